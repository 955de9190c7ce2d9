"""Keyphrases, word counts, chunks, turns, extraction from scanned text, fairness shares."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.text import STOP_WORDS, phrases, words
from lodespark.session import spread

#: Patterns of the fields of a scanned well file; the first group is the field.
WELL_FIELDS = {
    "file_no": r"WELL FILE W(\d+)",
    "operator": r"Well Operator\s*:\s*([^\n\r]+)",
    "well_name": r"Well Name\s*:\s*([^\n\r]+)",
    "job_id": r"\bJob (\d+)\b",
    "job_type": r"Type of Incident\s*:\s*([^\n\r]+)",
    "county": r"County\s*:\s*([^\n\r]+)",
    "latitude": r"(\d+°\d+'\d+\.\d+\"[NS])",
    "longitude": r"(\d+°\d+'\d+\.\d+\"[EW])",
    "datum": r"Vertical Datum to DDZ\s+([\d.]+ ft)",
    "date_simulated": r"Date Stimulated\s*\n\s*(\d{1,2}/\d{1,2}/\d{4})",
    "formation": r"Stimulated Formation\s*\n\s*([^\n\r]+)",
    "top_bottom_stages": r"Top \(Ft\)\s*Bottom \(Ft\)\s*Stimulation Stages\n\s*(\d+\s+\d+\s+\d+)",
    "psi": r"([\d,]+)\s*psi(?:[^A-Za-z]|$)",
    "lbs": r"([\d,]+)\s*lbs(?:[^A-Za-z]|$)",
    "type_treatment": r"Type Treatment\s*\n\s*([^\n\r]+)",
    "volume": r"Volume Units\s*\n(\d+\s*\w+)",
    "max_treatment_rate": r"Maximum Treatment Rate \(BBLS/Min\)\s*\n\s*(\d+(?:\.\d+)?)",
}
#: Fixed value: an API number in any of its spellings.
API_NUMBER = r"\b(\d{2}\s*-\s*\d{3}\s*-\s*\d{5}|API\s*#?\s*:?\s*\d{10})\b"


def rake(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """``(key, phrase, score)``: the ``top`` phrases of each text by the summed degree/frequency of their words.

    Counted within the text, each distinct phrase listed once; ties by phrase. Null keys and texts
    without phrases have no rows.
    """
    p = df.select(F.col(key).alias("key"), F.explode(phrases(F.col(text))).alias("phrase")).where("key is not null")
    p = p.groupBy("key", "phrase").agg(F.count("*").alias("times")).withColumn("w", F.split("phrase", " "))
    per_word = p.select("key", F.col("times"), F.size("w").alias("len"), F.explode("w").alias("word"))
    score = per_word.groupBy("key", "word").agg(F.sum(F.col("times") * F.col("len")).alias("degree"), F.sum("times").alias("freq"))
    each = p.select("key", "phrase", F.explode("w").alias("word")).join(score, ["key", "word"])
    total = each.groupBy("key", "phrase").agg(F.round(F.sum(F.col("degree") / F.col("freq")), 6).alias("score"))
    place = Window.partitionBy("key").orderBy(F.desc("score"), "phrase")
    return total.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= top).select(F.col("key").alias(key), "phrase", "score")


def top_words(df: DataFrame, text: str, k: int = 20) -> DataFrame:
    """Most frequent words of three letters and more that are no stop words; ties by word."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    w = df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.where(~F.array_contains(stop, F.col("word"))).orderBy(F.desc("n"), "word").limit(k)


def family_presence(df: DataFrame, text: str, by: str, families: dict[str, list[str]]) -> DataFrame:
    """Rows per group whose text holds any word of a family as a substring."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(by).agg(*[F.count_if(low.rlike("|".join(ws))).alias(name) for name, ws in families.items()])


def chunk(text: str, size: int = 500, overlap: int = 100, separator: str = "\n") -> list[str]:
    """Parts of ``text`` merged up to ``size`` characters, the last parts within ``overlap`` repeated; a longer part stays whole."""
    out, held, n = [], [], 0
    for part in (p for p in text.split(separator) if p):
        if held and n + len(part) + len(separator) > size:
            out.append(separator.join(held))
            while held and (n > overlap or n + len(part) + len(separator) > size):
                n -= len(held.pop(0)) + (len(separator) if held else 0)
        n += len(part) + (len(separator) if held else 0)
        held.append(part)
    if held:
        out.append(separator.join(held))
    return out


def chunks(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """``(key, chunk_no, chunk)``; null and empty texts have none."""
    kind = dict(df.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) if t for i, c in enumerate(chunk(t, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return spread(df.select(key, text)).mapInPandas(task, f"`{key}` {kind}, chunk_no bigint, chunk string")


def turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pair, user, bot)``: chat turns paired in order, the last pair first in number 0."""
    parts = F.filter(F.split(F.col(text), r"\n\n(?=User: |Assistant: )"), lambda p: p.rlike("^(?:User|Assistant): "))
    t = df.select(F.col(key).alias("key"), F.posexplode(parts).alias("turn", "said"))
    pair = t.groupBy("key", F.floor(F.col("turn") / 2).alias("at")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("said"))).alias("user"), F.max(F.when(F.col("turn") % 2 == 1, F.col("said"))).alias("bot")
    )
    order = Window.partitionBy("key").orderBy(F.desc("at"))
    return pair.select(F.col("key").alias(key), (F.row_number().over(order) - 1).cast("bigint").alias("pair"), "user", "bot")


def well_fields(text: Column) -> dict[str, Column]:
    """First group of each field's pattern, '' where it is not found; a job without a number has that of its file."""
    found = {name: F.coalesce(F.trim(F.regexp_extract(text, pattern, 1)), F.lit("")) for name, pattern in WELL_FIELDS.items()}
    return found | {"job_id": F.when(found["job_id"] == "", found["file_no"]).otherwise(found["job_id"])}


def api_numbers(text: Column) -> Column:
    """Distinct API numbers of a text, as XX-XXX-XXXXX, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(API_NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^(\d{2})(\d{3})(\d{5})$", "$1-$2-$3"))))


def group_bias(df: DataFrame, group: str, label: str) -> DataFrame:
    """Share of each label in each group against its share overall: ``(group, label, pct, baseline, deviation)``.

    On the full grid of groups and labels, so that an absent label deviates by its whole baseline.
    """
    d = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    n = d.groupBy(group, label).agg(F.count("*").alias("n"))
    per_group = n.groupBy(group).agg(F.sum("n").alias("gn"))
    base = n.groupBy(label).agg(F.sum("n").alias("ln")).crossJoin(F.broadcast(n.agg(F.sum("n").alias("all"))))
    # the grid of two aggregated lists of distinct values, not of rows
    grid = per_group.join(base).join(n, [group, label], "left")
    pct, baseline = F.coalesce("n", F.lit(0)) * 100.0 / F.col("gn"), F.col("ln") * 100.0 / F.col("all")
    return grid.select(group, label, F.round(pct, 6).alias("pct"), F.round(baseline, 6).alias("baseline"), F.round(pct - baseline, 6).alias("deviation"))


def weighted_errors(df: DataFrame, by: list[str], freq: str, predicted: str, wanted: str = "PER") -> DataFrame:
    """Frequency-weighted errors: 1 not tagged as ``wanted``, 2 tagged as something else, 3 not tagged; 0 if empty."""
    tag = F.coalesce(F.col(predicted), F.lit("O"))
    right = tag.endswith(wanted)
    part = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, F.col(freq)).otherwise(0)), F.sum(freq)), F.lit(0.0))
    return df.groupBy(*by).agg(part(~right).alias("type1"), part(~right & (tag != "O")).alias("type2"), part(tag == "O").alias("type3"))
