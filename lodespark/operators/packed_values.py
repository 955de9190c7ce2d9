"""Problem 2: fields that hold several values, split into one value per row with its place.

The field is split on its quote character: odd pieces are literals, even pieces are split on
delimiters, and an array fold puts the values together again with their ordinals. Everything is a
JVM expression on the row itself, so there is no shuffle and no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say that there is nothing.
NOTHING = ("", "-", "--", "?", "none", "n/a", "na", "nil", "null", "nan", "unknown", "not available", "not reported", "none reported", "[]")
_MARK = "\u0001"
_HARD = r"\s*(?:[;|/\\:_·•、，>+&–—]|(?<=\d)\s+to\s+(?=\d)|(?<=[\d\s])-(?=[\d\s]))\s*"
_BLANK = r"(?<=[^\s\u0001])\s+(?=[^\sA-Za-z\u0001(])"
#: A run with commas that is one number: thousands marks, or one decimal comma.
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+,\d{1,2}"


def with_places(df: DataFrame, text: str) -> DataFrame:
    """Adds ``places``, an ``array<string>`` of the places of ``text``; an empty place is an empty string.

    Null for a null or blank text or a mere word for nothing. Rules: outer brackets are dropped. The
    quote character is ``"`` where the text has one, else ``'`` where the text begins with it; doubled
    quotes in a literal count as one. Delimiters outside literals: ``; | / \\ : _ > + &``, dots and
    dashes between values, ``to``, blanks before anything but a word, and commas, unless every comma
    run that other delimiters leave is one number. Blanks in a row, and around another delimiter, are
    one separator. A blank before a word belongs to the value (``9 ft``). An unpaired quote is dropped.
    The steps are columns of their own, so that each runs once per row.
    """
    df = df.withColumn("s", F.regexp_replace(F.translate(text, "\u00a0\u2007\u202f", "   "), r"^\s*\[|\]\s*$", ""))
    df = df.where(F.col("s").isNotNull() & ~F.lower(F.regexp_replace("s", r"^\s+|\s+$", "")).isin(*NOTHING))
    df = df.withColumn("quote", F.when(F.col("s").contains('"'), '"').when(F.col("s").rlike(r"^\s*'"), "'").otherwise("\u0002"))
    df = df.withColumn("pieces", F.split("s", F.col("quote"), -1))
    paired = F.size("pieces") % 2 == 1
    df = df.withColumn("pieces", F.when(paired, F.col("pieces")).otherwise(F.array(F.regexp_replace("s", "[\"']", ""))))
    df = df.withColumn("plain", F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 0, p).otherwise("\u0003")), ""))
    df = df.withColumn("cut", F.regexp_replace("plain", _HARD, _MARK))
    runs = F.filter(F.split("cut", r"[\u0001\s\u0003A-Za-z]+"), lambda r: r.contains(","))
    alone = ~F.regexp_replace(F.trim("cut"), _BLANK, _MARK).contains(_MARK) & ~F.col("plain").rlike(r"^\s*\d{1,3},\d{3}\s*$")
    by_comma = F.col("plain").rlike(r"\u0003\s*,|,\s*\u0003|,\s|\s,|^,|,$") | alone | F.exists(runs, lambda r: ~r.rlike(f"^(?:{_NUMBER})$"))
    df = df.withColumns({"by_comma": by_comma, "last": F.size("pieces") - 1})

    def even(p: Column) -> Column:
        hard = F.regexp_replace(p, _HARD, _MARK)
        return F.regexp_replace(F.when(F.col("by_comma"), F.regexp_replace(hard, r"\s*,\s*", _MARK)).otherwise(hard), _BLANK, _MARK)

    def piece(p: Column, i: Column) -> Column:
        inner = (i > 0) & (i < F.col("last"))
        return (
            F.when(i % 2 == 1, F.translate(p, _MARK, " "))
            .when(inner & (p == ""), F.col("quote"))
            .when(inner & p.rlike(r"^\s*$"), F.lit(_MARK))
            .otherwise(even(p))
        )

    df = df.withColumn("marked", F.transform("pieces", piece))
    folded = F.aggregate("marked", F.lit(""), lambda acc, p: F.concat(acc, p))
    places = F.transform(F.split(folded, _MARK, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return df.withColumn("places", places).drop("s", "quote", "pieces", "plain", "cut", "by_comma", "last", "marked")


def unpack_values(df: DataFrame, key: str, packed: str) -> DataFrame:
    """``(key, piece_no, piece)``: every value of ``packed`` on its own row, places counted from 1.

    An empty place is counted but not listed. Rows with a null field give nothing; a null key is kept.
    Repeated rows are kept as they are. Other columns of ``df`` are not read, so their names can't clash.
    """
    held = with_places(df.select(F.col(key).alias("key"), F.col(packed).alias("packed")), "packed")
    pieces = held.select("key", F.posexplode("places").alias("pos", "piece"))
    return pieces.where(F.col("piece") != "").select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("bigint").alias("piece_no"), "piece"
    )
