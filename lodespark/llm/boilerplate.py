"""Problem 7: the main body of pages that mix it with the rest of their site.

Site style tree over text blocks: the pages of a host are merged, a node being a block's text with
numbers, the site's name and the page's own topic masked. A node's importance is entropy based: within
the host, one less the normalised entropy of its spread over the host's pages; across hosts, how many
hosts it has against how many it would have if it belonged to no site. Nodes of low importance are
removed. Blocks too rare for either are judged by a naive Bayes model learned from the clear nodes, and
short blocks by the branch they stand in: teaser runs, menus, or the run from headline to last paragraph.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut, spread

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"^\s*(?:[-*•·–+]|\d{1,2}[.)])\s+")
_SEPARATED = re.compile(r"\S\s*(?:\||·|›|»|\s/\s|\s>\s)\s*\S|\S {2,}\S")
_CRUMB = re.compile(r"\S\s+[>›»]\s+\S")
#: Documented bound of the fit of the word model: nodes per class.
SAMPLE_NODES = 20_000
#: Keys from this length on are counted by a hash of 128 bits.
LONG_KEY = 200


def site_of(host: str) -> str:
    """Name of the site: the host's first label after www, m or blog."""
    labels = [x for x in (host or "").lower().split(".") if x]
    while len(labels) > 2 and labels[0] in ("www", "m", "blog", "mobile", "amp"):
        labels = labels[1:]
    return labels[0] if labels else ""


def words_of(text: str, site: str = "") -> list[str]:
    """Lower-case words without those with digits; the site's name is ``@``."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        if any(c.isdigit() for c in w):
            continue
        out.append("@" if site and w == site else w)
    return out


def masked(words: list[str], topic: set[str], starts: tuple[str, ...]) -> str | None:
    """The words with the page's own topic as ``#``; None where nothing is masked or nothing is left."""
    out: list[str] = []
    hit = False
    for i, w in enumerate(words):
        own = w in topic or (i == len(words) - 1 and len(w) < 10 and any(t.startswith(w) for t in starts))
        hit |= own and len(w) > 3
        if own:
            if not out or out[-1] != "#":
                out.append("#")
        else:
            out.append(w)
    return " ".join(out) if hit and any(x not in "#@" for x in out) else None


def page_nodes(host: str, title: str, content: str) -> list[tuple[int, list[str]]]:
    """``(line_no, keys)`` of each line that is not blank: its words, the same with the topic masked, its opening (``^``)."""
    site = site_of(host)
    topic = set(words_of(title))
    starts = tuple(topic)
    nodes = []
    for n, line in enumerate(content.split("\n"), 1):
        if line.strip():
            words = words_of(line, site)
            keys = [" ".join(words) or line.strip()]
            if len(words) <= 16:
                keys += filter(None, [masked(words, topic, starts)])
                keys += ["^" + " ".join(words[:k]) for k in (1, 2) if len(words) > k]
            nodes.append((n, keys))
    return nodes


class WordModel:
    """Naive Bayes log-odds of words and word pairs: boilerplate above zero, content below."""

    def __init__(self, boiler: list[str], content: list[str]):
        counts = [Counter(), Counter()]
        for side, keys in zip(counts, (boiler, content)):
            for k in keys:
                side.update(set(self._terms(k.split())))
        n = [max(1, len(boiler)), max(1, len(content))]
        self.odds = {
            t: math.log((counts[0][t] + 0.3) / (n[0] + 0.6)) - math.log((counts[1][t] + 0.3) / (n[1] + 0.6))
            for t in counts[0].keys() | counts[1].keys()
            if counts[0][t] + counts[1][t] > 1
        }

    @staticmethod
    def _terms(words: list[str]) -> list[str]:
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def score(self, words: list[str]) -> float:
        terms = [self.odds[t] for t in self._terms(words) if t in self.odds]
        return sum(terms) / (1 + 0.5 * len(terms)) if terms else 0.0


def judge_page(host: str, title: str, content: str, evidence: dict[int, tuple[float, float]], model: WordModel, headlines: set[int]) -> list[int]:
    """Line numbers of the main body.

    ``evidence`` has, for lines with statistics, what is known across hosts and within the host; above 0
    speaks for boilerplate, below 0 for content. ``headlines`` are the lines made of words of titles.
    """
    site = site_of(host)
    head = " ".join(words_of(title, site))
    lines = content.split("\n")
    raw = any(c.isupper() for c in content)
    rows = []  # [line_no, words, verdict]: verdict 1 body, -1 not, 0 open
    seen_head = False
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        words = words_of(line, site)
        key = " ".join(words)
        marked = bool(_MARK.match(line))
        sentence = line.rstrip().endswith((".", "!", "?", '"', "”", "…", ":")) if raw else len(words) >= 9
        bayes = max(-1.5, min(1.5, model.score(words)))
        if n in evidence:
            across, within = evidence[n]
            mixed = abs(across) < 0.7 and len(words) <= 3  # a menu item here, a subhead there
            score = across + (0.3 * within if across < 0 or mixed else within) + (0.2 if abs(across) > 0.5 or mixed else 0.6) * bayes
        else:
            across, mixed, score = 0.0, False, bayes
        if "@" in words and len(words) <= 16:
            score += 0.6
        if head and not seen_head and (key == head or (len(words) >= 3 and head.startswith(key) and len(key) > 0.8 * len(head))):
            seen_head, verdict = True, 2
        elif raw and (_CRUMB.search(line) or _SEPARATED.search(line) and not sentence):
            verdict = -1
        elif n in headlines and not marked and not (raw and line.rstrip().endswith(".")):
            verdict = -1  # reads like a headline, but not this page's
        elif len(words) >= 9:
            verdict = -1 if score > (0.7 if n in evidence and len(words) <= 16 else 1.1) else 1
        elif score > 0.8 and not mixed or not words:
            verdict = -1
        elif score < -0.9 and len(words) >= 4:
            verdict = 1
        else:
            verdict = 0
        rows.append([n, words, verdict, score, marked])
    solid = [i for i, r in enumerate(rows) if r[2] == 1 and len(r[1]) >= 8]
    if not solid:
        return []
    heads = [i for i, r in enumerate(rows) if r[2] == 2]
    first = heads[0] if heads and heads[0] < solid[-1] else solid[0]
    last = solid[-1]
    following = [-1] * len(rows)  # verdict of the next block that is not open
    for i in range(len(rows) - 2, -1, -1):
        following[i] = rows[i + 1][2] or following[i + 1]
    for i, r in enumerate(rows):  # open blocks belong to the branch around them
        if r[2]:
            continue
        before = rows[i - 1][2] if i else -1
        after = following[i]
        inside = first <= i <= last
        lean = -r[3] + (0.6 if inside else -0.7) + (0.35 if before > 0 else -0.35) + (0.35 if after > 0 else -0.35)
        if r[4]:
            lean += 0.3 if inside or before > 0 else 0.0
        r[2] = 1 if lean > 0 else -1
    return [r[0] for r in rows if r[2] > 0]


def main_body(posts: DataFrame, least_pages: int = 4) -> DataFrame:
    """``(id, line_no)``: the lines of each page's main body; lines are split at ``\\n`` and counted from 1.

    ``posts`` has ``id, title, url, content``. A post counts once: of several rows with content the one
    with the largest content text counts. Null ids, null or blank contents and error pages have no rows;
    a null title or url is an empty one. Statistics are over all blocks of all pages; with few pages per host the word
    model and the page's own structure decide.
    """
    pages = posts.where(F.col("id").isNotNull() & F.col("content").isNotNull() & (F.trim("content") != ""))
    pages = pages.groupBy("id").agg(F.max(F.struct("content", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"))).alias("p"))
    host = F.lower(F.regexp_extract("p.url", r"://([^/?#:]+)", 1))
    pages = cut(pages.select("id", host.alias("host"), "p.title", "p.content"))
    total = pages.count()
    kind = pages.schema["id"].dataType.simpleString()
    if not total:
        return pages.select("id", F.lit(0).cast("bigint").alias("line_no"))

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, t, c in zip(b["id"], b["host"], b["title"], b["content"]):
                for n, keys in page_nodes(h, t, c):
                    rows += [(i, h, n, k) for k in keys]
            yield pd.DataFrame(rows, columns=["id", "host", "line_no", "key"])

    texts = cut(spread(pages).mapInPandas(nodes, f"id {kind}, host string, line_no int, key string"))
    is_long = F.length("key") >= LONG_KEY
    node = F.when(is_long, F.concat(F.lit("~"), F.md5("key"))).otherwise(F.col("key"))
    found = texts.withColumns({"key": node, "long": is_long})
    # bounded: hosts by power of their share
    by_host = pages.groupBy("host").agg(F.count("*").alias("m"))
    sizes = by_host.groupBy(F.round(F.log("m") * 4).alias("bin")).agg(F.avg("m").alias("m"), F.count("*").alias("hosts")).collect()
    sizes = [(r["m"] / total, r["hosts"]) for r in sizes]
    # words of two titles or more, whatever the number of pages; a line reads like a headline if it has 4 to 14
    # words and all are such, but for up to two before the first
    title_words = cut(
        pages.select("id", F.explode(F.array_distinct(F.split(F.lower("title"), r"(?U)[\W_]+"))).alias("w"))
        .where(r"w <> '' and not w rlike '(?U)\\d'").groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    )
    words = F.split("key", " ")
    lines = found.where(~F.col("long") & F.size(words).between(4, 16) & ~F.col("key").rlike("#|^\\^")).select("key").distinct()
    known = lines.select("key", F.size(words).alias("size"), F.posexplode(words).alias("at", "w"))
    known = known.join(F.broadcast(title_words) if title_words.count() < 100_000 else title_words, "w")
    headlines = known.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("lead"), F.first("size").alias("size"))
    headlines = headlines.where("lead <= 2 and n = size - lead and n between 4 and 14").select("key", F.lit(True).alias("foreign"))

    per_host = cut(found.select("host", "key", "long", "id").distinct().groupBy("host", "key", "long").agg(F.count("*").alias("n")))
    spread_over = per_host.groupBy("key", "long").agg(F.sum("n").alias("n"), F.count("*").alias("h")).where(f"n >= {least_pages}")

    expected = F.lit(0.0)
    for share, hosts in sizes:
        expected = expected + hosts * (1 - F.pow(F.lit(1 - share), F.col("n")))
    spread_over = spread_over.withColumn("short", F.try_divide(expected - F.col("h"), F.sqrt(expected * 0.5)))
    # evidence across hosts: held by some sites only (above 0), or lying evenly over all (below 0)
    across = F.when(F.col("short") > 1.2, F.least((F.col("short") - 1.2) * 0.6, F.lit(3.0))).otherwise((F.col("short") - 1.2) * F.least(F.col("n") / 40, F.lit(1.0)))
    one_host = F.lit(len([1 for _, h in sizes for _ in range(min(h, 2))]) < 2)
    spread_over = spread_over.withColumn("across", F.when(one_host, F.lit(0.0)).otherwise(F.least(across, F.lit(3.0))))
    # an opening speaks only for boilerplate: that of a common sentence says nothing
    spread_over = cut(spread_over.where("key not like '^%' or across > 0.6"))
    inside = per_host.where("n > 1").join(F.broadcast(by_host) if by_host.count() < 100_000 else by_host, "host")
    entropy = F.try_divide(F.log("n"), F.log("m"))  # 1 less this is the node's importance in its host
    inside = inside.where("m >= 5 and key not like '^%'").select("host", "key", F.greatest(F.lit(0.0), (entropy - 0.55) * 4).alias("within"))
    evidence = (
        found.join(spread_over.select("key", "across"), "key", "left").join(headlines, "key", "left").join(inside, ["host", "key"], "left")
        .where("across is not null or within is not null or foreign")
        .groupBy("id", "line_no")
        .agg(F.max("across").alias("hi"), F.min("across").alias("lo"), F.max("within").alias("within"), F.max("foreign").alias("foreign"))
    )
    # a node that clearly lies evenly over the hosts keeps that credit, whatever its opening or its host say
    evidence = evidence.select(
        "id",
        "line_no",
        F.round(F.when((F.col("lo") < -0.8) | (F.col("lo") < -0.2) & ~(F.coalesce("hi", F.lit(0.0)) > 0.6), F.col("lo")).otherwise(F.coalesce("hi", F.lit(0.0))), 3).alias("a"),
        F.round(F.coalesce("within", F.lit(0.0)), 3).alias("w"),
        F.coalesce("foreign", F.lit(False)).alias("foreign"),
        F.expr("hi is not null or within is not null").alias("counted"),
    )
    evidence = evidence.groupBy("id").agg(F.collect_list(F.struct("line_no", "a", "w", "foreign", "counted")).alias("evidence"))

    hashed = F.xxhash64("key")

    def sampled(held: DataFrame) -> list[str]:
        """The texts of a bounded sample of nodes; those of hashed ones are read back."""
        held = cut(held.orderBy(hashed).limit(SAMPLE_NODES).select("key", "long"))
        long = texts.where(is_long).select(node.alias("key"), F.col("key").alias("text")).join(F.broadcast(held.where("long").select("key")), "key")
        text = long.groupBy("key").agg(F.min("text").alias("text")).select("text")
        return held.where("not long").select("key").union(text).toPandas()["key"].tolist()

    boiler = sampled(spread_over.where("across > 0.9 and key not like '^%'"))
    lone = per_host.where((F.col("n") == 1) & ~F.col("long") & (F.size(F.split("key", " ")) >= 12) & ~F.col("key").rlike("#|^\\^"))
    even = sampled(spread_over.where("across < -0.5"))
    content = lone.orderBy(hashed).limit(SAMPLE_NODES).select("key").toPandas()["key"].tolist()
    model = WordModel(boiler, content + even * max(1, len(content) // (20 * max(1, len(even)))))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, t, c, e in zip(b["id"], b["host"], b["title"], b["content"], b["evidence"]):
                e = e if e is not None else []
                held = {x["line_no"]: (x["a"], x["w"]) for x in e if x["counted"]}
                rows += [(i, n) for n in judge_page(h, t, c, held, model, {x["line_no"] for x in e if x["foreign"]})]
            yield pd.DataFrame(rows, columns=["id", "line_no"])

    judged = pages.join(evidence, "id", "left")
    return judged.mapInPandas(judge, f"id {kind}, line_no bigint")
