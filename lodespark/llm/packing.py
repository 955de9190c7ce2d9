"""Problem 9: texts of varying length packed into containers of fixed capacity.

Vector best fit: an item takes tokens, one document place and attention cost (its tokens squared) of a
container; of the containers in which it fits under every constraint, the weighted residual norm, or the
weighted dot product of item and residual, picks one. Items are spread over groups of bounded size by a
hash of key, text and, of repeated rows, the number of the repeat, so no key or source can make a group
large and the containers don't depend on how the table is partitioned. Each group is packed in one task,
longest items first; what is lost is at most a few last containers per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.bpe import count_tokens
from lodespark.session import spread


def best_fit(sizes: np.ndarray, limits: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Container number of each item of ``sizes`` (none above ``limits[0]``), by vector best fit decreasing.

    An item that alone breaks another limit has a container of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), dtype=np.int64)
    items = np.stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2], axis=1) / limits
    least = items.min(axis=0) if len(items) else np.zeros(3)
    free = np.empty((1024, 3))  # residuals of the open containers, in shares of the limits
    number = np.empty(1024, dtype=np.int64)
    opened = live = 0
    slack = 1e-12
    for i in order:
        item = items[i]
        room = free[:live]
        fits = np.flatnonzero((room[:, 0] >= item[0] - slack) & (room[:, 1] >= item[1] - slack) & (room[:, 2] >= item[2] - slack))
        if len(fits):
            if rule == "norm":
                left = room[fits] - item
                at = fits[np.argmin((left * left) @ weights)]
            else:
                at = fits[np.argmin(room[fits] @ (weights * item))]
        else:
            if live == len(free):
                free, number = np.concatenate([free, free]), np.concatenate([number, number])
            at = live
            free[at], number[at] = 1.0, opened
            live, opened = live + 1, opened + 1
        free[at] -= item
        place[i] = number[at]
        if (free[at] < least - slack).any():  # nothing fits any more: close it
            live -= 1
            free[at], number[at] = free[live], number[live]
    return place


def pack_texts(
    df: DataFrame,
    key: str,
    text: str,
    path: str,
    capacity: int = 4096,
    max_items: int = 256,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    group_rows: int = 6000,
) -> DataFrame:
    """``(container, key, piece_no, first_token, tokens)``: every text in a container, whole if it fits.

    A text above ``capacity`` tokens is cut into full pieces and a rest; only then has it more than one
    piece. Null and empty texts have 0 tokens and take a document place. ``max_cost`` bounds the sum of squared lengths of
    containers with several items; its default, ``capacity`` squared, never binds. Repeated rows, and rows with a null key,
    are items of their own. An empty table has no containers.
    """
    groups = max(1, -(-df.count() // group_rows))
    sized = spread(df.select(key, text)).select(F.col(key).alias("item"), F.xxhash64(key, text).alias("h"), count_tokens(path)(F.col(text)).alias("tokens"))
    same = sized.groupBy("item", "h", "tokens").agg(F.count("*").alias("n"))
    sized = same.select("item", "tokens", F.explode(F.sequence(F.lit(1), "n")).alias("copy"), "h").withColumn("h", F.xxhash64("h", "copy")).drop("copy")
    sized = sized.withColumn("grp", F.pmod("h", F.lit(groups)).cast("int")).repartition(groups, "grp")  # a number given is kept
    limits = np.array([capacity, max_items, max_cost or capacity**2], dtype=float)
    w = np.array(weights)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "tokens"], kind="stable")
        tokens = rows["tokens"].to_numpy()
        pieces = np.maximum(1, -(-tokens // capacity))
        at = np.repeat(np.arange(len(rows)), pieces)
        number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = number * capacity
        size = np.minimum(capacity, tokens[at] - first)
        place = best_fit(size, limits, w, rule)
        return pd.DataFrame(
            {"container": [f"{rows['grp'].iloc[0]}-{p}" for p in place], "item": rows["item"].to_numpy()[at], "piece_no": number + 1, "first_token": first, "tokens": size}
        )

    kind = dict(sized.dtypes)["item"]
    packed = sized.groupBy("grp").applyInPandas(pack, f"container string, item {kind}, piece_no bigint, first_token bigint, tokens bigint")
    return packed.withColumnRenamed("item", key)


def packing_report(packed: DataFrame, key: str, capacity: int, max_items: int, max_cost: int) -> DataFrame:
    """``(containers, pieces, tokens, fill, over_tokens, over_items, over_cost)``: how full the containers are, and how many break a limit.

    A container of one item may exceed the cost alone. An empty packing has a null fill and zeros.
    """
    t = F.col("tokens").cast("double")
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum(t * t).alias("c"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.round(F.try_divide(F.sum("t"), F.count("*") * capacity), 4).alias("fill"),
        F.count_if(F.col("t") > capacity).alias("over_tokens"),
        F.count_if(F.col("n") > max_items).alias("over_items"),
        F.count_if((F.col("c") > max_cost) & (F.col("n") > 1)).alias("over_cost"),
    )
