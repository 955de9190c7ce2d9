"""Queries of the text and vector problems (4, 6 to 10) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm.boilerplate import main_body
from lodespark.llm.bpe import encode_corpus
from lodespark.llm.groups import describe_groups, hashed_features, kmeans_clusters, similarity_groups
from lodespark.llm.packing import pack_texts, packing_report
from lodespark.llm.similar import most_similar
from lodespark.llm.splitting import cut_report, split_oversized
from lodespark.llm.vectors import as_arrays, packed_vectors
from lodespark.session import cut, table

#: Folder of the public vocabularies, the same on every worker.
TOKENIZERS = os.environ.get("LODESPARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Tokens of a container, and the attention cost of several texts in one: that of two of half its size.
CAPACITY, MOST_COST = 4096, 4096**2 // 2
#: Tokens of a piece.
LIMIT = 1024


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return packed_vectors(table(spark, d, "embedding_vectors"), "reddit_post_id", "embedding")


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """The up to five most similar posts of every post, with their cosines."""
    return most_similar(_vectors(spark, d)).withColumn("cosine", F.round("cosine", 9))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar(spark, d).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity_groups(_vectors(spark, d)).withColumnRenamed("id", "reddit_post_id")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """(id, term): the distinct keywords of each post, over all its rows."""
    words = table(spark, d, "reddit_post_new").select("id", F.explode(F.split(F.lower("keywords"), ",")).alias("term"))
    return words.select("id", F.trim("term").alias("term")).where("id is not null and term <> ''").distinct()


def p6_described(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size, its most typical posts and their keywords."""
    vectors = cut(_vectors(spark, d))
    return describe_groups(similarity_groups(vectors), as_arrays(vectors), _terms(spark, d))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means clusters of the posts by their keywords as hashed weighted features: size, nearest posts, keywords."""
    terms = _terms(spark, d)
    held = terms.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    vectors = cut(hashed_features(held, "id", F.col("terms")))
    return describe_groups(kmeans_clusters(vectors), vectors, terms, group="cluster")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body(table(spark, d, "reddit_post_new"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", BYTE_BPE)


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", BYTE_BPE, capacity=CAPACITY, max_cost=MOST_COST)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Fill and broken limits of the containers."""
    return packing_report(p9_packed(spark, d), "doc_id", CAPACITY, 256, MOST_COST)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", BYTE_BPE, limit=LIMIT)


def p10_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where the pieces end."""
    return cut_report(p10_pieces(spark, d), LIMIT)


QUERIES = {"p4_found": p4_found, "p4_similar": p4_similar, "p6_found": p6_found, "p6_described": p6_described, "p6_clusters": p6_clusters, "p7_found": p7_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p9_report": p9_report, "p10_pieces": p10_pieces, "p10_cuts": p10_cuts}
_UNIT = """
    u as (select reddit_post_id as id, try_cast(embedding as double[]) as v from embedding_vectors where reddit_post_id is not null group by all),
    ok as (select id, v from u where len(v) = 200 and len(list_filter(v, lambda x: not isfinite(coalesce(x, 'nan'::double)))) = 0 and list_max(list_transform(v, lambda x: abs(x))) > 0),
    pairs as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as c from ok a join ok b on a.id <> b.id and list_cosine_similarity(a.v, b.v) >= 0.57)"""

ORACLES: dict[str, str] = {
    "p4_found": f"""
        with {_UNIT},
        best as (select a, b from pairs qualify row_number() over (partition by a order by c desc, b desc) <= 5)
        select distinct least(a, b) as id_a, greatest(a, b) as id_b from best""",
    "p4_similar": f"""
        with {_UNIT}
        select a as id, b as other, round(c, 9) as cosine from pairs qualify row_number() over (partition by a order by c desc, b desc) <= 5""",
    "p6_found": f"""
        with recursive {_UNIT},
        reach as (select a as id, a as seen from pairs union select r.id, p.b from reach r join pairs p on p.a = r.seen)
        select id as reddit_post_id, min(seen) as group_first_id from reach group by id""",
}
