"""Queries of the mining operators: itemsets, similarity, recommendation, graphs, clusters, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.operators import clustering as C
from lodespark.operators import graph as G
from lodespark.operators import itemsets as I
from lodespark.operators import recommend as M
from lodespark.operators import set_similarity as S
from lodespark.operators import sketches as K
from lodespark.operators.components import connected_components
from lodespark.plans.relational_queries import BASKETS, RATINGS, baskets, ratings
from lodespark.session import cut, slots
from lodespark.session import table as t


def _support(b: DataFrame, share: float) -> int:
    """A share of the baskets as a number, at least 2."""
    return max(2, int(b.select("basket").distinct().count() * share))


def q_frequent_itemsets(s: SparkSession, d: str) -> DataFrame:
    """All brand sets in at least 1 in 2,000 orders, of any size."""
    b = cut(baskets(s, d))
    return I.frequent_itemsets(b, _support(b, 0.0005)).select("size", F.array_join("items", ",").alias("items"), "support")


def q_frequent_pairs(s: SparkSession, d: str) -> DataFrame:
    b = baskets(s, d)
    return I.frequent_itemsets(b, _support(b, 0.02), 2).where("size = 2").select(F.array_join("items", ",").alias("items"), "support")


def q_pcy_pairs(s: SparkSession, d: str) -> DataFrame:
    """The same pairs through hash buckets."""
    b = baskets(s, d)
    return I.pcy_pairs(b, _support(b, 0.02)).select(F.concat_ws(",", "a", "b").alias("items"), "support")


def q_pcy_itemsets(s: SparkSession, d: str) -> DataFrame:
    """Sets of any size through hash buckets before each level."""
    b = cut(baskets(s, d))
    return I.pcy_itemsets(b, _support(b, 0.0005)).select("size", F.array_join("items", ",").alias("items"), "support")


def q_local_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of four slices by order number, of any size (F03); depends on the slicing."""
    b = cut(baskets(s, d))
    return I.local_candidates(b, _support(b, 0.008), 4, F.col("basket")).select("size", F.array_join("items", ",").alias("items"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    return S.shingle_sets(t(s, d, "documents"), "doc_id", "text")


def q_jaccard_classes(s: SparkSession, d: str) -> DataFrame:
    """Each document's class and number of links at Jaccard 0.8 of five-word shingles, exactly."""
    return S.similarity_classes(_sets(s, d), S.jaccard_pairs, 0.8)


def q_lsh_classes(s: SparkSession, d: str) -> DataFrame:
    """The same through MinHash and 20 bands of 3 (L01, J04), verified exactly."""
    return S.similarity_classes(_sets(s, d), lambda x, least: S.banded_pairs(x, least, 20, 3), 0.8)


def q_minhash_signature(s: SparkSession, d: str) -> DataFrame:
    """Each customer's signature of 60 values over the numbers of its parts."""
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = t(s, d, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("items"))
    return parts.select("o_custkey", F.posexplode(S.signature(F.col("items"))).alias("h", "least"))


def q_lsh_keywords(s: SparkSession, d: str) -> DataFrame:
    """Posts whose keyword sets are half alike and more, through 30 bands of 2 (L01): class and number of links."""
    k = _keywords(s, d, "id").groupBy("user").agg(F.array_sort(F.collect_set(F.xxhash64("item"))).alias("items"))
    sets = k.select(F.col("user").alias("id"), "items", F.concat_ws("/", F.size("items"), F.md5(F.array_join("items", ","))).alias("digest"))
    return S.similarity_classes(sets, lambda x, least: S.banded_pairs_packed(x, least, 30, 2), 0.5)


def _held_out() -> str:
    return "(user_id * 31 + cast(substring(item, 7) as int) * 17) % 10 = 0"


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = cut(ratings(s, d))
    return r.where(f"not {_held_out()}"), r.where(_held_out())


def q_item_similarity(s: SparkSession, d: str) -> DataFrame:
    """Similarity of brands by their co-raters."""
    return M.item_similarity(ratings(s, d)).select("item_a", "item_b", "n", F.round("sim", 6).alias("sim"))


def q_cf_predict(s: SparkSession, d: str) -> DataFrame:
    """Predictions of held-out ratings."""
    train, test = _split(s, d)
    return M.predict_cf(train, test, cut(M.item_similarity(train))).select("user_id", "item", F.round("prediction", 4).alias("prediction"))


def q_feature_table(s: SparkSession, d: str) -> DataFrame:
    """Features of the held-out pairs."""
    train, test = _split(s, d)
    f = M.feature_table(train, test.select("user_id", "item"))
    return f.select("user_id", "item", *[F.round(c, 8).alias(c) for c in M.FEATURES])


def _measures(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list]:
    """Measures of users and items from customers, orders, parts and lines; some of each are missing."""
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("review_count"), *[F.count_if(F.col("o_orderstatus") == x).alias(n) for x, n in (("F", "useful"), ("O", "funny"), ("P", "cool"))]
    )
    k = F.col("c_custkey")
    u = t(s, d, "customer").where("c_custkey % 10 <> 3").join(o, "c_custkey").select(
        k.alias("user_id"), "review_count", (k % 5 + 1).alias("average_stars"), F.col("c_nationkey").alias("fans"), "useful", "funny", "cool",
        F.when(k % 4 == 0, "None").otherwise(F.array_join(F.array_repeat(F.lit("f"), (k % 6 + 1).cast("int")), ",")).alias("friends"),
        F.when(k % 3 > 0, F.array_join(F.array_repeat(F.lit("2020"), (k % 3).cast("int")), ",")).alias("elite"),
        F.format_string("%d-05-01", F.lit(2005) + k % 20).alias("since"), (k % 7).cast("string").alias("hot"), F.lit("bad").alias("cute"),
    )
    p = t(s, d, "part").groupBy(F.col("p_brand").alias("item")).agg(F.count("*").alias("n"), F.min("p_size").cast("int").alias("low"))
    attributes = F.create_map(F.lit("RestaurantsPriceRange2"), (F.col("low") % 4 + 1).cast("string"), F.lit("ByAppointmentOnly"), F.when(F.col("n") % 2 == 0, "True").otherwise("False"))
    i = p.where("item <> 'Brand#5'").select("item", (F.col("n") % 5 + 1).alias("stars"), F.col("n").alias("review_count"), F.when(F.col("n") % 3 > 0, attributes).alias("attributes"))
    li = t(s, d, "lineitem").join(M.small(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))), "l_partkey")
    years = li.where("item <> 'Brand#7'").groupBy("item").agg(F.array_join(F.array_sort(F.collect_set(F.year("l_shipdate").cast("string"))), ",").alias("date"))
    photos = li.where("item <> 'Brand#9'").select("item", F.when(F.col("l_returnflag") == "R", "food").otherwise("menu").alias("label"))
    tips = li.where("item <> 'Brand#11'").select("item", F.col("l_quantity").cast("int").alias("likes"))
    return M.user_measures(u, ["hot", "cute"]), M.item_measures(i), M.side_measures(years, photos, tips)


def q_wide_features(s: SparkSession, d: str) -> DataFrame:
    """28 measures of the held-out pairs with defaults."""
    train, test = _split(s, d)
    f = M.wide_features(test.select("user_id", "item"), train, *_measures(s, d))
    return f.select("user_id", "item", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in M.WIDE])


def q_hybrid(s: SparkSession, d: str) -> DataFrame:
    """A boosted model of 100 rounds and a forest over all features, .65 and .35, blended with the collaborative part; RMSE of each."""
    train, test = _split(s, d)
    measures = _measures(s, d)
    features = [*M.FEATURES, *M.WIDE]
    base = cut(M.wide_features(M.feature_table(train, train), train, *measures))
    asked = cut(M.wide_features(M.feature_table(train, test.withColumnRenamed("rating", "truth")), train, *measures))
    model = M.boosted(base, asked, depth=6, rounds=100, step=0.1, features=features, out="one")
    model = M.forest(base, model, features=features, out="two")
    model = model.withColumn("model", F.col("one") * 0.65 + F.col("two") * 0.35)
    cf = M.predict_cf(train, test, cut(M.item_similarity(train, one_divisor=5.3)), top=20)
    j = model.select("user_id", "item", "truth", "one", "two", "model", "u_n").join(cf, ["user_id", "item"])
    w = M.blend_weight(F.col("co_rated"), F.col("u_n") == 0)
    j = j.withColumns({"hybrid": F.col("prediction") * 0.12 + F.col("model") * 0.88, "dynamic": F.least(F.greatest(w * F.col("prediction") + (1 - w) * F.col("model"), F.lit(1.0)), F.lit(5.0))})
    rmse = lambda c: F.round(F.sqrt(F.avg(F.pow(F.col(c) - F.col("truth"), 2))), 4).alias(f"rmse_{c}")
    return j.agg(F.count("*").alias("n"), *map(rmse, ("one", "two", "model", "prediction", "hybrid", "dynamic")))


def _keywords(s: SparkSession, d: str, by: str) -> DataFrame:
    """(user, item): authors (or posts) with the keywords of their posts; grows with the posts and stays populated at any scale."""
    p = t(s, d, "reddit_post_new").select(F.col(by).alias("user"), F.explode(F.split(F.lower("keywords"), ",")).alias("item"))
    return p.select("user", F.trim("item").alias("item")).where("user is not null and item <> ''").distinct()


def _edges(s: SparkSession, d: str, least: int = 4) -> DataFrame:
    return G.cooccurrence_edges(_keywords(s, d, "author"), least)


def q_graph_edges(s: SparkSession, d: str) -> DataFrame:
    """Authors that share at least four keywords."""
    return _edges(s, d)


def q_components(s: SparkSession, d: str) -> DataFrame:
    """Their components, from the edges that join something."""
    return connected_components(cut(G.cooccurrence_forest(_keywords(s, d, "author"), 4)))


def q_label_propagation(s: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence_labels(_keywords(s, d, "author"), 4)


def q_betweenness(s: SparkSession, d: str) -> DataFrame:
    """Edge betweenness of authors that share five, highest first, ties by edge."""
    return G.edge_lines(G.betweenness(_edges(s, d, 5)))


def q_modularity(s: SparkSession, d: str) -> DataFrame:
    """Modularity of the components."""
    k = _keywords(s, d, "author")
    parts = connected_components(cut(G.cooccurrence_forest(k, 4)))
    return G.modularity_of_components(G.cooccurrence_degrees(k, 4), parts).select(F.round("modularity", 6).alias("modularity"))


def q_communities(s: SparkSession, d: str) -> DataFrame:
    """Communities of authors that share eight, by removing edges of highest betweenness."""
    c = G.communities_by_removal(_edges(s, d, 8))
    return G.community_lines(c).select("size", F.array_join("members", ",").alias("members"))


def q_dense_ids(s: SparkSession, d: str) -> DataFrame:
    """Dense numbers of the operators' names."""
    return G.dense_ids(t(s, d, "clean_well_data"), "operator")


def _points(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def q_cluster_stats(s: SparkSession, d: str) -> DataFrame:
    """Count, sum and sum of squares per label and dimension."""
    st = C.cluster_stats(_points(s, d).withColumnRenamed("label", "cluster"))
    z = F.transform(F.arrays_zip("sum", "sumsq"), lambda p: p)
    return st.select("cluster", "n", F.posexplode(z).alias("place", "p")).select("cluster", "n", "place", F.round("p.sum", 4).alias("sum"), F.round("p.sumsq", 4).alias("sumsq"))


def q_lloyd_step(s: SparkSession, d: str) -> DataFrame:
    """Nearest of the labels' centroids."""
    p = _points(s, d)
    st = C.cluster_stats(p.withColumnRenamed("label", "cluster")).orderBy("cluster").collect()  # a row per label
    return C.nearest(p, [[v / r["n"] for v in r["sum"]] for r in st]).select("id", F.lit(1).alias("one"), F.col("cluster"), F.round("distance", 5).alias("distance"))


def q_lloyd(s: SparkSession, d: str) -> DataFrame:
    """Lloyd iterations until no label changes, at most 100, sizes."""
    p = cut(_points(s, d))
    first = [r["x"] for r in p.orderBy("id").limit(10).collect()]
    return C.lloyd(p, first)[0].groupBy("cluster").agg(F.count("*").alias("n"))


def q_bfr(s: SparkSession, d: str) -> DataFrame:
    """Clusters of data read in rounds."""
    return C.read_in_rounds(_points(s, d).select("id", "x"), 10)[0]


def q_bfr_report(s: SparkSession, d: str) -> DataFrame:
    return C.read_in_rounds(_points(s, d).select("id", "x"), 10)[1]


def q_knn_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten most similar vectors of every vector whose id is divisible by 50 (J11), exactly.

    The query set is scored against all rows where they lie; each partition keeps ten per query.
    """
    import numpy as np
    import pandas as pd

    p = _points(s, d).select("id", "x")
    asked = p.where("id % 50 = 0")
    n = p.count()
    blocks = max(1, min(slots(s) * 4, n // 2000))
    left = asked.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    right = p.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "cosine": []})
        x, y = np.stack(a["qx"].to_numpy()), np.stack(b["x"].to_numpy())
        c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        c[a["q"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -2
        j = np.argsort(-c, axis=1, kind="stable")[:, :10]
        return pd.DataFrame({"q": np.repeat(a["q"].to_numpy(), j.shape[1]), "id": b["id"].to_numpy()[j.ravel()], "cosine": np.take_along_axis(c, j, 1).ravel()})

    c = left.groupBy("blk").cogroup(right.groupBy("blk")).applyInPandas(score, "q bigint, id bigint, cosine double").where("cosine > -2")
    place = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return c.withColumn("place", F.row_number().over(place)).where("place <= 10").select("q", "id", "place", F.round("cosine", 4).alias("cosine"))


def _batches(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select((F.floor(F.col("event_id") / 200)).alias("batch"), F.col("user_id"), "event_id")


def q_bloom_fpr(s: SparkSession, d: str) -> DataFrame:
    """False positives per batch of 200 events (ST01, X22)."""
    return K.bloom_false_positives(_batches(s, d), "batch", "user_id")


def q_fm_estimate(s: SparkSession, d: str) -> DataFrame:
    """Distinct users per batch, estimated (ST02, X23)."""
    return K.distinct_estimate(_batches(s, d), "batch", "user_id")


def q_reservoir(s: SparkSession, d: str) -> DataFrame:
    """A uniform sample of 100 events (ST03)."""
    return K.reservoir(_batches(s, d), "event_id").select("event_id", "draw")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_SUP = "sup as (select greatest(2, cast(floor(count(distinct basket) * {share}) as bigint)) as k from b)"
_PAIRS = f"with {BASKETS}, {_SUP.format(share=0.02)} select a.item || ',' || c.item as items, count(*) as support from b a join b c on a.basket = c.basket and a.item < c.item group by all having count(*) >= (select k from sup)"
_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = f"""w as (select doc_id as id, {_W} as w from documents where text is not null),
    sh as (select distinct id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g from w where len(w) > 0),
    n as (select id, count(*) as n from sh group by 1),
    j as (select a.id as a, b.id as b from sh a join sh b on a.g = b.g and a.id <> b.id group by a.id, b.id
          having count(*)::double / ((select n from n where n.id = a.id) + (select n from n where n.id = b.id) - count(*)) >= 0.8)"""
_CLASS_OF = """reach as (select id, id as seen from n union select r.id, j.b from reach r join j on j.a = r.seen),
    l as (select a, count(*) as links from j group by 1), least_of as (select id, min(seen) as class_id from reach group by 1)
    select n.id, class_id, coalesce(links, 0) as links from n join least_of using (id) left join l on l.a = n.id"""
_CLASSES = f"with recursive {_SHINGLES}, {_CLASS_OF}"


def _sets_sql(share: float, sizes: int = 7, slices: int = 0) -> str:
    """Frequent sets of up to ``sizes`` items, more than an order has; with ``slices`` those of any slice of the orders, without support."""
    by = "basket % 4" if slices else "0"
    levels = [f"s1 as (select {by} as slice, basket, item as items, item as last from b)"]
    for k in range(2, sizes + 1):
        levels.append(f"s{k} as (select s.slice, s.basket, s.items || ',' || b.item as items, b.item as last from s{k - 1} s join b on b.basket = s.basket and b.item > s.last)")
    least = f"(select k from sup)::double / {slices}" if slices else "(select k from sup)"
    counted = " union all ".join(f"select {k}::int as size, slice, items, count(*) as support from s{k} group by slice, items having count(*) >= {least}" for k in range(1, sizes + 1))
    out = "select distinct size, items from f" if slices else "select size, items, support from f"
    return f"with {BASKETS}, {_SUP.format(share=share)}, {', '.join(levels)}, f as ({counted}) {out}"


_TRAIN = f"{RATINGS}, test as (select * from ratings where {_held_out()}), train as (select * from ratings where not ({_held_out()}))"


def _sims(r: str) -> str:
    return f"""m as (select item, avg(rating) as mean from {r} group by 1),
    p as (select a.item as item_a, b.item as item_b, count(*) as n, sum(a.rating)::double as sx, sum(b.rating)::double as sy, sum(a.rating * a.rating)::double as sxx, sum(b.rating * b.rating)::double as syy,
          sum(a.rating * b.rating)::double as sxy, avg(abs(a.rating - b.rating)) as gap from {r} a join {r} b on a.user_id = b.user_id and a.item < b.item group by all),
    sims as (select item_a, item_b, n, case when n <= 1 then (5 - abs(ma.mean - mb.mean)) / 5 when n = 2 then (5 - gap) / 5
          when n * sxx - sx * sx = 0 or n * syy - sy * sy = 0 then 0 else (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) end as sim
          from p join m ma on ma.item = item_a join m mb on mb.item = item_b)"""


_KEYWORDS = "pr as (select distinct u, trim(i) as i from (select {by} as u, unnest(string_split(lower(keywords), ',')) as i from reddit_post_new where {by} is not null and keywords is not null) where trim(i) <> '')"
_EDGES = _KEYWORDS.format(by="author") + ", e as (select a.u as src, b.u as dst, count(*) as common from pr a join pr b on a.i = b.i and a.u < b.u group by all having count(*) >= 4), sym as (select src, dst from e union select dst, src from e)"
_LPA = ", l0 as (select distinct src as id, src as label from sym)" + "".join(
    f", l{i} as (select src as id, label from (select src, label, count(*) as n from sym join l{i - 1} on dst = id group by all) qualify row_number() over (partition by src order by n desc, label) = 1)" for i in range(1, 6)
)
_BLOOM_ROWS = ", ".join(f"({a}, {b})" for a, b in K.BLOOM_HASHES)
_FM_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(K.FM_HASHES))
_REACH = "reach as (select src as id, src as seen from sym union select r.id, sym.dst from reach r join sym on sym.src = r.seen), comp as (select id, min(seen) as component from reach group by 1)"

ORACLES = {
    "q_frequent_itemsets": _sets_sql(0.0005),
    "q_pcy_itemsets": _sets_sql(0.0005),
    "q_local_candidates": _sets_sql(0.008, slices=4),
    "q_lsh_keywords": f"""with recursive {_KEYWORDS.format(by="id")}, n as (select u as id, count(*) as n from pr group by 1), c as (select a.u as a, b.u as b, count(*) as common from pr a join pr b on a.i = b.i and a.u <> b.u group by all),
        j as (select a, b from c join n x on x.id = a join n y on y.id = b where common::double / (x.n + y.n - common) >= 0.5), {_CLASS_OF}""",
    "q_wide_features": f"""with {_TRAIN}, o as (select o_custkey as k, count(*) as rc, count_if(o_orderstatus = 'F') as us, count_if(o_orderstatus = 'O') as fu, count_if(o_orderstatus = 'P') as co from orders group by 1),
        u as (select c_custkey as user_id, rc, (c_custkey % 5 + 1) as st, c_nationkey as fans, us, fu, co, case when c_custkey % 4 = 0 then 0 else c_custkey % 6 + 1 end as fr, c_custkey % 3 as el, c_custkey % 7 as comp, least((2025 - (2005 + c_custkey % 20)) * 365, 6000) as days from customer join o on k = c_custkey where c_custkey % 10 <> 3),
        i as (select p_brand as item, count(*) as n, min(p_size)::int as low from part group by 1), li as (select p_brand as item, lineitem.* from lineitem join part on l_partkey = p_partkey),
        ck as (select item, count(distinct year(l_shipdate)) as visits from li where item <> 'Brand#7' group by 1), ph as (select item, count(*) as photos, count_if(l_returnflag = 'R')::double / count(*) as food from li where item <> 'Brand#9' group by 1),
        tp as (select item, count(*) as tips, avg(l_quantity::int::double) as likes from li where item <> 'Brand#11' group by 1), up as (select user_id, count(*) as c from train group by 1), ip as (select item, count(*) as c from train group by 1),
        f as (select t.user_id, t.item, case when i.n is null or t.item = 'Brand#5' then 3.5 else i.n % 5 + 1 end as i_stars, case when i.n is null or t.item = 'Brand#5' then 30 else i.n end as i_reviews, case when i.n is null or t.item = 'Brand#5' or i.n % 3 = 0 then 2 else low % 4 + 1 end as i_price, 1 as i_cards,
          case when t.item <> 'Brand#5' and i.n % 3 > 0 and i.n % 2 = 0 then 1 else 0 end as i_appointment, 0 as i_reservations, 1 as i_service, 1 as i_wheelchair, coalesce(visits, 0) as visits, coalesce(photos, 5) as photos, coalesce(food, 0.5) as food_share, coalesce(tips, 3) as tips, coalesce(likes, 0.5) as tip_likes,
          coalesce(rc, 15) as u_reviews, coalesce(st, 3.7) as u_stars, coalesce(fans, 1) as u_fans, coalesce(us, 5) as u_useful, coalesce(fu, 2) as u_funny, coalesce(co, 2) as u_cool, coalesce(fr, 10) as u_friends, coalesce(el, 0) as u_elite, coalesce(comp, 2) as u_compliments, coalesce(days, 1500) as u_days, coalesce(up.c, 10) as u_pairs, coalesce(ip.c, 30) as i_pairs
          from test t left join i on i.item = t.item left join ck on ck.item = t.item left join ph on ph.item = t.item left join tp on tp.item = t.item left join u on u.user_id = t.user_id left join up on up.user_id = t.user_id left join ip on ip.item = t.item)
        select user_id, item, {", ".join(f"round({c}::double, 6) as {c}" for c in M.WIDE if c not in ("star_gap", "review_ratio", "star_product"))}, round(abs(u_stars::double - i_stars::double), 6) as star_gap, round(u_reviews::double / (i_reviews + 1), 6) as review_ratio, round(u_stars::double * i_stars::double / 25, 6) as star_product from f""",
    "q_frequent_pairs": _PAIRS,
    "q_pcy_pairs": _PAIRS,
    "q_jaccard_classes": _CLASSES,
    "q_lsh_classes": _CLASSES,
    "q_minhash_signature": f"with p as (select distinct o_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey), h(h, a, b) as (values {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(S.HASHES))}) select o_custkey, h::int as h, min((l_partkey * a + b) % {S.PRIME}) as least from p cross join h group by o_custkey, h",
    "q_item_similarity": f"with {RATINGS}, {_sims('ratings')} select item_a, item_b, n, round(sim, 6) as sim from sims",
    "q_cf_predict": f"""with {_TRAIN}, {_sims('train')}, both_ways as (select item_a as item, item_b as other, sim from sims union all select item_b, item_a, sim from sims),
        near as (select t.user_id, t.item, b.sim, r.rating from test t join train r on r.user_id = t.user_id join both_ways b on b.item = t.item and b.other = r.item
                 qualify row_number() over (partition by t.user_id, t.item order by sim desc, other) <= 15),
        agg as (select user_id, item, sum(sim * rating) as up, sum(abs(sim)) as down from near group by all), us as (select user_id, avg(rating) as mean from train group by 1)
        select t.user_id, t.item, round(least(greatest(case when mean is null then 3.5 when t.item not in (select item from train) then mean else coalesce(case when down <> 0 then up / down end, 3.5) end, 1), 5), 4)::double as prediction
        from test t left join us on us.user_id = t.user_id left join agg on agg.user_id = t.user_id and agg.item = t.item""",
    "q_feature_table": f"""with {_TRAIN}, g as (select avg(rating) as g from train), u as (select user_id, avg(rating) as m, count(*)::double as n, var_pop(rating) as v from train group by 1), i as (select item, avg(rating) as m, count(*)::double as n, var_pop(rating) as v from train group by 1),
        f as (select t.user_id, t.item, coalesce(u.m, g) as um, coalesce(u.n, 0) as un, coalesce(u.v, 0) as uv, coalesce(i.m, g) as im, coalesce(i.n, 0) as ins, coalesce(i.v, 0) as iv, g from test t left join u on u.user_id = t.user_id left join i on i.item = t.item cross join g)
        select user_id, item, round(um, 8) as u_mean, round(un, 8) as u_n, round(uv, 8) as u_var, round(im, 8) as i_mean, round(ins, 8) as i_n, round(iv, 8) as i_var, round(ln(1 + un), 8) as u_log, round(ln(1 + ins), 8) as i_log,
        round((un * um + 10 * g) / (un + 10), 8) as u_shrunk, round((ins * im + 10 * g) / (ins + 10), 8) as i_shrunk, round(abs(um - im), 8) as gap, round(un / (ins + 1), 8) as busy, round(um * im / 25, 8) as product from f""",
    "q_graph_edges": f"with {_EDGES} select * from e",
    "q_components": f"with recursive {_EDGES}, {_REACH} select id, component from comp",
    "q_label_propagation": f"with {_EDGES}{_LPA} select id, label from l5",
    "q_modularity": f"""with recursive {_EDGES}, {_REACH}, m as (select count(*)::double as m from e), k as (select c.component, count(*)::double as k from sym join comp c on c.id = src group by 1),
        i as (select c.component, count(*)::double as n from e join comp c on c.id = src group by 1) select round(sum((2 * n - k * k / (2 * m)) / (2 * m)), 6) as modularity from k join i using (component) cross join m""",
    "q_dense_ids": "select operator, row_number() over (order by operator) - 1 as idx from (select distinct operator from clean_well_data where operator is not null)",
    "q_cluster_stats": "with x as (select label as cluster, unnest(range(64))::int as p, unnest(embedding)::double as v from embeddings) select cluster, count(*) as n, p as place, round(sum(v), 4) as sum, round(sum(v * v), 4) as sumsq from x group by cluster, p",
    "q_lloyd_step": """with x as (select vec_id, label, unnest(range(64)) as p, unnest(embedding)::double as v from embeddings), c as (select label as c, p, avg(v) as m from x group by all),
        dd as (select vec_id, c, sum((v - m) * (v - m)) as dist from x join c using (p) group by all), lab as (select label as c, row_number() over (order by label) - 1 as k from (select distinct label from embeddings))
        select vec_id as id, 1 as one, k::int as cluster, round(dist, 5) as distance from dd join lab using (c) qualify row_number() over (partition by vec_id order by dist, c) = 1""",
    "q_knn_topk": """with s as (select a.vec_id as q, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
        select q, id, (row_number() over (partition by q order by c desc, id))::int as place, round(c, 4) as cosine from s qualify place <= 10""",
    "q_bloom_fpr": f"""with v as (select event_id // 200 as b, user_id as v from events), h(ha, hb) as (values {_BLOOM_ROWS}), f as (select v, min(b) as first from v group by 1),
        bits as (select v, first, (v % {K.BLOOM_BITS} * ha + hb) % {K.BLOOM_BITS} as bit from f cross join h), st as (select bit, min(first) as set_at from bits group by 1),
        k as (select v, max(set_at) as all_set from bits join st using (bit) group by 1), n as (select b, count(*) as new, count_if(all_set < b) as fp from v join f using (v) join k using (v) where b = first group by b)
        select v.b as batch, coalesce(max(new), 0)::bigint as new, coalesce(max(fp), 0)::bigint as false_positives, round(coalesce(max(fp)::double / max(new), 0), 6) as rate from v left join n on n.b = v.b group by v.b""",
    "q_fm_estimate": f"""with v as (select event_id // 200 as b, user_id as v from events), h(i, ha, hb) as (values {_FM_ROWS}), x as (select b, i, (v % {K.FM_RANGE} * ha + hb) % {K.FM_RANGE} as h from v cross join h),
        r as (select b, i, max(case when h = 0 then 0 else round(log2((h & -h)::double)) end) as r from x group by all), g as (select b, i // 10 as g, avg(pow(2.0, r)) as m from r group by all),
        md as (select b, list_sort(list(m))[3] as m from g group by 1) select v.b as batch, count(distinct v.v) as truth, floor(max(md.m))::bigint as estimate from v join md on md.b = v.b group by v.b""",
    "q_reservoir": "select event_id, md5('7/' || event_id) as draw from events order by draw, event_id limit 100",
}
