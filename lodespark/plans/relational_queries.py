"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.functions.numbers import clamp, list_length, safe_double, safe_int
from lodespark.operators import relational as R
from lodespark.session import table as t


def q_left_outer(s: SparkSession, d: str) -> DataFrame:
    """Clean wells with their treatments, 11 columns."""
    w = t(s, d, "clean_well_data").select("api_no", "well_name", "operator", "county", "latitude", "longitude").distinct()
    x = t(s, d, "well_treatments").select("api_no", "treatment_id", "stimulated_formation", "top_ft", "bottom_ft", "type_treatment")
    return w.join(x, "api_no", "left")


def q_anti_new_ids(s: SparkSession, d: str) -> DataFrame:
    """Posts that have no vector yet."""
    known = t(s, d, "embedding_vectors").select(F.col("reddit_post_id").alias("id"))
    return R.unseen(t(s, d, "reddit_post_new").select("id").distinct(), known, "id")


def q_semi_scores(s: SparkSession, d: str) -> DataFrame:
    """Titles of scored ids, in order of the score."""
    scored = t(s, d, "reddit_post_new").groupBy("id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "id").limit(25)
    titles = t(s, d, "reddit_post_new").groupBy("id").agg(F.max("title").alias("title"))
    return titles.join(F.broadcast(scored), "id").orderBy(F.desc("best"), "id")


def q_dup_all(s: SparkSession, d: str) -> DataFrame:
    """Every treatment row whose file and date occur more than once."""
    return R.duplicated(t(s, d, "well_treatments").select("treatment_id", "file_id", "date_stimulated"), ["file_id", "date_stimulated"]).select(
        "treatment_id", "file_id"
    )


def q_post_embedding(s: SparkSession, d: str) -> DataFrame:
    """One-to-one join of posts and vectors."""
    v = t(s, d, "embedding_vectors").select(F.col("reddit_post_id").alias("id"), F.length("embedding").alias("chars")).where("chars is not null")
    v = v.groupBy("id").agg(F.max("chars").alias("chars"))
    return t(s, d, "reddit_post_new").select("id", "domain").distinct().join(v, "id")


def q_lookup_defaults(s: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's balance and segment, defaults where missing."""
    features = t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    joined = R.lookup(t(s, d, "orders").select("o_orderkey", "o_custkey"), R.small(features), "o_custkey", {"balance": 0.0, "segment": "NONE"})
    return joined.select("o_orderkey", clamp(F.col("balance"), 10.0, 5000.0).alias("balance"), "segment")


def q_safe_numbers(s: SparkSession, d: str) -> DataFrame:
    """Lenient numbers from scanned text (X01, P15, P24): the value or the default, and whether it was bad."""
    r = t(s, d, "raw_well_data")
    return r.select("id", safe_double(F.col("lbs"), -1.0).alias("lbs"), safe_int(F.col("psi"), -1).alias("psi"), (F.col("lbs").isNotNull() & F.col("lbs").try_cast("double").isNull()).alias("bad"))


def q_transactions(s: SparkSession, d: str) -> DataFrame:
    """Basket key of date and customer, integer product, bad rows dropped."""
    o = t(s, d, "orders").select("o_orderkey", F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey").alias("basket"))
    lines = t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").try_cast("int").alias("product")).where("product is not null")
    return o.join(lines, "o_orderkey").select("basket", "product").distinct()


def q_basket_filter(s: SparkSession, d: str) -> DataFrame:
    """Orders with more than three brands."""
    items = t(s, d, "lineitem").join(R.small(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")), "l_partkey")
    sets = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("items"))
    return sets.where(F.size("items") > 3).select("l_orderkey", F.array_join("items", ",").alias("items"))


def q_user_item_means(s: SparkSession, d: str) -> DataFrame:
    """Mean, count and population variance per customer, with the overall mean."""
    r = ratings(s, d)
    overall = r.agg(F.avg("rating").alias("g"))
    users = r.groupBy("user_id").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"), F.var_pop("rating").alias("var"))
    return users.crossJoin(F.broadcast(overall)).select("user_id", F.round("mean", 6).alias("mean"), "n", F.round("var", 6).alias("var"), F.round("g", 6).alias("overall"))


def q_value_share(s: SparkSession, d: str) -> DataFrame:
    """Percentage of each order status within each priority."""
    return R.value_share(t(s, d, "orders"), "o_orderstatus", ["o_orderpriority"])


def q_top_values(s: SparkSession, d: str) -> DataFrame:
    """Ten operators with the most wells."""
    return R.top_values(t(s, d, "clean_well_data").where("operator is not null"), "operator", 10)


def q_crosstab(s: SparkSession, d: str) -> DataFrame:
    """Segment against order status."""
    j = t(s, d, "orders").select("o_custkey", "o_orderstatus").join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return R.crosstab(j, "c_mktsegment", "o_orderstatus")


def q_conditional_ratio(s: SparkSession, d: str) -> DataFrame:
    """Share of purchase events, and mean value with null as 0, per user."""
    e = t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count("*").alias("n"), F.avg(F.coalesce("value", F.lit(0.0))).alias("v"))
    return e.select("user_id", "n", F.round(F.col("hits") / F.col("n"), 6).alias("ratio"), F.round("v", 4).alias("mean_value"))


def q_quartiles(s: SparkSession, d: str) -> DataFrame:
    """Quartiles of the price per status."""
    q = F.percentile("o_totalprice", [0.25, 0.5, 0.75])
    return t(s, d, "orders").groupBy("o_orderstatus").agg(q.alias("q")).select("o_orderstatus", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


def q_multi_mean(s: SparkSession, d: str) -> DataFrame:
    """Means of several measures per flag (A08, A13), and the mean of those means."""
    m = t(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    macro = m.agg(F.avg("l_quantity").alias("macro_quantity"))
    return m.crossJoin(F.broadcast(macro)).select("l_returnflag", *[F.round(c, 5).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "macro_quantity")])


def q_list_length(s: SparkSession, d: str) -> DataFrame:
    """Keywords per post."""
    return t(s, d, "reddit_post_new").select("id", "keywords").distinct().select("id", list_length(F.col("keywords")).cast("bigint").alias("n"))


def q_flatten_ids(s: SparkSession, d: str) -> DataFrame:
    """Distinct well numbers of the JSON arrays."""
    r = t(s, d, "raw_well_data").select(F.explode(F.from_json("api_no", "array<string>")).alias("api_no"))
    return r.where("api_no is not null").distinct()


def q_containment(s: SparkSession, d: str) -> DataFrame:
    """Baskets that hold a whole candidate set (J05): orders with all three brands of each triple."""
    b = baskets(s, d)
    c = s.createDataFrame([(f"c{i}", f"Brand#{i + j}") for i in range(1, 21) for j in range(3)], "candidate string, item string")
    return R.contained(b, c).groupBy("candidate").agg(F.count("*").alias("support"))


def q_universe(s: SparkSession, d: str) -> DataFrame:
    """Stimulations per formation on all formations."""
    w = t(s, d, "well_treatments").select(F.upper(F.trim("stimulated_formation")).alias("formation")).where("formation is not null")
    r = t(s, d, "raw_well_data").select(F.upper(F.trim("formation")).alias("formation")).where("formation <> ''")
    n = w.groupBy("formation").agg(F.count("*").alias("n"))
    return R.label_universe(n, w.unionByName(r), "formation", "n")


def q_category(s: SparkSession, d: str) -> DataFrame:
    """First matching category, else Other."""
    c = R.category(F.lower("type_treatment"), [("acid", "Acid"), ("frac", "Frac"), ("gel", "Gel")])
    return t(s, d, "well_treatments").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


def q_date_range(s: SparkSession, d: str) -> DataFrame:
    """First and last reading per ticker within an inclusive range."""
    r = t(s, d, "ticker_daily").where(F.col("datetime").between(F.lit("2016-01-01").cast("timestamp_ntz"), F.lit("2017-12-31").cast("timestamp_ntz")))
    return r.groupBy("ticker_code").agg(F.date_format(F.min("datetime"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("datetime"), "yyyy-MM-dd").alias("last_day"), F.count_distinct("datetime").alias("n"))


def q_new_posts(s: SparkSession, d: str) -> DataFrame:
    """The newest 20 posts without content."""
    p = t(s, d, "reddit_post_new").where("content is null or content = ''").select("id", F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created")).distinct()
    return p.orderBy(F.desc("created"), "id").limit(20)


def q_upsert_nested(s: SparkSession, d: str) -> DataFrame:
    """Portfolios: tickers added to and removed from a nested list, then merged."""
    x = t(s, d, "tickers").where("exchange is not null")
    p = x.groupBy("exchange").agg(F.array_sort(F.collect_set("ticker_code")).alias("codes"))
    added = p.withColumn("codes", F.when(F.array_contains("codes", "NEW1"), F.col("codes")).otherwise(F.array_append("codes", F.lit("NEW1"))))
    changed = added.where(F.col("exchange") != "NYSE").withColumn("codes", F.filter("codes", lambda c: ~c.startswith("A")))
    return R.upsert(p, changed, ["exchange"]).select("exchange", F.size("codes").cast("bigint").alias("n"), F.array_join(F.slice(F.array_sort("codes"), 1, 3), ",").alias("head"))


def q_geojson(s: SparkSession, d: str) -> DataFrame:
    """A feature per placed well and the centre of its county."""
    w = t(s, d, "clean_well_data").where("latitude between 40 and 50 and longitude between -110 and -90").distinct()
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A")).alias(c)
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct("api_no", na("well_name"), na("well_status")).alias("properties")))
    centre = w.groupBy(F.col("county").alias("c")).agg(F.round(F.avg("latitude"), 5).alias("centre_lat"), F.round(F.avg("longitude"), 5).alias("centre_lon"))
    return w.withColumn("feature", f).join(centre, F.col("county").eqNullSafe(F.col("c"))).select("api_no", "centre_lat", "centre_lon", F.get_json_object("feature", "$.properties.well_status").alias("well_status"), F.get_json_object("feature", "$.geometry.type").alias("kind"))


def ratings(s: SparkSession, d: str) -> DataFrame:
    """(user_id, item, rating): customers rate brands 1 to 5, by the bought quantity."""
    j = t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")), "l_orderkey")
    j = j.join(R.small(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))), "l_partkey")
    return j.groupBy("user_id", "item").agg((F.sum(F.col("l_quantity").cast("bigint")) % 5 + 1).cast("bigint").alias("rating"))


def baskets(s: SparkSession, d: str) -> DataFrame:
    """(basket, item): the brands of each order."""
    j = t(s, d, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    return j.join(R.small(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))), "l_partkey").select("basket", "item").distinct()


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

RATINGS = "ratings as (select o_custkey as user_id, p_brand as item, cast(sum(cast(l_quantity as bigint)) % 5 + 1 as bigint) as rating from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all)"
BASKETS = "b as (select distinct l_orderkey as basket, p_brand as item from lineitem join part on l_partkey = p_partkey)"

ORACLES = {
    "q_left_outer": "with w as (select distinct api_no, well_name, operator, county, latitude, longitude from clean_well_data) select w.*, treatment_id, stimulated_formation, top_ft, bottom_ft, type_treatment from w left join well_treatments x on w.api_no = x.api_no",
    "q_anti_new_ids": "select distinct id from reddit_post_new p where not exists (select 1 from embedding_vectors e where e.reddit_post_id = p.id)",
    "q_semi_scores": "select id, max(title) as title, max(score) as best from reddit_post_new group by id order by best desc, id limit 25",
    "q_dup_all": "select treatment_id, file_id from well_treatments qualify count(*) over (partition by file_id, date_stimulated) > 1",
    "q_post_embedding": "with v as (select reddit_post_id as id, cast(max(length(embedding)) as int) as chars from embedding_vectors where embedding is not null group by 1) select distinct p.id, p.domain, v.chars from reddit_post_new p join v on p.id = v.id",
    "q_lookup_defaults": "select o_orderkey, least(greatest(coalesce(c_acctbal, 0.0), 10.0), 5000.0)::double as balance, coalesce(c_mktsegment, 'NONE') as segment from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey",
    "q_safe_numbers": "select id, coalesce(try_cast(trim(lbs) as double), -1.0)::double as lbs, coalesce(try_cast(case when regexp_full_match(trim(psi), '[+-]?[0-9]+') then trim(psi) end as bigint), -1) as psi, (lbs is not null and try_cast(lbs as double) is null) as bad from raw_well_data",
    "q_transactions": "select distinct strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey as basket, cast(trunc(l_quantity) as int) as product from orders join lineitem on o_orderkey = l_orderkey",
    "q_basket_filter": f"with {BASKETS} select basket as l_orderkey, string_agg(item, ',' order by item) as items from b group by basket having count(*) > 3",
    "q_user_item_means": f"with {RATINGS} select user_id, round(avg(rating), 6) as mean, count(*) as n, round(var_pop(rating), 6) as var, round((select avg(rating) from ratings), 6) as overall from ratings group by user_id",
    "q_value_share": "with c as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all) select *, round(n * 100.0::double / sum(n) over (partition by o_orderpriority), 6) as pct from c",
    "q_top_values": "select operator, count(*) as n from clean_well_data where operator is not null group by operator order by n desc, operator limit 10",
    "q_crosstab": "select c_mktsegment, o_orderstatus, count(*) as n from orders join customer on c_custkey = o_custkey group by all",
    "q_conditional_ratio": "select user_id, count(*) as n, round(count_if(event_type = 'purchase')::double / count(*), 6) as ratio, round(avg(coalesce(value, 0)), 4) as mean_value from events group by user_id",
    "q_quartiles": "select o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as q2, round(quantile_cont(o_totalprice, 0.75), 4) as q3 from orders group by 1",
    "q_multi_mean": "with m as (select l_returnflag, avg(l_quantity) as a, avg(l_discount) as b, avg(l_tax) as c from lineitem group by 1) select l_returnflag, round(a, 5) as l_quantity, round(b, 5) as l_discount, round(c, 5) as l_tax, round((select avg(a) from m), 5) as macro_quantity from m",
    "q_list_length": "select distinct id, case when keywords is null or trim(keywords) in ('', 'None') then 0 else len(string_split(keywords, ',')) end::bigint as n from (select distinct id, keywords from reddit_post_new)",
    "q_flatten_ids": "select distinct unnest(from_json(api_no, '[\"VARCHAR\"]')) as api_no from raw_well_data",
    "q_containment": f"with {BASKETS}, c as (select 'c' || i as candidate, 'Brand#' || (i + j) as item from range(1, 21) r(i), range(3) s(j)), h as (select basket, candidate from b join c using (item) group by all having count(*) = 3) select candidate, count(*) as support from h group by 1",
    "q_universe": "with w as (select upper(trim(stimulated_formation)) as formation from well_treatments where stimulated_formation is not null), r as (select upper(trim(formation)) as formation from raw_well_data where trim(formation) <> ''), u as (select formation from w union select formation from r) select u.formation, count(w.formation) as n from u left join w using (formation) group by 1",
    "q_category": "select case when type_treatment ilike '%acid%' then 'Acid' when type_treatment ilike '%frac%' then 'Frac' when type_treatment ilike '%gel%' then 'Gel' else 'Other' end as category, count(*) as n from well_treatments group by 1",
    "q_date_range": "select ticker_code, strftime(min(datetime), '%Y-%m-%d') as first_day, strftime(max(datetime), '%Y-%m-%d') as last_day, count(distinct datetime) as n from ticker_daily where datetime between '2016-01-01' and '2017-12-31' group by 1",
    "q_new_posts": "select distinct id, strftime(created_utc, '%Y-%m-%d %H:%M:%S') as created from reddit_post_new where content is null or content = '' order by created desc, id limit 20",
    "q_upsert_nested": """with p as (select exchange, list_sort(list_distinct(list(ticker_code))) as codes from tickers where exchange is not null group by 1),
        c as (select exchange, case when exchange = 'NYSE' then codes else list_filter(case when list_contains(codes, 'NEW1') then codes else list_append(codes, 'NEW1') end, lambda x: not starts_with(x, 'A')) end as codes from p)
        select exchange, len(codes)::bigint as n, array_to_string(list_sort(codes)[1:3], ',') as head from c""",
    "q_geojson": "with w as (select distinct * from clean_well_data where latitude between 40 and 50 and longitude between -110 and -90) select api_no, round(avg(latitude) over (partition by county), 5) as centre_lat, round(avg(longitude) over (partition by county), 5) as centre_lon, coalesce(well_status, 'N/A') as well_status, 'Point' as kind from w",
}
