"""Queries that write tables in a source's form to the shared folder and read them back; scalar steps on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.functions import numbers as N
from lodespark.functions import text as X
from lodespark.operators import itemsets as I
from lodespark.operators import relational as R
from lodespark.plans.relational_queries import BASKETS, baskets
from lodespark.sources import readers, writers
from lodespark.session import scratch
from lodespark.session import table as t


def io_csv_lines(s: SparkSession, d: str) -> DataFrame:
    """Orders as CSV parts, each with its header, and the header once more among the lines."""
    path = scratch(s, "csv")
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    o.write.option("header", True).csv(path)
    s.createDataFrame([(",".join(o.columns),)], "value string").write.mode("append").text(path)
    got = readers.csv_lines(s, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    return got.withColumn("o_totalprice", F.round("o_totalprice", 2))


def io_csv_table(s: SparkSession, d: str) -> DataFrame:
    """Customers as CSV with a header, read with a schema."""
    path = scratch(s, "csv")
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    c.write.option("header", True).csv(path)
    return readers.csv_table(s, path, "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey int")


def io_transactions(s: SparkSession, d: str) -> DataFrame:
    """Quoted transactions of six fields, some short or without a number, read as baskets."""
    path = scratch(s, "transactions")
    j = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey"), "l_orderkey")
    f = [F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey"), F.lit("a"), F.lit("b"), F.lit("c"), F.when(F.col("l_partkey") % 7 == 0, "none").otherwise(F.format_string("%06d", "l_partkey"))]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), x.cast("string"), F.lit('"')) for x in f])
    short = F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('","1"'))
    j.select(F.when(F.col("l_partkey") % 11 == 0, short).otherwise(line).alias("value")).write.text(path)
    return readers.transactions(s, path).distinct()


def io_json_lines(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as JSON lines, read with a schema, a key that no line has among them."""
    path = scratch(s, "json")
    t(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey")).write.json(path)
    return readers.json_lines(s, path, "s_suppkey bigint, s_name string, s_nationkey int, absent string")


def io_optional(s: SparkSession, d: str) -> DataFrame:
    """A source that is not there counts as an empty one."""
    gone = readers.optional(s, scratch(s, "gone"), "business_id string, likes int")
    return gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"))


def io_points(s: SparkSession, d: str) -> DataFrame:
    """Vectors as headerless CSV with an ignored column."""
    path = scratch(s, "points")
    e = t(s, d, "embeddings").select("vec_id", F.lit(-1).alias("ignored"), F.col("embedding").cast("array<double>").alias("x"))
    e.select("vec_id", "ignored", *[F.col("x")[i].alias(f"x{i}") for i in range(64)]).write.csv(path)
    return readers.points(s, path, 64).select("id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def _nation_files(s: SparkSession, d: str, name, text) -> str:
    """A file per nation: 25 rows at any scale."""
    path = scratch(s, "files")
    for r in t(s, d, "nation").select("n_nationkey", "n_name").collect():
        writers.put_text(s, f"{path}/{name(r)}", text(r))
    return path


def io_whole_texts(s: SparkSession, d: str) -> DataFrame:
    """Files read as one text each, the number taken from the name."""
    path = _nation_files(s, d, lambda r: f"W{1000 + r[0]}.txt", lambda r: f"WELL FILE\nCounty : {r[1]}\n")
    return readers.whole_texts(s, path).select("file", "file_no", F.trim(F.regexp_extract("text", r"County : ([^\n]+)", 1)).alias("county"))


def io_binary_files(s: SparkSession, d: str) -> DataFrame:
    """Files of all folders below one, by a pattern of the name."""
    path = _nation_files(s, d, lambda r: f"f{r[0] % 3}/in/W{r[0]}.{'pdf' if r[0] % 2 else 'txt'}", lambda r: "%PDF" + r[1])
    return readers.binary_files(s, path, "*.pdf").select("file", "bytes", F.substring(F.decode("content", "utf-8"), 5, 100).alias("held"))


def io_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of extracted text, blank ones counted only (S18), written as text by file and read again."""
    texts = t(s, d, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit("\f \f"), F.lower("n_name"), F.lit(" page 3")).alias("text"))
    path = scratch(s, "pages")
    p = readers.pages(texts, "n_nationkey", "text")
    writers.text_lines(p.where("page_no = 1").select("n_nationkey", "page"), "page", path, "n_nationkey")
    p.where("page_no > 1").select("n_nationkey", "page").write.mode("append").partitionBy("n_nationkey").text(path)
    return s.read.text(path).select("n_nationkey", F.col("value").alias("page"))


def io_partitioned_names(s: SparkSession, d: str) -> DataFrame:
    """Files of names whose path tells template, gender and year."""
    path = _nation_files(s, d, lambda r: f"T{r[0] % 9 + 1}/{'female' if r[0] % 2 else 'male'}/{1990 + r[0]}.csv", lambda r: f"{r[1]},x,{r[0] * 10}\nBoth {r[1]},x,7\n")
    return readers.partitioned_names(s, path)


def io_watch_list(s: SparkSession, d: str) -> DataFrame:
    """A YAML list of tickers, repeats dropped."""
    path = scratch(s, "watch") + ".yaml"
    rows = [r[0] for r in t(s, d, "nation").select("n_name").collect()]
    writers.put_text(s, path, "tickers:\n" + "".join(f"  - ticker_code: {n}\n    name: {n} Corp\n" for n in rows + rows[:4]))
    return readers.watch_list(s, path)


def io_literal_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows given in the program beside those of a table."""
    more = s.createDataFrame([(100, "ATLANTIS"), (101, "MU")], "r_regionkey bigint, r_name string")
    return t(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name").unionByName(more)


def io_sql(s: SparkSession, d: str) -> DataFrame:
    """A SQL statement over a registered table."""
    t(s, d, "clean_well_data").createOrReplaceTempView("lodespark_wells")
    return s.sql("select county, count(distinct api_no) as wells from lodespark_wells where county is not null group by county")


def io_by_keys(s: SparkSession, d: str) -> DataFrame:
    """Rows of given keys, by a filter that reaches the scan."""
    return readers.by_keys(t(s, d, "ticker_daily"), "ticker_code", ["APQ1", "F9YTM"]).groupBy("ticker_code").agg(F.count("*").alias("n"))


def io_stacked(s: SparkSession, d: str) -> DataFrame:
    """Daily tables of several tickers stacked with the ticker in front, within a range of days."""
    r = t(s, d, "ticker_daily").where(F.col("datetime").between(F.lit("2013-01-01").cast("timestamp_ntz"), F.lit("2022-12-31").cast("timestamp_ntz")))
    one = lambda c: r.where(F.col("ticker_code") == c).select("datetime", "close").distinct()
    out = readers.stacked({c: one(c) for c in ("APQ1", "F9YTM", "X8FSY")})
    return out.select("ticker_code", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), "close")


def _course_pages(s: SparkSession, d: str) -> DataFrame:
    """A page per customer: a table with a header row and rows of five cells, one with links."""
    link = "<a href='/h/%d.pdf'>Slides</a> and <a href='https://x.example/%d'>Notes</a> %s extra"
    html = "<table><tr><th>No</th><th>Name</th></tr><tr><td>%d</td><td> %s </td><td>b</td><td>c</td><td>" + link + "</td></tr><tr><td>short</td></tr></table>"
    c = t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.select("c_custkey", F.format_string(html, "c_custkey", "c_name", "c_custkey", "c_custkey", "c_mktsegment").alias("html"))


def io_html_rows(s: SparkSession, d: str) -> DataFrame:
    """Course tables of pages: links of one name, made absolute, and what is left beside them."""
    rows = readers.html_rows(_course_pages(s, d), "c_custkey", "html", 5)
    slides = F.filter("links", lambda x: x["name"] == "Slides")
    left = X.without_names(F.col("cells")[4], F.transform("links", lambda x: x["name"]))
    return rows.select("c_custkey", "row_no", F.col("cells")[1].alias("name"), X.absolute_url(slides[0]["link"], "https://uni.example/course/list").alias("slides"),
                       X.absolute_url(F.col("links")[1]["link"], "https://uni.example/course/list").alias("notes"), left.alias("rest"))


def io_html_labels(s: SparkSession, d: str) -> DataFrame:
    """Label and value cells of pages, statistics named by their text, and the place of their JSON form."""
    w = t(s, d, "clean_well_data").where("api_no is not null").groupBy("api_no").agg(F.max("county").alias("county"), F.max("latitude").alias("lat"), F.max("longitude").alias("lon"))
    html = "<section class='meta_info'><p class='block_stat'><span>%s</span> Barrels of Oil Produced in May 2020</p></section><table><tr><th>County</th><td>%s</td></tr></table>"
    pages = w.select("api_no", F.format_string(html, F.substring("api_no", 8, 5), F.coalesce("county", F.lit("?"))).alias("html"))
    stats = readers.html_stats(pages, "api_no", "html").select("api_no", X.stated_field(F.col("text"), F.col("value")).alias("field"), "value")
    labels = readers.html_labels(pages, "api_no", "html").select("api_no", F.col("value").alias("county"))
    place = readers.page_place(w.select("api_no", F.to_json(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))).alias("j")), "api_no", "j")
    return stats.join(labels, "api_no").join(place, "api_no")


def io_html_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages joined by a blank."""
    p = t(s, d, "supplier").select("s_suppkey", F.format_string("<div>x<p>Of %s</p><p>and <b>no %d</b></p></div>", "s_name", "s_suppkey").alias("html"))
    return readers.html_paragraphs(p, "s_suppkey", "html")


def io_itemset_report(s: SparkSession, d: str) -> DataFrame:
    """The text report of candidates and frequent sets, line by line."""
    b = baskets(s, d)
    least = max(2, int(b.select("basket").distinct().count() * 0.02))
    found = I.frequent_itemsets(b, least, 2)
    text = I.itemset_report(found.where("size = 1"), found)
    path = scratch(s, "report") + ".txt"
    writers.put_text(s, path, text)
    lines = s.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.where("line <> ''")


def io_predictions_csv(s: SparkSession, d: str) -> DataFrame:
    """Predictions as CSV with six decimals, sorted, read back as text."""
    path = scratch(s, "predictions")
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    writers.predictions_csv(o.select(F.col("o_custkey").alias("user_id"), F.lit("all").alias("business_id"), (F.col("n") / 8).alias("prediction")), path, 3)
    return s.read.option("header", True).csv(path)


def io_pairs_csv(s: SparkSession, d: str) -> DataFrame:
    """Pairs with their similarity as CSV with six decimals."""
    path = scratch(s, "pairs")
    n = t(s, d, "nation").select("n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    j = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(m, "n_regionkey").where("a < b")
    writers.pairs_csv(j.select("a", "b", (F.lit(1.0) / (F.col("b") - F.col("a"))).alias("similarity")), path, 6)
    return s.read.option("header", True).schema("a bigint, b bigint, similarity string").csv(path)


def io_upsert(s: SparkSession, d: str) -> DataFrame:
    """A keyed table: rows replaced, added, and appended once per new key."""
    path, staging = scratch(s, "keyed"), scratch(s, "staging")
    c = t(s, d, "customer").select("c_custkey", "c_mktsegment")
    c.where("c_custkey % 3 <> 0").write.parquet(path)
    writers.upsert_parquet(c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("NEW")), path, ["c_custkey"], staging)
    writers.append_new(c.unionByName(c), path, "c_custkey")
    return s.read.schema(c.schema).parquet(path)


def io_model(s: SparkSession, d: str) -> DataFrame:
    """A fitted model saved, loaded and applied (K11): standardised prices."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    path = scratch(s, "model")
    o = t(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    Pipeline(stages=[VectorAssembler(inputCols=["price"], outputCol="f"), StandardScaler(inputCol="f", outputCol="z", withMean=True)]).fit(o).save(path)
    return PipelineModel.load(path).transform(o).select("o_orderkey", F.round(vector_to_array("z")[0], 5).alias("z"))


def io_geojson(s: SparkSession, d: str) -> DataFrame:
    """A feature per placed well, written as text and read back."""
    path = scratch(s, "geo")
    w = t(s, d, "clean_well_data").where("api_no is not null").groupBy("api_no").agg(F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"), F.max("well_status").alias("well_status"))
    writers.text_lines(writers.feature_collection(w, "api_no", "latitude", "longitude", ["well_status"]), "feature", path)
    at = lambda p: F.get_json_object("value", p)
    return s.read.text(path).select(at("$.properties.api_no").alias("api_no"), at("$.properties.well_status").alias("well_status"), at("$.geometry.type").alias("kind"),
                                    F.round(at("$.geometry.coordinates[0]").cast("double"), 5).alias("lon"), F.round(at("$.geometry.coordinates[1]").cast("double"), 5).alias("lat"))


def q_chart_series(s: SparkSession, d: str) -> DataFrame:
    """What a chart of prices shows: monthly mean, lowest, highest and share of rising days per ticker."""
    r = t(s, d, "ticker_daily").where("ticker_code = 'APQ1' and close > 0 and not isnan(close)").select("datetime", "open", "close").distinct()
    m = r.groupBy(F.date_format("datetime", "yyyy-MM").alias("month"))
    return m.agg(F.round(F.avg("close"), 4).alias("mean"), F.min("close").alias("low"), F.max("close").alias("high"), F.round(F.avg((F.col("close") > F.col("open")).cast("double")), 6).alias("rising"))


def q_scalars(s: SparkSession, d: str) -> DataFrame:
    """Lenient scalars of customers: nested attributes, flags, years, sums, dictionaries, times, entities."""
    k = F.col("c_custkey")
    attributes = F.create_map(F.lit("price"), F.when(k % 3 == 0, "x").otherwise((k % 4).cast("string")), F.lit("open"), F.when(k % 2 == 0, "True").otherwise("False"))
    attributes = F.when(k % 5 == 0, F.lit(None)).otherwise(attributes)
    since = F.when(k % 7 == 0, "n/a").otherwise(F.format_string("%d-01-02", F.lit(2000) + k % 24))
    stats = X.stated_dict(F.format_string("{'hp': %d, 'name': 'x%d'}", k % 50, k), "hp int, name string")
    entities = F.when(k % 2 == 0, F.array(F.struct(F.format_string("B-%d", k % 3).alias("entity"), F.lit(0.5).alias("score"))))
    return t(s, d, "customer").select(
        "c_custkey", N.nested_int(attributes, "price", 2).alias("price"), N.flag(attributes, "open", 1).alias("open"), N.days_since_year(since, 2025).alias("days"),
        N.total_of(k.cast("string"), F.lit("bad"), F.lit(None), F.col("c_nationkey")).alias("total"), stats["hp"].alias("hp"), stats["name"].alias("name"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k * 3600), "yyyy-MM-dd HH:mm:ss").alias("at"), X.first_entity(entities).alias("tag"),
        N.text_mod(F.col("c_name"), 69_997).alias("folded"),
    )


def q_mixed_dates(s: SparkSession, d: str) -> DataFrame:
    """Dates of scanned files in any of their forms."""
    return t(s, d, "raw_well_data").select("id", X.mixed_date(F.col("date_simulated")).cast("string").alias("day"))


def q_stripped(s: SparkSession, d: str) -> DataFrame:
    """Units without blanks of any kind around them, column names in one form, rows with their key only."""
    w = t(s, d, "well_treatments").select(F.col("treatment_id").alias("Treatment Id"), F.col("api_no").alias(" API No "), F.col("volume_units").alias("Volume Units"))
    w = X.named_columns(w).where("api_no is not null")
    return w.select("treatment_id", "api_no", X.stripped(F.col("volume_units")).alias("volume_units"))


def q_case_baskets(s: SparkSession, d: str) -> DataFrame:
    """Baskets by user or by item, as the case asks (P02): both, sizes of each."""
    j = t(s, d, "orders").select("o_custkey", "o_orderpriority")

    def case(n: int) -> DataFrame:
        by, item = ("o_custkey", "o_orderpriority") if n == 1 else ("o_orderpriority", "o_custkey")
        return j.groupBy(F.col(by).cast("string").alias("basket")).agg(F.count_distinct(item).alias("n")).select(F.lit(n).alias("case"), "basket", "n")

    return case(1).unionByName(case(2))


def q_lookup_chain(s: SparkSession, d: str) -> DataFrame:
    """Order lines with features of four tables one after another, defaults where missing."""
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = t(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("int").alias("size"))
    supp = t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("nation"))
    orders = t(s, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("bigint").alias("cust"))
    seg = t(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("cust"), F.col("c_mktsegment").alias("segment"))
    x = R.lookup(li, R.small(part), "l_partkey", {"size": -1})
    x = R.lookup(x, R.small(supp), "l_suppkey", {"nation": -1})
    x = R.lookup(x, orders, "l_orderkey", {"cust": -1})
    return R.lookup(x, seg, "cust", {"segment": "NONE"}).select("l_orderkey", "l_linenumber", "size", "nation", "segment")


def q_semi_top(s: SparkSession, d: str) -> DataFrame:
    """Wells of the ten operators with the most rows (P09): top-k, then a semi join on it."""
    w = t(s, d, "clean_well_data").where("operator is not null")
    top = R.top_values(w, "operator", 10)  # ten rows
    return w.join(F.broadcast(top), "operator", "left_semi").groupBy("operator").agg(F.count_distinct("api_no").alias("wells"))


def q_flattened(s: SparkSession, d: str) -> DataFrame:
    """Fields of a nested column set beside the others."""
    e = t(s, d, "events").select("event_id", "user_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", "user_id", "p.*")


def q_trading(s: SparkSession, d: str) -> DataFrame:
    """Moving averages of 5 and 20 days, held while the short one is above, yearly return and Sharpe ratio per ticker."""
    r = t(s, d, "ticker_daily").where("ticker_code is not null and datetime is not null and close > 0 and not isnan(close) and close < double('infinity')")
    x = r.groupBy("ticker_code", F.to_date("datetime").alias("day")).agg(F.max(F.struct("datetime", "close"))["close"].alias("close"))
    w = Window.partitionBy("ticker_code").orderBy("day")
    x = x.withColumns({"short": F.avg("close").over(w.rowsBetween(-4, 0)), "long": F.avg("close").over(w.rowsBetween(-19, 0)), "i": F.row_number().over(w)})
    held = F.lag((F.col("i") >= 20) & (F.col("short") > F.col("long")), 1, False).over(w)
    x = x.withColumns({"held": held, "ret": F.col("close") / F.lag("close").over(w) - 1})
    gain = F.when(F.col("held"), F.col("ret")).otherwise(0.0)
    g = x.where("ret is not null").groupBy("ticker_code").agg(F.count("*").alias("days"), F.avg(gain).alias("m"), F.stddev_pop(gain).alias("s"), F.sum(F.log1p(gain)).alias("l"))
    return g.select("ticker_code", "days", F.round(F.exp(F.col("l") * 252 / F.col("days")) - 1, 4).alias("annual"), F.round(F.try_divide("m", "s") * F.sqrt(F.lit(252.0)), 4).alias("sharpe"))


def q_users(s: SparkSession, d: str) -> DataFrame:
    """Accounts: names must be unique, a taken name is refused, portfolios are listed and removed."""
    users = t(s, d, "customer").select(F.col("c_name").alias("username"), "c_custkey")
    asked = s.createDataFrame([("Customer#000000001",), ("somebody",)], "username string")
    made = asked.join(users, "username", "left_anti").select("username", F.lit(-1).alias("c_custkey"))
    portfolios = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    kept = portfolios.join(portfolios.where("o_orderkey % 5 = 0"), ["c_custkey", "o_orderkey"], "left_anti").groupBy("c_custkey").agg(F.count("*").alias("portfolios"))
    return R.lookup(users.unionByName(made), kept, "c_custkey", {"portfolios": 0})


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("io_", "q_"))}

_WELLS = "w as (select api_no, max(county) as county, max(latitude) as lat, max(longitude) as lon, max(well_status) as well_status from clean_well_data where api_no is not null group by 1)"
_USABLE = "ticker_code is not null and datetime is not null and close > 0 and isfinite(close)"
ORACLES = {
    "io_csv_lines": "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice::double, 2) as o_totalprice from orders",
    "io_csv_table": "select c_custkey, c_name, c_mktsegment, c_nationkey::int as c_nationkey from customer",
    "io_transactions": "select distinct strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey as basket, l_partkey::varchar as item from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 7 <> 0 and l_partkey % 11 <> 0",
    "io_json_lines": "select s_suppkey, s_name, s_nationkey::int as s_nationkey, null::varchar as absent from supplier",
    "io_optional": "select 0::bigint as n, 0::bigint as likes",
    "io_points": "select vec_id as id, len(embedding)::int as n, round(list_sum(embedding::double[]), 4) as total from embeddings",
    "io_whole_texts": "select 'W' || (1000 + n_nationkey) || '.txt' as file, (1000 + n_nationkey)::int as file_no, n_name as county from nation",
    "io_binary_files": "select 'W' || n_nationkey || '.pdf' as file, (4 + length(n_name))::bigint as bytes, n_name as held from nation where n_nationkey % 2 = 1",
    "io_pages": "select n_nationkey::int as n_nationkey, n_name as page from nation union all select n_nationkey::int, lower(n_name) || ' page 3' from nation",
    "io_partitioned_names": "with n as (select n_nationkey as k, n_name, unnest([true, false]) as own from nation) select 'T' || (k % 9 + 1) as template, case when k % 2 = 1 then 'female' else 'male' end as gender, (1990 + k)::int as year, case when own then n_name else 'Both ' || n_name end as name, case when own then k * 10 else 7 end::bigint as freq from n",
    "io_watch_list": "select n_name as ticker_code, n_name || ' Corp' as name from nation",
    "io_literal_rows": "select r_regionkey::bigint as r_regionkey, r_name from region union all values (100, 'ATLANTIS'), (101, 'MU')",
    "io_sql": "select county, count(distinct api_no) as wells from clean_well_data where county is not null group by 1",
    "io_by_keys": "select ticker_code, count(*) as n from ticker_daily where ticker_code in ('APQ1', 'F9YTM') group by 1",
    "io_stacked": "select distinct ticker_code, strftime(datetime, '%Y-%m-%d %H:%M:%S') as at, close from (select distinct ticker_code, datetime, close from ticker_daily where ticker_code in ('APQ1', 'F9YTM', 'X8FSY') and datetime between '2013-01-01' and '2022-12-31')",
    "io_html_rows": "select c_custkey, 1::int as row_no, c_name as name, 'https://uni.example/h/' || c_custkey || '.pdf' as slides, 'https://x.example/' || c_custkey as notes, 'and ' || c_mktsegment || ' extra' as rest from customer",
    "io_html_labels": f"with {_WELLS} select api_no, 'latest_barrels_of_oil_produced' as field, substr(api_no, 8, 5) as value, coalesce(county, '?') as county, lat as latitude, lon as longitude from w",
    "io_html_paragraphs": "select s_suppkey, 'Of ' || s_name || ' and no ' || s_suppkey as text from supplier",
    "io_itemset_report": f"""with {BASKETS}, k as (select greatest(2, cast(floor(count(distinct basket) * 0.02) as bigint)) as k from b),
        f1 as (select string_agg('(''' || item || ''')', ',' order by item) as line from (select item from b group by 1 having count(*) >= (select k from k))),
        f2 as (select string_agg('(''' || x || ''', ''' || y || ''')', ',' order by x, y) as line from (select a.item as x, c.item as y from b a join b c on a.basket = c.basket and a.item < c.item group by all having count(*) >= (select k from k)))
        select 0::int as line_no, 'Candidates:' as line union all select 1, line from f1 union all select 3, 'Frequent Itemsets:' union all select 4, line from f1 union all select 6, line from f2 where line is not null""",
    "io_predictions_csv": "select o_custkey::varchar as user_id, 'all' as business_id, printf('%.3f', count(*)::double / 8) as prediction from orders group by o_custkey",
    "io_pairs_csv": "select a.n_nationkey::bigint as a, b.n_nationkey::bigint as b, printf('%.6f', 1.0::double / (b.n_nationkey - a.n_nationkey)) as similarity from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "io_upsert": "select c_custkey, case when c_custkey % 2 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer",
    "io_model": "select o_orderkey, round((o_totalprice::double - (select avg(o_totalprice::double) from orders)) / (select stddev_samp(o_totalprice::double) from orders), 5) as z from orders",
    "io_geojson": f"with {_WELLS} select api_no, coalesce(well_status, 'N/A') as well_status, 'Point' as kind, round(lon, 5) as lon, round(lat, 5) as lat from w where lat is not null and lon is not null",
    "q_chart_series": "with r as (select distinct datetime, open, close from ticker_daily where ticker_code = 'APQ1' and close > 0 and not isnan(close)) select strftime(datetime, '%Y-%m') as month, round(avg(close), 4) as mean, min(close) as low, max(close) as high, round(avg((close > open)::int::double), 6) as rising from r group by 1",
    "q_scalars": """select c_custkey, (case when c_custkey % 5 = 0 or c_custkey % 3 = 0 then 2 else c_custkey % 4 end)::int as price, (case when c_custkey % 5 = 0 then 1 when c_custkey % 2 = 0 then 1 else 0 end)::int as open,
        (case when c_custkey % 7 = 0 then 1500 else least((2025 - (2000 + c_custkey % 24)) * 365, 6000) end)::int as days, (c_custkey + c_nationkey)::double as total, (c_custkey % 50)::int as hp, 'x' || c_custkey as name,
        strftime(to_timestamp(1700000000 + c_custkey * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as at, case when c_custkey % 2 = 0 then 'B-' || (c_custkey % 3) else 'O' end as tag,
        list_reduce(list_prepend(0::bigint, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::bigint)), lambda a, x: (a * 256 + x) % 69997) as folded from customer""",
    "q_mixed_dates": r"""with x as (select id, replace(trim(date_simulated), '/', '-') as c from raw_well_data)
        select id, strftime(case when regexp_full_match(c, '\d{4}-\d{1,2}-\d{1,2}') then try_strptime(c, '%Y-%m-%d') when regexp_full_match(c, '\d{1,2}-\d{1,2}-\d{4}') then try_strptime(c, '%m-%d-%Y') when regexp_full_match(c, '\d{1,2}-\d{1,2}-\d{2}') then try_strptime(regexp_replace(c, '-(\d{2})$', '-20\1'), '%m-%d-%Y') end, '%Y-%m-%d') as day from x""",
    "q_stripped": r"select treatment_id, api_no, regexp_replace(volume_units, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') as volume_units from well_treatments where api_no is not null",
    "q_case_baskets": "select 1::int as \"case\", o_custkey::varchar as basket, count(distinct o_orderpriority) as n from orders group by o_custkey union all select 2, o_orderpriority, count(distinct o_custkey) from orders group by o_orderpriority",
    "q_lookup_chain": "select l_orderkey, l_linenumber, coalesce(p_size, -1)::int as size, coalesce(s_nationkey, -1)::int as nation, coalesce(c_mktsegment, 'NONE') as segment from lineitem left join (select * from part where p_size > 10) on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey left join (select * from orders where o_orderstatus <> 'F') on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey",
    "q_semi_top": "with top as (select operator from clean_well_data where operator is not null group by 1 order by count(*) desc, operator limit 10) select operator, count(distinct api_no) as wells from clean_well_data where operator in (select operator from top) group by 1",
    "q_flattened": "select event_id, user_id, (props->>'k')::bigint as k from events",
    "q_trading": f"""with x as (select ticker_code, cast(datetime as date) as day, arg_max(close, (datetime, close)) as close from ticker_daily where {_USABLE} group by all),
        a as (select *, avg(close) over (w rows between 4 preceding and current row) as s, avg(close) over (w rows between 19 preceding and current row) as l, row_number() over w as i, close / lag(close) over w - 1 as ret from x window w as (partition by ticker_code order by day)),
        h as (select ticker_code, ret, case when lag(i >= 20 and s > l) over (partition by ticker_code order by day) then ret else 0 end as g from a)
        select ticker_code, count(*) as days, round(exp(sum(ln(1 + g)) * 252 / count(*)) - 1, 4) as annual, round(case when stddev_pop(g) > 0 then avg(g) / stddev_pop(g) * sqrt(252.0::double) end, 4) as sharpe from h where ret is not null group by 1""",
    "q_users": "with u as (select c_name as username, c_custkey from customer union all select 'somebody', -1), p as (select o_custkey, count(*) as n from orders where o_orderkey % 5 <> 0 group by 1) select username, c_custkey, coalesce(n, 0) as portfolios from u left join p on o_custkey = c_custkey",
}
