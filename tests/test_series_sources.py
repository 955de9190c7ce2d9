"""Series against pandas; sources, sinks and streams on small files; the queries on the smallest data."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodespark.functions import text as X
from lodespark.operators import timeseries as T
from lodespark.plans import catalog
from lodespark.sources import readers, writers
from lodespark.streaming import streams


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=90)
    frame = pd.DataFrame({"source": "s", "day": days.date, "value": 100 + rng.normal(0, 1, 90).cumsum()})
    return frame, spark.createDataFrame(frame, "source string, day date, value double")


def values(df, column):
    return [r[column] for r in df.orderBy("day").collect()]


def test_resample_and_fill(spark):
    rows = [("s", dt.date(2020, 1, 1), None), ("s", dt.date(2020, 1, 2), 1.0), ("s", dt.date(2020, 1, 6), 5.0), ("s", dt.date(2020, 1, 8), None)]
    d = T.resample_daily(spark.createDataFrame(rows, "source string, day date, value double"), "source", "day", "value")
    want = pd.Series([None, 1, None, None, None, 5, None, None], index=pd.date_range("2020-01-01", periods=8), dtype=float)
    assert values(T.interpolate(d), "value") == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0]
    assert [x if x == x else None for x in want.interpolate("time")] == values(T.interpolate(d), "value")
    assert values(T.backfill(d), "value") == [1.0, 1.0, 5.0, 5.0, 5.0, 5.0, None, None]


def test_indicators(series):
    frame, df = series
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    line = ema(frame["value"], 12) - ema(frame["value"], 26)
    assert values(T.macd(df), "macd") == pytest.approx(line.tolist())
    assert values(T.macd(df), "signal") == pytest.approx(ema(line, 9).tolist())
    diff = frame["value"].diff().fillna(0)
    gain, loss = diff.clip(lower=0).rolling(14).mean(), (-diff.clip(upper=0)).rolling(14).mean()
    got = values(T.rsi(df), "rsi")
    assert got[:13] == [None] * 13 and got[13:] == pytest.approx((100 - 100 / (1 + gain / loss)).tolist()[13:])
    x = frame["value"] - frame["value"].mean()
    acf = {r["lag"]: r for r in T.autocorrelation(df, 5).collect()}
    assert acf[3]["acf"] == pytest.approx((x[3:].to_numpy() * x[:-3].to_numpy()).sum() / (x**2).sum()) and acf[1]["pacf"] == pytest.approx(acf[1]["acf"])
    assert T.chronological_split(df).where("train").count() == 81 and T.tail(df, 7).count() == 7
    assert set(values(T.crossover(T.macd(df)), "action")) <= {"Buy", "Sell", "No Action"}


def test_rsi_edges(spark):
    day = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(20)]
    up = spark.createDataFrame([("u", d, float(i)) for i, d in enumerate(day)] + [("c", d, 5.0) for d in day], "source string, day date, value double")
    last = {r["source"]: r["rsi"] for r in T.rsi(up).where(F.col("day") == day[-1]).collect()}
    assert last == {"u": 100.0, "c": None}


def test_text_cleaning(spark):
    t = "Écrivez à bob.o@x-y.org: <b>DON'T</b> visit https://a.b/c?d  or www.e.fr!! It's 42%..."
    got = spark.range(1).select(X.clean_text(F.lit(t)).alias("c"), X.clean_text(F.lit(None).cast("string")).alias("n"), X.clean_text(F.lit("12 ...")).alias("d")).first()
    assert got["c"] == "ecrivez a do not visit or it is" and got["n"] is None and got["d"] == ""
    assert spark.range(1).select(X.remove_stop_words(F.lit("this is not a test"))).first()[0] == "not test"


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"11/1/2000","123","a","b","c","00045"\n"11/1/2000","123","a","b","c","x"\n"short",1\n')
    assert [tuple(r) for r in readers.transactions(spark, str(tmp_path / "t.csv")).collect()] == [("11/1/2000-123", "45")]
    (tmp_path / "p.csv").write_text("1,0,1.5,2.5\n2,1,3,bad\n")
    assert [r["x"] for r in readers.points(spark, str(tmp_path / "p.csv"), 2).orderBy("id").collect()] == [[1.5, 2.5], [3.0, None]]
    (tmp_path / "W123.txt").write_text("WELL FILE\nCounty : X")
    w = readers.whole_texts(spark, str(tmp_path / "W123.txt")).first()
    assert (w["file_no"], w["text"]) == (123, "WELL FILE\nCounty : X")
    assert readers.optional(spark, str(tmp_path / "none.json"), "a string").count() == 0
    (tmp_path / "j.json").write_text('{"a": "x"}\n{"b": 1}\n')
    assert readers.optional(spark, str(tmp_path / "j.json"), "a string").count() == 2
    (tmp_path / "w.yaml").write_text("tickers:\n  - ticker_code: AA\n    name: A One\n  - ticker_code: BB\n    name: B\n  - ticker_code: AA\n    name: A One\n")
    assert sorted(r["ticker_code"] for r in readers.watch_list(spark, str(tmp_path / "w.yaml")).collect()) == ["AA", "BB"]
    html = "<p>Hi <b>there</b></p><table><tr><th>Well</th><td>W 1</td></tr><tr><td>1</td><td>a</td><td><a href='/x'>Slides</a></td></tr><tr><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<td")], "id int, html string")
    rows = readers.html_rows(pages, "id", "html", 3).collect()
    assert [(r["cells"], r["links"][0]["link"]) for r in rows] == [(["1", "a", "Slides"], "/x")]
    assert [tuple(r) for r in readers.html_labels(pages, "id", "html").collect()] == [(1, "Well", "W 1")]
    assert [r["text"] for r in readers.html_paragraphs(pages, "id", "html").orderBy("id").collect()] == ["Hi there", "", ""]


def test_sinks(spark, tmp_path):
    table, staging = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(table)
    writers.upsert_parquet(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), table, ["k"], staging)
    writers.append_new(spark.createDataFrame([(3, "no"), (4, "d"), (4, "d")], "k int, v string"), table, "k")
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "z"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        writers.upsert_parquet(df.union(df), table, ["k"], staging)
    writers.predictions_csv(spark.createDataFrame([("u2", "b", 1.5), ("u1", "b", 2.0)], "user_id string, business_id string, prediction double").coalesce(1), str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*")).read_text().splitlines()
    assert part == ["user_id,business_id,prediction", "u1,b,2.000000", "u2,b,1.500000"]
    f = writers.feature_collection(spark.createDataFrame([(1, 2.0, 3.0, None), (2, None, 1.0, "x")], "k int, lat double, lon double, p string"), "k", "lat", "lon", ["p"]).collect()
    assert len(f) == 1 and json.loads(f[0]["feature"]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3.0, 2.0]}, "properties": {"k": 1, "p": "N/A"}}


def test_streams(spark, tmp_path):
    data = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(i * 50 + j, str(i * 50 + j)) for j in range(50)] + [(7, "7")], "v bigint, s string").coalesce(1).write.mode("append").parquet(str(data))
    stream = lambda: streams.file_stream(spark, str(data), "*.parquet", "v bigint, s string")
    bloom = [(r["seq"], r["seen"], r["maybe_known"]) for r in streams.drain(streams.bloom_stream(stream(), "v")).orderBy("seq").collect()]
    assert [b[:2] for b in bloom] == [(0, 51), (1, 51), (2, 51)] and sum(b[2] for b in bloom) >= 2
    drained = streams.drain(streams.reservoir_stream(stream(), "s", 20, shards=3)).cache()
    assert drained.groupBy("shard").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 153
    sample = [r["value"] for r in streams.merged_reservoir(drained, 20).collect()]
    draws = sorted((hashlib.md5(f"7/{v}".encode()).hexdigest(), str(v)) for v in range(150))
    assert sample == [v for _, v in draws[:20]]
    target = str(tmp_path / "out")
    streams.refresh_once(stream(), target, "v")
    assert spark.read.parquet(target).count() == 150


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def rows_as_text(columns, rows):
    """Rows in one order, columns by name, numbers of equal value alike."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


FEW = [
    "q_frequent_pairs", "q_left_outer", "q_text_clean", "q_rake", "p3_found", "p5_found", "p5_grid", "q_local_candidates", "q_wide_features", "q_regex_fields", "q_scalars",
    "q_mixed_dates", "q_trading", "io_csv_lines", "io_transactions", "io_html_rows", "io_html_labels", "io_pages", "io_itemset_report", "io_upsert", "stream_window_counts", "stream_bloom",
]


@pytest.mark.parametrize("name", FEW)
def test_queries_equal_their_sql_on_the_smallest_data(spark, small, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, small)
    want = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_as_text(df.columns, [tuple(r) for r in df.collect()]) == rows_as_text(columns, want.fetchall())
