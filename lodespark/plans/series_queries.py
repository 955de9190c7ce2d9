"""Queries of the series, text and fairness operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import text as X
from lodespark.operators import textmining as M
from lodespark.operators import timeseries as T
from lodespark.operators.regular_grid import usable_reading
from lodespark.session import cut, spread
from lodespark.session import table as t


def _daily(s: SparkSession, d: str) -> DataFrame:
    """(source, day, value): the last usable close of each ticker and day."""
    r = t(s, d, "ticker_daily").where(usable_reading(F.col("close")))
    return r.groupBy(F.col("ticker_code").alias("source"), F.to_date("datetime").alias("day")).agg(F.max(F.struct("datetime", "close"))["close"].alias("value"))


def _full(s: SparkSession, d: str) -> DataFrame:
    x = _daily(s, d)
    return T.interpolate(T.resample_daily(x, "source", "day", "value"))


def q_daily_resample(s: SparkSession, d: str) -> DataFrame:
    """Every calendar day of each ticker, absent ones null."""
    return T.resample_daily(_daily(s, d), "source", "day", "value")


def q_interpolate(s: SparkSession, d: str) -> DataFrame:
    """Absent days interpolated."""
    return _full(s, d).select("source", "day", F.round("value", 5).alias("value"))


def q_backfill(s: SparkSession, d: str) -> DataFrame:
    """Absent days take the next value."""
    return T.backfill(T.resample_daily(_daily(s, d), "source", "day", "value"))


def q_macd(s: SparkSession, d: str) -> DataFrame:
    """MACD and signal of the daily order totals."""
    return T.macd(_orders(s, d), 12, 26, 10).select("day", F.round("macd", 3).alias("macd"), F.round("signal", 3).alias("signal"))


def q_crossover(s: SparkSession, d: str) -> DataFrame:
    """Buy and sell labels, carried on."""
    return T.crossover(T.macd(_orders(s, d), 12, 26, 10)).select("day", "action")


def _orders(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round("o_totalprice").cast("bigint")).cast("double").alias("value"))
    return T.interpolate(T.resample_daily(o.withColumn("source", F.lit("orders")), "source", "day", "value"))


def q_rsi(s: SparkSession, d: str) -> DataFrame:
    """Relative strength over 14 days."""
    return T.rsi(_full(s, d)).select("source", "day", F.round("rsi", 3).alias("rsi"))


def q_lags(s: SparkSession, d: str) -> DataFrame:
    """Three lags."""
    return T.with_lags(_daily(s, d), 3)


def q_calendar(s: SparkSession, d: str) -> DataFrame:
    """Calendar parts of the order days."""
    return t(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", *[c.alias(n) for n, c in T.calendar(F.col("day")).items()])


def q_minmax(s: SparkSession, d: str) -> DataFrame:
    """Closes scaled within the ticker."""
    return T.minmax(_daily(s, d)).select("source", "day", F.round("scaled", 6).alias("scaled"))


def q_split(s: SparkSession, d: str) -> DataFrame:
    """The first nine tenths of the days."""
    return T.chronological_split(_daily(s, d)).groupBy("source").agg(F.count_if("train").alias("train"), F.count("*").alias("n"))


def q_tail(s: SparkSession, d: str) -> DataFrame:
    """The last five days of each ticker."""
    return T.tail(_daily(s, d), 5)


def q_acf(s: SparkSession, d: str) -> DataFrame:
    """Autocorrelations of the order totals."""
    return T.autocorrelation(_orders(s, d), 30).select("lag", F.round("acf", 5).alias("acf"))


def q_pacf(s: SparkSession, d: str) -> DataFrame:
    """Partial autocorrelations per ticker."""
    return T.autocorrelation(_full(s, d), 10)


def q_corr_matrix(s: SparkSession, d: str) -> DataFrame:
    """Correlations of the price columns."""
    r = t(s, d, "ticker_daily").where(usable_reading(F.col("close")) & usable_reading(F.col("open")) & usable_reading(F.col("high")) & usable_reading(F.col("volume")))
    return T.correlations(r, ["open", "high", "close", "volume"]).select("a", "b", F.round("corr", 5).alias("corr"))


def q_rmse_band(s: SparkSession, d: str) -> DataFrame:
    """Error of yesterday's value as forecast, and its band."""
    x = T.error_band(T.with_lags(_daily(s, d), 1), "value", "lag_1")
    return x.select(F.round("mse", 3).alias("mse"), F.round("rmse", 3).alias("rmse"), F.round("band", 3).alias("band"))


def q_forecast(s: SparkSession, d: str) -> DataFrame:
    """Forecast of the last tenth of each ticker's days from five lags."""
    return T.direct_forecast(cut(_full(s, d)))


def q_missing_days(s: SparkSession, d: str) -> DataFrame:
    """Days of 2016 a backfill must fetch per ticker (ST05, X20)."""
    return T.missing_days(_daily(s, d), "2016-01-01", "2016-12-31")


def q_text_clean(s: SparkSession, d: str) -> DataFrame:
    """The whole cleaning pipeline."""
    return spread(t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned"))


def q_stop_words(s: SparkSession, d: str) -> DataFrame:
    """Titles without stop words (X11)."""
    return t(s, d, "reddit_post_new").select("id", "title").distinct().select("id", X.remove_stop_words(X.clean_text(F.col("title"))).alias("kept"))


def q_email_url(s: SparkSession, d: str) -> DataFrame:
    """Characters that e-mails, urls and tags take."""
    n = lambda f: (F.length("text") - F.length(f(F.col("text")))).cast("bigint")
    return spread(t(s, d, "documents").select("doc_id", "text")).select("doc_id", n(X.remove_emails).alias("emails"), n(X.remove_urls).alias("urls"), n(X.remove_tags).alias("tags"))


def q_top_words(s: SparkSession, d: str) -> DataFrame:
    return M.top_words(t(s, d, "documents"), "text", 20)


def q_keyword_family(s: SparkSession, d: str) -> DataFrame:
    """Texts per kind that name strength or care."""
    return M.family_presence(t(s, d, "documents"), "text", "kind", {"power": ["strong", "attack", "fight", "armour"], "care": ["friend", "help", "cheerful", "free"]})


def q_word_count(s: SparkSession, d: str) -> DataFrame:
    """Mean number of words per kind."""
    w = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != ""))
    return t(s, d, "documents").where("text is not null").groupBy("kind").agg(F.round(F.avg(w), 4).alias("mean_words"))


def q_rake(s: SparkSession, d: str) -> DataFrame:
    """Ten keyphrases of each post's own text."""
    return M.rake(t(s, d, "reddit_post_new").groupBy("id").agg(F.max("selftext").alias("text")), "id", "text")


def q_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of 500 characters with 100 repeated."""
    return M.chunks(t(s, d, "documents"), "doc_id", "text")


def q_chat_pairs(s: SparkSession, d: str) -> DataFrame:
    """Turns of the chats in pairs, the latest first."""
    return M.turns(t(s, d, "documents").where("kind = 'chat'"), "doc_id", "text")


def q_regex_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields of the well reports."""
    r = t(s, d, "documents").where("kind = 'well_report' and text is not null")
    return r.select("doc_id", *[c.alias(n) for n, c in M.well_fields(F.col("text")).items()])


def q_api_numbers(s: SparkSession, d: str) -> DataFrame:
    """API numbers in raw text and in texts."""
    r = t(s, d, "raw_well_data").select(F.concat(F.lit("w"), "id").alias("id"), F.col("api_no").alias("text"))
    o = t(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return r.unionByName(o).where("text is not null").select("id", F.array_join(M.api_numbers(F.col("text")), ",").alias("numbers")).where("numbers <> ''")


def q_group_bias(s: SparkSession, d: str) -> DataFrame:
    """Share of each kind of text per source against all."""
    return M.group_bias(t(s, d, "documents"), "source", "kind")


def q_weighted_error(s: SparkSession, d: str) -> DataFrame:
    """Weighted errors per year and line status."""
    x = t(s, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_linestatus", F.col("l_quantity").cast("bigint").alias("freq"), F.when(F.col("l_returnflag") == "N", "B-PER").when(F.col("l_returnflag") == "A", "B-LOC").otherwise("O").alias("tag"))
    e = M.weighted_errors(x, ["year", "l_linestatus"], "freq", "tag")
    return e.select("year", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("type1", "type2", "type3")])


def q_prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts of every region and segment (X28): two short lists, rendered."""
    r = t(s, d, "region").select("r_name")
    g = t(s, d, "customer").select("c_mktsegment").distinct()
    return r.join(F.broadcast(g)).select(F.format_string("Suggest a job for a %s customer from %s.", F.lower("c_mktsegment"), "r_name").alias("prompt"))


def _days_as_text(f):
    """Dates as ISO text, which compares alike everywhere."""

    def query(s: SparkSession, d: str) -> DataFrame:
        df = f(s, d)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    query.__doc__ = f.__doc__
    return query


QUERIES = {k: _days_as_text(f) for k, f in list(globals().items()) if k.startswith("q_")}

_DAILY = "dl as (select ticker_code as source, cast(datetime as date) as day, arg_max(close, (datetime, close)) as value from ticker_daily where close > 0 and isfinite(close) group by all)"
_SPINE = f"{_DAILY}, sp as (select source, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from dl group by source), rs as (select sp.source, sp.day, value from sp left join dl using (source, day))"
_INTER = """x as (select source, day, value, last_value(value ignore nulls) over b as v0, last_value(case when value is not null then day end ignore nulls) over b as d0, first_value(value ignore nulls) over a as v1, first_value(case when value is not null then day end ignore nulls) over a as d1
    from rs window b as (partition by source order by day rows between unbounded preceding and current row), a as (partition by source order by day rows between current row and unbounded following)),
    fl as (select source, day, coalesce(value, v0 + (v1 - v0) * ((day - d0)::double / (d1 - d0)), v0) as value from x)"""
_ORD = "dl as (select 'orders' as source, cast(o_orderdate as date) as day, sum(cast(round(o_totalprice) as bigint))::double as value from orders group by all), sp as (select source, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from dl group by source), rs as (select sp.source, sp.day, value from sp left join dl using (source, day))"
_EMA = f"""{_ORD}, {_INTER}, nb as (select day, value, row_number() over (order by day) as i from fl),
    em as (select 1::bigint as i, value as s, value as l, 0.0::double as g from nb where i = 1
      union all select nb.i, 2.0/13 * value + (1 - 2.0/13) * s, 2.0/27 * value + (1 - 2.0/27) * l, 2.0/11 * ((2.0/13 * value + (1 - 2.0/13) * s) - (2.0/27 * value + (1 - 2.0/27) * l)) + (1 - 2.0/11) * g from em join nb on nb.i = em.i + 1),
    mc as (select nb.day, em.i, s - l as macd, g as signal from em join nb on nb.i = em.i)"""
_CLEAN = "lower(text)"
_CLEAN = f"strip_accents({_CLEAN})"
for _p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:https?://|www\.)[^ \t\r\n]+", r"<[^<>]*>"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
for _a, _b in X.CONTRACTIONS:
    _CLEAN = f"replace({_CLEAN}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b}')"
_CLEAN = rf"trim(regexp_replace({_CLEAN}, '[^a-z]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_ARRAY_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS if w not in X.NEGATIONS) + "]"
_FIELD = lambda p: "coalesce(trim(regexp_extract(text, '" + p.replace("'", "''") + "', 1)), '')"

ORACLES = {
    "q_daily_resample": f"with {_SPINE} select * from rs",
    "q_interpolate": f"with {_SPINE}, {_INTER} select source, day, round(value, 5) as value from fl",
    "q_backfill": f"with {_SPINE} select source, day, first_value(value ignore nulls) over (partition by source order by day rows between current row and unbounded following) as value from rs",
    "q_macd": f"with recursive {_EMA} select day, round(macd, 3) as macd, round(signal, 3) as signal from mc",
    "q_crossover": f"""with recursive {_EMA}, cr as (select day, case when macd - signal > 0 and lag(macd - signal) over o <= 0 then 'Buy' when macd - signal < 0 and lag(macd - signal) over o >= 0 then 'Sell' end as x from mc window o as (order by day))
        select day, coalesce(last_value(x ignore nulls) over (order by day rows between unbounded preceding and current row), 'No Action') as action from cr""",
    "q_rsi": f"""with {_SPINE}, {_INTER}, df as (select source, day, coalesce(value - lag(value) over (partition by source order by day), 0) as df from fl),
        gl as (select source, day, avg(greatest(df, 0)) over w as g, avg(greatest(-df, 0)) over w as l, row_number() over (partition by source order by day) as r from df window w as (partition by source order by day rows between 13 preceding and current row))
        select source, day, round(case when r < 14 then null when l > 0 then 100 - 100 / (1 + g / l) when g > 0 then 100 end, 3) as rsi from gl""",
    "q_lags": f"with {_DAILY}, l as (select *, lag(value, 1) over w as lag_1, lag(value, 2) over w as lag_2, lag(value, 3) over w as lag_3 from dl window w as (partition by source order by day)) select * from l where lag_3 is not null",
    "q_calendar": "select distinct cast(o_orderdate as date) as day, isodow(o_orderdate)::int - 1 as dow, month(o_orderdate)::int as month, year(o_orderdate)::int as year, dayofyear(o_orderdate)::int as doy, quarter(o_orderdate)::int as quarter, weekofyear(o_orderdate)::int as week from orders",
    "q_minmax": f"with {_DAILY} select source, day, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from dl window w as (partition by source)",
    "q_split": f"with {_DAILY} select source, floor(count(*) * 0.9 + 1e-9)::bigint as train, count(*) as n from dl group by 1",
    "q_tail": f"with {_DAILY} select * from dl qualify row_number() over (partition by source order by day desc) <= 5",
    "q_acf": f"with {_ORD}, {_INTER}, c as (select day, value - avg(value) over () as x from fl), k as (select unnest(range(0, 31))::int as lag), p as (select row_number() over (order by day) as i, x from c) select k.lag, round(sum(a.x * b.x) / (select sum(x * x) from p), 5) as acf from k join p a on true join p b on b.i = a.i - k.lag group by k.lag",
    "q_corr_matrix": "with r as (select * from ticker_daily where " + " and ".join(f"{c} > 0 and isfinite({c})" for c in ("open", "high", "close", "volume")) + ") "
    + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 5) as corr from r" for a, b in (("open", "high"), ("open", "close"), ("open", "volume"), ("high", "close"), ("high", "volume"), ("close", "volume"))),
    "q_rmse_band": f"with {_DAILY}, l as (select value - lag(value) over (partition by source order by day) as e from dl) select round(avg(e * e), 3) as mse, round(sqrt(avg(e * e)), 3) as rmse, round(stddev_pop(e) * 1.96, 3) as band from l where e is not null",
    "q_missing_days": f"with {_DAILY}, s as (select distinct source from dl), g as (select source, unnest(generate_series(date '2016-01-01', date '2016-12-31', interval 1 day))::date as day from s) select g.* from g anti join dl on g.source = dl.source and g.day = dl.day",
    "q_text_clean": f"select doc_id, md5({_CLEAN}) as cleaned from documents",
    "q_stop_words": f"with p as (select distinct id, title as text from reddit_post_new) select id, array_to_string(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '' and not list_contains({_ARRAY_STOP}, w)), ' ') as kept from p",
    "q_email_url": r"select doc_id, length(text) - length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g')) as emails, length(text) - length(regexp_replace(text, '(?:https?://|www\.)[^ \t\r\n]+', '', 'g')) as urls, length(text) - length(regexp_replace(text, '<[^<>]*>', '', 'g')) as tags from documents",
    "q_top_words": f"with w as (select unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as word from documents) select word, count(*) as n from w where not list_contains({_STOP}, word) group by 1 order by n desc, word limit 20",
    "q_keyword_family": "select kind, count_if(regexp_matches(lower(coalesce(text, '')), 'strong|attack|fight|armour'))::bigint as power, count_if(regexp_matches(lower(coalesce(text, '')), 'friend|help|cheerful|free'))::bigint as care from documents group by 1",
    "q_word_count": r"select kind, round(avg(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> ''))), 4) as mean_words from documents where text is not null group by 1",
    "q_rake": rf"""with t as (select id, regexp_replace(regexp_replace(lower(max(selftext)), '[^a-z \t\r\n]+', '|', 'g'), '\b(?:{"|".join(X.STOP_WORDS)})\b', '|', 'g') as t from reddit_post_new group by id),
        p0 as (select id, trim(regexp_replace(unnest(string_split(t, '|')), '[ \t\r\n\f]+', ' ', 'g')) as phrase from t), p as (select id, phrase, count(*) as times from p0 where phrase <> '' group by all),
        w as (select id, phrase, times, len(string_split(phrase, ' ')) as n, unnest(string_split(phrase, ' ')) as word from p), s as (select id, word, sum(times * n) / sum(times) as sc from w group by all),
        r as (select w.id, phrase, round(sum(sc), 6) as score from w join s on s.id = w.id and s.word = w.word group by w.id, phrase) select id, phrase, score from r qualify row_number() over (partition by id order by score desc, phrase) <= 10""",
    "q_regex_fields": "select doc_id, " + ", ".join(f"coalesce(nullif({_FIELD(p)}, ''), {_FIELD(M.WELL_FIELDS['file_no'])}) as {n}" if n == "job_id" else f"{_FIELD(p)} as {n}" for n, p in M.WELL_FIELDS.items()) + " from documents where kind = 'well_report' and text is not null",
    "q_api_numbers": rf"""with s as (select 'w' || id as id, api_no as text from raw_well_data union all select 'd' || doc_id, text from documents), x as (select id, list_transform(regexp_extract_all(text, '{M.API_NUMBER}', 1), lambda v: regexp_replace(regexp_replace(v, '\D', '', 'g'), '^(\d{{2}})(\d{{3}})(\d{{5}})$', '\1-\2-\3')) as l from s where text is not null)
        select id, array_to_string(list_sort(list_distinct(l)), ',') as numbers from x where len(l) > 0""",
    "q_group_bias": "with n as (select source, kind, count(*) as n from documents where source is not null and kind is not null group by all), g as (select source, sum(n) as gn from n group by 1), b as (select kind, sum(n) as ln, (select sum(n) from n) as total from n group by 1), x as (select g.source, b.kind, coalesce(n.n, 0) * 100.0::double / gn as pct, ln * 100.0::double / total as base from g cross join b left join n on n.source = g.source and n.kind = b.kind) select source, kind, round(pct, 6) as pct, round(base, 6) as baseline, round(pct - base, 6) as deviation from x",
    "q_weighted_error": "select year(l_shipdate)::int as year, l_linestatus, round(sum(case when l_returnflag <> 'N' then l_quantity::bigint else 0 end)::double / sum(l_quantity::bigint), 6) as type1, round(sum(case when l_returnflag = 'A' then l_quantity::bigint else 0 end)::double / sum(l_quantity::bigint), 6) as type2, round(sum(case when l_returnflag = 'R' then l_quantity::bigint else 0 end)::double / sum(l_quantity::bigint), 6) as type3 from lineitem group by 1, 2",
    "q_prompts": "select 'Suggest a job for a ' || lower(c_mktsegment) || ' customer from ' || r_name || '.' as prompt from region cross join (select distinct c_mktsegment from customer)",
}
for _k in ("daily_resample", "interpolate", "backfill", "macd", "crossover", "rsi", "lags", "calendar", "minmax", "tail", "missing_days"):
    ORACLES[f"q_{_k}"] = f"select * replace (cast(day as varchar) as day) from ({ORACLES[f'q_{_k}']})"
