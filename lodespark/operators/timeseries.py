"""Series per source: regular days, filling, indicators, lags, scaling, splits, correlations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_day(source: str = "source", day: str = "day"):
    return Window.partitionBy(source).orderBy(day)


def resample_daily(df: DataFrame, source: str, day: str, value: str) -> DataFrame:
    """``(source, day, value)`` on every calendar day from a source's first to its last; absent days are null.

    ``df`` has one row per source and day; rows with a null source or day are left out.
    """
    d = df.select(F.col(source).alias("source"), F.col(day).cast("date").alias("day"), F.col(value).alias("value")).where("source is not null and day is not null")
    nxt = F.lead("day").over(by_day())
    filled = d.withColumn("g", F.sequence("day", F.coalesce(F.date_sub(nxt, 1), "day"))).select("*", F.explode("g").alias("at"))
    return filled.select("source", F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("value")).alias("value"))


def interpolate(df: DataFrame) -> DataFrame:
    """Linear in time between known neighbours; leading nulls stay, trailing ones take the last value."""
    before = by_day().rowsBetween(Window.unboundedPreceding, 0)
    after = by_day().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("day"))
    d = df.withColumns({
        "v0": F.last("value", True).over(before), "d0": F.last(known, True).over(before),
        "v1": F.first("value", True).over(after), "d1": F.first(known, True).over(after),
    })
    weight = F.try_divide(F.datediff("day", "d0"), F.datediff("d1", "d0"))
    value = F.coalesce("value", F.col("v0") + (F.col("v1") - F.col("v0")) * weight, "v0")
    return d.select("source", "day", value.alias("value"))


def backfill(df: DataFrame) -> DataFrame:
    """Nulls take the next known value."""
    return df.withColumn("value", F.first("value", True).over(by_day().rowsBetween(0, Window.unboundedFollowing)))


def macd(df: DataFrame, short: int = 12, long: int = 26, signal: int = 9) -> DataFrame:
    """Adds ``macd`` and ``signal``: recursive exponential means (first value as start, alpha 2/(span+1)).

    A series is one task: it holds days, so its length is bounded by the calendar.
    """

    def fold(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("day")
        ema = lambda x, span: x.ewm(span=span, adjust=False).mean()
        line = ema(s["value"], short) - ema(s["value"], long)
        return s.assign(macd=line, signal=ema(line, signal))

    kind = dict(df.dtypes)["source"]
    return df.select("source", "day", "value").groupBy("source").applyInPandas(fold, f"source {kind}, day date, value double, macd double, signal double")


def rsi(df: DataFrame, window: int = 14) -> DataFrame:
    """Adds ``rsi``: from the mean gain and loss of the last ``window`` days (first difference 0).

    Null before ``window`` days and where both are 0; 100 where only the loss is.
    """
    diff = F.coalesce(F.col("value") - F.lag("value").over(by_day()), F.lit(0.0))
    d = df.withColumn("diff", diff)
    frame = by_day().rowsBetween(1 - window, 0)
    d = d.withColumns({
        "gain": F.avg(F.greatest("diff", F.lit(0.0))).over(frame), "loss": F.avg(F.greatest(-F.col("diff"), F.lit(0.0))).over(frame),
        "row": F.row_number().over(by_day()),
    })
    value = F.when(F.col("loss") > 0, 100 - 100 / (1 + F.try_divide("gain", "loss"))).when(F.col("gain") > 0, 100.0)
    return d.withColumn("rsi", F.when(F.col("row") >= window, value)).drop("diff", "gain", "loss", "row")


def crossover(df: DataFrame, a: str = "macd", b: str = "signal") -> DataFrame:
    """Adds ``action``: Buy on the day ``a`` rises above ``b``, Sell when it falls below, carried on; before the first No Action."""
    now, before = F.col(a) - F.col(b), F.lag(F.col(a) - F.col(b)).over(by_day())
    cross = F.when((now > 0) & (before <= 0), "Buy").when((now < 0) & (before >= 0), "Sell")
    d = df.withColumn("_x", cross)
    carried = F.last("_x", True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("action", F.coalesce(carried, F.lit("No Action"))).drop("_x")


def with_lags(df: DataFrame, n: int) -> DataFrame:
    """Adds ``lag_1`` to ``lag_n`` and drops the days that lack one."""
    d = df.withColumns({f"lag_{i}": F.lag("value", i).over(by_day()) for i in range(1, n + 1)})
    return d.na.drop(subset=["value", *[f"lag_{i}" for i in range(1, n + 1)]])


def calendar(day: Column) -> dict[str, Column]:
    """Parts of a date; the week begins with Monday = 0."""
    return {
        "dow": F.weekday(day), "month": F.month(day), "year": F.year(day), "doy": F.dayofyear(day), "quarter": F.quarter(day), "week": F.weekofyear(day),
    }


def minmax(df: DataFrame) -> DataFrame:
    """``scaled`` to 0..1 within the source; null where the source is constant. Aggregated first, then joined."""
    ends = df.groupBy("source").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = df.join(ends, "source")
    return d.withColumn("scaled", F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")


def chronological_split(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Adds ``train``: whether the day is among the first ``floor(share n)`` of its source."""
    n = F.count("*").over(Window.partitionBy("source"))
    return df.withColumn("train", F.row_number().over(by_day()) <= F.floor(n * share + 1e-9))


def tail(df: DataFrame, n: int) -> DataFrame:
    last = Window.partitionBy("source").orderBy(F.desc("day"))
    return df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def autocorrelation(df: DataFrame, lags: int = 30) -> DataFrame:
    """``(source, lag, acf, pacf)`` of each source's series; partial values by Durbin-Levinson on the sums."""
    mean = df.groupBy("source").agg(F.avg("value").alias("m"))
    centred = df.join(mean, "source").select("source", "day", (F.col("value") - F.col("m")).alias("x"))
    pairs = centred.select("source", "x", *[F.lag("x", k).over(by_day()).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = pairs.groupBy("source").agg(F.sum(F.col("x") * F.col("x")).alias("s0"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])

    def levinson(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                s0 = r.s0
                acf = [1.0] + [(getattr(r, f"s{k}") or 0.0) / s0 if s0 else 0.0 for k in range(1, lags + 1)]
                phi: list[float] = []
                rows.append((r.source, 0, 1.0, 1.0))
                for k in range(1, lags + 1):
                    up = acf[k] - sum(p * acf[k - 1 - i] for i, p in enumerate(phi))
                    down = 1 - sum(p * acf[i + 1] for i, p in enumerate(phi))
                    last = up / down if abs(down) > 1e-12 else 0.0
                    phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
                    rows.append((r.source, k, acf[k], last))
            yield pd.DataFrame(rows, columns=["source", "lag", "acf", "pacf"])

    kind = dict(df.dtypes)["source"]
    return sums.mapInPandas(levinson, f"source {kind}, lag int, acf double, pacf double")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, corr)`` of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    held = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(held))


def error_band(df: DataFrame, truth: str, predicted: str, z: float = 1.96) -> DataFrame:
    """MSE, RMSE and the half width of the band of ``z`` population deviations of the residuals."""
    e = F.col(truth) - F.col(predicted)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), (F.stddev_pop(e) * z).alias("band"))


def missing_days(have: DataFrame, first: str, last: str) -> DataFrame:
    """Days of ``first..last`` that a source of ``have (source, day)`` lacks: what a backfill must fetch."""
    spine = have.select("source").distinct().select("source", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return spine.join(have.select("source", F.col("day").cast("date").alias("day")).distinct(), ["source", "day"], "left_anti")


def direct_forecast(df: DataFrame, lags: int = 5) -> DataFrame:
    """Least-squares forecast of the next day from the last ``lags``, fitted on the first 90 % of each series' days."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = chronological_split(with_lags(df, lags))
    v = VectorAssembler(inputCols=[f"lag_{i}" for i in range(1, lags + 1)], outputCol="_f").transform(d)
    model = LinearRegression(featuresCol="_f", labelCol="value", predictionCol="forecast", regParam=1e-6).fit(v.where("train"))
    return model.transform(v.where("not train")).select("source", "day", "value", "forecast")
