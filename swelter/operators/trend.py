"""Yearly and period summaries, and linear trends."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import quantiles
from swelter.sources import shared


def annual_summary(df: DataFrame, value: str, high: float = 2.0, keys=("city",)) -> DataFrame:
    sums = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count_if(F.col(value) > high).alias("n_high")]
    found = quantiles.grouped(df.withColumn("year", F.year("date")), [*keys, "year"], value, [0.9], sums)
    return found.select(*keys, "year", "n", "mean", F.get("q", F.lit(0)).alias("p90"), "max", "n_high")


def head_tail_by_group(df: DataFrame, order: str, n: int = 4, keys=("city",)) -> DataFrame:
    """The first and the last n rows of each group."""
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__u", F.row_number().over(up)).withColumn("__d", F.row_number().over(down)).where((F.col("__u") <= n) | (F.col("__d") <= n)).drop("__u", "__d")


def monthly_component_mean(scores: DataFrame, value: str, keys=("city",)) -> DataFrame:
    return scores.where(F.col(value).isNotNull()).groupBy(*keys, F.trunc("date", "month").cast("date").alias("month")).agg(F.avg(value).alias("mean"))


def symmetric_limit(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.max(F.abs(value)).alias("limit"))


def period_summary(df: DataFrame, value: str, flag: str, keys=("city",)) -> DataFrame:
    """Distribution of a value on flagged days, per group and period."""
    rows = df.where(flag).withColumn("period", C.period_bucket(F.year("date")))
    found = quantiles.grouped(rows, [*keys, "period"], value, [0.9], [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")])
    return found.select(*keys, "period", "n", "mean", F.get("q", F.lit(0)).alias("p90"), "max")


def trend_sums(df: DataFrame, y: str, x: str, keys=("city",)) -> DataFrame:
    """Slope and its standard error of y on x within groups, from grouped sums."""
    s = df.groupBy(*keys).agg(*[getattr(F, f"regr_{f}")(y, x).alias(f) for f in ("count", "slope", "sxx", "sxy", "syy")])
    rest = F.try_divide(F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)), F.when(F.col("count") > 2, F.col("count") - 2))
    return s.withColumn("se", F.sqrt(F.try_divide(rest, F.col("sxx")))).select(*keys, F.col("count").alias("n"), "slope", "se")


def _t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t: a regularised incomplete beta by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 1.0 if x >= 1 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a, b, x):
        f, c, d = 1.0, 1.0, 0.0
        for k in range(400):
            m = k // 2
            top = 1.0 if k == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return f - 1

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def _t_quantile(p: float, df: int) -> float:
    """The t whose two-sided tail is p, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_tail(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def linear_trend(df: DataFrame, y: str, x: str, per: float = 10.0, level: float = 0.95, keys=("city",)) -> DataFrame:
    """Slope per `per` units of x, its confidence limits and p-value, a row for each group. The sums are Spark's; only the
    t distribution of each group's row is computed in a task."""
    shared.ship(df.sparkSession)
    sums = trend_sums(df, y, x, keys)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            low, high, p = [], [], []
            for n, slope, se in zip(pdf["n"], pdf["slope"], pdf["se"]):
                ok = n > 2 and se == se and slope == slope and slope is not None and se is not None
                q = _t_quantile(1 - level, int(n) - 2) if ok else None
                low.append((slope - q * se) * per if ok else None)
                high.append((slope + q * se) * per if ok else None)
                p.append((_t_tail(abs(slope / se), int(n) - 2) if se > 0 else 0.0) if ok else None)
            yield pdf.assign(slope=pdf["slope"] * per, se=pdf["se"] * per, ci_low=low, ci_high=high, p_value=p)

    fields = [f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in keys] + ["n long", "slope double", "se double", "ci_low double", "ci_high double", "p_value double"]
    return sums.mapInPandas(run, ", ".join(fields))
