"""Percentile thresholds and what exceeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import quantiles


def _long(daily: DataFrame, metrics: dict[str, str], keys) -> DataFrame:
    """keys, date, metric, value."""
    return daily.select(*keys, "date", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()])).alias("m")).select(*keys, "date", "m.*")


def _seasonal(rows: DataFrame, group: list[str], probs: list[float], half: int) -> DataFrame:
    """group, doy and q, the quantiles of the values within `half` days of each day of the year, for days that have one. A day of the year has one value a
    year, and these are gathered once; a window of days then slides round the year over the gathered arrays, whose
    first and last days lie at both ends. So a value is moved to its series once, and not to each of the days it counts for."""
    gathered = rows.groupBy(*group, F.dayofyear("date").alias("doy")).agg(F.collect_list("value").alias("values"))
    doys = rows.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    right = gathered.select(*[F.col(c).alias(f"__{c}") for c in [*group, "doy"]], "values")
    on = [doys[c].eqNullSafe(right[f"__{c}"]) for c in [*group, "doy"]]
    year = doys.join(right, on, "left").select(*group, "doy", "values")
    ends = F.filter(F.array(F.col("doy") - 366, F.col("doy"), F.col("doy") + 366), lambda at: (at > -half) & (at <= 366 + half))
    around = Window.partitionBy(*group).orderBy("__at").rowsBetween(-half, half)
    pooled = year.withColumn("__at", F.explode(ends)).withColumn("__s", F.sort_array(F.flatten(F.collect_list("values").over(around))))
    n = F.size("__s")
    at = lambda p: (n - 1) * F.lit(p)
    value = lambda k: F.get("__s", k.cast("int"))
    q = F.array(*[value(F.floor(at(p))) + (value(F.ceil(at(p))) - value(F.floor(at(p)))) * (at(p) - F.floor(at(p))) for p in probs])
    return pooled.where((F.col("__at") >= 1) & (F.col("__at") <= 366) & (n > 0)).select(*group, "doy", q.alias("q"))


def thresholds(daily: DataFrame, metrics: dict[str, str], percents=(90.0, 92.5, 95.0), mode: str = "fixed", half_window: int = 7, keys=("city",)) -> DataFrame:
    """keys, metric, percent, threshold; in seasonal mode also doy 1..366. metrics: name -> column.

    Percentiles interpolate linearly, and all come from one pass. Seasonal ones pool the days within half_window days of
    the year, around its end, over all years (see `_seasonal`)."""
    rows, group = _long(daily, metrics, keys), [*keys, "metric"]
    if mode == "seasonal":
        found, group = _seasonal(rows, group, [p / 100 for p in percents], half_window), [*group, "doy"]
    elif mode == "fixed":
        found = quantiles.grouped(rows, group, "value", [p / 100 for p in percents], [])
    else:
        raise ValueError("mode is 'fixed' or 'seasonal'")
    named = F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.coalesce("q", F.array(*[F.lit(None).cast("double")] * len(percents))).alias("threshold"))
    return found.select(*group, F.explode(named).alias("z")).select(*group, F.col("z.percent"), F.col("z.threshold"))


def attach_threshold(daily: DataFrame, thr: DataFrame, keys=("city",)) -> DataFrame:
    """daily in long form with its thresholds: metric, percent, value, threshold, over and excess. One row a key
    (and day of the year) in thr: Spark broadcasts it while it is small."""
    metrics = thr.columns
    on = [*keys, *(["doy"] if "doy" in metrics else [])]
    rows = daily.withColumn("doy", F.dayofyear("date")) if "doy" in metrics else daily
    return rows.join(thr, on, "left")


def exceedance(daily: DataFrame, thr: DataFrame, metric: str, column: str, percents=(90.0, 95.0), keys=("city",)) -> DataFrame:
    """daily with above_pNN and excess_pNN for each percent."""
    named = {p: f"p{p:g}".replace(".", "") for p in percents}
    wide = thr.where(F.col("metric") == metric)
    on = [*keys, *(["doy"] if "doy" in thr.columns else [])]
    wide = wide.groupBy(*on).agg(*[F.max(F.when(F.col("percent") == p, F.col("threshold"))).alias(f"thr_{n}") for p, n in named.items()])
    rows = daily.withColumn("doy", F.dayofyear("date")) if "doy" in thr.columns else daily
    out = rows.join(wide, on, "left")
    new = {}
    for n in named.values():
        new[f"above_{n}"] = C.is_over(F.col(column), F.col(f"thr_{n}"))
        new[f"excess_{n}"] = C.excess(F.col(column), F.col(f"thr_{n}"))
    return out.withColumns(new)
