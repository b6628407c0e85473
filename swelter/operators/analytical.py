"""Reshaping, the merged analytical table, and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.operators import quantiles

WINDOWS = ["6_10", "11_18", "cumulative"]


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, checked to have no two rows of a key."""
    twice = df.groupBy(*keys).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{keys} repeat: {twice[0]}")
    return df


def pivot_windows(df: DataFrame, values: list[str], person: str = "ext_genid", windows=None) -> DataFrame:
    """One row per person with {value}_{window} columns. The windows are given, so no extra pass finds them."""
    windows = windows or WINDOWS
    wide = df.where(F.col("window").isin(*windows)).groupBy(person).pivot("window", windows).agg(*[F.first(v).alias(v) for v in values])
    one = len(values) == 1
    return wide.select(person, *[F.col(w if one else f"{w}_{v}").alias(f"{v}_{w}") for v in values for w in windows])


def unpivot_metrics(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def merge_analytical(cohort: DataFrame, births: DataFrame, scores: DataFrame, components: DataFrame, person: str = "ext_genid") -> DataFrame:
    """cohort with births, wide scores and wide components. The three have one row per person and are joined with each other
    first, so the wide cohort is shuffled once; its rows are kept as they are."""
    right = require_unique(births, [person])
    for other in (scores, components):
        right = right.join(require_unique(other, [person]), person, "full")
    return cohort.join(right, person, "left")


def describe_long(df: DataFrame, variables: list[str], keys=("city",)) -> DataFrame:
    """keys, variable, n_total, n_nonmiss, mean, sd, median, p25, p75, min, max, in the order of variables."""
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(list(keys), variables, "variable", "value")
    sums = [F.count(F.lit(1)).alias("n_total"), F.count("value").alias("n_nonmiss"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")]
    out = quantiles.grouped(long, [*keys, "variable"], "value", [0.25, 0.5, 0.75], sums)
    place = F.array_position(F.array(*map(F.lit, variables)), F.col("variable"))
    return out.select(*keys, "variable", place.cast("int").alias("position"), "n_total", "n_nonmiss", "mean", "sd", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(2)).alias("p75"), "min", "max")


def describe_cohort(df: DataFrame, numbers: list[str], codes: list[str], any_of: list[str]) -> DataFrame:
    """variable, level, n, mean, sd, median, min, max: numbers, counts of each code, and rows with any of any_of."""
    empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "median", "min", "max")]
    long = df.select(*[F.col(v).cast("double").alias(v) for v in numbers]).unpivot([], numbers, "variable", "value")
    sums = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")]
    parts = quantiles.grouped(long, ["variable"], "value", [0.5], sums).select("variable", F.lit(None).cast("string").alias("level"), "n", "mean", "sd", F.get("q", F.lit(0)).alias("median"), "min", "max")
    for c in codes:
        parts = parts.unionByName(df.groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("variable"), "level", "n", *empty))
    some = F.lit(False)
    for c in any_of:
        some = some | F.col(c).isNotNull()
    return parts.unionByName(df.agg(F.count_if(some).alias("n")).select(F.lit("any_index").alias("variable"), F.lit(None).cast("string").alias("level"), "n", *empty))


def coverage_report(components: DataFrame, person: str = "ext_genid") -> DataFrame:
    one = components.select(person, "window", "coverage_frac").distinct()
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return one.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage_frac").alias("mean"), share(F.col("coverage_frac") == 0).alias("pct_zero"), share(F.col("coverage_frac") >= 0.95).alias("pct_full"))


def hw_count_report(components: DataFrame, hw_def: str = "tmax_p90_d3") -> DataFrame:
    found = quantiles.grouped(components.where(F.col("hw_def") == hw_def), ["window"], "hw_count", [0.5], [F.avg("hw_count").alias("mean"), F.max("hw_count").cast("int").alias("max")])
    return found.select("window", "mean", F.get("q", F.lit(0)).alias("median"), "max")


def wave(df: DataFrame, k: int, name: str = "redcap_event_name") -> DataFrame:
    """Rows of one wave: an event name is 'wave', the wave's number and perhaps an arm."""
    return df.where(F.regexp_extract(name, r"^wave0*(\d+)(_|$)", 1) == str(k))


def describe_numbers(df: DataFrame, numbers: list[str]) -> DataFrame:
    """variable, position, n, n_missing, mean, sd, median, p25, p75, min, max of whole-table numbers, in the order given."""
    long = df.select(*[F.col(v).cast("double").alias(v) for v in numbers]).unpivot([], numbers, "variable", "value")
    sums = [F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")]
    out = quantiles.grouped(long, ["variable"], "value", [0.25, 0.5, 0.75], sums)
    place = F.array_position(F.array(*map(F.lit, numbers)), F.col("variable")).cast("int").alias("position")
    return out.select("variable", place, "n", "n_missing", "mean", "sd", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(2)).alias("p75"), "min", "max").orderBy("position")


def describe_wave(df: DataFrame, numbers: list[str], codes: list[str], any_of: list[str]) -> DataFrame:
    """variable, level, n_total, n_nonmiss, mean, sd, median, p25, p75, min, max: the numbers, the rows of each code, and the rows that have any of any_of."""
    stats = ["mean", "sd", "median", "p25", "p75", "min", "max"]
    n = df.count()
    names = ["variable", "level", "n_total", "n_nonmiss", *stats]
    no_level, none = F.lit(None).cast("string").alias("level"), [F.lit(None).cast("double").alias(c) for c in stats]
    total = F.lit(n).cast("long").alias("n_total")
    out = describe_numbers(df, numbers).select("variable", no_level, total, F.col("n").alias("n_nonmiss"), *stats)
    for c in codes:
        counted = df.groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n_nonmiss"))
        out = out.unionByName(counted.select(F.lit(c).alias("variable"), "level", total, "n_nonmiss", *none))
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in any_of])
    return out.unionByName(df.agg(F.count(some).alias("n_nonmiss")).select(F.lit("any_index").alias("variable"), no_level, total, "n_nonmiss", *none)).select(*names)


def column_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """variable, n (rows that have it), n_rows."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in names])
    return counted.unpivot(["n_rows"], names, "variable", "n").select("variable", "n", "n_rows")


def stack(*tables: DataFrame) -> DataFrame:
    """Tables one under the other by column name; a column that a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
