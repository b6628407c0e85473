"""From hourly readings to a gap-free daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C

#: (name, hourly measure, aggregate) of the daily measures.
DAILY = [
    ("tmax_daily", "tmax_c", "max"), ("tmin_daily", "tmin_c", "min"), ("tmean_daily", "temp_drybulb_c", "avg"), ("tsd_daily", "temp_drybulb_c", "stddev_samp"),
    ("dewpoint_daily", "dewpoint_c", "avg"), ("dewpoint_max_daily", "dewpoint_max_c", "max"), ("dewpoint_min_daily", "dewpoint_min_c", "min"),
    ("humidity_mean", "rh_pct", "avg"), ("humidity_min", "rh_min_pct", "min"), ("humidity_max", "rh_max_pct", "max"),
    ("pressure_mean", "pressure_mbar", "avg"), ("pressure_max", "pressure_max_mbar", "max"), ("pressure_min", "pressure_min_mbar", "min"),
    ("radiation_total", "radiation_kj", "sum"), ("radiation_mean", "radiation_kj", "avg"), ("radiation_max", "radiation_kj", "max"), ("radiation_min", "radiation_kj", "min"),
    ("wind_mean", "wind_speed_ms", "avg"), ("wind_max", "wind_speed_ms", "max"), ("wind_min", "wind_speed_ms", "min"),
    ("wind_gust_max", "wind_gust_ms", "max"), ("wind_gust_mean", "wind_gust_ms", "avg"), ("wind_gust_min", "wind_gust_ms", "min"),
    ("precip_total", "precip_mm", "sum"),
]
MEASURES = [name for name, _, _ in DAILY]


def range_qc(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Readings outside their physical limits become null."""
    limits = limits or C.QC_LIMITS
    return df.withColumns({c: C.within(F.col(c), lo, hi) for c, (lo, hi) in limits.items() if c in df.columns})


def hourly_to_daily(hourly: DataFrame, keys=("city", "date"), distinct_on: list[str] | None = None) -> DataFrame:
    """One row per station and day. The sum of no reading is 0, other measures of none are null. distinct_on: drop
    rows that repeat these columns first (by default rows are taken as they come)."""
    if distinct_on:
        hourly = hourly.dropDuplicates(distinct_on)

    def measure(name, source, how):
        out = getattr(F, how)(source)
        return (F.coalesce(out, F.lit(0.0)) if how == "sum" else out).alias(name)

    return hourly.groupBy(*keys).agg(
        *[measure(*m) for m in DAILY], F.count(F.lit(1)).cast("int").alias("n_obs"), F.count("tmax_c").cast("int").alias("n_tmax_valid")
    )


def complete_calendar(df: DataFrame, keys=("city",), date: str = "date") -> DataFrame:
    """Every day from a series' first to its last; the days that were missing have nulls."""
    spine = df.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).where(F.col("lo").isNotNull())
    spine = spine.select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))
    return spine.join(df, [*keys, date], "left")


def flag_long_gaps(df: DataFrame, present: str = "n_obs", longest: int = 3, keys=("city",), date: str = "date") -> DataFrame:
    """long_gap: a day that was missing, in a run of more than `longest` such days. Runs are found among the missing
    days: consecutive ones have the same day number less rank."""
    gone = F.col(present).isNull()
    rank = F.row_number().over(Window.partitionBy(*keys, gone).orderBy(date))
    df = df.withColumn("__run", F.when(gone, F.unix_date(date) - rank))
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    return df.withColumn("long_gap", gone & (many > longest)).drop("__run")


def interpolate_gaps(df: DataFrame, columns: list[str], present: str = "n_obs", keys=("city",), date: str = "date") -> DataFrame:
    """Linear interpolation on missing days in short gaps (needs long_gap), between the nearest values on either side
    of each column. Days that were there keep their nulls, and nothing is extrapolated. Both sides are running frames, the
    later one over falling dates: a frame that ends with the partition would cost the square of a series' length."""
    before = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, 0)
    fill = F.col(present).isNull() & ~F.col("long_gap")
    day = F.unix_date(date)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), day.alias("d"))) for c in columns}
    df = df.withColumns({f"__p_{c}": F.last(x, ignorenulls=True).over(before) for c, x in known.items()} | {f"__n_{c}": F.last(x, ignorenulls=True).over(after) for c, x in known.items()})

    def value(c):
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * F.try_divide(day - p["d"], n["d"] - p["d"])
        return F.when(fill, line).otherwise(F.col(c))

    out = df.withColumns({c: value(c) for c in columns}).withColumn(present, F.coalesce(present, F.lit(0)))
    return out.drop(*[f"__{s}_{c}" for c in columns for s in "pn"])


def clean_daily(daily: DataFrame, keys=("city",)) -> DataFrame:
    """Complete calendar, short gaps interpolated, long ones flagged, apparent temperature added."""
    full = interpolate_gaps(flag_long_gaps(complete_calendar(daily, keys), keys=keys), MEASURES, keys=keys)
    return full.withColumn("apparent_temp", C.apparent_temp(F.col("tmax_daily"), F.col("humidity_mean"), F.col("wind_mean")))


def daily_qa(daily: DataFrame, keys=("city",)) -> DataFrame:
    """Counts, range and nulls of a daily series."""
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.min("tmax_daily").alias("tmax_min"), F.max("tmax_daily").alias("tmax_max"), F.count_if(F.col("tmax_daily").isNull()).alias("n_tmax_null"),
        F.count_if(F.col("long_gap")).alias("n_long_gap"), F.count_if(F.col("n_obs") == 0).alias("n_filled"), F.avg("apparent_temp").alias("mean_apparent"),
    )


def days_per_year(daily: DataFrame, keys=("city",)) -> DataFrame:
    return daily.groupBy(*keys, F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_days"))
