"""Daily and monthly features, standardised within stations, with rolling and lagged exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({
        "yr": F.year(date), "mo": F.month(date), "doy": F.dayofyear(date), "yr_mo": F.date_format(date, "yyyy-MM"),
        "month_start": F.trunc(date, "month"), "season": C.season(F.month(date)),
    })


def daily_derived(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dtr": F.col("tmax_daily") - F.col("tmin_daily"), "dewpoint_range_daily": F.col("dewpoint_max_daily") - F.col("dewpoint_min_daily"),
        "pressure_range_daily": F.col("pressure_max") - F.col("pressure_min"),
    })


def heat_calendar(df: DataFrame) -> DataFrame:
    """year, doy and intensity: the excess over the 90th percentile on days over it, else null."""
    return df.select("city", "date", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), F.when(F.col("above_p90"), F.col("excess_p90")).alias("intensity"))


#: Monthly measures as (name, aggregate, daily column).
MONTHLY = [
    ("mean_tmax", "avg", "tmax_daily"), ("max_tmax", "max", "tmax_daily"), ("mean_tmean", "avg", "tmean_daily"), ("mean_apparent", "avg", "apparent_temp"),
    ("sd_tmax", "stddev_samp", "tmax_daily"), ("sd_tmean", "stddev_samp", "tmean_daily"), ("mean_dtr", "avg", "dtr"), ("sd_dtr", "stddev_samp", "dtr"), ("mean_tsd", "avg", "tsd_daily"),
    ("mean_humidity", "avg", "humidity_mean"), ("min_humidity", "min", "humidity_min"), ("max_humidity", "max", "humidity_max"),
    ("mean_dewpoint", "avg", "dewpoint_daily"), ("mean_dewpoint_range", "avg", "dewpoint_range_daily"), ("max_daily_precip", "max", "precip_total"),
    ("mean_pressure", "avg", "pressure_mean"), ("mean_pressure_range", "avg", "pressure_range_daily"),
    ("mean_radiation", "avg", "radiation_total"), ("mean_radiation_peak", "avg", "radiation_max"),
    ("mean_wind", "avg", "wind_mean"), ("mean_wind_peak", "avg", "wind_max"), ("mean_gust_peak", "avg", "wind_gust_max"),
]


def monthly_features(daily: DataFrame, keys=("city",)) -> DataFrame:
    """One row per station and month from daily rows with the flags above_p90, above_p95 and hw_day. Means over no
    exceedance day are 0."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    some = lambda p: F.coalesce(F.avg(F.when(F.col(f"above_{p}"), F.col(f"excess_{p}"))), F.lit(0.0)).alias(f"mean_excess_{p}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    when = [F.year("date").alias("yr"), F.month("date").alias("mo"), F.date_format("date", "yyyy-MM").alias("yr_mo")]
    return daily.groupBy(*keys, *when).agg(
        F.count(F.lit(1)).cast("int").alias("n_days"), flag("long_gap").cast("int").alias("n_long_gap"), F.avg("n_obs").alias("n_obs_mean"),
        *[getattr(F, how)(c).alias(n) for n, how, c in MONTHLY],
        flag("above_p90").alias("days_above_p90"), flag("above_p95").alias("days_above_p95"), flag("hw_day").alias("hw_days"), some("p90"), some("p95"),
        total("excess_p90").alias("degree_days_p90"), total("excess_p95").alias("degree_days_p95"),
        total("precip_total").alias("total_precip"), F.count_if(F.col("precip_total") < 1).alias("dry_days"),
    )


def zscore_within(df: DataFrame, columns: list[str], keys=("city",), raw: str | None = None) -> DataFrame:
    """columns standardised by the group's mean and sample deviation; null where the deviation is 0, that is where least and
    largest are equal (merged deviations of a constant may miss 0 by rounding). With raw, a suffix, the columns as they were
    stand beside them."""
    spread = lambda c: F.when(F.min(c) < F.max(c), F.stddev_samp(c))
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", spread))])
    out = df.join(stats, list(keys))
    z = {c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))) for c in columns}
    if raw:
        z |= {f"{c}{raw}": F.col(c) for c in columns}
    return out.withColumns(z).select(*df.columns, *([f"{c}{raw}" for c in columns] if raw else []))


def recent_years(df: DataFrame, years: int, date: str = "date") -> DataFrame:
    """Rows of the table's last `years` calendar years."""
    last = df.agg(F.max(F.year(date))).first()[0]
    return df.where(F.year(date) > last - years) if last is not None else df


def rolling_features(df: DataFrame, sums: dict[str, tuple], means: dict[str, tuple], lags: dict[str, tuple], keys=("city",), date: str = "date") -> DataFrame:
    """Right-aligned rolling sums (missing is 0), means and maxima (missing skipped) and lags in calendar days; null
    before the n-th day of a series. df needs a complete calendar. All frames share one sort."""
    w = Window.partitionBy(*keys).orderBy(date)
    full = lambda n, x: F.when(F.row_number().over(w) >= n, x)
    new = {}
    for c, ns in sums.items():
        for n in ns:
            new[f"sum_{c}_{n}d"] = full(n, F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(w.rowsBetween(1 - n, 0)))
    for c, ns in means.items():
        for n in ns:
            new[f"mean_{c}_{n}d"] = full(n, F.avg(c).over(w.rowsBetween(1 - n, 0)))
            new[f"max_{c}_{n}d"] = full(n, F.max(c).over(w.rowsBetween(1 - n, 0)))
    for c, ks in lags.items():
        for k in ks:
            new[f"{c}_lag{k}"] = F.lag(c, k).over(w)
    return df.withColumns(new)
