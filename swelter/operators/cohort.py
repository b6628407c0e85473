"""Persons of a longitudinal cohort: birth dates, windows of development, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import clean

#: Windows as (name, first year, year that ends it): from birth + first years up to the day before birth + last years.
WINDOWS = [("0_5", 0, 5), ("6_10", 6, 10), ("11_18", 11, 18)]


def derive_birth_dates(cohort: DataFrame, sites: dict, person: str = "ext_genid", wave: str = "redcap_event_name") -> DataFrame:
    """One row per person with an estimate: the birth date by the first wave, number and spread (days) of the estimates,
    the first wave's site and gender, and the latest assessment of all. One grouping does it all."""
    usable = F.col("d_date").isNotNull() & F.col("age").isNotNull()
    birth = F.when(usable, C.birth_date_estimate(F.col("d_date"), F.col("age")))
    rows = cohort.withColumn("__birth", birth)
    first = F.min(F.when(usable, F.struct(F.col(wave).alias("w"), F.col("__birth").alias("birth"), F.col("site").alias("site"), F.col("gender").alias("gender"))))
    g = rows.groupBy(person).agg(
        first.alias("f"), F.count("__birth").cast("int").alias("n_estimates"), F.stddev_samp(F.unix_date("__birth")).alias("birth_date_sd_days"), F.max("d_date").alias("last_assessment")
    )
    return g.where("n_estimates > 0").select(
        person, F.col("f.birth").alias("birth_date"), "n_estimates", "birth_date_sd_days", F.col("f.site").alias("site"), F.col("f.gender").alias("gender"),
        F.year("f.birth").alias("birth_year"), C.map_code(F.col("f.site"), sites).alias("city"), "last_assessment",
    )


def developmental_windows(persons: DataFrame, windows=None, unit: str = "year", leap_birth: str = "null") -> DataFrame:
    """Each person's windows: window, window_start, window_end; 'cumulative' ends at the latest assessment. unit 'month' is
    for scaled-down windows."""
    windows = windows or WINDOWS
    birth = F.col("birth_date")

    def at(k):
        return C.plus_years(birth, k, leap_birth) if unit == "year" else F.add_months(birth, k)

    spans = [F.struct(F.lit(n).alias("window"), (at(a) if a else birth).alias("window_start"), F.date_sub(at(b), 1).alias("window_end")) for n, a, b in windows]
    spans.append(F.struct(F.lit("cumulative").alias("window"), birth.alias("window_start"), F.col("last_assessment").alias("window_end")))
    return persons.select("*", F.explode(F.array(*spans)).alias("__w")).select(*persons.columns, "__w.*")


def observed_days(windows: DataFrame, daily: DataFrame, keys=("city",)) -> DataFrame:
    """__n, the observed days in each distinct window that meets the series: the running count up to its last day less that
    up to the day before its first, two equality lookups however long it is. Days that the series lacks count as not observed."""
    spans = windows.select(*keys, "window_start", "window_end").distinct().where("window_end >= window_start")
    ends = daily.groupBy(*keys).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = clean.complete_calendar(daily.select(*keys, "date", "n_obs"), keys)
    run = days.select(*keys, "date", F.count_if(F.col("n_obs") > 0).over(upto).alias("k"))
    met = spans.join(ends, list(keys)).withColumns({"__last": F.least("window_end", "__hi"), "__before": F.date_sub(F.greatest("window_start", "__lo"), 1)})
    met = met.where(F.col("__last") > F.col("__before")).drop("__lo", "__hi")
    met = met.join(run.select(*keys, F.col("date").alias("__last"), F.col("k").alias("__k1")), [*keys, "__last"])
    met = met.join(run.select(*keys, F.col("date").alias("__before"), F.col("k").alias("__k0")), [*keys, "__before"], "left")
    return met.select(*keys, "window_start", "window_end", (F.col("__k1") - F.coalesce("__k0", F.lit(0))).alias("__n"))


def coverage_frac(windows: DataFrame, daily: DataFrame, keys=("city",), observed_only: bool = False) -> DataFrame:
    """windows with coverage_frac, the share of a window's days that the climate series has. A series is complete, so the
    share follows from its first and last day; with observed_only, filled days don't count."""
    length = F.datediff("window_end", "window_start") + 1
    if observed_only:
        seen = observed_days(windows, daily, keys)
        out = windows.join(seen, [*keys, "window_start", "window_end"], "left")
        return out.withColumn("coverage_frac", F.when(length > 0, F.coalesce(F.col("__n") / length, F.lit(0.0))).otherwise(0.0)).drop("__n").select(*windows.columns, "coverage_frac")
    ends = daily.groupBy(*keys).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    inside = F.datediff(F.least("window_end", "__hi"), F.greatest("window_start", "__lo")) + 1
    known = F.col("window_end").isNotNull() & F.col("window_start").isNotNull() & F.col("__lo").isNotNull()
    frac = F.when(known & (length > 0), F.greatest(F.lit(0), inside) / length).otherwise(0.0)
    return windows.join(ends, list(keys), "left").withColumn("coverage_frac", frac).drop("__lo", "__hi")


def cohort_qa(births: DataFrame, most_sd: float = 30.0) -> DataFrame:
    return births.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("birth_date_sd_days") > most_sd).alias("n_spread"), F.count_if(F.col("city").isNull()).alias("n_no_city"))
