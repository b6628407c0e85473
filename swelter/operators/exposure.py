"""Exposure of date windows to climate and heat-wave events.

Work is done once for each distinct (station, start, end), not for each person: `spans` makes them, and results are joined
back to persons at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import event_ranges

SPAN = ["window_start", "window_end"]


def spans(windows: DataFrame, keys=("city",)) -> DataFrame:
    """Distinct proper windows."""
    return windows.select(*keys, *SPAN).where("window_end >= window_start").distinct()


def window_climate_by_join(windows: DataFrame, daily: DataFrame, keys=("city",)) -> DataFrame:
    """General climate of each distinct window, by a range join. daily: with thr_p90. It is the plain twin of window_climate."""
    s = spans(windows, keys)
    days = daily.select(*keys, "date", "tmax_daily", "tmean_daily", "humidity_mean", "precip_total", "thr_p90")
    rows = s.join(days, list(keys)).where(F.col("date").between(F.col("window_start"), F.col("window_end")))
    return rows.groupBy(*keys, *SPAN).agg(
        F.avg("tmax_daily").alias("mean_tmax"), F.avg("tmean_daily").alias("mean_tmean"), F.count_if(C.is_over(F.col("tmax_daily"), F.col("thr_p90"))).cast("int").alias("days_above_p90"),
        F.avg("humidity_mean").alias("mean_humidity"), F.coalesce(F.sum("precip_total"), F.lit(0.0)).alias("total_precip"), F.stddev_samp("tmax_daily").alias("tmax_sd"),
    )


def window_climate(windows: DataFrame, daily: DataFrame, keys=("city",)) -> DataFrame:
    """General climate of each distinct window, from running sums: a window's sum is that up to its last day less that up
    to the day before its first, so each window costs two equality lookups however long it is. The series must be complete.
    Values are centred at the station's mean before they are squared. A window that meets no day has no row."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    measures = ["tmax_daily", "tmean_daily", "humidity_mean", "precip_total"]
    centre = daily.groupBy(*keys).agg(F.avg("tmax_daily").alias("__c"), F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    rows = daily.join(centre, list(keys))
    dev = F.col("tmax_daily") - F.col("__c")
    terms = {f"n_{m}": F.when(F.col(m).isNotNull(), 1.0).otherwise(0.0) for m in measures} | {f"s_{m}": F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in measures}
    terms |= {"d1": F.coalesce(dev, F.lit(0.0)), "d2": F.coalesce(dev * dev, F.lit(0.0)), "over": C.is_over(F.col("tmax_daily"), F.col("thr_p90")).cast("double")}
    running = rows.select(*keys, "date", F.array(*[F.sum(t).over(w) for t in terms.values()]).alias("run"))
    clipped = spans(windows, keys).join(centre.drop("__c"), list(keys)).withColumn("last", F.least("window_end", "__hi")).withColumn("before", F.date_sub(F.greatest("window_start", "__lo"), 1))
    clipped = clipped.where(F.col("last") > F.col("before")).drop("__lo", "__hi")
    upto = running.select(*keys, F.col("date").alias("last"), F.col("run").alias("hi"))
    until = running.select(*keys, F.col("date").alias("before"), F.col("run").alias("lo"))
    both = clipped.join(upto, [*keys, "last"]).join(until, [*keys, "before"], "left")
    at = {name: F.get("hi", F.lit(k)) - F.coalesce(F.get("lo", F.lit(k)), F.lit(0.0)) for k, name in enumerate(terms)}
    both = both.select(*keys, *SPAN, *[x.alias(n) for n, x in at.items()])
    mean = lambda m: F.try_divide(F.col(f"s_{m}"), F.nullif(F.col(f"n_{m}"), F.lit(0.0)))
    n = F.col("n_tmax_daily")
    var = F.when(n > 1, F.greatest(F.col("d2") - F.col("d1") * F.col("d1") / n, F.lit(0.0)) / (n - 1))
    return both.select(
        *keys, *SPAN, mean("tmax_daily").alias("mean_tmax"), mean("tmean_daily").alias("mean_tmean"), F.col("over").cast("int").alias("days_above_p90"),
        mean("humidity_mean").alias("mean_humidity"), F.col("s_precip_total").alias("total_precip"), F.sqrt(var).alias("tmax_sd"),
    )


def clip_events_to_windows(windows: DataFrame, events: DataFrame, keys=("city",)) -> DataFrame:
    """Events that overlap a distinct window, clipped to it: clipped_start, clipped_end, clipped_duration, duration_ratio.
    Both sides have a row for each month they touch and are joined by station and month, so a window meets only events
    near it and a busy station's windows lie in many tasks. A pair comes up in the first month that both have."""

    def monthly(df, lo, hi):
        months = F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("INTERVAL 1 MONTH"))
        return df.where(F.col(lo) <= F.col(hi)).withColumn("__month", F.explode(months))

    both = monthly(spans(windows, keys), *SPAN).join(monthly(events, "start", "end"), [*keys, "__month"])
    both = both.where(F.col("__month") == F.trunc(F.greatest("start", "window_start"), "MM")).drop("__month")
    both = both.where((F.col("start") <= F.col("window_end")) & (F.col("end") >= F.col("window_start")))
    both = both.withColumns({"clipped_start": F.greatest("start", "window_start"), "clipped_end": F.least("end", "window_end")})
    both = both.withColumn("clipped_duration", (F.datediff("clipped_end", "clipped_start") + 1).cast("int"))
    return both.withColumn("duration_ratio", F.col("clipped_duration") / F.col("duration"))


def window_heatwave_metrics_by_join(clipped: DataFrame, keys=("city",)) -> DataFrame:
    """Heat-wave metrics of each window and definition that has an event, from a row for each overlap: the plain twin of
    event_ranges.window_event_metrics."""
    load = F.sum(F.col("degree_days") * F.col("duration_ratio"))
    apparent = F.col("hw_def").startswith("apparent_")
    return clipped.groupBy(*keys, *SPAN, "hw_def").agg(
        F.count(F.lit(1)).cast("int").alias("hw_count"), F.avg("mean_excess").alias("hw_mean_excess"), F.max("mean_excess").alias("hw_max_excess"),
        F.sum("clipped_duration").cast("int").alias("hw_total_days"), F.avg("clipped_duration").alias("hw_mean_duration"), load.alias("hw_degree_days"),
        F.avg("mean_humidity").alias("hw_mean_humidity"), F.sum(F.when(apparent, F.col("degree_days") * F.col("duration_ratio"))).alias("hw_apparent_excess"),
    )


def precip_climatology(daily: DataFrame, keys=("city",)) -> DataFrame:
    return daily.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg("precip_total").alias("clim_precip"))


def precip_deficit_by_join(clipped: DataFrame, daily: DataFrame, keys=("city",)) -> DataFrame:
    """Mean precipitation of a window's heat-wave days less the mean climatology over their days of the year, from a row for
    each of these days: the plain twin of event_ranges.window_event_metrics. A first grouping by day of the year makes both
    means from one pass, as a definition's days are disjoint."""
    days = clipped.select(*keys, *SPAN, "hw_def", F.explode(F.sequence("clipped_start", "clipped_end")).alias("date"))
    rain = days.join(daily.select(*keys, "date", "precip_total"), [*keys, "date"])
    per_doy = rain.groupBy(*keys, *SPAN, "hw_def", F.dayofyear("date").alias("doy")).agg(F.sum("precip_total").alias("s"), F.count("precip_total").alias("n"))
    both = per_doy.join(precip_climatology(daily, keys), [*keys, "doy"], "left")
    return both.groupBy(*keys, *SPAN, "hw_def").agg((F.try_divide(F.sum("s"), F.nullif(F.sum("n"), F.lit(0))) - F.avg("clim_precip")).alias("precip_deficit"))


def exposure_scaffold(windows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every window with every definition. Definitions are a short fixed list, which goes along as an array."""
    names = [r["hw_def"] for r in definitions.select("hw_def").collect()]  # a parameter, not data
    return windows.withColumn("hw_def", F.explode(F.array(*map(F.lit, names))))


def exposure_components(windows: DataFrame, daily: DataFrame, events: DataFrame, definitions: DataFrame, keys=("city",), metrics: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """All exposure metrics per person, window and definition. Windows that are no proper span have null metrics; proper
    ones without an event have count and days 0 and null metrics. A span's metrics are joined as one map by definition, so persons' windows
    are shuffled before they are repeated for each definition, never after. metrics: only these of the heat waves, without the general
    climate. digits: the metrics' doubles are rounded, once for each span rather than for each person and definition."""
    on = [*keys, *SPAN]
    found = event_ranges.window_event_metrics(windows, daily, events, keys, deficit=metrics is None or "precip_deficit" in metrics)
    names = metrics or [c for c in found.columns if c not in (*on, "hw_def")]
    told = lambda df, c: (F.round(c, digits) + F.lit(0.0)).alias(c) if digits is not None and df.schema[c].dataType.simpleString() == "double" else F.col(c)
    held = found.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("hw_def", F.struct(*[told(found, c) for c in names])))).alias("__metrics"))
    out = windows
    if metrics is None:
        climate = window_climate(windows, daily, keys)
        out = out.join(climate.select(*[c if c in on else told(climate, c) for c in climate.columns]), on, "left")
    out = out.join(held, on, "left")
    out = exposure_scaffold(out, definitions).withColumn("__own", F.try_element_at("__metrics", F.col("hw_def")))
    out = out.withColumns({c: F.col(f"__own.{c}") for c in names}).drop("__metrics", "__own")
    proper = F.col("window_end").isNotNull() & F.col("window_start").isNotNull() & (F.col("window_end") >= F.col("window_start"))
    zero = {c: F.when(proper, F.coalesce(F.col(c), F.lit(0))) for c in ("hw_count", "hw_total_days") if c in names}
    return out.withColumns(zero)
