"""Heat-wave events: runs of days over a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C

DURATIONS = (2, 3, 5)
#: Days of a chunk of a series, in which runs are found first.
CHUNK_DAYS = 3653


def runs_of_true(df: DataFrame, flag: str, keys, date: str = "date") -> DataFrame:
    """The rows where flag is true, with run: equal for days that follow each other. Null is false."""
    true = df.where(F.coalesce(F.col(flag), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    return true.withColumn("run", F.unix_date(date) - rank)


def run_table(df: DataFrame, flag: str, keys, least: int = 1, date: str = "date") -> DataFrame:
    """keys, start, end, duration of every maximal run of at least `least` days."""
    out = runs_of_true(df, flag, keys, date).groupBy(*keys, "run").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).cast("int").alias("duration"))
    return out.where(F.col("duration") >= least).drop("run")


def runs_in_chunks(df: DataFrame, flag: str, keys, most: dict[str, str], mean: dict[str, str], total: dict[str, str], date: str = "date", chunk_days: int | None = None) -> DataFrame:
    """keys, start, end, duration of every maximal run of days where flag is true, with maxima, means and sums of columns over its days (name -> column).

    A series is cut into chunks of chunk_days, and runs are found and summed up within each. Only runs that touch a chunk's first
    or last day can go on in a neighbour: those, at most two a chunk, are put together where one begins on the day after another's end. So no
    task needs a whole series, and new days touch the last chunk and its seam."""
    days, keys = chunk_days or CHUNK_DAYS, list(keys)
    true = df.where(F.coalesce(F.col(flag), F.lit(False))).withColumn("__chunk", F.floor(F.unix_date(date) / days))
    rank = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(date))
    sums = {f"__s_{n}": c for n, c in (mean | total).items()}
    part = true.withColumn("__run", F.unix_date(date) - rank).groupBy(*keys, "__chunk", "__run").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("duration"), *[F.max(c).alias(n) for n, c in most.items()],
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.count(c).alias(f"__n_{n}") for n, c in mean.items()],
    )
    first = F.col("__chunk") * days
    edge = (F.unix_date("start") == first) | (F.unix_date("end") == first + days - 1)
    columns = ["start", "end", "duration", *most, *sums, *[f"__n_{n}" for n in mean]]
    at_edge = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.date_add(F.lag("end").over(at_edge), 1) == F.col("start"), 0).otherwise(1)
    seams = part.where(edge).withColumn("__new", new).withColumn("__run", F.sum("__new").over(at_edge)).groupBy(*keys, "__run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("duration").alias("duration"), *[F.max(n).alias(n) for n in most], *[F.sum(n).alias(n) for n in [*sums, *[f"__n_{n}" for n in mean]]]
    )
    both = part.where(~edge).select(*keys, *columns).unionByName(seams.select(*keys, *columns))
    means = [F.try_divide(F.col(f"__s_{n}"), F.nullif(F.col(f"__n_{n}"), F.lit(0))).alias(n) for n in mean]
    return both.select(*keys, "start", "end", F.col("duration").cast("int").alias("duration"), *most, *means, *[F.col(f"__s_{n}").alias(n) for n in total])


def heatwave_events(daily: DataFrame, thr: DataFrame, metrics: dict[str, str], durations=DURATIONS, keys=("city",)) -> DataFrame:
    """Events of every definition (metric, percentile, shortest duration): start, end, duration, hw_def, peaks, excess,
    degree days, mean humidity and precipitation. Runs are found once per metric and percentile; the shortest
    durations are a filter on them."""
    values = F.create_map(*[x for m, c in metrics.items() for x in (F.lit(m), F.col(c).cast("double"))])
    on = [*keys, *(["doy"] if "doy" in thr.columns else [])]
    days = daily.select(*keys, "date", "tmax_daily", "apparent_temp", "humidity_mean", "precip_total", values.alias("values"), *([F.dayofyear("date").alias("doy")] if "doy" in on else []))
    days = days.join(thr, on).withColumn("value", F.try_element_at("values", F.col("metric")))
    days = days.withColumn("over", C.is_over(F.col("value"), F.col("threshold"))).withColumn("excess", F.col("value") - F.col("threshold"))
    found = runs_in_chunks(
        days, "over", [*keys, "metric", "percent"], {"peak_temp": "tmax_daily", "peak_apparent": "apparent_temp"},
        {"mean_excess": "excess", "mean_humidity": "humidity_mean", "mean_precip": "precip_total"}, {"degree_days": "excess"},
    )
    found = found.withColumn("days", F.explode(F.array(*map(F.lit, durations)))).where(F.col("duration") >= F.col("days"))
    return found.withColumn("hw_def", C.hw_label(F.col("metric"), F.col("percent"), F.col("days"))).drop("metric", "percent", "days")


def hw_definitions(spark, metrics=("tmax", "apparent"), percents=(90.0, 92.5, 95.0), durations=DURATIONS) -> DataFrame:
    """hw_def, metric, percent, days of every definition, in order."""
    rows = [(m, float(p), d) for m in metrics for p in percents for d in durations]
    df = spark.createDataFrame(rows, "metric string, percent double, days int")
    return df.withColumn("hw_def", C.hw_label(F.col("metric"), F.col("percent"), F.col("days")))


def union_of_definitions(*tables: DataFrame) -> DataFrame:
    """hw_def of every definition that one of the tables has, once."""
    out = tables[0].select("hw_def")
    for t in tables[1:]:
        out = out.union(t.select("hw_def"))
    return out.distinct()


def event_counts(events: DataFrame, keys=("city",)) -> DataFrame:
    return events.groupBy(*keys, "hw_def").agg(F.count(F.lit(1)).alias("n_events"), F.sum("duration").alias("n_days"))


def expand_events(events: DataFrame, keys=("city",)) -> DataFrame:
    """keys and date of every day in an event, once."""
    days = events.where(F.col("end") >= F.col("start")).select(*keys, F.explode(F.sequence("start", "end")).alias("date"))
    return days.distinct()


def flag_event_days(daily: DataFrame, events: DataFrame, keys=("city",), name: str = "hw_day") -> DataFrame:
    """daily with a flag: the day is in one of the events."""
    days = expand_events(events, keys).withColumn("__hit", F.lit(True))
    return daily.join(days, [*keys, "date"], "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def enrich_events(events: DataFrame, daily: DataFrame, keys=("city",)) -> DataFrame:
    """Peaks and means over each event's days, for events that come from elsewhere. Each event is expanded to its
    days, so the join is an equality on station and date."""
    days = events.where(F.col("end") >= F.col("start")).withColumn("date", F.explode(F.sequence("start", "end")))
    return days.join(daily, [*keys, "date"]).groupBy(*events.columns).agg(
        F.max("tmax_daily").alias("peak_temp"), F.max("apparent_temp").alias("peak_apparent"), F.avg("humidity_mean").alias("mean_humidity"), F.avg("precip_total").alias("mean_precip")
    )


def primary_definition(events: DataFrame, wanted: str = "tmax_p90_d3") -> DataFrame:
    """The events of the wanted definition; without it of the first that contains tmax_p90; else of the first."""
    rank = F.when(F.col("hw_def") == wanted, 0).when(F.col("hw_def").contains("tmax_p90"), 1).otherwise(2)
    best = events.agg(F.min(F.struct(rank.alias("r"), "hw_def")).alias("b")).select(F.col("b.hw_def").alias("hw_def"))
    return events.join(F.broadcast(best), "hw_def", "left_semi")
