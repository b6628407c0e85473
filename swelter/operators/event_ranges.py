"""Heat-wave metrics of date windows by range queries over events.

Events of one station and definition are disjoint and in order, so those that meet a window are a range i..j of them: i is the first
that ends at or after the window's start, j the last that starts by its end. Both come from one lookup by date. Counts and sums of the
range are differences of running sums, and what lies outside the window is clipped from the first and the last event alone. The largest mean excess and the set of days of the year
come from doubling tables: for each event the maximum, and the union, over 1, 2, 4, ... events up to it and from it on, two of which cover any range.

A set of days of the year is seven longs of 60 bits each. The set of a range of dates is written down from its ends, and a window's mean climatology is
a sum over its set's groups of four bits, each looked up in the station's table of the sums of all 16 subsets.

So a window costs a row for each definition that it meets, however many events or days it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.sources import shared

SPAN = ["window_start", "window_end"]
#: Longs of a set of days of the year, and bits that each holds.
WORDS, BITS = 7, 60
_E = ["start", "end", "duration", "mean_excess", "degree_days", "mean_humidity"]
#: Running sums over events: name and SQL of the term.
_SUMS = {
    "days": "duration", "load": "coalesce(degree_days, 0D)", "excess": "coalesce(mean_excess, 0D)", "n_excess": "CAST(mean_excess IS NOT NULL AS LONG)",
    "humid": "coalesce(mean_humidity, 0D)", "n_humid": "CAST(mean_humidity IS NOT NULL AS LONG)", "rain": "rain", "n_rain": "n_rain",
}


def _interval(p: str, q: str, k: int) -> str:
    """SQL: word k of the set of days p..q of the year (none if p > q)."""
    lo, hi = f"greatest({p}, {k * BITS + 1})", f"least({q}, {(k + 1) * BITS})"
    return f"CASE WHEN {lo} <= {hi} THEN shiftleft(shiftleft(1L, {hi} - {lo} + 1) - 1L, {lo} - {k * BITS + 1}) ELSE 0L END"


def days_of_year(a: str, b: str) -> Column:
    """The set of days of the year of the dates a..b (SQL names), as an array of longs; empty if a > b or one is null."""
    same, years = f"year({a}) = year({b})", f"year({b}) - year({a})"
    last = f"dayofyear(make_date(year({a}), 12, 31))"
    # whole years between the two: one of them has a day 366 if four of them are there or a leap year is
    leap = f"exists(sequence(1, greatest(1, least({years} - 1, 8))), k -> dayofyear(make_date(year({a}) + k, 12, 31)) = 366)"
    words = []
    for k in range(WORDS):
        one = _interval(f"dayofyear({a})", f"dayofyear({b})", k)
        two = f"({_interval(f'dayofyear({a})', last, k)}) | ({_interval('1', f'dayofyear({b})', k)})"
        whole = f"CASE WHEN {years} >= 2 THEN {_interval('1', f'CASE WHEN {leap} THEN 366 ELSE 365 END', k)} ELSE 0L END"
        words.append(f"CASE WHEN {a} > {b} OR {a} IS NULL OR {b} IS NULL THEN 0L WHEN {same} THEN {one} ELSE ({two}) | ({whole}) END")
    return F.expr(f"array({', '.join(words)})")


def _union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def running_rain(daily: DataFrame, keys) -> DataFrame:
    """keys, date, rain_upto and n_rain_upto: the station's rain, and days with a value, up to each day."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "date", F.sum(F.coalesce(F.col("precip_total").cast("double"), F.lit(0.0))).over(w).alias("rain_upto"), F.sum(F.when(F.col("precip_total").isNotNull(), 1).otherwise(0)).over(w).alias("n_rain_upto"))


def _at(rows: DataFrame, rain: DataFrame, keys, date: Column, name: str) -> DataFrame:
    """rows with the rain up to a date (nothing where the series doesn't have it)."""
    right = rain.select(*keys, F.col("date").alias("__on"), F.col("rain_upto").alias(f"{name}_rain"), F.col("n_rain_upto").alias(f"{name}_n_rain"))
    return rows.withColumn("__on", date).join(right, [*keys, "__on"], "left").drop("__on").withColumns({f"{name}_{c}": F.coalesce(f"{name}_{c}", F.lit(0)) for c in ("rain", "n_rain")})


def event_table(events: DataFrame, rain: DataFrame, keys) -> DataFrame:
    """A written table, a row an event: place (from 1, by keys and hw_def), the station's rain up to the day before it (lo_*) and to its end (hi_*), running sums upto_* (with the event), tables `back` (the last 1, 2, 4, ... events up to it) and
    `ahead` (from it on) of (excess, set), next_ahead and last_back (those of its neighbours)."""
    own = shared.written(events.where(F.col("end") >= F.col("start")).select(*keys, "hw_def", *_E), "events")
    most = own.groupBy(*keys, "hw_def").count().agg(F.max("count")).first()[0] or 1
    rows = _at(_at(own, rain, keys, F.col("end"), "hi"), rain, keys, F.date_sub("start", 1), "lo")
    rows = rows.withColumns({"rain": F.col("hi_rain") - F.col("lo_rain"), "n_rain": F.col("hi_n_rain") - F.col("lo_n_rain")})
    w = Window.partitionBy(*keys, "hw_def").orderBy("start")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"place": F.row_number().over(w)} | {f"upto_{n}": F.sum(F.expr(t)).over(upto) for n, t in _SUMS.items()})
    rows = rows.withColumn("b0", F.struct(F.col("mean_excess").alias("excess"), days_of_year("`start`", "`end`").alias("set")))
    levels = max(1, int(most).bit_length())
    for k in range(1, levels):
        far, near = F.lag(f"b{k - 1}", 1 << (k - 1)).over(w), F.col(f"b{k - 1}")
        rows = rows.withColumn("__far", far)
        both = F.struct(F.greatest(near["excess"], F.col("__far.excess")).alias("excess"), _union(near["set"], F.col("__far.set")).alias("set"))
        rows = rows.withColumn(f"b{k}", F.when(F.col("__far").isNotNull(), both)).drop("__far")
    rows = rows.withColumns({"back": F.array(*[f"b{k}" for k in range(levels)]), "ahead": F.array(*[F.lead(f"b{k}", (1 << k) - 1).over(w) if k else F.col("b0") for k in range(levels)])})
    rows = rows.withColumns({"next_ahead": F.lead("ahead", 1).over(w), "last_back": F.lag("back", 1).over(w), "next_start": F.lead("start", 1).over(w), "last_end": F.lag("end", 1).over(w)})
    return shared.written(rows.drop(*[f"b{k}" for k in range(levels)]), "event-table")


def _subset_sums(daily: DataFrame, keys) -> DataFrame:
    """keys, sums (of the mean rain of the days of the year, for each group of four bits and each subset), known (the set of days that have one)."""
    by_day = daily.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg("precip_total").alias("mean")).where("mean IS NOT NULL")
    held = by_day.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("doy", "mean"))).alias("of"))
    value = lambda d: F.coalesce(F.try_element_at("of", d), F.lit(0.0))
    bit = lambda g, s, b: F.when(s.bitwiseAND(1 << b) != 0, value(g * 4 + b + 1)).otherwise(0.0)
    four = lambda g, s: bit(g, s, 0) + bit(g, s, 1) + bit(g, s, 2) + bit(g, s, 3)
    groups = F.sequence(F.lit(0), F.lit(WORDS * BITS // 4 - 1))
    sums = F.flatten(F.transform(groups, lambda g: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: four(g, s))))
    known = F.array(*[F.aggregate(F.map_keys("of"), F.lit(0).cast("long"), _add_bit(k)) for k in range(WORDS)])
    return held.select(*keys, sums.alias("sums"), known.alias("known"))


def _add_bit(k: int):
    def add(held: Column, d: Column) -> Column:
        bit = d - 1 - k * BITS
        power = F.pow(F.lit(2.0), bit.cast("double")).cast("long")
        return F.when((bit >= 0) & (bit < BITS), held.bitwiseOR(power)).otherwise(held)

    return add


def _mean_of_set(days: Column) -> Column:
    """Mean of the station's climatology (sums, known) over a set of days of the year."""
    per = BITS // 4

    def word(held: Column, k: Column) -> Column:
        bits = F.element_at(days, k + 1)
        step = lambda h, g: h + F.element_at("sums", ((k * per + g) * 16 + F.call_function("shiftrightunsigned", bits, g * 4).bitwiseAND(15) + 1).cast("int"))
        return F.when(bits == 0, held).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(per - 1)), held, step))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(WORDS - 1)), F.lit(0.0), word)
    n = F.aggregate(F.zip_with(days, "known", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda h, x: h + x)
    return F.try_divide(total, F.nullif(n, F.lit(0)))


def window_event_metrics(windows: DataFrame, daily: DataFrame, events: DataFrame, keys=("city",), deficit: bool = True) -> DataFrame:
    """keys, window_start, window_end, hw_def and the heat-wave metrics, with precip_deficit if asked for, of every distinct proper window and definition that meet.
    Events of a definition must not overlap, and their days be in the daily series."""
    keys = list(keys)
    rain = shared.written(running_rain(daily, keys), "rain")
    table = event_table(events, rain, keys)
    ends = table.groupBy(*keys).agg(F.date_sub(F.min("start"), 1).alias("__lo"), F.max("end").alias("__hi"))
    ranged = table.join(ends, keys)
    last_started = ranged.select(*keys, "hw_def", F.col("place").alias("j"), F.explode(F.sequence("start", F.coalesce(F.date_sub("next_start", 1), "__hi"))).alias("__we"))
    first_open = ranged.where(F.coalesce("last_end", "__lo") < F.col("end")).select(*keys, "hw_def", F.col("place").alias("i"), F.explode(F.sequence(F.coalesce("last_end", "__lo"), F.date_sub("end", 1))).alias("__ws"))
    spans = windows.select(*keys, *SPAN).where("window_end >= window_start").distinct().join(ends, keys)
    spans = spans.where((F.col("window_end") > F.col("__lo")) & (F.col("window_start") <= F.col("__hi")))
    spans = spans.withColumns({"__we": F.least("window_end", "__hi"), "__ws": F.greatest(F.date_sub("window_start", 1), "__lo")}).drop("__lo", "__hi")
    if deficit:
        spans = _at(_at(spans, rain, keys, F.date_sub("window_start", 1), "before"), rain, keys, F.col("window_end"), "until")
    met = spans.join(last_started, [*keys, "__we"]).join(first_open, [*keys, "hw_def", "__ws"]).where("j >= i").drop("__we", "__ws")
    used = [*_E, *[f"upto_{n}" for n in _SUMS], "rain", "n_rain", "lo_rain", "lo_n_rain", "hi_rain", "hi_n_rain"]
    side = lambda name, more: table.select(*keys, "hw_def", F.col("place").alias(name), F.struct(*used, *more).alias(name * 2))
    both = met.join(side("i", ["ahead", "next_ahead"]), [*keys, "hw_def", "i"]).join(side("j", ["back", "last_back"]), [*keys, "hw_def", "j"])
    i, j, n = F.col("ii"), F.col("jj"), F.col("j") - F.col("i") + 1
    both = both.withColumns({
        "n": n, "cut_i": F.greatest(F.lit(0), F.datediff("window_start", i["start"])), "cut_j": F.greatest(F.lit(0), F.datediff(j["end"], "window_end")), "level": F.floor(F.log2(n.cast("double")) + 1e-9).cast("int"),
    })
    total = lambda s, term: j[f"upto_{s}"] - i[f"upto_{s}"] + term
    days = total("days", i["duration"]) - F.col("cut_i") - F.col("cut_j")
    share = lambda e, cut: F.coalesce(e["degree_days"], F.lit(0.0)) * F.col(cut) / e["duration"]
    load = total("load", F.coalesce(i["degree_days"], F.lit(0.0))) - share(i, "cut_i") - share(j, "cut_j")
    mean = lambda s, c: F.try_divide(total(s, F.coalesce(i[c], F.lit(0.0))), F.nullif(total(f"n_{s}", i[c].isNotNull().cast("long")), F.lit(0)))
    at = lambda t, k: F.get(t, k)
    out = {
        "hw_count": F.col("n").cast("int"), "hw_mean_excess": mean("excess", "mean_excess"), "hw_max_excess": F.greatest(at(i["ahead"], F.col("level"))["excess"], at(j["back"], F.col("level"))["excess"]),
        "hw_total_days": days.cast("int"), "hw_mean_duration": days / F.col("n"), "hw_degree_days": load, "hw_mean_humidity": mean("humid", "mean_humidity"),
        "hw_apparent_excess": F.when(F.col("hw_def").startswith("apparent_"), load),
    }
    names = [*keys, *SPAN, "hw_def"]
    if not deficit:
        return both.select(*names, *[c.alias(k) for k, c in out.items()])
    # the first and the last event within the window, and the events between them whole
    for e in "ij":
        both = both.withColumns({f"__{e}_lo": F.greatest("window_start", F.col(f"{e}{e}.start")), f"__{e}_hi": F.least("window_end", F.col(f"{e}{e}.end"))})
    inner = F.floor(F.log2(F.greatest(F.col("n") - 2, F.lit(1)).cast("double")) + 1e-9).cast("int")
    between = F.when(F.col("n") > 2, _union(at(i["next_ahead"], inner)["set"], at(j["last_back"], inner)["set"])).otherwise(F.array(*[F.lit(0).cast("long")] * WORDS))
    days_set = _union(_union(days_of_year("__i_lo", "__i_hi"), days_of_year("__j_lo", "__j_hi")), between)
    first = {s: F.when(F.col("cut_i") > 0, F.col(f"before_{s}") - i[f"lo_{s}"]).otherwise(0) for s in ("rain", "n_rain")}
    last = {s: F.when(F.col("cut_j") > 0, j[f"hi_{s}"] - F.col(f"until_{s}")).otherwise(0) for s in ("rain", "n_rain")}
    fallen = {s: total(s, i[s]) - first[s] - last[s] for s in ("rain", "n_rain")}
    told = both.select(*names, *[c.alias(k) for k, c in out.items()], days_set.alias("__set"), F.try_divide(fallen["rain"], F.nullif(fallen["n_rain"], F.lit(0))).alias("__rain"))
    climate = _subset_sums(daily, keys)
    told = told.join(climate, keys, "left").withColumn("precip_deficit", F.col("__rain") - _mean_of_set(F.col("__set")))
    return told.drop("__set", "__rain", "sums", "known")
