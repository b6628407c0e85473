"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import analytical, clean, cohort, event_ranges, events, exposure, features, index, pca, thresholds, trend
from swelter.plans import adapters as A
from swelter.sources import shared, stations

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_QC = {c: "CASE WHEN " + " AND ".join([f"{c} >= {lo}"] * (lo is not None) + [f"{c} <= {hi}"] * (hi is not None)) + f" THEN {c} END" for c, (lo, hi) in C.QC_LIMITS.items()}
_R = f"r0 AS ({A.READINGS}), r AS (SELECT city, date, hour_utc, dewpoint_c, dewpoint_max_c, dewpoint_min_c, " + ", ".join(f"{x} AS {c}" for c, x in _QC.items()) + " FROM r0)"
_AGG = {"avg": "avg", "max": "max", "min": "min", "stddev_samp": "stddev_samp", "sum": "sum"}
_D = (
    _R + ", d AS (SELECT city, date, "
    + ", ".join((f"coalesce(sum({s}), 0)" if how == "sum" else f"{_AGG[how]}({s})") + f" AS {n}" for n, s, how in clean.DAILY)
    + ", count(*) AS n_obs, count(tmax_c) AS n_tmax_valid FROM r GROUP BY city, date)"
)
_CAL = "SELECT city, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT city, min(date) AS lo, max(date) AS hi FROM {0} GROUP BY city)"
_AT = "-2.7 + 1.04 * tmax_daily + 2.0 * (humidity_mean / 100 * 6.105 * exp(17.27 * tmax_daily / (237.7 + tmax_daily)) / 10) - 0.65 * wind_mean"


def _filled(source: str, columns: list[str]) -> str:
    """f: source on a complete calendar with long_gap and short gaps of columns interpolated."""
    w = "(PARTITION BY city ORDER BY date ROWS BETWEEN {0})"
    back, on = w.format("UNBOUNDED PRECEDING AND CURRENT ROW"), w.format("CURRENT ROW AND UNBOUNDED FOLLOWING")
    line = "CASE WHEN n_obs IS NULL AND NOT long_gap THEN p_{0} + (n_{0} - p_{0}) * (date - pd_{0}) / (nd_{0} - pd_{0}) ELSE {0} END AS {0}"
    near = "last_value({0} IGNORE NULLS) OVER " + back + " AS p_{0}, first_value({0} IGNORE NULLS) OVER " + on + " AS n_{0}, " \
        "last_value(CASE WHEN {0} IS NOT NULL THEN date END IGNORE NULLS) OVER " + back + " AS pd_{0}, first_value(CASE WHEN {0} IS NOT NULL THEN date END IGNORE NULLS) OVER " + on + " AS nd_{0}"  # fmt: skip
    extra = ", n_tmax_valid" if source == "d" else ""
    return (
        f"c0 AS ({_CAL.format(source)}), c1 AS (SELECT c0.city, c0.date, {', '.join(columns)}, n_obs{extra} FROM c0 LEFT JOIN {source} s ON c0.city = s.city AND c0.date = s.date), "
        "c2 AS (SELECT *, count(n_obs) OVER (PARTITION BY city ORDER BY date) AS seen FROM c1), "
        "c3 AS (SELECT *, n_obs IS NULL AND count(*) FILTER (WHERE n_obs IS NULL) OVER (PARTITION BY city, seen) > 3 AS long_gap FROM c2), "
        f"c4 AS (SELECT *, {', '.join(near.format(c) for c in columns)} FROM c3), "
        f"f AS (SELECT city, date, {', '.join(line.format(c) for c in columns)}, coalesce(n_obs, 0) AS n_obs{extra}, long_gap FROM c4)"
    )


_F = _D + ", " + _filled("d", clean.MEASURES) + f", fd AS (SELECT *, {_AT} AS apparent_temp FROM f)"
_THR = "thr AS (SELECT city, " + ", ".join(f"quantile_cont({c}, {p / 100}) AS {m}_{str(p).replace('.', '_')}" for m, c in (("tmax", "tmax_daily"), ("apparent", "apparent_temp")) for p in (90.0, 92.5, 95.0)) + " FROM fd GROUP BY city)"
_X = _F + ", " + _THR + """, x AS (SELECT fd.*, tmax_daily - tmin_daily AS dtr, dewpoint_max_daily - dewpoint_min_daily AS dewpoint_range_daily, pressure_max - pressure_min AS pressure_range_daily,
 tmax_90_0 AS thr_p90, coalesce(tmax_daily > tmax_90_0, FALSE) AS above_p90, coalesce(tmax_daily > tmax_95_0, FALSE) AS above_p95,
 greatest(tmax_daily - tmax_90_0, 0) AS excess_p90, greatest(tmax_daily - tmax_95_0, 0) AS excess_p95 FROM fd JOIN thr ON fd.city = thr.city)"""
_DEFS = [(m, c, p) for m, c in (("tmax", "tmax_daily"), ("apparent", "apparent_temp")) for p in (90.0, 92.5, 95.0)]
_E = _X + ", o AS (" + " UNION ALL ".join(
    f"SELECT fd.city, date, tmax_daily, apparent_temp, humidity_mean, precip_total, '{m}_p{f'{p:g}'.replace('.', '')}' AS def, {c} - {m}_{str(p).replace('.', '_')} AS excess FROM fd JOIN thr ON fd.city = thr.city WHERE {c} > {m}_{str(p).replace('.', '_')}"
    for m, c, p in _DEFS) + """), o2 AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY city, def ORDER BY date) AS INTEGER) AS run FROM o),
 o3 AS (SELECT city, def, min(date) AS "start", max(date) AS "end", count(*) AS duration, max(tmax_daily) AS peak_temp, max(apparent_temp) AS peak_apparent, avg(excess) AS mean_excess,
  sum(excess) AS degree_days, avg(humidity_mean) AS mean_humidity, avg(precip_total) AS mean_precip FROM o2 GROUP BY city, def, run),
 e AS (SELECT o3.* EXCLUDE (def), def || '_d' || k AS hw_def FROM o3, (SELECT unnest([2, 3, 5]) AS k) WHERE duration >= k)"""  # fmt: skip
_H = _E + ", hd AS (SELECT x.*, EXISTS (SELECT 1 FROM e WHERE hw_def = 'tmax_p90_d2' AND e.city = x.city AND x.date BETWEEN e.\"start\" AND e.\"end\") AS hw_day FROM x)"
_B = f"""co AS ({A.COHORT}), est AS (SELECT *, d_date - CAST(round_even(age * 365.25, 0) AS INTEGER) AS birth FROM co WHERE d_date IS NOT NULL AND age IS NOT NULL),
 last AS (SELECT ext_genid, max(d_date) AS last_assessment FROM co GROUP BY ext_genid),
 b AS (SELECT g.*, year(birth_date) AS birth_year, CASE site WHEN 1 THEN 'A' WHEN 2 THEN 'N' WHEN 3 THEN 'R' END AS city, last_assessment FROM
  (SELECT ext_genid, arg_min(birth, redcap_event_name) AS birth_date, count(*) AS n_estimates, stddev_samp(birth - DATE '1970-01-01') AS birth_date_sd_days,
   arg_min(site, redcap_event_name) AS site, arg_min(gender, redcap_event_name) AS gender FROM est GROUP BY ext_genid) g JOIN last USING (ext_genid))"""
_WIN = _B + ", w AS (" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS \"window\", CAST(birth_date + INTERVAL {a} MONTH AS DATE) AS window_start, CAST(birth_date + INTERVAL {z} MONTH AS DATE) - 1 AS window_end FROM b" for n, a, z in A.MONTH_WINDOWS
) + " UNION ALL SELECT *, 'cumulative', birth_date, last_assessment FROM b)"
_CLIP = """sp AS (SELECT DISTINCT city, window_start, window_end FROM w WHERE window_end >= window_start),
 cl AS (SELECT sp.*, e.* EXCLUDE (city), greatest("start", window_start) AS cs, least("end", window_end) AS ce FROM sp JOIN e ON sp.city = e.city AND "start" <= window_end AND "end" >= window_start),
 cl2 AS (SELECT *, ce - cs + 1 AS cd, (ce - cs + 1) / duration AS ratio FROM cl)"""
_GEN = """gc AS (SELECT sp.city, window_start, window_end, avg(tmax_daily) AS mean_tmax, avg(tmean_daily) AS mean_tmean, count(*) FILTER (WHERE above_p90) AS days_above_p90,
 avg(humidity_mean) AS mean_humidity, coalesce(sum(precip_total), 0) AS total_precip, stddev_samp(tmax_daily) AS tmax_sd FROM sp JOIN x ON sp.city = x.city AND date BETWEEN window_start AND window_end GROUP BY ALL)"""
_HW = """hm AS (SELECT city, window_start, window_end, hw_def, count(*) AS hw_count, avg(mean_excess) AS hw_mean_excess, max(mean_excess) AS hw_max_excess, sum(cd) AS hw_total_days, avg(cd) AS hw_mean_duration,
 sum(degree_days * ratio) AS hw_degree_days, avg(mean_humidity) AS hw_mean_humidity, sum(CASE WHEN hw_def LIKE 'apparent%' THEN degree_days * ratio END) AS hw_apparent_excess FROM cl2 GROUP BY ALL)"""
_PD = """dd AS (SELECT city, window_start, window_end, hw_def, CAST(unnest(generate_series(CAST(cs AS TIMESTAMP), CAST(ce AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM cl2),
 clim AS (SELECT city, dayofyear(date) AS doy, avg(precip_total) AS cp FROM x GROUP BY ALL),
 dp AS (SELECT dd.*, precip_total, dayofyear(dd.date) AS doy FROM dd JOIN x ON dd.city = x.city AND dd.date = x.date),
 pdf AS (SELECT a.city, a.window_start, a.window_end, a.hw_def, m - c AS precip_deficit FROM
  (SELECT city, window_start, window_end, hw_def, avg(precip_total) AS m FROM dp GROUP BY ALL) a JOIN
  (SELECT q.city, window_start, window_end, hw_def, avg(cp) AS c FROM (SELECT DISTINCT city, window_start, window_end, hw_def, doy FROM dp) q JOIN clim ON q.city = clim.city AND q.doy = clim.doy GROUP BY ALL) z
  ON a.city = z.city AND a.window_start = z.window_start AND a.window_end = z.window_end AND a.hw_def = z.hw_def)"""
_DEFNAMES = "[" + ", ".join(f"'{m}_p{f'{p:g}'.replace('.', '')}_d{k}'" for m, _, p in _DEFS for k in (2, 3, 5)) + "]"
_COV = """ends AS (SELECT city, min(date) AS lo, max(date) AS hi FROM x GROUP BY city),
 cv AS (SELECT w.*, CASE WHEN window_end >= window_start AND lo IS NOT NULL THEN greatest(0, least(window_end, hi) - greatest(window_start, lo) + 1) / (window_end - window_start + 1) ELSE 0.0 END AS coverage_frac FROM w LEFT JOIN ends ON w.city = ends.city)"""
_COMP = f"""{_CLIP}, {_GEN}, {_HW}, {_PD}, {_COV}, sc AS (SELECT cv.*, unnest({_DEFNAMES}) AS hw_def FROM cv),
 comp AS (SELECT sc.*, mean_tmax, mean_tmean, days_above_p90, gc.mean_humidity AS mean_humidity, total_precip, tmax_sd, hw_mean_excess, hw_max_excess, hw_mean_duration, hw_degree_days, hw_mean_humidity, hw_apparent_excess, precip_deficit,
  CASE WHEN sc.window_end >= sc.window_start THEN coalesce(hw_count, 0) END AS hw_count, CASE WHEN sc.window_end >= sc.window_start THEN coalesce(hw_total_days, 0) END AS hw_total_days
  FROM sc LEFT JOIN gc ON sc.city = gc.city AND sc.window_start = gc.window_start AND sc.window_end = gc.window_end
  LEFT JOIN hm ON sc.city = hm.city AND sc.window_start = hm.window_start AND sc.window_end = hm.window_end AND sc.hw_def = hm.hw_def
  LEFT JOIN pdf ON sc.city = pdf.city AND sc.window_start = pdf.window_start AND sc.window_end = pdf.window_end AND sc.hw_def = pdf.hw_def)"""
_ZIN = "zi AS (SELECT * FROM (SELECT ext_genid, \"window\", hw_def, coverage_frac, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in index.METRICS) + ", count(*) OVER g AS gn FROM comp WHERE \"window\" <> '0_5' AND coverage_frac >= 0.5 WINDOW g AS (PARTITION BY \"window\", hw_def)) WHERE gn >= 20), " \
    "zs AS (SELECT ext_genid, \"window\", hw_def, coverage_frac, " + ", ".join(f"CASE WHEN stddev_samp({m}) OVER g > 1e-12 THEN ({m} - avg({m}) OVER g) / stddev_samp({m}) OVER g ELSE 0 END AS z_{m}" for m in index.METRICS) + " FROM zi WINDOW g AS (PARTITION BY \"window\", hw_def))"  # fmt: skip


def _select(spec: str, source: str, ctes: str, where: str = "") -> str:
    """SQL of the columns in spec, separated by blanks: name as it is, name:d a double to 6 digits, name:i a long."""
    out = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        q = f'"{name}"'
        out.append(f"round({q}, 6) + 0.0 AS {q}" if kind == "d" else f"CAST({q} AS BIGINT) AS {q}" if kind == "i" else q)
    return f"WITH {ctes} SELECT {', '.join(out)} FROM {source} {where}"


def _query(name: str, sql: str | None = None, digits: int | None = 6):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: A.rounded(f(spark, sf_dir), digits)
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return add


_METRICS = {"tmax": "tmax_daily", "apparent": "apparent_temp"}


def _exceeding(spark, d) -> DataFrame:
    daily = features.daily_derived(A.full_daily(spark, d))
    return thresholds.exceedance(daily, thresholds.thresholds(daily, {"tmax": "tmax_daily"}), "tmax", "tmax_daily")


def _events(spark, d) -> DataFrame:
    daily = A.full_daily(spark, d)
    return events.heatwave_events(daily, thresholds.thresholds(daily, _METRICS), _METRICS)


def _featured(spark, d) -> DataFrame:
    return events.flag_event_days(_exceeding(spark, d), _events(spark, d).where("hw_def = 'tmax_p90_d2'"))


def _components(spark, d, metrics: list[str] | None = None, digits: int | None = None) -> DataFrame:
    # climate, events, deficit and coverage all read the daily series, so it and the events are made once
    daily = shared.written(_exceeding(spark, d), "daily")
    found = shared.written(events.heatwave_events(daily, thresholds.thresholds(daily, _METRICS), _METRICS), "events")
    windows = cohort.coverage_frac(A.windows(spark, d), daily)
    if digits is not None:
        windows = windows.withColumn("coverage_frac", F.round("coverage_frac", digits) + F.lit(0.0))
    return exposure.exposure_components(windows, daily, found, events.hw_definitions(spark), metrics=metrics, digits=digits)


def _index_components(spark, d) -> DataFrame:
    """What the index reads, written: its columns of the rows that it covers, which are chosen before windows are repeated for each definition."""
    rows = index.covered(_components(spark, d, index.METRICS))
    return shared.written(rows.select("ext_genid", *index.GROUP, "coverage_frac", *index.METRICS), "components")


def flagship(spark, d) -> DataFrame:
    """Readings to events under the tmax, 90th percentile, two-day definition."""
    return _events(spark, d).where("hw_def = 'tmax_p90_d2'")


_MEASURES_D = " ".join(f"{m}:d" for m in clean.MEASURES)


@_query("parse_comma_qc", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(CASE WHEN v BETWEEN -10 AND 50 THEN v END, 6) + 0.0 AS tmax_c, CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) END AS date
 FROM (SELECT *, CASE WHEN l_linenumber % 5 IN (0, 1) OR l_linenumber = 4 THEN NULL ELSE l_extendedprice / 1000 END AS v FROM lineitem)""")
def _parse(spark, d):
    """P1 to P3 on numbers written with a comma, missing codes, broken numbers and both date forms."""
    t = A.table(spark, d, "lineitem")
    number = F.regexp_replace((F.col("l_extendedprice") / 1000).cast("string"), r"\.", ",")
    text = F.when(F.col("l_linenumber") % 5 == 0, "-9999").when(F.col("l_linenumber") % 5 == 1, "-9999,0").when(F.col("l_linenumber") == 4, "1,2,3").otherwise(number)
    day = F.when(F.col("l_linenumber") == 7, "x").when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return clean.range_qc(t.select("l_orderkey", "l_linenumber", C.parse_comma_numeric(text).alias("tmax_c"), C.parse_station_date(day).alias("date")), {"tmax_c": (-10, 50)})


@_query("hourly_to_daily", _select(f"city date {_MEASURES_D} n_obs:i n_tmax_valid:i", "d", _D))
def _daily(spark, d):
    return A.daily(spark, d)


@_query("complete_calendar_gaps", _select("city date n_obs:i long_gap", "c3", f"s AS ({A.SERIES}), " + _filled("s", ["v"])))
def _gaps(spark, d):
    return clean.flag_long_gaps(clean.complete_calendar(A.series(spark, d))).select("city", "date", "n_obs", "long_gap")


@_query("interpolate_gaps", _select("city date v:d n_obs:i long_gap", "f", f"s AS ({A.SERIES}), " + _filled("s", ["v"])))
def _interpolated(spark, d):
    return clean.interpolate_gaps(clean.flag_long_gaps(clean.complete_calendar(A.series(spark, d))), ["v"])


@_query("clean_daily", _select(f"city date {_MEASURES_D} n_obs:i n_tmax_valid:i long_gap apparent_temp:d", "fd", _F))
def _clean(spark, d):
    """Calendar, gaps and apparent temperature (P4) of the readings' daily series."""
    return A.full_daily(spark, d)


@_query("threshold_fixed", "WITH " + _F + " " + " UNION ALL ".join(f"SELECT city, '{m}' AS metric, CAST({p} AS DOUBLE) AS percent, round(quantile_cont({c}, {p / 100}), 6) AS threshold FROM fd GROUP BY city" for m, c, p in _DEFS))
def _fixed(spark, d):
    return thresholds.thresholds(A.full_daily(spark, d), _METRICS)


@_query("threshold_seasonal", "WITH " + _F + """, ex AS (SELECT city, tmax_daily, (dayofyear(date) - 1 + k + 366) % 366 + 1 AS doy FROM fd, (SELECT unnest(range(-7, 8)) AS k))
 SELECT city, 'tmax' AS metric, CAST(doy AS BIGINT) AS doy, CAST(90.0 AS DOUBLE) AS percent, round(quantile_cont(tmax_daily, 0.9), 6) AS threshold FROM ex GROUP BY city, doy""")
def _seasonal(spark, d):
    return thresholds.thresholds(A.full_daily(spark, d), {"tmax": "tmax_daily"}, percents=(90.0,), mode="seasonal")


_EV = "city start end duration:i hw_def peak_temp:d peak_apparent:d mean_excess:d degree_days:d mean_humidity:d mean_precip:d"


@_query("heatwave_events", _select(_EV, "e", _E))
def _hw(spark, d):
    """Events of all 18 definitions."""
    return _events(spark, d)


@_query("flagship_tmax_p90_d2", _select(_EV, "e", _E, "WHERE hw_def = 'tmax_p90_d2'"))
def _flag(spark, d):
    return flagship(spark, d)


@_query("event_counts", "WITH " + _E + " SELECT city, hw_def, count(*) AS n_events, CAST(sum(duration) AS BIGINT) AS n_days FROM e GROUP BY city, hw_def")
def _counts(spark, d):
    return events.event_counts(_events(spark, d))


@_query("enrich_events", "WITH " + _E + """ SELECT e.city, e."start", e."end", CAST(duration AS BIGINT) AS duration, hw_def, round(max(tmax_daily), 6) AS peak_temp, round(max(apparent_temp), 6) AS peak_apparent,
 round(avg(humidity_mean), 6) AS mean_humidity, round(avg(precip_total), 6) + 0.0 AS mean_precip FROM e JOIN fd ON e.city = fd.city AND date BETWEEN "start" AND "end" GROUP BY e.city, e."start", e."end", duration, hw_def""")
def _enriched(spark, d):
    return events.enrich_events(_events(spark, d).select("city", "start", "end", "duration", "hw_def"), A.full_daily(spark, d))


@_query("primary_definition", _select("city start end hw_def", "e", _E, "WHERE hw_def = 'tmax_p90_d2'"))
def _primary(spark, d):
    """No event lasts five days or more above the 99th percentile, so the fallback is taken."""
    return events.primary_definition(_events(spark, d), "tmax_p99_d5").select("city", "start", "end", "hw_def")


@_query("parse_hw_def", "WITH " + _E + """ SELECT DISTINCT hw_def, split_part(hw_def, '_', 1) AS metric, CASE WHEN hw_def LIKE '%p925%' THEN '92.5th' WHEN hw_def LIKE '%p95%' THEN '95th' ELSE '90th' END AS threshold,
 '≥' || right(hw_def, 1) || 'd' AS duration FROM e""")
def _parsed(spark, d):
    return _events(spark, d).select("hw_def").distinct().withColumn("p", C.parsed_label(F.col("hw_def"))).select("hw_def", "p.metric", "p.threshold", "p.duration")


@_query("flag_event_days", _select("city date above_p90 excess_p90:d excess_p95:d hw_day", "hd", _H))
def _flagged(spark, d):
    return _featured(spark, d).select("city", "date", "above_p90", "excess_p90", "excess_p95", "hw_day")


_MSQL = {"avg": "avg", "max": "max", "min": "min", "stddev_samp": "stddev_samp"}


@_query("monthly_features", "WITH " + _H + " SELECT city, CAST(year(date) AS BIGINT) AS yr, CAST(month(date) AS BIGINT) AS mo, strftime(date, '%Y-%m') AS yr_mo, count(*) AS n_days, count(*) FILTER (WHERE long_gap) AS n_long_gap, round(avg(n_obs), 6) AS n_obs_mean, "
        + ", ".join(f"round({how}({c}), 6) + 0.0 AS {n}" for n, how, c in features.MONTHLY)
        + """, count(*) FILTER (WHERE above_p90) AS days_above_p90, count(*) FILTER (WHERE above_p95) AS days_above_p95, count(*) FILTER (WHERE hw_day) AS hw_days,
 round(coalesce(avg(excess_p90) FILTER (WHERE above_p90), 0), 6) + 0.0 AS mean_excess_p90, round(coalesce(avg(excess_p95) FILTER (WHERE above_p95), 0), 6) + 0.0 AS mean_excess_p95,
 round(sum(excess_p90), 6) + 0.0 AS degree_days_p90, round(sum(excess_p95), 6) + 0.0 AS degree_days_p95, round(coalesce(sum(precip_total), 0), 6) + 0.0 AS total_precip, count(*) FILTER (WHERE precip_total < 1) AS dry_days
 FROM hd GROUP BY city, year(date), month(date), strftime(date, '%Y-%m')""")
def _monthly(spark, d):
    return features.monthly_features(_featured(spark, d))


@_query("zscore_within", "WITH " + _F + ", g AS (SELECT city, avg(tmax_daily) AS a, stddev_samp(tmax_daily) AS b, avg(wind_mean) AS e, stddev_samp(wind_mean) AS h FROM fd GROUP BY city) "
        "SELECT city, date, round((tmax_daily - a) / nullif(b, 0), 6) + 0.0 AS tmax_daily, round((wind_mean - e) / nullif(h, 0), 6) + 0.0 AS wind_mean FROM fd JOIN g USING (city)")
def _z(spark, d):
    return features.zscore_within(A.full_daily(spark, d).select("city", "date", "tmax_daily", "wind_mean"), ["tmax_daily", "wind_mean"])


_ROLL_W = "(PARTITION BY city ORDER BY date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def _roll(n, x):
    return f"CASE WHEN row_number() OVER (PARTITION BY city ORDER BY date) >= {n} THEN {x} OVER {_ROLL_W.format(n - 1)} END"


@_query("rolling_features", "WITH s AS (" + A.SERIES + "), c0 AS (" + _CAL.format("s") + "), c1 AS (SELECT c0.city, c0.date, v, n_obs FROM c0 LEFT JOIN s ON c0.city = s.city AND c0.date = s.date) SELECT city, date, round(v, 6) AS v, CAST(n_obs AS BIGINT) AS n_obs, "
        + ", ".join(f"CAST({_roll(n, 'sum(coalesce(n_obs, 0))')} AS DOUBLE) AS sum_n_obs_{n}d" for n in (3, 7, 14, 30)) + ", "
        + ", ".join(f"round({_roll(n, 'avg(v)')}, 4) AS mean_v_{n}d, round({_roll(n, 'max(v)')}, 4) AS max_v_{n}d" for n in (7, 14, 30)) + ", "
        + ", ".join(f"round(lag(v, {k}) OVER (PARTITION BY city ORDER BY date), 4) AS v_lag{k}" for k in (1, 3, 7, 14)) + " FROM c1")
def _rolling(spark, d):
    """W4 to W7 on a calendar with gaps."""
    out = features.rolling_features(clean.complete_calendar(A.series(spark, d)), {"n_obs": (3, 7, 14, 30)}, {"v": (7, 14, 30)}, {"v": (1, 3, 7, 14)})
    return out.withColumns({c: F.round(c, 4) for c in out.columns if "_v_" in c or "_lag" in c})


@_query("heat_calendar", "WITH " + _X + " SELECT city, date, CAST(year(date) AS BIGINT) AS year, CAST(dayofyear(date) AS BIGINT) AS doy, round(CASE WHEN above_p90 THEN excess_p90 END, 6) AS intensity FROM x")
def _calendar(spark, d):
    return features.heat_calendar(_exceeding(spark, d))


@_query("calendar_keys", "WITH " + _D + " SELECT city, date, CAST(year(date) AS BIGINT) AS yr, CAST(month(date) AS BIGINT) AS mo, CAST(dayofyear(date) AS BIGINT) AS doy, strftime(date, '%Y-%m') AS yr_mo, CAST(date_trunc('month', date) AS DATE) AS month_start, "
        "CASE WHEN month(date) IN (12, 1, 2) THEN 'Summer' WHEN month(date) < 6 THEN 'Autumn' WHEN month(date) < 9 THEN 'Winter' ELSE 'Spring' END AS season FROM d")
def _keys(spark, d):
    return features.add_calendar(A.daily(spark, d).select("city", "date"))


@_query("annual_summary", "WITH " + _X + " SELECT city, CAST(year(date) AS BIGINT) AS year, count(excess_p90) AS n, round(avg(excess_p90), 6) AS mean, round(quantile_cont(excess_p90, 0.9), 6) AS p90, round(max(excess_p90), 6) AS max, count(*) FILTER (WHERE excess_p90 > 2) AS n_high FROM x GROUP BY city, year(date)")
def _annual(spark, d):
    return trend.annual_summary(_exceeding(spark, d), "excess_p90")


@_query("head_tail_years", "WITH " + _D + ", y AS (SELECT city, CAST(year(date) AS BIGINT) AS year, count(*) AS n_days FROM d GROUP BY city, year(date)) SELECT city, year, n_days FROM y QUALIFY row_number() OVER (PARTITION BY city ORDER BY year) <= 2 OR row_number() OVER (PARTITION BY city ORDER BY year DESC) <= 2")
def _ends(spark, d):
    return trend.head_tail_by_group(clean.days_per_year(A.daily(spark, d)), "year", 2)


@_query("period_summary", "WITH " + _X + " SELECT city, CAST(CASE WHEN year(date) <= 2014 THEN 1 WHEN year(date) <= 2019 THEN 2 ELSE 3 END AS BIGINT) AS period, count(*) AS n, round(avg(excess_p90), 6) AS mean, round(quantile_cont(excess_p90, 0.9), 6) AS p90, round(max(excess_p90), 6) AS max FROM x WHERE above_p90 GROUP BY 1, 2")
def _period(spark, d):
    return trend.period_summary(_exceeding(spark, d), "excess_p90", "above_p90")


@_query("monthly_component_mean", "WITH " + _D + " SELECT city, CAST(date_trunc('month', date) AS DATE) AS month, round(avg(wind_mean), 6) + 0.0 AS mean FROM d WHERE wind_mean IS NOT NULL GROUP BY 1, 2")
def _month_mean(spark, d):
    return trend.monthly_component_mean(A.daily(spark, d), "wind_mean")


@_query("linear_trend", "WITH " + _D + ", q AS (SELECT city, regr_count(tmax_daily, year(date)) AS n, regr_slope(tmax_daily, year(date)) AS s, regr_sxx(tmax_daily, year(date)) AS xx, regr_sxy(tmax_daily, year(date)) AS xy, regr_syy(tmax_daily, year(date)) AS yy FROM d GROUP BY city) "
        "SELECT city, CAST(n AS BIGINT) AS n, round(s, 6) + 0.0 AS slope, round(sqrt((yy - xy * xy / xx) / (n - 2) / xx), 6) AS se FROM q")
def _slope(spark, d):
    return trend.trend_sums(A.daily(spark, d).withColumn("year", F.year("date")), "tmax_daily", "year")


@_query("linear_trend_test")
def _trend(spark, d):
    """Slopes per ten years with confidence limits and p-values."""
    return trend.linear_trend(A.daily(spark, d).withColumn("year", F.year("date")), "tmax_daily", "year")


@_query("birth_dates", _select("ext_genid:i birth_date n_estimates:i birth_date_sd_days:d site:i gender:i birth_year:i city last_assessment", "b", _B))
def _births(spark, d):
    return A.births(spark, d)


_YEARS = " UNION ALL ".join(
    f"SELECT ext_genid, '{n}' AS \"window\", " + ", ".join(f"CASE WHEN day(birth_date + INTERVAL {k} YEAR) = day(birth_date) THEN CAST(birth_date + INTERVAL {k} YEAR AS DATE) - {less} END AS {c}" for k, less, c in ((a, 0, "window_start"), (z, 1, "window_end"))) + " FROM b"
    for n, a, z in cohort.WINDOWS
)


@_query("developmental_windows", f"WITH {_B} {_YEARS} UNION ALL SELECT ext_genid, 'cumulative', birth_date, last_assessment FROM b")
def _windows(spark, d):
    """Windows in years; a birth on 29 February has null boundaries."""
    return cohort.developmental_windows(A.births(spark, d)).select("ext_genid", "window", "window_start", "window_end")


@_query("coverage_frac", _select("ext_genid:i window window_start window_end coverage_frac:d", "cv", f"{_X}, {_WIN}, {_COV}"))
def _coverage(spark, d):
    return cohort.coverage_frac(A.windows(spark, d), A.full_daily(spark, d)).select("ext_genid", "window", "window_start", "window_end", "coverage_frac")


@_query("coverage_observed", "WITH " + _F + ", " + _WIN + ", sp AS (SELECT DISTINCT city, window_start, window_end FROM w WHERE window_end >= window_start), n AS (SELECT sp.city, window_start, window_end, count(*) AS k FROM sp JOIN fd ON sp.city = fd.city AND n_obs > 0 AND date BETWEEN window_start AND window_end GROUP BY ALL) "
        "SELECT ext_genid, \"window\", round(CASE WHEN w.window_end >= w.window_start THEN coalesce(k, 0) / (w.window_end - w.window_start + 1) ELSE 0.0 END, 6) AS coverage_frac FROM w LEFT JOIN n ON w.city = n.city AND w.window_start = n.window_start AND w.window_end = n.window_end")
def _observed(spark, d):
    return cohort.coverage_frac(A.windows(spark, d), A.full_daily(spark, d), observed_only=True).select("ext_genid", "window", "coverage_frac")


_GCOLS = "city window_start window_end mean_tmax:d mean_tmean:d days_above_p90:i mean_humidity:d total_precip:d tmax_sd:d"
_SP = "sp AS (SELECT DISTINCT city, window_start, window_end FROM w WHERE window_end >= window_start)"


@_query("window_climate", _select(_GCOLS, "gc", f"{_X}, {_WIN}, {_SP}, {_GEN}"))
def _climate(spark, d):
    """From running sums."""
    return exposure.window_climate(A.windows(spark, d), _exceeding(spark, d))


@_query("window_climate_by_join", _select(_GCOLS, "gc", f"{_X}, {_WIN}, {_SP}, {_GEN}"))
def _climate_join(spark, d):
    return exposure.window_climate_by_join(A.windows(spark, d), _exceeding(spark, d))


@_query("window_hw_metrics", _select("city window_start window_end hw_def hw_count:i hw_mean_excess:d hw_max_excess:d hw_total_days:i hw_mean_duration:d hw_degree_days:d hw_mean_humidity:d hw_apparent_excess:d", "hm", f"{_E}, {_WIN}, {_CLIP}, {_HW}"))
def _hw_metrics(spark, d):
    return event_ranges.window_event_metrics(A.windows(spark, d), A.full_daily(spark, d), _events(spark, d), deficit=False)


@_query("window_hw_metrics_by_join", SQL["window_hw_metrics"])
def _hw_metrics_by_join(spark, d):
    """The same from a row for each overlap."""
    return exposure.window_heatwave_metrics_by_join(exposure.clip_events_to_windows(A.windows(spark, d), _events(spark, d)))


@_query("precip_deficit", _select("city window_start window_end hw_def precip_deficit:d", "pdf", f"{_E}, {_WIN}, {_CLIP}, {_PD}"))
def _deficit(spark, d):
    found = event_ranges.window_event_metrics(A.windows(spark, d), A.full_daily(spark, d), _events(spark, d))
    return found.select("city", "window_start", "window_end", "hw_def", "precip_deficit")


@_query("exposure_components", _select("ext_genid:i window hw_def coverage_frac:d hw_count:i hw_total_days:i hw_mean_excess:d hw_max_excess:d hw_mean_duration:d hw_degree_days:d hw_mean_humidity:d hw_apparent_excess:d precip_deficit:d mean_tmax:d mean_tmean:d days_above_p90:i mean_humidity:d total_precip:d tmax_sd:d", "comp", f"{_E}, {_WIN}, {_COMP}"), digits=None)
def _comps(spark, d):
    """Person by window by definition, windows without events included. Values are rounded before they are repeated."""
    c = _components(spark, d, digits=6)
    return c.select("ext_genid", "window", "hw_def", "coverage_frac", "hw_count", "hw_total_days", "hw_mean_excess", "hw_max_excess", "hw_mean_duration", "hw_degree_days", "hw_mean_humidity", "hw_apparent_excess", "precip_deficit", "mean_tmax", "mean_tmean", "days_above_p90", "mean_humidity", "total_precip", "tmax_sd")


@_query("coverage_report", f"WITH {_X}, {_WIN}, {_COV} SELECT \"window\", count(*) AS n, round(avg(coverage_frac), 6) AS mean, round(avg(CASE WHEN coverage_frac = 0 THEN 100.0 ELSE 0 END), 6) + 0.0 AS pct_zero, round(avg(CASE WHEN coverage_frac >= 0.95 THEN 100.0 ELSE 0 END), 6) + 0.0 AS pct_full FROM (SELECT DISTINCT ext_genid, \"window\", coverage_frac FROM cv) GROUP BY \"window\"")
def _coverage_report(spark, d):
    return analytical.coverage_report(cohort.coverage_frac(A.windows(spark, d), A.full_daily(spark, d)))


@_query("hw_count_report", f"WITH {_E}, {_WIN}, {_COMP} SELECT \"window\", round(avg(hw_count), 6) AS mean, CAST(quantile_cont(hw_count, 0.5) AS DOUBLE) AS median, CAST(max(hw_count) AS BIGINT) AS max FROM comp WHERE hw_def = 'tmax_p90_d2' GROUP BY \"window\"")
def _count_report(spark, d):
    return analytical.hw_count_report(_components(spark, d), "tmax_p90_d2")


@_query("index_zmean", f"WITH {_E}, {_WIN}, {_COMP}, {_ZIN} SELECT ext_genid, \"window\", hw_def, round(({' + '.join('z_' + m for m in index.METRICS)}) / 6, 6) + 0.0 AS csei_zsum FROM zs")
def _zmean(spark, d):
    return index.zmean(index.index_inputs(_index_components(spark, d))).select("ext_genid", "window", "hw_def", "csei_zsum")


@_query("index_pca")
def _index(spark, d):
    return index.build_index(_index_components(spark, d))[0]


@_query("index_loadings")
def _loadings(spark, d):
    return index.build_index(_index_components(spark, d))[1]


@_query("spearman_by_group", "WITH " + _D + ", k AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY round(tmax_daily, 3)) + (count(*) OVER (PARTITION BY city, round(tmax_daily, 3)) - 1) / 2 AS a, rank() OVER (PARTITION BY city ORDER BY precip_total) + (count(*) OVER (PARTITION BY city, precip_total) - 1) / 2 AS b "
        "FROM (SELECT city, tmax_daily, round(precip_total, 3) AS precip_total FROM d)) SELECT city, round(corr(a, b), 6) + 0.0 AS spearman, count(*) AS n FROM k GROUP BY city")
def _spearman(spark, d):
    rows = A.daily(spark, d).select("city", F.round("tmax_daily", 3).alias("x"), F.round("precip_total", 3).alias("y"))
    return index.spearman_by_group(rows, "x", "y", ("city",))


_PCA_DAILY = ["tmax_daily", "tmin_daily", "tmean_daily", "apparent_temp", "above_p90", "above_p95", "hw_day", "excess_p90", "excess_p95", "tsd_daily", "dtr", "dewpoint_daily", "dewpoint_range_daily", "humidity_mean", "humidity_min", "humidity_max", "pressure_mean", "pressure_range_daily", "radiation_total", "radiation_max", "wind_mean", "wind_max", "wind_gust_max", "precip_total"]
_PCA_MONTHLY = ["mean_tmax", "max_tmax", "mean_tmean", "mean_apparent", "days_above_p90", "days_above_p95", "hw_days", "degree_days_p90", "degree_days_p95", "sd_tmax", "sd_tmean", "mean_dtr", "sd_dtr", "mean_tsd", "mean_humidity", "min_humidity", "max_humidity", "mean_dewpoint", "mean_dewpoint_range", "total_precip", "dry_days", "max_daily_precip", "mean_pressure", "mean_pressure_range", "mean_radiation", "mean_radiation_peak", "mean_wind", "mean_wind_peak", "mean_gust_peak"]


def _daily_z(spark, d) -> DataFrame:
    rows = _featured(spark, d).withColumns({c: F.col(c).cast("double") for c in ("above_p90", "above_p95", "hw_day")})
    return features.zscore_within(rows.select("city", "date", *_PCA_DAILY), _PCA_DAILY)


@_query("joint_pca_loadings")
def _pca(spark, d):
    """Loadings, eigenvalues and shares of the daily variables, standardised within stations."""
    return pca.fit_pca(_daily_z(spark, d), _PCA_DAILY)[0]


@_query("joint_pca_monthly_loadings")
def _pca_monthly(spark, d):
    """The same of the monthly variables."""
    rows = features.monthly_features(_featured(spark, d)).select("city", "yr_mo", *_PCA_MONTHLY)
    return pca.fit_pca(features.zscore_within(rows, _PCA_MONTHLY), _PCA_MONTHLY)[0]


@_query("joint_pca_scores")
def _scores(spark, d):
    rows = _daily_z(spark, d)
    return pca.pca_scores(rows, pca.fit_pca(rows, _PCA_DAILY)[1], 4).select("city", "date", "PC1", "PC2", "PC3", "PC4")


_PIV = [f"max(CASE WHEN \"window\" = '{w}' THEN {v} END)" for v in ("hw_count", "coverage_frac") for w in analytical.WINDOWS]


@_query("pivot_windows", f"WITH {_E}, {_WIN}, {_COMP} SELECT ext_genid, " + ", ".join(f"CAST({x} AS BIGINT) AS hw_count_{w}" for x, w in zip(_PIV[:3], analytical.WINDOWS)) + ", " + ", ".join(f"round({x}, 6) + 0.0 AS coverage_frac_{w}" for x, w in zip(_PIV[3:], analytical.WINDOWS)) + " FROM comp WHERE hw_def = 'tmax_p90_d2' AND \"window\" <> '0_5' GROUP BY ext_genid")
def _pivot(spark, d):
    return analytical.pivot_windows(_components(spark, d).where("hw_def = 'tmax_p90_d2'"), ["hw_count", "coverage_frac"])


@_query("merge_analytical", f"WITH {_E}, {_WIN}, {_COMP}, p AS (SELECT ext_genid, " + ", ".join(f"CAST({x} AS BIGINT) AS hw_count_{w}" for x, w in zip(_PIV[:3], analytical.WINDOWS)) + " FROM comp WHERE hw_def = 'tmax_p90_d2' AND \"window\" <> '0_5' GROUP BY ext_genid), "
        "v AS (SELECT ext_genid, " + ", ".join(f"round({x}, 6) + 0.0 AS coverage_frac_{w}" for x, w in zip(_PIV[3:], analytical.WINDOWS)) + " FROM comp WHERE hw_def = 'tmax_p90_d2' AND \"window\" <> '0_5' GROUP BY ext_genid) "
        "SELECT co.ext_genid, redcap_event_name, d_date, round(age, 6) AS age, birth_date, b.city, hw_count_6_10, hw_count_11_18, hw_count_cumulative, coverage_frac_6_10, coverage_frac_11_18, coverage_frac_cumulative FROM co LEFT JOIN b USING (ext_genid) LEFT JOIN p USING (ext_genid) LEFT JOIN v USING (ext_genid)")
def _merge(spark, d):
    one = shared.written(_components(spark, d).where("hw_def = 'tmax_p90_d2'"), "components")
    births = A.births(spark, d).select("ext_genid", "birth_date", "city")
    people = A.members(spark, d).select("ext_genid", "redcap_event_name", "d_date", "age")
    return analytical.merge_analytical(people, births, analytical.pivot_windows(one, ["coverage_frac"]), analytical.pivot_windows(one, ["hw_count"]))


_VARS = ["tmax_daily", "tmin_daily", "tmean_daily", "apparent_temp", "humidity_mean", "wind_mean", "wind_gust_max", "pressure_mean", "radiation_total", "precip_total", "dewpoint_daily"]


@_query("describe_long", "WITH " + _F + " " + " UNION ALL ".join(
    f"SELECT city, '{v}' AS variable, CAST({k + 1} AS BIGINT) AS position, count(*) AS n_total, count({v}) AS n_nonmiss, " + ", ".join(f"round({x.format(v)}, 6) + 0.0 AS {n}" for n, x in (("mean", "avg({0})"), ("sd", "stddev_samp({0})"), ("median", "quantile_cont({0}, 0.5)"), ("p25", "quantile_cont({0}, 0.25)"), ("p75", "quantile_cont({0}, 0.75)"), ("min", "min({0})"), ("max", "max({0})"))) + " FROM fd GROUP BY city"
    for k, v in enumerate(_VARS)))
def _describe(spark, d):
    return analytical.describe_long(A.full_daily(spark, d), _VARS)


@_query("describe_cohort", "WITH " + _B + " SELECT 'birth_date_sd_days' AS variable, NULL AS level, count(birth_date_sd_days) AS n, round(avg(birth_date_sd_days), 6) AS mean, round(stddev_samp(birth_date_sd_days), 6) AS sd, round(quantile_cont(birth_date_sd_days, 0.5), 6) AS median, round(min(birth_date_sd_days), 6) AS min, round(max(birth_date_sd_days), 6) AS max FROM b "
        "UNION ALL SELECT 'n_estimates', NULL, count(n_estimates), round(avg(n_estimates), 6), round(stddev_samp(n_estimates), 6), quantile_cont(n_estimates, 0.5), min(n_estimates), max(n_estimates) FROM b "
        "UNION ALL SELECT 'site', CAST(site AS VARCHAR), count(*), NULL, NULL, NULL, NULL, NULL FROM b GROUP BY site UNION ALL SELECT 'gender', CAST(gender AS VARCHAR), count(*), NULL, NULL, NULL, NULL, NULL FROM b GROUP BY gender "
        "UNION ALL SELECT 'any_index', NULL, count(*) FILTER (WHERE birth_date_sd_days IS NOT NULL), NULL, NULL, NULL, NULL, NULL FROM b")
def _describe_people(spark, d):
    return analytical.describe_cohort(A.births(spark, d), ["birth_date_sd_days", "n_estimates"], ["site", "gender"], ["birth_date_sd_days"])


@_query("unpivot_metrics", "WITH " + _D + " SELECT city, date, 'tmax_daily' AS metric, round(tmax_daily, 6) + 0.0 AS value FROM d UNION ALL SELECT city, date, 'wind_mean', round(wind_mean, 6) + 0.0 FROM d")
def _unpivot(spark, d):
    return analytical.unpivot_metrics(A.daily(spark, d).select("city", "date", "tmax_daily", "wind_mean"), ["city", "date"], ["tmax_daily", "wind_mean"])


_NAMES = "SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN o_orderkey % 4 = 0 THEN concat('INMET_S_RS_A', CAST(o_custkey % 7 AS VARCHAR(9)), '_A_31-12-', CAST(year(o_orderdate) AS VARCHAR(9)), '.CSV') ELSE concat('INMET_S_RS_A', CAST(o_custkey % 7 AS VARCHAR(9)), '_B_', CAST(o_orderkey AS VARCHAR(20)), '.csv') END AS name FROM orders"


@_query("station_files", f"WITH n AS ({_NAMES}), s AS (SELECT 'st' || k AS station, 'A' || k || '_' AS code FROM (SELECT unnest(range(6)) AS k)) SELECT station, CAST(year AS BIGINT) AS year, name, is_full_year FROM (SELECT *, upper(name) LIKE '%\\_A\\_31-12-' || year || '.CSV' ESCAPE '\\' AS is_full_year FROM n JOIN s ON contains(name, code)) QUALIFY row_number() OVER (PARTITION BY station, year ORDER BY CASE WHEN is_full_year THEN 0 ELSE 1 END, name) = 1")
def _files(spark, d):
    """File names made from orders: seven codes, full-year and partial files; one code has no station."""
    names = A._sql(spark, d, _NAMES, "orders").select("name", "year").distinct()
    known = spark.range(6).select(F.concat(F.lit("st"), F.col("id").cast("string")).alias("station"), F.concat(F.lit("A"), F.col("id").cast("string"), F.lit("_")).alias("code"))
    return stations.select_station_files(names, known).select("station", "year", "name", "is_full_year")


@_query("check_station_years", "WITH c AS (SELECT DISTINCT o_custkey % 500 AS station, year(o_orderdate) AS year FROM orders) SELECT CAST(a.station AS BIGINT) AS station, CAST(b.year AS BIGINT) AS year FROM (SELECT DISTINCT station FROM c) a, (SELECT DISTINCT year FROM c) b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.station = a.station AND c.year = b.year)")
def _missing_years(spark, d):
    found = A.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("station"), F.year("o_orderdate").alias("year")).distinct()
    return stations.check_station_years(found, found.select("station").distinct(), found.select("year").distinct())


@_query("daily_qa", "WITH " + _F + " SELECT city, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day, round(min(tmax_daily), 6) AS tmax_min, round(max(tmax_daily), 6) AS tmax_max, count(*) - count(tmax_daily) AS n_tmax_null, count(*) FILTER (WHERE long_gap) AS n_long_gap, count(*) FILTER (WHERE n_obs = 0) AS n_filled, round(avg(apparent_temp), 6) AS mean_apparent FROM fd GROUP BY city")
def _qa(spark, d):
    return clean.daily_qa(A.full_daily(spark, d))


@_query("cohort_qa", f"WITH {_B} SELECT CAST(site AS BIGINT) AS site, count(*) AS n, count(*) FILTER (WHERE birth_date_sd_days > 30) AS n_spread, count(*) FILTER (WHERE city IS NULL) AS n_no_city FROM b GROUP BY site")
def _people_qa(spark, d):
    return cohort.cohort_qa(A.births(spark, d))


@_query("precip_climatology", "WITH " + _F + " SELECT city, CAST(dayofyear(date) AS BIGINT) AS doy, round(avg(precip_total), 6) + 0.0 AS clim_precip FROM fd GROUP BY city, dayofyear(date)")
def _climatology(spark, d):
    return exposure.precip_climatology(A.full_daily(spark, d))


from swelter.plans import chains, files, models  # noqa: E402, F401  (they register their queries)
