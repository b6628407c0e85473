"""Chains of steps on what earlier steps made: features, trends and means of the components, and tables of the index scores.

The SQL finds the first four axes one after another, each from what the axes before it leave of the correlation matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.operators import analytical, clean, events, features, pca, thresholds, trend
from swelter.plans import adapters as A
from swelter.plans import models as M
from swelter.plans import registry as R
from swelter.sources import shared

_N = M._N


def _rest(k: int) -> str:
    """CTE jm<k>: what the first k - 1 axes leave."""
    p = k - 1
    return f"jm{k} AS (SELECT [c[p + 1] - lam * v[p // {_N} + 1] * v[p % {_N} + 1] FOR p IN range({_N * _N})] AS m FROM j{p})"


def _sign(k: int, anchor: str) -> str:
    return f"CASE WHEN j{k}.v[{M._V.index(anchor) + 1}] >= 0 THEN 1 ELSE -1 END"


_SCORE = {k: "(" + " + ".join(f"(zz.{c} - avg(zz.{c}) OVER ()) / stddev_samp(zz.{c}) OVER () * j{k}.v[{i + 1}]" for i, c in enumerate(M._V)) + ")" for k in range(1, 5)}
_SCORES = f"""{M._JOINT},
 {_rest(3)}, {M._axis("j3", "jm3", _N)}, {_rest(4)}, {M._axis("j4", "jm4", _N)},
 sc AS (SELECT zz.city, zz.date, {", ".join(f"{x} AS PC{k}" for k, x in _SCORE.items())}, {_SCORE[3]} * {_sign(3, "hw_day")} AS stagnation, {_SCORE[1]} * {_sign(1, "tmax_daily")} AS abs_warm
        FROM zz, j1, j2, j3, j4),
 scored AS (SELECT sc.*, hd.above_p90, hd.hw_day, hd.excess_p90 FROM sc JOIN hd ON sc.city = hd.city AND sc.date = hd.date)"""


def _scored(spark, d) -> DataFrame:
    """city, date, PC1..PC4, stagnation and abs_warm (the third and the first component, signed by heat-wave days and by tmax), and the raw flags and excess."""
    rows, (loadings, model) = M._fitted(spark, d)
    scores = pca.orient(pca.pca_scores(rows, model, 4), loadings, {"stagnation": (3, "hw_day"), "abs_warm": (1, "tmax_daily")})
    raw = R._featured(spark, d).select("city", "date", "above_p90", "hw_day", "excess_p90")
    return scores.select("city", "date", "PC1", "PC2", "PC3", "PC4", "stagnation", "abs_warm").join(raw, ["city", "date"])


_FLAGS = {"above_p90": (3, 7, 14, 30), "hw_day": (7, 14, 30), "excess_p90": (7, 14, 30)}
_PCS = {f"PC{k}": (7, 14, 30) for k in range(1, 5)}
_LAGS = {f"PC{k}": (1, 3, 7, 14) for k in range(1, 5)}


def _frame(n: int, x: str) -> str:
    return f"CASE WHEN row_number() OVER (PARTITION BY city ORDER BY date) >= {n} THEN {x} OVER (PARTITION BY city ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


_ROLLED = [
    *[f"round({_frame(n, f'sum(coalesce(CAST({c} AS DOUBLE), 0))')}, 3) + 0.0 AS sum_{c}_{n}d" for c, ns in _FLAGS.items() for n in ns],
    *[f"round({_frame(n, f'avg({c})')}, 3) + 0.0 AS mean_{c}_{n}d, round({_frame(n, f'max({c})')}, 3) + 0.0 AS max_{c}_{n}d" for c, ns in _PCS.items() for n in ns],
    *[f"round(lag({c}, {k}) OVER (PARTITION BY city ORDER BY date), 3) + 0.0 AS {c}_lag{k}" for c, ks in _LAGS.items() for k in ks],
]


@R._query("component_features", f"""WITH RECURSIVE {_SCORES}, spine AS ({R._CAL.format("scored")}),
 full_days AS (SELECT spine.city, spine.date, PC1, PC2, PC3, PC4, above_p90, hw_day, excess_p90 FROM spine LEFT JOIN scored s ON spine.city = s.city AND spine.date = s.date)
 SELECT city, date, {", ".join(_ROLLED)} FROM full_days""")  # fmt: skip
def _component_features(spark, d):
    """Rolling sums of flags and excess, rolling means and maxima and lags of four components, on a complete calendar."""
    scored = _scored(spark, d).drop("stagnation", "abs_warm")
    out = features.rolling_features(clean.complete_calendar(scored), _FLAGS, _PCS, _LAGS)
    made = [c for c in out.columns if c not in scored.columns]
    return out.select("city", "date", *[(F.round(c, 3) + 0.0).alias(c) for c in made])


@R._query("component_years", f"""WITH RECURSIVE {_SCORES} SELECT city, CAST(year(date) AS BIGINT) AS year, count(stagnation) AS n, round(avg(stagnation), 3) + 0.0 AS stagnation_mean, round(quantile_cont(stagnation, 0.9), 3) + 0.0 AS stagnation_p90,
 round(max(stagnation), 3) + 0.0 AS stagnation_max, round(avg(abs_warm), 3) + 0.0 AS warm_mean FROM scored GROUP BY city, year(date)""")  # fmt: skip
def _component_years(spark, d):
    """Yearly summaries of the stagnation and the warmth component."""
    scored = shared.written(_scored(spark, d), "scored")
    stagnation, warm = (trend.annual_summary(scored, c) for c in ("stagnation", "abs_warm"))
    both = stagnation.select("city", "year", "n", F.col("mean").alias("stagnation_mean"), F.col("p90").alias("stagnation_p90"), F.col("max").alias("stagnation_max")).join(warm.select("city", "year", F.col("mean").alias("warm_mean")), ["city", "year"])
    return both.select("city", "year", "n", *[(F.round(c, 3) + 0.0).alias(c) for c in both.columns[3:]])


@R._query("component_months", f"""WITH RECURSIVE {_SCORES}, m AS (SELECT city, CAST(date_trunc('month', date) AS DATE) AS month, avg(PC3) AS mean FROM scored WHERE PC3 IS NOT NULL GROUP BY 1, 2)
 SELECT city, month, round(mean, 3) + 0.0 AS mean, round((SELECT max(abs(mean)) FROM m), 3) AS "limit" FROM m""")  # fmt: skip
def _component_months(spark, d):
    """Monthly means of the third component, with the limit of a scale that is even around zero."""
    means = shared.written(trend.monthly_component_mean(_scored(spark, d), "PC3"), "monthly-means")
    # one row: the largest of them
    return means.join(F.broadcast(trend.symmetric_limit(means, "mean"))).select("city", "month", (F.round("mean", 3) + 0.0).alias("mean"), F.round("limit", 3).alias("limit"))


# ---- the index

_VALUES = ["csei_pca", "csei_zsum", "coverage_frac"]
_DEF = "tmax_p90_d2"
_INDEXED = f"""{M._INDEX}, wide AS (SELECT ext_genid, {", ".join(f'max(CASE WHEN "window" = {chr(39)}{w}{chr(39)} THEN {v} END) AS {v}_{w}' for v in _VALUES for w in analytical.WINDOWS)} FROM sco WHERE hw_def = '{_DEF}' GROUP BY ext_genid),
 an AS (SELECT co.*, wide.* EXCLUDE (ext_genid) FROM co LEFT JOIN wide USING (ext_genid)),
 w1 AS (SELECT * FROM an WHERE regexp_extract(redcap_event_name, '^wave0*([0-9]+)(_|$)', 1) = '1')"""
_SCORED = [f"{v}_{w}" for v in _VALUES for w in analytical.WINDOWS]


def _indexed(spark, d) -> DataFrame:
    """The cohort with the index scores of each window."""
    scores = M._build(spark, d)[0].where(F.col("hw_def") == _DEF)
    wide = analytical.pivot_windows(scores, _VALUES)
    return analytical.merge_analytical(A.members(spark, d), A.births(spark, d).select("ext_genid", "birth_date", "city"), wide, wide.select("ext_genid"))


@R._query("merge_index_scores", f"WITH RECURSIVE {_INDEXED} SELECT ext_genid, redcap_event_name, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _SCORED)} FROM an")
def _merge_scores(spark, d):
    """The cohort's rows with index scores and coverage by window."""
    return _indexed(spark, d).select("ext_genid", "redcap_event_name", *[(F.round(c, 5) + 0.0).alias(c) for c in _SCORED])


def _described_sql(c: str) -> str:
    stats = ", ".join(f"round({x}, 4) + 0.0 AS {n}" for n, x in (("mean", f"avg({c})"), ("sd", f"stddev_samp({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("p25", f"quantile_cont({c}, 0.25)"), ("p75", f"quantile_cont({c}, 0.75)"), ("min", f"min({c})"), ("max", f"max({c})")))
    return f"SELECT '{c}' AS variable, NULL AS level, count(*) AS n_total, count({c}) AS n_nonmiss, {stats} FROM w1"


_NULLS = "NULL, NULL, NULL, NULL, NULL, NULL, NULL"


@R._query("first_wave_table", f"""WITH RECURSIVE {_INDEXED}, t AS ({" UNION ALL ".join(map(_described_sql, ["age", *_SCORED]))}
 UNION ALL SELECT 'any_index', NULL, count(*), count(*) FILTER (WHERE {" OR ".join(f"csei_pca_{w} IS NOT NULL" for w in analytical.WINDOWS)}), {_NULLS} FROM w1
 UNION ALL SELECT 'site', CAST(site AS VARCHAR), (SELECT count(*) FROM w1), count(*), {_NULLS} FROM w1 GROUP BY site
 UNION ALL SELECT 'gender', CAST(gender AS VARCHAR), (SELECT count(*) FROM w1), count(*), {_NULLS} FROM w1 GROUP BY gender) SELECT * FROM t""")  # fmt: skip
def _first_wave(spark, d):
    """The first wave's age, index and coverage columns described, rows with any index, and sites and genders counted."""
    out = analytical.describe_wave(shared.written(analytical.wave(_indexed(spark, d), 1), "first-wave"), ["age", *_SCORED], ["site", "gender"], [f"csei_pca_{w}" for w in analytical.WINDOWS])
    return out.select("variable", "level", "n_total", "n_nonmiss", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "sd", "median", "p25", "p75", "min", "max")])


@R._query("index_column_counts", f"WITH RECURSIVE {_INDEXED} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) AS n_rows FROM w1" for c in _SCORED[:6]))
def _column_counts(spark, d):
    """How many rows of the first wave have each index column."""
    return analytical.column_counts(analytical.wave(_indexed(spark, d), 1), _SCORED[:6])


def _cases(of: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


@R._query("named_index_loadings", f"""WITH RECURSIVE {M._INDEX} SELECT hw_def, metric, "window", {_cases(C.METRIC_LABELS, "metric")} AS metric_label, {_cases(C.WINDOW_LABELS, '"window"')} AS window_label, round(loading, 5) + 0.0 AS loading,
 concat(CASE WHEN hw_def LIKE 'apparent%' THEN 'Apparent' ELSE 'Tmax' END, ' ', CASE WHEN hw_def LIKE '%p925%' THEN '92.5th' WHEN hw_def LIKE '%p95%' THEN '95th' ELSE '90th' END, ' ≥', right(hw_def, 1), 'd') AS short_name FROM lod""")  # fmt: skip
def _named(spark, d):
    """Loadings with the labels of metric, window and definition."""
    out = M._build(spark, d)[1]
    return out.select("hw_def", "metric", "window", C.labelled(F.col("metric"), C.METRIC_LABELS).alias("metric_label"), C.labelled(F.col("window"), C.WINDOW_LABELS).alias("window_label"), (F.round("loading", 5) + 0.0).alias("loading"), C.parsed_label(F.col("hw_def"))["short_name"].alias("short_name"))


# ---- small steps


@R._query("definitions_of_both", "WITH " + R._E + " SELECT hw_def FROM e WHERE city = 'A' UNION SELECT hw_def FROM e WHERE city = 'N'")
def _both(spark, d):
    """Definitions that have an event in either of two cities, once."""
    found = shared.written(R._events(spark, d), "events")
    return events.union_of_definitions(found.where("city = 'A'"), found.where("city = 'N'"))


@R._query("attached_thresholds", "WITH " + R._F + ", th AS (" + " UNION ALL ".join(f"SELECT city, '{m}' AS metric, CAST({p} AS DOUBLE) AS percent, quantile_cont({c}, {p / 100}) AS threshold FROM fd GROUP BY city" for m, c, p in R._DEFS) + ") SELECT fd.city, fd.date, metric, percent, round(threshold, 6) AS threshold FROM fd LEFT JOIN th ON fd.city = th.city")
def _attached(spark, d):
    daily = A.full_daily(spark, d)
    return thresholds.attach_threshold(daily, thresholds.thresholds(daily, R._METRICS)).select("city", "date", "metric", "percent", "threshold")


@R._query("recent_hot_days", "WITH " + R._X + " SELECT city, date, round(excess_p90, 6) + 0.0 AS excess_p90 FROM x WHERE year(date) >= (SELECT max(year(date)) FROM x) - 1 AND above_p90")
def _recent(spark, d):
    """Days over the threshold in the last two years of the series."""
    return features.recent_years(shared.written(R._exceeding(spark, d), "daily"), 2).where("above_p90").select("city", "date", "excess_p90")
