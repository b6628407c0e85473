"""The climate and cohort operators on small hand-made frames."""

import datetime as dt
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

D = dt.date


def day(k, start=D(2020, 1, 1)):
    return start + dt.timedelta(days=k)


def one(df):
    return df.first()[0]


# ---- columns


def test_numbers(spark):
    from swelter.functions.columns import parse_comma_numeric

    cases = {"12,5": 12.5, "-9999": None, "-9999,0": None, ",8": 0.8, "": None, "1,2,3": None, "NaN": None, "Infinity": None, "1.5d": None, "-3": -3.0, "1e2": 100.0, None: None, "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("v", parse_comma_numeric(F.col("t")))
    assert {x.t: x.v for x in df.collect()} == cases


def test_scalars(spark):
    from swelter.functions import columns as C

    df = spark.sql("SELECT '2020/02/03' a, '2020-02-03' b, 'x' c, 5.0D t, null n, date'2020-02-29' leap")
    r = df.select(
        C.parse_station_date(F.col("a")), C.parse_station_date(F.col("b")), C.parse_station_date(F.col("c")), C.within(F.lit(50.0), -10, 50), C.within(F.lit(50.1), -10, 50), C.within(F.lit(0.0), 0, None),
        C.is_over(F.col("n").cast("double"), F.lit(1.0)), C.excess(F.col("n").cast("double"), F.lit(1.0)), C.excess(F.col("t"), F.lit(1.0)),
        C.birth_date_estimate(F.lit(D(2020, 1, 10)), F.lit(2.0 / 146.1 * 0.5 * 4 / 4)), C.plus_years(F.col("leap"), 5), C.plus_years(F.col("leap"), 5, "clamp"), C.plus_years(F.col("leap"), 4),
        C.season(F.lit(12)), C.season(F.lit(5)), C.period_bucket(F.lit(2014)), C.period_bucket(F.lit(2015)), C.period_bucket(F.lit(2020)), C.month_of_label(F.lit("2020-07")),
        C.map_code(F.lit(2), {1: "a", 2: "b"}), C.map_code(F.lit(3), {1: "a"}),
    ).first()
    assert tuple(r) == (D(2020, 2, 3), D(2020, 2, 3), None, 50.0, None, 0.0, False, 0.0, 4.0, D(2020, 1, 8), None, D(2025, 2, 28), D(2024, 2, 29), "Summer", "Autumn", 1, 2, 3, 7, "b", None)


def test_rounding_is_half_even(spark):
    from swelter.functions.columns import birth_date_estimate

    # 2.5 days round to 2
    df = spark.range(1).select(birth_date_estimate(F.lit(D(2020, 1, 10)), F.lit(2.5 / 365.25)))
    assert one(df) == D(2020, 1, 8)


def test_apparent_temperature(spark):
    from swelter.functions.columns import apparent_temp

    want = -2.7 + 1.04 * 30 + 2 * (0.6 * 6.105 * math.exp(17.27 * 30 / 267.7) / 10) - 0.65 * 2
    df = spark.range(1)
    assert abs(one(df.select(apparent_temp(F.lit(30.0), F.lit(60.0), F.lit(2.0)))) - want) < 1e-12
    assert one(df.select(apparent_temp(F.lit(-237.7), F.lit(60.0), F.lit(2.0)))) is None


def test_labels_round_trip(spark):
    from swelter.functions.columns import parsed_label
    from swelter.operators.events import hw_definitions

    defs = hw_definitions(spark).withColumn("p", parsed_label(F.col("hw_def"))).collect()
    assert len(defs) == 18 and defs[0].hw_def == "tmax_p90_d2"
    x = next(d for d in defs if d.hw_def == "apparent_p925_d5")
    assert (x.p.metric, x.p.threshold, x.p.duration) == ("apparent", "92.5th", "≥5d")


# ---- cleaning


def test_daily_of_missing_readings(spark):
    from swelter.operators import clean

    cols = ["tmax_c", "tmin_c", "temp_drybulb_c", "dewpoint_c", "dewpoint_max_c", "dewpoint_min_c", "rh_pct", "rh_min_pct", "rh_max_pct", "pressure_mbar", "pressure_max_mbar", "pressure_min_mbar", "radiation_kj", "wind_speed_ms", "wind_gust_ms", "precip_mm"]
    df = spark.createDataFrame([("a", day(0), *[None] * 16)], "city string, date date, " + ", ".join(f"{c} double" for c in cols))
    r = clean.hourly_to_daily(df).first()
    assert (r.radiation_total, r.precip_total, r.tmax_daily, r.tsd_daily, r.n_obs, r.n_tmax_valid) == (0.0, 0.0, None, None, 1, 0)
    twice = df.unionByName(df)
    assert clean.hourly_to_daily(twice).first().n_obs == 2 and clean.hourly_to_daily(twice, distinct_on=["city", "date"]).first().n_obs == 1


def test_gaps_and_interpolation(spark):
    from swelter.operators import clean

    # days 0, 4 (gap of 3), 9 (gap of 4), 11 (gap of 1); day 4 has a null that must stay
    rows = [("a", day(0), 1.0, 10.0, 1), ("a", day(4), None, 14.0, 1), ("a", day(9), 10.0, 19.0, 1), ("a", day(11), 12.0, 21.0, 1), ("b", day(3), 1.0, None, 1)]
    df = spark.createDataFrame(rows, "city string, date date, v double, w double, n_obs int")
    out = clean.interpolate_gaps(clean.flag_long_gaps(clean.complete_calendar(df)), ["v", "w"]).where("city = 'a'").orderBy("date").collect()
    assert [x.long_gap for x in out] == [False] * 5 + [True] * 4 + [False] * 3
    # between the nearest values on both sides, beyond the gap if need be: days 1 to 3 lie on the line from day 0 to day 9
    assert [x.v for x in out[:5]] == [1.0, 2.0, 3.0, 4.0, None] and [x.v for x in out[5:]] == [None] * 4 + [10.0, 11.0, 12.0]
    assert [x.w for x in out[:5]] == [10.0, 11.0, 12.0, 13.0, 14.0] and out[1].n_obs == 0
    assert clean.complete_calendar(df.limit(0)).count() == 0


# ---- thresholds and events


def test_percentiles_interpolate(spark):
    from swelter.operators.thresholds import thresholds

    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate([1.0, 2.0, 4.0, 10.0, None])], "city string, date date, t double")
    got = {x.percent: x.threshold for x in thresholds(df, {"t": "t"}).collect()}
    assert abs(got[90.0] - 8.2) < 1e-12
    with pytest.raises(ValueError):
        thresholds(df, {"t": "t"}, mode="other")


def test_seasonal_window_wraps(spark):
    from swelter.operators.thresholds import thresholds

    df = spark.createDataFrame([("a", D(2019, 12, 31), 5.0), ("a", D(2020, 1, 3), 1.0)], "city string, date date, t double")
    got = {x.doy: x.threshold for x in thresholds(df, {"t": "t"}, (50.0,), "seasonal").collect()}
    assert got[366] == 3.0 and got[1] == 3.0 and got[9] == 1.0 and got[358] == 5.0 and 200 not in got


def _flags(spark, text):
    flag = {"1": True, "0": False, ".": None}
    return spark.createDataFrame([("a", day(k), flag[c]) for k, c in enumerate(text)], "city string, date date, f boolean")


def test_runs(spark):
    from swelter.operators.events import run_table

    got = sorted((x.start, x.end, x.duration) for x in run_table(_flags(spark, "110111.1101"), "f", ["city"], 2).collect())
    assert got == [(day(0), day(1), 2), (day(3), day(5), 3), (day(7), day(8), 2)]
    assert run_table(_flags(spark, "00.0"), "f", ["city"]).count() == 0


def _climate(spark, n=400):
    rows = [("a", day(k), 20 + 10 * math.sin(k / 9.0) + (k * 37 % 11) / 3, 15.0 + k % 7, 50.0 + k % 30, float(k % 4), 25.0 + (k * 13 % 17)) for k in range(n)]
    return spark.createDataFrame(rows, "city string, date date, tmax_daily double, tmean_daily double, humidity_mean double, precip_total double, apparent_temp double")


def test_event_sets_nest_and_cover(spark):
    from swelter.operators import events, thresholds

    m = {"tmax": "tmax_daily", "apparent": "apparent_temp"}
    daily = _climate(spark)
    ev = events.heatwave_events(daily, thresholds.thresholds(daily, m), m).cache()
    by = {}
    for x in ev.collect():
        by.setdefault(x.hw_def, set()).add((x.start, x.end))
    p90 = [by.get(f"tmax_p90_d{k}", set()) for k in (5, 3, 2)]
    assert p90[0] <= p90[1] <= p90[2] and p90[2]
    one_def = ev.where("hw_def = 'tmax_p90_d2'")
    flagged = events.flag_event_days(daily, one_def)
    assert flagged.count() == 400 and flagged.where("hw_day").count() == one_def.agg(F.sum("duration")).first()[0]
    again = {(x.start): (x.peak_temp, x.mean_humidity) for x in events.enrich_events(one_def.select("city", "start", "end"), daily).collect()}
    assert all(again[x.start][0] == x.peak_temp and abs(again[x.start][1] - x.mean_humidity) < 1e-9 for x in one_def.collect())
    assert {x.hw_def for x in events.primary_definition(ev, "none").select("hw_def").distinct().collect()} == {"tmax_p90_d2"}


# ---- features


def test_rolling_guards(spark):
    from swelter.operators.features import rolling_features

    df = spark.createDataFrame([("a", day(k), v, True) for k, v in enumerate([None, None, 3.0, None, 5.0])], "city string, date date, v double, f boolean")
    out = rolling_features(df, {"v": (3,)}, {"v": (2, 30)}, {"v": (1,)}).orderBy("date").collect()
    assert [x.sum_v_3d for x in out] == [None, None, 3.0, 3.0, 8.0]
    assert [x.mean_v_2d for x in out] == [None, None, 3.0, 3.0, 5.0] and [x.max_v_2d for x in out] == [None, None, 3.0, 3.0, 5.0]
    assert all(x.mean_v_30d is None for x in out) and [x.v_lag1 for x in out] == [None, None, None, 3.0, None]


def test_zscore_of_constant_is_null(spark):
    from swelter.operators.features import zscore_within

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, 1.0)], "city string, x double, y double")
    got = {(x.city, x.x, x.y) for x in zscore_within(df, ["x", "y"]).collect()}
    r = math.sqrt(0.5)
    assert {(c, None if v is None else round(v, 9), y) for c, v, y in got} == {("a", round(-r, 9), None), ("a", round(r, 9), None), ("b", None, None)}


# ---- components


def test_pca_invariants(spark):
    import numpy as np

    from swelter.operators import pca

    r = np.random.default_rng(3)
    x = r.normal(size=(500, 4)) @ r.normal(size=(4, 4)) + 3
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, v), "k") for v in x] + [(None, 1.0, 1.0, 1.0, "k")], "a double, b double, c double, d double, key string")
    loadings, model = pca.fit_pca(df.repartition(7), cols)
    _, v, mean, sd = model
    table = loadings.toPandas().pivot(index="variable", columns="component", values="eigenvalue")
    eig = table.iloc[0].to_numpy()
    assert np.allclose(v.T @ v, np.eye(4)) and abs(eig.sum() - 4) < 1e-9 and (np.diff(eig) <= 1e-12).all()
    corr = np.corrcoef(x.T)
    assert np.allclose(v @ np.diag(eig) @ v.T, corr)
    s = pca.pca_scores(df, model).select("PC1", "PC2", "PC3", "PC4").toPandas().to_numpy()
    assert len(s) == 500 and np.allclose(np.cov(s.T), np.diag(eig), atol=1e-8)
    circle = pca.component_correlations(loadings).collect()
    assert abs(max(math.hypot(p.x, p.y) for p in circle) - 1) < 1e-12
    flipped = pca.orient(pca.pca_scores(df, model), loadings, {"first": (1, "c")}).select("PC1", "first").first()
    assert abs(abs(flipped.PC1) - abs(flipped.first)) < 1e-12


def test_index_groups_and_constants(spark):
    import numpy as np

    from swelter.operators import index

    r = np.random.default_rng(5)
    rows = []
    for w, n in (("6_10", 40), ("11_18", 19)):
        for k in range(n):
            v = r.normal(size=5)
            rows.append((k, w, "tmax_p90_d3", 0.9, *map(float, v), None))
    rows.append((99, "6_10", "tmax_p90_d3", 0.4, *[1.0] * 5, None))
    df = spark.createDataFrame(rows, "ext_genid long, window string, hw_def string, coverage_frac double, " + ", ".join(f"{m} double" for m in index.METRICS))
    scores, loadings = index.build_index(df)
    s = scores.toPandas()
    assert len(s) == 40 and set(s.window) == {"6_10"}
    x = np.array([row[4:9] for row in rows[:40]])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(s.set_index("ext_genid").csei_zsum.sort_index(), z.sum(1) / 6)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert abs(abs(np.corrcoef(s.set_index("ext_genid").csei_pca.sort_index(), z @ vectors[:, -1])[0, 1]) - 1) < 1e-9
    assert abs(s.pca_var_explained.iloc[0] - values[-1] / values.sum()) < 1e-9
    assert loadings.agg(F.sum("loading")).first()[0] >= 0 and loadings.count() == 6
    assert index.loadings_summary(loadings).count() == 6 and index.variance_summary(scores).count() == 1


def test_spearman_averages_ties(spark):
    from swelter.operators.index import spearman_by_group

    df = spark.createDataFrame([("g", x, y) for x, y in [(1.0, 2.0), (1.0, 3.0), (2.0, 1.0), (5.0, 9.0), (None, 1.0)]], "g string, x double, y double")
    import pandas as pd

    p = pd.DataFrame([(1, 2), (1, 3), (2, 1), (5, 9)])
    r = spearman_by_group(df, "x", "y", ("g",)).first()
    assert r.n == 4 and abs(r.spearman - p[0].rank().corr(p[1].rank())) < 1e-12


def test_trend_and_t_distribution(spark):
    from swelter.operators import trend

    assert abs(trend._t_tail(2.2281388519649385, 10) - 0.05) < 1e-9 and abs(trend._t_quantile(0.05, 10) - 2.2281388519649385) < 1e-7
    assert abs(trend._t_tail(12.706204736, 1) - 0.05) < 1e-8 and trend._t_tail(0, 5) == 1.0
    df = spark.createDataFrame([("a", float(k), 2.0 * k + (k % 2)) for k in range(10)] + [("b", 1.0, 1.0), ("b", 2.0, 3.0)], "city string, x double, y double")
    got = {x.city: x for x in trend.linear_trend(df, "y", "x").collect()}
    assert abs(got["a"].slope - 20) < 0.5 and got["a"].ci_low < got["a"].slope < got["a"].ci_high and got["a"].p_value < 1e-6
    assert got["b"].p_value is None or math.isnan(got["b"].p_value)


# ---- cohort and exposure


def test_birth_dates_take_the_first_wave(spark):
    from swelter.operators.cohort import derive_birth_dates

    rows = [("p", "wave1", 1, 0, D(2012, 1, 1), 2.0), ("p", "wave0", 2, 1, D(2010, 1, 1), 1.0), ("p", "wave2", 1, 0, D(2014, 1, 1), None), ("q", "wave0", 1, 0, D(2010, 1, 1), None), ("r", "wave0", 9, 0, D(2010, 1, 1), 1.0)]
    got = {x.ext_genid: x for x in derive_birth_dates(spark.createDataFrame(rows, "ext_genid string, redcap_event_name string, site int, gender int, d_date date, age double"), {1: "a", 2: "b"}).collect()}
    p = got["p"]
    assert set(got) == {"p", "r"} and (p.birth_date, p.n_estimates, p.site, p.city, p.last_assessment) == (D(2009, 1, 1), 2, 2, "b", D(2014, 1, 1))
    assert got["r"].city is None and got["r"].birth_date_sd_days is None


def test_windows_and_coverage(spark):
    from swelter.operators import cohort

    people = spark.createDataFrame([("p", D(2000, 2, 29), "a", D(2001, 1, 1)), ("q", D(2000, 3, 1), "a", D(1999, 1, 1)), ("r", D(2000, 3, 1), None, None)], "ext_genid string, birth_date date, city string, last_assessment date")
    w = cohort.developmental_windows(people)
    got = {(x.ext_genid, x.window): (x.window_start, x.window_end) for x in w.collect()}
    assert got["p", "0_5"] == (D(2000, 2, 29), None) and got["q", "6_10"] == (D(2006, 3, 1), D(2010, 2, 28)) and got["q", "cumulative"] == (D(2000, 3, 1), D(1999, 1, 1))
    daily = spark.createDataFrame([("a", day(k, D(2006, 3, 1)), k % 2) for k in range(100)], "city string, date date, n_obs int")
    c = {(x.ext_genid, x.window): x.coverage_frac for x in cohort.coverage_frac(w, daily).collect()}
    assert c["q", "cumulative"] == 0 and c["p", "0_5"] == 0 and abs(c["q", "6_10"] - 100 / 1461) < 1e-12 and c["r", "6_10"] == 0
    o = {(x.ext_genid, x.window): x.coverage_frac for x in cohort.coverage_frac(w, daily, observed_only=True).collect()}
    assert abs(o["q", "6_10"] - 50 / 1461) < 1e-12 and len(o) == 12


def test_prefix_sums_equal_the_range_join(spark):
    from swelter.operators import exposure, thresholds

    daily = _climate(spark)
    daily = daily.withColumn("tmax_daily", F.when(F.dayofmonth("date") != 7, F.col("tmax_daily")))
    daily = thresholds.exceedance(daily, thresholds.thresholds(daily, {"tmax": "tmax_daily"}), "tmax", "tmax_daily")
    spans = [(day(-9), day(5)), (day(3), day(3)), (day(390), day(900)), (day(0), day(399)), (day(500), day(600)), (day(9), day(2)), (day(6), day(6)), (day(50), None)]
    w = spark.createDataFrame([("a", *s) for s in spans], "city string, window_start date, window_end date")
    key = lambda x: (x.window_start, x.window_end)
    a, b = ({key(x): x for x in f(w, daily).collect()} for f in (exposure.window_climate, exposure.window_climate_by_join))
    assert set(a) == set(b) and len(a) == 5
    for k in a:
        for c in ("mean_tmax", "mean_tmean", "days_above_p90", "mean_humidity", "total_precip", "tmax_sd"):
            assert a[k][c] == b[k][c] or abs(a[k][c] - b[k][c]) < 1e-9, (k, c)


def test_overlaps_equal_all_pairs_by_brute_force(spark):
    import random

    from swelter.operators import exposure

    r = random.Random(3)
    windows = [("ab"[r.randrange(2)], day(lo), day(lo + r.randrange(-5, 400))) for lo in (r.randrange(900) for _ in range(80))] + [("a", day(3), None), ("c", day(0), day(90)), (None, day(0), day(90))]
    events = [("ab"[r.randrange(2)], day(lo), day(lo + n), n + 1, "d") for lo, n in ((r.randrange(900), r.choice([0, 1, 6, 45, 200])) for _ in range(60))]
    got = exposure.clip_events_to_windows(
        spark.createDataFrame(windows, "city string, window_start date, window_end date"), spark.createDataFrame(events, "city string, start date, end date, duration int, hw_def string")
    )
    want = [
        (c, a, z, s, e, max(a, s), min(z, e))
        for c, a, z in {w for w in windows if w[2] is not None and w[1] <= w[2]} for d, s, e, *_ in events if c == d and s <= z and e >= a
    ]
    assert len(want) > 500
    assert sorted(map(tuple, got.select("city", "window_start", "window_end", "start", "end", "clipped_start", "clipped_end").collect())) == sorted(want)


def test_observed_coverage_equals_a_count_of_days(spark):
    import random

    from swelter.operators import cohort

    r = random.Random(5)
    seen = {day(k): r.choice([0, 0, 3, None]) for k in range(300) if r.random() < 0.8}  # days may be missing altogether
    windows = [(k, "a", day(lo), day(lo + r.randrange(-3, 200))) for k, lo in enumerate(r.randrange(-100, 400) for _ in range(60))] + [(60, "b", day(0), day(9)), (61, None, day(0), day(9)), (62, "a", day(0), None)]
    w = spark.createDataFrame(windows, "person int, city string, window_start date, window_end date")
    daily = spark.createDataFrame([("a", d, n) for d, n in seen.items()], "city string, date date, n_obs int")
    got = {x.person: x.coverage_frac for x in cohort.coverage_frac(w, daily, observed_only=True).collect()}
    for k, c, a, z in windows:
        days = [a + dt.timedelta(n) for n in range((z - a).days + 1)] if z and c == "a" else []
        assert abs(got[k] - (sum((seen.get(d) or 0) > 0 for d in days) / len(days) if days else 0)) < 1e-12
    assert len(got) == 63


def test_ranks_over_several_ranges(spark):
    import numpy as np

    from swelter.operators.index import average_ranks

    g = np.random.default_rng(2)
    rows = [(["p", "q", "q"][k % 3], float(v)) for k, v in enumerate(g.integers(0, 700, 3000))]
    df = spark.createDataFrame(rows, "g string, x double")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = average_ranks(df, "x", "rank", ["g"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(got) == 3000 and (got.groupby("g").x.rank() == got["rank"]).all()


def test_clipped_events_and_empty_windows(spark):
    from swelter.operators import events, exposure, thresholds

    daily = _climate(spark)
    daily = thresholds.exceedance(daily, thresholds.thresholds(daily, {"tmax": "tmax_daily"}), "tmax", "tmax_daily")
    ev = spark.createDataFrame([("a", day(10), day(19), 10, "tmax_p90_d3", 2.0, 20.0, 60.0)], "city string, start date, end date, duration int, hw_def string, mean_excess double, degree_days double, mean_humidity double")
    w = spark.createDataFrame([(1, "a", day(12), day(14)), (2, "a", day(30), day(40)), (3, "a", day(5), None)], "ext_genid long, city string, window_start date, window_end date")
    got = {(x.ext_genid, x.hw_def): x for x in exposure.exposure_components(w, daily, ev, events.hw_definitions(spark, ("tmax",), (90.0,), (3,))).collect()}
    hit, none, null = (got[k, "tmax_p90_d3"] for k in (1, 2, 3))
    assert (hit.hw_count, hit.hw_total_days, hit.hw_degree_days, hit.hw_apparent_excess) == (1, 3, 6.0, None)
    days = [daily.where(F.col("date") == day(k)).first().precip_total for k in (12, 13, 14)]
    clim = {x.doy: x.clim_precip for x in exposure.precip_climatology(daily).collect()}
    assert abs(hit.precip_deficit - (sum(days) / 3 - sum(clim[k + 1] for k in (12, 13, 14)) / 3)) < 1e-12
    assert (none.hw_count, none.hw_total_days, none.hw_mean_excess) == (0, 0, None) and none.mean_tmax is not None
    assert (null.hw_count, null.mean_tmax) == (None, None)


def test_pivot_and_merge(spark):
    from swelter.operators import analytical

    long = spark.createDataFrame([(1, "6_10", 2.0), (1, "cumulative", 3.0), (2, "0_5", 1.0), (2, "11_18", 4.0)], "ext_genid long, window string, v double")
    wide = analytical.pivot_windows(long, ["v"])
    assert {tuple(x) for x in wide.collect()} == {(1, 2.0, None, 3.0), (2, None, 4.0, None)}
    cohort = spark.createDataFrame([(1, "w0"), (1, "w1"), (3, "w0")], "ext_genid long, wave string")
    births = spark.createDataFrame([(1, "a")], "ext_genid long, city string")
    out = analytical.merge_analytical(cohort, births, wide, wide.withColumnsRenamed({c: f"{c}_n" for c in wide.columns[1:]}))
    assert out.count() == 3 and out.where("city = 'a'").count() == 2
    with pytest.raises(ValueError):
        analytical.merge_analytical(cohort, births.unionByName(births), wide, wide)


def test_descriptives(spark):
    from swelter.operators import analytical

    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("a", 3.0, 3)], "city string, x double, y int")
    got = {x.variable: x for x in analytical.describe_long(df, ["y", "x"]).collect()}
    assert (got["x"].n_total, got["x"].n_nonmiss, got["x"].median, got["x"].position, got["y"].p25) == (3, 2, 2.0, 2, 1.5)


# ---- sources


HEADER = "".join(f"META{k}:;x\n" for k in range(8)) + "DATA (YYYY-MM-DD);HORA;P;" + ";" * 16 + "\n"


def test_read_hourly(spark, tmp_path):
    from swelter.sources import stations

    fields = ["2020/01/02", "00:00", "0,2", "990,1", "991", "-9999", "10", "21,5", "15", "22", ",8", "1,2,3", "9", "80", "70", "75", "180", "3", "2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "INMET_S_A801.CSV").write_bytes((HEADER + ";".join(fields) + ";\n" + ";".join(["bad"] + fields[1:]) + ";\n").encode("latin-1"))
    got = stations.read_hourly(spark, f"file://{tmp_path}/in", F.substring("file_name", 9, 4)).collect()
    assert len(got) == 1
    x = got[0]
    assert (x.date, x.hour_utc, x.precip_mm, x.pressure_min_mbar, x.tmin_c, x.dewpoint_max_c, x.city) == (D(2020, 1, 2), "00:00", 0.2, None, 0.8, None, "A801")


def test_archives_and_selection(spark, tmp_path):
    from swelter.sources import stations

    with zipfile.ZipFile(tmp_path / "2020.zip", "w") as z:
        z.writestr("INMET_S_A801_X_01-01-2020_A_31-12-2020.CSV", "á;1\nb;2\n".encode("latin-1"))
        z.writestr("INMET_S_B999.CSV", "x\n")
    got = stations.read_archives(spark, f"file://{tmp_path}/*.zip", "A801").orderBy("line_no").collect()
    assert [(x.line_no, x.line) for x in got] == [(0, "á;1"), (1, "b;2")]
    names = spark.createDataFrame([("INMET_A801_p.CSV", 2020), ("z_A801_a_31-12-2020.csv", 2020), ("INMET_A801_q.CSV", 2021)], "name string, year int")
    known = spark.createDataFrame([("s", "A801"), ("t", "B1")], "station string, code string")
    best = stations.select_station_files(names, known)
    assert {(x.station, x.year, x.name) for x in best.collect()} == {("s", 2020, "z_A801_a_31-12-2020.csv"), ("s", 2021, "INMET_A801_q.CSV")}
    missing = stations.check_station_years(best, known, spark.createDataFrame([(2020,), (2021,)], "year int"))
    assert {tuple(x) for x in missing.collect()} == {("t", 2020), ("t", 2021)}


def test_tables(spark, tmp_path):
    from swelter.sources import stations

    df = spark.createDataFrame([("a", day(0), True, 1.5), ("b", day(1), None, None)], "city string, date date, hw_day boolean, v double")
    stations.write_table(df, f"{tmp_path}/p")
    assert stations.read_table(spark, f"{tmp_path}/p").count() == 2
    stations.write_csv_table(df, f"{tmp_path}/c", small=True)
    back = stations.read_table(spark, f"{tmp_path}/c", "city string, date date, hw_day boolean, v double", "csv")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


# ---- entry


def test_entry(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and e.entry(spark).count() >= 0
    assert queries["calendar_keys"](spark, "/root/testdata/sf0.001").count() > 0


def test_joint_components_take_all_variables(spark):
    from swelter.plans import registry

    for name, k in (("joint_pca_loadings", 24), ("joint_pca_monthly_loadings", 29)):
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(got) == k * k and abs(sum({x.component: x.eigenvalue for x in got}.values()) - k) < k * 1e-6  # each rounded to 6 places
    assert registry.QUERIES["joint_pca_scores"](spark, "/root/testdata/sf0.001").where("PC4 IS NOT NULL").head(1)


def test_hot_ties_spread_over_tasks(spark, monkeypatch):
    """Nine tenths of the rows share one value: they are joined by broadcast, and both columns' ranks are right."""
    import random

    import pandas as pd

    from swelter.operators import index
    from swelter.sources import shared

    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    r = random.Random(4)
    rows = [("g" if k % 4 else "h", 5.0 if r.random() < 0.9 else float(r.randrange(40)), r.random() if r.random() < 0.5 else 0.25) for k in range(2000)] + [("c", 1.0, float(k)) for k in range(9)] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    ranked = index.average_ranks(df.where("x IS NOT NULL"), ["x", "y"], ["rx", "ry"], ["g"])
    assert "BroadcastHashJoin" in ranked._jdf.queryExecution().toString()
    got = ranked.toPandas()
    assert len(got) == 2009 and (got.groupby("g").x.rank() == got.rx).all() and (got.groupby("g").y.rank() == got.ry).all()
    want = pd.DataFrame(rows, columns=["g", "x", "y"]).dropna().groupby("g").apply(lambda p: p.x.rank().corr(p.y.rank()), include_groups=False)
    for x in index.spearman_by_group(df, "x", "y", ("g",)).collect():
        assert x.n == (9 if x.g == "c" else len([q for q in rows if q[0] == x.g])) and (x.spearman is None if x.g == "c" else abs(x.spearman - want[x.g]) < 1e-9)


def test_folders_are_removed_after_a_mark(spark, tmp_path):
    import os

    from swelter.sources import shared

    since = shared.mark()
    held = shared.written(spark.range(5), "some")
    path = held.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert held.count() == 5 and os.path.exists(path)
    shared.remove(spark, since)
    assert not os.path.exists(path) and shared.mark() == since


def test_seasonal_thresholds_slide_round_the_year(spark):
    """Against pooling each day's window by hand: leap days, a window over the year's end, days without a value, two series."""
    import random

    from swelter.operators import thresholds

    r = random.Random(6)
    rows = [(c, day(k), None if r.random() < 0.1 else r.random() * 40) for c in (*"ab", None) for k in range(0, 1600, 1 if c == "a" else 37)]
    df = spark.createDataFrame(rows, "city string, date date, tmax double")
    got = {(x.city, x.doy, x.percent): x.threshold for x in thresholds.thresholds(df, {"t": "tmax"}, (50.0, 95.0), mode="seasonal").collect()}
    want = {}
    for c in (*"ab", None):
        for doy in range(1, 367):
            own = sorted(v for d, t, v in rows if d == c and v is not None and min((t.timetuple().tm_yday - doy) % 366, (doy - t.timetuple().tm_yday) % 366) <= 7)
            for p in (50.0, 95.0):
                if own:
                    h = (len(own) - 1) * p / 100
                    want[c, doy, p] = own[int(h)] + (own[min(int(h) + 1, len(own) - 1)] - own[int(h)]) * (h - int(h))
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_without_a_correlation_matrix_the_components_are_null(spark):
    """No complete row, one row, and a column that is constant over all of them."""
    from swelter.operators import pca

    for rows in ([(1.0, None), (None, 2.0)], [(1.0, 2.0)], [(1.0, 2.0), (3.0, 2.0), (4.0, 2.0)]):
        df = spark.createDataFrame(rows, "x double, y double")
        loadings, model = pca.fit_pca(df, ["x", "y"])
        assert sorted((r.variable, r.component, r.loading, r.share) for r in loadings.collect()) == [(v, k, None, None) for v in "xy" for k in (1, 2)]
        scores = pca.orient(pca.pca_scores(df, model, 2), loadings, {"up": (1, "y")}).collect()
        assert [(r.PC2, r.up) for r in scores] == [(None, None)] * df.dropna().count()
        assert sorted(map(tuple, pca.component_correlations(loadings).collect())) == [("x", None, None), ("y", None, None)]


def test_component_queries_where_a_measure_is_the_same_on_all_days(spark, tmp_path):
    """Its z-score is null, so no row is complete: with many readings a day, the least humidity is that of the smallest reading each day."""
    import os

    from swelter.plans import registry

    d = "/root/testdata/sf0.001"
    for name in os.listdir(d):
        os.symlink(f"{d}/{name}", tmp_path / name)
    (tmp_path / "lineitem.parquet").unlink()
    spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("* EXCEPT (l_quantity)", "7D AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {q: registry.QUERIES[q](spark, str(tmp_path)).collect() for q in ("labelled_loadings", "component_circle", "joint_pca_check", "component_years", "component_months")}
    assert {k: len(v) for k, v in got.items()} == {"labelled_loadings": 48, "component_circle": 24, "joint_pca_check": 1, "component_years": 0, "component_months": 0}
    assert all(r.loading is None and r.share is None and r.label for r in got["labelled_loadings"]) and all(r.x is None for r in got["component_circle"])
    assert tuple(got["joint_pca_check"][0]) == (24, 24.0, None, 0.0, 0.0, 1.0)  # the SQL's row


def test_definitions_are_repeated_after_the_joins(spark):
    """No join shuffles a row for each window and definition: the repetition is above every join of windows."""
    from swelter.operators import events, exposure, thresholds

    daily = _climate(spark)
    daily = thresholds.exceedance(daily, thresholds.thresholds(daily, {"tmax": "tmax_daily"}), "tmax", "tmax_daily")
    ev = spark.createDataFrame([("a", day(10), day(19), 10, "tmax_p90_d3", 2.0, 20.0, 60.0)], "city string, start date, end date, duration int, hw_def string, mean_excess double, degree_days double, mean_humidity double")
    w = spark.createDataFrame([(1, "a", day(12), day(14)), (1, "a", day(30), day(40))], "ext_genid long, city string, window_start date, window_end date")
    plan = exposure.exposure_components(w, daily, ev, events.hw_definitions(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_a_constant_has_no_z_score_and_no_components_however_its_rows_are_dealt(spark):
    """Deviations merged over tasks miss 0 by rounding (1 over 3 tasks, 13.7 over 51), which gave z-scores and components made of it."""
    from swelter.operators import features, pca

    for value, tasks in ((1.0, 3), (13.7, 51)):
        df = spark.range(7497, numPartitions=tasks).selectExpr("id % 3 AS city", f"IF(id >= 0, {value}D, NULL) AS h", "CAST(id * 7919 % 7497 AS DOUBLE) AS x")
        z = features.zscore_within(df, ["h", "x"])
        assert z.where("h IS NOT NULL OR x IS NULL").count() == 0
        loadings, model = pca.fit_pca(df, ["h", "x"])
        assert {(r.loading, r.eigenvalue) for r in loadings.collect()} == {(None, None)} and model[1] is None


def test_exposure_values_are_rounded_before_they_are_repeated_for_each_definition(spark):
    from swelter.plans import registry

    plan = registry.QUERIES["exposure_components"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "round(" not in above and "round(" in below


def test_index_reads_only_covered_rows_and_its_own_columns(spark):
    from swelter.operators import index
    from swelter.plans import registry

    rows = registry._index_components(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["ext_genid", *index.GROUP, "coverage_frac", *index.METRICS]
    assert rows.where("window = '0_5' OR coverage_frac < 0.5").count() == 0 < rows.count()


def test_equal_pairs_are_ranked_once_by_weight(spark):
    from swelter.operators import index

    pairs = [("g", float(k * k % 7), float(k % 5), k % 4 + 1) for k in range(35)] + [("tied", 2.0, float(k), 3) for k in range(4)]
    once = spark.createDataFrame(pairs, "g string, x double, y double, w long")
    each = once.selectExpr("g", "x", "y", "explode(sequence(1, w)) AS k").drop("k")
    weighted = index.average_ranks(once, ["x", "y"], ["rx", "ry"], ["g"], "w").select("g", "x", "y", "rx", "ry").distinct()
    assert sorted(map(tuple, weighted.collect())) == sorted(map(tuple, index.average_ranks(each, ["x", "y"], ["rx", "ry"], ["g"]).distinct().collect()))
    got = {r.g: (r.spearman, r.n) for r in index.spearman_by_group(each, "x", "y", ("g",)).collect()}
    pdf = each.where("g = 'g'").toPandas()
    assert abs(got["g"][0] - pdf["x"].rank().corr(pdf["y"].rank())) < 1e-12 and got["g"][1] == len(pdf) and got["tied"] == (None, 12)
