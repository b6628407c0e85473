"""Range queries over events against the join form."""

import datetime as dt
import random

from pyspark.sql import functions as F

DAY0 = dt.date(2007, 11, 20)


def day(k):
    return DAY0 + dt.timedelta(k)


def doys(a, b):
    return {(a + dt.timedelta(k)).timetuple().tm_yday for k in range((b - a).days + 1)}


def test_sets_of_days_of_the_year(spark):
    from swelter.operators import event_ranges as R

    r = random.Random(1)
    pairs = [(day(lo), day(lo + n)) for lo in (r.randrange(4000) for _ in range(120)) for n in [r.choice([-1, 0, 1, 40, 59, 60, 200, 364, 365, 366, 700, 1500, 3700])]]
    pairs += [(dt.date(2001, 12, 31), dt.date(2003, 1, 1)), (dt.date(2003, 12, 31), dt.date(2005, 1, 1)), (dt.date(2008, 2, 29), dt.date(2008, 12, 31)), (dt.date(1896, 12, 30), dt.date(1904, 1, 1)), (None, day(1))]
    for x in spark.createDataFrame(pairs, "a date, b date").select("a", "b", R.days_of_year("a", "b").alias("s")).collect():
        got = {k * R.BITS + b + 1 for k, word in enumerate(x.s) for b in range(R.BITS) if word >> b & 1}
        assert got == (doys(x.a, x.b) if x.a and x.b and x.a <= x.b else set()), x


def test_metrics_and_deficit_equal_the_join_form(spark):
    from swelter.operators import event_ranges, exposure

    r = random.Random(2)
    daily = [("ab"[k % 2], day(k // 2), None if r.random() < 0.1 else r.random() * 30) for k in range(2 * 2400)]
    events = []
    for city in "abc":
        for hw_def, gap, longest in (("tmax_p90_d2", 12, 9), ("apparent_p95_d3", 90, 25), ("tmax_p90_d5", 700, 500), ("apparent_p90_d2", 1, 2)):
            at = r.randrange(200)
            while at < 2100:
                n = r.randrange(1, longest + 1)
                excess = None if r.random() < 0.05 else r.random() * 5
                events.append((city, day(at), day(at + n - 1), n, hw_def, excess, r.random() * 9 * n, None if r.random() < 0.2 else r.random() * 100))
                at += n + 1 + r.randrange(gap)
    windows = [("ab"[r.randrange(2)], day(lo), day(lo + r.choice([-2, 0, 1, 5, 30, 200, 900, 2000]))) for lo in (r.randrange(-100, 2400) for _ in range(150))]
    windows += [("a", day(-500), day(-400)), ("a", day(2390), day(4000)), ("a", day(3), None), ("d", day(0), day(90)), (None, day(0), day(90)), ("b", day(-500), day(9000))]
    w = spark.createDataFrame(windows, "city string, window_start date, window_end date")
    d = spark.createDataFrame(daily, "city string, date date, precip_total double")
    e = spark.createDataFrame(events, "city string, start date, end date, duration int, hw_def string, mean_excess double, degree_days double, mean_humidity double")
    e = e.where("city <> 'c'").unionByName(e.where("false"))
    key = lambda x: (x.city, x.window_start, x.window_end, x.hw_def)
    clipped = exposure.clip_events_to_windows(w, e)
    plain, fallen = ({key(x): x for x in df.collect()} for df in (exposure.window_heatwave_metrics_by_join(clipped), exposure.precip_deficit_by_join(clipped, d)))
    got = {key(x): x for x in event_ranges.window_event_metrics(w, d, e).collect()}
    assert set(got) == set(plain) and len(got) > 300
    names = [c for c in next(iter(plain.values())).asDict() if c.startswith("hw_") and c != "hw_def"]
    for k, x in got.items():
        for c in names:
            a, b = x[c], plain[k][c]
            assert a == b or a is not None and b is not None and abs(a - b) < 1e-7, (k, c, a, b)
        a, b = x.precip_deficit, fallen[k].precip_deficit
        assert a == b or abs(a - b) < 1e-7, (k, a, b)
    narrow = event_ranges.window_event_metrics(w, d, e, deficit=False)
    assert narrow.count() == len(got) and "precip_deficit" not in narrow.columns
    text = narrow._jdf.queryExecution().toString()
    assert "sequence(window_start" not in text and "clipped" not in text


def test_no_events_and_no_windows(spark):
    from swelter.operators import event_ranges

    w = spark.createDataFrame([("a", day(0), day(9))], "city string, window_start date, window_end date")
    d = spark.createDataFrame([("a", day(1), 2.0)], "city string, date date, precip_total double")
    e = spark.createDataFrame([("a", day(1), day(1), 1, "tmax_p90_d2", 1.0, 1.0, 5.0)], "city string, start date, end date, duration int, hw_def string, mean_excess double, degree_days double, mean_humidity double")
    assert event_ranges.window_event_metrics(w, d, e.where("false")).count() == 0 and event_ranges.window_event_metrics(w.where("false"), d, e).count() == 0
    x = event_ranges.window_event_metrics(w, d, e).first()
    assert (x.hw_count, x.hw_total_days, x.precip_deficit) == (1, 1, 0.0)
    assert event_ranges.window_event_metrics(w, d.withColumn("precip_total", F.lit(None).cast("double")), e).first().precip_deficit is None


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=top, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 80, done.stderr
