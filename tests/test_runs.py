"""Runs of days, found in chunks."""

import datetime as dt
import random


def day(k):
    return dt.date(1995, 3, 7) + dt.timedelta(k)


def test_runs_in_chunks_equal_whole_runs(spark):
    from swelter.operators import events

    r = random.Random(1)
    rows, at = [], 0
    for city in (*"ab", None):
        on = False
        for k in range(700):
            if r.random() < (0.05 if city == "a" else 0.3):
                on = not on
            if r.random() < 0.97:  # days may be missing: a run ends there
                rows.append((city, day(k + at), on if r.random() < 0.98 else None, r.random() if r.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "city string, date date, hot boolean, v double")
    want = {}
    for city in (*"ab", None):
        held = {d: v for c, d, hot, v in rows if c == city and hot}
        for d in held:
            if d - dt.timedelta(1) not in held:
                run = [d]
                while run[-1] + dt.timedelta(1) in held:
                    run.append(run[-1] + dt.timedelta(1))
                want[city, d] = (run[-1], len(run), [held[x] for x in run if held[x] is not None])
    assert max(n for _, n, _ in want.values()) > 30  # over three chunks and more of the shorter ones
    for chunk in (1, 7, 10, 97, 5000):
        got = events.runs_in_chunks(df, "hot", ["city"], {"top": "v"}, {"mean": "v"}, {"sum": "v"}, chunk_days=chunk).collect()
        assert len(got) == len(want)
        for x in got:
            end, n, values = want[x.city, x.start]
            assert (x.end, x.duration) == (end, n) and x.top == max(values, default=None)
            assert x["sum"] is None and x["mean"] is None if not values else abs(x["sum"] - sum(values)) < 1e-9 and abs(x["mean"] - sum(values) / len(values)) < 1e-9


def test_no_run(spark):
    from swelter.operators import events

    df = spark.createDataFrame([("a", day(0), False, 1.0), ("a", day(1), None, 1.0)], "city string, date date, hot boolean, v double")
    assert events.runs_in_chunks(df, "hot", ["city"], {"top": "v"}, {}, {}).count() == 0 and events.runs_in_chunks(df.limit(0), "hot", ["city"], {}, {}, {}).count() == 0
