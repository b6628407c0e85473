"""Quantiles by selection against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F


def brute(values, p):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    h = (len(values) - 1) * p
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return lo + (hi - lo) * (h - math.floor(h))


@pytest.mark.parametrize("gather, splits", [(4096, 200), (60, 20)])
def test_selected_quantiles_equal_sorted_ones(spark, monkeypatch, gather, splits):
    from swelter.operators import quantiles as Q

    monkeypatch.setattr(Q, "LARGE", 30)
    monkeypatch.setattr(Q, "GATHER", gather)
    monkeypatch.setattr(Q, "SPLITS", splits)
    r = random.Random(1)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(3000)], "heavy": [r.paretovariate(0.3) ** 9 for _ in range(700)], "ties": [r.choice([1.0, 2.0]) for _ in range(900)], "mostly": [5.0] * 900 + [r.random() for _ in range(100)],
        "one": [3.0], "constant": [2.5] * 500, "nulls": [None] * 40, "some": [None if r.random() < 0.5 else float(k) for k in range(200)], None: [float(-k) for k in range(100)], "tiny": [1.0, 2.0, 4.0, 10.0], "two": [0.0] * 50 + [1.0] * 50,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = Q.grouped(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", probs, [F.count("v").alias("n"), F.max("v").alias("top")]).collect()
    assert {x.g for x in got} == set(groups) and len(got) == len(groups)
    for x in got:
        own = [v for v in groups[x.g] if v is not None]
        assert x.n == len(own) and x.top == max(own, default=None)
        assert (x.q or [None] * 5) == pytest.approx([brute(own, p) for p in probs]) if own else not any(x.q or [])


def test_a_rank_that_the_sketch_misplaces_is_found_by_the_counts(spark, monkeypatch):
    from swelter.operators import quantiles as Q

    monkeypatch.setattr(Q, "LARGE", 10)
    monkeypatch.setattr(Q, "GATHER", 150)
    monkeypatch.setattr(Q, "_sketch", lambda v: F.transform(F.sequence(F.lit(0), F.lit(Q.SPLITS)), lambda k: F.min(v) + (F.max(v) - F.min(v)) * F.pow(k / Q.SPLITS, F.lit(3.0))))
    values = [float(k) for k in range(500)]
    got = Q.grouped(spark.createDataFrame([(1, v) for v in values], "g int, v double"), ["g"], "v", [0.77], []).first()
    assert got.q == pytest.approx([brute(values, 0.77)])


def test_an_empty_table_and_two_keys(spark, monkeypatch):
    from swelter.operators import quantiles as Q

    assert Q.grouped(spark.createDataFrame([], "g int, v double"), ["g"], "v", [0.5], []).count() == 0
    monkeypatch.setattr(Q, "LARGE", 2)
    rows = [(a, b, float(a * 10 + b * k)) for a in range(3) for b in range(3) for k in range(7)]
    got = Q.grouped(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"], "v", [0.5], [F.count(F.lit(1)).alias("n")]).collect()
    assert sorted((x.a, x.b, x.n, x.q[0]) for x in got) == sorted((a, b, 7, float(a * 10 + b * 3)) for a in range(3) for b in range(3))


def test_the_plan_holds_no_group_in_a_task(spark, monkeypatch):
    from swelter.operators import quantiles as Q

    monkeypatch.setattr(Q, "LARGE", 10)
    df = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") % 977).cast("double").alias("v"))
    own = df.select("g", F.col("v").alias("value"))
    out = Q._select(own, own.groupBy("g").agg(F.count("value").alias("n")), ["g"], {"t": F.col("n") - 1})
    assert out.first().t == 976.0
    assert "percentile(" not in out._jdf.queryExecution().toString()
