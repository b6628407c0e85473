"""Exact quantiles of groups of any size.

Spark's `percentile` holds a group's distinct values in one task. That serves groups of up to LARGE rows. In larger groups the values of the wanted
ranks are selected: a sketch of the group (approx_percentile, which tasks make and merge) brackets each rank between two of its
values, a scan counts what lies below, at and between them, and the search goes on between the two with a sketch made in the same scan, until a rank falls on a
bracket's end or few values are left, which are gathered. Counts are exact, so the result is, whatever the sketch's error: a rank that it
misplaced is looked for on the side where the counts put it. Each scan leaves about a hundredth of the values between brackets. Only
one small row a group and scan is moved, so no task holds a group.

Quantiles interpolate linearly between neighbours, and nulls don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.sources import shared

#: Rows up to which a group's quantiles are made by `percentile`; values between brackets that are gathered.
LARGE, GATHER = 1_000_000, 4_096
#: Values that a sketch gives, and its accuracy.
SPLITS, ACCURACY = 200, 10_000


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__right_{k}" for k in keys])


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, [k / SPLITS for k in range(SPLITS + 1)], ACCURACY)


def _bracketed(t: Column) -> Column:
    """The next bracket (a, b) of a target from the sketch of its interval, two of the sketch's values beyond its rank."""
    at = lambda k: F.element_at(t["sketch"], F.greatest(F.lit(1), F.least(F.lit(SPLITS + 1), k)).cast("int"))
    share = t["k"] / F.greatest(t["m"], F.lit(1)) * SPLITS
    return t.withField("a", at(F.floor(share) - 1)).withField("b", at(F.ceil(share) + 3))


def _select(own: DataFrame, large: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """keys and a column for each name in ranks: the value of that rank (from 0, over `n`, a column of large). own: keys and value (no nulls) of the large groups."""
    names, v = list(ranks), F.col("value")
    first = own.groupBy(*keys).agg(_sketch(v).alias("sketch"))
    none = F.lit(None).cast("double")
    state = _same(large, first, keys).select(
        *keys, *[F.struct(none.alias("lo"), none.alias("hi"), r.cast("long").alias("k"), F.col("n").alias("m"), none.alias("a"), none.alias("b"), "sketch", none.alias("found")).alias(t) for t, r in ranks.items()]
    )
    state = shared.written(state.select(*keys, *[_bracketed(F.col(t)).alias(t) for t in names]), "ranks")
    is_open = lambda t: F.col(f"{t}.found").isNull()
    any_open = is_open(names[0])
    for t in names[1:]:
        any_open = any_open | is_open(t)
    while True:
        left = state.where(any_open)
        if not left.head(1):
            return state.select(*keys, *[F.col(f"{t}.found").alias(t) for t in names])
        both, aggs = _same(own, shared.small(left), keys), []
        for t in names:
            s = lambda f: F.col(f"{t}.{f}")  # noqa: B023, E731
            above, below = s("lo").isNull() | (v > s("lo")), s("hi").isNull() | (v < s("hi"))
            use, few = above & below & is_open(t), s("m") <= GATHER
            between = use & ~few & (v > s("a")) & (v < s("b"))
            count = lambda c: F.count_if(c)
            aggs += [
                count(use & (v < s("a"))).alias(f"{t}_low"), count(use & (v == s("a"))).alias(f"{t}_at_a"), count(between).alias(f"{t}_mid"), count(use & (v == s("b")) & (s("a") < s("b"))).alias(f"{t}_at_b"),
                count(use).alias(f"{t}_all"), _sketch(F.when(between, v)).alias(f"{t}_sketch"), F.collect_list(F.when(use & few, v)).alias(f"{t}_few"),
            ]
        counted = shared.written(_same(left, both.groupBy(*keys).agg(*aggs), keys), "counts")
        # where the counts put the rank on a side that the sketch had missed, there is no sketch of that side yet
        missing, done = [], []
        for t in names:
            c = lambda f: F.col(f"{t}_{f}")  # noqa: B023, E731
            x, k = F.col(t), F.col(f"{t}.k")
            upto_a, upto_mid = c("low") + c("at_a"), c("low") + c("at_a") + c("mid")
            upto_b = upto_mid + c("at_b")
            no_sketch = F.lit(None).cast("array<double>")
            low = x.withField("hi", x["a"]).withField("m", c("low")).withField("sketch", no_sketch)
            mid = x.withField("lo", x["a"]).withField("hi", x["b"]).withField("k", k - upto_a).withField("m", c("mid")).withField("sketch", c("sketch"))
            high = x.withField("lo", x["b"]).withField("k", k - upto_b).withField("m", c("all") - upto_b).withField("sketch", no_sketch)
            few = F.when(x["m"] <= GATHER, F.element_at(F.sort_array(c("few")), (k + 1).cast("int")))
            found = F.coalesce(x["found"], few, F.when((k >= c("low")) & (k < upto_a), x["a"]).when((k >= upto_mid) & (k < upto_b), x["b"]))
            done.append(F.when(found.isNotNull(), x.withField("found", found)).when(k < c("low"), low).when(k < upto_mid, mid).otherwise(high).alias(t))
            missing.append(is_open(t) & F.col(f"{t}.sketch").isNull() & (F.col(f"{t}.m") > GATHER))
        moved = shared.written(counted.select(*keys, *done), "ranks")
        lost = missing[0]
        for m in missing[1:]:
            lost = lost | m
        if moved.where(lost).head(1):
            again = _same(own, shared.small(moved.where(lost)), keys)
            inside = lambda t: (F.col(f"{t}.lo").isNull() | (v > F.col(f"{t}.lo"))) & (F.col(f"{t}.hi").isNull() | (v < F.col(f"{t}.hi")))
            sketches = again.groupBy(*keys).agg(*[_sketch(F.when(inside(t), v)).alias(f"{t}_sketch") for t in names])
            moved = _same(moved, sketches, keys, "left").select(*keys, *[F.when(F.col(f"{t}.sketch").isNull(), F.col(t).withField("sketch", F.col(f"{t}_sketch"))).otherwise(F.col(t)).alias(t) for t in names])
        state = shared.written(state.where(~any_open).unionByName(moved.select(*keys, *[_bracketed(F.col(t)).alias(t) for t in names])), "ranks")


def grouped(df: DataFrame, keys: list[str], value: str, probs: list[float], aggs: list[Column], name: str = "q") -> DataFrame:
    """keys, the aggregates and `name`, an array of the quantiles of value at probs (null for groups without a value). aggs may use keys and value only."""
    keys = list(keys)
    rows = shared.written(df.select(*keys, F.col(value).cast("double").alias(value)), "values")
    sizes = shared.written(rows.groupBy(*keys).agg(F.count(value).alias("n")), "sizes")
    large = sizes.where(F.col("n") > LARGE)
    plain = lambda part: part.groupBy(*keys).agg(*aggs, F.percentile(value, F.array(*map(F.lit, probs))).alias(name))
    if not large.head(1):
        return plain(rows)
    rest = _same(rows, shared.small(large.select(*keys)), keys, "left_anti")
    own = _same(rows, shared.small(large.select(*keys)), keys, "left_semi")
    at = {f"t{k}": (F.col("n") - 1) * p for k, p in enumerate(probs)}
    ranks = {f"{t}_{side}": f(x) for t, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = _select(own.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value")), large, keys, ranks)
    weights = _same(large, found, keys)
    q = F.array(*[F.col(f"{t}_lo") + (F.col(f"{t}_hi") - F.col(f"{t}_lo")) * (x - F.floor(x)) for t, x in at.items()])
    chosen = weights.select(*keys, q.alias(name))
    if aggs:
        chosen = _same(own.groupBy(*keys).agg(*aggs), chosen, keys)
    return plain(rest).unionByName(chosen)
