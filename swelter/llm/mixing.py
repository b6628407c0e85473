"""Mixing sources to target weights by entropy balancing.

The rates minimise the token-weighted relative entropy to the corpus, subject to token totals by source, which
are met exactly, and by language, which may give way: a language's total b may miss by b * SOFT * mu, where mu is
its multiplier (a quadratic penalty in the primal). Rates end at most_rate. The dual is convex: minimise
sum(tokens * psi(lambda + mu)) - sum(lambda * a) - sum(mu * b) + SOFT / 2 * sum(b * mu^2), where psi is the
exponential, continued as a straight line where it reaches most_rate. A document's rate is then the exponential
tilt exp(lambda of its source + mu of its language), at most most_rate.

Newton runs on the joint dual with its full Hessian. Its source block is diagonal and is eliminated on the executors,
so sources may be many; what is left has a row for each language (those with the fewest words are one where there are over MOST_VALUES), is summed by executors from the
corpus' cells (distinct pairs of source and language, which one pre-aggregating shuffle makes) and solved by the driver.
A step is halved until the dual falls enough; steps that run out are an error.

Rates become copies: the whole part for every document, and one more for those of each source that come first in
the order of hash / fractional rate (sequential Poisson sampling), up to the place where the source's fractional
tokens are met. That place is found by histograms of PLACES ranges, one inside the other, so no task holds a hot source.

Nulls: a null text has no words, null sources and languages are values of their own, a null doc_id hashes as
the empty string. Rows that repeat a doc_id hash alike and are taken alike. Empty tables give empty
results. Other columns are returned as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Characters that separate words; a word is a run of others.
WORD = "[^\\x20\\x09-\\x0D]+"
#: How far languages give way; Newton steps at most; the relative gap that ends them; values of the eliminated system at most.
SOFT, MOST_STEPS, GAP, MOST_VALUES = 0.1, 60, 1e-11, 500
#: Ranges of a histogram level.
PLACES = 4096
_STEPS = [2.0**-k for k in range(12)]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_hash(key: Column) -> Column:
    """48 bits of md5 of the key's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets_by_cycle(sizes: DataFrame, group: str, size: str, weights=(5, 2, 1), total_share: float = 1.5, most_rate: float = 2.0) -> DataFrame:
    """sizes (a row for each group) with target: groups by code point, null last, have the weights in turn and
    share total_share of all sizes; a group stops at most_rate times its size and the rest share its excess by weight.

    A group's place in the order is its place in a range of the sorted table plus the rows of the ranges before, of which
    there are as many as shuffle partitions. Resharing ends at min(limit, level * weight) with one level for all; each
    round takes the groups that are full at the present level out of the sharing, until no more fill up."""
    in_order = F.col(group).asc_nulls_last()
    placed = scratch.written(sizes.repartitionByRange(in_order).sortWithinPartitions(in_order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("before") + inside, F.lit(len(weights))).cast("int") + 1)
    g = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("weight", weight).withColumn("limit", F.col(size) * most_rate)
    g = scratch.written(g.select(*sizes.columns, "weight", "limit"), "weights")
    level = n_full = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("limit")
        total, n, held, shared = g.agg(
            F.sum(size) * total_share, F.count_if(full), F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == n_full or not shared:
            break
        n_full, level = n, (total - held) / shared
    share = F.col("limit") if level is None else F.least(F.col("limit"), F.col("weight") * level)
    return g.select(*sizes.columns, share.alias("target"))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x of matrix x = right, by elimination with the largest pivot. The matrix is positive definite."""
    rows, n = [[*r, y] for r, y in zip(matrix, right)], len(right)
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(k + 1, n):
            f = rows[i][k] / rows[k][k]
            if f:
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    x = [0.0] * n
    for k in reversed(range(n)):
        x[k] = (rows[k][n] - sum(rows[k][j] * x[j] for j in range(k + 1, n))) / rows[k][k]
    return x


def balance(cells: DataFrame, by: str, soft_by: str | None = None, tokens: str = "tokens", target: str = "target", most_rate: float = 2.0, soft: float = SOFT) -> DataFrame:
    """cells with rate. cells: a row for each pair of `by` and `soft_by`, with its tokens and the target of its `by`
    value. The targets of soft_by keep the values' shares of all tokens. Of more than MOST_VALUES values those with the fewest tokens are one: they
    share a target, and a source's rate is the same for all of them. Sources without tokens have rate 1."""
    spark, top = cells.sparkSession, float(most_rate)
    values, rest = [None], False
    if soft_by:
        largest = cells.groupBy(soft_by).agg(F.sum(tokens).alias("__t")).orderBy(F.desc_nulls_last("__t"), soft_by).select(soft_by).head(MOST_VALUES + 1)
        rest = len(largest) > MOST_VALUES
        values = [r[0] for r in (largest[: MOST_VALUES - 1] if rest else largest)]
    values.sort(key=lambda v: (v is None, v))
    n, of_source = len(values) + rest, Window.partitionBy(by)
    named = F.coalesce(F.concat(F.lit("v"), F.col(soft_by).cast("string")), F.lit("null")) if soft_by else F.lit("null")
    listed = F.array(*[F.coalesce(F.concat(F.lit("v"), F.lit(v).cast("string")), F.lit("null")) for v in values]) if values else F.array().cast("array<string>")
    place = F.array_position(listed, named) - 1
    number = F.when(place >= 0, place).otherwise(n - 1) if rest else place
    start = cells.select(
        *cells.columns, number.cast("int").alias("__k"), F.col(tokens).cast("double").alias("__t"), F.col(target).cast("double").alias("__a"), F.sum(F.col(tokens).cast("double")).over(of_source).alias("__size"),
    )
    # sources at a bound of their rates are settled; the others start where their total is met without any tilt by language
    settled = F.when(F.col("__size") <= 0, 1.0).when(F.col("__a") <= 0, 0.0).when(F.col("__a") >= top * F.col("__size") * (1 - 1e-12), top)
    log_rate = F.when(F.col("__fixed").isNull(), F.log(F.col("__a") / F.col("__size"))).otherwise(0.0)
    # __l is lambda, __e lambda + mu
    start = start.withColumn("__fixed", settled).withColumn("__l", log_rate).withColumn("__e", log_rate)
    since = scratch.mark()
    state = scratch.written(start, "balance-0")
    shares = {r[0]: r[1:] for r in state.groupBy("__k").agg(F.sum("__t"), F.sum(F.col("__a") * F.try_divide("__t", "__size"))).collect()}
    total_t, total_a = (sum(r[k] or 0.0 for r in shares.values()) for k in (0, 1))
    if not total_t or not total_a:
        scratch.remove(spark, since, keep=("balance-0",))
        return state.select(*cells.columns, F.coalesce("__fixed", F.lit(1.0)).alias("rate"))
    # values without tokens get a target that keeps the system regular and changes nothing
    b, mu = [(shares.get(k, (0.0,))[0] or 1e-300) * total_a / total_t for k in range(n)], [0.0] * n

    for step in range(1, MOST_STEPS + 2):
        gap, system = _newton_system(state, by, top, n, rest)
        grad = [system.get((k, -1), 0.0) - b[k] * (1 - soft * mu[k]) for k in range(n)] if soft_by else [0.0]
        gap = max([gap, *[abs(x) / y for x, y in zip(grad, b) if y > 1e-200]])
        if gap < GAP:
            break
        if step > MOST_STEPS:
            raise RuntimeError(f"entropy balancing: a relative gap of {gap:.1e} is left after {MOST_STEPS} Newton steps")
        # Newton's system with the sources eliminated: (E - B' B / D) dmu = -g + B' g / D
        matrix = [[(system.get((i, -2), 0.0) + (soft + 1e-9) * b[i] if i == j else 0.0) - system.get((i, j), 0.0) for j in range(n)] for i in range(n)]
        dmu = _solved(matrix, [system.get((i, -3), 0.0) - grad[i] for i in range(n)]) if soft_by else [0.0]
        # and each source's own part of the step: -(g + sum of h dmu) / d
        along = F.element_at(F.split(F.lit(",".join(map(repr, dmu))), ","), F.col("__k") + 1).cast("double")
        m, h = _mass_and_curvature(top)
        own = -(F.sum(m).over(of_source) - F.col("__a") + F.sum(h * F.col("__dm")).over(of_source)) / (F.sum(h).over(of_source) + 1e-9 * F.col("__size"))
        moved = state.withColumn("__dm", along).withColumn("__dl", F.when(F.col("__fixed").isNull(), F.least(F.lit(4.0), F.greatest(F.lit(-4.0), own))).otherwise(0.0))
        moved = scratch.written(moved, f"balance-{step}")
        heights = _dual_along(moved, top)
        heights = {s: x + sum(soft / 2 * b[k] * (mu[k] + s * dmu[k]) ** 2 - b[k] * (mu[k] + s * dmu[k]) for k in range(n) if soft_by) for s, x in heights.items()}
        size = next((s for s in _STEPS if heights[s] <= heights[0.0] + 1e-13 * abs(heights[0.0])), _STEPS[-1])
        mu = [m + size * x for m, x in zip(mu, dmu)]
        state = moved.withColumn("__l", F.col("__l") + size * F.col("__dl")).withColumn("__e", F.col("__e") + size * (F.col("__dl") + F.col("__dm"))).drop("__dl", "__dm")
        scratch.remove(spark, since, keep=(f"balance-{step}",))
    rate = F.coalesce("__fixed", F.least(F.lit(top), F.exp("__e")))
    near = F.round(rate)
    return state.select(*cells.columns, F.when(F.abs(rate - near) < 1e-9, near).otherwise(rate).alias("rate"))


def _mass_and_curvature(top: float) -> tuple[Column, Column]:
    """A cell's tokens at its present rate, and their derivative by the log rate."""
    e, t, free = F.exp("__e"), F.col("__t"), F.col("__fixed").isNull()
    return F.coalesce("__fixed", F.least(F.lit(top), e)) * t, F.when(free & (e < top), e * t).otherwise(0.0)


def _newton_system(state: DataFrame, by: str, top: float, n: int, merged: bool = False) -> tuple[float, dict]:
    """The largest relative gap of a source, and sums by (i, j): values (i, -1) mass, (i, -2) curvature, (i, -3) the
    sources' part of the right side, (i, j) their part of the matrix. A source sends at most n * n numbers. merged: a source may have several cells of one value."""
    m, h = _mass_and_curvature(top)
    if merged:
        state = state.groupBy(by, "__k").agg(F.sum(m).alias("__m"), F.sum(h).alias("__h"), *[F.first(c).alias(c) for c in ("__fixed", "__size", "__a")])
        m, h = F.col("__m"), F.col("__h")
    cell = F.struct(F.col("__k").alias("k"), m.alias("m"), h.alias("h"))
    free = F.first(F.col("__fixed").isNull())
    # a source whose cells are all at the top rate has no curvature: a little keeps its block regular
    sources = state.groupBy(by).agg(
        F.when(free, F.sum(h) + 1e-9 * F.first("__size")).otherwise(1.0).alias("d"), F.when(free, F.sum(m) - F.first("__a")).otherwise(0.0).alias("g"), F.first("__a").alias("a"), F.collect_list(cell).alias("row"),
    )
    entry = "named_struct('i', {}, 'j', {}, 'v', {})"
    alone = F.expr(f"flatten(transform(row, x -> array({entry.format('x.k', -1, 'x.m')}, {entry.format('x.k', -2, 'x.h')}, {entry.format('x.k', -3, 'x.h * g / d')})))")
    pairs = F.expr(f"flatten(transform(row, x -> transform(row, y -> {entry.format('x.k', 'y.k', 'x.h * y.h / d')})))")
    gap = F.expr(f"array({entry.format(-4, -4, 'coalesce(abs(try_divide(g, a)), 0D)')})")
    sums = sources.select(F.explode(F.concat(alone, pairs, gap)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v"), F.max("e.v").alias("most"))
    found = {(r.i, r.j): r for r in sums.collect()}
    return found.pop((-4, -4)).most, {k: r.v for k, r in found.items()}


def _dual_along(moved: DataFrame, top: float) -> dict[float, float]:
    """The dual at each trial step, without the languages' own terms; settled sources add their mass times mu."""
    s = F.col("s")
    e = F.col("__e") + s * (F.col("__dl") + F.col("__dm"))
    psi = F.when(F.exp(e) < top, F.exp(e)).otherwise(top * (1 + e - F.log(F.lit(top)))) * F.col("__t")
    linear = F.col("__a") * (F.col("__l") + s * F.col("__dl")) * F.try_divide("__t", "__size")
    value = F.coalesce(F.col("__fixed") * F.col("__t") * e, psi - linear)
    trials = moved.withColumn("s", F.explode(F.array(*map(F.lit, [0.0, *_STEPS]))))
    return {r.s: r.v for r in trials.groupBy("s").agg(F.sum(value).alias("v")).collect()}


def turn(hash_: Column, part: Column) -> Column:
    """A document's place in the order of its source, that of q = hash / part, as the 48-bit number of q / (q + 2^48). None where no fraction is taken."""
    return F.when(part > 0, hash_ / (hash_ + part * float(1 << 48)) * float(1 << 48)).cast("long")


def cut_turns(rows: DataFrame, needs: DataFrame, total: int) -> DataFrame:
    """source, cut: documents of a source with a turn up to cut get one more copy, so that their sizes sum up to `need`
    as nearly as whole documents can. rows: source, turn, size. needs: source, need (over 0), n_rows.

    Two levels of PLACES ranges each find the range of the cut; the turns in it, 1 / PLACES^2 of all, are summed one by one."""
    keys = ["need", "n_rows", "low", "done"]
    state = needs.withColumn("low", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("double"))
    w = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in (36, 24, 0):
        here = scratch.join_split_hot(rows, state, ["source"], "n_rows", total)
        inside = here.where((F.col("turn") >= F.col("low")) & (F.col("turn") - F.col("low") < PLACES << (shift or 12)))
        place = F.shiftright(F.col("turn") - F.col("low"), shift) if shift else F.col("turn")
        sums = inside.groupBy("source", place.alias("place")).agg(F.sum("size").alias("size"), *[F.first(k).alias(k) for k in keys])
        upto = sums.withColumn("upto", F.col("done") + F.sum("size").over(w))
        if not shift:
            fits = F.col("upto") - F.col("size") / 2 <= F.col("need") + 0.01
            return upto.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("place"))), F.first("low") - 1).alias("cut"))
        # the first range that passes the need, or the last one if none does
        at = F.struct("place", (F.col("upto") - F.col("size")).alias("done"))
        found = F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), at)), F.max(at))
        step = upto.groupBy("source").agg(found.alias("x"), *[F.first(k).alias(k) for k in keys[:3]])
        state = scratch.written(step.select("source", "need", "n_rows", (F.col("low") + F.shiftleft("x.place", shift)).alias("low"), F.col("x.done").alias("done")), f"places-{shift}")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str | None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, lang, size, hash) as a written table, and the cells (source, lang) with
    source_size, target, whole (copies that all get), part (fraction of one more) and cut (the last turn that gets it).
    A null source or lang is 'null' here, others have a 'v' before them."""
    spark, since = docs.sparkSession, scratch.mark()
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")) if c else F.lit("null")
    rows = docs.select(F.col(id_col).alias("doc_id"), key(source_col).alias("source"), key(lang_col).alias("lang"), n_words(F.col(text_col)).alias("size"), rank_hash(F.col(id_col)).alias("hash"))
    rows = scratch.written(rows, "sizes")
    cells = scratch.written(rows.groupBy("source", "lang").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "cells")
    sources = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    named = sources.withColumn("name", F.when(F.col("source") != "null", F.substring("source", 2, 1 << 30)))
    targets = scratch.written(targets_by_cycle(named, "name", "source_size").select("source", "source_size", "target"), "targets")
    rated = balance(cells.join(targets, "source"), "source", "lang" if lang_col else None)
    rated = scratch.written(rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.floor("rate")), "rates")
    total = rows.count()
    needs = rated.groupBy("source").agg(F.sum(F.col("part") * F.col("tokens")).alias("need"), F.sum("n_rows").alias("n_rows")).where("need > 0")
    turned = _with_cell(rows, rated.select("source", "lang", "part", "n_rows"), total).select("source", turn(F.col("hash"), F.col("part")).alias("turn"), "size").where("turn IS NOT NULL")
    turned = scratch.written(turned, "turns")
    cuts = scratch.written(cut_turns(turned, scratch.written(needs, "needs"), total), "cuts")
    out = scratch.written(rated.join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(-1))), "plan")
    scratch.remove(spark, since, keep=("sizes", "plan"))
    return rows, out


def _with_cell(rows: DataFrame, cells: DataFrame, total: int) -> DataFrame:
    """rows with what their cell holds; a cell of many rows is broadcast."""
    small = scratch.maybe_broadcast(cells)
    return rows.join(small, ["source", "lang"]) if small is not cells else scratch.join_split_hot(rows, cells, ["source", "lang"], "n_rows", total)


def copies(hash_: Column, whole: str = "whole", part: str = "part", cut: str = "cut") -> Column:
    return F.col(whole) + F.when(turn(hash_, F.col(part)) <= F.col(cut), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str | None = "lang") -> DataFrame:
    """docs as the mix takes them, all columns as they are: a row for each copy taken. The decision needs only
    a row's source, language and hash, so texts aren't shuffled while the cells are few enough to broadcast."""
    rows, plan = _plan(docs, id_col, text_col, source_col, lang_col)
    s, lang, whole, part, cut, n_rows, many, copy = scratch.fresh(docs.columns, "source_key", "lang_key", "whole", "part", "cut", "n_rows", "many", "copy")
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")) if c else F.lit("null")
    cells = plan.select(F.col("source").alias(s), F.col("lang").alias(lang), F.col("whole").alias(whole), F.col("part").alias(part), F.col("cut").alias(cut), F.col("n_rows").alias(n_rows))
    keyed = docs.withColumn(s, key(source_col)).withColumn(lang, key(lang_col))
    small = scratch.maybe_broadcast(cells)
    both = keyed.join(small, [s, lang]) if small is not cells else scratch.join_split_hot(keyed, cells, [s, lang], n_rows, rows.count())
    taken = both.withColumn(many, copies(rank_hash(F.col(id_col)), whole, part, cut)).where(F.col(many) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, plan = _plan(docs, "doc_id", "text", "source", "lang")
    both = _with_cell(rows, plan.select("source", "lang", "source_size", "target", "whole", "part", "cut", "n_rows"), rows.count())
    return both.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (copies(F.col("hash")) * F.col("size")).alias("taken"))


#: The rates by coordinate descent on the same dual: a source's multiplier is moved to its total, then a language's by
#: a Newton step of its own, 300 times.
OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
rounds AS (
  SELECT 0 AS k, source, source_size, w, FALSE AS full_, 1.5 * sum(source_size) OVER () * w / sum(w) OVER () AS share FROM sources
  UNION ALL
  SELECT k + 1, source, source_size, w, now_full,
         CASE WHEN now_full THEN 2.0 * source_size
              ELSE share + w * sum(CASE WHEN now_full AND NOT full_ THEN share - 2.0 * source_size ELSE 0 END) OVER ()
                   / nullif(sum(CASE WHEN now_full THEN 0 ELSE w END) OVER (), 0) END
  FROM (SELECT *, full_ OR share > 2.0 * source_size AS now_full FROM rounds) WHERE k < 60),
targets AS (SELECT source, source_size, CAST(share AS DOUBLE) AS target FROM rounds WHERE k = 60),
cells AS (
  SELECT c.source, c.lang, CAST(c.tokens AS DOUBLE) AS t, CAST(source_size AS DOUBLE) AS size, target AS a,
         sum(CAST(c.tokens AS DOUBLE)) OVER (PARTITION BY c.lang) * (SELECT sum(target) FROM targets WHERE source_size > 0) / sum(CAST(c.tokens AS DOUBLE)) OVER () AS b,
         CASE WHEN source_size = 0 THEN 1.0 WHEN target <= 0 THEN 0.0 WHEN target >= 2.0 * source_size * (1 - 1e-12) THEN 2.0 END AS fixed
  FROM (SELECT source, lang, sum(size) AS tokens FROM docs GROUP BY source, lang) c JOIN targets g ON c.source IS NOT DISTINCT FROM g.source),
steps AS (
  SELECT 0 AS k, source, lang, t, size, a, b, fixed, CASE WHEN fixed IS NULL THEN ln(a / size) ELSE 0.0 END AS l, 0.0::DOUBLE AS mu FROM cells
  UNION ALL
  SELECT k + 1, source, lang, t, size, a, b, fixed, l2,
         mu - CASE WHEN b > 0 THEN (sum(coalesce(fixed, least(2.0, exp(l2 + mu))) * t) OVER by_lang - b * (1 - 0.1 * mu))
              / (sum(CASE WHEN fixed IS NULL AND exp(l2 + mu) < 2.0 THEN exp(l2 + mu) * t ELSE 0 END) OVER by_lang + 0.1 * b) ELSE 0 END
  FROM (SELECT *, CASE WHEN fixed IS NULL THEN l + ln(a / sum(least(2.0, exp(l + mu)) * t) OVER (PARTITION BY source)) ELSE 0.0 END AS l2 FROM steps WHERE k < 300)
  WINDOW by_lang AS (PARTITION BY lang)),
rates AS (
  SELECT source, lang, t, CASE WHEN abs(r - round(r)) < 1e-9 THEN round(r) ELSE r END AS rate
  FROM (SELECT *, coalesce(fixed, least(2.0, exp(l + mu))) AS r FROM steps WHERE k = 300)),
turns AS (
  SELECT d.doc_id, d.source, d.size, floor(rate) AS whole, rate - floor(rate) AS part,
         CASE WHEN rate > floor(rate) THEN CAST(trunc(d.h / (d.h + (rate - floor(rate)) * 281474976710656.0) * 281474976710656.0) AS BIGINT) END AS turn
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang),
needs AS (SELECT source, sum((rate - floor(rate)) * t) AS need FROM rates GROUP BY source),
placed AS (
  SELECT source, turn, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WHERE turn IS NOT NULL GROUP BY source, turn),
cuts AS (
  SELECT p.source, max(turn) AS cut FROM placed p JOIN needs n ON p.source IS NOT DISTINCT FROM n.source
  WHERE upto - size / 2.0 <= need + 0.01 GROUP BY p.source)
SELECT t.doc_id, t.size, g.source_size, round(g.target, 6) AS target,
       CAST(t.size * (t.whole + CASE WHEN t.turn <= c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM turns t JOIN targets g ON t.source IS NOT DISTINCT FROM g.source
LEFT JOIN cuts c ON t.source IS NOT DISTINCT FROM c.source
"""
