"""The exposure index: first component and equal-weight mean of standardised metrics, per window and definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.sources import shared

METRICS = ["hw_count", "hw_mean_excess", "hw_total_days", "hw_degree_days", "hw_mean_humidity", "hw_apparent_excess"]
GROUP = ["window", "hw_def"]


def covered(components: DataFrame, skip=("0_5",), coverage: float = 0.5) -> DataFrame:
    """The rows that the index is made of: windows that are not skipped and covered well enough."""
    return components.where(~F.col("window").isin(*skip) & (F.col("coverage_frac") >= coverage))


def index_inputs(components: DataFrame, skip=("0_5",), coverage: float = 0.5, least: int = 20, metrics=None) -> DataFrame:
    """Covered rows of groups that are large enough, with metrics (null is 0) standardised within the group as z_*; a
    constant metric is 0."""
    metrics = metrics or METRICS
    rows = covered(components, skip, coverage).withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics})
    stats = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__n"), *[f(m).alias(f"__{k}_{m}") for m in metrics for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    # a row for each window and definition, made once for all that read the inputs
    rows = rows.join(shared.small(shared.written(stats.where(F.col("__n") >= least), "stats")), GROUP)
    z = {f"z_{m}": F.when(F.col(f"__s_{m}") > 1e-12, (F.col(m) - F.col(f"__m_{m}")) / F.col(f"__s_{m}")).otherwise(0.0) for m in metrics}
    return rows.withColumns(z).drop("__n", *[f"__{k}_{m}" for m in metrics for k in "ms"])


def zmean(inputs: DataFrame, metrics=None) -> DataFrame:
    """csei_zsum: the mean of all standardised metrics, constant ones included."""
    z = [F.col(f"z_{m}") for m in metrics or METRICS]
    return inputs.withColumn("csei_zsum", sum(z[1:], z[0]) / len(z))


def first_components(inputs: DataFrame, metrics=None) -> DataFrame:
    """window, hw_def, loadings (array in the order of metrics) and pca_var_explained. Rows are reduced to the second
    moments of each group; one small matrix a group is decomposed."""
    from swelter.operators.pca import moments

    metrics = metrics or METRICS
    k, columns = len(metrics), [f"z_{m}" for m in metrics]
    sums = moments(inputs, columns, tuple(GROUP))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        m, s = np.zeros((k, k)), np.zeros(k)
        m[pdf["i"], pdf["j"]] = pdf["sxy"]
        s[pdf["i"]] = pdf["sx"]
        n = int(pdf["n"].iloc[0])
        values, vectors = np.linalg.eigh((m - np.outer(s, s) / n) / (n - 1))
        # a group without any variance has no axis
        v = vectors[:, -1] * (values.sum() > 1e-12)
        if v.sum() < 0:
            v = -v
        share = values[-1] / values.sum() if values.sum() > 1e-12 else 0.0
        return pd.DataFrame({"window": [pdf["window"].iloc[0]], "hw_def": [pdf["hw_def"].iloc[0]], "loadings": [v.tolist()], "pca_var_explained": [float(share)]})

    return sums.groupBy(*GROUP).applyInPandas(solve, "window string, hw_def string, loadings array<double>, pca_var_explained double")


def build_index(components: DataFrame, person: str = "ext_genid", metrics=None, **limits) -> tuple[DataFrame, DataFrame]:
    """Scores (person, window, hw_def, coverage_frac, csei_pca, csei_zsum, pca_var_explained) and loadings."""
    metrics = metrics or METRICS
    inputs = index_inputs(components, metrics=metrics, **limits)
    # a row for each window and definition: what is broadcast grows with the definitions, not with the data
    first = shared.written(first_components(inputs, metrics), "loadings")
    small = F.broadcast(first) if first.count() <= 10_000 else first
    rows = zmean(inputs, metrics).join(small, GROUP)
    pc1 = sum((F.col(f"z_{m}") * F.get("loadings", F.lit(k)) for k, m in list(enumerate(metrics))[1:]), F.col(f"z_{metrics[0]}") * F.get("loadings", F.lit(0)))
    scores = rows.select(person, *GROUP, "coverage_frac", pc1.alias("csei_pca"), "csei_zsum", "pca_var_explained")
    names = F.arrays_zip(F.array(*map(F.lit, metrics)).alias("metric"), F.col("loadings").alias("loading"))
    loadings = first.select(*GROUP, F.explode(names).alias("z"), "pca_var_explained").select(*GROUP, "z.metric", "z.loading", F.col("pca_var_explained").alias("var_explained"))
    return scores, loadings


def _ranks(df: DataFrame, columns: list[str], keys, weight: str | None = None) -> DataFrame:
    """keys, __column, __value, __rank, __n, __rows: the average rank of every distinct value of each column within its group, its weight (how often
    a row counts; 1 without one) and its rows.
    Distinct values of all columns are counted together and dealt to tasks by range; a task's running counts start from what
    the ranges before it hold of the group, so no task needs a whole group, however many values it has."""
    long = df.select(*keys, (F.col(weight) if weight else F.lit(1)).alias("__w"), F.explode(F.array(*[F.struct(F.lit(k).alias("__column"), F.col(c).cast("double").alias("__value")) for k, c in enumerate(columns)])).alias("__x")).select(*keys, "__w", "__x.*")
    group = [*keys, "__column"]
    counts = long.groupBy(*group, "__value").agg(F.sum("__w").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    counts = shared.written(counts.repartitionByRange(*group, "__value").withColumn("__range", F.spark_partition_id()), "counts")
    # a row for each range and group
    before = F.sum("__all").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.groupBy(*group, "__range").agg(F.sum("__n").alias("__all")).withColumn("__from", F.coalesce(before, F.lit(0))).drop("__all")
    upto = F.sum("__n").over(Window.partitionBy(*group, "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("__upto", upto).join(starts, [*group, "__range"])
    return shared.written(ranked.select(*group, "__value", "__n", "__rows", (F.col("__from") + F.col("__upto") - (F.col("__n") - 1) / 2).alias("__rank")), "ranks")


def average_ranks(df: DataFrame, value: str | list[str], name: str | list[str], keys, weight: str | None = None) -> DataFrame:
    """df with the rank of each row's value within its group, ties averaged, a row counting as often as weight says; of several columns at once if lists are given. Values that many rows
    share are joined by broadcast, so those rows stay where they are, and the others by a shuffle on group and value. Groups and values must not be null."""
    values, names = ([value], [name]) if isinstance(value, str) else (value, name)
    ranks, total = _ranks(df, values, list(keys), weight), df.count()
    for k, (v, n) in enumerate(zip(values, names)):
        own = ranks.where(F.col("__column") == k).select(*keys, F.col("__value").alias("__on"), F.col("__rank").alias(n), "__rows")
        df = shared.join_split_hot(df.withColumn("__on", F.col(v).cast("double")), own, [*keys, "__on"], "__rows", total).drop("__on", "__rows")
    return df


def spearman_by_group(df: DataFrame, x: str, y: str, keys=tuple(GROUP)) -> DataFrame:
    """Spearman's correlation of two columns in each group, over rows that have both; null where all ranks of a side are tied. Rows
    with the same pair of values are counted first and ranked once. A group's mean rank is (n + 1) / 2, so centred ranks are exact."""
    rows = shared.written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("__w")), "pairs")
    totals = rows.groupBy(*keys).agg(F.sum("__w").alias("n"))
    ranked = average_ranks(rows, [x, y], ["__rx", "__ry"], keys, "__w").join(shared.small(totals), list(keys))
    dx, dy = (F.col(r) - (F.col("n") + 1) / 2 for r in ("__rx", "__ry"))
    share = F.try_divide(F.sum(F.col("__w") * dx * dy), F.sqrt(F.sum(F.col("__w") * dx * dx)) * F.sqrt(F.sum(F.col("__w") * dy * dy)))
    return ranked.groupBy(*keys).agg(share.alias("spearman"), F.first("n").alias("n"))


def variance_summary(scores: DataFrame) -> DataFrame:
    one = scores.select("window", "hw_def", "pca_var_explained").distinct()
    return one.groupBy("window").agg(F.avg("pca_var_explained").alias("mean"), F.min("pca_var_explained").alias("min"), F.max("pca_var_explained").alias("max"), F.count(F.lit(1)).alias("n"))


def loadings_summary(loadings: DataFrame) -> DataFrame:
    return loadings.groupBy("metric", "window").agg(F.avg("loading").alias("mean"), F.stddev_samp("loading").alias("sd"), F.avg(F.when(F.col("loading") > 0, F.col("loading"))).alias("mean_positive"))
