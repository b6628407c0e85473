"""Joint principal components from distributed moments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.sources import shared


def moments(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, j, n, sx (sum of column i), sxy (sum of the products of columns i and j), lo and hi (least and largest of column i) over complete rows.

    Each task adds up its rows' cross products in numpy and emits one k x k block a key; a grouped sum adds the blocks.
    Give it standardised columns, so that nothing cancels."""
    k = len(columns)
    data = df.dropna(subset=columns).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held: dict = {}
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                x = g[columns].to_numpy(float)
                if not len(x):
                    continue
                n, s, p, lo, hi = held.get(key, (0, np.zeros(k), np.zeros((k, k)), np.full(k, np.inf), np.full(k, -np.inf)))
                held[key] = (n + len(x), s + x.sum(0), p + x.T @ x, np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
        for key, (n, s, p, lo, hi) in held.items():
            yield pd.DataFrame({
                **{name: [v] * (k * k) for name, v in zip(keys, key if isinstance(key, tuple) else (key,))},
                "i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "n": n, "sx": np.repeat(s, k), "sxy": p.ravel(), "lo": np.repeat(lo, k), "hi": np.repeat(hi, k),
            })

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + ["i int", "j int", "n long", "sx double", "sxy double", "lo double", "hi double"]
    added = [F.sum(c).alias(c) for c in ("n", "sx", "sxy")]
    return data.mapInPandas(run, ", ".join(fields)).groupBy(*keys, "i", "j").agg(*added, F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class ConstantColumn(ValueError):
    """A column without variance, of which there is no correlation."""


def correlation_components(n: int, sums, products):
    """Eigenvalues (falling), eigenvectors (columns), means and deviations of the correlation matrix. Each vector's
    largest entry is positive, which fixes the sign."""
    import numpy as np

    mean = sums / n
    cov = (products - n * np.outer(mean, mean)) / (n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    if (sd <= 0).any():
        raise ConstantColumn("a constant column has no correlation")
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(sd))])
    return np.clip(values, 0, None), vectors * signs, mean, sd


def fit_pca(df: DataFrame, columns: list[str]):
    """loadings (variable, component, loading, eigenvalue, share, cumulative), and the model that pca_scores takes. Only
    the k x k moments reach the driver. Without a correlation matrix (fewer than two complete rows, or a column that is
    constant over them) there are no components: all their values and scores are null."""
    import numpy as np

    k = len(columns)
    rows = moments(df, columns).collect()  # k * k rows
    schema = "variable string, component int, loading double, eigenvalue double, share double, cumulative double"
    nothing = df.sparkSession.createDataFrame([(c, j + 1, *[None] * 4) for j in range(k) for c in columns], schema), (columns, None, None, None)
    # sums of a constant may not cancel to the last bit, so its ends tell
    if not rows or rows[0]["n"] < 2 or any(r["lo"] == r["hi"] for r in rows):
        return nothing
    sums, products = np.zeros(k), np.zeros((k, k))
    for r in rows:
        sums[r["i"]], products[r["i"], r["j"]] = r["sx"], r["sxy"]
    try:
        values, vectors, mean, sd = correlation_components(rows[0]["n"], sums, products)
    except ConstantColumn:
        return nothing
    share = values / values.sum()
    table = [
        (c, j + 1, float(vectors[i, j]), float(values[j]), float(share[j]), float(share[: j + 1].sum())) for j in range(k) for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(table, schema), (columns, vectors, mean, sd)


def pca_scores(df: DataFrame, model, n_components: int | None = None) -> DataFrame:
    """df's complete rows with PC1..PCn, as column expressions."""
    columns, vectors, mean, sd = model
    if vectors is None:
        return df.dropna(subset=columns).withColumns({f"PC{j + 1}": F.lit(None).cast("double") for j in range(n_components or len(columns))})
    z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(columns, mean, sd)]
    pc = {f"PC{j + 1}": sum((z[i] * float(vectors[i, j]) for i in range(1, len(z))), z[0] * float(vectors[0, j])) for j in range(n_components or len(columns))}
    return df.dropna(subset=columns).withColumns(pc)


def orient(scores: DataFrame, loadings: DataFrame, anchors: dict[str, tuple[int, str]]) -> DataFrame:
    """Named components: name -> (component, anchor variable), signed so that the anchor's loading is positive."""
    signs = {(r["component"], r["variable"]): (1.0 if r["loading"] is None or r["loading"] >= 0 else -1.0) for r in loadings.where(F.col("component").isin([c for c, _ in anchors.values()])).collect()}
    return scores.withColumns({name: F.col(f"PC{c}") * signs[c, v] for name, (c, v) in anchors.items()})


def component_correlations(loadings: DataFrame) -> DataFrame:
    """Coordinates of the correlation circle: loading times the component's deviation, over the largest radius of the
    first two components."""
    r = loadings.withColumn("r", F.col("loading") * F.sqrt("eigenvalue"))
    wide = r.groupBy("variable").pivot("component", [1, 2]).agg(F.first("r")).toDF("variable", "x", "y")
    most = wide.agg(F.max(F.hypot("x", "y")).alias("__most"))
    return wide.join(F.broadcast(most)).select("variable", (F.col("x") / F.col("__most")).alias("x"), (F.col("y") / F.col("__most")).alias("y"))


def describe_loadings(loadings: DataFrame, labels: DataFrame) -> DataFrame:
    """Loadings with the label and group of each variable (variable, label, group)."""
    return loadings.join(shared.small(labels), "variable", "left")
