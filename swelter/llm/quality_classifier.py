"""A quality classifier learned from trusted positives and unlabelled text.

A linear model on measures of the whole text minimises the non-negative unbiased risk with logistic loss:
prior * E_pos[loss(g)] + max(0, E_all[loss(-g)] - prior * E_pos[loss(-g)]) plus a small ridge. Positives are the
rows labelled 1, the unlabelled sample is every document; labels of 0 are never read. With this loss the risk is the
larger of two convex functions (with the max at 0, and without it), so each Newton step is made for the mixture of both
that the step leaves least. Each step's sums run over all documents: executors add up their rows, Spark adds those, and only the model's own numbers reach the driver. A fit whose steps run out warns and is marked (`converged`).

The prior is estimated from positives and unlabelled text: a first model, with a prior of 1/2 and without the positives
of one fold, ranks all documents; over a cut of the scores the share of all documents is at least prior times the share
of the positives kept back, with equality where only positives score that high. The prior is this ratio at the cut where
it is least after an allowance for chance (best-bin estimation). It is right if positives were labelled
regardless of their text; how many negatives were labelled doesn't matter.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read.

Nulls: a null text counts as empty; null qualities are unlabelled; a null doc_id has no label and isn't held
out. A doc_id with several labels counts once, as its largest. Empty tables give empty results; with no
positive label the score is 1/2. With positives in one fold only, the same ones rank and estimate. Other columns are never read by a score.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Scores from this on are predicted 1; ridge; Newton steps at most; the step's size that ends them.
CUT, RIDGE, STEPS, DONE = 0.7, 0.03, 40, 1e-4
#: Cuts of the scores that the prior's estimate tries; bounds of the prior.
BINS, LEAST_PRIOR = 4096, 0.01
#: What a document is to a fit.
UNLABELLED, POSITIVE, KEPT_BACK = 0, 1, 2
_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 2 * (len(_SYMBOLS) + 5) + 8


def features(text: str):
    """Measures of one whole text, each of about unit size."""
    import numpy as np

    raw = text.encode()
    n = len(raw)
    if not n:
        return np.zeros(N_FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    lines = raw.split(b"\n")
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    shout = sum(map(bytes.isupper, words))
    shares = np.array(
        [count[c] / k for c in _SYMBOLS] + [upper / max(1, upper + lower), digits / n, count[128:].sum() / n, count[:32].sum() / n, shout / k]
    )
    rest = [
        np.log1p(len(words)), np.log(n / k), np.log1p(100 * len(set(words)) / k), np.log1p(100 - 100 * len(set(lines)) / len(lines)), np.log1p(k / len(lines)),
        float(len(words) < 20), float(len(words) < 5), np.log1p(100 * sum(count[c] for c in b"#*$%&|<>") / k),
    ]
    return np.concatenate([np.log1p(100 * shares), np.minimum(shares, 1), rest])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the features of every document."""
    import pyarrow as pa

    scratch.ship(docs.sparkSession)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = np.array([features(t.as_py() or "") for t in part.column(1)], np.float32)
                yield pa.record_batch([part.column(0), _rows(x)], ["doc_id", "x"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, x array<float>")


def _rows(x):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float32()))


def _sums(table: DataFrame, of):
    """Sum over all rows of what of(x, part) gives for a batch: executors add up, then Spark does."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                s = of(x, b.column(1).to_numpy(zero_copy_only=False))
                total = s if total is None else total + s
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["k", "v"])

    parts = table.select("x", "part").mapInArrow(run, "k int, v double")
    return np.array([v for _, v in sorted(parts.groupBy("k").agg(F.sum("v")).collect())])


def is_held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Weights of standardised features, the bias last; picklable, the size of a row."""

    def __init__(self, mean, scale, weights, converged=True):
        self.mean, self.scale, self.weights, self.converged = mean, scale, weights, converged

    def scores(self, x):
        import numpy as np

        g = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-g.clip(-500, 500)))


def fit(table: DataFrame, prior: float, parts: tuple = (POSITIVE, KEPT_BACK), start: Model | None = None) -> Model:
    """table: x and part of every document; rows of `parts` are the positives. start: a model of the same table to go on from."""
    import numpy as np

    d, logit = N_FEATURES, float(np.log(prior / (1 - prior)))
    if start is None:
        first = _sums(table, lambda x, part: np.concatenate([[len(x), np.isin(part, parts).sum()], x.sum(0), (x**2).sum(0)]))
        if not len(first) or not first[1]:
            return Model(np.zeros(d), np.ones(d), np.array([0.0] * d + [logit]))
        mean = first[2 : 2 + d] / first[0]
        scale = np.sqrt(np.maximum(first[2 + d :] / first[0] - mean**2, 1e-6))
        w = np.array([0.0] * d + [logit])
    else:
        mean, scale, w = start.mean, start.scale, start.weights
    m = d + 1

    def step_sums(x, part):
        z = np.hstack([((x - mean) / scale).clip(-8, 8), np.ones((len(x), 1))])
        g = z @ w
        s, soft, p = 1 / (1 + np.exp(-g.clip(-500, 500))), np.logaddexp(0, g), np.isin(part, parts)
        pos = z[p]
        return np.concatenate([
            [len(x), len(pos), soft.sum(), soft[p].sum()], z.T @ s, pos.sum(0), pos.T @ s[p],
            (z.T @ (z * (s * (1 - s))[:, None])).ravel(), (pos.T @ (pos * (s * (1 - s))[p][:, None])).ravel(),
        ])

    penalty = RIDGE * np.eye(m)
    penalty[-1, -1] = 1e-9
    share = 0.0  # of the positives' risk alone in the mixture
    for _ in range(STEPS):
        n, n_pos, soft_all, soft_pos, *rest = _sums(table, step_sums)
        grad_all, mean_pos, grad_pos = np.array(rest[:m]) / n, np.array(rest[m : 2 * m]) / n_pos, np.array(rest[2 * m : 3 * m]) / n_pos
        bend_all, bend_pos = (np.array(x).reshape(m, m) for x in (rest[3 * m : 3 * m + m * m], rest[3 * m + m * m :]))
        # loss(g) - loss(-g) = -g, so the risk is the larger of these two: of positives alone, and unbiased
        slope_pos, slope_full = prior * (grad_pos - mean_pos), grad_all - prior * mean_pos
        negative = soft_all / n - prior * soft_pos / n_pos  # the second less the first: the negative class' risk
        hessian = share * prior * bend_pos / n_pos + (1 - share) * bend_all / n + penalty
        ahead, across = np.linalg.solve(hessian, np.stack([slope_full + penalty @ w, slope_pos - slope_full], 1)).T
        # the mixture whose step makes the larger of both least, as their slopes tell
        bent = (slope_pos - slope_full) @ across
        share = float(np.clip((-negative - (slope_pos - slope_full) @ ahead) / max(bent, 1e-12), 0, 1))
        delta = ahead + share * across
        delta *= min(1.0, 5.0 / max(1e-12, np.abs(delta).max()))
        w = w - delta
        if np.abs(delta).max() < DONE:
            return Model(mean, scale, w)
    warnings.warn(f"the classifier's steps ran out after {STEPS}", stacklevel=2)
    return Model(mean, scale, w, converged=False)


def estimate_prior(table: DataFrame, model: Model, part: int = KEPT_BACK) -> float:
    """The share of positives among all documents, from the model's scores of all and of the positives `part`."""
    import numpy as np

    def tops(x, parts):
        at = np.minimum(model.scores(x) * BINS, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[parts == part], minlength=BINS)])

    sums = _sums(table, tops).reshape(2, BINS)
    n_all, n_pos = sums.sum(1)
    over_all, over_pos = np.cumsum(sums[:, ::-1], axis=1) / np.array([[n_all], [n_pos]])
    tried = over_pos > 0
    over_all, over_pos = over_all[tried], over_pos[tried]
    # both shares' distance from what they estimate, by the bound of Dvoretzky, Kiefer and Wolfowitz at 1 in 10
    allowance = np.sqrt(np.log(40) / 2 / n_all) + np.sqrt(np.log(40) / 2 / n_pos)
    best = np.argmin((over_all + allowance) / over_pos)
    return float(np.clip(over_all[best] / over_pos[best], LEAST_PRIOR, 1 - LEAST_PRIOR))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table of doc_id and x that it was learned from."""
    fold = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3, KEPT_BACK).otherwise(POSITIVE)
    usable = labels.where((F.col("quality") == 1) & ~is_held_out("doc_id")).select(F.col("doc_id").alias("__id"), fold.alias("__part")).distinct()
    x = scratch.written(measured(docs, id_col, text_col), "features")
    joined = x.join(scratch.maybe_broadcast(usable), F.col("doc_id") == F.col("__id"), "left")
    table = scratch.written(joined.select("x", F.coalesce("__part", F.lit(UNLABELLED)).alias("part")), "training")
    found = {r.part for r in table.where(F.col("part") != UNLABELLED).select("part").distinct().collect()}
    if not found:
        return fit(table, 0.5), x
    ranking, kept_back = min(found), max(found)  # the same ones where only one fold has any
    first = fit(table, 0.5, (ranking,))
    return fit(table, estimate_prior(table, first, kept_back), start=first), x


def score(x: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of a table of doc_id and x."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            yield pa.record_batch([b.column(0), pa.array(model.scores(rows) if len(rows) else [], pa.float64())], ["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs without those that score under the cut, all columns as they are. With no positive label nothing has been learned, and all stay."""
    import pyarrow as pa

    model, _ = learn(docs, labels, id_col, text_col)
    if not model.weights.any():
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = np.array([features(t.as_py() or "") for t in part.column(at)], np.float32).astype(np.float64)
                yield part.filter(pa.array(model.scores(x) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's score for quality, learned from labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, x = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(x, model)
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.lit(model.converged).alias("converged"))
