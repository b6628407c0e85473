"""Quality rules of documents, and verdicts on their hosts.

Each whole text is measured once. Failures are summed by host (pre-aggregated before the shuffle), the
hosts' rates are shrunk by a beta prior that is estimated from all hosts by the moments of a
beta-binomial, and hosts whose shrunk rate is over MAX_RATE are rejected with all their documents.

Nulls: a null text has no words and fails; null hosts are one host. Empty tables give empty results.
Repeated rows each count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Base rules: fewest words, largest share of words in repeated windows (percent); a host's largest shrunk failure rate.
MIN_WORDS, MAX_REPEAT, MAX_RATE = 20, 30, 0.5
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    import numpy as np

    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    spaces = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat, n = 0, len(words)
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        sums = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):  # a polynomial in an odd number, modulo 2**64
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
        order = np.argsort(sums, kind="stable")
        same = sums[order[1:]] == sums[order[:-1]]
        if same.any():
            twice = np.zeros(len(sums) + WINDOW, np.int64)
            starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            twice[starts] += 1
            twice[starts + WINDOW] -= 1
            repeat = int((np.cumsum(twice)[:n] > 0).sum())
    return n, len(text) - spaces, symbols, dup_lines, repeat


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the five measures of every document. host: an SQL expression."""
    import pyarrow as pa

    scratch.ship(docs.sparkSession)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"{host} AS host", f"`{text_col}` AS text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measures(t.as_py() or "") for t in b.column(2)]
            columns = list(zip(*found)) or [()] * 5
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "host", *names])

    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"doc_id {types['doc_id']}, host {types['host']}, " + ", ".join(f"{n} long" for n in names))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_ok. measured: host and base_failed."""
    hosts = scratch.written(
        measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts"
    )
    rate = F.try_divide(F.sum("n_failed"), F.sum("n_docs"))
    k, n, nn, p = hosts.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum(F.col("n_docs").cast("double") ** 2), rate).first()
    alpha = beta = 0.5
    if k and k > 1 and 0 < p < 1:
        spread = hosts.agg(F.sum(F.col("n_docs") * (F.col("n_failed") / F.col("n_docs") - p) ** 2)).first()[0]
        within = n - nn / n - k + 1
        rho = (spread / (p * (1 - p)) - (k - 1)) / within if within > 0 else 0.5
        strength = 1 / min(max(rho, 1e-6), 0.5) - 1
        alpha, beta = p * strength, (1 - p) * strength
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_ok", shrunk <= MAX_RATE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the measures, base_failed and kept. Hosts too many to broadcast are joined by a shuffle, but for
    those that hold a large share of all documents. At a shrunk rate of exactly MAX_RATE a host is not rejected."""
    measured = scratch.written(measure(docs, id_col, text_col, host).withColumn("base_failed", base_failed()), "measures")
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")).alias("host_key")
    verdicts = scratch.written(host_verdicts(measured).select(key("host"), "n_docs", "host_ok"), "verdicts")
    keyed, small = measured.withColumn("host_key", key("host")), scratch.maybe_broadcast(verdicts)
    both = keyed.join(small, "host_key") if small is not verdicts else scratch.join_split_hot(keyed, verdicts, ["host_key"], "n_docs", measured.count())
    return both.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_key", "n_docs", "host_ok")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; its source is its host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).drop("host")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, s, array_to_string(words[s:s + 7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS s FROM docs))),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source),
prior AS (
  SELECT p, 1 / least(greatest((sum(n * (f / n - p) * (f / n - p)) / (p * (1 - p)) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - count(*) + 1), 1e-6), 0.5) - 1 AS strength
  FROM hosts, (SELECT sum(f) / sum(n) AS p FROM hosts) GROUP BY p)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.f + p * strength) / (h.n + strength) <= 0.5 AS kept
FROM judged j JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source, prior
"""
