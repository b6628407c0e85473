"""Exact deduplication: a tree-merge of sorted digest runs.

Every input partition is a run: its rows' digests sorted once, equal ones combined to (digest, best identifier,
rows). Then runs meet in pairs, in ceil(log2(runs)) rounds whatever their number: in each round every odd run goes
to the even one before it, and a sort-merge join walks both in order and keeps, of entries that agree, the better
identifier. An entry carries the text's length and a second hash, and entries agree only if these do as well, so the
identifier retained at every level is that of a verified group. A run's digests lie spread over all tasks, so the
last rounds are as parallel as the first; a text that fills a third of all rows is one entry of each run.

Nulls: a null text counts as empty; a null doc_id is the smallest identifier. Repeated rows (same
doc_id, same text): one of them stays. Empty tables give empty results. Other columns are ignored, whatever
their names, and returned as they are by drop_copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

_KEY = ["digest", "n_bytes", "second_hash"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, row_id, run, digest (32 bytes), n_bytes, second_hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("second_hash"),
    )


def sorted_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """run, digest, n_bytes, second_hash, best (doc_id, row_id), group_size: each input partition as one sorted run.
    A run's rows come together by run, not by digest, and are sorted and combined there."""
    best = {"min": F.min, "max": F.max}[keep]
    return (
        rows.select("run", *_KEY, F.struct("doc_id", "row_id").alias("id"))
        .repartition("run")
        .groupBy("run", *_KEY)
        .agg(best("id").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )


def merge_pairs(level: DataFrame, keep: str = "max") -> DataFrame:
    """One binomial round: runs 2k and 2k + 1 become run k by one ordered pass over both; a last run without a partner stays."""
    better = {"min": F.least, "max": F.greatest}[keep]
    pair = F.shiftright("run", 1).alias("run")
    here = level.where("run % 2 = 0").select(pair, *_KEY, F.col("best").alias("best_a"), F.col("group_size").alias("size_a"))
    there = level.where("run % 2 = 1").select(pair, *_KEY, F.col("best").alias("best_b"), F.col("group_size").alias("size_b"))
    both = here.hint("merge").join(there, ["run", *_KEY], "full_outer")
    # least and greatest pass over the side that is null
    size = F.coalesce("size_a", F.lit(0)) + F.coalesce("size_b", F.lit(0))
    return both.select("run", *_KEY, better("best_a", "best_b").alias("best"), size.alias("group_size"))


def tree_merge(rows: DataFrame, keep: str = "max") -> DataFrame:
    """Merge the runs of `rows`: digest, n_bytes, second_hash, best (doc_id, row_id), group_size.
    keep: 'min' or 'max', the identifier that each level retains."""
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    since = scratch.mark()
    level = scratch.written(sorted_runs(rows, keep), "runs-0")
    rounds = (runs - 1).bit_length()
    for k in range(1, rounds + 1):
        level = scratch.written(merge_pairs(level, keep), f"runs-{k}")
        scratch.remove(rows.sparkSession, since, keep=(f"runs-{k}",))
    return level.drop("run")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: doc_id, row_id, digest, keep_id, group_size, kept."""
    rows = scratch.written(digest_rows(docs, id_col, text_col), "digests")
    both = scratch.join_split_hot(rows, tree_merge(rows, keep), _KEY, "group_size", rows.count())
    return both.select(
        "doc_id",
        "row_id",
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that find_copies drops, all columns as they are.

    The dropped (doc_id, digest) pairs are anti-joined: by broadcast while they are few (counted
    first), else by a shuffle that builds its hash table from the pairs. Where a dropped row repeats
    the very doc_id and text of the row that stays, the pair stays and its rows are reduced to one."""
    since = scratch.mark()
    found = scratch.written(find_copies(docs, id_col, text_col, keep), "copies")
    scratch.remove(docs.sparkSession, since, keep=("copies",))
    digest, drop_id, drop_digest = scratch.fresh(docs.columns, "digest", "drop_id", "drop_digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    dropped = found.where(~F.col("kept") & ~same).select(F.col("doc_id").alias(drop_id), F.col("digest").alias(drop_digest)).distinct()
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    small = scratch.maybe_broadcast(dropped)
    right = dropped.hint("shuffle_hash") if small is dropped else small
    rest = marked.join(right, F.col(digest).eqNullSafe(F.col(drop_digest)) & F.col(id_col).eqNullSafe(F.col(drop_id)), "left_anti")
    if found.where(~F.col("kept") & same).head(1):
        rest = rest.dropDuplicates([id_col, digest])
    return rest.drop(digest)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Of equal texts in documents the row with the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_copies(docs, keep="max").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
