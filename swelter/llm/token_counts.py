"""Token counts kept up to date by signed deltas.

A ledger is a folder with one Parquet table a batch, which holds sums of signed changes by source,
language and tokenizer version: an insert counts +1 document and +n tokens, a delete takes both away, a
revised count is a delete under the old figures and an insert under the new ones. Totals are sums over
the committed batches. A batch is written to a folder of its own and commits when that folder is renamed to the
batch's name, which fails if there is one already: so committing a batch id again does nothing, of two writers of
one id one wins, and what a failed attempt leaves is never read. compact folds the committed batches into one table of sums and a
list of their names, both from one listing of the ledger; vacuum deletes what that has made needless after a time of grace.

Counts come from a byte-level BPE rank file (bpe_counted) or from patterns (count_by), and any other column of counts will do.

Nulls: a null text has no tokens; null sources and languages are keys of their own. Empty batches
commit. Repeated rows each count. The ledger adds what it is given: to delete what was never inserted leaves totals
below zero, which negatives lists. Other columns are ignored.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, scratch

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
SCHEMA_COLUMNS = [*KEYS, "n_docs", "n_tokens"]
#: Tokenizer versions that a pattern can count; others bring their own counts.
TOKENIZERS = {"words/1": "[^\\x20\\x09-\\x0D]+", "pieces/2": "\\p{L}+|\\p{N}+|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]+"}


def count_by(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def changes(rows: DataFrame, tokenizer: str, tokens: str, sign: int) -> DataFrame:
    """Signed changes, a row for each document: rows has source, lang and a column of token counts."""
    return rows.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"), (F.col(tokens) * sign).cast("long").alias("n_tokens"),
    )


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the committed batches' folders; what compact has folded in is left out."""
    root, fs = _hadoop(spark, ledger)
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in found if n.startswith("batch="))


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless there is one of that name."""
    sc = spark.sparkContext
    jvm = sc._jvm.org.apache.hadoop.fs
    a, b = jvm.Path(source), jvm.Path(target)
    _, fs = _hadoop(spark, target)
    if fs.exists(b):
        return False
    try:
        jvm.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(a, b, sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0))
    except Py4JJavaError:
        if not fs.exists(b):
            raise
        return False
    return True


def _sums(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def commit(ledger: str, batch_id: str, signed: DataFrame) -> bool:
    """Add a batch to the ledger; False if a batch of this id is in it already, and then nothing changes."""
    spark, name = signed.sparkSession, f"batch={quote(batch_id, safe='')}"
    held, folded = _committed(spark, ledger), _folded(spark, ledger)
    if name in held or name in folded:
        return False
    own = f"{ledger}/_new-{uuid.uuid4().hex}"
    _sums(signed).write.parquet(own)
    if _rename(spark, own, f"{ledger}/{name}"):
        return True
    own, fs = _hadoop(spark, own)
    fs.delete(own, True)
    return False


def _bases(spark: SparkSession, ledger: str) -> list[str]:
    """Folders of sums, oldest first; the last one holds what the others do."""
    root, fs = _hadoop(spark, ledger)
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted((n for n in found if n.startswith("base-")), key=lambda n: int(n[5:]))


def _folded(spark: SparkSession, ledger: str) -> dict[str, str]:
    """Batches that compact has folded in, with the folder of sums that holds them. The names are few and short: a row a batch."""
    bases = _bases(spark, ledger)
    if not bases:
        return {}
    rows = spark.read.schema("batch string").parquet(f"{ledger}/{bases[-1]}/batches").collect()
    return {r.batch: bases[-1] for r in rows}


def compact(spark: SparkSession, ledger: str) -> None:
    """Fold all committed batches into one table of sums, which counts from the moment its folder has its name. A batch that
    commits meanwhile is in neither the sums nor the list. Of two that compact at once, one wins."""
    held, folded = _committed(spark, ledger), _folded(spark, ledger)
    todo = [n for n in held if n not in folded]
    if not todo:
        return
    number = max([int(b[5:]) for b in folded.values()], default=0) + 1
    own = f"{ledger}/_new-{uuid.uuid4().hex}"
    _sums(_read(spark, ledger, todo, folded)).write.parquet(f"{own}/sums")
    spark.createDataFrame([(n,) for n in sorted({*folded, *todo})], "batch string").coalesce(1).write.parquet(f"{own}/batches")
    if not _rename(spark, own, f"{ledger}/base-{number}"):
        own, fs = _hadoop(spark, own)
        fs.delete(own, True)


def vacuum(spark: SparkSession, ledger: str, grace_s: float = 86_400) -> list[str]:
    """Delete folded batches and older sums once the latest sums are grace_s old, and attempts that old that never got a name. No reader or
    writer may take longer than that. Gives the deleted folders' names. A folded batch's name stays in the list, so it can't commit again."""
    root, fs = _hadoop(spark, ledger)
    if not fs.exists(root):
        return []
    latest = time.time() * 1000 - grace_s * 1000
    ages = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(root)}
    bases, folded = _bases(spark, ledger), _folded(spark, ledger)
    gone = [n for n, t in ages.items() if n.startswith("_new-") and t <= latest]
    if bases and ages[bases[-1]] <= latest:
        gone += [*bases[:-1], *(n for n in folded if n in ages)]
    for n in gone:
        path, _ = _hadoop(spark, f"{ledger}/{n}")
        fs.delete(path, True)
    return sorted(gone)


def _read(spark: SparkSession, ledger: str, batches: list[str], folded: dict[str, str]) -> DataFrame:
    """The changes of the batches and the sums that hold the folded ones."""
    paths = [f"{ledger}/{n}" for n in batches] + [f"{ledger}/{b}/sums" for b in {*folded.values()}]
    return spark.read.schema(SCHEMA).parquet(*paths).select(*SCHEMA_COLUMNS)


def _changes(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The latest table of sums and the batches that it doesn't hold."""
    folded = _folded(spark, ledger)
    batches = [n for n in _committed(spark, ledger) if n not in folded]
    return _read(spark, ledger, batches, folded) if batches or folded else None


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over the committed batches; keys that are back at zero are left out."""
    rows = _changes(spark, ledger)
    return _sums(rows).where("n_docs <> 0 OR n_tokens <> 0") if rows is not None else spark.createDataFrame([], SCHEMA)


def negatives(spark: SparkSession, ledger: str) -> DataFrame:
    """Totals below zero: something was deleted that had not been inserted."""
    return totals(spark, ledger).where("n_docs < 0 OR n_tokens < 0")


def bpe_counted(docs: DataFrame, rank_path: str, pattern: str, *columns: Column, text_col: str = "text") -> DataFrame:
    """The given columns of every document and n_tokens, its number of tokens by a rank file (see bpe)."""
    keyed = docs.select(F.struct(*columns).alias("key"), F.col(text_col).alias("text"))
    return bpe.encode(keyed, rank_path, pattern, id_col="key").select("doc_id.*", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents are loaded with their numbers of BPE tokens, recounted under words/1 (a batch that is sent twice; the BPE counts are
    taken away again), and those of fewer than 20 words deleted: the totals that remain."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    counted = bpe_counted(docs, path, public_tokenizers.PATTERN, F.col("source"), F.col("lang"), count_by(F.col("text"), "words/1").alias("words"))
    counted = scratch.written(counted, "counts")
    ledger = scratch.new_path(spark, "token-ledger")
    recount = changes(counted, "byte_bpe_multi_50k/1", "n_tokens", -1).unionByName(changes(counted, "words/1", "words", 1))
    commit(ledger, "load", changes(counted, "byte_bpe_multi_50k/1", "n_tokens", 1))
    commit(ledger, "recount", recount)
    compact(spark, ledger)
    commit(ledger, "recount", recount)
    commit(ledger, "withdraw", changes(counted.where("words < 20"), "words/1", "words", -1))
    return totals(spark, ledger)


OP7_SQL = r"""
SELECT source, lang, 'words/1' AS tokenizer, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) >= 20
GROUP BY source, lang
"""
