"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to tasks; each task turns blocks of them into impact lists, one a term, ordered by what the term adds to
a document's score. A search reads the lists of its terms in step (sorted access) and looks up every document it meets in all
other lists (direct access), and both mark the positions that they touch as seen. A list's best position is the end of its
seen prefix, which is often beyond what was read in order, so the sum of the impacts at the best positions bounds an unseen
document more tightly than the last-read positions do. A search stops in a block once that sum lies strictly below the
kth score, which is carried from block to block within a task; equal scores can then not be missed. Each task's best k
rows an item meet in one small window at the end. Texts are read once: the postings of the terms asked for are written, and document
counts, lengths and frequencies are sums over them.

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080 on; only A-Z are lower-cased.

Items are searched in blocks of at most BLOCK_TERMS term places (an item with more is a block of its own), whose vocabulary goes
to all tasks. Items' texts are read by the driver a block at a time.

Nulls: a null text has no terms, as a document or as an item; null doc_ids come last among equal scores, null item_ids are
returned. Repeated rows are documents, or items, of their own (repeated items repeat ranks). Empty tables and items without
a match give no rows. Other columns are ignored. An item's text and a document's text must fit in memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

TOP = 20
#: Term places of the items of a block, and documents of a block of impact lists.
BLOCK_TERMS, BLOCK_DOCS = 200_000, 8192
#: Positions read from each list in the first step; each step reads twice as many.
FIRST_DEPTH = 16
#: Bytes that belong to terms, lower-cased; all others are spaces.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms and tfs (those of the vocabulary) of every document. docs: doc_id, text."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for b in batches:
            lengths, terms, tfs = [], [], []
            for text in b.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                found = [(number[w], tf) for w, tf in Counter(words).items() if w in number]
                lengths.append(len(words))
                terms.append([t for t, _ in found])
                tfs.append([tf for _, tf in found])
            yield pa.record_batch([b.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def length_norm(n, n_docs: int, n_terms: int):
    return 75 + (25 * n * n_docs) // n_terms


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """The impact lists of a block of documents, by term: in order of impact, and by document for direct access."""

    def __init__(self, doc, term, impact):
        import numpy as np

        order = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[order], term[order], impact[order]
        self.terms, starts = np.unique(term, return_index=True)
        self.ends = np.append(starts, len(term))
        position = np.arange(len(term)) - np.repeat(starts, np.diff(self.ends))
        by_doc = np.lexsort((doc, term))
        self.doc, self.impact = doc, impact
        self.own_doc, self.own_impact, self.own_position = doc[by_doc], impact[by_doc], position[by_doc]

    def of(self, term: int) -> slice | None:
        """Where a term's list lies, if it has one."""
        import numpy as np

        k = int(np.searchsorted(self.terms, term))
        return slice(int(self.ends[k]), int(self.ends[k + 1])) if k < len(self.terms) and self.terms[k] == term else None


def best_positions(lists: Lists, item: dict[int, int], top: int, floor: list[int], n_docs: int):
    """Documents of the block (places and scores) among which all are that belong to the best `top` of an item, given the best
    scores found before; and how many positions were read in order. item: repeats by term. floor: at most `top` scores."""
    import numpy as np

    own = [(at, q) for t, q in item.items() if (at := lists.of(t)) is not None and lists.impact[at.start] > 0]
    sizes = [at.stop - at.start for at, _ in own]
    seen = [np.zeros(size + 1, bool) for size in sizes]  # the last place is never seen: a mark
    best, met = [0] * len(own), np.zeros(n_docs, bool)
    docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    depth, read, step = 0, 0, FIRST_DEPTH
    while depth < max(sizes, default=0):
        parts = [lists.doc[at.start + depth : min(at.start + depth + step, at.stop)] for at, _ in own]
        read += sum(map(len, parts))
        new = np.unique(np.concatenate(parts))
        new = new[~met[new]]
        met[new] = True
        total = np.zeros(len(new), np.int64)
        for k, (at, q) in enumerate(own):
            held = lists.own_doc[at]
            place = np.minimum(np.searchsorted(held, new), len(held) - 1)
            hit = held[place] == new
            place = place[hit] + at.start
            total[hit] += q * lists.own_impact[place]
            seen[k][lists.own_position[place]] = True
            best[k] += int(np.argmin(seen[k][best[k] :]))
        docs.append(new)
        scores.append(total)
        depth, step = depth + step, 2 * step
        bound = sum(q * int(lists.impact[at.start + best[k] - 1]) for k, (at, q) in enumerate(own) if best[k] < sizes[k])
        known = np.concatenate([np.asarray(floor, np.int64), *scores])
        if len(known) >= top and bound < np.partition(known, len(known) - top)[len(known) - top]:
            break
    return np.concatenate(docs), np.concatenate(scores), read


def _search_block(docs: DataFrame, items: list[tuple], top: int, name: str) -> DataFrame:
    """place (of the item in the list), doc_id, score, rank for one block of items."""
    import pyarrow as pa

    spark = docs.sparkSession
    counted = [Counter(terms_of(text.encode()) if text is not None else []) for _, text in items]
    number = {w: k for k, w in enumerate(sorted(set().union(*counted)))}
    asked = [{number[w]: q for w, q in c.items()} for c in counted]
    table = scratch.written(postings(docs, number), name)
    n_docs, n_terms = table.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = f"place int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    if not n_docs:
        return spark.createDataFrame([], schema + ", rank int")
    frequency = {r.term: r.df for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # at most a block's vocabulary
    shared = spark.sparkContext.broadcast((asked, [term_weight(n_docs, frequency.get(k, 0)) for k in range(len(number))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        asked, weights = shared.value
        weights = np.array([*weights, 0], np.int64)
        best: list[list[tuple]] = [[] for _ in asked]

        def search(t: pa.Table) -> None:
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            many = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(t.num_rows), many)
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
            m = length_norm(t.column("n").to_numpy(), n_docs, n_terms)[doc]
            lists, ids = Lists(doc, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))), t.column("doc_id")
            for k, item in enumerate(asked):
                places, scores, _ = best_positions(lists, item, top, [s for s, *_ in best[k]], t.num_rows)
                least = best[k][-1][0] if len(best[k]) == top else 1
                for p in np.flatnonzero(scores >= max(least, 1)):
                    x = ids[int(places[p])].as_py()
                    best[k].append((int(scores[p]), x is None, x))
                best[k] = sorted(best[k], key=lambda r: (-r[0], r[1], r[2] if not r[1] else 0))[:top]

        held, rows, id_type = [], 0, pa.null()
        for b in batches:
            id_type = b.schema.field("doc_id").type
            while b.num_rows:
                held.append(b.slice(0, BLOCK_DOCS - rows))
                rows += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if rows == BLOCK_DOCS:
                    search(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            search(pa.Table.from_batches(held))
        out = [(k, x, s) for k, found in enumerate(best) for s, _, x in found]
        if out:
            places, ids, scores = zip(*out)
            yield pa.record_batch([pa.array(places, pa.int32()), pa.array(ids, id_type), pa.array(scores, pa.int64())], ["place", "doc_id", "score"])

    found = table.mapInArrow(run, schema)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of at most BLOCK_TERMS bytes of terms at least, so that no block's vocabulary has more."""
    held, terms = [], 0
    for r in items.toLocalIterator():
        many = len(terms_of(r.text.encode())) if r.text is not None else 0
        if held and terms + many > BLOCK_TERMS:
            yield held
            held, terms = [], 0
        held.append((r.item_id, r.text))
        terms += many
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` highest-scoring documents with a score above 0."""
    scratch.ship(docs.sparkSession)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    asked = items.selectExpr(f"`{item_id}` AS item_id", f"CAST(`{item_text}` AS string) AS text")
    ids, out = asked.schema["item_id"].dataType.simpleString(), None
    for block in _blocks(asked):
        found = _search_block(narrow, block, top, "postings")
        names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"place int, item_id {ids}")
        # a block's items: a row for each, and no more than BLOCK_TERMS of them have a term
        part = found.join(names, "place").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {ids}, rank int, doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score long")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
asked AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(q * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
