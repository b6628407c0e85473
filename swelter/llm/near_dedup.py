"""Near-duplicate classes by order MinHash.

A document is its sequence of 5-word shingles in lower case, each labelled with its occurrence number, so
that repeats count. For each of HASHES hash functions the TUPLE shingles of least hash are taken and
hashed together in their text order; two documents share such a key with probability of about
similarity ** TUPLE, less if the shared shingles stand in another order. Documents that share a key are
candidates, and candidates are verified by a banded alignment: matched shingles lie within the band that
any alignment good enough must keep to, and the longest run of matches in order on both sides gives
similarity = matched / (all - matched). Links of THRESHOLD or more make classes (connected components).

Exact copies (equal words) are grouped first, so buckets hold different texts only. A bucket is a star,
not all its pairs: its members are compared with its least member, which then retires from it. Buckets that
still hold several classes go on in leader rounds (see `leader_round`): members outside a bucket's largest
class are compared with all others outside their own class and retire, until no bucket holds two classes. No bucket,
class or number of rounds is capped. So two texts of different classes that share a key have been compared, or their lengths or parity bits, which
bound what they share, rule a link out.

Nulls: a null text counts as empty; texts without words are copies of each other, and texts of under five words
are near only to equal ones. A null doc_id is the smallest. Repeated rows are copies. Empty tables give
empty results. Other columns are ignored or, in drop_near_copies, returned as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import scratch

SHINGLE, THRESHOLD = 5, 0.8
#: Keys a document, shingles a key; short documents (up to SHORT shingles) have keys of two as well.
HASHES, TUPLE, SHORT, SHORT_HASHES = 64, 8, 24, 16
#: Leaders a bucket in the first leader round, about; further rounds have twice as many, up to the second number.
LEADERS, MOST_LEADERS = 64, 256
#: Longs of a text's parity bits.
PARITY = 16
#: Hashes of shingles that are made at a time.
HASHED = 500_000
#: Pairs of one node that are aligned together; a node with more has its words dealt to several tasks.
SPLIT = 16_384
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def sequence(words: list[bytes]):
    """32 bits of every word's hash; a shingle of five then has 160."""
    import numpy as np

    return np.fromiter(map(zlib.crc32, words), "<u4", len(words))


def shingles(seq):
    """64-bit hashes of the occurrence-labelled shingles of a sequence, in text order."""
    import numpy as np

    n = len(seq) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide, s = seq.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += wide[k : k + n] * np.uint64(_ODD[k])
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    starts = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not starts.all():  # label the repeats
        at = np.arange(n)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (at - np.maximum.accumulate(np.where(starts, at, 0))).astype(np.uint64)
        s = s + occurrence * np.uint64(0xE7037ED1A0B428DB)
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32))


def _salts(k: int, salt: int):
    import numpy as np

    r = np.random.default_rng(salt)
    return r.integers(0, 1 << 63, k, np.uint64), r.integers(0, 1 << 63, k, np.uint64) | np.uint64(1)


def order_minhash(x, hashes: int, size: int, salt: int):
    """Keys: for each hash function, the `size` least shingles in text order, hashed together."""
    import numpy as np

    if len(x) < size:
        return np.zeros(0, np.int64)
    flip, factor = _salts(hashes, salt)
    step, out = max(1, HASHED // len(x)), []
    for lo in range(0, hashes, step):
        h = (x[None, :] ^ flip[lo : lo + step, None]) * factor[lo : lo + step, None]
        m = len(h)
        least = np.argpartition(h, size - 1, axis=1)[:, :size]
        picked = x[np.sort(least, axis=1)]
        key = np.arange(lo, lo + m, dtype=np.uint64) + np.uint64(salt << 20)
        for k in range(size):
            key = (key ^ picked[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(33)
        out.append(key)
    return np.concatenate(out).view(np.int64)


def parity_bits(x):
    """PARITY longs: bit k says whether an odd number of shingles fall to it. The bits in which two texts differ are
    no more than the shingles that only one of them has."""
    import numpy as np

    odd = np.bincount((x & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(x, y, threshold: float = THRESHOLD) -> float:
    """Aligned share of two shingle sequences, 0 where it is surely under the threshold."""
    import numpy as np

    a, b = len(x), len(y)
    if not a or not b or min(a, b) < threshold * max(a, b):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    need = threshold * (a + b) / (1 + threshold)
    if len(i) < need - 1e-9:
        return 0.0
    # a match in an alignment of `need` matches is off the diagonal by no more than the shingles left out
    off = i - j
    inside = (off <= a - need + 1) & (off >= need - b - 1)
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if len(j) > 1 and (np.diff(j) < 0).any():
        matched = _longest_rising(j.tolist())
    else:
        matched = len(j)
    return matched / (a + b - matched)


def _longest_rising(values: list[int]) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the words), seq (32-bit word hashes), n_shingles, parity and keys of every document."""
    import pyarrow as pa

    scratch.ship(docs.sparkSession)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                digests, seqs, counts, parities, keys = [], [], [], [], []
                for t in part.column(1):
                    words = words_of(t.as_py() or "")
                    digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    seq = sequence(words)
                    x = shingles(seq)
                    seqs.append(seq.tobytes())
                    counts.append(len(x))
                    parities.append(parity_bits(x))
                    k = order_minhash(x, HASHES, TUPLE, 1)
                    if 0 < len(x) <= SHORT:
                        k = np.concatenate([k, order_minhash(x, SHORT_HASHES, 2, 2)])
                    keys.append(k)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                bits = np.array(parities).reshape(-1, PARITY)
                parity = pa.StructArray.from_arrays([pa.array(bits[:, k], pa.int64()) for k in range(PARITY)], [f"p{k}" for k in range(PARITY)])
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(seqs, pa.binary()), pa.array(counts, pa.int64()), parity, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                    ["doc_id", "digest", "seq", "n_shingles", "parity", "keys"],
                )

    longs = ", ".join(f"p{k}: long" for k in range(PARITY))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, digest binary, seq binary, n_shingles long, parity struct<{longs}>, keys array<long>")


def verify(pairs: DataFrame, seqs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold. seqs: node, seq."""
    import pyarrow as pa

    count = lambda side: pairs.groupBy(F.lit(side).alias("side"), F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    many = scratch.written(count("a").unionByName(count("b")).where(F.col("n") > SPLIT), "many")
    busy = {r.side: r.total for r in many.groupBy("side").agg(F.sum("n").alias("total")).collect()}
    both = pairs
    for side in ("b", "a"):
        both = _with_seq(both, many.where(F.col("side") == side), busy.get(side, 0), seqs, side)
    both = both.select("a", "b", "seq_a", "seq_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, x = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            near = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, x = a[k], shingles(np.frombuffer(batch.column(2)[k].as_buffer(), "<u4"))
                near.append(similarity(x, shingles(np.frombuffer(batch.column(3)[k].as_buffer(), "<u4")), threshold) >= threshold - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _with_seq(rows: DataFrame, many: DataFrame, busy: int, seqs: DataFrame, side: str) -> DataFrame:
    """rows of pairs with the sequence of their node a or b. A node of more than SPLIT pairs (the leader of a large
    class, listed in many) is dealt out in parts, so that no task gets all its pairs. busy: such nodes' pairs."""
    seq = seqs.select(F.col("node").alias(side), F.col("seq").alias(f"seq_{side}"))
    if not busy:
        return rows.join(seq, side)
    many = many.select(F.col("node").alias(side), "n", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    other = "b" if side == "a" else "a"
    hot = scratch.join_split_hot(rows, many, [side], "n", busy).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("n", "parts")
    dealt = many.join(seq, side).select(side, f"seq_{side}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = rows.join(scratch.maybe_broadcast(many.select(side)), side, "left_anti")
    return hot.join(dealt, [side, "part"]).drop("part").unionByName(rest.join(seq, side))


def components(links: DataFrame) -> DataFrame:
    """node, root of every node in a link (a, b): root is its component's least node. Large and small stars
    in turn until nothing changes; each is a grouped minimum and a join in which hubs are split off."""
    edges = scratch.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e, large, total):
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        rows = scratch.join_split_hot(around, least, ["u"], "n", total)
        if large:
            new = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = rows.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        return new.where("u <> v") if large else new.where("u <> v").distinct()

    seen = mark(edges)
    while seen[0]:
        edges = scratch.written(star(star(edges, True, 2 * seen[0]), False, 2 * seen[0]), "edges")
        seen, before = mark(edges), seen
        if seen == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def bucket_members(keyed: DataFrame) -> DataFrame:
    """key, n, a (the bucket's least node), n_a, node, n_shingles: the other members of every bucket of several. keyed: node, n_shingles, keys."""
    rows = keyed.select("node", "n_shingles", F.explode("keys").alias("key"))
    led = rows.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    led = scratch.written(led.select("key", "n", F.col("lead.node").alias("a"), F.col("lead.n_shingles").alias("n_a")), "leaders")
    total = led.agg(F.sum("n")).first()[0] or 0
    return scratch.written(scratch.join_split_hot(rows, led, ["key"], "n", total).where("node <> a"), "members")


def stars(members: DataFrame) -> DataFrame:
    """First round: every bucket's least node against its other members."""
    return members.where(_lengths("n_a", "n_shingles")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def open_nodes(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """node, n_shingles, parity, keys: the members of the buckets of three or more, without the stars' leaders, with those buckets' keys."""
    found = members.where("n > 2").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.collect_list("key").alias("keys"))
    return found.join(keyed.select("node", "parity"), "node")


def with_roots(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Open nodes with their class, a row for each of their keys."""
    found = open_.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return scratch.written(found.select("node", "root", "n_shingles", "parity", "keys", F.explode("keys").alias("key")), "open-rows")


def leader_round(open_: DataFrame, most: int, salt: int) -> tuple[DataFrame, DataFrame] | None:
    """open_: node, root, n_shingles, parity, keys, and a row for each key. Gives (pairs, open nodes that are left), or None if no bucket holds two classes. About `most` members outside a bucket's largest class, or all if they are no more,
    are paired with the members outside their own class and retire from the bucket; a bucket of one class is closed.
    At most about `most` pairs a row come up, and hot buckets' members stay where they are."""
    shares = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = shares.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    buckets = scratch.written(buckets.select("key", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("others")).where("others > 0"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0]
    if not total:
        return None
    chance = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))  # the node's own, so that its buckets agree
    leads = (F.col("root") != F.col("main")) & (chance * F.col("others") < most)
    rows = scratch.written(scratch.join_split_hot(open_, buckets, ["key"], "n", total).withColumn("leads", leads).drop("main", "others"), "open-rows")
    led = rows.where("leads").groupBy(F.col("node").alias("a")).agg(
        F.first("n_shingles").alias("n_a"), F.first("root").alias("root_a"), F.first("parity").alias("parity_a"), F.collect_list(F.struct("key", "n")).alias("leads_in")
    )
    led = led.withColumn("keys_a", F.col("leads_in.key")).withColumn("x", F.explode("leads_in")).select("a", "n_a", "root_a", "parity_a", "keys_a", "x.key", "x.n")
    rows = rows.drop("n")
    # two texts at the threshold have this share of their shingles unmatched at most
    differ = sum(F.bit_count(F.col(f"parity.p{k}").bitwiseXOR(F.col(f"parity_a.p{k}"))) for k in range(PARITY))
    few = differ <= (F.col("n_a") + F.col("n_shingles")) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-9
    # a pair comes up once, in the least of the buckets that it shares under this leader
    once = F.col("key") == F.array_min(F.array_intersect("keys", "keys_a"))
    # of two leaders, the lesser one is paired with the greater one and not the other way round as well
    one_way = ~(F.col("leads") & (F.col("node") < F.col("a")))
    both = scratch.join_split_hot(rows, led, ["key"], "n", total).where((F.col("root") != F.col("root_a")) & _lengths("n_a", "n_shingles") & one_way & few & once)
    pairs = both.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    left = rows.where("NOT leads").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"), F.collect_list("key").alias("keys"))
    return pairs, left


def _lengths(a: str, b: str):
    """The shorter text must have THRESHOLD of the longer one's shingles."""
    return F.least(a, b) >= THRESHOLD * F.greatest(a, b) - 1e-9


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row_id, digest, class_id (the least doc_id of its class), class_size, and
    kept (true for one row of each class, which has that doc_id)."""
    since = scratch.mark()
    rows = scratch.written(sketches(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    groups = scratch.written(
        rows.groupBy("digest").agg(F.min(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("many")), "texts"
    )
    nodes = groups.select(F.col("best.row_id").alias("row_id"))
    keyed = scratch.written(
        rows.where("n_shingles > 0").select("row_id", "n_shingles", "parity", "keys").join(nodes, "row_id", "left_semi").withColumnRenamed("row_id", "node"), "keys"
    )
    seqs = rows.select(F.col("row_id").alias("node"), "seq")
    members = bucket_members(keyed)
    tried = scratch.written(stars(members), "pairs")
    links = scratch.written(verify(tried, seqs), "links")
    roots = scratch.written(components(links), "roots")
    open_, most, salt = open_nodes(members, keyed), LEADERS, 1
    while found := leader_round(with_roots(open_, roots), most, salt):
        pairs, open_ = found
        pairs = scratch.written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        most, salt = min(2 * most, MOST_LEADERS), salt + 1
        if not pairs.head(1):
            continue
        more = scratch.written(verify(pairs, seqs), "links")
        if more.head(1):
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more)
            roots = scratch.written(components(links), "roots")
        tried = tried.unionByName(pairs)
    # every text's class, with its least document and number of rows
    texts = groups.join(roots, F.col("best.row_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "best.row_id"))
    sizes = texts.groupBy("root").agg(F.min("best").alias("first"), F.sum("many").alias("class_size"), F.count(F.lit(1)).alias("n"))
    total = groups.count()
    of_text = scratch.written(
        scratch.join_split_hot(texts.select("root", "digest", "many"), scratch.written(sizes, "classes"), ["root"], "n", total).select("digest", "many", "first", "class_size"), "text-classes"
    )
    scratch.remove(docs.sparkSession, since, keep=("sketches", "text-classes"))
    out = scratch.join_split_hot(rows.select("doc_id", "row_id", "digest"), of_text, ["digest"], "many", rows.count())
    return out.select("doc_id", "row_id", "digest", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, all columns as they are. Where doc_ids repeat or are null, a row goes if its
    doc_id and words are among those dropped and not those of a row that stays; rows that repeat these are reduced to one."""
    since = scratch.mark()
    found = scratch.written(classes(docs, id_col, text_col), "near")
    scratch.remove(docs.sparkSession, since, keep=("near",))
    drop_id, digest, drop_digest = scratch.fresh(docs.columns, "drop_id", "digest", "drop_digest")
    same = F.col("doc_id").eqNullSafe(F.col("class_id"))
    if not found.groupBy("doc_id").count().where("count > 1").head(1):
        dropped = found.where("NOT kept").select(F.col("doc_id").alias(drop_id))
        small = scratch.maybe_broadcast(dropped)
        right = dropped.hint("shuffle_hash") if small is dropped else small
        return docs.join(right, F.col(id_col).eqNullSafe(F.col(drop_id)), "left_anti")
    # doc_ids that repeat: the words decide as well
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [hashlib.blake2b(b" ".join(words_of(t or "")), digest_size=16).digest() for t in b.column(text_at).to_pylist()]
            yield b.append_column(digest, pa.array(digests, pa.binary()))

    text_at = docs.columns.index(text_col)
    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(digest, BinaryType())]))
    # a text is in one class, so at most one row of its words is kept
    stays = found.where("kept").select("digest", F.lit(True).alias("stays"))
    keys = found.where("NOT kept").join(stays, "digest", "left").where(~same | F.col("stays").isNull())
    keys = keys.select(F.col("doc_id").alias(drop_id), F.col("digest").alias(drop_digest)).distinct()
    rest = marked.join(keys, F.col(id_col).eqNullSafe(F.col(drop_id)) & (F.col(digest) == F.col(drop_digest)), "left_anti")
    repeated = found.where(~F.col("kept") & same).head(1)
    return (rest.dropDuplicates([id_col, digest]) if repeated else rest).drop(digest)


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "class_id", "class_size", "kept")
