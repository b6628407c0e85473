"""Token-id output: best-fit-decreasing packing into rows of a fixed length.

Documents are encoded where they lie and gathered into blocks of BLOCK_TOKENS tokens within their own
partition, so nothing is shuffled and memory is bounded by a block. A document longer than a row is
split without loss: whole rows first, its rest packed like a short document. Within a block the
segments go from long to short, each into the open row with the least room that still holds it; a
segment tree over room 0..length answers "least room >= n" in logarithmic time. Every row is written as
little-endian uint32 bytes: ids (padded), positions (0 again at each segment's start), with cumulative
segment lengths and each segment's document and offset in it, from which texts can be put together again.

Which documents share a row depends on how the input is dealt into partitions, and a partition ends in one short
block: so the rows are the same for the same files, but not for the same set of documents. fill tells how full they are.

Nulls: a null text counts as empty and, having no tokens, has no segment; a null doc_id passes through.
Empty tables give no rows. Repeated doc_ids are separate segments. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import scratch

#: Production parameters: tokens a row, tokens a block (4 bytes each while it is packed), padding id.
ROW_TOKENS, BLOCK_TOKENS, PAD_ID = 2048, 1 << 20, 50_256


class RoomTree:
    """A segment tree over room 0..length: how many open rows have that much room left."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, need: int) -> int:
        """The least room >= need that an open row has, -1 if there is none."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into lengths (each 1..capacity), by best fit from long to short; ties in the given order."""
    tree, open_rows, rows = RoomTree(capacity), {}, []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = tree.least(lengths[k])
        if room < 0:
            row, room = [], capacity
            rows.append(row)
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        row.append(k)
        left = room - lengths[k]
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def pack_block(docs: list[tuple], length: int = ROW_TOKENS, pad: int = PAD_ID) -> Iterator[dict]:
    """docs: (doc_id, ids as a uint32 array). Yields the rows of one block."""
    import numpy as np

    segments = [(doc_id, lo, ids[lo : lo + length]) for doc_id, ids in docs for lo in range(0, len(ids), length)]
    for row in best_fit_decreasing([len(s[2]) for s in segments], length):
        parts = [segments[k] for k in row]
        sizes = [len(p[2]) for p in parts]
        used = sum(sizes)
        ids = np.full(length, pad, "<u4")
        ids[:used] = np.concatenate([p[2] for p in parts])
        positions = np.zeros(length, "<u4")
        positions[:used] = np.concatenate([np.arange(n, dtype="<u4") for n in sizes])
        yield {
            "n_tokens": used,
            "ids": ids.tobytes(),
            "positions": positions.tobytes(),
            "cu_seqlens": [0, *np.cumsum(sizes).tolist()],
            "doc_ids": [p[0] for p in parts],
            "doc_offsets": [p[1] for p in parts],
        }


_encoders: dict[int, object] = {}


def _encoder(rank_file: bytes, pattern: str):
    """A worker's library encoder, kept from task to task."""
    import base64

    import tiktoken

    key = hash((rank_file, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[key]


def pack(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, pad: int = PAD_ID) -> DataFrame:
    """block, row, n_tokens, ids, positions, cu_seqlens, doc_ids, doc_offsets: a row of `length` ids each."""
    import pyarrow as pa

    spark = docs.sparkSession
    scratch.ship(spark)
    with open(rank_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        encode, block, held, number = _encoder(ranks.value, pattern), [], 0, 0
        id_arrow = None

        def emit():
            rows = list(pack_block(block, length, pad))
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                yield pa.record_batch(
                    [
                        pa.array([(partition << 32) + number] * len(part), pa.int64()),
                        pa.array(range(lo, lo + len(part)), pa.int32()),
                        pa.array([r["n_tokens"] for r in part], pa.int32()),
                        pa.array([r["ids"] for r in part], pa.binary()),
                        pa.array([r["positions"] for r in part], pa.binary()),
                        pa.array([r["cu_seqlens"] for r in part], pa.list_(pa.int32())),
                        pa.array([r["doc_ids"] for r in part], pa.list_(id_arrow)),
                        pa.array([r["doc_offsets"] for r in part], pa.list_(pa.int64())),
                    ],
                    ["block", "row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "doc_offsets"],
                )

        for b in batches:
            id_arrow = b.schema.field(0).type
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    ids = np.array(encode(text), "<u4")
                    block.append((doc_id, ids))
                    held += len(ids)
                    if held >= block_tokens:
                        yield from emit()
                        block, held, number = [], 0, number + 1
        if block:
            yield from emit()

    return narrow.mapInArrow(run, f"block long, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{id_type}>, doc_offsets array<long>")


def fill(packed: DataFrame, length: int = ROW_TOKENS) -> DataFrame:
    """n_rows, n_tokens and the share of the rows' room that they fill (null without rows)."""
    from pyspark.sql import functions as F

    n, tokens = F.count(F.lit(1)), F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0))
    return packed.agg(n.alias("n_rows"), tokens.alias("n_tokens"), F.try_divide(tokens, n * length).alias("filled"))


def unpack(packed: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, doc_offset, ids (little-endian bytes): every segment again."""
    from pyspark.sql import functions as F

    seg = packed.select("ids", "cu_seqlens", "doc_offsets", F.posexplode("doc_ids").alias("k", "doc_id"))
    start = F.element_at("cu_seqlens", F.col("k") + 1)
    return seg.select(
        "doc_id",
        F.element_at("doc_offsets", F.col("k") + 1).alias("doc_offset"),
        F.substring(F.col("ids"), start * 4 + 1, (F.element_at("cu_seqlens", F.col("k") + 2) - start) * 4).alias("ids"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into rows of 2,048 token ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
