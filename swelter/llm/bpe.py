"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces of a block of texts lie end to end in one linked list of tokens, with no link from piece to piece. For
each pair that a merge rule joins, its left position lies in the bucket of the rule's rank, and a two-level
bitmap (one bit a rank, one bit a word of 256 ranks) says which buckets are in use. Two find-first-set steps
give the lowest rank; its positions are merged from the left, all at once as long as no merge brings up a
lower rank in its own piece, and those whose pair has changed meanwhile are stale and skipped. A piece of n
bytes takes O(n) queue operations however long it is, and pieces that repeat in a block are merged once.

Nulls: a null text counts as empty and has no tokens; null and repeated doc_ids pass through. Empty
tables give empty results. Special tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame

from . import scratch

#: Characters of text in a block, which share one queue; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: A whitespace character before a space: only such texts need the pattern to find their chunks.
_RUN = re.compile(r"\s ")
_CHUNK = re.compile(r"\s*\S+|\s+")


class Codec:
    """Encoder and decoder for a rank file (lines of base64 bytes and rank) and a splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import numpy as np
        import pyarrow as pa
        import regex

        self.split = regex.compile(pattern).findall
        self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        top = max(self.rank_of.values())
        self.shift = top.bit_length()
        merged = sorted(
            ((self.rank_of[t[:k]] << self.shift) | self.rank_of[t[k:]], rank)
            for t, rank in self.rank_of.items()
            for k in range(1, len(t))
            if t[:k] in self.rank_of and t[k:] in self.rank_of
        )
        #: Pairs of ids in order, with an end mark, and the rank that each pair merges to.
        self.pairs = np.array([*(k for k, _ in merged), 1 << 62], np.int64)
        self.ranks = np.array([*(r for _, r in merged), -1], np.int32)
        self.byte_ids = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.rank_of_pair(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        #: Tokens that some pair merges into a token of a lower rank.
        self.brings_lower = np.zeros(top + 1, bool)
        low = self.ranks[:-1].astype(np.int64)
        for side in (self.pairs[:-1] >> self.shift, self.pairs[:-1] & ((1 << self.shift) - 1)):
            self.brings_lower[side[low < side]] = True
        self.bit = [1 << k for k in range(max(256, (top >> 8) + 1))]
        by_id = dict(map(reversed, self.rank_of.items()))
        self.bytes_of = pa.array([by_id.get(i, b"") for i in range(top + 1)], pa.binary())
        self.text_of = pa.array([f"{i}," for i in range(top + 1)], pa.string())

    def rank_of_pair(self, left, right):
        """Rank of each pair of ids, -1 where no rule joins them. An id of -1 on the right has no rule."""
        import numpy as np

        keys = (np.asarray(left, np.int64) << self.shift) | right
        at = self.pairs.searchsorted(keys)
        return np.where(self.pairs[at] == keys, self.ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes]):
        """(ids of all pieces end to end, number of ids of each): in every piece always the lowest rank next, from the left."""
        import numpy as np

        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), sizes
        starts = np.cumsum(sizes) - sizes
        filled = sizes > 0
        first, last = starts[filled], (starts + sizes - 1)[filled]
        # position n is the end of every piece: it has no id
        ids, rank_at = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        ids[:n] = self.byte_ids[raw]
        rank_at[: n - 1] = self.byte_pairs[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[last], before[first], rank_at[last] = n, n, -1
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)

        bit, words, top = self.bit, [0] * len(self.bit), 0
        at = np.flatnonzero(rank_at >= 0)
        at = at[np.argsort(rank_at[at], kind="stable")]
        ranks = rank_at[at]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        buckets = dict(zip(ranks[cuts].tolist(), np.split(at, cuts[1:])))
        added: dict[int, list[int]] = {}  # positions that came up later, by rank
        for rank in buckets:
            words[rank >> 8] |= bit[rank & 255]
            top |= bit[rank >> 8]

        while top:
            # find first set, level by level
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            words[w] = word = word ^ low
            if not word:
                top ^= bit[w]
            p = buckets.pop(rank, None)
            late = added.pop(rank, None)
            if late:
                p = np.array(late) if p is None else np.concatenate([p, late])
                p.sort()
            p = p[rank_at[p] == rank]  # the others are stale
            if not len(p):
                continue
            j = after[p]
            held = p
            if len(p) > 1:
                shares = p[1:] == j[:-1]  # its left token is the right one of the position before
                if shares.any():
                    k = np.arange(len(p))
                    run = np.maximum.accumulate(np.where(np.concatenate([[True], ~shares]), k, 0))
                    odd = ((k - run) & 1).astype(bool)
                    p, j = p[~odd], j[~odd]
                if self.brings_lower[rank]:
                    p, j, wait = self._until_lower(rank, p, j, held, ids, after, before, piece_of)
                    if len(wait):
                        added[rank] = wait.tolist()
                        words[w] |= low
                        top |= bit[w]
            then = after[j]
            ids[p], ids[j], rank_at[j] = rank, -1, -1
            after[p], before[then] = then, p
            changed = np.concatenate([p, before[p]])
            changed = changed[changed < n]
            if len(p) > 1 and (then[:-1] == p[1:]).any():
                changed = np.unique(changed)
            new = self.rank_of_pair(ids[changed], ids[after[changed]])
            rank_at[changed] = new
            some = new >= 0
            for pos, r in zip(changed[some].tolist(), new[some].tolist()):
                if r in added:
                    added[r].append(pos)
                else:
                    added[r] = [pos]
                    words[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
        live = ids[:n] >= 0
        ends = np.concatenate([[0], np.cumsum(live)])
        return ids[:n][live], ends[starts + sizes] - ends[starts]

    def _until_lower(self, rank, p, j, held, ids, after, before, piece_of):
        """p and j up to the first merge of each piece that brings up a lower rank, and the held positions that then wait."""
        import numpy as np

        left = ids[before[p]]
        left[1:][after[j[:-1]] == p[1:]] = rank  # the neighbour has been merged by then
        a, b = self.rank_of_pair(np.full(len(p), rank), ids[after[j]]), self.rank_of_pair(np.maximum(left, 0), np.full(len(p), rank))
        lower = ((a >= 0) & (a < rank)) | ((left >= 0) & (b >= 0) & (b < rank))
        if not lower.any():
            return p, j, p[:0]
        at = np.flatnonzero(lower)
        pieces, k = np.unique(piece_of[p[at]], return_index=True)
        stop = p[at[k]]

        def waits(x):
            of = piece_of[x]
            slot = np.minimum(np.searchsorted(pieces, of), len(pieces) - 1)
            return (pieces[slot] == of) & (x > stop[slot])

        go = ~waits(p)
        return p[go], j[go], held[waits(held)]

    def encode_block(self, texts: list[str]):
        """(ids of all texts end to end, number of ids of each). No piece goes on from a character other than
        white space to white space, and what follows such a place doesn't depend on what precedes it; so texts
        are cut there, and each different chunk is split and each different piece merged once."""
        import numpy as np

        index: dict[str, int] = defaultdict(count().__next__)  # numbers, in the order of first sight
        rows = []
        for text in texts:
            if not text:
                chunks = []
            elif _RUN.search(text):
                chunks = _CHUNK.findall(text)
            else:
                first, *others = text.split(" ")
                chunks = [" " + x for x in others]
                if first:
                    chunks.insert(0, first)
            rows.append(np.fromiter(map(index.__getitem__, chunks), np.int32, len(chunks)))
        pieces: dict[str, int] = defaultdict(count().__next__)
        parts, counts = [], []
        for chunk in index:
            if chunk.isascii() and chunk.lstrip(" ").isalpha() and len(chunk) < 64:
                found = (chunk,)
            else:
                found = self.split(chunk)
            parts.extend(map(pieces.__getitem__, found))
            counts.append(len(found))
        flat, sizes = self._ids_of([x.encode() for x in pieces])
        del index, pieces
        for level in ((parts, counts), (np.concatenate(rows) if rows else [], [len(r) for r in rows])):
            of, many = np.array(level[0], np.int64), np.array(level[1], np.int64)
            flat, sizes = _gathered(flat, sizes, of, many)
        return flat, sizes

    def _ids_of(self, pieces: list[bytes]):
        """(ids end to end, number of each) of pieces: whole tokens as they are, the others merged."""
        import numpy as np

        whole = np.fromiter((self.rank_of.get(x, -1) for x in pieces), np.int32, len(pieces))
        todo = np.flatnonzero(whole < 0)
        merged, many = self.merge([pieces[k] for k in todo.tolist()])
        sizes = np.ones(len(pieces), np.int64)
        sizes[todo] = many
        flat = np.empty(int(sizes.sum()), np.int32)
        is_whole = np.repeat(whole >= 0, sizes)
        flat[is_whole] = whole[whole >= 0]
        flat[~is_whole] = merged
        return flat, sizes

    def encode(self, text: str):
        """Ids of a text as an array."""
        return self.encode_block([text])[0]

    def decode_block(self, ids, sizes) -> list[memoryview]:
        """The bytes that each text's ids stand for."""
        return self._joined(self.bytes_of, ids, sizes)

    def decode(self, ids) -> bytes:
        return bytes(self.decode_block(ids, [len(ids)])[0])

    def decimals_block(self, ids, sizes) -> list[memoryview]:
        """Each text's ids as decimals joined by commas."""
        return [x[:-1] for x in self._joined(self.text_of, ids, sizes)]

    @staticmethod
    def _joined(of_id, ids, sizes) -> list[memoryview]:
        import numpy as np
        import pyarrow as pa

        taken = of_id.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        cuts = offsets[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
        data = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
        return [data[lo:hi] for lo, hi in zip(cuts, cuts[1:])]


def _gathered(flat, sizes, of, many):
    """Put sequences together from parts: flat and sizes hold the parts end to end, `of` says which parts come one
    after the other and `many` how many of them each sequence takes. Returns the same two for the sequences."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    length = sizes[of]
    done = np.cumsum(length)
    total = int(done[-1]) if len(done) else 0
    where = np.repeat(starts[of] - (done - length), length) + np.arange(total)
    ends = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(many)])]
    return flat[where], np.diff(ends)


_codecs: dict[bytes, Codec] = {}


def codec_for(rank_file: bytes, pattern: str) -> Codec:
    """A worker's codec, kept from task to task."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _share(spark, rank_path: str):
    scratch.ship(spark)
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _blocks(batches: Iterator, block_chars: int) -> Iterator[tuple]:
    """(doc_ids as an Arrow array, texts) in blocks of about block_chars characters."""
    import pyarrow as pa

    ids, texts, held = [], [], 0
    for b in batches:
        lo = 0
        for k, t in enumerate(b.column(1)):
            text = t.as_py() or ""
            texts.append(text)
            held += len(text)
            if held >= block_chars:
                ids.append(b.column(0).slice(lo, k + 1 - lo))
                yield pa.concat_arrays(ids), texts
                ids, texts, held, lo = [], [], 0, k + 1
        if lo < b.num_rows:
            ids.append(b.column(0).slice(lo))
    if texts:
        yield pa.concat_arrays(ids), texts


def _lists(flat, sizes):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of every whole text."""
    import pyarrow as pa

    ranks = _share(docs.sparkSession, rank_path)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks.value, pattern)
        for doc_ids, texts in _blocks(batches, block_chars):
            flat, sizes = codec.encode_block(texts)
            yield pa.record_batch([doc_ids, pa.array(sizes, pa.int64()), _lists(flat, sizes)], ["doc_id", "n_tokens", "ids"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes: the bytes that the ids stand for (a cut id sequence need not be valid UTF-8)."""
    import pyarrow as pa

    ranks = _share(tokens.sparkSession, rank_path)
    narrow = tokens.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks.value, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sizes = part.column(1).value_lengths().fill_null(0).to_numpy()
                found = codec.decode_block(part.column(1).flatten(), sizes)
                yield pa.record_batch([part.column(0), pa.array(map(bytes, found), pa.binary())], ["doc_id", "text_bytes"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_bytes binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the bytes that the ids decode to), and ids if asked for."""
    import pyarrow as pa

    ranks = _share(docs.sparkSession, rank_path)
    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_ids, texts in _blocks(batches, block_chars):
            flat, sizes = codec.encode_block(texts)
            out = [
                doc_ids, pa.array(sizes, pa.int64()), pa.array(map(sha, codec.decimals_block(flat, sizes)), pa.string()),
                pa.array(map(sha, codec.decode_block(flat, sizes)), pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(_lists(flat, sizes))
                names.append("ids")
            yield pa.record_batch(out, names)

    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents by the public multilingual rank file."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
