"""WARC archives: a writer of responses and revisits, and a reader that salvages damaged archives.

Writer: equal payloads are found by digest; the first page of a group is a response, the others are
revisits that name it. Every record is a gzip member of its own, so damage costs the records that it hits. Tasks make
the members, number the files by the bytes written so far, and Spark's own writer puts them into files, with its commit protocol, on any file system it knows. That writer
ends each line with a separator, which is made the member's own last byte: a zero, as the top byte of a length
under 16 MB; a longer record gets an empty member after it, whose length ends in zeros.

Reader: archives up to ARCHIVE_BYTES by our writer, or as large as Spark's file source takes in one row (under 2 GB),
are read one to a row and walked through without a copy: what is unpacked is held a record at a time, so a
file that is one large member is read as a stream. Gzip members and plain text are both read. A record counts only if its version
line, its length, the blank lines after it and, for responses, its payload's digest are right. After a failed check the
search goes on at the next gzip member or version line; what lies between is logged as a gap with its byte range and the
reason. A record may have MOST_BYTES at most; a longer length is taken for damage.

Nulls: a null payload is empty, a null url writes no target, a null page_id reads back as null and is a
response. Rows that repeat the first page_id and payload of a group are responses too. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Payloads from so many bytes are stored once; bytes of text that an archive aims at; longest record that is read.
MIN_SHARED, ARCHIVE_BYTES, MOST_BYTES = 100, 64 << 20, 1 << 30
VERSION = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
#: Bytes that are unpacked or looked at in one go.
_STEP = 1 << 16
_EMPTY = zlib.compress(b"", 6, 31)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to (the response's page_id; null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).alias("n_bytes"), F.sha2(payload, 256).alias("digest"),
    )
    groups = scratch.written(
        rows.where(F.col("n_bytes") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1"),
        "payloads",
    )
    small = scratch.maybe_broadcast(groups)
    if small is not groups:
        found = rows.join(small, "digest", "left")
    else:
        # hot groups by broadcast; their rows, and payloads too short to be shared, then go to many keys of the shuffled join, where they match nothing
        total = groups.agg(F.sum("many")).first()[0]
        hot = groups.where(F.col("many") * scratch.HOT_SHARE > total).select("digest", F.col("first").alias("hot_first"))
        key = F.when(F.col("hot_first").isNull() & (F.col("n_bytes") >= MIN_SHARED), F.col("digest")).otherwise(F.concat(F.lit("alone"), F.xxhash64("page_id").cast("string")))
        found = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", key)
        found = found.join(groups.select(F.col("digest").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    revisit = (F.col("n_bytes") >= MIN_SHARED) & (F.col("first") < F.col("page_id"))
    return found.select("page_id", "url", "payload", "n_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def gzip_member(text: bytes) -> bytes:
    """text as a gzip member without its last byte, which is a zero (see the module's docstring)."""
    member = zlib.compress(text, 6, 31)
    return (member if len(text) < 1 << 24 else member + _EMPTY)[:-1]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", packed: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages as archives of at most archive_bytes of text each (or of one longer record), of gzip members or (packed=False)
    plain. A task counts the bytes it writes and begins its next file before they are too many: its k-th file lies in the folder file=k."""
    import pyarrow as pa

    scratch.ship(pages.sparkSession)
    records = plan_records(pages, id_col, url_col, payload_col)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    clean = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise("WARC-Type: response\r\n"),
        line("WARC-Record-ID", F.coalesce(urn("page_id"), F.lit("<urn:page:>"))),
        line("WARC-Refers-To", urn("refers_to")),
        line("WARC-Target-URI", clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string")),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    end = b"\r\n\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                members, files = [], []
                for t in b.column(0).slice(lo, 64):
                    record = t.as_py().encode()
                    size = len(record) + len(end)
                    if held and held + size > archive_bytes:
                        file, held = file + 1, 0
                    held += size
                    members.append(gzip_member(record + end) if packed else record)
                    files.append(file)
                yield pa.record_batch([pa.array(members, pa.binary()), pa.array(files, pa.int32())], ["value", "file"])

    # Spark's strings are bytes, and its text writer writes them as they are
    lines = records.select(text.alias("value")).mapInArrow(run, "value binary, file int").select(F.col("value").cast("string").alias("value"), "file")
    lines.write.partitionBy("file").option("lineSep", "\0" if packed else end.decode()).option("compression", "none").text(path)


def _headers(block: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name; of lines with one name the first."""
    found: dict[str, str] = {}
    for x in block.split(b"\r\n")[1:]:
        name, _, value = x.partition(b":")
        found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def _length(headers: dict[str, str]) -> int | None:
    value = headers.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


class Window:
    """The part of a stream of bytes that is being looked at: what lies before it is dropped, what follows is fetched on demand."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.start = chunks, bytearray(), 0

    def reach(self, n: int) -> bool:
        """Whether the window has n bytes, after fetching."""
        while len(self.data) < n:
            more = next(self.chunks, None)
            if more is None:
                return False
            self.data += more
        return True

    def find(self, what: bytes, at: int, limit: int | None = None) -> int:
        """Where `what` begins, from `at` on, or -1; fetches as it goes."""
        while (here := self.data.find(what, at)) < 0:
            at = max(at, len(self.data) - len(what) + 1)
            if limit is not None and at > limit or not self.reach(len(self.data) + 1):
                return -1
        return here

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.start += n


def parse_record(w: Window, at: int = 0):
    """(headers, http block, payload, end) of the record at `at` in the window, or the reason why there is none."""
    w.reach(at + 7)
    if w.data[at : at + 7] != VERSION:
        return "no version line"
    stop = w.find(b"\r\n\r\n", at, at + (1 << 20))
    if stop < 0:
        return "header has no end"
    h = _headers(bytes(w.data[at:stop]))
    length = _length(h)
    if length is None:
        return "no length"
    lo, hi = stop + 4, stop + 4 + length
    if length > MOST_BYTES or not w.reach(hi):
        return "cut short"
    w.reach(hi + 4)
    if w.data[hi : hi + 4] not in (b"\r\n\r\n", b""):
        return "length is wrong"
    body = w.data.find(b"\r\n\r\n", lo, hi) + 4
    if body < 4:
        body = lo
    payload = bytes(w.data[body:hi])
    named = h.get("warc-payload-digest", "").partition(":")
    if h.get("warc-type") == "response" and named[0] == "sha256" and hashlib.sha256(payload).hexdigest() != named[2]:
        return "digest is wrong"
    return h, bytes(w.data[lo:body]), payload, min(hi + 4, len(w.data))


def _plain(w: Window, member: int) -> Iterator[tuple]:
    """('record', member, start, headers, http, payload) and ('gap', member, start, end, reason) of a stream of text."""
    while w.reach(1):
        found = parse_record(w)
        if not isinstance(found, str):
            yield ("record", member, w.start, *found[:3])
            w.drop(found[3])
            continue
        start, reason = w.start, found
        # the next valid record after a line's end; bytes that can't be its start are dropped on the way
        at = 1
        while (here := w.find(b"\n" + VERSION, at - 1)) >= 0:
            w.drop(here + 1)
            if not isinstance(parse_record(w), str):
                break
            at = 1
        if here < 0:
            w.drop(len(w.data))
        yield ("gap", member, start, w.start, reason)


class _Member:
    """The gzip member at `at` of data as a stream; end (None if it is damaged) and wrong (the reason) are set when it has been read."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.end, self.wrong = data, at, None, "gzip: not read"

    def chunks(self) -> Iterator[bytes]:
        z, pos = zlib.decompressobj(31), self.at
        self.wrong = "gzip: cut short"
        try:
            while not z.eof and (pos < len(self.data) or z.unconsumed_tail):
                part = z.unconsumed_tail or self.data[pos : (pos := min(pos + _STEP, len(self.data)))]
                yield z.decompress(part, 16 * _STEP)
        except zlib.error as e:
            self.wrong = f"gzip: {e}"[:80]
        if z.eof:
            self.end, self.wrong = pos - len(z.unused_data) - len(z.unconsumed_tail), ""


def salvage(data) -> Iterator[tuple]:
    """All records of an archive (bytes or a buffer) that pass their checks, and the gaps between them. member is a gzip
    member's offset in the file, -1 in plain text; other offsets are in the member's text, or in the file."""
    data, at = memoryview(data).cast("B"), 0
    while at < len(data):
        if data[at : at + 3] == _GZIP:
            m = _Member(data, at)
            tail = None
            for x in _plain(Window(m.chunks()), at):
                # the last gap of a damaged member is part of the damage
                if tail:
                    yield tail
                tail = x if x[0] == "gap" else None
                if not tail:
                    yield x
            if not m.wrong:
                if tail:
                    yield tail
                at = m.end
                continue
            wrong = m.wrong
        elif data[at : at + 7] == VERSION:
            # plain text, up to a member that holds a record
            end = _next_member(data, at + 1)
            for x in _plain(Window(bytes(data[k : min(k + _STEP, end)]) for k in range(at, end, _STEP)), -1):
                yield (x[0], -1, x[2] + at, *([x[3] + at, x[4]] if x[0] == "gap" else x[3:]))
            at = end
            continue
        else:
            wrong = "neither a member nor a version line"
        start, at = at, min(_next_member(data, at + 1), _next_plain(data, at + 1))
        yield ("gap", -1, start, at, wrong)


def _next_member(data: memoryview, at: int) -> int:
    """Where the next gzip member begins that holds a valid record first, or nothing; else the end."""
    for found in re.compile(re.escape(_GZIP)).finditer(data, at):
        m = _Member(data, found.start())
        w = Window(m.chunks())
        if not isinstance(parse_record(w), str) or (not w.reach(1) and not m.wrong):
            return found.start()
    return len(data)


def _next_plain(data: memoryview, at: int) -> int:
    """Where the next valid record of plain text begins, else the end."""
    for found in re.compile(re.escape(VERSION)).finditer(data, at):
        lo = found.start()
        if not isinstance(parse_record(Window(bytes(data[k : k + _STEP]) for k in range(lo, len(data), _STEP))), str):
            return lo
    return len(data)


_FIELDS = "kind string, path string, member long, start long, end long, reason string, record_id string, record_type string, refers_to string, target_uri string, named_digest string, http_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record (kind 'record') and each quarantined gap (kind 'gap') of the archives under path."""
    import pyarrow as pa

    scratch.ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _FIELDS.split(", ")]

    def batch(rows):
        return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, held = [], 0
                name = b.column(0)[k].as_py()
                for x in salvage(b.column(1)[k].as_buffer()):
                    if x[0] == "gap":
                        rows.append(dict(zip(("kind", "member", "start", "end", "reason"), x), path=name))
                    else:
                        h = x[3]
                        rows.append({
                            "kind": "record", "path": name, "member": x[1], "start": x[2], "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"),
                            "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "named_digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
                            "http_bytes": _length(_headers(x[4])), "payload": x[5],
                        })
                        held += len(x[5])
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    # one file a batch in the hands of a worker: archives aren't gathered
    return files.mapInArrow(run, _FIELDS)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back. A gap in what was just written is an error, not a page less."""
    path = scratch.new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS long)")
    is_revisit = F.col("record_type") == "revisit"
    found = scratch.written(
        read_archives(spark, path).select(
            "kind", "path", "start", "end", "reason",
            page("record_id").alias("page_id"),
            F.when(is_revisit, F.col("http_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
            F.when(is_revisit, F.col("named_digest")).otherwise(F.sha2(F.col("payload"), 256)).alias("payload_digest"),
            "record_type",
            page("refers_to").alias("refers_to"),
        ),
        "warc-records",
    )
    gap = found.where("kind = 'gap'").head(1)
    if gap:
        raise RuntimeError(f"an archive that was just written has a gap: {gap[0]}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
