"""Zip archives by their tables of contents: what lies in them, chosen members' lines, and what is damaged.

Archives are read in splits, as Spark's text reader cuts files at line feeds, and written as a table of small pieces with their places, so that no task
holds an archive, however large it is. A first pass looks at the last pieces of each archive only, where its table of contents is, and gives a row for each
member. What to read is chosen from these rows. A second pass cuts the chosen members out of the pieces, still packed, and deals them to tasks: a member is
unpacked in one task, piece by piece, however many lie in one archive, and those that nobody chose are never unpacked. A member counts only if its size and
checksum are right; otherwise, and for archives without a table of contents, there is a row that says so.
"""

from __future__ import annotations

import itertools
import struct
import tempfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swelter.sources import shared

#: Bytes at the end of an archive in which its table of contents is looked for first; more are taken where it begins before them.
TAIL = 1 << 20
#: Bytes of text that leave a task in a row, if a line isn't longer, and such rows that leave it together.
TEXT, TEXTS = 1 << 16, 100
#: Bytes of a piece of an archive (Spark hands up to 10,000 rows at a time to Python), and pieces that leave a task together.
PIECE, PIECES = 1 << 11, 1000
#: Bytes of pieces that a Parquet reader or writer holds in memory.
ROW_GROUP = 1 << 23
#: Bytes of an archive by which pieces and members find each other.
CHUNK = 1 << 20
#: Bytes of a packed member or table of contents that a task holds in memory; what is beyond goes to a file of the task.
HELD = 1 << 24
#: Bytes that are read or unpacked at once.
STEP = 1 << 16
#: Ends of names of files that Spark's text reader would unpack: its file source reads each of them in one row, so they must stay under 2 GB.
PACKED_TEXT = ["bz2", "deflate", "gz", "lz4", "snappy", "zst"]
_CONTENTS = "archive string, name string, start long, span long, packed long, size long, crc long, method int, encrypted boolean, damage string"
_LINES = "archive string, name string, line_no int, text string, damage string"


def _gathered(rows: Iterator[tuple], size: int) -> Iterator[tuple]:
    """Pieces of at most `size` bytes, or of one part, of parts that follow each other: archive, length, split, at (from the split's first part), n, bytes."""
    for key, own in itertools.groupby(rows, lambda r: r[:3]):
        at, n, some = 0, 0, []
        for *_, part in own:
            if some and n + len(part) > size:
                yield *key, at, n, b"".join(some)
                at, n, some = at + n, 0, []
            some.append(part)
            n += len(part)
        yield *key, at, n, b"".join(some)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the files under path: archive, length (of the file), at (where the piece begins), n, bytes. They are a written table, as a split begins
    after a line feed: where that is, is known only once the splits before it are counted, and another read may be split otherwise. A line feed that
    the file doesn't have may follow its last byte."""
    shared.ship(spark)
    of = [F.col(f"_metadata.{c}").alias(a) for a, c in (("archive", "file_path"), ("length", "file_size"), ("split", "file_block_start"))]
    is_text = ~F.col("_metadata.file_name").rlike(rf"(?i)\.({'|'.join(PACKED_TEXT)})$")
    lines = spark.read.option("lineSep", "\n").text(path).where(is_text).select(*of, F.col("value").cast("binary").alias("bytes"), F.lit(b"\n").alias("end"))
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in PACKED_TEXT)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{any_case}}}").load(path)
    rows = lines.unionByName(whole.select(*of, F.col("content").alias("bytes"), F.lit(b"").alias("end")))
    size = PIECE
    last = f"(greatest(length(bytes), 1) - 1) div {size}"
    parts = rows.select("*", F.explode(F.expr(f"sequence(0L, {last})")).alias("k"))
    some = f"substring(bytes, CAST(k * {size} + 1 AS INT), {size})"
    part = F.expr(f"CASE WHEN k < {last} THEN {some} ELSE concat({some}, end) END").alias("part")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        found = (r for pdf in batches for r in zip(pdf["archive"], pdf["length"], pdf["split"], pdf["part"]))
        made = _gathered(found, size)
        while some := list(itertools.islice(made, PIECES)):
            yield pd.DataFrame(some, columns=["archive", "length", "split", "at", "n", "bytes"])

    # rows of a split keep their order up to here
    cut = parts.select("archive", "length", "split", part).mapInPandas(run, "archive string, length long, split long, at long, n long, bytes binary")
    cut = shared.written(cut, "archive-pieces", **{"parquet.block.size": ROW_GROUP})
    splits = cut.groupBy("archive", "length", "split").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("archive").orderBy("split")) - F.col("n")
    # the reader leaves out a file's first three bytes if they mark UTF-8
    mark = F.when(F.sum("n").over(Window.partitionBy("archive")) < F.col("length"), 3).otherwise(0)
    # reserved characters are escaped in the metadata's paths, but a plus isn't
    name = F.url_decode(F.replace(F.col("archive"), F.lit("+"), F.lit("%2B")))
    starts = shared.written(splits.select("archive", "split", name.alias("path"), (before + mark).alias("start")), "archive-splits")
    placed = cut.join(shared.small(starts), ["archive", "split"])
    return placed.select(F.col("path").alias("archive"), "length", (F.col("start") + F.col("at")).alias("at"), "n", "bytes")


class _Before(Exception):
    """Bytes are wanted that lie before those at hand."""


class _End:
    """The last bytes of a file (those in `held`) as that file."""

    def __init__(self, held: BinaryIO, before: int, length: int):
        self.held, self.before, self.length, self.at = held, before, length, 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.at, self.length)[whence]
        if to < 0:
            raise OSError("before the file's first byte")
        self.at = to
        return to

    def read(self, n: int = -1) -> bytes:
        if self.at < self.before:
            raise _Before(self.at)
        self.held.seek(self.at - self.before)
        data = self.held.read(max(0, self.length - self.at) if n is None or n < 0 else max(0, min(n, self.length - self.at)))
        self.at += len(data)
        return data


def _members(archive: str, file: BinaryIO) -> tuple[list[tuple], int | None]:
    """The members that the table of contents of an archive lists, and from where on bytes are wanted if those at hand don't hold it."""
    import zipfile

    try:
        with zipfile.ZipFile(file) as z:
            found, end = z.infolist(), z.start_dir
    except _Before as e:
        return [(archive, *[None] * 9)], e.args[0]
    except Exception as e:  # noqa: BLE001  any way in which a file can fail to be an archive
        return [(archive, *[None] * 8, f"no table of contents: {e}")], None
    starts = sorted({x.header_offset for x in found} | {end})
    following = dict(zip(starts, starts[1:]))
    rows = []
    for x in found:
        start = x.header_offset
        if not x.is_dir():
            wrong = None if 0 <= start < end else "the table of contents points outside the archive"
            rows.append((archive, x.filename, start, following.get(start, end) - start, x.compress_size, x.file_size, x.CRC, x.compress_type, bool(x.flag_bits & 1), wrong))
    return rows, None


def contents(spark: SparkSession, path: str, held: DataFrame | None = None) -> DataFrame:
    """A row for each member of the archives under path: archive, name, start and span (of its bytes in the archive), packed and size (bytes), crc, method, encrypted,
    damage. An archive that can't be read has one row, with damage and no name (files of no bytes aren't listed by Spark's reader). Only the archives' last bytes
    reach the tasks that look. held: their `pieces`, if they are there already."""
    shared.ship(spark)
    held = pieces(spark, path) if held is None else held

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        rows = (r for pdf in batches for r in zip(pdf["archive"], pdf["length"], pdf["at"], pdf["bytes"]))
        for (archive, length), own in itertools.groupby(rows, lambda r: r[:2]):
            with tempfile.SpooledTemporaryFile(HELD) as tail:
                before = None
                for *_, at, data in own:
                    before = at if before is None else before
                    tail.write(data)
                found, wanted = _members(archive, _End(tail, before, length))
            listed = pd.DataFrame(found, columns=[c.split()[0] for c in _CONTENTS.split(", ")])
            yield listed.astype({c: "Int64" for c in ("start", "span", "packed", "size", "crc", "method")}).assign(wanted=pd.array([wanted] * len(listed), "Int64"))

    def listed(ends: DataFrame) -> DataFrame:
        dealt = ends.repartition("archive").sortWithinPartitions("archive", "at")
        return shared.written(dealt.mapInPandas(run, _CONTENTS + ", wanted long"), "contents")

    got = listed(held.where(F.col("at") + F.col("n") > F.col("length") - TAIL))
    out = got.where("wanted IS NULL")
    # tables that begin earlier: from there on
    while (more := got.where("wanted IS NOT NULL").select("archive", "wanted")).head(1):
        got = listed(held.join(shared.small(more), "archive").where(F.col("at") + F.col("n") > F.col("wanted")).drop("wanted"))
        out = out.unionByName(got.where("wanted IS NULL"))
    return out.drop("wanted")


def unpacked(member: BinaryIO, packed: int, method: int) -> Iterator[bytes]:
    """The bytes of a member (a file, local header first) in parts of bounded size."""
    member.seek(0)
    head = member.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    member.seek(30 + sum(struct.unpack("<HH", head[26:30])))
    if method not in (0, 8):
        raise ValueError(f"method {method} isn't supported")
    z, left = zlib.decompressobj(-15) if method == 8 else None, packed
    while left > 0 and (data := member.read(min(STEP, left))):
        left -= len(data)
        if z is None:
            yield data
            continue
        while data and not z.eof:
            yield z.decompress(data, STEP)
            data = z.unconsumed_tail
    if z is not None:
        yield z.flush()


def member_fault(member: BinaryIO, packed: int, size: int, crc: int, method: int, encrypted: bool) -> str | None:
    """Why a member's bytes can't be taken, or None."""
    if encrypted:
        return "encrypted"
    found, n = 0, 0
    try:
        for part in unpacked(member, packed, method):
            found, n = zlib.crc32(part, found), n + len(part)
    except (ValueError, zlib.error, struct.error) as e:
        return str(e)
    return "size is wrong" if n != size else "checksum is wrong" if found != crc else None


def _texts(parts: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    """(number of the first line, whole lines) of a member's bytes, of at least TEXT bytes but for the last; the last line's feed is left out."""
    line_no, n, some = 0, 0, []
    for part in parts:
        end = part.rfind(b"\n") if n + len(part) >= TEXT else -1
        if end < 0:
            some.append(part)
            n += len(part)
            continue
        text = b"".join([*some, part[:end]])
        yield line_no, text.decode("latin-1")
        line_no += text.count(b"\n") + 1
        some, n = [part[end + 1 :]], len(part) - end - 1
    if rest := b"".join(some):
        yield line_no, rest.removesuffix(b"\n").decode("latin-1")


def member_lines(spark: SparkSession, path: str, chosen: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Lines of chosen members (rows of `contents`) of the archives under path: archive, name, line_no, line. A damaged member has one row, with
    damage and no line: members are checked before their first line leaves the task. held: the archives' `pieces`, if they are there already."""
    shared.ship(spark)
    held = pieces(spark, path) if held is None else held
    fields = ["name", "start", "span", "packed", "size", "crc", "method", "encrypted"]
    members = chosen.where("damage IS NULL").select("archive", *fields).distinct()
    over = lambda at, n: F.explode(F.expr(f"sequence({at} div {CHUNK}, ({at} + {n} - 1) div {CHUNK})")).alias("chunk")
    told = held.select("archive", "at", "n", "bytes", over("at", "n")).join(shared.small(members.select("*", over("start", "span"))), ["archive", "chunk"])
    # a pair that meets in two chunks counts in the first
    told = told.where(f"at < start + span AND at + n > start AND chunk = greatest(at, start) div {CHUNK}")
    cut = F.expr("substring(bytes, CAST(greatest(start - at, 0L) + 1 AS INT), CAST(least(at + n, start + span) - greatest(at, start) AS INT))")
    slices = told.select("archive", *fields, "at", cut.alias("bytes"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in _LINES.split(", ")]
        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        # a member's pieces follow each other
        for _, own in itertools.groupby(rows, lambda r: (r.archive, r.name, r.start)):
            with tempfile.SpooledTemporaryFile(HELD) as member:
                for r in own:
                    member.write(r.bytes)
                wrong = member_fault(member, r.packed, r.size, r.crc, r.method, r.encrypted)
                if wrong:
                    yield pd.DataFrame([(r.archive, r.name, None, None, wrong)], columns=columns).astype({"line_no": "Int32"})
                    continue
                made = ((r.archive, r.name, *x, None) for x in _texts(unpacked(member, r.packed, r.method)))
                while some := list(itertools.islice(made, TEXTS)):
                    yield pd.DataFrame(some, columns=columns)

    dealt = slices.repartition("archive", "name").sortWithinPartitions("archive", "name", "start", "at")
    # a damaged member's row has no text, and so no number of a line
    split = dealt.mapInPandas(run, _LINES).select("archive", "name", "damage", "line_no", F.posexplode_outer(F.split("text", "\n")).alias("k", "line"))
    line_no = (F.col("line_no") + F.col("k")).alias("line_no")
    return split.select("archive", "name", line_no, F.rtrim("line", F.lit("\r")).alias("line"), "damage")


def damage(listed: DataFrame, lines: DataFrame) -> DataFrame:
    """archive, name (null: the whole archive), damage: what `contents` and `member_lines` could not read."""
    of = lambda df: df.where("damage IS NOT NULL").select("archive", "name", "damage")
    return of(listed).unionByName(of(lines)).distinct()
