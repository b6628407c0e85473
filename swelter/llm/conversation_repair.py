"""Conversation structure repair by weighted CYK parsing.

A conversation is well formed if its role initials read `(s?(ua)+)?`: an optional system turn, then pairs of user and
assistant. Rows have faults (blank, duplicate, truncated), and edits have costs: keep 0, rerole to user or assistant 2, delete 3
(a must for blank rows and duplicates), insert an empty turn anywhere 2, and 1 for each truncated row that isn't deleted. The
cheapest edits are found, of equal costs those whose initials (K, R, D, I) are least in ASCII order.

The repair grammar has a nonterminal for every kind of fragment of a well-formed conversation: empty, or its first and last initial
(with an s at its start or without). Its rules are in Chomsky normal form: two fragments that may meet make a third. A cell
holds, for each nonterminal, the least (cost, audit) of a span of rows, closed under insertions at both ends. Cells are combined bottom-up
by span length, over all splits for spans of up to LEAF rows. Fragments can be cut anywhere into fragments, so one split finds a
longer span's least cell, and longer spans are joined two by two. (Two audits of equal cost for one span never begin one another,
since whatever one has beyond the other costs something; so the least of two parts make the least of the whole.)

Rows are sorted by ranges of (conversation, turn), so that a conversation of any length lies in order over one or more partitions, and
get increasing positions; CHUNK positions make a span that a task parses, and a conversation's spans are joined at the end. Only
positions and audits meet there, never texts. A conversation's audit is one string, so a byte a row must fit in a task a few times.

Order: turns, nulls first; equal turns by role and text. Nulls: a null role or text counts as one space; null conv_ids are one
conversation. Empty tables give empty results. Repeated rows are duplicates. Roles of other initials can only be reroled or
deleted. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Costs of the edits: rerole, delete, insert, keep or rerole a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a span whose splits are all tried; bits of positions in a chunk.
LEAF, CHUNK_BITS = 12, 12
LEGAL = ("su", "ua", "au")
#: Nonterminals: the empty fragment, and the first and last initial of the others.
FRAGMENTS = ["", "ss", "su", "sa", "uu", "ua", "au", "aa"]
_AT = {x: k for k, x in enumerate(FRAGMENTS)}
#: Binary rules: (whole, left, right).
RULES = [(_AT[x + y], _AT[x + p], _AT[q + y]) for p, q in LEGAL for x in "sua" for y in "sua" if x + p in _AT and q + y in _AT and x + y in _AT]
RULES += [(k, k, 0) for k in range(len(FRAGMENTS))] + [(k, 0, k) for k in range(1, len(FRAGMENTS))]
#: Whole conversations.
START = [_AT[""], _AT["ua"], _AT["sa"]]
#: A row's class: its initial, or x; in capitals if truncated. Rows that must go: the digits, by the same initials.
CLASSES = {"ok": "suax", "truncated": "SUAX", "gone": "0123"}
_GONE = str.maketrans("0123", "dddd")
_INITIAL = str.maketrans("SUAX0123", "suaxsuax")

Cell = list  # of (cost, audit) or None, by nonterminal


def _put(cell: Cell, k: int, found: tuple[int, str]) -> bool:
    if cell[k] is None or found < cell[k]:
        cell[k] = found
        return True
    return False


def join(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """The cell of a span from those of its two parts."""
    cell = into or [None] * len(FRAGMENTS)
    for k, a, b in RULES:
        x, y = left[a], right[b]
        if x and y:
            cost = x[0] + y[0]
            if cell[k] is None or cost <= cell[k][0]:
                _put(cell, k, (cost, x[1] + y[1]))
    return cell


_INSERTED: Cell = [None] * len(FRAGMENTS)
_INSERTED[_AT["uu"]] = _INSERTED[_AT["aa"]] = (INSERT, "I")


def closed(cell: Cell) -> Cell:
    """The cell with all insertions at its ends that make another or a cheaper fragment."""
    while True:
        before = list(cell)
        join(_INSERTED, before, cell)
        join(before, _INSERTED, cell)
        if cell == before:
            return cell


def terminal(kind: str) -> Cell:
    """The cell of one row."""
    cell: Cell = [None] * len(FRAGMENTS)
    cell[0] = (DELETE, "D")
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for x in "ua":
            _put(cell, _AT[x + x], (REROLE + more, "R"))
        if (x := kind.lower()) in "sua":
            _put(cell, _AT[x + x], (more, "K"))
    return closed(cell)


class Parser:
    """Cells of spans. What a span's cell is depends on its rows' classes alone, so cells are kept by class string."""

    def __init__(self, most: int = 200_000):
        self.cells: dict[str, Cell] = {}
        self.most = most

    def chart(self, kinds: str) -> Cell:
        """CYK over all spans of up to LEAF rows, shortest first, and all their splits."""
        cells, n = self.cells, len(kinds)
        if len(cells) > self.most:
            cells.clear()
        for length in range(1, n + 1):
            for i in range(n - length + 1):
                span = kinds[i : i + length]
                if span not in cells:
                    if length == 1:
                        cells[span] = terminal(span)
                    else:
                        cell: Cell = [None] * len(FRAGMENTS)
                        for k in range(1, length):
                            join(cells[span[:k]], cells[span[k:]], cell)
                        cells[span] = closed(cell)
        return cells[kinds]

    def parse(self, kinds: str) -> Cell:
        return merge([self.chart(kinds[i : i + LEAF]) for i in range(0, len(kinds), LEAF)])


def merge(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, joined two by two."""
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def scripts(audit: str, chunks: list[str]) -> Iterator[str]:
    """What becomes of each chunk's rows (class strings): K kept, U and A reroled, D deleted, u and a inserted before the next row (at
    the end of the last chunk: after it). The audit and the kept rows say which role each has."""
    at, last = 0, ""
    for c, kinds in enumerate(chunks):
        out, k = [], 0
        kinds = kinds.translate(_INITIAL).lower()
        while at < len(audit) and (k < len(kinds) or c == len(chunks) - 1):
            edit = audit[at]
            at += 1
            turn = "a" if last == "u" else "u"
            if edit == "K":
                out.append("K")
                last = kinds[k]
            elif edit in "RI":
                out.append(turn.upper() if edit == "R" else turn)
                last = turn
            else:
                out.append("D")
            k += edit != "I"
        yield "".join(out)


def row_scripts(script: str, sizes: list[int]) -> Iterator[str]:
    """The parts of a chunk's script by row (a row stands for sizes[k] equal ones)."""
    at = 0
    for k, size in enumerate(sizes):
        start = at
        while size and at < len(script):
            size -= script[at] not in "ua"
            at += 1
        yield (script[start:at] if k < len(sizes) - 1 else script[start:]).replace("D", "")


def mark(rows: DataFrame) -> DataFrame:
    """A written table, a row for equal rows of a conversation's turn: conv_id, turn, role, text, copies, fault of the first,
    kinds (class string) and pos (increasing by conversation, turn, role and text). rows: conv_id, turn, role, text."""
    clean = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    counted = clean.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")), F.length("role").cast("string"), "role", "text"), 256)
    keyed = scratch.written(counted.withColumn("same", key), "turns")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    many = keyed.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # keys that many turns hold are joined by broadcast, of which there are few; the rest by a shuffle
    total = keyed.count()
    hot = scratch.written(many.where(F.col("n") * scratch.HOT_SHARE > total), "hot-turns")
    held, rest = keyed.join(F.broadcast(hot), "same"), keyed.join(F.broadcast(hot.select("same")), "same", "left_anti")
    cold = many.where(F.col("n") * scratch.HOT_SHARE <= total)
    both = held.unionByName(rest.join(cold, "same", "left"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.coalesce(F.col("first") < order, F.lit(False))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(again, "duplicate").when(cut, "truncated")
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(4)
    kind = lambda c: F.substring(F.lit(CLASSES[c]), initial, F.lit(1))  # noqa: E731
    first = F.when(F.col("fault").isin("blank", "duplicate"), kind("gone")).when(F.col("fault") == "truncated", kind("truncated")).otherwise(kind("ok"))
    kinds = F.concat(first, F.repeat(kind("gone"), (F.col("copies") - 1).cast("int")))
    tie = F.concat("role", F.lit("\x00"), "text")
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.withColumn("fault", fault).withColumn("kinds", kinds).repartitionByRange(parts, *by, F.substring(tie, 1, 96)).sortWithinPartitions(*by, tie)
    return scratch.written(placed.select("conv_id", "turn", "role", "text", "copies", "fault", "kinds", F.monotonically_increasing_id().alias("pos")), "marked")


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def parse(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (conv_id, key, pos, sizes, kinds and their cells) and conversations (conv_id, cost, audit, illegal and the scripts of their
    spans, by key); both are written tables."""
    import pyarrow as pa

    scratch.ship(marked.sparkSession)
    kind = marked.schema["conv_id"].dataType.simpleString()
    grouped = marked.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(F.min("pos").alias("key"), F.sort_array(F.collect_list(F.struct("pos", "copies", "kinds"))).alias("rows"))
    listed = grouped.select("conv_id", "key", F.col("rows.pos").alias("pos"), F.col("rows.copies").alias("sizes"), F.concat_ws("", "rows.kinds").alias("kinds"))

    def parse_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for b in batches:
            costs, audits = [], []
            for kinds in b.column("kinds").to_pylist():
                cell = parser.parse(kinds.translate(_GONE))
                costs.append([x and x[0] for x in cell])
                audits.append([x and x[1] for x in cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], [*b.schema.names, "costs", "audits"])

    spans = scratch.written(listed.mapInArrow(parse_spans, f"conv_id {kind}, key long, pos array<long>, sizes array<long>, kinds string, costs array<long>, audits array<string>"), "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "cost", "audit", "illegal", "keys", "scripts"]
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                cell = merge([[None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])] for p in parts])
                cost, audit = min(cell[k] for k in START if cell[k])
                kinds = [p["kinds"] for p in parts]
                out.append((cost, audit, _illegal("".join(kinds).translate(_INITIAL)), [p["key"] for p in parts], list(scripts(audit, kinds))))
            kinds_of = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds_of)]], names)

    whole = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("key", "kinds", "costs", "audits"))).alias("parts"))
    return spans, scratch.written(whole.mapInArrow(finish, f"conv_id {kind}, cost long, audit string, illegal long, keys array<long>, scripts array<string>"), "parsed")


def repaired(marked: DataFrame, spans: DataFrame, parsed: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, pos, sub (both in order), turn (null for inserted rows), role, text, edit."""
    import pyarrow as pa

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, scripts_ = [], []
            for at, sizes, script in zip(*(b.column(c).to_pylist() for c in ("pos", "sizes", "script"))):
                for p, part in zip(at, row_scripts(script, sizes)):
                    if part:
                        pos.append(p)
                        scripts_.append(part)
            yield pa.record_batch([pa.array(pos, pa.int64()), pa.array(scripts_, pa.string())], ["pos", "script"])

    told = parsed.select(F.explode(F.arrays_zip("keys", "scripts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.scripts").alias("script"))
    by_row = spans.select("key", "pos", "sizes").join(told, "key").select("pos", "sizes", "script").mapInArrow(split, "pos long, script string")
    turns = marked.join(by_row, "pos").select("conv_id", "pos", "turn", "role", "text", F.posexplode(F.split("script", "")).alias("sub", "op")).where("op <> ''")
    inserted = F.col("op").isin("u", "a")
    return turns.select(
        "conv_id", "pos", "sub", F.when(~inserted, F.col("turn")).alias("turn"),
        F.when(F.lower("op") == "u", "user").when(F.lower("op") == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"), F.when(inserted, "insert").when(F.col("op") == "K", "keep").otherwise("rerole").alias("edit"),
    )  # fmt: skip


def counts(marked: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated: what is wrong with each conversation's rows."""
    turns = marked.groupBy("conv_id", "turn").agg(*[F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum(F.col("copies") - 1).alias("more"), F.sum(F.when(F.col("fault") == "blank", F.col("copies") - 1).otherwise(0)).alias("more_blank"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), F.sum(F.col("blank") + F.col("more_blank")).alias("blank"), F.sum(F.col("duplicate") + F.col("more") - F.col("more_blank")).alias("duplicate"), F.sum("truncated").alias("truncated"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 of the lines `role:text` of its rows, newline-joined. Lines stream through a task in order, one batch
    in memory; a digest takes its input in order, so one conversation can't be dealt to several tasks."""
    import pyarrow as pa

    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, held, current, ids, found = pa.null(), None, None, [], []
        for b in batches:
            id_type = b.schema.field("conv_id").type
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
                if held is None or conv != current:
                    if held is not None:
                        ids.append(current)
                        found.append(held.hexdigest())
                    held, current = hashlib.sha256(line.encode()), conv
                else:
                    held.update(b"\n" + line.encode())
            yield pa.record_batch([pa.array(ids, id_type), pa.array(found, pa.string())], ["conv_id", "sha256"])
            ids, found = [], []
        if held is not None:
            yield pa.record_batch([pa.array([current], id_type), pa.array([held.hexdigest()], pa.string())], ["conv_id", "sha256"])

    lines = rows.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role, by a hash of conversation and turn. rows: conv_id, turn, role, text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    told = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("how")).where("how <> 0")
    how = F.col("how")
    return told.select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")  # fmt: skip


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired rows (see `repaired`)."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    marked = mark(rows)
    spans, parsed = parse(marked)
    found = counts(marked).unionByName(parsed.select("conv_id", "illegal", "cost", "audit"), allowMissingColumns=True)
    report = found.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in found.columns[1:]])
    return report, repaired(marked, spans, parsed)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage: what is wrong with it, its cheapest repair and the repaired text's digest."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, mended = repair(damaged(rows))
    parts = rows.select("conv_id").distinct().unionByName(report, allowMissingColumns=True).unionByName(digests(mended).withColumnRenamed("sha256", "repaired_sha256"), allowMissingColumns=True)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )  # fmt: skip


OP11_SQL = r"""
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT)) % 20 AS how FROM src),
hurt AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE how <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
told AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND concat(before, x) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY c),
fills AS (
  SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'u', 2, 'I', 'user:'), ('', 'a', 4, 'II', 'user:|assistant:'), ('s', 's', 0, '', ''), ('s', 'u', 2, 'I', 'user:'), ('s', 'a', 4, 'II', 'user:|assistant:'),
    ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', 'assistant:'), ('u', 'u', 4, 'II', 'assistant:|user:'), ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', 'user:'), ('a', 'a', 4, 'II', 'user:|assistant:')) AS t(p, q, cost, audit, made)),
edits AS (
  SELECT c, i, p, q, edit, cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END AS cost,
         CASE edit WHEN 'K' THEN concat(role, ':', text) WHEN 'R' THEN concat(CASE q WHEN 'u' THEN 'user:' ELSE 'assistant:' END, text) END AS made
  FROM faults, (VALUES ('', 's', 'K', 0), ('', 'u', 'K', 0), ('s', 'u', 'K', 0), ('u', 'a', 'K', 0), ('a', 'u', 'K', 0), ('', 'u', 'R', 2), ('s', 'u', 'R', 2), ('u', 'a', 'R', 2), ('a', 'u', 'R', 2),
    ('', '', 'D', 3), ('s', 's', 'D', 3), ('u', 'u', 'D', 3), ('a', 'a', 'D', 3)) AS t(p, q, edit, cost)
  WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR x = q))),
states AS (
  SELECT c, CAST(0 AS BIGINT) AS i, '' AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'made': CAST([] AS VARCHAR[])} AS best FROM told
  UNION ALL
  SELECT s.c, e.i, e.q, min({'cost': CAST(s.best.cost + f.cost + e.cost AS BIGINT), 'audit': concat(s.best.audit, f.audit, e.edit),
         'made': list_concat(s.best.made, CASE WHEN f.made = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(f.made, '|') END, CASE WHEN e.made IS NULL THEN CAST([] AS VARCHAR[]) ELSE [e.made] END)})
  FROM states s JOIN fills f ON f.p = s.q JOIN edits e ON e.c = s.c AND e.i = s.i + 1 AND e.p = f.q GROUP BY s.c, e.i, e.q),
ends AS (
  SELECT s.c, min({'cost': CAST(s.best.cost + f.cost AS BIGINT), 'audit': concat(s.best.audit, f.audit), 'made': list_concat(s.best.made, CASE WHEN f.made = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(f.made, '|') END)}) AS best
  FROM states s JOIN told t ON t.c = s.c AND t.n = s.i JOIN fills f ON f.p = s.q AND f.q IN ('', 'a') GROUP BY s.c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.c = t.c
"""
