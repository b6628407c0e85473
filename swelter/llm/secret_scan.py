"""Secrets in texts: three patterns, and a battery of randomness tests for other tokens.

Patterns find assignments (a name such as password, then a value), access keys and long hexadecimal strings. Beyond them, tokens of
MIN_LENGTH letters, digits, +, /, - and _ are tested under the encoding whose alphabet is the smallest that holds them:

* three tests of randomness, none of which may reject it at Z standard deviations: chi-squared uniformity over the alphabet (by
  the cube-root approximation, two-sided, so that too even a token fails as well), Wald-Wolfowitz runs of the alphabet's lower and upper half,
  and lag-1 serial correlation of the places in the alphabet;
* one test against ordinary text, in which case letters and digits change places at most with probability TEXT_CHANGE[encoding]: a
  Chernoff bound on the chance of so many changes between lower case, upper case and digits. It is far weaker for short tokens, so the false
  discovery rate is held under FDR by Benjamini and Hochberg's rule in each band of lengths apart, over all tokens of the table.

A token that passes all of them and touches no pattern's span is a span of the kind `random`. Everything is done by column functions: positions come
from the texts between matches, by running sums over arrays; the rule's thresholds come from counts by band and evidence.

Nulls: a null text counts as empty; null and repeated identifiers are rows of their own. Empty tables give empty results. Other columns are ignored.
Work grows with a text's length, but for looking up each token that may be random among its text's pattern spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

MIN_LENGTH, Z, FDR = 16, 3.29, 0.01
#: Lower ends of the bands of lengths.
BANDS = [16, 20, 24, 32, 48, 96]
#: Evidence (natural logarithms) is counted in steps of a tenth, up to this many.
STEPS = 10_000
#: Items of an array that are summed together.
PART = 256


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: What the patterns find, in the order of kinds.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = "(?:" + "|".join(map(_any_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?"""
PATTERNS = {"assign": ASSIGN_HEAD + VALUE, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
KINDS = [*PATTERNS, "random"]
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches that are long enough, found without the many short ones: both kinds match whole runs of their characters, so a
#: match that is too short holds no longer one. (An assignment that is too short may hide another one, so all of them are found.)
SEARCHED = {**PATTERNS, "access": f"AKIA[A-Z0-9]{{{SHORTEST['access'] - 4},}}", "hex": f"[0-9a-f]{{{SHORTEST['hex']},}}"}

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by size of alphabet, each in its natural order.
ENCODINGS = {
    "hex_lower": _DIGITS + _LOWER[:6], "hex_upper": _DIGITS + _LOWER[:6].upper(), "base32": _LOWER.upper() + "234567", "base36_lower": _DIGITS + _LOWER, "base36_upper": _DIGITS + _LOWER.upper(),
    "base62": _LOWER.upper() + _LOWER + _DIGITS, "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/", "base64_url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}
#: How often ordinary tokens change between letters and digits and, in alphabets that have both, between cases (joined words).
TEXT_CHANGE = {name: 0.2 if {"a", "A"} <= set(alphabet) else 0.1 for name, alphabet in ENCODINGS.items()}
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(numbers: Column) -> Column:
    """Sums of an array up to each item, in parts of PART items so that the work is linear in long arrays."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("sums"))
    add = lambda held, x: F.struct((held["sum"] + x).alias("sum"), F.concat(held["sums"], F.array(held["sum"] + x)).alias("sums"))
    one = lambda part: F.aggregate(part, zero, add, lambda held: held["sums"])

    def sums_of(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(PART))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda at: one(F.slice(v, at, F.lit(PART)))), joined)

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), one(F.transform(parts, lambda sums: F.element_at(sums, -1))))
        return let(before, lambda held: F.flatten(F.transform(parts, lambda sums, k: let(F.element_at(held, k + 1), lambda more: F.transform(sums, lambda x: x + more)))))

    return let(numbers, sums_of)


def matches(text: Column, pattern: str) -> Column:
    """An array of (start, end, match) of a pattern's matches from left to right, in code points. The pattern has no groups."""
    whole = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    both = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("match"))

    def placed(x: Column) -> Column:
        ends = running_sums(F.transform(x, lambda m: (F.length(m["gap"]) + F.length(m["match"])).cast("long")))
        return F.filter(F.zip_with(x, ends, lambda m, end: F.struct((end - F.length(m["match"])).alias("start"), end.alias("end"), m["match"].alias("match"))), lambda m: m["match"] != "")

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def _long_enough(kind: str):
    if kind == "assign":
        return lambda x: F.length(F.regexp_extract(x["match"], f"^{ASSIGN_HEAD}({VALUE})", 1)) >= SHORTEST[kind]
    return lambda x: F.length(x["match"]) >= SHORTEST[kind]


def encoding_of(token: Column) -> Column:
    """Name of the smallest alphabet that holds a token's characters; null if none does."""
    out = F
    for name, alphabet in ENCODINGS.items():
        out = out.when(F.translate(token, alphabet, "") == "", name)
    return out


def _by_encoding(encoding: Column, values: dict) -> Column:
    out = F
    for name, v in values.items():
        out = out.when(encoding == name, v)
    return out


def evidence(token: Column, encoding: Column) -> Column:
    """Against ordinary text: minus the logarithm of the Chernoff bound on as many changes of case, letter and digit; 0 if they are no more
    than text has."""
    kinds = F.translate(F.translate(token, "+/-_", ""), _LOWER + _LOWER.upper() + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    counted = lambda k: F.struct((F.length(k) - 1).cast("double").alias("steps"), (F.length(F.regexp_replace(k, "a+|A+|0+", "x")) - 1).cast("double").alias("changes"))

    def bound(x: Column) -> Column:
        q, p = _by_encoding(encoding, TEXT_CHANGE), x["changes"] / x["steps"]
        rest = F.when(x["changes"] < x["steps"], (1 - p) * F.ln((1 - p) / (1 - q))).otherwise(0.0)
        return F.when((x["steps"] >= 1) & (x["changes"] > q * x["steps"]), x["steps"] * (p * F.ln(p / q) + rest)).otherwise(0.0)

    return let(let(kinds, counted), bound)


def battery(token: Column, encoding: Column) -> Column:
    """Whether none of the three tests rejects that a token is random in its encoding."""
    alphabet = _by_encoding(encoding, ENCODINGS)
    places = let(alphabet, lambda a: F.struct(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double")).alias("v"), F.length(a).cast("double").alias("size")))
    return let(let(places, _sums), _passes)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _sums(x: Column) -> Column:
    """n, size (of the alphabet), squares (of the counts by character), high, changes (of the half), mean, variance and lagged products."""
    v, size = x["v"], x["size"]
    pairs = lambda then: _total(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), then))
    squares = _total(F.transform(F.array_distinct(v), lambda x: let(F.size(F.filter(v, lambda y: y == x)).cast("double"), lambda k: k * k)))
    high = _total(F.transform(v, lambda x: F.when(x * 2 > size, 1.0).otherwise(0.0)))
    changes = pairs(lambda a, b: F.when((a * 2 > size) != (b * 2 > size), 1.0).otherwise(0.0))
    around = lambda mean: F.struct(_total(F.transform(v, lambda x: (x - mean) * (x - mean))).alias("variance"), pairs(lambda a, b: (a - mean) * (b - mean)).alias("lagged"))
    return F.struct(F.size(v).cast("double").alias("n"), size.alias("size"), squares.alias("squares"), high.alias("high"), changes.alias("changes"), let(_total(v) / F.size(v), around).alias("around"))


def _passes(x: Column) -> Column:
    n, free, high = x["n"], x["size"] - 1, x["high"]
    spread = 2 / (9 * free)
    even = (F.pow((x["size"] / n * x["squares"] - n) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    wanted = 2 * high * (n - high) / n + 1
    by_runs = F.try_divide(x["changes"] + 1 - wanted, F.sqrt((wanted - 1) * (wanted - 2) / (n - 1)))
    serial = (F.try_divide(x["around"]["lagged"], x["around"]["variance"]) + 1 / n) * F.sqrt(n)
    return F.coalesce((F.abs(even) <= Z) & (F.abs(by_runs) <= Z) & (F.abs(serial) <= Z), F.lit(False))


def band_of(length: Column) -> Column:
    return F.aggregate(F.array(*map(F.lit, BANDS)), F.lit(0), lambda a, low: F.when(length >= low, low).otherwise(a))


def _placed(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def examine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: doc_id, base (spans of the patterns: start, place of the kind, end) and tokens (start, end, band, step of evidence,
    random: whether the battery passes and no pattern's span is touched) of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), *[F.filter(matches(text, p), _long_enough(k)).alias(k) for k, p in SEARCHED.items()], matches(text, TOKEN).alias("tokens"))
    base = F.array_sort(F.concat(*[F.transform(k, _placed(at)) for at, k in enumerate(PATTERNS)]))

    def tested(x: Column) -> Column:
        return let(encoding_of(x["match"]), lambda encoding: let(F.coalesce(F.least(F.floor(evidence(x["match"], encoding) * 10), F.lit(STEPS)), F.lit(0)).cast("int"), lambda step: told(x, encoding, step)))

    def told(x: Column, encoding: Column, step: Column) -> Column:
        clear = ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        random = F.when(step > 0, clear & battery(x["match"], encoding)).otherwise(False)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), band_of(F.length(x["match"])).alias("band"), step.alias("step"), random.alias("random"))

    return scratch.written(found.withColumn("base", base).select("doc_id", "base", F.transform("tokens", tested).alias("tokens")), "tokens")


def thresholds(examined: DataFrame, rate: float = FDR) -> dict[int, int]:
    """For each band the least step of evidence that is a discovery. A step's tokens count with its weakest evidence, and among all
    tokens of the band. At most STEPS rows a band are read."""
    counts = examined.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.step").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for band in {r.band for r in counts}:
        own = sorted(((r.step, r.n) for r in counts if r.band == band), reverse=True)
        total, above = sum(n for _, n in own), 0
        for step, n in own:
            above += n
            if step and total * math.exp(-step / 10) <= rate * above:
                out[band] = step
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) in order: code points, end exclusive."""
    examined = examine(docs, id_col, text_col)
    kinds = F.array(*map(F.lit, KINDS))
    least = {**{b: STEPS + 1 for b in BANDS}, **thresholds(examined, rate)}
    limit = lambda band: F.aggregate(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")) for b, s in least.items()]), F.lit(STEPS + 1), lambda a, x: F.when(x["b"] == band, x["s"]).otherwise(a))
    added = F.transform(F.filter("tokens", lambda t: t["random"] & (t["step"] >= limit(t["band"]))), _placed(len(PATTERNS)))
    spans = F.array_sort(F.concat("base", added))
    return examined.select("doc_id", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["kind"] + 1).alias("kind"), s["end"].alias("end"))).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's spans: counts by pattern, a digest of the patterns' spans and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in PATTERNS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _sql_case(value: str, of: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in of.items()) + " END"


def _sql_patterns() -> str:
    quoted = {k: f"(?s)(.*?)({p}|\\z)".replace("'", "''") for k, p in {**PATTERNS, "random": TOKEN}.items()}
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {KINDS.index(k)} AS place, regexp_extract_all(text, '{p}', 1) AS gaps, regexp_extract_all(text, '{p}', 2) AS found FROM docs" for k, p in quoted.items())


_VALUE_SQL = f"^{ASSIGN_HEAD}({VALUE})".replace("'", "''")
OP12_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_sql_patterns()}),
items AS (SELECT doc_id, kind, place, unnest(gaps) AS gap, unnest(found) AS m, unnest(range(len(found))) AS i FROM raw),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM items),
spans AS (
  SELECT doc_id, kind, place, stop - length(m) AS start, stop, m FROM placed
  WHERE m <> '' AND CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{_VALUE_SQL}', 1)) >= {SHORTEST["assign"]} WHEN 'access' THEN length(m) >= {SHORTEST["access"]} WHEN 'hex' THEN length(m) >= {SHORTEST["hex"]} ELSE true END),
base AS (SELECT * FROM spans WHERE kind <> 'random'),
tokens AS (
  SELECT doc_id, place, start, stop, m, CASE {" ".join(f"WHEN translate(m, '{a}', '') = '' THEN '{k}'" for k, a in ENCODINGS.items())} END AS encoding,
         CASE {" ".join(f"WHEN length(m) >= {b} THEN {b}" for b in reversed(BANDS))} END AS band,
         regexp_replace(m, '[+/_-]', '', 'g') AS plain, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[+/_-]', '', 'g'), '[a-z]+', '!', 'g'), '[A-Z]+', '!', 'g'), '[0-9]+', '!', 'g') AS runs
  FROM spans WHERE kind = 'random'),
changed AS (SELECT *, CAST(length(plain) - 1 AS DOUBLE) AS steps, CAST(length(runs) - 1 AS DOUBLE) AS changes, {_sql_case("encoding", TEXT_CHANGE)} AS q FROM tokens),
stepped AS (
  SELECT *, CASE WHEN steps >= 1 AND changes > q * steps THEN CAST(least(floor(steps * (changes / steps * ln(changes / steps / q) +
         CASE WHEN changes < steps THEN (1 - changes / steps) * ln((1 - changes / steps) / (1 - q)) ELSE 0 END) * 10), {STEPS}) AS INTEGER) ELSE 0 END AS step FROM changed),
counted AS (SELECT band, step, sum(count(*)) OVER (PARTITION BY band) AS total, sum(count(*)) OVER (PARTITION BY band ORDER BY step DESC) AS above FROM stepped GROUP BY band, step),
least_steps AS (SELECT band, min(step) AS least_step FROM counted WHERE step > 0 AND total * exp(-step / 10) <= {FDR} * above GROUP BY band),
far AS (
  SELECT t.* FROM stepped t JOIN least_steps l ON t.band = l.band AND t.step >= l.least_step
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)),
chars AS (SELECT doc_id, start, i, CAST(instr(alphabet, substr(m, i, 1)) AS DOUBLE) AS v, CAST(length(alphabet) AS DOUBLE) AS size
  FROM (SELECT doc_id, start, m, {_sql_case("encoding", ENCODINGS)} AS alphabet, CAST(unnest(range(1, length(m) + 1)) AS INTEGER) AS i FROM far)),
paired AS (SELECT *, lead(v) OVER (PARTITION BY doc_id, start ORDER BY i) AS w, avg(v) OVER (PARTITION BY doc_id, start) AS mean, count(*) OVER (PARTITION BY doc_id, start, v) AS same FROM chars),
sums AS (
  SELECT doc_id, start, CAST(count(*) AS DOUBLE) AS n, any_value(size) AS size, CAST(sum(same) AS DOUBLE) AS squares, CAST(count(*) FILTER (WHERE v * 2 > size) AS DOUBLE) AS high,
         CAST(count(*) FILTER (WHERE w IS NOT NULL AND (v * 2 > size) <> (w * 2 > size)) AS DOUBLE) AS changes, sum((v - mean) * (v - mean)) AS variance, sum((v - mean) * (w - mean)) AS lagged
  FROM paired GROUP BY doc_id, start),
tested AS (
  SELECT *, (pow((size / n * squares - n) / (size - 1), 1 / 3) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1))) AS even, 2 * high * (n - high) / n + 1 AS wanted FROM sums),
random AS (
  SELECT f.doc_id, 'random' AS kind, f.place, f.start, f.stop FROM far f JOIN tested t ON t.doc_id = f.doc_id AND t.start = f.start
  WHERE abs(even) <= {Z} AND variance > 0 AND abs((lagged / nullif(variance, 0) + 1 / n) * sqrt(n)) <= {Z} AND (wanted - 1) * (wanted - 2) > 0
    AND abs((t.changes + 1 - wanted) / sqrt(greatest((wanted - 1) * (wanted - 2), 1e-300) / (n - 1))) <= {Z}),
every AS (SELECT doc_id, kind, place, start, stop FROM base UNION ALL SELECT * FROM random),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place) FILTER (WHERE kind <> 'random') AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id
"""
