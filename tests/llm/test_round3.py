"""Conversation repair, secret scans and lexical search against brute force and edge cases."""

import hashlib
import itertools
import random
import re
import string
from collections import Counter, defaultdict

import pytest

CONV = "conv_id long, turn long, role string, text string, edit string, `pos` string"
DOCS = "doc_id long, text string, spans string, score string, `rank` int"

# ---- conversation repair


def cheapest(kinds):
    """Least (cost, audit) over all edit sequences, by a table of automaton states: an independent way."""
    states = {"": (0, "")}
    step = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(held):
        out = dict(held)
        for _ in range(4):
            for p, (cost, audit) in list(out.items()):
                for q in "ua":
                    if (p, q) in step and (cost + 2, audit + "I") < out.get(q, (9e9, "")):
                        out[q] = (cost + 2, audit + "I")
        return out

    for kind in kinds:
        nxt = {}
        for p, (cost, audit) in inserted(states).items():
            options = [(p, cost + 3, "D")]
            if kind not in "0123":
                more = kind.isupper()
                options += [(q, cost + 2 + more, "R") for q in "ua" if (p, q) in step]
                options += [(kind.lower(), cost + more, "K")] if (p, kind.lower()) in step else []
            for q, c, e in options:
                nxt[q] = min(nxt.get(q, (9e9, "")), (c, audit + e))
        states = nxt
    return min(v for q, v in inserted(states).items() if q in ("", "a"))


def test_chart_equals_automaton_on_all_short_and_many_long_sequences():
    from swelter.llm import conversation_repair as C

    parser = C.Parser(most=500)
    gone = str.maketrans("0123", "dddd")

    def least(kinds):
        cell = parser.parse(kinds.translate(gone))
        return min(cell[k] for k in C.START if cell[k])

    for n in range(1, 6):
        for kinds in itertools.product("suaxUA2", repeat=n):
            assert least("".join(kinds)) == cheapest(kinds)
    r = random.Random(1)
    for _ in range(60):
        kinds = "".join(r.choices("suaxSUAX0123", k=r.randrange(6, 90)))
        assert least(kinds) == cheapest(kinds), kinds


def test_all_splits_and_one_split_agree(monkeypatch):
    from swelter.llm import conversation_repair as C

    r = random.Random(2)
    for _ in range(20):
        kinds = "".join(r.choices("suaxUAd", k=25))
        whole = C.Parser().chart(kinds)
        monkeypatch.setattr(C, "LEAF", 3)
        assert C.Parser().parse(kinds) == whole


def brute_report(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired rows of one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    kinds, seen, n = [], set(), Counter()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        n[fault] += 1
        at = "sua".find(role[:1]) if role[:1] else 3
        at = 3 if at < 0 else at
        kinds.append(("0123" if fault in ("blank", "duplicate") else "SUAX" if fault else "suax")[at])
    turns = [t for t, *_ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(kinds)
    out, at, last = [], 0, ""
    for e in audit:
        role, text = (rows[at][1], rows[at][2]) if e != "I" else ("", "")
        at += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        out.append((role, text))
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, out


@pytest.mark.parametrize("chunk_bits", [12, 2])
def test_repair_equals_brute_force(spark, monkeypatch, chunk_bits):
    from swelter.llm import conversation_repair as C

    monkeypatch.setattr(C, "CHUNK_BITS", chunk_bits)
    r = random.Random(3)
    rows = []
    for conv in [None, *range(25)]:
        for _ in range(r.choice([1, 2, 6, 9, 40])):
            rows.append((conv, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "tool", "", None, "u", "student"]), r.choice(["", " \n", None, "Hi.", "Hello", "So?", "Well! \t", "Never…", f"n{r.random()}."]), "x", "y"))
    rows += [(7, 3, "user", "Hi.", "x", "y")] * 50  # equal rows of one turn
    report, mended = C.repair(spark.createDataFrame(rows, CONV).repartition(5))
    by, told = defaultdict(list), defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn, role, text))
    for x in sorted(mended.collect(), key=lambda x: (x.pos, x.sub)):
        told[x.conv_id].append((x.role, x.text))
    found = {x.conv_id: x for x in report.collect()}
    digests = {x.conv_id: x.sha256 for x in C.digests(mended).collect()}
    assert set(found) == set(by)
    for conv, own in by.items():
        *numbers, out = brute_report(own)
        x = found[conv]
        assert [x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit] == numbers, conv
        assert told[conv] == out
        if out:
            assert digests[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_one_conversation_with_most_rows_lies_over_many_spans(spark, monkeypatch):
    from swelter.llm import conversation_repair as C

    monkeypatch.setattr(C, "CHUNK_BITS", 6)
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Same.", f"Turn {t}.", "cut"]), "", "") for t in range(3000)] + [(k, 0, "user", "Hi.", "", "") for k in range(2, 40)]
    marked = C.mark(spark.createDataFrame(rows, CONV).repartition(7))
    assert marked.where("conv_id = 1").select((marked.pos / 2**33).cast("int")).distinct().count() > 1
    spans, parsed = C.parse(marked)
    assert max(x["count"] for x in spans.groupBy("conv_id").count().collect()) > 40
    x = parsed.where("conv_id = 1").first()
    *numbers, out = brute_report([v[1:4] for v in rows if v[0] == 1])
    assert [x.illegal, x.cost, x.audit] == numbers[4:]
    assert [(y.role, y.text) for y in C.repaired(marked, spans, parsed).where("conv_id = 1").orderBy("pos", "sub").collect()] == out


def test_repair_edge_cases(spark):
    from swelter.llm import conversation_repair as C

    report, mended = C.repair(spark.createDataFrame([], CONV))
    assert report.count() == 0 and mended.count() == 0 and C.digests(mended).count() == 0
    long = "word " * 200_000 + "end."
    report, mended = C.repair(spark.createDataFrame([(1, 0, "user", long, None, None), (1, 1, "assistant", "A.", None, None), (2, None, None, None, None, None)], CONV))
    got = {x.conv_id: (x.cost, x.audit, x.blank, x.gaps) for x in report.collect()}
    assert got == {1: (0, "KK", 0, 0), 2: (3, "D", 1, 0)}
    assert [x.text for x in mended.orderBy("pos").collect()] == [long, "A."]


# ---- secret scans

HEAD = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(HEAD, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, k, e) for s, _, k, e in sorted(out)]


def scanned(spark, texts):
    from swelter.llm import secret_scan

    rows = [(k, t, "a", "b", 1) for k, t in enumerate(texts)]
    return {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans] for x in secret_scan.scan(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}


def test_pattern_spans_equal_brute_force(spark):
    r = random.Random(5)
    parts = ["token", "TOKEN: ", "api_key='", "apikey=", "Secret", " = ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef01234567", "é", "🙂", "\n", " ", "x.y-z", "password\" : \"", "token: abcd", "secret=token: abcdefgh", "\r\n", "'"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(300)] + [None, "", "🙂 token=" + "abc123" * 3, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24, " ".join(["token=abcdef"] * 1500) + "deadbeef" * 4]
    got = scanned(spark, texts)
    for k, t in enumerate(texts):
        assert [s for s in got[k] if s[1] != "random"] == brute_base(t), t


def test_running_sums_of_long_and_empty_arrays(spark):
    from pyspark.sql import functions as F

    from swelter.llm import secret_scan

    got = spark.sql("SELECT explode(array(0, 1, 255, 256, 257, 5000)) AS n").select("n", F.when(F.col("n") > 0, F.expr("transform(sequence(1, n), x -> CAST(x AS BIGINT))")).otherwise(F.expr("CAST(array() AS array<bigint>)")).alias("v"))
    for x in got.select("n", secret_scan.running_sums(F.col("v")).alias("s")).collect():
        assert x.s == list(itertools.accumulate(range(1, x.n + 1)))


def test_random_tokens_are_found_and_words_are_not(spark):
    r = random.Random(6)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.digits + "ABCDEF", string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits]
    syllables = ["the", "ing", "tion", "er", "heit", "lich", "ver", "keit", "an", "und", "ou", "ment"]
    texts, planted = [], {}
    for k in range(600):
        words = [re.sub("^.", lambda m: m[0].upper() if r.random() < 0.2 else m[0], "".join(r.choices(syllables, k=r.randrange(1, 9)))) for _ in range(40)]
        words += [r.choice(["getElementsByTagName", "2024-11-28T12-30-00", "src/main/java/org/Example1", "+49-170-5550123-4567", "0123456789012345678901", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "aaaaaaaaaaaaaaaaaaaaaaaa", "www_example_com_page_42"])]
        if k % 3 == 0:
            token = "".join(r.choices(r.choice(alphabets), k=r.choice([32, 40, 48, 64])))
            before = " ".join(words) + " "
            planted[k] = (len(before), "random", len(before) + len(token))
            texts.append(before + token + " the end")
        else:
            texts.append(" ".join(words))
    got = scanned(spark, texts)
    inside = lambda k: any(s[1] != "hex" and s[0] <= planted[k][0] and s[2] >= planted[k][2] for s in got[k])
    assert sum(map(inside, planted)) >= 0.93 * len(planted)
    added = [(k, s) for k, found in got.items() for s in found if s[1] == "random"]
    wrong = [(k, s) for k, s in added if planted.get(k) != s]
    assert len(wrong) <= 0.03 * len(added), [texts[k][s[0] : s[2]] for k, s in wrong]


def test_added_spans_touch_no_pattern_span_and_edges(spark):
    from swelter.llm import secret_scan

    r = random.Random(7)
    token = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    texts = [f"token = \"{token(40)}\"", f"x {token(40)} y", f"x {token(40)} y", f"x {token(300)}"] * 5
    got = scanned(spark, texts)
    assert all([s[1] for s in got[k]] == ["assign"] for k in range(0, 20, 4))
    assert sum(s[1] == "random" for found in got.values() for s in found) >= 13
    assert secret_scan.scan(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(None, None, "", "", 1), (None, "f" * 30, "", "", 1), (2, "", "", "", 1), (2, "w " * 100_000, "", "", 1)], DOCS)
    assert sorted(len(x.spans) for x in secret_scan.scan(same).collect()) == [0, 0, 0, 1]


# ---- lexical search


def brute_ranks(docs, items, top=20):
    import math

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("block_docs, block_terms", [(8192, 200_000), (7, 30), (64, 200_000)])
def test_search_equals_brute_force(spark, monkeypatch, block_docs, block_terms):
    from swelter.llm import lexical_search as L

    monkeypatch.setattr(L, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(L, "BLOCK_DOCS", block_docs)
    r = random.Random(8)
    words = ["the", "The", "of", "Étude", "étude", "a1", "B", "x_y", "naïve", *[f"w{int(r.paretovariate(0.7))}" for _ in range(300)]]
    docs = [(k, " ".join(r.choices(words, k=r.randrange(60)))) for k in range(400)] + [(900 + k, "the of w1") for k in range(60)] + [(1000, None), (1001, ""), (None, "the w1 w2"), (5, "w7 w8")]
    items = [(k, " ".join(r.choices(words, k=r.randrange(1, 40)))) for k in range(25)] + [(50, None), (51, "zzz"), (52, "the the the of"), (None, "w1 w2 w3")]
    d = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], DOCS).repartition(5)
    got = L.search(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda v: tuple((x is None, x or 0) for x in v)
    assert sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in got), key=key) == sorted(brute_ranks(docs, items), key=key)


def test_search_stops_before_the_lists_end():
    import numpy as np

    from swelter.llm import lexical_search as L

    r = np.random.default_rng(9)
    n, terms = 8000, 4
    doc, term = np.tile(np.arange(n), terms), np.repeat(np.arange(terms), n)
    impact = (r.pareto(1.5, n * terms) * 1000).astype(np.int64) + 1
    lists = L.Lists(doc, term, impact)
    places, scores, read = L.best_positions(lists, dict.fromkeys(range(terms), 1), 20, [], n)
    whole = np.bincount(doc, impact, n).astype(np.int64)
    assert sorted(scores)[-20:] == sorted(whole)[-20:] and read < 0.5 * n * terms
    floor = sorted(whole)[-20:]
    assert L.best_positions(lists, dict.fromkeys(range(terms), 1), 20, floor, n)[2] <= read


def test_best_positions_stop_no_later_than_last_read_positions():
    """The bound is taken at the seen prefix, which direct accesses have made longer than what was read in order."""
    import numpy as np

    from swelter.llm import lexical_search as L

    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    impact = np.concatenate([np.arange(n, 0, -1), np.r_[np.arange(n, n - 40, -1), np.arange(n - 41, -1, -1)]]) * 10
    lists = L.Lists(doc, np.repeat([0, 1], n), impact.astype(np.int64))
    _, scores, read = L.best_positions(lists, {0: 1, 1: 1}, 5, [], n)
    assert read < 200 and max(scores) == 2 * n * 10


def test_search_edge_cases(spark):
    from swelter.llm import lexical_search as L

    empty, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(3, "A b " * 50_000, "", "", 1), (3, "a", "", "", 1), (4, "c", "", "", 1)], DOCS)
    assert L.search(empty, items).count() == 0 and L.search(some, items.limit(0)).count() == 0
    got = L.search(some, items.union(items)).orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 1, 2, 2] and {x.doc_id for x in got} == {3}
    named = spark.createDataFrame([("x", "a"), ("y", None), (None, "a b")], "name string, body string")
    assert [x.doc_id for x in L.search(named, items, id_col="name", text_col="body").orderBy("rank").collect()] == [None, "x"]


# ---- archives and counts


def test_archives_are_cut_by_bytes_where_large_pages_are_neighbours(spark, tmp_path):
    import glob
    import gzip

    from swelter.llm import warc

    r = random.Random(10)
    html = lambda n: "".join(r.choices("abcdef <>", k=1000)) * (n // 1000) + "x" * (n % 1000)
    rows = [(k, f"http://h/{k}", html(60_000 if 1000 <= k < 1060 else 100) + str(k)) for k in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    for packed in (True, False):
        warc.write_archives(pages, f"file://{tmp_path}/{packed}", packed=packed, archive_bytes=100_000)
        names = glob.glob(f"{tmp_path}/{packed}/*/part-*")
        texts = [gzip.decompress(data) if packed else data for data in (open(n, "rb").read() for n in names)]
        assert max(map(len, texts)) <= 100_000 and sum(t.count(b"WARC-Record-ID") for t in texts) == 1500
        assert sorted(x.record_id for x in warc.read_archives(spark, f"file://{tmp_path}/{packed}").collect()) == sorted(f"<urn:page:{k}>" for k in range(1500))


CHANGE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def test_a_batch_that_commits_during_compact_counts_once(spark, tmp_path, monkeypatch):
    from swelter.llm import token_counts as tc

    ledger = f"file://{tmp_path}/ledger"
    one = lambda n: spark.createDataFrame([("s", "en", "words/1", 1, n)], CHANGE)
    tc.commit(ledger, "a", one(10))
    rename, sums = tc._rename, tc._sums

    def late(signed):  # a batch commits while compact makes its sums
        monkeypatch.setattr(tc, "_sums", sums)
        tc.commit(ledger, "b", one(7))
        return sums(signed)

    monkeypatch.setattr(tc, "_sums", late)
    tc.compact(spark, ledger)
    want = [("s", "en", "words/1", 2, 17)]
    assert [tuple(x) for x in tc.totals(spark, ledger).collect()] == want
    assert not tc.commit(ledger, "a", one(10)) and not tc.commit(ledger, "b", one(7))
    tc.compact(spark, ledger)
    assert [tuple(x) for x in tc.totals(spark, ledger).collect()] == want
    # of two that compact at once, the second one's folder goes
    tc.commit(ledger, "c", one(1))
    monkeypatch.setattr(tc, "_rename", lambda s, a, b: False)
    tc.compact(spark, ledger)
    monkeypatch.setattr(tc, "_rename", rename)
    assert not list(tmp_path.glob("ledger/_new-*"))
    assert [tuple(x) for x in tc.totals(spark, ledger).collect()] == [("s", "en", "words/1", 3, 18)]


def test_vacuum_deletes_what_is_folded_after_its_grace(spark, tmp_path):
    from swelter.llm import token_counts as tc

    ledger = f"file://{tmp_path}/ledger"
    one = lambda n: spark.createDataFrame([(None, None, "words/1", 1, n)], CHANGE)
    for k in "abc":
        tc.commit(ledger, k, one(2))
        if k != "c":
            tc.compact(spark, ledger)
    (tmp_path / "ledger/_new-lost").mkdir()
    assert tc.vacuum(spark, ledger) == []
    assert tc.vacuum(spark, ledger, grace_s=-5) == ["_new-lost", "base-1", "batch=a", "batch=b"]
    assert [tuple(x) for x in tc.totals(spark, ledger).collect()] == [(None, None, "words/1", 3, 6)]
    assert not tc.commit(ledger, "a", one(2)) and tc.vacuum(spark, f"{ledger}-none") == []


def test_bpe_counts_are_the_librarys(spark):
    import base64
    import sys

    import tiktoken
    from pyspark.sql import functions as F

    sys.path.append("/opt/tokenizers")
    import public_tokenizers as P

    from swelter.llm import token_counts as tc

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello world, 123 Übermut", "a"), (2, None, "a"), (3, "", None), (4, "x " * 9000, "b"), (4, "x " * 9000, "b")]
    got = tc.bpe_counted(spark.createDataFrame(rows, "doc_id long, text string, source string"), path, P.PATTERN, F.col("source"), F.col("doc_id")).collect()
    key = lambda v: (v[1], v[2])
    assert sorted(map(tuple, got), key=key) == sorted(((s, i, len(lib.encode_ordinary(t or ""))) for i, t, s in rows), key=key)


# ---- the pipeline


def _tables(spark, path, docs, labels, schema="doc_id long, text string, lang string, source string, n_chars long, keep_id string, `digest` string, `copy` int"):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_pipeline_equals_brute_force_on_a_small_table(spark):
    """Each stage against a plain version over what the stage before kept: scores by op4 (which has its own brute force), a dictionary, all pairs, sums by source,
    and the tokenizer library."""
    import base64
    import sys

    import tiktoken

    import corpus_pipeline as p
    from swelter.llm import near_dedup, quality_classifier

    sys.path.append("/opt/tokenizers")
    import public_tokenizers as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    whole = {x.doc_id: x for x in docs.collect()}
    run, ids = dict(p.STAGES), lambda df: sorted(x.doc_id for x in df.collect())
    after = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.scratch.written(stage(spark, docs, d), name)
        after[name] = docs.collect()
        assert all(x == whole[x.doc_id] for x in after[name])
    kept = {name: [x.doc_id for x in rows] for name, rows in after.items()}
    good = {x.doc_id for x in quality_classifier.op4_quality_classifier(spark, d).collect() if x.predicted}
    assert sorted(kept["quality"]) == sorted(good)
    last = {}
    for i in sorted(good):
        last[texts[i]] = i
    assert sorted(kept["exact_dedup"]) == sorted(last.values())
    left = sorted(last.values())
    seqs = {i: near_dedup.shingles(near_dedup.sequence(near_dedup.words_of(texts[i]))) for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(left):
        for j in left[:n]:
            if near_dedup.words_of(texts[i]) == near_dedup.words_of(texts[j]) or near_dedup.similarity(seqs[i], seqs[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(kept["near_dedup"]) == sorted({find(i) for i in left})
    size = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))
    mixed = Counter(kept["mixing"])
    assert max(mixed.values()) <= 2 and set(mixed) <= set(kept["near_dedup"])
    by, taken, largest = Counter(), Counter(), Counter()
    for i in kept["near_dedup"]:
        s = whole[i].source
        by[s] += size(i)
        taken[s] += size(i) * mixed[i]
        largest[s] = max(largest[s], size(i))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    weight, target, pool, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {}, 1.5 * sum(by.values()), set(sources)
    while True:  # sources that would be taken more than twice stop there
        share = {s: pool * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * by[s]
            pool -= target[s]
            free.discard(s)
    for s in sources:
        assert abs(taken[s] - target[s]) <= largest[s] + 0.01 * target[s], s
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = p.STAGES[-1][1](spark, docs, d).collect()
    assert sorted(x.doc_id for x in out) == sorted(kept["mixing"]) and run and ids(docs) == sorted(kept["mixing"])
    for x in out:
        want = lib.encode_ordinary(texts[x.doc_id])
        assert list(x["ids"]) == want and x.n_tokens == len(want) and x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()


def test_pipeline_on_odd_input(spark, tmp_path):
    import corpus_pipeline as p

    odd = [(1, "a b c", "en", "s"), (2, "a b c", None, None), (2, "a b c", None, None), (3, None, "en", "s"), (4, "", "", ""), (5, "a b c ", "en", "s"), (None, "a b c", "en", "t"), (None, "x " * 7, None, "t"), (6, "w " * 30_000, "en", "s"), (6, "v " * 50, "en", "s")]
    rows = [(*x, None, "k", "d", 1) for x in odd]
    d = _tables(spark, tmp_path / "odd", rows, [(1, 1, 0), (None, 0, 0), (3, None, None), (3, 1, 0)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = p.run(spark, d).collect()
    digests = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd}
    assert got and {x.decoded_sha256 for x in got} <= digests
    for name, stage in p.STAGES[:-1]:
        docs = p.scratch.written(stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id", "digest", "copy"], name
        assert {x.keep_id for x in docs.collect()} <= {"k"}
    # no labels at all: the classifier keeps everything, and one row of each text stays
    d = _tables(spark, tmp_path / "unlabelled", rows, [])
    kept = p.exact(spark, p.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d), d).collect()
    assert sorted((x.text or "") for x in kept) == sorted({t or "" for _, t, *_ in odd})
    d = _tables(spark, tmp_path / "empty", [], [])
    assert p.run(spark, d).count() == 0


# ---- mixing with many languages


def test_languages_beyond_the_bound_share_a_rate(spark, monkeypatch):
    from swelter.llm import mixing

    r = random.Random(12)
    cells = [(s, None if k == 7 else f"l{k}", r.randrange(1, 50) if k > 4 else 1000 + 100 * k + ord(s), t) for s, t in (("a", 9000.0), ("b", 3000.0), ("c", 7000.0)) for k in range(40) if r.random() < 0.9 or k < 5]
    df = spark.createDataFrame(cells, "s string, lang string, tokens long, target double")
    monkeypatch.setattr(mixing, "MOST_VALUES", 6)
    got = {(x.s, x.lang): x.rate for x in mixing.balance(df, "s", "lang").collect()}
    assert len(got) == len(cells)
    for s, t in (("a", 9000.0), ("b", 3000.0), ("c", 7000.0)):
        assert abs(sum(c[2] * got[c[:2]] for c in cells if c[0] == s) - min(t, 2 * sum(c[2] for c in cells if c[0] == s))) < 1e-4
        assert len({round(got[c[:2]], 9) for c in cells if c[0] == s and c[1] not in ("l0", "l1", "l2", "l3", "l4")}) == 1
        assert len({round(got[c[:2]], 6) for c in cells if c[0] == s}) > 1
    # a bound that no table reaches gives what it gave before
    monkeypatch.setattr(mixing, "MOST_VALUES", 40)
    fine = {(x.s, x.lang): x.rate for x in mixing.balance(df, "s", "lang").collect()}
    assert len({round(fine[c[:2]], 9) for c in cells if c[0] == "a"}) > 10


def test_a_mix_of_more_languages_than_the_bound(spark, monkeypatch):
    from swelter.llm import mixing

    monkeypatch.setattr(mixing, "MOST_VALUES", 10)
    rows = [(k, "w " * (5 + k % 7), f"l{k % 60}", "xyz"[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.mix(docs).groupBy("source").agg({"doc_id": "count"}).count()
    assert taken == 3
