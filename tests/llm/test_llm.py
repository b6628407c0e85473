"""The training-data operations against brute force, round trips and edge cases."""

import base64
import hashlib
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, `digest` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in rows], SCHEMA).repartition(3)


EDGE = [(1, "a b c", "s"), (2, "a b c", None), (2, "a b c", None), (3, None, "s"), (4, "", ""), (5, "a b c ", "s"), (None, "a b c", "t"), (6, "w " * 30_000, "s")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- exact dedup


@pytest.mark.parametrize("keep, runs", [("min", 40), ("max", 7), ("max", 2), ("min", 1)])
def test_exact_copies_match_brute_force(spark, keep, runs):
    from swelter.llm import exact_dedup

    r = random.Random(3)
    rows = [(k, r.choice(["x", "y", "z", "hot", "hot", "hot", f"u{k}"]), "s") for k in range(400)]
    df = docs_of(spark, rows).repartition(runs)
    got = {x.doc_id: x for x in exact_dedup.find_copies(df, keep=keep).collect()}
    pick = {"min": min, "max": max}[keep]
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (pick(same), len(same), i == pick(same))


def test_exact_edge_cases(spark, edge, empty):
    from swelter.llm import exact_dedup

    got = exact_dedup.find_copies(edge).collect()
    abc = [x for x in got if x.group_size == 4]
    assert len(abc) == 4 and {x.keep_id for x in abc} == {2} and sum(x.kept for x in abc) == 1
    assert sorted(x.doc_id for x in got if x.group_size == 2) == [3, 4]
    out = exact_dedup.drop_copies(edge)
    assert out.columns == edge.columns and sorted(x.doc_id for x in out.collect()) == [2, 4, 5, 6]
    assert exact_dedup.find_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_hot_groups_join_like_others(spark, monkeypatch):
    from swelter.llm import exact_dedup, scratch

    monkeypatch.setattr(scratch, "SMALL_JOIN", 0)
    monkeypatch.setattr(scratch, "HOT_SHARE", 5)
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 3)
    rows = [(k, "hot" if k % 2 else f"t{k // 4}", "s") for k in range(200)]
    got = exact_dedup.find_copies(docs_of(spark, rows)).collect()
    assert len(got) == 200 and sum(x.kept for x in got) == 51
    assert exact_dedup.drop_copies(docs_of(spark, rows)).count() == 51


def test_runs_meet_in_pairs_and_in_order(spark):
    from swelter.llm import exact_dedup

    rows = docs_of(spark, [(k, f"t{k % 9}", "s") for k in range(90)]).repartition(5)
    runs = exact_dedup.sorted_runs(exact_dedup.digest_rows(rows))
    level = exact_dedup.merge_pairs(runs)
    assert [x.run for x in runs.select("run").distinct().orderBy("run").collect()] == [0, 1, 2, 3, 4]
    assert [x.run for x in level.select("run").distinct().orderBy("run").collect()] == [0, 1, 2]
    plan = level._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning(digest" not in plan
    assert level.groupBy().sum("group_size").first()[0] == 90


def test_dropping_keeps_columns_of_clashing_names(spark):
    from pyspark.sql import functions as F

    from swelter.llm import exact_dedup, mixing, near_dedup, sharding

    names = ["__digest", "__drop_id", "DIGEST_", "drop_id", "drop_digest", "keep_id", "kept", "row_id", "run", "best", "__n", "__copy", "__source", "__whole", "__slot", "__shard", "slot", "shard", "whole", "cut", "copy", "hash", "size"]
    df = docs_of(spark, EDGE).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names) if n not in ("keep_id",)])
    for out in (exact_dedup.drop_copies(df), near_dedup.drop_near_copies(df), near_dedup.drop_near_copies(df.where("doc_id in (1, 3, 6)")), mixing.mix(df)):
        assert out.columns == df.columns
        assert all(x["__digest"] == 0 and x["__n"] == names.index("__n") for x in out.collect())
    placed = sharding.place(df, "doc_id", ["a", "b"], 101)
    assert placed.columns[:-2] == df.columns and len(set(placed.columns)) == len(placed.columns)
    assert placed.count() == len(EDGE)


# ---- sharding


def test_table_shares_and_stability():
    from swelter.llm import sharding

    names = [f"s{k}" for k in range(10)]
    t = sharding.fill_table(names, 1009)
    counts = [t.count(k) for k in range(10)]
    assert sum(counts) == 1009 and max(counts) - min(counts) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer) if a != 9)
    assert moved < 0.25 * 1009
    heavy = sharding.fill_table(["a", "b"], 101, [3, 1])
    assert 70 <= heavy.count(0) <= 80
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_placement_matches_brute_force(spark, edge, empty):
    import xxhash

    from swelter.llm import sharding

    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 101)
    for x in sharding.place(edge, "doc_id", names, 101).collect():
        h = xxhash.xxh64("" if x.doc_id is None else str(x.doc_id), seed=42).intdigest()
        h -= (1 << 64) * (h >= 1 << 63)
        assert x["slot"] == h % 101 and x["shard"] == names[table[h % 101]]
    assert sharding.place(empty, "doc_id", names, 101).count() == 0


# ---- mixing


def test_targets_share_excess(spark):
    from swelter.llm import mixing

    sizes = [("a", 10), ("b", 1000), ("c", 50), ("d", 400), (None, 0), ("e", 3)]
    got = {x.g: x.target for x in mixing.targets_by_cycle(spark.createDataFrame(sizes, "g string, n long"), "g", "n").collect()}
    order = sorted((g for g, _ in sizes if g), key=str) + [None]
    weight = {g: (5, 2, 1)[k % 3] for k, g in enumerate(order)}
    size, left, full = dict(sizes), 1.5 * sum(n for _, n in sizes), set()
    while True:
        rest = [g for g in order if g not in full]
        share = {g: left * weight[g] / sum(weight[h] for h in rest) for g in rest}
        over = [g for g in rest if share[g] > 2 * size[g]]
        if not over:
            break
        full |= set(over)
        left -= sum(2 * size[g] for g in over)
    want = {g: 2.0 * size[g] if g in full else share[g] for g in order}
    assert all(abs(got[g] - want[g]) < 1e-6 for g in order)


def _numpy_rates(cells, soft, top=2.0):
    """Newton on the whole joint dual, with all multipliers in one dense system. cells: (source, lang, tokens, target)."""
    import numpy as np

    t, a = np.array([c[2] for c in cells], float), {c[0]: c[3] for c in cells}
    size = {s: sum(c[2] for c in cells if c[0] == s) for s in a}
    fixed = np.array([1.0 if not size[c[0]] else 0.0 if c[3] <= 0 else top if c[3] >= top * size[c[0]] * (1 - 1e-12) else np.nan for c in cells])
    free = np.isnan(fixed)
    sources, langs = sorted({c[0] for c, f in zip(cells, free) if f}), sorted({c[1] for c in cells}, key=str)
    x = np.zeros((len(cells), len(sources) + len(langs)))
    for k, c in enumerate(cells):
        if free[k]:
            x[k, sources.index(c[0])] = 1
        x[k, len(sources) + langs.index(c[1])] = 1
    b = np.array([sum(c[2] for c in cells if c[1] == v) for v in langs]) * sum(a[s] for s in a if size[s]) / t.sum()
    want, give = np.concatenate([[a[s] for s in sources], b]), np.concatenate([np.zeros(len(sources)), soft * b])
    z = np.zeros(len(want))
    for _ in range(200):
        e = np.exp(x @ z)
        r = np.where(free, np.minimum(top, e), np.nan_to_num(fixed))
        h = np.where(free & (e < top), e * t, 0)
        g = x.T @ (r * t) - want + give * z
        z -= 0.7 * np.linalg.solve(x.T @ (x * h[:, None]) + np.diag(give + 1e-9 * want), g)
    return r


def test_newton_agrees_with_a_dense_solver(spark):
    from swelter.llm import mixing

    r = random.Random(2)
    for soft, skew in ((0.1, 1), (0.02, 6)):
        cells = []
        for s, rate in (("a", 0.7), ("b", 2.0), ("c", 1.6), ("d", 0.3), ("e", 1.9), ("f", 0.0)):
            row = [(s, v, r.randint(1, 400) * (skew if v == "x" and s in "ac" else 1)) for v in ("x", "y", None)]
            cells += [(*c, rate * sum(x[2] for x in row)) for c in row]
        cells.append(("zero", "x", 0, 0.0))
        want = _numpy_rates(cells, soft)
        df = spark.createDataFrame(cells, "s string, l string, tokens long, target double").repartition(3)
        got = {(x.s, x.l): x.rate for x in mixing.balance(df, "s", "l", soft=soft).collect()}
        assert all(abs(got[c[:2]] - w) < 1e-7 for c, w in zip(cells, want))
        assert len({round(got["a", v], 6) for v in ("x", "y", None)}) == 3  # the tilt is real
        for s in "abcde":
            assert abs(sum(c[2] * got[c[:2]] for c in cells if c[0] == s) - next(c[3] for c in cells if c[0] == s)) < 1e-5


def test_balancing_by_source_alone_and_without_an_end(spark, monkeypatch):
    from swelter.llm import mixing

    df = spark.createDataFrame([("a", 10, 15.0), ("b", 20, 5.0), ("c", 0, 0.0)], "s string, tokens long, target double")
    assert {x.s: round(x.rate, 9) for x in mixing.balance(df, "s").collect()} == {"a": 1.5, "b": 0.25, "c": 1.0}
    monkeypatch.setattr(mixing, "MOST_STEPS", 0)
    monkeypatch.setattr(mixing, "GAP", -1.0)
    with pytest.raises(RuntimeError):
        mixing.balance(df, "s")


def test_cuts_match_brute_force(spark):
    from swelter.llm import mixing

    r = random.Random(4)
    rows = [(r.choice("aab"), r.choice([r.randrange(1 << 48), r.randrange(1 << 20), 7]), r.randint(0, 9)) for _ in range(800)]
    needs = [(s, need, sum(x[0] == s for x in rows)) for s, need in (("a", 900.3), ("b", 0.2))]
    got = {x.source: x.cut for x in mixing.cut_turns(spark.createDataFrame(rows, "source string, turn long, size long"), spark.createDataFrame(needs, "source string, need double, n_rows long"), 800).collect()}
    for s, need, _ in needs:
        best, done = -1, 0
        for t in sorted({x[1] for x in rows if x[0] == s}):
            size = sum(x[2] for x in rows if x[0] == s and x[1] == t)
            best = t if done + size / 2 <= need + 0.01 else best
            done += size
        assert [x for x in rows if x[0] == s and x[1] <= got[s]] == [x for x in rows if x[0] == s and x[1] <= best]


def test_mix_takes_targets(spark, edge, empty):
    from swelter.llm import mixing

    r = random.Random(1)
    rows = [(k, "w " * r.randint(1, 30), r.choice("aaaaabbc")) for k in range(3000)]
    df = docs_of(spark, rows)
    src, plan = mixing._plan(df, "doc_id", "text", "source", "lang")
    target = {x.source[1:]: x.target for x in plan.collect()}
    taken = {}
    once = mixing.mix(df).collect()
    for x in once:
        taken[x.source] = taken.get(x.source, 0) + len(x.text.split())
    assert all(abs(taken[s] - target[s]) <= 16 for s in "abc")
    assert sorted(x.doc_id for x in once) == sorted(x.doc_id for x in mixing.mix(df).collect())
    assert max(map([x.doc_id for x in once].count, range(50))) <= 2
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(empty).count() == 0
    assert mixing.mix(edge, lang_col=None).count() > 0


# ---- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_codec_matches_the_library(tokenizer):
    from swelter.llm.bpe import Codec

    path, pattern, want = tokenizer
    codec = Codec(open(path, "rb").read(), pattern)
    r = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "1", "the", " \n", "\t", "　", "\x1c", "\x85", "漢字", "!", "\U0001f600", "x" * 70, "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)] + ["abcdefgh" * 5000, "", " ", "\n\n"]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == want(t), repr(t[:80])
        assert codec.decode(ids) == t.encode()


def test_lower_ranks_that_come_up_go_first():
    """Ranks for which a merge makes a pair of a lower rank than its own."""
    from swelter.llm.bpe import Codec

    tokens = [bytes([b]) for b in range(256)]
    merges = [b"bcd", b"ab", b"cd", b"bc", b"abcd", b"cdcd"]
    lines = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens + merges))
    codec, rank = Codec(lines, r"\S+|\s+"), {t: k for k, t in enumerate(tokens + merges)}

    def slow(piece):
        if piece in rank:
            return [rank[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not found:
                return [rank[p] for p in parts]
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    r = random.Random(9)
    pieces = [bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 14))) for _ in range(3000)] + [b"abcd" * 300, b"b" + b"cd" * 500]
    flat, sizes = codec._ids_of(pieces)
    flat, at = flat.tolist(), 0
    for piece, n in zip(pieces, sizes.tolist()):
        found, at = flat[at : at + n], at + n
        assert found == slow(piece), piece


def test_round_trip_frames(spark, edge, empty, tokenizer):
    from swelter.llm import bpe

    path, pattern, want = tokenizer
    got = bpe.round_trip(edge, path, pattern, with_ids=True).collect()
    assert len(got) == len(EDGE)
    text = {i: t or "" for i, t, _ in EDGE}
    for x in got:
        ids = want(text[x.doc_id])
        assert (x.n_tokens, x.ids) == (len(ids), ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text[x.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(edge, path, pattern), path, pattern).collect()
    assert all(bytes(x.text_bytes) == text[x.doc_id].encode() for x in back)
    assert bpe.round_trip(empty, path, pattern).count() == 0


# ---- packing


def test_best_fit_decreasing_is_best_fit():
    from swelter.llm.packing import best_fit_decreasing

    r = random.Random(2)
    for _ in range(40):
        lengths = [r.randint(1, 50) for _ in range(r.randrange(60))]
        rows = best_fit_decreasing(lengths, 50)
        room, n = [], 0
        for x in sorted(lengths, reverse=True):
            fit = [y for y in room if y >= x]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - x)
            else:
                n += 1
                room.append(50 - x)
        assert len(rows) == n and sorted(k for row in rows for k in row) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in row) <= 50 for row in rows)


def test_packing_is_lossless(spark, edge, empty, tokenizer):
    import numpy as np

    from swelter.llm import packing

    path, pattern, want = tokenizer
    df = docs_of(spark, [(k, f"some words {k} " * (k % 40), "s") for k in range(300)] + [(1000, "long text " * 3000, "s"), (1001, None, "s")])
    packed = packing.pack(df, path, pattern, length=128, block_tokens=2000)
    for x in packed.collect():
        ids, pos = np.frombuffer(x.ids, "<u4"), np.frombuffer(x.positions, "<u4")
        assert len(ids) == 128 and x.cu_seqlens[-1] == x.n_tokens and (ids[x.n_tokens :] == packing.PAD_ID).all()
        for lo, hi in zip(x.cu_seqlens, x.cu_seqlens[1:]):
            assert pos[lo:hi].tolist() == list(range(hi - lo))
    back = {}
    for x in packing.unpack(packed).collect():
        back.setdefault(x.doc_id, []).append((x.doc_offset, np.frombuffer(x.ids, "<u4").tolist()))
    for x in df.collect():
        assert [i for _, part in sorted(back.get(x.doc_id, [])) for i in part] == want(x.text or "")
    assert packing.pack(empty, path, pattern).count() == 0
    (full,) = packing.fill(packed, 128).collect()
    assert full.n_rows == packed.count() and 0.9 < full.filled <= 1 and packing.fill(packing.pack(empty, path, pattern)).first().filled is None
    odd = packing.pack(docs_of(spark, [(None, "a b", "s"), (7, "a b", "s"), (7, "a b", "s")]).coalesce(1), path, pattern, length=8)
    assert sorted(map(str, odd.first().doc_ids)) == ["7", "7", "None"]


# ---- WARC


def test_warc_round_trip(spark, empty, tmp_path):
    from swelter.llm import warc

    body = "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 100
    hostile = "http://a/?content-length:5\r\ncontent-length:5"
    rows = [(1, "http://a/ b", body), (2, None, body), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (7, "content-length:5", body), (8, "u", "y" * 300_000), (9, hostile, "z" * 200), (9, hostile, "z" * 200)]
    pages = spark.createDataFrame([(*x, "s", 1) for x in rows], "page_id long, url string, html string, digest string, payload long")
    for packed in (True, False):
        path = f"file://{tmp_path}/{packed}"
        warc.write_archives(pages, path, packed=packed, archive_bytes=2000)
        got = warc.read_archives(spark, path).collect()
        assert not [x for x in got if x.kind == "gap"]
        seen = {x.record_id: x for x in got}
        assert len(got) == 10 and seen["<urn:page:2>"].record_type == "revisit" and seen["<urn:page:7>"].refers_to == "<urn:page:1>"
        assert bytes(seen["<urn:page:1>"].payload) == body.encode() and seen["<urn:page:2>"].http_bytes == len(body.encode())
        assert seen["<urn:page:4>"].record_type == "response" and bytes(seen["<urn:page:5>"].payload) == b""
        assert bytes(seen["<urn:page:9>"].payload) == b"z" * 200 and [x.record_type for x in got if x.record_id == "<urn:page:9>"] == ["response"] * 2
    none = f"file://{tmp_path}/none"
    warc.write_archives(pages.where("false"), none)
    assert warc.read_archives(spark, none).count() == 0


def test_damage_in_our_own_archive_costs_one_record(spark, tmp_path):
    import glob
    import gzip

    from swelter.llm import warc

    r = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(r.choices("abcdefghij <>", k=r.randint(100, 2000)))) for k in range(200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/a")
    (name,) = glob.glob(f"{tmp_path}/a/*/part-*")
    whole = open(name, "rb").read()
    assert gzip.decompress(whole).count(b"WARC-Record-ID") == 200
    starts = [x[1] for x in warc.salvage(whole)]
    assert len(starts) == 200
    for cut in (0.1, 0.5, 0.9):
        k = int(200 * cut)
        at = (starts[k] + starts[k + 1]) // 2 - 20
        assert starts[k] + 20 < at and at + 40 < starts[k + 1]
        broken = whole[:at] + bytes(r.randrange(256) for _ in range(40)) + whole[at + 40 :]
        found = list(warc.salvage(broken))
        assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == [f"<urn:page:{j}>" for j in range(200) if j != k]
        assert [x[2:4] for x in found if x[0] == "gap"] == [(starts[k], starts[k + 1])]


def test_long_records_end_in_a_zero():
    import gzip

    from swelter.llm import warc

    for text in (b"", b"x" * 1000, b"ab" * (9 << 20)):
        assert gzip.decompress(warc.gzip_member(text) + b"\0") == text


def test_salvage_recovers_all_but_the_damaged():
    from swelter.llm import warc

    def record(k, payload):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n" % (
            k, hashlib.sha256(payload).hexdigest().encode(), len(http) + len(payload))
        return head + http + payload + b"\r\n\r\n"

    def gz(data):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    r = random.Random(4)
    plain = [record(k, bytes(r.randrange(32, 127) for _ in range(300))) for k in range(8)]
    names = lambda found: [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    want = [f"<urn:page:{k}>" for k in range(8)]
    for pack in (lambda x: x, gz):
        parts = [pack(x) for x in plain]
        whole = b"".join(parts)
        assert names(warc.salvage(whole)) == want and not [x for x in warc.salvage(whole) if x[0] == "gap"]
        at = sum(map(len, parts[:3])) + len(parts[3]) // 2
        for broken in (whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :], whole[:at] + b"\0" * 40 + whole[at + 40 :], whole[: at - 20] + whole[at:]):
            found = list(warc.salvage(broken))
            assert names(found) == want[:3] + want[4:], pack
            assert [x for x in found if x[0] == "gap"]
        assert names(warc.salvage(whole[:-30])) == want[:7]
        assert names(warc.salvage(b"junk" * 9 + whole)) == want
    one = gz(b"".join(plain))
    assert names(warc.salvage(one)) == want
    assert names(warc.salvage(plain[0] + gz(plain[1]) + plain[2])) == want[:3]
    assert list(warc.salvage(b"")) == []


# ---- token counts


def test_ledger_is_idempotent_and_additive(spark, edge, tmp_path):
    from pyspark.sql import functions as F

    from swelter.llm import token_counts as tc

    ledger = f"file://{tmp_path}/ledger"
    rows = edge.withColumn("n", tc.count_by(F.col("text"), "words/1"))
    assert tc.commit(ledger, "a", tc.changes(rows, "words/1", "n", 1))
    first = sorted(map(tuple, tc.totals(spark, ledger).collect()), key=str)
    assert not tc.commit(ledger, "a", tc.changes(rows, "words/1", "n", 1))
    (tmp_path / "ledger" / "_new-torn").mkdir()
    assert sorted(map(tuple, tc.totals(spark, ledger).collect()), key=str) == first
    assert ("s", "en", "words/1", 4, 3 + 0 + 3 + 30_000) in first
    assert tc.commit(ledger, "../x y/=", tc.changes(rows.limit(0), "words/1", "n", 1)) and not tc.commit(ledger, "../x y/=", tc.changes(rows, "words/1", "n", 1))
    (tmp_path / "ledger" / "_late").mkdir()
    assert not tc._rename(spark, f"{ledger}/_late", f"{ledger}/batch=a")  # of two writers of one id one wins
    tc.compact(spark, ledger)
    assert sorted(map(tuple, tc.totals(spark, ledger).collect()), key=str) == first and not tc.commit(ledger, "a", tc.changes(rows, "words/1", "n", 1))
    tc.commit(ledger, "b", tc.changes(rows, "words/1", "n", -1))
    assert tc.totals(spark, ledger).count() == 0
    tc.compact(spark, ledger)
    assert tc.totals(spark, ledger).count() == 0 and tc.negatives(spark, ledger).count() == 0
    tc.commit(ledger, "c", tc.changes(rows.where("doc_id = 1"), "words/1", "n", -1))
    assert [(x.source, x.n_docs, x.n_tokens) for x in tc.negatives(spark, ledger).collect()] == [("s", -1, -3)]
    assert tc.totals(spark, f"file://{tmp_path}/none").count() == 0


# ---- quality rules


def test_measures_match_brute_force():
    import re

    from swelter.llm.quality_rules import measures

    r = random.Random(8)
    for _ in range(400):
        t = "".join(r.choice(["a ", "b ", "c ", "a b c d e f g h ", "é ", "#", "\n", "\x0b", "\xa0", "\n\n", "x$ "]) for _ in range(r.randrange(50)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        cover = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert measures(t) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), repr(t)


def test_host_verdicts(spark, edge, empty):
    from swelter.llm import quality_rules as q

    rows = [(f"h{k}", k == 0 or j == 0) for k in range(6) for j in range(50)] + [(None, False), ("tiny", True)]
    v = {x.host: x for x in q.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert not v["h0"].host_ok and v["h1"].host_ok and v[None].host_ok
    assert 0.02 < v["h1"].shrunk_rate < 0.2 and v["tiny"].shrunk_rate < 1
    out = q.judge(edge).collect()
    assert len(out) == len(EDGE) and not any(x.kept for x in out)
    assert q.judge(empty).count() == 0
    # at a rate of exactly one half a host stays
    even = [("a", k % 2 == 0) for k in range(10)] + [("b", k % 2 == 0) for k in range(4)]
    assert all(x.host_ok for x in q.host_verdicts(spark.createDataFrame(even, "host string, base_failed boolean")).collect())


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    from swelter.llm import quality_rules as q
    from swelter.llm import scratch

    df = docs_of(spark, [(k, "w " * 3 if k % 3 else " ".join(map(str, range(30))), None if k % 5 == 0 else f"h{k % 40}" if k % 2 else "hot") for k in range(300)])
    want = sorted(map(str, q.judge(df).collect()))
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(scratch, "SMALL_JOIN", 0)
    monkeypatch.setattr(scratch, "HOT_SHARE", 5)
    assert sorted(map(str, q.judge(df).collect())) == want and len(want) == 300


# ---- quality classifier


def test_classifier_learns_from_positives(spark, empty):
    from pyspark.sql import functions as F

    from swelter.llm import quality_classifier as q

    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 8))) for _ in range(60)) + "."
    rows = [(k, good() if k % 4 else good().replace(" ", "$$$ ").upper(), "s") for k in range(1200)] + [(5000, None, "s"), (None, "x", "s")]
    df = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 1200, 3)], "doc_id long, quality int, toxic int")
    model, x = q.learn(df, labels)
    got = {y.doc_id: y.score for y in q.score(x, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 1202
    assert sum((got[k] >= 0.5) == (k % 4 > 0) for k in range(1200)) > 1190
    poisoned = labels.withColumn("quality", F.when(q.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {y.doc_id: round(y.score, 6) for y in q.score(x, q.learn(df, poisoned)[0]).collect()} == {k: round(s, 6) for k, s in got.items()}
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and 850 < kept.count() < 950
    assert q.keep_good(empty, labels).count() == 0
    assert q.keep_good(df, labels.limit(0)).columns == df.columns


def _minimise(z, p, prior, ridge):
    """Least non-negative risk by plain numpy: the largest of min_w share * A + (1 - share) * B over shares."""
    import numpy as np

    def parts(w):
        g = z @ w
        return prior * np.logaddexp(0, -g[p]).mean(), np.logaddexp(0, g).mean() - prior * g[p].mean()

    def least(share):
        w = np.zeros(z.shape[1])
        for _ in range(60):
            s = 1 / (1 + np.exp(-(z @ w)))
            q = s * (1 - s)
            slope = share * prior * (z[p] * (s[p] - 1)[:, None]).mean(0) + (1 - share) * ((z * s[:, None]).mean(0) - prior * z[p].mean(0)) + ridge * w
            bend = share * prior * (z[p].T @ (z[p] * q[p][:, None])) / p.sum() + (1 - share) * (z.T @ (z * q[:, None])) / len(z) + np.diag(ridge)
            w = w - np.linalg.solve(bend, slope)
        return w

    lo, hi = 0.0, 1.0
    for _ in range(30):
        mid = (lo + hi) / 2
        first, second = parts(least(mid))
        lo, hi = (mid, hi) if first > second else (lo, mid)
    return max(parts(least(lo))) + 0.5 * (ridge * least(lo) ** 2).sum(), lambda w: max(parts(w)) + 0.5 * (ridge * w**2).sum()


@pytest.mark.parametrize("prior", [0.6, 0.75, 0.9])
def test_classifier_is_the_least_of_its_risk(spark, prior):
    import numpy as np

    from swelter.llm import quality_classifier as q

    r = np.random.default_rng(3)
    x = r.normal(size=(600, q.N_FEATURES)).astype(np.float32)
    good = r.random(600) < 0.75
    x[good, :3] += 1.0
    p = good & (r.random(600) < 0.4)
    table = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, p)], "x array<float>, part int").repartition(3)
    model = q.fit(table, prior)
    assert model.converged
    z = np.hstack([((x - model.mean) / model.scale).clip(-8, 8), np.ones((600, 1))])
    want, risk = _minimise(z, p, prior, np.array([q.RIDGE] * q.N_FEATURES + [1e-9]))
    assert abs(risk(model.weights) - want) < 1e-4
    again = q.fit(table, prior, start=q.fit(table, 0.5))
    assert abs(risk(again.weights) - want) < 1e-4


def test_prior_comes_from_positives_and_all_documents(spark):
    import numpy as np

    from swelter.llm import quality_classifier as q

    r = np.random.default_rng(4)
    for share in (0.3, 0.8):
        x = np.zeros((6000, q.N_FEATURES), np.float32)
        good = r.random(6000) < share
        x[:, 0] = np.where(good, 1.5, -1.5) + r.normal(size=6000)
        part = np.where(good & (r.random(6000) < 0.5), q.KEPT_BACK, q.UNLABELLED)
        table = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, part)], "x array<float>, part int")
        model = q.Model(np.zeros(q.N_FEATURES), np.ones(q.N_FEATURES), np.array([1.0] + [0.0] * q.N_FEATURES))
        assert abs(q.estimate_prior(table, model) - share) < 0.06


def test_classifier_edge_cases(spark, edge):
    from swelter.llm import quality_classifier as q

    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model, x = q.learn(edge, some)
        rows = q.score(x, model).collect()
        assert len(rows) == edge.count() and all(0 <= y.score <= 1 for y in rows)
    assert {y.score for y in rows} == {0.5}
    long = docs_of(spark, [(1, "a b. " * 200_000, "s"), (1, "a b. " * 200_000, "s"), (2, "", "s")])
    scores = [y.score for y in q.score(*reversed(q.learn(long, labels))).orderBy("doc_id").collect()]
    assert len(scores) == 3 and scores[0] == scores[1]
    clash = edge.selectExpr("*", "1 AS x", "'p' AS part", "2.0 AS score")
    assert q.keep_good(clash, labels, cut=0.0).columns == clash.columns and q.keep_good(clash, labels, cut=0.0).count() == edge.count()


# ---- near duplicates


def test_similarity_matches_slow_alignment():
    import numpy as np

    from swelter.llm import near_dedup as n

    r = random.Random(7)

    def slow(x, y):
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        return m / (len(x) + len(y) - m) if m else 0.0

    for _ in range(150):
        words = [r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 80))]
        other = list(words)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(other))
            other[k : k + r.randrange(2)] = [r.choice("xyz")]
        if r.random() < 0.2:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        x, y = (n.shingles(n.sequence([w.encode() for w in t])) for t in (words, other))
        want, got = slow(x, y), n.similarity(x, y)
        assert (want >= 0.8) == (got >= 0.8) and (got == 0 or abs(want - got) < 1e-12)


def _near_corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows, k = [], 0
    for _ in range(40):
        base = [word() for _ in range(r.choice([9, 25, 120, 300]))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy), "s"))
            k += 1
    for _ in range(30):  # a shared passage doesn't make near-duplicates
        rows.append((k, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(30)]), "s"))
        k += 1
    rows += [(k + j, rows[5][1].upper(), "s") for j in range(20)]
    return rows


def test_classes_match_brute_force(spark):
    from swelter.llm import near_dedup as n

    rows = _near_corpus()
    x = {i: n.shingles(n.sequence(n.words_of(t))) for i, t, _ in rows}
    text = {i: t.lower() for i, t, _ in rows}
    root = {i: i for i in x}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in x:
        for j in range(i):
            if text[i] == text[j] or n.similarity(x[i], x[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = n.classes(docs_of(spark, rows)).collect()
    assert {y.doc_id: y.class_id for y in got} == {i: find(i) for i in x}
    assert all(y.kept == (y.doc_id == y.class_id) for y in got)
    kept = n.drop_near_copies(docs_of(spark, rows))
    assert sorted(y.doc_id for y in kept.collect()) == sorted({find(i) for i in x})


def test_near_edge_cases(spark, edge, empty):
    from swelter.llm import near_dedup as n

    got = n.classes(edge).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.class_size) for x in got)[-1] == ("None", "None", 5)
    assert sum(x.kept for x in got) == 3
    out = n.drop_near_copies(edge)
    assert out.columns == edge.columns and out.count() == 3
    assert n.classes(empty).count() == 0 and n.drop_near_copies(empty).count() == 0


def test_links_in_a_crowd_at_the_threshold(spark):
    """Texts of 225 shingles with words of their own in some of 45 places, each of which decides five shingles: two texts
    that differ in five places are at 0.8. 100 pairs are, in a crowd of 600 at about 0.7."""
    import numpy as np

    from swelter.llm import near_dedup as n

    r = random.Random(5)
    base, own = [f"w{k}" for k in range(229)], np.zeros((700, 45), int)
    for k in range(600):
        own[k, r.sample(range(45), 4)] = k + 1
    for k in range(600, 700):
        own[k] = own[k - 600]
        own[k, r.sample([at for at in range(45) if not own[k, at]], 5)] = k + 1
    rows = []
    for k in range(700):
        words = list(base)
        for at in np.flatnonzero(own[k]):
            words[4 + 5 * at] = f"x{own[k, at]}y{at}"
        rows.append((k, " ".join(words), "s"))
    least = list(range(700))
    for i in range(700):
        for j in np.flatnonzero((own[:i] != own[i]).sum(1) <= 5):
            a, b = sorted((least[i], least[j]))
            least = [a if c == b else c for c in least]
    assert 300 < len(set(least)) < 601
    got = n.classes(docs_of(spark, rows)).collect()
    assert {y.doc_id: y.class_id for y in got} == dict(enumerate(least))


def test_no_link_is_lost_in_templates(spark):
    """3 templates of 200 words with 400 variants each of 3 to 5 substitutions, against all pairs."""
    import numpy as np

    from swelter.llm import near_dedup as n

    r = random.Random(13)
    rows, own = [], []
    for t in range(3):
        base = [f"t{t}w{k}" for k in range(200)]
        for k in range(400):
            words = list(base)
            for at in r.sample(range(200), r.randint(3, 5)):
                words[at] = f"v{t}x{k}y{at}"
            rows.append((400 * t + k, " ".join(words), "s"))
            own.append(n.shingles(n.sequence(n.words_of(rows[-1][1]))))
    least, links = list(range(1200)), 0
    for i in range(1200):
        for j in range(400 * (i // 400), i):
            # substitutions keep places, so shingles in common are those in the same places
            same = int((own[i] == own[j]).sum())
            if same / (392 - same) >= 0.8 - 1e-9:
                links += 1
                a, b = sorted((least[i], least[j]))
                least = [a if c == b else c for c in least] if a != b else least
    assert links > 300 and len(set(least)) > 500
    got = {y.doc_id: y.class_id for y in n.classes(docs_of(spark, rows)).collect()}
    assert got == dict(enumerate(least))


def test_parity_bits_bound_what_differs():
    import numpy as np

    from swelter.llm import near_dedup as n

    r = np.random.default_rng(3)
    for size in (0, 1, 30, 3000):
        for kept in (0, size // 2, size - size // 10, size):
            x = r.integers(0, 1 << 63, size, np.uint64)
            y = np.concatenate([x[:kept], r.integers(0, 1 << 63, size // 5, np.uint64)])
            bits = n.parity_bits(x) ^ n.parity_bits(y)
            assert len(bits) == n.PARITY and sum(int(b).bit_count() for b in bits.view(np.uint64)) <= len(np.setxor1d(x, y))


def test_near_copies_under_one_id_and_under_null(spark):
    from swelter.llm import near_dedup as n

    base = [f"w{k}" for k in range(100)]
    near = [" ".join([*base[:at], "other", *base[at + 1 :]]) for at in (0, 1, 99)]
    rows = [(1, t, "s") for t in near] + [(None, t.replace("w", "v"), "s") for t in near] + [(2, near[0], "s"), (1, near[0], "s"), (3, "a b c", "s")]
    kept = n.drop_near_copies(docs_of(spark, rows)).collect()
    assert sorted(str(x.doc_id) for x in kept) == ["1", "3", "None"]


def test_a_leader_round_is_linear_in_a_hot_bucket(spark):
    """3,000 classes in one bucket: a round makes some 16 pairs a row, and their leaders retire."""
    from pyspark.sql import functions as F

    from swelter.llm import near_dedup as n

    parity = F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(n.PARITY)])
    open_ = spark.range(3000).select(F.col("id").alias("node"), F.col("id").alias("root"), F.lit(20).cast("long").alias("n_shingles"), F.lit(7).cast("long").alias("key"), parity.alias("parity"), F.array(F.lit(7).cast("long")).alias("keys"))
    pairs, left = n.leader_round(open_, 16, 1)
    led = 3000 - left.count()
    assert left.where("size(keys) <> 1").count() == 0
    assert 4 < led < 40 and pairs.count() == led * 3000 - led * (led + 1) // 2


def test_components_of_a_chain(spark):
    from swelter.llm import near_dedup as n

    links = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 200)]
    got = {x.node: x.root for x in n.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and {got[100], got[200], got[300]} == {100}
    assert n.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- the pipeline


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.scratch.written(stage(spark, docs, d), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    ids = [x.doc_id for x in docs.collect()]
    out = p.STAGES[-1][1](spark, docs, d)
    assert sorted(x.doc_id for x in out.collect()) == sorted(ids) == sorted(x.doc_id for x in p.run(spark, d).collect())
