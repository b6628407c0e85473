"""Archives by their tables of contents: what is chosen, what is damaged, what is never unpacked."""

import io
import zipfile

import pytest


def packed(members, method=zipfile.ZIP_DEFLATED, comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", method) as z:
        z.comment = comment
        for name, text in members:
            z.writestr(name, text)
    return held.getvalue()


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("s", "A801_"), ("t", "B901_")], "station string, code string")


def put(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    return f"file://{tmp_path}/*.zip"


def lines_of(spark, path, known):
    from swelter.sources import stations

    lines, damage = stations.archive_lines(spark, path, known)
    got = sorted((x.city, x.name, x.line_no, x.line) for x in lines.collect())
    return got, sorted((x.archive.rpartition("/")[2], x["name"], x.damage) for x in damage.collect())


FULL, PART = "X_A801_A_31-12-2020.CSV", "X_A801_A_30-06-2020.CSV"


def test_a_member_in_two_archives_counts_once_from_the_first_archive(spark, tmp_path, known):
    path = put(tmp_path, a=packed([(FULL, "1;á\r\n2".encode("latin-1")), ("u/", "")]), b=packed([(FULL, "changed"), (PART, "never")]))
    assert lines_of(spark, path, known) == ([("s", FULL, 0, "1;á"), ("s", FULL, 1, "2")], [])


def test_broken_archives_and_members_are_listed_and_unwanted_ones_never_unpacked(spark, tmp_path, known):
    good = packed([(PART, "never"), (FULL, "ok\n")], comment=b"x" * 300)
    at = good.find(b"never")
    assert at < 0  # it is packed
    bad_part = bytearray(good)
    bad_part[32 + len(PART)] ^= 0xFF  # in the unwanted member's data
    bad = bytearray(packed([("X_B901_A_31-12-2021.CSV", "x" * 5000)]))
    bad[60] ^= 0xFF
    path = put(tmp_path, a=bytes(bad_part), b=bytes(bad), c=b"no archive at all", e=packed([("X_B901_A_31-12-2020.CSV", "fine")])[:-30], f=packed([("X_B901_B-2022.CSV", "stored\r\n\r\nend")], zipfile.ZIP_STORED), g=packed([]))
    got, damage = lines_of(spark, path, known)
    assert got == [("s", FULL, 0, "ok")] + [("t", "X_B901_B-2022.CSV", k, x) for k, x in enumerate(["stored", "", "end"])]
    assert [x[:2] for x in damage] == [("b.zip", "X_B901_A_31-12-2021.CSV"), ("c.zip", None), ("e.zip", None)]


def test_methods_that_are_not_supported_and_encrypted_members_are_listed(spark, tmp_path, known):
    encrypted = bytearray(packed([(FULL, "secret")]))
    encrypted[6] |= 1
    encrypted[encrypted.find(b"PK\x01\x02") + 8] |= 1
    path = put(tmp_path, a=packed([("X_B901_A_31-12-2021.CSV", "x" * 50)], zipfile.ZIP_BZIP2), b=bytes(encrypted))
    got, damage = lines_of(spark, path, known)
    assert got == [] and [x[1:] for x in damage] == [("X_B901_A_31-12-2021.CSV", "method 12 isn't supported"), (FULL, "encrypted")]


def test_a_table_of_contents_longer_than_the_tail(spark, tmp_path, known, monkeypatch):
    from swelter.sources import archives

    monkeypatch.setattr(archives, "TAIL", 2000)
    many = [(f"X_A801_{k:03d}-{2000 + k % 30}.CSV", f"{k}\n" * 50) for k in range(120)]
    path = put(tmp_path, a=packed(many), b=packed([("X_B901_1-2020.CSV", "b")]), c=b"y" * 5000)
    listed = archives.contents(spark, path).collect()
    assert sum(x.damage is None for x in listed) == 121 and [x.archive[-5:] for x in listed if x.damage] == ["c.zip"]
    got, damage = lines_of(spark, path, known)
    assert len(got) == 30 * 50 + 1 and {x[1] for x in got if x[0] == "s"} == {f"X_A801_{k:03d}-{2000 + k}.CSV" for k in range(30)}
    assert [x[:2] for x in damage] == [("c.zip", None)]


def test_codes_of_many_lengths(spark):
    from swelter.sources import stations

    codes = [("c" * k, f"<{'k' * k}>") for k in range(1, 201)]
    known = spark.createDataFrame(codes, "station string, code string")
    names = spark.createDataFrame([(f"p{code}q", 2020) for _, code in codes] + [("", 2020), (None, 2020)], "name string, year int")
    got = stations.select_station_files(names, known).collect()
    assert {(x.station, x["name"]) for x in got} == {(s, f"p{c}q") for s, c in codes}
    assert stations.select_station_files(names, known.limit(0)).count() == 0 and stations.select_station_files(names.limit(0), known).count() == 0


def test_more_years_than_the_plan_takes_are_an_error(spark, monkeypatch):
    from swelter.sources import stations

    known = spark.createDataFrame([("s", "x")], "station string, code string")
    found = spark.createDataFrame([("s", 3)], "station string, year int")
    years = spark.range(5).selectExpr("CAST(id AS INT) AS year")
    assert sorted(x.year for x in stations.check_station_years(found, known, years).collect()) == [0, 1, 2, 4]
    assert stations.check_station_years(found, known, years.limit(0)).count() == 0
    monkeypatch.setattr(stations, "MOST_YEARS", 4)
    with pytest.raises(ValueError):
        stations.check_station_years(found, known, years)


def test_a_member_in_many_pieces(spark, tmp_path, known, monkeypatch):
    """Tasks get pieces of bounded size, in order, and give the same lines and damage; stored and deflated members larger than what is held in memory."""
    from swelter.sources import archives

    for name, v in (("PIECE", 100), ("HELD", 500), ("STEP", 64)):
        monkeypatch.setattr(archives, name, v)
    text = "\n".join(f"{k};{k * k % 977}" for k in range(3000))
    bad = bytearray(packed([("X_B901_A_31-12-2021.CSV", text)]))
    bad[3000] ^= 0xFF
    path = put(tmp_path, a=packed([(PART, "no"), (FULL, text)]), b=packed([("X_B901_A_31-12-2020.CSV", text)], zipfile.ZIP_STORED), c=bytes(bad))
    got, damage = lines_of(spark, path, known)
    want = list(enumerate(text.split("\n")))
    assert [x[2:] for x in got if x[0] == "s"] == want and [x[2:] for x in got if x[0] == "t"] == want
    assert [x[:2] for x in damage] == [("c.zip", "X_B901_A_31-12-2021.CSV")]


def test_unpacking_takes_bounded_parts():
    from swelter.sources import archives

    data = packed([("x", b"\0" * 50_000_000)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        size = z.infolist()[0].compress_size
    parts = [len(p) for p in archives.unpacked(io.BytesIO(data), size, 8)]
    assert sum(parts) == 50_000_000 and max(parts) <= archives.STEP


def test_packing_streams():
    """Rows of an archive leave long before its last line comes, and make a whole archive."""
    import random

    from swelter.plans import files

    r = random.Random(1)
    lines, taken = [f"{r.random()}" for _ in range(400_000)], [0]

    def come():
        for x in lines:
            taken[0] += 1
            yield x

    made, at_first = [], None
    for row in files._packed(7, "A", 2000, come(), False):
        at_first = at_first or taken[0]
        made.append(row)
    assert at_first < 300_000 and [x[1] for x in made] == list(range(len(made)))
    with zipfile.ZipFile(io.BytesIO(b"\n".join(x[2] for x in made) + b"\n")) as z:
        assert z.testzip() is None
        part, full = (z.read(x).decode("latin-1").split("\r\n") for x in z.namelist())
    assert part == [*files._HEAD, *lines[:9]] and full == [*files._HEAD, *lines]


def test_lines_of_a_city_are_written_by_many_tasks(spark, tmp_path):
    from swelter.plans import files

    files._by_city(spark.range(0, 400, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN 'A' ELSE 'N' END AS city", "CAST(id AS STRING) AS line"), f"file://{tmp_path}/name=good-")
    for city, k in (("A", 0), ("N", 1)):
        found = list((tmp_path / f"name=good-{city}").glob("part-*"))
        assert len(found) == 4 and sorted(int(x) for f in found for x in f.read_text().split()) == list(range(k, 400, 2))


def test_no_archive_is_read_as_one_row(spark, tmp_path, known):
    """Spark's file source gives a file in one row; with so low a limit on it an archive that is read so fails the job."""
    text = "\n".join(f"{k};{k * k % 977}" for k in range(30_000))
    path = put(tmp_path, a=packed([(PART, "no"), (FULL, text)]), b=packed([("X_B901_A_31-12-2020.CSV", text)])[:-3000])
    limit, split = "spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(limit, "5000")
        spark.conf.set(split, "10000")
        got, damage = lines_of(spark, path, known)
    finally:
        spark.conf.unset(limit)
        spark.conf.unset(split)
    assert [x[2:] for x in got] == list(enumerate(text.split("\n"))) and [x[:2] for x in damage] == [("b.zip", None)]


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_pieces_hold_all_bytes(spark, tmp_path, monkeypatch, split):
    import random

    from swelter.sources import archives

    monkeypatch.setattr(archives, "PIECE", 300)
    r = random.Random(1)
    files = {
        "a b+c%20\u00e9.zip": r.randbytes(20_000), "feeds.zip": b"\n" * 2000, "one": b"x", "last.zip": b"abc\r\n", "long.zip": b"y" * 5000 + b"\n" + b"z" * 901,
        "mark.zip": b"\xef\xbb\xbf" + r.randbytes(3000), "mark_last.zip": b"\xef\xbb\xbfab\n", "named.zip.GZ": r.randbytes(3000), "named.bz2": b"a\nb\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = archives.pieces(spark, f"file://{tmp_path}/*").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {x.archive.rpartition("/")[2] for x in rows} == set(files) and max(len(x.bytes) for x in rows) <= 301
    for name, data in files.items():
        own = sorted((x for x in rows if x.archive.endswith(f"/{name}")), key=lambda x: x.at)
        first = own[0].at
        assert first == (3 if name.startswith("mark") else 0) and {x.length for x in own} == {len(data)}
        assert all(x.at + x.n == y.at and x.n == len(x.bytes) for x, y in zip(own, own[1:]))
        assert b"".join(x.bytes for x in own)[: len(data) - first] == data[first:]


def test_members_in_many_chunks(spark, tmp_path, known, monkeypatch):
    """Small members that share a piece, and one that goes over many chunks, each come whole and once."""
    from swelter.sources import archives

    for name, v in (("PIECE", 100), ("CHUNK", 256)):
        monkeypatch.setattr(archives, name, v)
    text = "\n".join(f"{k * k % 977}" for k in range(3000))
    small = [(f"X_B901_A_31-12-{2000 + k}.CSV", f"{k}") for k in range(40)]
    path = put(tmp_path, a=packed([*small[:20], (FULL, text), *small[20:]]))
    got, damage = lines_of(spark, path, known)
    assert damage == [] and [x[2:] for x in got if x[0] == "s"] == list(enumerate(text.split("\n")))
    assert sorted((x[1], x[3]) for x in got if x[0] == "t") == sorted(small)


def test_an_archive_that_is_cut_short_is_known_by_its_last_bytes():
    from swelter.sources import archives

    data = packed([(f"{k}", f"{k}" * 50) for k in range(3000)], zipfile.ZIP_STORED)
    end = lambda data, n: archives._End(io.BytesIO(data[-n:]), len(data) - n, len(data))
    rows, wanted = archives._members("a", end(data[:-30], 70_000))
    assert wanted is None and len(rows) == 1 and rows[0][-1].startswith("no table of contents")
    # a table that begins earlier says where
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        begins, found = z.start_dir, z.infolist()
    assert archives._members("a", end(data, 70_000)) == ([("a", *[None] * 9)], begins)
    rows, wanted = archives._members("a", end(data, len(data) - begins))
    assert wanted is None and [(x[1], x[2]) for x in rows] == [(x.filename, x.header_offset) for x in found]


def test_texts_of_lines():
    from swelter.sources import archives

    for text, want in ((b"", []), (b"\n", [""]), (b"a", ["a"]), (b"a\n", ["a"]), (b"a\n\nb\n\n", ["a", "", "b", ""])):
        assert [t for _, x in archives._texts(iter([text])) for t in x.split("\n")] == want
    lines = [f"{k}" * (k % 50) for k in range(20_000)] + ["w" * 200_000, "", "", "end"]
    data = "\n".join(lines).encode()
    got = list(archives._texts(data[k : k + 1000] for k in range(0, len(data), 1000)))
    assert [t for _, x in got for t in x.split("\n")] == lines and len(got) > 10
    assert [n for n, _ in got] == [sum(x.count("\n") + 1 for _, x in got[:k]) for k in range(len(got))]


def test_lines_are_parsed_in_methods_that_are_compiled(spark):
    """Java's virtual machine doesn't compile methods of more than 8,000 bytes; parsing lines was one."""
    import re

    from swelter.operators import clean
    from swelter.sources import stations

    days = clean.hourly_to_daily(clean.range_qc(stations.parse_hourly(stations.split_fields(spark.range(3).selectExpr("'s' AS city", "concat(id, ';') AS line")))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(days._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


def test_numbers_with_a_comma_or_none(spark):
    from pyspark.sql import functions as F

    from swelter.functions.columns import parse_comma_numeric

    want = {"1,5": 1.5, ",5": 0.5, "1,": 1.0, "1,5E-3": 0.0015, "-9999.0": -9999.0, "-9999,00": -9999.0, "-9999\n": -9999.0, "-99990": -99990.0}
    none = ["-9999", "-9999,0", "1,2,3", "1.2,3", "", " 1", "1d", "NaN", "Infinity", "0x1p3", "1e", "1_0"]
    got = spark.createDataFrame([(x,) for x in [*want, *none]], "t string").select("t", parse_comma_numeric(F.col("t")).alias("v")).collect()
    assert {x.t: x.v for x in got} == want | dict.fromkeys(none)
