import gzip
import random
import time

from pyspark.sql import functions as F

from assayflow.llm import warc
from assayflow.llm.common import Scratch

PAGES = "page_id long, url string, html string"
RECORDS = "file string, offset long, record binary"


def pages(spark, n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, f"http://a{i}.example.com/", "<p>" + "x" * r.randrange(3000) + "é</p>") for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None), (5, "http://again.example.com", ""), (5, "http://again.example.com", "")], PAGES)


def record(n, body=None):
    body = b"x" * n if body is None else body
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_files_are_read_back(spark, tmp_path):
    table = pages(spark).repartition(3).withColumn("file", F.lit(1)).withColumn("row", F.lit(1)).withColumn("value", F.lit(1))
    warc.write_warc(table, str(tmp_path / "out"))
    rows = warc.read_warc(spark, str(tmp_path / "out")).orderBy("file", "offset").collect()
    assert {r.status for r in rows} == {"whole"} and len(rows) == 126
    first = [r for r in rows if r.file == rows[0].file]
    assert [r.offset for r in first] == [sum(r.length for r in first[:i]) for i in range(len(first))]  # bytes of the stream
    want = table.select("page_id", warc.record_text(F.col("url"), F.col("html")).alias("t")).collect()
    got = [(bytes(b.record).split(b"page-id: ")[1].split(b"\r")[0].decode(), bytes(a.record)) for a, b in zip(rows[::2], rows[1::2])]
    assert sorted(got) == sorted((str(w.page_id) if w.page_id is not None else "", w.t.encode()) for w in want)
    warc.write_warc(table.limit(0), str(tmp_path / "none"))
    (tmp_path / "none").mkdir(exist_ok=True)
    assert warc.read_warc(spark, str(tmp_path / "none")).collect() == []


def test_damage_becomes_rows_and_the_rest_is_read(spark, tmp_path):
    parts = [record(n) for n in (5, 70_000, 0, 300)]
    starts = [sum(map(len, parts[:i])) for i in range(4)]
    parse = lambda data: [(o, len(r) if r is not None else None, s) for o, _, r, s in warc.parse_records(data)]
    plain = b"".join(parts)
    sound = [(o, len(p), "whole") for o, p in zip(starts, parts)]
    assert parse(plain) == sound and parse(b"") == []
    assert parse(plain[:-50]) == [*sound[:3], (starts[3], len(parts[3]) - 50, "cut")]
    assert parse(b"?" + plain[1:]) == [(0, None, "unreadable"), *sound[1:]]
    assert parse(plain.replace(b"Content-Length: 70000", b"Content-Xength: 70000")) == [sound[0], (starts[1], None, "unreadable"), *sound[2:]]
    assert parse(plain.replace(b"Length: 70000", b"Length: 70009")) == [sound[0], (starts[1], len(parts[1]), "damaged"), *sound[2:]]
    assert parse(plain[: starts[1]] + bytes(len(parts[1])) + plain[starts[2] :]) == [sound[0], (starts[1], None, "unreadable"), *sound[2:]]
    members = [gzip.compress(p) for p in parts]
    places = [sum(map(len, members[:i])) for i in range(4)]
    whole = [(o, len(p), "whole") for o, p in zip(places, parts)]
    packed = b"".join(members)
    assert parse(packed) == whole
    assert parse(gzip.compress(plain)) == sound
    holed = plain[: starts[1]] + bytes(len(parts[1]) - 4) + b"\r\n\r\n" + plain[starts[2] :]
    assert parse(gzip.compress(holed)) == [sound[0], (starts[1], None, "unreadable"), *sound[2:]]
    assert parse(packed[:-3]) == [*whole[:3], (places[3], len(parts[3]), "whole"), (places[3] + len(parts[3]), None, "unreadable")]
    broken = bytearray(packed)
    broken[places[1] + 12] ^= 255
    assert parse(bytes(broken)) == [whole[0], (places[1], None, "unreadable"), *whole[2:]]
    (tmp_path / "a.warc").write_bytes(plain[:-50])
    (tmp_path / "b.warc.gz").write_bytes(bytes(broken))
    got = sorted((r.file, r.offset, r.status) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [("a.warc", o, s) for o, _, s in parse(plain[:-50])] + [("b.warc.gz", o, s) for o, _, s in parse(bytes(broken))]


def test_any_flipped_byte_leaves_the_other_records():
    r = random.Random(6)
    parts = [record(0, bytes(r.randrange(32, 127) for _ in range(r.randrange(200)))) for _ in range(12)]
    for packed in (False, True):
        files = [gzip.compress(p) if packed else p for p in parts]
        data = b"".join(files)
        for _ in range(300):
            at = r.randrange(len(data))
            hit = next(i for i in range(12) if at < sum(map(len, files[: i + 1])))
            rows = list(warc.parse_records(data[:at] + bytes([data[at] ^ (1 << r.randrange(8))]) + data[at + 1 :]))
            found = [x for _, _, x, s in rows if s == "whole"]
            assert [p for i, p in enumerate(parts) if abs(i - hit) > 0] == [x for x in found if x in parts and x != parts[hit]] or any(parts[i] == parts[hit] for i in range(12) if i != hit)


def test_many_small_members_are_read_in_one_pass():
    r = random.Random(7)
    data = b"".join(gzip.compress(record(0, r.randbytes(3700)), 1) for _ in range(8000))
    began = time.process_time()
    assert sum(s == "whole" for *_, s in warc.parse_records(data)) == 8000
    assert len(data) > 29_000_000 and time.process_time() - began < 3


def test_query_audits_files(spark):
    from assayflow.llm.queries import op4_warc_fixity

    got = {r.page_id: r.status for r in op4_warc_fixity(spark, "/root/testdata/sf0.001").collect()}
    assert got and got == {i: "missing" if i % 193 == 5 else "changed" if i % 97 == 13 else "intact" for i in got}


def damage(rows, r):
    out, want = [], {}
    for file, offset, record in rows:
        kind = r.random()
        if kind < 0.03:
            want[file, offset] = "missing"
        elif kind < 0.06:
            out.append((file, offset, record[:-1] + b"#"))
            want[file, offset] = "changed"
        else:
            out.append((file, offset, record))
        if kind > 0.98:
            out.append((file, offset + 1, b"new"))
            want[file, offset + 1] = "extra"
    return out, want


def replica(seed, files=7, n=40):
    r = random.Random(seed)
    rows = []
    for f in range(files):
        at = 0
        for _ in range(n):
            size = r.choice((10, 500, 90_000, 5_000_000))
            rows.append((f"f{f}.warc", at, bytes([r.randrange(256)]) * r.randrange(1, 9)))
            at += size
    return rows


def run(spark, a, b):
    make = lambda rows: spark.createDataFrame([(f, o, bytearray(x) if x is not None else None) for f, o, x in rows], RECORDS)
    return {(r.file, r.offset): r.status for r in warc.audit(make(a), make(b), Scratch(spark, "test")).collect()}


def test_damage_is_located(spark):
    rows = replica(1)
    other, want = damage(rows, random.Random(2))
    assert len(want) > 10
    assert run(spark, rows, other) == want


def test_equal_and_empty_replicas(spark):
    rows = replica(3, 2, 5)
    assert run(spark, rows, list(reversed(rows))) == {}
    assert run(spark, [], []) == {}
    assert run(spark, rows, []) == {(f, o): "missing" for f, o, _ in rows}
    assert run(spark, [], rows) == {(f, o): "extra" for f, o, _ in rows}


def test_odd_rows(spark):
    a = [("f", 0, b"x"), ("f", 0, b"y"), ("f", 9, None)]
    assert run(spark, a, [("f", 0, b"y"), ("f", 0, b"x"), ("f", 9, None)]) == {}
    assert run(spark, a, [("f", 0, b"y"), ("f", 9, b"")]) == {("f", 0): "changed", ("f", 9): "changed"}
    odd = [(None, 0, b"x"), (None, None, b"y"), ("f", None, b"z"), ("", 3, b"w")]
    assert run(spark, odd, odd[::-1]) == {}
    assert run(spark, odd, [(f, o, x + b"!") for f, o, x in odd]) == {(f, o): "changed" for f, o, _ in odd}
    assert run(spark, odd, odd[2:]) == {(None, 0): "missing", (None, None): "missing"}


def test_only_branches_that_differ_are_read(spark, monkeypatch):
    rows = replica(4, 6, 30)
    other = [(f, o, b"bad" if (f, o) == rows[50][:2] else x) for f, o, x in rows]
    scratch, sizes = Scratch(spark, "test"), {}
    save = scratch.save

    def counting(df, name):
        out = save(df, name)
        if name.startswith("differ"):
            sizes[name] = out.count()
        return out

    monkeypatch.setattr(scratch, "save", counting)
    make = lambda rows: spark.createDataFrame([(f, o, bytearray(x)) for f, o, x in rows], RECORDS)
    (hit,) = warc.audit(make(rows), make(other), scratch).collect()
    assert (hit.file, hit.offset, hit.status) == (*rows[50][:2], "changed")
    assert set(sizes.values()) == {1}


def test_a_changed_record_reads_the_leaves_of_its_range_only(spark, tmp_path):
    table = pages(spark, 300).coalesce(1)
    warc.write_warc(table, str(tmp_path / "one"))
    text = warc.record_text(F.col("url"), F.col("html"))
    changed = F.when(F.col("page_id") == 150, F.concat(F.expr("left(_r, length(_r) - 5)"), F.lit("#\r\n\r\n"))).otherwise(F.col("_r"))
    warc.write_warc(table.withColumn("_r", text), str(tmp_path / "other"), changed)
    one, other = (warc.read_warc(spark, str(tmp_path / name)).select("file", "offset", "record") for name in ("one", "other"))
    scratch = Scratch(spark, "test")
    a, b = warc.Tree(one, scratch, "one"), warc.Tree(other, scratch, "other")
    ranges = a.leaves.groupBy("parent").count()
    assert ranges.count() > 5 and a.levels[0].count() == ranges.count()
    x, y = warc.differing_leaves(a, b, scratch)
    (hit,) = warc.audit(one, other, Scratch(spark, "whole")).collect()
    (seen,) = {r.parent for r in x.select("parent").collect()}
    assert hit.status == "changed" and hit.offset >> warc.RANGE_BITS == int(seen.split("/")[-1])
    assert x.count() == y.count() == a.leaves.filter(F.col("parent") == seen).count() < a.leaves.count() / 4
