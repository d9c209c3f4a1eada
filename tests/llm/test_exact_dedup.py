import hashlib
import re

from cases import awkward, frame, with_clashes

from assayflow.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        same = [(-len(u or ""), j is None, j or 0, j) for (j, u), m in zip(rows, norm) if m == n]
        out.append((i, min(same)[3], len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rows = awkward() + [(20, "a b c"), (21, "abc"), (22, " a  b c"), (23, "abd")]
    got = exact_dedup(with_clashes(frame(spark, rows))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each class, repeated rows included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    rows = [(1, "x"), (2, "y"), (3, "x ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}
