import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, frame, with_clashes

from assayflow.llm.line_dedup import HASH, LineDedup, PerfectHash, line_index

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, length=40, common=5):
    holders = defaultdict(list)
    for at, (i, text) in enumerate(rows):
        for key in {key_of(x) for x in (text or "").split("\n")}:
            holders[key].append((at, i))
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            held = holders[key_of(line)]
            known = [j for _, j in held if j is not None]
            top = max(known) if known else None
            if len(key_of(line)) < length or len(held) < common or i == top:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    pool = [("Line %d of the pool, ÄÖ and 漢字 in it, " % i) + "x" * r.randrange(0, 30) for i in range(60)]
    rows = []
    for i in range(120):
        lines = [r.choice([" ", "\t", ""]) + (x.upper().replace("ß", "ß") if r.random() < 0.2 and x.isascii() else x) + r.choice(["", "\r", "  "]) for x in r.sample(pool, r.randrange(0, 9))]
        rows.append((1000 + i if i % 17 else None, "\n".join([*lines, "short", "own line number %d that nobody else in the table has" % i, *lines[:1]])))
    shared = "The one line that every document of a crawl has in its foot: all rights reserved"
    rows += [(5000 + i, shared + "\n" + shared.lower()) for i in range(50)]
    rows += [(7, "é" * 39), (8, "é" * 40), (9, "é" * 40), (10, "é" * 40), (11, "É".lower() * 40), (12, "é" * 40 + " ")]
    return awkward() + rows + [(20 + i, "é" * 39) for i in range(6)] + [(None, "only rows without an id have this line, many of them")] * 6


@pytest.mark.parametrize("shard, block", [(1 << 17, 1 << 18), (16, 24)])
def test_against_brute_force(spark, shard, block):
    rows = corpus()
    found = LineDedup(with_clashes(frame(spark, rows)).repartition(5), shard=shard, block=block)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found.digest().collect()), key=str)
    assert got == brute(rows)
    texts = sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in found.texts().collect()), key=str)
    assert texts == sorted(((i, sha) for i, _, _, sha in brute(rows)), key=str)


def test_empty_table(spark):
    assert LineDedup(frame(spark, [])).digest().collect() == []


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 50_000):
        keys = np.zeros(2 * n, HASH)
        keys["h"], keys["f"] = r.integers(0, 1 << 63, 2 * n, np.uint64), r.integers(0, 1 << 32, 2 * n, np.uint32)
        keys["h"][: n // 2] = keys["h"][n // 2 : 2 * (n // 2)]  # told apart by the fingerprint alone
        known, strange = keys[:n], keys[n:]
        found = PerfectHash.of(known)
        slots = found.slots(known)
        assert sorted(slots.tolist()) == list(range(n))
        prints = np.zeros(n, np.uint32)
        prints[slots] = known["f"]
        other = found.slots(strange)
        assert (other < n).all() and not (prints[other[other >= 0]] == strange["f"][other >= 0]).any()
        if n > 1000:
            assert found.bits.nbytes * 8 < 5 * n


def test_index_holds_each_distinct_line_once(spark):
    rows = corpus()
    found = LineDedup(frame(spark, rows), shard=16)
    shards = line_index(found.prints, 8).collect()
    counts = np.concatenate([np.frombuffer(s.counts, "<u4") for s in shards])
    holders = defaultdict(set)
    for at, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(at)
    assert sorted(counts.tolist()) == sorted(map(len, holders.values()))
