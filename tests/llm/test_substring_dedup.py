import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import awkward, frame, with_clashes, words

from assayflow.llm import anchors
from assayflow.llm.common import Scratch
from assayflow.llm.substring_dedup import repeated_spans, substring_dedup


def brute(rows, window):
    texts = [(t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") for _, t in rows]
    texts = [[w for w in t if w] for t in texts]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = set()
        for s in range(len(t) - window + 1):
            if seen[tuple(t[s : s + window])] > 1:
                gone |= set(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(t) if k not in gone)
        out.append((i, len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def mixed(seed, n=120, window=35):
    """Fresh words, shared passages cut at any place, near copies, periodic text, repeats inside one text."""
    r = random.Random(seed)
    shared = [words(r.choice((window - 1, window, window + 1, 60, 150)), 1000 + i, 50) for i in range(12)]
    rows, texts = [], []
    for i in range(n):
        t = []
        for _ in range(r.randrange(1, 6)):
            kind = r.random()
            if kind < 0.35:
                t += words(r.randrange(1, 80), seed * 1000 + i, 400)
            elif kind < 0.75:
                p = r.choice(shared)
                a = r.randrange(len(p)) if r.random() < 0.5 else 0
                p = p[a : r.randrange(a, len(p)) + 1] if r.random() < 0.5 else p[a:]
                if r.random() < 0.3 and p:
                    p = list(p)
                    p[r.randrange(len(p))] = "changed"
                t += p * r.choice((1, 1, 1, 3))
            elif kind < 0.85:
                t += ["a"] * r.randrange(1, 120)
            elif kind < 0.92:
                t += ["x", "y", "z"] * r.randrange(1, 40)
            elif texts:
                t += r.choice(texts)
        texts.append(t)
        rows.append((i, " ".join(t)))
    return rows


def run(spark, rows, **how):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in substring_dedup(with_clashes(frame(spark, rows)), **how).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = mixed(seed)
    assert run(spark, rows) == sorted(map(str, brute(rows, 35)))


def test_small_windows_against_brute_force(spark):
    rows = mixed(7, 80, 6)
    assert run(spark, rows, window=6, gram=3) == sorted(map(str, brute(rows, 6)))


def test_awkward_and_repeated_rows(spark):
    p = " ".join(words(50, 77))
    rows = awkward() + [(70, p), (70, p), (71, p + " tail"), (72, " ".join(words(40, 78))), (73, " ".join(words(34, 78)))]
    assert run(spark, rows) == sorted(map(str, brute(rows, 35)))
    assert run(spark, [(1, p), (1, p)]) == sorted(map(str, brute([(1, p), (1, p)], 35)))


def test_blocks_find_what_differs_from_the_lead(spark):
    """Four families share an anchor with the lead's document, and no more: further blocks find them, before any hash of windows."""

    class Kept(Scratch):
        def save(self, df, name):
            tables[name] = super().save(df, name)
            return tables[name]

    anchor, rows = words(30, 900), []
    for k in range(4):
        side = [words(40, 901 + k), words(40, 950 + k)]
        rows += [(10 * k + i, " ".join(words(20, 1000 + 10 * k + i) + side[0] + anchor + side[1])) for i in range(3)]
    spans, open_windows = {}, {}
    for more in (0, 3):
        tables = {}
        found = repeated_spans(anchors.Repeats(frame(spark, rows), Kept(spark, "blocks"), 35, 12), Kept(spark, "blocks"), 35, 12, more)
        spans[more] = {(r.uid, w) for r in found.collect() for w in range(r.start, r.stop)}
        open_windows[more] = tables["left"].groupBy("hash").count().filter("count > 1").count()
    assert spans[0] == spans[3] and len(spans[3]) == 12 * 110
    assert open_windows[0] > 0 and open_windows[3] == 0


def test_kept_text(spark):
    p = " ".join(words(35, 5))
    got = {r.doc_id: r.kept_text for r in substring_dedup(frame(spark, [(1, "b " + p + " e"), (2, p), (3, "clean")]), keep_text=True).collect()}
    assert got == {1: "b e", 2: "", 3: None}


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).collect() == []


def test_hash_of_runs():
    codes = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    twice = np.concatenate([codes, codes])
    for n in (1, 2, 3, 5, 12, 35, 36):
        h = anchors.sequence_hashes(twice, n)
        assert len(h) == len(twice) - n + 1 and (h[:50] == h[100:150]).all() and len(np.unique(h)) == 100
