import random

import numpy as np
import pytest
from cases import awkward, frame, with_clashes, words

from assayflow.llm import near
from assayflow.llm.common import Scratch
from assayflow.llm.simhash import drop_near_copies


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """The root of each text under transitive links of similarity 0.8, and the pairs' similarities."""
    sets, root, pairs = [grams(t) for t in texts], list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            pairs[j, i] = len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 1.0
            if pairs[j, i] >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], pairs


def edited(r, w, n):
    w = list(w)
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.randrange(10**9)}"
    return w


def planted(seed=1):
    """Copies at all similarities from 0.6 to 1, chains of them, and texts alone."""
    r = random.Random(seed)
    texts = []
    for k in range(40):
        w = words(r.randrange(30, 400), 100 + k, 5000)
        texts.append(w)
        for _ in range(4):
            texts.append(edited(r, r.choice(texts[-2:]), r.randrange(len(w) // 20 + 1)))
    return [" ".join(w) for w in texts]


def test_every_pair_at_the_threshold_is_found(spark):
    texts = planted()
    want, pairs = groups(texts)
    assert sum(0.8 <= j < 0.95 for j in pairs.values()) > 40 and sum(0.6 < j < 0.8 for j in pairs.values()) > 40
    got = {r.doc_id for r in drop_near_copies(with_clashes(frame(spark, list(enumerate(texts))))).collect()}
    assert got == set(want)


@pytest.mark.parametrize("small", [2, 16])
def test_large_groups_by_leaders_against_brute_force(spark, small):
    r = random.Random(5)
    base = words(120, 9, 5000)
    texts = [" ".join(base)] + [" ".join(edited(r, base, r.randrange(5))) for _ in range(70)]
    chain = base
    for _ in range(30):  # each near the one before, the ends far apart
        chain = edited(r, chain, 2)
        texts.append(" ".join(chain))
    want, _ = groups(texts)
    code = near.WordCodes()
    sets = [near.shingle_set(t.encode(), code).view(np.int64).tolist() for t in texts]
    table = spark.createDataFrame(list(enumerate(sets)), "fp long, grams array<long>")
    drawn = [near.sketch(near.least_hashes(np.array(x).view(np.uint64))).view(np.int64).tolist() for x in sets]
    members = spark.createDataFrame([(k, i, drawn[i]) for k in range(2) for i in range(len(texts))], "key long, fp long, sketch array<long>")
    got = {r.vertex: r.root for r in near.near_components(members, table, Scratch(spark, "test"), 0.8, small).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_sketches_differ_as_sets_do():
    r = np.random.default_rng(3)
    for share, low, high in ((1.0, 0, 0), (0.8, 20, 71), (0.6, 60, 115), (0.0, 180, 250)):
        x = r.integers(0, 1 << 64, 1000, np.uint64)
        same = int(round(1000 * 2 * share / (1 + share)))
        y = np.r_[x[:same], r.integers(0, 1 << 64, 1000 - same, np.uint64)]
        a, b = near.sketch(near.least_hashes(x)), near.sketch(near.least_hashes(y))
        d = a ^ b
        assert low <= int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()) <= high


def test_rows_without_words_and_repeated_rows(spark):
    rows = awkward()
    want = groups([t for _, t in rows])[0]
    assert drop_near_copies(frame(spark, rows)).count() == len(set(want))


def test_a_large_group_takes_few_rounds(spark, monkeypatch):
    """A family of some 0.7 with links here and there: what is left of it ends at once, not a member of each component a round."""
    r = random.Random(8)
    base = words(150, 9, 5000)
    texts = [" ".join(edited(r, base, r.randrange(2, 7))) for _ in range(300)]
    want, _ = groups(texts)
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    code = near.WordCodes()
    sets = [near.shingle_set(t.encode(), code) for t in texts]
    rows = [(0, i, x.view(np.int64).tolist(), near.sketch(near.least_hashes(x)).view(np.int64).tolist()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "key long, fp long, grams array<long>, sketch array<long>")
    got = {r.vertex: r.root for r in near.near_components(table.select("key", "fp", "sketch"), table.select("fp", "grams"), Scratch(spark, "test"), 0.8).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want and len(set(want)) > 20
    assert sum(name.startswith("rows-") for name in saved) <= 5
