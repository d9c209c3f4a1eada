import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from cases import awkward, frame, with_clashes, words

from assayflow.llm import simhash
from assayflow.llm.common import LOWER, Scratch
from assayflow.llm.components import connected_components


def plain(text):
    w = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def components(codes):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = sorted(root)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def near(rng, n, seeds, flips):
    base = [rng.getrandbits(64) for _ in range(seeds)]
    out = []
    for _ in range(n):
        c = rng.choice(base)
        for _ in range(rng.randrange(flips + 1)):
            c ^= 1 << rng.randrange(64)
        out.append(c)
    return out


def test_fingerprint_matches_definition():
    for t in (None, "", "a", "A b", "the cat sat on the mat", " ".join(words(400, 3))):
        assert simhash.fingerprint((t or "").encode()) == plain(t)


def test_gray_rank_inverts_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("seeds,flips", [(400, 4), (3, 5), (1, 3)])
def test_index_finds_every_link(seeds, flips):
    codes = np.array(sorted(set(near(random.Random(seeds), 700, seeds, flips))), np.uint64)
    for groups in (1, 90):
        keys = np.random.default_rng(1).integers(0, groups, len(codes))
        order = np.lexsort((simhash.gray_rank(codes), keys))
        k, c = keys[order], codes[order]
        found = [(int(a), int(b)) for x, y in simhash.index_links(k, c) for a, b in zip(x, y)]
        want = {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if k[i] == k[j] and int(c[i] ^ c[j]).bit_count() <= 3}
        assert len(found) == len(set(found)) and set(found) == want


def test_tree_prunes_node_pairs_of_real_documents(spark):
    """The query's own routing and trees: whole groups go by accumulated differences, and no link is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    codes = simhash.fingerprints(docs).select("fp").distinct()
    rows = simhash._route(codes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("bits"), "fp"), 0).select("key", "fp").toPandas()
    keys, fp = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    tally = {}
    edges = simhash.group_forest(keys, fp, tally=tally)
    assert tally["pruned"] > 20 and tally["pruned"] > 0.2 * tally["seen"]
    order = np.lexsort((simhash.gray_rank(fp), keys))
    root = {int(c): int(c) for c in fp}
    k, c = keys[order], fp[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(k)) + 1, len(k)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(cuts[:-1], cuts[1:]):  # all pairs of each group
        for i in range(a, b):
            for j in range(i + 1, b):
                if int(c[i] ^ c[j]).bit_count() <= 3:
                    x, y = sorted((find(int(c[i])), find(int(c[j]))))
                    root[y] = x
    label = {x: x for x in root}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(*edges):
        x, y = sorted((top(int(x)), top(int(y))))
        label[y] = x
    groups = lambda of: {frozenset(g) for g in collect(of).values() if len(g) > 1}

    def collect(of):
        out = {}
        for x in root:
            out.setdefault(of(x), set()).add(x)
        return out

    assert groups(find) == groups(top) and groups(find)


@pytest.mark.parametrize("group", [1024, 20])
def test_distributed_links_with_and_without_deeper_routing(spark, group):
    codes = sorted(set(near(random.Random(7), 300, 40, 4) + near(random.Random(8), 300, 1, 4)))
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    scratch = Scratch(spark, "test")
    edges = simhash.fingerprint_edges(spark.createDataFrame([(signed(c),) for c in codes], "fp long"), scratch, group)
    got = {r.vertex: r.root for r in connected_components(edges, scratch).collect()}
    want = components(codes)
    same = lambda roots: {frozenset(c for c in codes if roots(c) == r) for r in {roots(c) for c in codes}}
    assert same(lambda c: got.get(signed(c), signed(c))) == same(want.get)


def test_components_against_brute_force(spark):
    base = words(300, 5)
    rows = awkward() + [(100 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(0, 300, 7)] + [(90, " ".join(base))]
    got = simhash.simhash_components(with_clashes(frame(spark, rows))).collect()
    prints = {t: plain(t) for _, t in rows}
    roots = components(set(prints.values()))
    ids = {}
    for i, t in rows:
        ids.setdefault(roots[prints[t]], []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    want = [(i, f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)


def test_empty_table(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []


def test_long_chain_of_components(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.vertex: r.root for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
