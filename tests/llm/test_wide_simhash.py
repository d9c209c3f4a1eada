"""The near-copies stage searches by SimHash: wide fingerprints, routed block patterns, trees in Gray order, star contraction."""

import random

import numpy as np
import pytest
from cases import frame, words
from test_near import edited, groups, planted

from assayflow.llm import simhash
from assayflow.llm.common import Scratch
from assayflow.llm.components import connected_components


def test_links_come_through_the_index_alone(spark, monkeypatch):
    texts = planted(2)[:60]
    docs = frame(spark, list(enumerate(texts)))
    kept = lambda: {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert kept() == set(groups(texts)[0]) != set(range(len(texts)))
    monkeypatch.setattr(simhash, "wide_edges", lambda *_: spark.createDataFrame([], "a long, b long"))
    assert len(kept()) == len(set(texts))


def test_blocks_and_trees_connect_every_similar_pair(spark):
    short = [" ".join(f"s{k}x{i}" for i in range(n)) for k in range(100) for n in (8, 9)]  # four shingles, and a fifth
    texts = planted(3) + short
    _, pairs = groups(texts)
    width, blocks = simhash.block_plan(len(texts), 0.8)
    prints = simhash._wide_prints(frame(spark, list(enumerate(texts))), "text", "doc_id", 5, max(simhash.CARRIED, -(-width * blocks // 64))).select("k1", "fp", "code")
    fp = {r.k1: r.fp for r in prints.collect()}
    scratch = Scratch(spark, "test")
    roots = {r.vertex: r.root for r in connected_components(simhash.wide_edges(prints, scratch, width, blocks, 0.8), scratch).collect()}
    near = [(i, j) for (i, j), s in pairs.items() if s >= 0.8]
    assert len(near) > 150 and all(roots.get(fp[i], fp[i]) == roots.get(fp[j], fp[j]) for i, j in near)
    far = [(i, j) for (i, j), s in pairs.items() if s == 0]
    assert all(roots.get(fp[i], fp[i]) != roots.get(fp[j], fp[j]) for i, j in far)


@pytest.mark.parametrize("share", [0.02, 0.15, 0.24])
def test_forest_connects_what_all_pairs_do(share):
    r = np.random.default_rng(7)
    noise = lambda n: np.packbits(r.random((n, 256)) < share, axis=1).view(np.uint64)
    codes = np.concatenate([r.integers(0, 1 << 64, (150, 4), np.uint64)] + [r.integers(0, 1 << 64, (1, 4), np.uint64) ^ noise(n) for n in (200, 60, 5, 2)])
    codes = codes[r.permutation(len(codes))]
    keys = np.sort(r.integers(0, 3, len(codes)))
    want = np.arange(len(codes))
    for i in range(len(codes)):
        one, all_ = (np.bitwise_count(codes[i, :k] ^ codes[:, :k]).sum(1) for k in (1, 4))
        for j in np.flatnonzero((keys == keys[i]) & (one <= 64) & (all_ <= 77)):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    moved, to = simhash.wide_forest(keys, codes, 64, 77)
    got = np.arange(len(codes))
    got[moved] = to
    assert (got == want).all() and (want != np.arange(len(codes))).any()


def test_fingerprint_by_definition_and_share_of_differing_bits():
    r = np.random.default_rng(1)
    grams = r.integers(0, 1 << 64, 600, np.uint64)
    low, mask = [], (1 << 64) - 1
    for x in map(int, grams):
        x = x * (int(simhash._SPREAD) | 1) & mask
        x = (x ^ x >> 32) * int(simhash._STIR) & mask
        low.append(x ^ x >> 32)
    assert int(simhash.wide_fingerprint(grams, 2)[0]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in low) > len(low))
    for n, other, common in ((4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (90, 90, 80), (300, 240, 240)):  # similarities of 0.8 or more
        shares = []
        for _ in range(40):
            x = r.integers(0, 1 << 64, n + other - common, np.uint64)
            shares.append(np.bitwise_count(simhash.wide_fingerprint(x[:n], 32) ^ simhash.wide_fingerprint(x[n - common :], 32)).sum() / 2048)
        assert np.mean(shares) < simhash.differing_share(0.8)


def test_edges_of_a_large_group_grow_with_its_rows_not_with_its_blocks(spark):
    r = random.Random(11)
    base = words(300, 5, 5000)
    texts = [" ".join(edited(r, base, r.randrange(1, 8))) for _ in range(600)]
    width, blocks = 8, 60
    prints = simhash._wide_prints(frame(spark, list(enumerate(texts))), "text", "doc_id", 5, -(-width * blocks // 64)).select("fp", "code")
    scratch = Scratch(spark, "test")
    edges = simhash.wide_edges(prints, scratch, width, blocks, 0.8)
    assert edges.count() < 3 * len(texts)
    assert len({r.root for r in connected_components(edges, scratch).collect()}) == 1
