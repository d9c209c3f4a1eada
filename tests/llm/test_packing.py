import itertools
import random

import numpy as np
import pytest
from cases import awkward, frame, with_clashes, words

from assayflow.llm.packing import optimal_boundaries, pack, token_lengths


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(8))
def test_bounds_against_all_choices(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), 9))
    counts = [r.randrange(1, 20) for _ in lengths]
    for k in (1, 2, 3, 5, 20):
        best = min(padding(lengths, counts, c + (lengths[-1],)) for n in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], n))
        bounds = optimal_boundaries(np.array(lengths), np.array(counts), k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert padding(lengths, counts, bounds) == best


def test_bounds_of_many_lengths_are_quick():
    n = 20_000
    assert len(optimal_boundaries(np.arange(1, n + 1), np.ones(n, int), 16)) == 16


def check(rows, got, budget):
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, number), own in batches.items():
        room = max(1, budget // own[0].bucket_length)
        assert sorted(r.position for r in own) == list(range(len(own))) and len(own) <= room
        assert len({r.bucket_length for r in own}) == 1
        last = max(b for k, b in batches if k == bucket)
        assert len(own) == room or number == last
        assert number <= last and {b for k, b in batches if k == bucket} == set(range(last + 1))


def test_batches(spark):
    r = random.Random(1)
    rows = [(i, " ".join(words(r.randrange(1, 300), i))) for i in range(500)] + awkward()
    for shard in (7, 2000):
        got = pack(with_clashes(frame(spark, rows).repartition(5)), budget=1000, buckets=6, shard=shard).collect()
        check(rows, got, 1000)
        n = [len((t or "").encode().split()) for _, t in rows]
        assert sorted(r.n_tokens for r in got) == sorted(n)
        bounds = {r.bucket_length for r in got}
        counts = np.unique([max(1, x) for x in n], return_counts=True)
        assert sum(max(1, r.n_tokens) for r in got) + padding(*counts, bounds) == sum(r.bucket_length for r in got)


def test_tokenizer_lengths(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no tokenizer files here")
    t = Tokenizer.from_file(str(path))
    rows = [(1, "some words here"), (2, None), (3, "ä ö 漢字")]
    got = {r.doc_id: r.n_tokens for r in token_lengths(frame(spark, rows), str(path)).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}


def test_empty_table(spark):
    assert pack(frame(spark, [])).collect() == []
