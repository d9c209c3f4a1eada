import itertools
import math
import zlib
from collections import Counter

import numpy as np
from cases import awkward, frame, with_clashes, words

from assayflow.llm import hmm_lm
from assayflow.llm.common import LOWER


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [b""]


def random_model(states, classes, seed):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm_lm.HMM(norm(r.random((1, states))), norm(r.random((states, states))), norm(r.random((states, classes))))


def paths(model, seq):
    """Probability of each state path."""
    for p in itertools.product(range(len(model.emit)), repeat=len(seq)):
        x = model.start[0][p[0]] * model.emit[p[0], seq[0]]
        for a, b, o in zip(p, p[1:], seq[1:]):
            x *= model.move[a, b] * model.emit[b, o]
        yield p, x


def test_likelihood_is_the_sum_over_paths():
    model, seqs = random_model(3, 5, 1), [[0, 1, 2, 4], [3], [1, 1], [4, 3, 2, 1, 0, 0]]
    flat, lengths = np.concatenate([np.array(s) for s in seqs]), np.array([len(s) for s in seqs])
    got = hmm_lm.log10_likelihood(model, flat, np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    assert np.allclose(got, [math.log10(sum(x for _, x in paths(model, s))) for s in seqs])


def test_probabilities_of_all_sequences_sum_to_one():
    model = random_model(2, 3, 2)
    seqs = np.array(list(itertools.product(range(3), repeat=4)))
    got = hmm_lm.log10_likelihood(model, seqs.ravel(), np.arange(len(seqs)) * 4, np.full(len(seqs), 4))
    assert abs((10**got).sum() - 1) < 1e-9


def test_expected_counts_are_those_over_paths():
    model, seqs = random_model(2, 4, 3), [[0, 1, 2], [3, 3, 1, 0], [2]]
    start, move, emit, likely = np.zeros((1, 2)), np.zeros((2, 2)), np.zeros((2, 4)), 0
    for s in seqs:
        total = sum(x for _, x in paths(model, s))
        likely += math.log(total)
        for p, x in paths(model, s):
            start[0][p[0]] += x / total
            for a, b in zip(p, p[1:]):
                move[a, b] += x / total
            for a, o in zip(p, s):
                emit[a, o] += x / total
    lengths = np.array([len(s) for s in seqs])
    for piece in (1, 2, 100):  # cuts change nothing
        got = hmm_lm.expected_counts(model, np.concatenate([np.array(s) for s in seqs]), np.r_[0, np.cumsum(lengths)[:-1]], lengths, piece)
        for a, b in zip((*hmm_lm.split_counts(got, 2), got[-2:]), (start, move, emit, (likely, lengths.sum()))):
            assert np.allclose(a, b, rtol=1e-4)


def test_long_texts_count_as_uncut():
    r, model = np.random.default_rng(4), random_model(4, 30, 5)
    lengths = np.array([2000, 3, 700, 1])
    flat, starts = r.integers(0, 30, lengths.sum()), np.r_[0, np.cumsum(lengths)[:-1]]
    whole = hmm_lm.expected_counts(model, flat, starts, lengths)
    assert np.allclose(hmm_lm.expected_counts(model, flat, starts, lengths, 128), whole, rtol=1e-3, atol=1e-3)
    assert np.allclose(whole[-2] / math.log(10), hmm_lm.log10_likelihood(model, flat, starts, lengths).sum(), rtol=1e-5)


def corpus():
    rows = awkward()
    for i in range(120):  # two languages that share no words
        rows.append((100 + i, " ".join(("A" if i % 2 else "b") + w for w in words(150, i, 60))))
    return rows


def test_counts_and_base_against_brute_force(spark):
    rows = corpus()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((str(i), out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    docs = with_clashes(frame(spark, rows))
    got = hmm_lm.hmm_scores(docs, hmm_lm.contract_held_out(), rounds=2, states=3, block=2_000).collect()
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in mine] == [x[:5] for x in sorted(want)]
    assert np.allclose([x[5] for x in mine], [x[5] for x in sorted(want)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_states_beat_the_unigram_on_held_out_documents(spark):
    docs = frame(spark, corpus())
    got = [r for r in hmm_lm.hmm_scores(docs, hmm_lm.contract_held_out(), rounds=6, states=4).collect() if r.held_out and r.doc_id >= 100]
    assert len(got) > 5
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_blocks_do_not_change_results(spark):
    docs = frame(spark, corpus()).repartition(5)
    a, b = ({(r.doc_id, r.n_tokens, round(r.score, 3), round(r.base_score, 6)) for r in hmm_lm.hmm_scores(docs, hmm_lm.contract_held_out(), rounds=1, block=n).collect()} for n in (500, 10**6))
    assert a == b


def test_empty_table_and_no_training_rows(spark):
    from pyspark.sql import functions as F

    assert hmm_lm.hmm_scores(frame(spark, []), hmm_lm.contract_held_out()).collect() == []
    (row,) = hmm_lm.hmm_scores(frame(spark, [(1, "a b")]), F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
