import random

import numpy as np
import pytest
from cases import awkward, frame, with_clashes

from assayflow.llm import latent

ITEM = "item_id long, text string"


def prose(r, n):
    return " ".join(r.choice(("the", "of", "and", "in")) if r.random() < 0.5 else f"word{r.randrange(20_000)}" for _ in range(n))


def tables(seed=1, n=150, items=30):
    r = random.Random(seed)
    bench = [(k, f"{prose(r, r.randrange(10, 40)).capitalize()}. {prose(r, r.randrange(3, 12))}.") for k in range(items)]
    rows, truth = [], {}
    for i in range(n):
        t, hits = prose(r, r.randrange(20, 400)).split(" "), set()
        if i % 3 == 0:
            k = r.randrange(items)
            w = bench[k][1].split(" ")
            if i % 2:  # a paraphrase: some words of the question dropped, one replaced
                cut = next(j for j, x in enumerate(w) if x.endswith(".")) + 1
                question = [x for j, x in enumerate(w[:cut]) if j % 7]
                question[len(question) // 2] = "other"
                w = question + w[cut:]
            at = r.randrange(len(t))
            t[at:at], hits = w, {k}
        rows.append((i, " ".join(t)))
        truth[i] = hits
    return rows, bench, truth


def test_finds_exact_and_paraphrased_items_only(spark):
    rows, bench, truth = tables()
    got = {r.doc_id: set(r.item_ids) for r in latent.decontaminate(frame(spark, rows), spark.createDataFrame(bench, ITEM)).collect()}
    assert got == truth


def space_for(spark, rows, bench, rank):
    space = latent.fit_space(frame(spark, rows).select("text"), spark.createDataFrame(bench, ITEM), rank)
    return space, latent.place_items(space, [(k, t.encode()) for k, t in bench])


def paraphrases(seed=3, topics=25):
    """Items of topics that share words, and documents in which many of an item's words are replaced by others of its topic, amid rare words."""
    r = random.Random(seed)
    bench, rows, truth = [], [], set()
    for t in range(topics):
        pool = [f"topic{t}x{j}" for j in range(40)]
        for _ in range(6):
            bench.append((len(bench), " ".join(r.sample(pool, 24)) + ". " + " ".join(r.sample(pool, 3)) + "."))
    for i in range(240):
        words = [f"rare{i}n{j}" for j in range(r.randrange(60, 120))]
        if i % 2:
            k = r.randrange(len(bench))
            question, answer = bench[k][1].split(". ")
            pool = [f"topic{k // 6}x{j}" for j in range(40)]
            said = [w if r.random() < 0.62 else r.choice(pool) for w in question.split()]
            spread = [x for w in said for x in ([w] if r.random() < 0.5 else [w, f"rare{i}m{len(w)}{r.random()}"])]
            at = r.randrange(len(words))
            words[at:at] = [*spread, *answer.strip(".").split()]
        rows.append((i, " ".join(words)))
    return rows, bench


@pytest.mark.parametrize("rank", [256, 40])
def test_recall_on_paraphrases_against_full_coverage(spark, rank):
    """Truth: whole items and answers against whole documents, without a search."""
    rows, bench = paraphrases()
    space, lot = space_for(spark, rows, bench, rank)
    assert space.vectors.shape[1] <= len(lot.of) // 2
    want = set()
    for i, t in rows:
        (ids,) = space.vocabulary.numbers([t.encode()])
        want |= {(i, k) for k, item in enumerate(lot.words) if latent.coverage(item, ids, space.idf) >= latent.COVERAGE and latent.coverage(lot.answers[k], ids, space.idf) >= latent.COVERAGE}
    assert len(want) > 80 and {i for i, _ in want} <= {i for i, _ in rows if i % 2}
    got = {(r.doc_id, k) for r in latent.decontaminate(frame(spark, rows), spark.createDataFrame(bench, ITEM), rank=rank).collect() for k in r.item_ids}
    assert len(want & got) >= 0.9 * len(want) and got <= want


def test_the_space_finds_candidates_that_the_words_do_not(spark):
    """The same threshold on word-by-word cosines (all dimensions) finds fewer of the pairs above."""
    rows, bench = paraphrases(4)
    space, lot = space_for(spark, rows, bench, 40)
    words = latent.Space(space.vocabulary, space.idf, np.eye(len(space.vocabulary), dtype=np.float32))
    plain = latent.place_items(words, [(k, t.encode()) for k, t in bench])
    texts = [space.vocabulary.numbers([t.encode()])[0] for _, t in rows]
    pairs = [{(i, k) for i, _, k, _ in latent.candidates(s, x, texts)} for s, x in ((space, lot), (words, plain))]
    assert len(pairs[0] - pairs[1]) > 50
    topic = {(i, k) for i, k in pairs[0] if f"topic{k // 6}x" in rows[i][1]}
    assert topic == pairs[0]  # and never an item of a topic that the document hasn't


def test_singular_vectors_against_dense_svd(spark):
    r = np.random.default_rng(2)
    rows = [r.integers(0, 40, 12) for _ in range(25)]
    idf = r.random(40) + 0.5
    a = np.zeros((25, 40))
    for k, ids in enumerate(rows):
        at, x = latent.weighted(ids, idf)
        a[k, at] = x / np.linalg.norm(x)
    table = spark.createDataFrame([(bytearray(x.astype(np.int64).tobytes()),) for x in rows], "numbers binary")
    v = latent.randomised_svd(table.repartition(3), idf, 40, 6, rounds=4)
    exact = np.linalg.svd(a)[2][:6]
    assert np.allclose(np.linalg.svd(exact @ v)[1], 1, atol=1e-2)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)


def test_coverage_is_the_heaviest_common_subsequence():
    r = np.random.default_rng(3)
    for _ in range(30):
        a, b, idf = r.integers(0, 6, 8), r.integers(0, 6, 12), r.random(6)
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + idf[x] * (x == y))
        assert abs(latent.coverage(a, b, idf) - best[-1, -1] / idf[a].sum()) < 1e-12


def test_answers():
    assert latent.answer_of(b"What is it? Answer: forty two") == b"forty two"
    assert latent.answer_of(b"One here. Two there. ...") == b"Two there."
    assert latent.answer_of(b"...") == b"" == latent.answer_of(b"")


def test_awkward_rows_items_and_several_lots(spark, monkeypatch):
    rows, bench, truth = tables(5, 40, 9)
    items = bench + [(None, bench[0][1]), (50, None), (51, ""), (52, "..."), (1, bench[1][1])]
    table = spark.createDataFrame(items, ITEM)
    docs = with_clashes(frame(spark, rows + awkward()))

    def result():
        return sorted(str((r.doc_id, r.contaminated, [x for x in r.item_ids])) for r in latent.decontaminate(docs, table).collect())

    once = result()
    assert len(once) == len(rows + awkward())
    found = {r.doc_id: set(r.item_ids) - {None} for r in latent.decontaminate(docs, table).collect() if r.doc_id is not None and r.doc_id in truth and r.doc_id > 20}
    assert all(found[i] == truth[i] for i in found)
    monkeypatch.setattr(latent, "ITEMS", 4)
    assert result() == once


def test_words_have_one_hash_wherever_they_stand(monkeypatch):
    import re

    texts = ["It's (A) --- b2! «Été» ÉTÉ!! #x1.", "", "  ", "a", "a b a", "x" * 5000 + " end " + "y" * 300, "A" * 40 + " " + "é" * 900, "..."]
    known = {}
    for piece in (1 << 20, 64):
        monkeypatch.setattr(latent, "_PIECE", piece)
        for t, found in zip(texts, latent.word_hashes([t.encode() for t in texts])):
            words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
            assert len(found) == len(words)
            for w, h in zip(words, found.tolist()):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_rows_that_hold_items_go(spark):
    rows, bench, truth = tables(6, 40, 9)
    docs = with_clashes(frame(spark, rows + awkward()))
    kept = latent.drop_leaks(docs, spark.createDataFrame(bench, ITEM))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None, -5} >= {i for i in truth if not truth[i]}
    assert kept.count() == len(rows + awkward()) - sum(bool(x) for x in truth.values())
    assert latent.drop_leaks(docs, spark.createDataFrame([], ITEM)).count() == len(rows + awkward())


def test_empty_tables(spark):
    assert latent.decontaminate(frame(spark, []), spark.createDataFrame([(1, "a b")], ITEM)).collect() == []
    (row,) = latent.decontaminate(frame(spark, [(1, "a b")]), spark.createDataFrame([], ITEM)).collect()
    assert not row.contaminated and row.item_ids == []
