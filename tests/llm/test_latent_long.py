import random

import pytest
from cases import frame
from test_latent import ITEM, prose, space_for

from assayflow.llm import latent


def kept(r, text, share):
    question, answer = text.split(". ")
    return " ".join(w for w in question.split(" ") if r.random() < share) + ". " + answer


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_long_items_against_full_coverage(spark, share):
    r = random.Random(11)
    bench = [(k, f"{prose(r, n)}. {prose(r, 8)}.") for k, n in enumerate((20, 500, 800, 1200, 2000))]
    rows, want = [], set()
    for i in range(20):
        words = prose(r, r.randrange(50, 600)).split(" ")
        if i % 2:
            at = r.randrange(len(words))
            words[at:at] = kept(r, bench[i // 2 % 5][1], share).split(" ")
        rows.append((i, " ".join(words)))
    space, lot = space_for(spark, rows, bench, latent.RANK)
    for i, t in rows:  # whole items and answers against whole documents, without a search
        (ids,) = space.vocabulary.numbers([t.encode()])
        for k, item in enumerate(lot.words):
            if latent.coverage(item, ids, space.idf) >= latent.COVERAGE and latent.coverage(lot.answers[k], ids, space.idf) >= latent.COVERAGE:
                want.add((i, k))
    assert {(i, i // 2 % 5) for i in range(1, 20, 2)} <= want
    got = {(d.doc_id, k) for d in latent.decontaminate(frame(spark, rows), spark.createDataFrame(bench, ITEM)).collect() for k in d.item_ids}
    assert got == want
    assert {d.doc_id for d in latent.drop_leaks(frame(spark, rows), spark.createDataFrame(bench, ITEM)).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_lots_are_bounded_by_passages(spark, monkeypatch):
    r = random.Random(12)
    table = spark.createDataFrame([(k, prose(r, 400)) for k in range(6)], ITEM)
    monkeypatch.setattr(latent, "PASSAGES", 100)
    assert [len(x) for x in latent._lots(table)] == [2, 2, 2]
