from collections import Counter

import pytest
from cases import awkward, frame, with_clashes, words
from test_substring_dedup import mixed

from assayflow.llm import suffix_dedup
from assayflow.llm.suffix_dedup import repeated_passages


def brute(rows, window):
    texts = [[w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] for _, t in rows]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        spans = []
        for s in range(len(t) - window + 1):
            if seen[tuple(t[s : s + window])] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + window
                else:
                    spans.append([s, s + window])
        out.append(str((i, len(t), sum(b - a for a, b in spans), spans)))
    return sorted(out)


def run(spark, rows, **how):
    return sorted(str((r.doc_id, r.n_words, r.n_repeated, [[s.start, s.stop] for s in r.spans])) for r in repeated_passages(with_clashes(frame(spark, rows)), **how).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = mixed(seed, 120, 50)
    assert run(spark, rows) == brute(rows, 50)


def test_small_windows_against_brute_force(spark):
    rows = mixed(9, 100, 7)
    assert run(spark, rows, window=7, gram=3) == brute(rows, 7)


def test_grams_in_several_parts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 3)
    rows = mixed(10, 100, 7)
    assert run(spark, rows, window=7, gram=3) == brute(rows, 7)


def test_awkward_and_repeated_rows(spark):
    p = " ".join(words(60, 77))
    rows = awkward() + [(70, p), (70, p), (71, "head " + p + " tail"), (72, " ".join(words(60, 78)))]
    assert run(spark, rows) == brute(rows, 50)


def test_empty_table(spark):
    assert repeated_passages(frame(spark, [])).collect() == []
