import random
import re

import pytest
from cases import awkward, frame, with_clashes, words

import corpus_pipeline
from assayflow.llm.exact_dedup import drop_exact_copies, exact_dedup
from assayflow.llm.simhash import drop_near_copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, copies, near copies, leaks, poor and toxic ones."""
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(("the", "of", "and")) if r.random() < 0.4 else f"word{r.randrange(9000)}" for _ in range(n))
    items = [(k, text(30) + ".") for k in range(12)]
    rows, kinds, labels = [], {}, []

    def add(kind, t):
        i = len(rows)
        rows.append((i, t))
        kinds[i] = kind
        if r.random() < 0.5:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
        return i

    for _ in range(500):
        add("clean", text(r.randrange(80, 300)))
    for _ in range(80):
        add("poor", " ".join(w.upper() + "!!" for w in text(100).split()))
    for _ in range(80):
        w = text(120).split()
        for _ in range(4):
            w[r.randrange(len(w))] = r.choice(("nasty", "vile"))
        add("toxic", " ".join(w))
    for i in range(40):
        add("copy", rows[i][1].replace(" ", "  ", 1)[:-1] + rows[i][1][-1])  # stays, being longer; its original goes
        kinds[i] = "copied"
        w = rows[100 + i][1].split()
        w[len(w) // 2] = "changed"
        add("near", " ".join(w))
        t = text(100).split()
        t[50:50] = items[i % 12][1].split()
        add("leak", " ".join(t))
    out = tmp_path_factory.mktemp("pipeline")
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), kinds


def least_of_groups(rows, least=0.8):
    """The smallest id of each group of rows linked by five-word Jaccard similarities, all pairs compared."""
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, holders, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    shared = {}
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[j, i] = shared.get((j, i), 0) + 1
    for (i, j), n in shared.items():
        if not sets[i] and not sets[j] or n >= least * (len(sets[i]) + len(sets[j]) - n):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min((x for x in g if x is not None), default=None) for g in groups.values()]


def test_stages_take_effect(spark, folder):
    out, kinds = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, out).collect()}
    share = lambda kind: sum(i in got for i in kinds if kinds[i] == kind) / sum(k == kind for k in kinds.values())
    assert share("poor") < 0.05 and share("toxic") < 0.05 and share("leak") == 0 and share("copied") == 0
    assert share("clean") > 0.97 and share("copy") > 0.97


def test_each_stage_against_its_operator(spark, folder):
    out, _ = folder
    docs = with_clashes(spark.read.parquet(f"{out}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, out)
        assert kept.columns == docs.columns, name
        ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if name == "exact_dedup":
            assert ids == sorted(r.doc_id for r in exact_dedup(docs).filter("kept").collect())
        if name == "simhash_near_dedup":
            assert ids == sorted(least_of_groups([(r.doc_id, r.text) for r in docs.collect()]))


def test_awkward_rows(spark):
    docs = with_clashes(frame(spark, awkward()))
    exact = [(r.doc_id, r.text) for r in drop_exact_copies(docs).collect()]
    assert len(exact) == sum(r.kept for r in exact_dedup(docs).collect()) == len(set(exact))
    near = [(r.doc_id, r.text) for r in drop_near_copies(docs).collect()]
    assert sorted(i for i, _ in near if i is not None) == sorted(i for i in least_of_groups(awkward()) if i is not None)
    assert len(near) == len(least_of_groups(awkward()))
    twice = frame(spark, [(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "x"), (None, "x")])
    assert sorted(str(r.text) for r in drop_exact_copies(twice).collect()) == ["a b c", "other words here", "x"]
    assert sorted(str(r.text) for r in drop_near_copies(twice).collect()) == ["a b c", "other words here", "x"]


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
