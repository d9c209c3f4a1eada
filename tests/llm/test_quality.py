import random
import zlib

import numpy as np
from cases import awkward, frame, with_clashes

from assayflow.llm import quality
from assayflow.llm.quality import quality_classifier

LABELS = "doc_id long, quality int, toxic int"
FILL = [f"word{i}" for i in range(300)]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        w = [r.choice(FILL) for _ in range(r.randrange(30, 200))]
        toxic, junk = r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(("nasty", "vile", "awful"))
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        truth[i] = (int(not junk), int(toxic))
        if i % 2:
            labels.append((i, *truth[i]))
    return rows, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus()
    got = {r.doc_id: r for r in quality_classifier(with_clashes(frame(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()}
    rest = [i for i in truth if i % 2 == 0]
    toxic = [i for i in rest if truth[i][1]]
    clean = [i for i in rest if truth[i] == (1, 0)]
    assert np.mean([not got[i].keep for i in toxic]) > 0.95
    assert np.mean([got[i].keep for i in clean]) > 0.97
    assert np.mean([(got[i].p_quality >= 0.5) == truth[i][0] for i in rest]) > 0.95


def fitted(rows, y, dim, unknown):
    """A view's model on rows that are all in one list."""
    share = float(np.clip(np.mean(y), 1e-3, 1 - 1e-3)) if y else unknown
    prior, y = float(np.log(share / (1 - share))), np.array(y)
    weights = np.zeros(dim)
    if not 0 < y.sum() < len(y):
        return quality.Linear(weights, prior)
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pos, total = np.bincount(flat, weights=y[of], minlength=dim), np.bincount(flat, minlength=dim)
    ratio = quality.log_ratios(pos, total - pos, y.sum(), len(y) - y.sum())
    used = np.flatnonzero(ratio)
    place = np.full(dim, -1)
    place[used] = np.arange(len(used))
    kept = place[flat] >= 0
    x = quality.descend(place[flat[kept]], of[kept], y, ratio[used], np.r_[np.zeros(len(used)), prior])
    weights[used] = ratio[used] * x[:-1]
    return quality.Linear(weights, float(x[-1]))


def plain(rows, labels, taught, rounds):
    """The models by the same rule, without Spark: every unlabelled row is in one list."""
    buckets, marks = quality._Buckets(), {}
    for i, *y in labels:
        marks[i] = y
    text = {i: quality.text_features((t or "").encode(), buckets) for i, t in rows}
    meta = {i: quality.meta_features((t or "").encode(), "en", "src0") for i, t in rows}
    free, out = sorted(i for i in text if i not in marks), {}
    for c, (question, unknown) in enumerate(quality.QUESTIONS.items()):
        known = [i for i in sorted(text) if i in marks]
        check, train = ([known[j] for j in part] for part in quality.split(len(known)))
        t = quality.CoTraining(np.array([marks[i][c] for i in check]), np.mean([marks[i][c] for i in train]))
        views = [([v[i] for i in train], [float(marks[i][c]) for i in train]) for v in (text, meta)]
        seen = set()
        for n in range(rounds + 1):
            models = [fitted(x, y, dim, unknown) for (x, y), dim in zip(views, (quality.TEXT_DIM, quality.META_DIM))]
            t.calibrate(models, tuple(m.logits(*quality._flat([v[i] for i in check])) for m, v in zip(models, (text, meta))))
            if n == rounds:
                break
            for k, own in enumerate((text, meta)):
                z, picks = dict(zip(free, t.logits(k, *quality._flat([own[i] for i in free])))), []
                for sign in (1, -1):
                    sure = sorted((i for i in free if sign * z[i] >= t.least(sign)), key=lambda i: (-sign * z[i], i))[: t.quota(sign, taught * (n + 1))]
                    picks += [i for i in sure if (k, i) not in seen]
                views[1 - k] = (views[1 - k][0] + [(meta, text)[k][i] for i in picks], views[1 - k][1] + [1 / (1 + np.exp(-z[i])) for i in picks])
                t.taught[1 - k] += len(picks)
                seen |= {(k, i) for i in picks}
        out[question] = t.model()
    return out, text, meta


def test_models_against_a_plain_version(spark):
    rows, labels, truth = corpus(500, 3)
    labels = [x for x in labels if x[0] % 3]
    models, text, meta = plain(rows, labels, 60, 3)
    found = quality.fit_quality(frame(spark, rows).repartition(5), spark.createDataFrame(labels, LABELS), taught=60)
    ids = sorted(text)
    for q in quality.QUESTIONS:
        assert found[q].taught == models[q].taught and min(found["quality"].taught) > 20
        a, b = (m.probabilities(m.text.logits(*quality._flat([text[i] for i in ids])), m.meta.logits(*quality._flat([meta[i] for i in ids])))[2] for m in (found[q], models[q]))
        assert np.allclose(a, b, atol=1e-3)


def test_each_view_teaches_the_other(spark):
    """In a source that no label comes from, only the words of the labelled ones tell the class: the metadata view learns it from text. The other way round, new words are learnt from sources."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.4
        where, words_ = ("old", "own") if i < 300 else ("new", "own") if i < 600 else ("old", "other")
        w = [r.choice(FILL) for _ in range(40)] + ([f"bad{words_}"] * 2 if bad else [f"good{words_}"] * 2)
        r.shuffle(w)
        rows.append((i, " ".join(w), "en", f"{where}{int(bad)}", 0))
        if i < 300:
            labels.append((i, int(not bad), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, LABELS)
    alone, together = (quality.fit_quality(docs, labels, taught=300, rounds=n)["quality"] for n in (0, 3))
    crc = lambda x, dim: zlib.crc32(x) % dim
    for view, facts, dim in (("text", (b"badother", b"goodother"), quality.TEXT_DIM), ("meta", (b"source=new1", b"source=new0"), quality.META_DIM)):
        bad, good = ([getattr(m, view).weights[crc(f, dim)] for f in facts] for m in (alone, together))
        assert bad == [0, 0] and good[0] < -0.5 < 0.5 < good[1], view
    assert min(together.taught) > 200


def test_awkward_rows_and_labels(spark):
    rows, labels, _ = corpus(200)
    odd = [(None, 1, 0), (1, None, None), (3, 1, None), (5, 0, 1), (5, 1, 0), (99999, 1, 1)]
    got = quality_classifier(with_clashes(frame(spark, rows + awkward())), spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(got) == len(rows + awkward())
    assert all(0 <= p <= 1 for r in got for p in (r.p_text, r.p_meta, r.p_quality, r.p_toxic))


def test_without_labels_and_without_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep for r in quality_classifier(frame(spark, awkward()), none).collect())
    assert quality_classifier(frame(spark, []), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_sample_is_bounded(spark):
    rows, labels, _ = corpus(300)
    a = quality.fit_quality(frame(spark, rows), spark.createDataFrame(labels, LABELS), labelled=40, taught=10)
    assert set(a) == {"quality", "toxic"}
