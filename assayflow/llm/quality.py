"""Document quality and toxicity by co-training a text view and a page-metadata view."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.common import LOWER, Scratch, sum_vectors

TEXT_DIM, META_DIM = 1 << 18, 1 << 12
#: When a view is sure of a row: the probability, and the odds over those of the class at large.
SURE, GAIN = 0.95, 5.0
#: Labelled rows that the fit takes at most, and rows that a view passes to the other in a round at most.
LABELLED, TAUGHT, ROUNDS = 16000, 2000, 3
QUESTIONS = {"quality": 0.9, "toxic": 0.1}
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")
_UPPER, _DIGIT, _SPACE, _LINE, _OTHER = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", bytes(c for c in range(33, 127) if not chr(c).isalnum())))


class _Buckets(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[token] = bucket = zlib.crc32(token) % TEXT_DIM
        return bucket


def text_features(text: bytes, buckets: _Buckets) -> np.ndarray:
    """Which hashed tokens (runs of letters, runs of signs) the whole text holds."""
    tokens = _TOKEN.findall(text.translate(LOWER))
    return np.unique(np.fromiter(map(buckets.__getitem__, tokens), np.int32, len(tokens)))


def meta_features(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of the page besides its words: language, source, size, and the shape of its layout, in steps."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, lines = len(text), int(counts[_LINE].sum()) + 1
    share = lambda of: int(20 * np.sqrt(counts[of].sum() / max(1, size)))
    facts = (f"lang={lang}", f"source={source}", f"size={size.bit_length()}", f"lines={lines.bit_length()}", f"line={(size // lines).bit_length()}", f"upper={share(_UPPER)}", f"digit={share(_DIGIT)}", f"sign={share(_OTHER)}", f"space={share(_SPACE)}")
    return np.unique(np.array([zlib.crc32(f.encode()) % META_DIM for f in facts], np.int32))


# ---------------------------------------------------------------- models
def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _evidence(pos: np.ndarray, neg: np.ndarray, all_pos: float, all_neg: float) -> np.ndarray:
    """G squared of each feature's presence against the class."""
    total, total_all = pos + neg, all_pos + all_neg
    out = np.zeros(len(pos))
    for seen, row, column in ((pos, total, all_pos), (neg, total, all_neg), (all_pos - pos, total_all - total, all_pos), (all_neg - neg, total_all - total, all_neg)):
        out += 2 * seen * np.log(np.maximum(seen, 1e-300) / np.maximum(row * column / total_all, 1e-300))
    return out


@dataclass
class Linear:
    """Logit = bias + the sum of the weights of the features present."""

    weights: np.ndarray
    bias: float

    def logits(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        out, some = np.full(len(cuts) - 1, self.bias), cuts[1:] > cuts[:-1]
        if some.any():  # row by row, so that rows with the same features have the same logit wherever they stand
            out[some] += np.add.reduceat(self.weights[flat], cuts[:-1][some])
        return out


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log-count ratios of the features that the labels speak for, zero for all others.

    A feature takes part if its likelihood ratio (G squared) exceeds twice the logarithm of the number of
    features: chance alone would hardly lift any of so many above it.
    """
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    ratio[_evidence(pos, neg, n_pos, n_neg) <= 2 * np.log(np.count_nonzero(pos + neg) + 2)] = 0
    return ratio


def descend(at: np.ndarray, of: np.ndarray, y: np.ndarray, ratio: np.ndarray, start: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression on some rows by Adam: multipliers of ``ratio``, then the bias, from ``start`` on.

    ``at``: which of the features that take part each row (``of``) holds.
    """
    n, size = len(y), len(ratio)
    u, bias = start[:-1], start[-1]
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(of, weights=(ratio * u)[at], minlength=n)
        error = (_sigmoid(z) - y) / n
        g = np.r_[np.bincount(at, weights=error[of], minlength=size) * ratio + l2 * u / n, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        u, bias = u - move[:-1], bias - move[-1]
    return np.r_[u, bias]


def _ridge_logistic(x: np.ndarray, y: np.ndarray, intercept: float = 0.0, l2: float = 1.0) -> np.ndarray:
    """Coefficients, intercept last, by damped Newton steps; drawn to ones and the given intercept."""
    x = np.c_[np.clip(x, -30, 30), np.ones(len(x))]
    aim = np.r_[np.ones(x.shape[1] - 1), intercept]

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + l2 / 2 * ((w - aim) ** 2).sum()

    w = aim.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * (w - aim))
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    """Two views of one question, each calibrated, and how their logits combine."""

    text: Linear
    meta: Linear
    scale: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray
    taught: tuple[int, int] = (0, 0)  # pseudo-labels that the text view and the metadata view were given

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (s[0] * z + s[1] for s, z in zip(self.scale, (text, meta)))
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


class CoTraining:
    """One question in training. ``y``: 0 or 1 of the rows that calibrate; ``share``: of those that train, 1 in so many.

    In each round both views are fitted on their own labels and calibrated, and each passes rows that it is sure of to
    the other, with the probability that it gives them. Sure means a probability of ``SURE`` or more, and odds at least
    ``GAIN`` times those of the class at large: a view that knows nothing, but whose class is frequent, teaches nothing.
    """

    def __init__(self, y: np.ndarray, share: float):
        self.y, self.share = y.astype(float), share
        self.learns = 0 < self.y.sum() < len(y) and 0 < share < 1
        self.models: list[Linear] = []
        self.taught = [0, 0]  # rows that each view was given by the other

    def calibrate(self, models: list[Linear], z: tuple[np.ndarray, np.ndarray]) -> None:
        """Take both views' models and how they are calibrated and combined, from their logits on the rows that calibrate."""
        self.models = models
        flat = np.array([1.0, 0.0])
        self.scale = tuple(_ridge_logistic(x[:, None], self.y) if self.learns else flat for x in z)
        self.mix = np.array([1.0, 0.0, 0.0])
        if self.learns:  # views that are independent given the class add up, less the prior that both hold
            odds = self.y.mean() / (1 - self.y.mean())
            self.mix = _ridge_logistic(np.c_[tuple(s[0] * x + s[1] for s, x in zip(self.scale, z))], self.y, -float(np.log(odds)))

    def logits(self, view: int, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Calibrated logits, rounded, so that the order of sums over tasks doesn't choose between rows that are as sure."""
        return np.round(self.scale[view][0] * self.models[view].logits(flat, cuts) + self.scale[view][1], 6)

    def least(self, sign: int) -> float:
        """The calibrated logit for a class from which a view is sure."""
        part = self.share if sign > 0 else 1 - self.share
        return max(np.log(SURE / (1 - SURE)), np.log(GAIN) + np.log(part / (1 - part)))

    def quota(self, sign: int, taught: int) -> int:
        """How many rows of a class a view passes in a round at most: in the classes' proportion."""
        return int(np.ceil(taught * (self.share if sign > 0 else 1 - self.share)))

    def model(self) -> CoTrained:
        return CoTrained(*self.models, self.scale, self.mix, tuple(self.taught))


def split(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Which of n labelled rows, in order of their ids, calibrate (a quarter) and which train."""
    order = np.random.default_rng(seed).permutation(n)
    return order[: n // 4], order[n // 4 :]


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.r_[0, np.cumsum([len(r) for r in rows])].astype(int)


# ---------------------------------------------------------------- tables
_FEATURES = "doc_id long, text binary, meta binary"


def _features(docs: DataFrame) -> DataFrame:
    """Both views' features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            text, meta = [], []
            for value, lang, source in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = value.as_py() or b""
                text.append(text_features(t, buckets).tobytes())
                meta.append(meta_features(t, lang, source).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "text", "meta"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, _FEATURES).withColumn("uid", F.monotonically_increasing_id())


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of a batch's rows in each view, and where each row's begin."""
    for name in ("text", "meta"):
        rows = batch.column(batch.schema.get_field_index(name)).to_pylist()
        yield np.frombuffer(b"".join(rows), np.int32), np.r_[0, np.cumsum([len(r) // 4 for r in rows])].astype(int)


def _logits(features: DataFrame, training: dict[str, CoTraining]) -> DataFrame:
    """``uid, doc_id`` and for each question and view the calibrated logit: ``quality_0, quality_1, toxic_0, toxic_1``."""
    names = [f"{q}_{k}" for q in training for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = list(_columns(batch))
            z = [t.logits(k, *views[k]) for t in training.values() for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), *map(pa.array, z)], ["uid", "doc_id", *names])

    return features.select("doc_id", "text", "meta", "uid").mapInArrow(run, "uid long, doc_id long, " + ", ".join(f"{n} double" for n in names))


def _surest(logits: DataFrame, training: dict[str, CoTraining], taught: int) -> DataFrame | None:
    """``question, view, sign, uid, z`` of the rows that each view is surest of, within its quota.

    A histogram of all rows' logits tells from where on they are few enough to be sorted.
    """
    names = [(q, k) for q, t in training.items() if t.learns for k in (0, 1)]
    if not names:
        return None
    bins = F.explode(F.array(*(F.struct(F.lit(f"{q}_{k}").alias("name"), F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), f"{q}_{k}")) * 8).alias("bin")) for q, k in names))).alias("b")
    counts: dict[str, dict[int, int]] = {}
    for r in logits.select(bins).groupBy("b.name", "b.bin").count().collect():
        counts.setdefault(r["name"], {})[r["bin"]] = r["count"]
    parts = []
    for q, k in names:
        for sign in (1, -1):
            quota, least, n = training[q].quota(sign, taught), training[q].least(sign), 0
            for b in sorted(counts.get(f"{q}_{k}", {}), key=lambda b: -sign * b):
                n += counts[f"{q}_{k}"][b]
                if n >= quota:  # the bin's nearer edge
                    least = max(least, sign * (b if sign > 0 else b + 1) / 8)
                    break
            z = F.col(f"{q}_{k}")
            sure = logits.filter(z * sign >= least).orderBy(F.desc(z * sign), "doc_id", "uid").limit(quota)
            parts.append(sure.select(F.lit(q).alias("question"), F.lit(k).alias("view"), F.lit(sign).alias("sign"), "uid", z.alias("z")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_DIMS = (TEXT_DIM, META_DIM)


def _aims(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """``uid, slot, y, features`` of training rows: slot 2q + k is view k of question q."""
    for batch in batches:
        for uid, text, meta, aims in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("uid", "text", "meta", "aims"))):
            views = [np.frombuffer(x, np.int32) for x in (text, meta)]
            for aim in aims:
                yield uid, aim["slot"], aim["y"], views[aim["slot"] % 2]


def _ratios(train: DataFrame, unknown: list[float]) -> list[tuple[np.ndarray, float, bool]]:
    """For each slot the log-count ratios, the prior logit, and whether there is anything to learn: from sums over tasks."""
    slots = 2 * len(unknown)
    starts = np.r_[0, np.cumsum([2 * _DIMS[s % 2] + 2 for s in range(slots)])]

    def count(batches):
        out = np.zeros(starts[-1])
        for _, slot, y, features in _aims(batches):
            at, dim = starts[slot], _DIMS[slot % 2]
            out[at + features] += y
            out[at + dim + features] += 1
            out[at + 2 * dim] += y
            out[at + 2 * dim + 1] += 1
        return out

    total, out = sum_vectors(train, count), []
    total = np.zeros(starts[-1]) if total is None else total
    for slot in range(slots):
        dim, part = _DIMS[slot % 2], total[starts[slot] : starts[slot + 1]]
        y, n = part[-2], part[-1]
        share = float(np.clip(y / n, 1e-3, 1 - 1e-3)) if n else unknown[slot // 2]
        learns = bool(1e-9 < y < n - 1e-9)
        ratio = log_ratios(part[:dim], part[dim : 2 * dim] - part[:dim], y, n - y) if learns else np.zeros(dim)
        out.append((ratio, float(np.log(share / (1 - share))), learns))
    return out


def _models(train: DataFrame, unknown: list[float]) -> list[Linear]:
    """Each slot's model, fitted in a task of its own to the features that take part of the training rows.

    These are some thousand at most of each row, and rows as many as the parameters bound.
    """
    ratios = _ratios(train, unknown)
    used = [np.flatnonzero(r) for r, _, _ in ratios]
    weights = [r[u] for (r, _, _), u in zip(ratios, used)]
    learns, priors = [l for _, _, l in ratios], [p for _, p, _ in ratios]

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [np.full(dim, -1, np.int32) for dim in _DIMS * (len(used) // 2)]
        for place, u in zip(places, used):
            place[u] = np.arange(len(u))
        for batch in batches:
            rows = [(uid, slot, y, p[p >= 0].tobytes()) for uid, slot, y, features in _aims([batch]) if learns[slot] for p in [places[slot][features]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.binary()))], ["uid", "slot", "y", "at"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending"), ("y", "ascending")])  # whatever order they came in
        slot = table.column("slot")[0].as_py()
        rows = table.column("at").to_pylist()
        at, of = np.frombuffer(b"".join(rows), np.int32), np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])
        found = descend(at, of, table.column("y").to_numpy(), weights[slot], np.r_[np.zeros(len(used[slot])), priors[slot]])
        return pa.table({"slot": pa.array([slot], pa.int32()), "found": pa.array([found.tobytes()], pa.binary())})

    rows = train.mapInArrow(restrict, "uid long, slot int, y double, at binary")
    got = {r.slot: np.frombuffer(r.found) for r in rows.groupBy("slot").applyInArrow(fit, "slot int, found binary").collect()} if any(learns) else {}
    out = []
    for slot, (u, w, dim) in enumerate(zip(used, weights, _DIMS * (len(used) // 2))):
        whole, bias = np.zeros(dim), priors[slot]
        if slot in got:
            whole[u], bias = w * got[slot][:-1], float(got[slot][-1])
        out.append(Linear(whole, bias))
    return out


def _raw_logits(rows: DataFrame, models: list[Linear]) -> DataFrame:
    """``uid`` and each slot's logit before calibration."""
    names = [f"z{k}" for k in range(len(models))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = list(_columns(batch))
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(m.logits(*views[k % 2])) for k, m in enumerate(models))], ["uid", *names])

    return rows.select("text", "meta", "uid").mapInArrow(run, "uid long, " + ", ".join(f"{n} double" for n in names))


def _fit(docs: DataFrame, labels: DataFrame, labelled: int, taught: int, rounds: int) -> tuple[dict[str, CoTrained], DataFrame]:
    """The models, and the features of all rows. The driver holds labels, logits and weights: features stay in tables."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    features = scratch.save(_features(docs), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(q).cast("int").alias(q) for q in QUESTIONS))
    marks = marks.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(*(F.max(q).alias(q) for q in QUESTIONS))
    known = features.filter("doc_id is not null").groupBy("doc_id").agg(F.min("uid").alias("uid")).join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    got = sorted((r.doc_id, r.uid, r.quality, r.toxic) for r in known.collect())
    training, aims, checks = {}, {}, {}
    for q, (name, unknown) in enumerate(QUESTIONS.items()):
        own = [(uid, y[q]) for _, uid, *y in got if y[q] is not None]
        check, train = split(len(own))
        for i in train:
            for k in (0, 1):
                aims.setdefault(own[i][0], []).append((2 * q + k, float(own[i][1])))
        checks[name] = [own[i] for i in check]
        training[name] = CoTraining(np.array([y for _, y in checks[name]]), float(np.mean([own[i][1] for i in train])) if len(train) else unknown)

    def rows_of(aims: dict[int, list]) -> DataFrame:
        """The features of some rows beside what they teach."""
        given = spark.createDataFrame(sorted(aims.items()), "uid long, aims array<struct<slot:int,y:double>>")
        # As many rows as the parameters bound.
        return features.select("uid", "text", "meta").join(F.broadcast(given), "uid").select("uid", "text", "meta", "aims")

    train = scratch.save(rows_of(aims), "train")
    check = scratch.save(rows_of({u: [] for own in checks.values() for u, _ in own}), "check")
    seen: set[tuple[str, int, int]] = set()
    for round_ in range(rounds + 1):
        models = _models(train, list(QUESTIONS.values()))
        z = {r.uid: r for r in _raw_logits(check, models).collect()}
        for q, (name, t) in enumerate(training.items()):
            t.calibrate(models[2 * q : 2 * q + 2], tuple(np.array([z[u][f"z{2 * q + k}"] for u, _ in checks[name]]) for k in (0, 1)))
        if round_ == rounds:
            break
        logits = scratch.save(_logits(features, training).join(marks.select("doc_id"), "doc_id", "left_anti"), f"logits-{round_}")
        sure = _surest(logits, training, taught * (round_ + 1))  # beyond those passed before
        if sure is None:
            break
        picks = [r for r in sure.collect() if (r.question, r.view, r.uid) not in seen]  # bounded by the quotas
        scratch.drop(f"logits-{round_}")
        if not picks:
            break
        seen |= {(r.question, r.view, r.uid) for r in picks}
        aims = {}
        for r in picks:
            aims.setdefault(r.uid, []).append((2 * list(QUESTIONS).index(r.question) + 1 - r.view, float(_sigmoid(r.z))))
            training[r.question].taught[1 - r.view] += 1
        train = train.union(scratch.save(rows_of(aims), f"taught-{round_}"))
    return {q: t.model() for q, t in training.items()}, features


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS) -> dict[str, CoTrained]:
    """Models for quality and toxicity by co-training on ``labels(doc_id, quality, toxic)`` and all rows without labels.

    The labelled rows are those of least hash of their id, ``labelled`` of them at most. In each round every
    unlabelled row of ``docs`` is scored by both views, and each passes the rows that it is surest of to the
    other, at most ``taught``. Features are counted by class in sums over tasks, and the few that the labels speak for go on to
    the fit, in a task for each view. To the driver come ids, labels, logits and weights, never a row's features.

    Defined cases: as ``quality_classifier``.
    """
    return _fit(docs, labels, labelled, taught, rounds)[0]


def _scores(models: dict[str, CoTrained], text: tuple[np.ndarray, np.ndarray], meta: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """p_text, p_meta, p_quality, p_toxic and keep of rows with these features."""
    p = {c: m.probabilities(m.text.logits(*text), m.meta.logits(*meta)) for c, m in models.items()}
    good, toxic = p["quality"], p["toxic"][2]
    return (*good, toxic, (good[2] >= 0.5) & (toxic < 0.5))


def drop_rejected(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """The rows that the models keep by ``quality_classifier``'s rule, with all their columns, in one scan.

    Defined cases: null and empty texts are judged as empty ones; null languages and sources are values of their
    own; repeated rows stay or go together; an empty table gives none; the other columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            text, meta = [], []
            for value, lang, source in zip(column("text").cast(pa.large_binary()), column("lang").to_pylist(), column("source").to_pylist()):
                t = value.as_py() or b""
                text.append(text_features(t, buckets))
                meta.append(meta_features(t, lang, source))
            yield batch.filter(pa.array(_scores(models, _flat(text), _flat(meta))[-1], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS) -> DataFrame:
    """Fit by co-training (``fit_quality``) and score all documents: one row per input row.

    ``p_text`` and ``p_meta`` are the calibrated views of quality, ``p_quality`` and ``p_toxic`` the combined
    probabilities; ``keep`` is p_quality >= 0.5 and p_toxic < 0.5. Features are made once and kept.

    Defined cases: a null text is empty; a null language or source is a value of its own; null ids are scored
    but no labelled rows; of labels that repeat an id the greatest counts, and of rows that do one learns;
    without labels of both classes a probability is the share of positive labels, and without any labels all
    rows are kept; repeated rows each give a row; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    models, features = _fit(docs, labels, labelled, taught, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _scores(models, *_columns(batch)))], ["doc_id", "p_text", "p_meta", "p_quality", "p_toxic", "keep"])

    return features.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, p_toxic double, keep boolean")
