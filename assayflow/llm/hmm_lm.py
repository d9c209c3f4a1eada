"""A hidden Markov language model whose counts, training and exact scores cover the whole corpus."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayflow.llm.common import LOWER, Scratch, sum_vectors

#: A word with at least this share of the training tokens is a class of its own: so there are at most 4096 of them.
OWN_SHARE = 4096
#: Classes of all other words, by the hash of their last two characters.
ENDINGS = 1024
#: Class of the end token.
END = 0
STATES = 8
#: Tokens in a block, the unit that has a vocabulary of its own; and tokens that a worker holds at a time.
BLOCK, AT_ONCE = 4_000_000, 1_000_000
#: Tokens from which a sequence waits for others as long.
LONG = 2048
#: Tokens of a sequence whose forward values are in memory at once. A longer one keeps the values at its cuts and goes over each piece again.
PIECE = 262_144
#: Training ends when the log-likelihood of a token grows by less.
GAIN = 1e-3


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _pack(ids: np.ndarray) -> bytes:
    """Bytes by significance, which compresses far better than number by number."""
    return ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- counts
_BLOCKS = "block string, doc_id long, held_out boolean, tokens binary, local int, word string, train long"


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """Documents as numbers in the vocabulary of their block, and the words of these vocabularies with their counts.

    A task names its blocks anew at each attempt, and writes both kinds of rows in one file, so they always agree.
    """
    schema = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("local", pa.int32()), ("word", pa.string()), ("train", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            name = uuid.uuid4().hex
            if not docs_in:
                return
            counts = np.zeros(len(ids), np.int64)
            for _, out, tokens in docs_in:
                if not out:
                    counts += np.bincount(tokens, minlength=len(ids)) if len(tokens) > len(ids) >> 4 else 0
                    if len(tokens) <= len(ids) >> 4:
                        np.add.at(counts, tokens, 1)
            for at in range(0, len(docs_in), 2000):
                part = docs_in[at : at + 2000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([d[0] for d in part], pa.int64()), pa.array([d[1] for d in part], pa.bool_()), pa.array([_pack(d[2]) for d in part], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=schema,
                )
            words = list(ids)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[at : at + n])], schema=schema,
                )

        ids, docs_in, size = _Ids({b"": 0}), [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for key, text, out in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                words = (text.as_py() or b"").translate(LOWER).split()
                words.append(b"")
                docs_in.append((key, out, np.fromiter(map(ids.__getitem__, words), np.int32, len(words))))
                size += len(words)
                if size >= block:
                    yield from flush()
                    ids, docs_in, size = _Ids({b"": 0}), [], 0
        yield from flush()

    return docs.mapInArrow(run, _BLOCKS)


def _ending_class(word: Column) -> Column:
    return (F.pmod(F.xxhash64(F.right(word, F.lit(2))), F.lit(ENDINGS)) + 1).cast("int")


class Counts:
    """Corpus counts: words by block with their counts and classes, and the totals of each class."""

    def __init__(self, blocks: DataFrame, scratch: Scratch):
        words = blocks.filter("word is not null").select("block", "local", "word", "train")
        # Blocks of a word are summed before the shuffle, and meet their word again in a join that adaptive execution may split.
        known = scratch.save(words.groupBy("word").agg(F.sum("train").alias("c")), "known")
        total = known.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total.n), int(total.v)
        # At most OWN_SHARE words can have such a share, whatever the corpus.
        own = [r.word for r in known.filter((F.col("c") > 0) & (F.col("c") * OWN_SHARE >= self.n) & (F.col("word") != "")).orderBy(F.desc("c"), "word").select("word").collect()]
        self.classes = ENDINGS + 1 + len(own)
        spark = blocks.sparkSession
        named = spark.createDataFrame([(w, ENDINGS + 1 + i) for i, w in enumerate(own)], "word string, own int")
        known = known.join(F.broadcast(named), "word", "left").withColumn(
            "class", F.when(F.col("word") == "", END).otherwise(F.coalesce("own", _ending_class(F.col("word")))).cast("int")
        )
        self.words = scratch.save(words.join(known.select("word", "c", "class"), "word").select("block", "local", "c", "class"), "words")
        by_class = known.filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        self.class_n, self.class_v = np.zeros(self.classes), np.zeros(self.classes)
        for r in by_class:
            self.class_n[r["class"]], self.class_v[r["class"]] = r.n, r.v


def _encode(blocks: DataFrame, counts: Counts) -> DataFrame:
    """Per document: class numbers in order, the base score and the words' scores given their classes."""
    n, v = counts.n, counts.v
    room = counts.class_n + counts.class_v + 1  # one more for all words that training doesn't have

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        local = words.column("local").to_numpy()
        c, kind = np.zeros(size), np.zeros(size, np.uint16)
        c[local], kind[local] = words.column("c").to_numpy(), words.column("class").to_numpy()
        base, given = np.log10((c + 1) / (n + v + 1)), np.log10((c + 1) / room[kind])
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "given", "classes")}
        for data in docs.column("tokens"):
            t = _unpack(data.as_py(), np.int32)
            for k, x in zip(out, (len(t), int((c[t] > 0).sum()), float(base[t].sum()), float(given[t].sum()), _pack(kind[t]))):
                out[k].append(x)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **{k: pa.array(x, pa.binary() if k == "classes" else pa.float64() if k in ("base_score", "given") else pa.int64()) for k, x in out.items()}})

    # Twice as many parts as blocks: no task gets more than a few of them, however many there are.
    parts = max(1, 2 * blocks.select("block").distinct().count())
    docs = blocks.filter("tokens is not null").select("block", "doc_id", "held_out", "tokens").repartition(parts, "block")
    words = counts.words.select("block", "local", "c", "class").repartition(parts, "block")
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, given double, classes binary")


# ---------------------------------------------------------------- the model
class HMM:
    """start: (1, states), for the first token of a document; move: (states, states); emit: (states, classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, prior: np.ndarray, states: int, seed: int) -> HMM:
        r = np.random.default_rng(seed)
        emit = prior * np.exp(r.normal(0, 1, (states, len(prior))))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full((1, states), 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, vector: np.ndarray, prior: np.ndarray, states: int) -> HMM:
        start, move, emit = split_counts(vector, states)
        norm = lambda x: x / x.sum(1, keepdims=True)
        return cls(norm(start + 1), norm(move + 1), norm(emit + prior * 100))


def split_counts(vector: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = states, states + states * states
    return vector[:a].reshape(1, states), vector[a:b].reshape(states, states), vector[b:-2].reshape(states, -1)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by falling length, and how many sequences have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")


def log10_likelihood(model: HMM, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The exact log10 probability of each sequence: the scaled forward recursion over all of them at once."""
    order, active = _by_length(lengths)
    first, total = starts[order], np.zeros(len(starts))
    by_class = np.ascontiguousarray(model.emit.T)
    alpha = None
    for t, n in enumerate(active):
        alpha = np.repeat(model.start, n, axis=0) if t == 0 else alpha[:n] @ model.move
        alpha *= by_class[tokens[first[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


def _forward(model: HMM, tokens: np.ndarray, starts: np.ndarray, active: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Scaled forward values, emissions, scales and token numbers, step after step; ``before``: the values ahead of the first step, if sequences go on."""
    cuts = np.r_[0, np.cumsum(active)]
    seen = np.empty(cuts[-1], np.int64)
    for t, n in enumerate(active):
        seen[cuts[t] : cuts[t + 1]] = tokens[starts[:n] + t]
    emits = np.ascontiguousarray(model.emit.T)[seen]
    alphas, scales, move = np.empty_like(emits), np.empty((len(seen), 1)), model.move
    for t, n in enumerate(active):
        now = slice(cuts[t], cuts[t + 1])
        last = alphas[cuts[t - 1] : cuts[t - 1] + n] if t else before
        alpha = (model.start if last is None else last @ move) * emits[now]
        scale = np.maximum(alpha.sum(1, keepdims=True), 1e-30)
        np.divide(alpha, scale, out=alphas[now])
        scales[now] = scale
    return alphas, emits, scales, seen


def _backward(model: HMM, active: np.ndarray, found: tuple[np.ndarray, ...], before: np.ndarray | None, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The expected counts of the steps, and what the last step before them needs: the values behind it, if sequences go on (``after`` likewise)."""
    alphas, emits, scales, seen = found
    states, classes = model.emit.shape
    cuts, move = np.r_[0, np.cumsum(active)], model.move
    ahead = emits  # becomes beta times emission over scale
    ahead /= scales
    gamma, moving = np.empty_like(alphas), np.zeros((states, states))
    for t in range(len(active) - 1, -1, -1):
        now, n = slice(cuts[t], cuts[t + 1]), active[t]
        m = active[t + 1] if t + 1 < len(active) else 0
        beta = np.ones((n, states))
        if m:
            following = ahead[cuts[t + 1] : cuts[t + 1] + m]
            moving += alphas[cuts[t] : cuts[t] + m].T @ following
            beta[:m] = following @ move.T
        elif after is not None:
            beta = after
        np.multiply(alphas[now], beta, out=gamma[now])
        ahead[now] *= beta
    if before is not None:
        moving += before.T @ ahead[: cuts[1]]
    starting = np.zeros((1, states)) if before is not None else gamma[: cuts[1]].sum(0, dtype=np.float64)[None, :]
    emitting = np.array([np.bincount(seen, weights=gamma[:, k], minlength=classes) for k in range(states)])
    vector = np.concatenate([starting.ravel(), (moving * model.move).ravel(), emitting.ravel(), [np.log(scales).sum(), len(seen)]])
    return vector, ahead[: cuts[1]] @ move.T


def expected_counts(model: HMM, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Baum-Welch's expected counts of whole sequences as one vector, with their log-likelihood and tokens last.

    Sequences of more than ``piece`` tokens keep the forward values at their cuts; the pieces are gone over again
    from the last to the first, with the backward values carried on, so the counts are those of the uncut sequence.
    """
    long = lengths > piece
    order, active = _by_length(lengths[~long])
    total = _backward(model, active, _forward(model, tokens, starts[~long][order], active, None), None, None)[0] if len(active) else 0
    for start, length in zip(starts[long].tolist(), lengths[long].tolist()):
        parts = [(a, np.ones(min(piece, start + length - a), np.int64)) for a in range(start, start + length, piece)]
        before = [None]
        for a, ones in parts[:-1]:
            before.append(_forward(model, tokens, np.array([a]), ones, before[-1])[0][-1:].copy())
        after = None
        for (a, ones), ahead in zip(reversed(parts), reversed(before)):
            found, after = _backward(model, ones, _forward(model, tokens, np.array([a]), ones, ahead), ahead, after)
            total = total + found
    return total


def _parts(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[tuple[list[np.ndarray], list[tuple[pa.RecordBatch, int, int]]]]:
    """Documents' class numbers, some ``most`` tokens at a time, with the rows that they are of."""
    for batch in batches:
        held, size, begin = [], 0, 0
        for i, data in enumerate(batch.column(at)):
            t = _unpack(data.as_py(), np.uint16)
            held.append(t)
            size += len(t)
            if size >= most:
                yield held, [(batch, begin, i + 1)]
                held, size, begin = [], 0, i + 1
        if held:
            yield held, [(batch, begin, batch.num_rows)]


def baum_welch(encoded: DataFrame, model: HMM, prior: np.ndarray, rounds: int) -> HMM:
    """Each round: expected counts of every training document by task, summed over tasks in two steps."""
    states = len(model.emit)
    rows = encoded.filter("not held_out").select("classes")

    def counts(batches: Iterator[pa.RecordBatch], model: HMM) -> np.ndarray | None:
        total, late, size = None, [], 0

        def add(held):
            nonlocal total
            if held:
                sizes = np.array([len(t) for t in held])
                found = expected_counts(model, np.concatenate(held), np.r_[0, np.cumsum(sizes)[:-1]], sizes)
                total = found if total is None else total + found

        for held, _ in _parts(batches, 0, AT_ONCE):
            add([t for t in held if len(t) <= LONG])
            late += [t for t in held if len(t) > LONG]  # long sequences wait for one another: a step costs the same for few and many
            size = sum(map(len, late))
            if size > AT_ONCE:
                add(late)
                late = []
        add(late)
        return total

    last = -math.inf
    for _ in range(rounds):
        summed = sum_vectors(rows, partial(counts, model=model))
        if summed is None:
            return model
        model = HMM.from_counts(summed, prior, states)
        now = summed[-2] / summed[-1]
        if now - last < GAIN:
            break
        last = now
    return model


def hmm_scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", states: int = STATES, rounds: int = 5, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Log10 probabilities of whole texts: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words, A-Z lower-cased, and an end. ``base_score`` is the add-one unigram model; ``score``
    is the hidden Markov model: latent states emit word classes, and a class emits its words with add-one
    counts, so both sum to one over known words and one unknown word (of each class). A word is a class of
    its own if it has a 4096th of the tokens or more, and else falls in one of 1024 classes by its ending:
    the model's size is bounded, while the word counts behind it are those of the whole corpus.

    Words are counted through blocks: a task numbers the words of some 4 million tokens, so that the shuffle
    by word has a row for each word of a block, not for each token, and a frequent word has one row a block.
    The sequences then meet their block's words again, and are kept as class numbers for the training rounds.

    ``held_out`` is a condition on ``docs``; rows where it is null train. Defined cases: a null text is empty
    and has the end only; null ids stay; repeated rows each count and give a row; without training rows all
    words are unknown; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "hmm")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = scratch.save(_blocks(rows, block), "blocks")
    counts = Counts(blocks, scratch)
    encoded = scratch.save(_encode(blocks, counts), "encoded")
    scratch.drop("blocks", "known", "words")
    prior = counts.class_n + counts.class_v + 1
    prior /= prior.sum()
    model = baum_welch(encoded, HMM.initial(prior, states, seed), prior, rounds)
    train_tokens = counts.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in _parts(batches, 6, AT_ONCE):
            lengths = np.array([len(t) for t in held])
            found = log10_likelihood(model, np.concatenate(held), np.r_[0, np.cumsum(lengths)[:-1]], lengths)
            (batch, a, b), = rows
            part = batch.slice(a, b - a)
            score = found + part.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.full(b - a, train_tokens)), part.column(4), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def contract_held_out(doc_id: str = "doc_id") -> Column:
    """Documents that don't train: CRC-32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2
