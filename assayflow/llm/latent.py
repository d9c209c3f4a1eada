"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayflow.llm.common import sum_vectors

_WORD_BYTE = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])
_SENTENCE = re.compile(rb"(?<=[.!?])\s+")
_ANSWER = re.compile(rb"\banswer\s*[:=]\s*", re.IGNORECASE)
#: Words of a passage, and from one passage's start to the next.
PASSAGE, STRIDE = 32, 8
#: Buckets for the document counts of words that no item has; theirs are exact.
OTHER = 1 << 18
#: Dimensions of the latent space, or half the number of passages where these are few.
RANK = 256
#: Least cosine in the space, as a share of a verbatim copy's, and least share of an item's weight that a document must hold in order.
COSINE, COVERAGE = 0.3, 0.5
#: Items searched for in one scan of the documents, and their passages (one item may have more). The space is fitted to all items at once.
ITEMS, PASSAGES = 8192, 32768
#: Rows compared with passages at a time.
_ROWS = 4096


# ---------------------------------------------------------------- words
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes hashed at a time; a longer text is cut at a space.
_PIECE = 1 << 20


def _powers(way: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64."""
    if len(_POWERS[way]) < n:
        base = np.full(2 * n, _BASE if way == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = 1
        _POWERS[way] = np.multiply.accumulate(base)
    return _POWERS[way][:n]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of some bytes, whose first and last byte are none of a word.

    With prefix sums of byte times power, a word's sum is a difference, brought to its start by an inverse power.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = _WORD_BYTE[raw].view(np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", len(raw)))
    h = (total[end - 1] - total[start - 1]) * _powers("down", len(raw))[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return start, h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of each text's words, in order: runs of letters and digits, in lower case."""
    out: list[np.ndarray] = []
    group, size = [], 1

    def flush():
        nonlocal group, size
        if group:
            start, h = _hash_piece(b" " + b" ".join(group) + b" ")
            offsets = np.cumsum([1, *(len(t) + 1 for t in group)])
            out.extend(np.split(h, np.searchsorted(start, offsets[1:-1])))
        group, size = [], 1

    for text in texts:
        text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
        if size + len(text) > _PIECE:
            flush()
        if len(text) <= _PIECE:
            group.append(text)
            size += len(text) + 1
            continue
        parts, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= _PIECE else text.rfind(b" ", at, at + _PIECE) + 1
            end = end if end > at else (text.find(b" ", at) + 1 or len(text))
            parts.append(_hash_piece(b" " + text[at:end] + b" ")[1])
            at = end
        out.append(np.concatenate(parts))
    flush()
    return out


def answer_of(text: bytes) -> bytes:
    """What is marked as the answer, or else the last sentence that has words."""
    marked = _ANSWER.split(text)
    if len(marked) > 1:
        return marked[-1]
    return next((s for s in reversed(_SENTENCE.split(text.strip())) if len(word_hashes([s])[0])), b"")


class Vocabulary:
    """Numbers of words: the items' words by their place, any other word by a bucket after these."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes >> np.uint64(48)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        ids = len(self) + (hashes & np.uint64(OTHER - 1)).astype(np.int64)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        if len(at):
            found = hashes[at]
            place = np.minimum(np.searchsorted(self.hashes, found), len(self) - 1)
            same = self.hashes[place] == found
            ids[at[same]] = place[same]
        return ids

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        return [self.of(h) for h in word_hashes(texts)]


# ---------------------------------------------------------------- the latent space
def _some(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as bytes, about a piece at a time."""
    held, size = [], 0
    for v in texts.cast(pa.large_binary()):
        held.append(v.as_py() or b"")
        size += len(held[-1])
        if size > _PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def document_counts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> np.ndarray:
    """Documents that hold each word, and the number of documents last."""
    total = np.zeros(len(vocabulary) + OTHER + 1)
    for batch in batches:
        for texts in _some(batch.column(0)):
            for ids in vocabulary.numbers(texts):
                total[np.unique(ids)] += 1
        total[-1] += batch.num_rows
    return total


def weighted(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF with the root of the count, so that squares add up word by word."""
    unique, counts = np.unique(ids, return_counts=True)
    return unique, np.sqrt(counts) * idf[unique]


def _gram_product(batches: Iterator[pa.RecordBatch], base: np.ndarray, idf: np.ndarray) -> np.ndarray | None:
    """This task's rows A of the TF-IDF matrix: A'(A base), flat."""
    out = None
    for batch in batches:
        out = np.zeros_like(base) if out is None else out
        for value in batch.column(0):
            at, x = weighted(np.frombuffer(value.as_py(), np.int64), idf)
            x = x / max(1e-12, np.sqrt((x * x).sum()))
            out[at] += x[:, None] * (x @ base[at])[None, :]
    return None if out is None else out.ravel()


def randomised_svd(passages: DataFrame, idf: np.ndarray, size: int, rank: int, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the passages' TF-IDF rows.

    A random base is multiplied by the rows' Gram matrix, task by task, and made orthogonal, some rounds;
    the last product gives the small matrix whose eigenvectors turn the base into singular vectors.
    """
    wide = min(size, rank + 16)
    base = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, wide)))[0]
    for _ in range(rounds):
        product = sum_vectors(passages, partial(_gram_product, base=base, idf=idf))
        if product is None:
            return base[:, :rank]
        base = np.linalg.qr(product.reshape(size, wide))[0]
    small = base.T @ sum_vectors(passages, partial(_gram_product, base=base, idf=idf)).reshape(size, wide)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return base @ turn[:, np.argsort(-values)[:rank]]


@dataclass
class Space:
    """The latent space of all items. It grows with the words of the benchmark, not with the documents."""

    vocabulary: Vocabulary
    idf: np.ndarray
    vectors: np.ndarray  # words x rank


@dataclass
class Lot:
    """Some items in the space: bounded by ITEMS and PASSAGES."""

    ids: list  # of the items
    words: list[np.ndarray]  # of each item, in order
    answers: list[np.ndarray]
    of: np.ndarray  # the item of each row: an item as a whole, or one of its passages
    queries: np.ndarray  # rows x rank, over the square of their lengths: a copy of the row gives one
    most: np.ndarray  # of each word, the greatest that it adds to a product with any row


def fit_space(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Space | None:
    """Counts over all documents, and the singular vectors of the passages of all items; None without items that have words."""
    texts = benchmark.filter("text is not null").select(F.col("text").cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(word_hashes(part))).view(np.int64))], ["h"])

    known = texts.mapInArrow(hashed, "h long").distinct().toArrow().column("h").to_numpy().view(np.uint64)
    if not len(known):
        return None
    vocabulary = Vocabulary(known)
    counts = sum_vectors(docs.select(F.col("text").cast("string").alias("text")), partial(document_counts, vocabulary=vocabulary))
    counts = np.zeros(len(vocabulary) + OTHER + 1) if counts is None else counts
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some(batch.column(0)):
                parts = [x.tobytes() for n in vocabulary.numbers(part) if len(n) for x in item_parts(n)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["numbers"])

    rows = texts.mapInArrow(passages, "numbers binary")
    rank = max(1, min(rank, rows.count() // 2))
    return Space(vocabulary, idf, randomised_svd(rows, idf[: len(vocabulary)], len(vocabulary), rank).astype(np.float32))


def place_items(space: Space, items: list[tuple[object, bytes]]) -> Lot:
    """Items and their passages as vectors of the space."""
    words = space.vocabulary.numbers([t for _, t in items])
    parts = [(k, part) for k, n in enumerate(words) for part in item_parts(n)]
    queries = np.zeros((len(parts), space.vectors.shape[1]), np.float32)
    for i, (_, n) in enumerate(parts):
        at, x = weighted(n, space.idf)
        q = (x / np.sqrt((x * x).sum())) @ space.vectors[at]
        queries[i] = q / max(float(q @ q), 1e-6)
    most = np.zeros(len(space.idf))
    for i in range(0, len(parts), 256):
        most[: len(space.vocabulary)] = np.maximum(most[: len(space.vocabulary)], (space.vectors @ queries[i : i + 256].T).max(1))
    return Lot([i for i, _ in items], words, space.vocabulary.numbers([answer_of(t) for _, t in items]), np.array([k for k, _ in parts]), queries, most * space.idf)


# ---------------------------------------------------------------- search and checks
def passage_starts(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words; the last passage ends with the text."""
    return np.unique(np.r_[np.arange(0, max(1, n - PASSAGE + 1), STRIDE), max(0, n - PASSAGE)])


def item_parts(words: np.ndarray) -> list[np.ndarray]:
    """What of an item is searched for: the whole, and where it is longer than a passage each of its passages.

    A passage of a document can hold no more than a passage of a long item, whose whole it hardly resembles.
    """
    starts = passage_starts(len(words)) if len(words) > PASSAGE else ()
    return [words, *(words[s : s + PASSAGE] for s in starts)]


def candidates(space: Space, lot: Lot, texts: list[np.ndarray], cosine: float = COSINE) -> list[tuple[int, int, int, float]]:
    """(text, passage start, item, cosine) of the pairs at the cosine or above.

    The cosine is that of the passage and a row of the item (the whole, or one of its passages) in the latent
    space, as a share of what a copy of that row has there, and the greatest over the item's rows. Nothing but
    this decides what is checked. No word adds more to a product than its greatest weight in any row's image:
    passages where the sum of these is too small are passed over without loss.
    """
    size = len(space.vocabulary)
    ids = np.concatenate([*texts, np.zeros(0, np.int64)])
    begin = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    each = [passage_starts(len(t)) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(x) for x in each])
    starts = np.concatenate([*each, np.zeros(0, np.int64)]) + begin[of]
    ends = np.minimum(starts + PASSAGE, begin[of + 1])
    total, most = np.r_[0, np.cumsum(space.idf[ids] ** 2)], np.r_[0, np.cumsum(lot.most[ids])]
    norm = np.sqrt(np.maximum(total[ends] - total[starts], 1e-12))
    left = np.flatnonzero(most[ends] - most[starts] >= cosine * norm * (1 - 1e-6))
    out: dict[tuple[int, int, int], float] = {}
    for at in range(0, len(left), 1024):
        part = left[at : at + 1024]
        lengths = ends[part] - starts[part]
        row = np.repeat(np.arange(len(part)), lengths)
        word = ids[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[part], lengths)]
        inside = word < size
        pair, count = np.unique(row[inside] * size + word[inside], return_counts=True)
        row, word = np.divmod(pair, size)
        x = np.sqrt(count) * space.idf[word] / norm[part][row]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        if not len(first):
            continue
        latent = np.add.reduceat(space.vectors[word] * x[:, None].astype(np.float32), first)
        passage = part[row[first]]
        for r in range(0, len(lot.of), _ROWS):
            close = latent @ lot.queries[r : r + _ROWS].T
            i, k = np.nonzero(close >= cosine)
            for p, item, c in zip(passage[i].tolist(), lot.of[r + k].tolist(), close[i, k].tolist()):
                found = (int(of[p]), int(starts[p] - begin[of[p]]), item)
                out[found] = max(out.get(found, 0.0), c)
    return [(*found, c) for found, c in out.items()]


def coverage(item: np.ndarray, text: np.ndarray, idf: np.ndarray) -> float:
    """The weight of the heaviest common subsequence over the item's weight; a word weighs its IDF."""
    if not len(item):
        return 0.0
    total = idf[item].sum()
    item, text = item[np.isin(item, text)], text[np.isin(text, item)]  # other words are in no common subsequence
    row = np.zeros(len(text) + 1)
    for w in item:
        with_w = np.where(text == w, row[:-1] + idf[w], 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], with_w))
    return float(row[-1] / total)


def coverage_bound(item: np.ndarray, text: np.ndarray, idf: np.ndarray) -> float:
    """At least the coverage: what the words give in any order."""
    words, n = np.unique(item, return_counts=True)
    held, m = np.unique(text, return_counts=True)
    _, a, b = np.intersect1d(words, held, assume_unique=True, return_indices=True)
    return float((np.minimum(n[a], m[b]) * idf[words[a]]).sum() / idf[item].sum())


def leaks(space: Space, lot: Lot, texts: list[np.ndarray], cosine: float = COSINE, least: float = COVERAGE) -> list[list[tuple[int, float, float, float]]]:
    """For each text, (item, cosine, coverage of the item, coverage of its answer) of each item that it holds."""
    best: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in texts]
    seen: set[tuple[int, int, int, int]] = set()
    for i, s, k, c in sorted(candidates(space, lot, texts, cosine), key=lambda x: -x[3]):
        n = len(lot.words[k])
        start, end = max(0, s - n), min(len(texts[i]), s + PASSAGE + n)
        if (i, k, start, end) in seen:  # the same words, at a cosine no greater
            continue
        seen.add((i, k, start, end))
        around = texts[i][start:end]
        if coverage_bound(lot.words[k], around, space.idf) < max(least, best[i][k][2] if k in best[i] else 0.0) - 1e-9:
            continue
        found = coverage(lot.words[k], around, space.idf)
        if found >= least and (k not in best[i] or (found, c) > (best[i][k][2], best[i][k][1])):
            answer = coverage(lot.answers[k], around, space.idf)
            if answer >= least:
                best[i][k] = (k, c, found, answer)
    return [[own[k] for k in sorted(own)] for own in best]


def _lots(benchmark: DataFrame) -> list[list[tuple[int | None, bytes]]]:
    """The items that have words, ITEMS of them or PASSAGES of their passages at a time."""
    wanted = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    lots, lot, size = [], [], 0
    for r in wanted.orderBy("item_id", "text").toLocalIterator():
        if n := len(word_hashes([r.text.encode()])[0]):
            parts = 1 + (len(passage_starts(n)) if n > PASSAGE else 0)
            if lot and size + parts > PASSAGES:
                lots, lot, size = [*lots, lot], [], 0
            lot.append((r.item_id, r.text.encode()))
            size += parts
        if len(lot) == ITEMS:
            lots, lot, size = [*lots, lot], [], 0
    return lots + [lot] if lot else lots


def _search(space: Space, lot: Lot, texts: pa.Array, cosine: float, least: float) -> list[list[tuple[int, float, float, float]]]:
    """``leaks`` of the texts, some at a time."""
    return [x for part in _some(texts) for x in leaks(space, lot, space.vocabulary.numbers(part), cosine, least)]


def _spread(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int) -> tuple[Broadcast | None, list[Broadcast]]:
    """The space and the lots, for the tasks."""
    space = fit_space(docs, benchmark, rank)
    if space is None:
        return None, []
    return spark.sparkContext.broadcast(space), [spark.sparkContext.broadcast(place_items(space, lot)) for lot in _lots(benchmark)]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least: float = COVERAGE, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` that hold no item by ``decontaminate``'s rule, with all their columns.

    Defined cases: null and empty texts hold nothing and stay; null ids and repeated rows are judged by their
    texts like any others; without items all rows stay; an empty table gives none; the other columns stay as they are.
    """
    schema = docs.schema
    space_of, lots = _spread(docs.sparkSession, docs, benchmark, rank)

    def keep(lot_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not x for x in _search(space_of.value, lot_of.value, texts, cosine, least)], pa.bool_()))

        return run

    for lot_of in lots:
        docs = docs.mapInArrow(keep(lot_of), schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least: float = COVERAGE, rank: int = RANK) -> DataFrame:
    """Which documents hold which benchmark items: ``doc_id, contaminated, n_items, item_ids, coverage, cosine``.

    Words are runs of letters and digits, in lower case. The space is a distributed randomised SVD of the TF-IDF
    rows of all items and their passages of 32 words, at a rank of at most half their number; IDF counts all
    documents. Passages of 32 words, every 8 words, of every document whose cosine with a row in the space
    reaches ``cosine`` of a verbatim copy's are candidates. A candidate is a leak if the document around the
    passage holds half of the item's IDF weight as a common subsequence, and half of its answer's (what
    follows "answer:", or the last sentence). One row per input row; ``item_ids`` is sorted.

    All items share one space, whose vectors are as many as the benchmark has different words. ``ITEMS`` items
    or ``PASSAGES`` of their passages are searched for in one pass over the documents, more in further passes.

    Defined cases: null texts are empty and hold nothing; items without words are never found; null ids stay;
    items that repeat are each found; repeated rows each give a row; an empty table of documents gives no
    rows, and without items nothing is contaminated; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    space_of, lots = _spread(docs.sparkSession, rows, benchmark, rank)

    def search(lot_of, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, lot = space_of.value, lot_of.value
            for batch in batches:
                found = _search(space, lot, batch.column(0), cosine, least)
                items, cover, close = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i, x in enumerate(found):
                    if x:
                        items[i] = items[i] + [lot.ids[f[0]] for f in x]
                        cover[i] = max(cover[i] or 0.0, *(f[2] for f in x))
                        close[i] = max(close[i] or 0.0, *(f[1] for f in x))
                rows = [*batch.columns[:2], pa.array(items, pa.list_(pa.int64())), pa.array(cover, pa.float64()), pa.array(close, pa.float64())]
                yield pa.RecordBatch.from_arrays(rows[last:], names[last:])

        return run

    out = rows.select("text", "doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("cosine"))
    kinds = ("text string", "doc_id long", "item_ids array<long>", "coverage double", "cosine double")
    names = [k.split()[0] for k in kinds]
    for i, lot_of in enumerate(lots):  # one after the other in one scan of the table; the last passes no text on
        last = int(i == len(lots) - 1)
        out = out.mapInArrow(search(lot_of, last), ", ".join(kinds[last:]))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.array_sort("item_ids").alias("item_ids"), "coverage", "cosine")
