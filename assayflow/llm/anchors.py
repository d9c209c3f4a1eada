"""Word sequences as numbers, content-selected anchors, and the anchors that occur more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.common import Scratch

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_CACHE = 1_000_000


class WordCodes(dict):
    """64-bit codes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sequence_hashes(codes: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """A mixed polynomial hash of each run of ``length`` codes, by doubling the runs."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    total, covered = None, 0
    run, size, power = codes, 1, _BASES[base]
    with np.errstate(over="ignore"):
        rest = length
        while rest:
            if rest & 1:
                n = len(codes) - covered - size + 1
                total = run[:n].copy() if total is None else total[:n] * power + run[covered : covered + n]
                covered += size
            rest >>= 1
            if rest:
                run, size, power = run[:-size] * power + run[size:], size * 2, power * power
        x = total[: len(codes) - length + 1]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def selected(grams: np.ndarray, per_window: int) -> np.ndarray:
    """For each window, where its least gram is, leftmost first: equal windows select the same place."""
    if len(grams) < per_window:
        return np.zeros(0, np.int64)
    out = np.empty(len(grams) - per_window + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, per_window)
    for at in range(0, len(out), 1 << 16):
        part = view[at : at + (1 << 16)]
        out[at : at + len(part)] = part.argmin(1) + np.arange(at, at + len(part))
    return out


def text_anchors(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of a text: the grams that some window selects."""
    grams = sequence_hashes(codes, gram)
    at = np.unique(selected(grams, window - gram + 1))
    return grams[at], at


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id, text`` with a key of two longs, which rows share only if they repeat both id and text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k2")
    )


def anchored(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Per row of ``keyed``: ``doc_id, k1, k2, n_words, sha256`` of its words, and its anchors (``g``, ``pos``).

    A place p where the text has had that hash before is written -p - 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCodes()
        for batch in batches:
            n, sha, g, pos, cuts = [], [], [], [], [0]
            for value in batch.column(1).cast(pa.large_binary()):
                words = value.as_py().split()
                a, b = text_anchors(code.of(words), window, gram)
                first = np.zeros(len(a), bool)
                first[np.unique(a, return_index=True)[1]] = True
                b = np.where(first, b, -b - 1)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                g.append(a)
                pos.append(b)
                cuts.append(cuts[-1] + len(a))
            cuts = pa.array(cuts, pa.int32())
            flat = lambda x, kind: pa.ListArray.from_arrays(cuts, pa.array((np.concatenate(x) if x else np.zeros(0)).astype(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(cuts, pa.array((np.concatenate(g) if g else np.zeros(0, np.uint64)).view(np.int64))), flat(pos, np.int32)],
                ["doc_id", "k1", "k2", "n_words", "sha256", "g", "pos"],
            )

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, sha256 string, g array<long>, pos array<int>")


class Repeats:
    """What the corpus repeats, as far as anchors tell.

    ``prints``: a row per document, numbered by ``uid``. ``again``: keys that several rows have. ``texts``: the
    documents (one row per key) with an anchor that occurs elsewhere, with their texts and these anchors:
    ``at`` is an array of (pos, g, lead, lead_pos), where lead names one occurrence per anchor hash; with
    ``counted`` also of n, the documents that hold it. A text moves once, to meet its anchors; a hot anchor is a partial count, then a join that AQE may split.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch, window: int, gram: int, text: str = "text", doc_id: str = "doc_id", counted: bool = False):
        rows = keyed(docs, text, doc_id)
        self.prints = scratch.save(anchored(rows, window, gram).withColumn("uid", F.monotonically_increasing_id()), "prints")
        self.again = scratch.save(self.prints.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid")).filter("n > 1"), "again")
        prints = self.prints
        if repeated := not self.again.isEmpty():  # one row per key takes part
            later = prints.join(self.again.withColumnRenamed("uid", "first"), ["k1", "k2"]).filter("uid <> first").select("uid")
            prints = prints.join(later, "uid", "left_anti")
        spots = prints.select("uid", F.explode(F.arrays_zip("g", "pos")).alias("a")).select("uid", "a.g", "a.pos")
        leads = spots.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("lead"), F.min_by("pos", F.when(F.col("pos") >= 0, F.col("uid"))).alias("lead_pos"))
        leads = scratch.save(leads.filter("n > 1"), "leads")
        spots = spots.withColumn("pos", F.when(F.col("pos") < 0, -F.col("pos") - 1).otherwise(F.col("pos")))
        place = ["pos", "g", "lead", "lead_pos", *(["n"] if counted else [])]
        at = spots.join(leads, "g").groupBy("uid").agg(F.collect_list(F.struct(*place)).alias("at"))
        found = at.join(prints.select("uid", "k1", "k2"), "uid")
        texts = rows.select("k1", "k2", "text").join(found, ["k1", "k2"])
        if repeated:
            texts = texts.dropDuplicates(["k1", "k2"])
        self.texts = scratch.save(texts.select("uid", "text", F.array_sort("at").alias("at")), "texts")


def matched_windows(equal: np.ndarray, window: int) -> np.ndarray:
    """Where a run of ``window`` true values starts."""
    if len(equal) < window:
        return np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(equal)]
    return np.flatnonzero(total[window:] - total[:-window] == window)


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The windows' union, as intervals."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + window).tolist()))
