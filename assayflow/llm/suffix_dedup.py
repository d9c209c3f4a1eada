"""Repeated passages by a sparse suffix array over content-selected positions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.anchors import Repeats, WordCodes, selected, sequence_hashes
from assayflow.llm.common import Scratch

#: Words in a repeated passage at least, and in the grams whose least one selects a suffix.
WINDOW, GRAM = 50, 16
#: Suffixes of one gram that are sorted together. More are dealt out to parts of about so many.
PART = 4096

_SUFFIX = "g long, part int, parts int, right binary, left binary, uid long, pos int, low int, high int"
_FOUND = "uid long, start int, stop int, hash binary"


def _side(codes: np.ndarray, width: int) -> bytes:
    """Big-endian 32-bit codes, so that bytes sort as words do; 0 is no word and pads a text's end."""
    out = np.zeros(width, ">u4")
    out[: len(codes)] = np.maximum(codes & np.uint64(0xFFFFFFFF), 1)
    return out.tobytes()


def _suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The suffixes kept: one for each anchor that occurs again, with as many words on either side as a window has."""
    width = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCodes()
        for batch in batches:
            cols = [[] for _ in range(9)]
            for uid, value, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2)):
                codes = code.of(value.as_py().split())
                select = selected(sequence_hashes(codes, gram), width + 1)
                for x in at.as_py():
                    p = x["pos"]
                    parts = -(-x["n"] // PART)
                    part = zlib.crc32(b"%d %d" % (uid, p)) % parts
                    row = (x["g"], part, parts, _side(codes[p + gram : p + window], width), _side(codes[max(0, p - width) : p][::-1], width), uid, p, int(np.searchsorted(select, p, "left")), int(np.searchsorted(select, p, "right")))
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(cols[0]) > 4000:
                    yield _batch(cols)
                    cols = [[] for _ in range(9)]
            yield _batch(cols)

    def _batch(cols):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["g", "part", "parts", "right", "left", "uid", "pos", "low", "high"])

    return texts.mapInArrow(run, _SUFFIX)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row; 0 equals nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class _Neighbours:
    """Neighbouring suffixes of one sorted part, some at a time.

    In each run of suffixes that share the words to the right of offset o, those that follow one another and
    share o words to the left form a chain. Chains of two or more are repeats. If a run has several chains,
    goes on beyond what is looked at, or its gram has several parts, equal chains may be apart: then one
    window of each chain is left to be compared by hash.
    """

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.width = window, gram, window - gram

    def found(self, g, part, parts, right, left, uid, pos, low, high) -> pa.RecordBatch:
        n, width = len(g), self.width
        r, l = np.full(n, -1), np.full(n, -1)  # with the suffix before
        same = (g[1:] == g[:-1]) & (part[1:] == part[:-1])
        r[1:] = np.where(same, _common(right[1:], right[:-1]), -1)
        l[1:] = np.where(same, _common(left[1:], left[:-1]), -1)
        out = [[], [], [], []]
        hit = (r >= 0) & (r + l >= width)
        for i in np.flatnonzero(hit).tolist():  # extended to both sides
            for k in (i - 1, i):
                for column, value in zip(out, (uid[k], pos[k] - l[i], pos[k] + self.gram + r[i], None)):
                    column.append(int(value) if value is not None else None)
        for o in range(width + 1):
            start = pos - o
            chosen = (start >= low) & (start < high)
            if not chosen.any():
                continue
            run = np.cumsum(r < width - o)
            head = ~((r >= width - o) & (l >= o))
            chains = np.bincount(run, weights=head, minlength=run[-1] + 1)
            several = (chains[run] > 1) | (run == run[0]) | (run == run[-1]) | (parts > 1)
            for k in np.flatnonzero(head & chosen & several).tolist():
                digest = hashlib.blake2b(g[k].tobytes() + bytes([o % 256, o >> 8]) + left[k, :o].tobytes() + right[k, : width - o].tobytes(), digest_size=16).digest()
                for column, value in zip(out, (int(uid[k]), int(start[k]), int(start[k]) + self.window, digest)):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["uid", "start", "stop", "hash"])


def _neighbours(suffixes: DataFrame, window: int, gram: int) -> DataFrame:
    width = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, held = _Neighbours(window, gram), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(n, width)  # noqa: E731, B023
            number = lambda i: batch.column(i).to_numpy()  # noqa: E731, B023
            now = [number(0), number(1), number(2), words(3), words(4), *map(number, (5, 6, 7, 8))]
            if held is not None:  # parts overlap in one suffix
                yield compare.found(*held)
                now = [np.concatenate([h[-1:], x]) for h, x in zip(held, now)]
            held = now
        if held is not None:
            yield compare.found(*held)

    return suffixes.mapInArrow(run, _FOUND)


def _merged(spans: DataFrame) -> DataFrame:
    """Each document's spans as disjoint ones, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                merged: list[dict] = []
                for s in row:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["uid", "spans"])

    return spans.mapInArrow(run, "uid long, spans array<struct<start:int,stop:int>>")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Passages of ``window`` words or more that occur again, in any document: ``doc_id, n_words, n_repeated, spans``.

    ``spans`` is an array of (start, stop) in words, apart from one another; each word in them is in a window
    of ``window`` words that also starts elsewhere, and no other word is. Every row has one result.

    Suffixes are kept where a window selects its least gram (about 2 in 36 words), and of these only such
    whose gram occurs again. They are dealt out by gram and sorted by gram, words to the right, and words to
    the left; a gram with more than ``PART`` suffixes is dealt out in parts, so equal suffixes never need to be
    in one task. Neighbours are extended to the right and left. What parts or sorting by the right side can keep
    apart is compared by hash. Words compare by 32-bit codes.

    Defined cases: a null text has no words; rows that repeat both id and text are repeats from ``window``
    words on; null ids stay; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    repeats = Repeats(docs, scratch, window, gram, text, doc_id, counted=True)
    suffixes = scratch.save(_suffixes(repeats.texts.select("uid", "text", "at"), window, gram), "suffixes")
    order = ["g", "part", "right", "left", "uid", "pos"]
    found = scratch.save(_neighbours(suffixes.repartition("g", "part").sortWithinPartitions(*order), window, gram), "found")
    left = found.filter("hash is not null").distinct()
    again = left.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    spans = found.filter("hash is null").select("uid", "start", "stop").union(left.join(again, "hash").select("uid", "start", "stop"))
    spans = spans.groupBy("uid", "start").agg(F.max("stop").alias("stop")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    merged = _merged(spans)
    again = repeats.again.select("k1", "k2", F.lit(True).alias("twice"))
    whole = F.col("twice") & (F.col("n_words") >= window)
    out = repeats.prints.select("doc_id", "k1", "k2", "uid", "n_words").join(merged, "uid", "left").join(again, ["k1", "k2"], "left")
    kind = "array<struct<start:int,stop:int>>"
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    out = out.select("doc_id", "n_words", F.when(whole, all_).otherwise(F.coalesce("spans", F.array().cast(kind))).alias("spans"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["stop"] - s["start"]).cast("long"))
    return out.select("doc_id", "n_words", size.alias("n_repeated"), "spans")
