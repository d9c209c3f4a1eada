"""Repeated passages by relative Lempel-Ziv factors, and the removal of the words that they cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.anchors import Repeats, WordCodes, covered, matched_windows, selected, sequence_hashes
from assayflow.llm.common import Scratch

WINDOW = 35
#: Words in an anchor. Every window holds one of the anchors that its document selects.
GRAM = 12
#: How far beyond an anchor's windows a factor within a document is extended at once.
AHEAD = 4096
#: Words in a stretch of a leading document. A block is handed out by its stretches, so a factor meets one piece and not all blocks of its lead.
STRETCH = 4096
#: How many more blocks an anchor is held against, after that of its lead. What is open then is settled by hash.
BLOCKS = 3

_FOUND = "kind int, uid long, lead long, start int, stop int, delta int, codes binary"
SPAN, OPEN, FACTOR, BLOCK = range(4)
_HASHED = "uid long, start int, stop int, hash binary"


def _window_hash(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


class _Rows:
    """Rows of the table that both passes write."""

    def __init__(self):
        self.columns = [[] for _ in range(7)]

    def add(self, kind, uid, start, stop, lead=None, delta=None, codes=None):
        for column, value in zip(self.columns, (kind, uid, lead, start, stop, delta, codes)):
            column.append(value)

    def spans(self, uid: int, starts: np.ndarray, window: int) -> None:
        for a, b in covered(starts, window):
            self.add(SPAN, uid, a, b)

    def open(self, uid: int, starts: np.ndarray, codes: np.ndarray, offset: int, window: int, gram: int) -> None:
        """Windows that differ from the block met: a row for each run at one anchor, with the anchor's hash for its lead and its place for its stop."""
        if not len(starts):
            return
        grams = sequence_hashes(codes, gram)
        at = selected(grams, window - gram + 1)[starts - offset]
        cuts = np.r_[0, np.flatnonzero((np.diff(starts) != 1) | (np.diff(at) != 0)) + 1, len(starts)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low, high, place = int(starts[a]), int(starts[b - 1]), int(at[a])
            self.add(OPEN, uid, low, place + offset, lead=int(grams[place].view(np.int64)), codes=codes[low - offset : high - offset + window].tobytes())

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], ["kind", "uid", "lead", "start", "stop", "delta", "codes"])
        self.columns = [[] for _ in range(7)]
        return out


def parse(uid: int, codes: np.ndarray, at: list[tuple[int, int, int, int]], out: _Rows, window: int, gram: int) -> None:
    """Factor one document, anchor by anchor, against itself and the reference blocks that hold its anchors.

    at: (place, hash, leading document, place there), by place. Anchors whose windows lie in the current
    factor are jumped over. What repeats inside the document is settled here; each other anchor goes, with
    the words of its windows, to the block of its lead.
    """
    n = len(codes)
    select = selected(sequence_hashes(codes, gram), window - gram + 1)
    places = np.array([a[0] for a in at])
    lows, highs = np.searchsorted(select, places, "left"), np.searchsorted(select, places, "right")
    here: dict[int, int] = {}
    reach = (0, 0)  # the current factor within the document
    across: list[list[int]] = []  # first window, last window, lead, delta, last anchor
    blocks: list[list[int]] = []
    repeated = []
    for (p, g, lead, lead_pos), low, high in zip(at, lows.tolist(), highs.tolist()):
        own = lead == uid
        source = here.setdefault(g, p)  # a lead is the first place in its document
        if own and p == lead_pos:  # others refer to these words
            a, b = max(0, p - window + gram), min(n, p + window)
            if blocks and a <= blocks[-1][1]:
                blocks[-1][1] = b
            else:
                blocks.append([a, b])
            continue
        if p != source:
            if reach[0] <= low and high - 1 + window <= reach[1]:
                continue
            delta = source - p
            a, b = max(low, -delta), min(n, n - delta, high - 1 + window + AHEAD)
            if b > a:
                equal = codes[a:b] == codes[a + delta : b + delta]
                starts = matched_windows(equal, window) + a
                repeated += [starts, starts + delta]
                at_p = p - a
                end = at_p + (int(np.argmin(equal[at_p:])) if not equal[at_p:].all() else len(equal) - at_p)
                begin = at_p - (int(np.argmin(equal[: at_p + 1][::-1])) if not equal[: at_p + 1].all() else at_p + 1) + 1
                reach = (a + begin, a + end)
            else:
                starts = np.zeros(0, np.int64)
            rest = np.setdiff1d(np.arange(low, high), starts, assume_unique=False)
            if not len(rest):
                continue
            if own:
                out.open(uid, rest, codes[low : high - 1 + window], low, window, gram)
                continue
        delta = lead_pos - p
        last = across[-1] if across else None
        if last and last[1:4] == [low, lead, delta] and (last[4] + delta) // STRETCH == lead_pos // STRETCH:  # the windows go on where the last factor's ended
            last[1], last[4] = high, p
        else:
            across.append([low, high, lead, delta, p])
    if repeated:
        out.spans(uid, np.concatenate(repeated), window)
    for a, b in blocks:
        for k in range(a // STRETCH, (b - 1) // STRETCH + 1):  # with as much around a stretch as a factor at it may have
            begin, end = max(a, k * STRETCH - 2 * window), min(b, (k + 1) * STRETCH + 2 * window)
            out.add(BLOCK, uid, begin, end, delta=k, codes=codes[begin:end].tobytes())
    for low, high, lead, delta, p in across:
        out.add(FACTOR, uid, low, p, lead=lead, delta=delta, codes=codes[low : high - 1 + window].tobytes())


def _parsed(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out = WordCodes(), _Rows()
        for batch in batches:
            anchors = batch.column(2)
            for uid, value, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), anchors):
                at = [(x["pos"], x["g"], x["lead"], x["lead_pos"]) for x in at.as_py()]
                parse(uid, code.of(value.as_py().split()), at, out, window, gram)
                if len(out.columns[0]) > 5000:
                    yield out.batch()
            yield out.batch()

    return texts.select("uid", "text", "at").mapInArrow(run, _FOUND)


def _checked(factors: DataFrame, window: int, gram: int) -> DataFrame:
    """Factors against their reference words: equal windows are repeats on both sides, the others stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for batch in batches:
            uids, leads, starts, deltas, firsts = (batch.column(i).to_pylist() for i in range(5))
            for uid, lead, start, delta, first, codes, block in zip(uids, leads, starts, deltas, firsts, batch.column(5), batch.column(6)):
                own, other = np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(block.as_py(), np.uint64)
                shift = start + delta - first  # of the factor's first word in the block
                a, b = max(0, -shift), min(len(own), len(other) - shift)
                equal = np.zeros(len(own), bool)
                equal[a:b] = own[a:b] == other[a + shift : b + shift]
                same = matched_windows(equal, window)
                out.spans(uid, same + start, window)
                out.spans(lead, same + start + delta, window)
                out.open(uid, np.setdiff1d(np.arange(len(own) - window + 1), same) + start, own, start, window, gram)
                if len(out.columns[0]) > 5000:
                    yield out.batch()
            yield out.batch()

    return factors.select("uid", "lead", "start", "delta", "first", "codes", "block").mapInArrow(run, _FOUND)


def _hashed(rest: DataFrame, window: int) -> DataFrame:
    """``uid, start, stop, hash`` of each window that is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, starts, hashes = [], [], []
            for uid, start, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(codes.as_py(), np.uint64)
                for k in range(len(own) - window + 1):
                    uids.append(uid)
                    starts.append(start + k)
                    hashes.append(_window_hash(own[k : k + window]))
            stops = [a + window for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(hashes, pa.binary())], ["uid", "start", "stop", "hash"])

    return rest.select("uid", "start", "codes").mapInArrow(run, _HASHED)


def repeated_spans(repeats: Repeats, scratch: Scratch, window: int, gram: int, more: int = BLOCKS) -> DataFrame:
    """``uid, start, stop``: the words that a repeated window covers, for one row of each key.

    Factors against the lead of each anchor find what two occurrences share with the lead. Windows that differ
    from it may still occur twice: of the occurrences of an anchor that have such windows, the first is the next
    block that the index names, and the others are factored against it, ``more`` times. A block that has been
    met leaves the search, for what equals it is found. An anchor may have any number of blocks, so windows that
    differ from all of these are checked among themselves, by the hash of the whole window.
    """
    found = scratch.save(_parsed(repeats.texts, window, gram), "parsed")
    blocks = found.filter(F.col("kind") == BLOCK).select("uid", F.col("delta").alias("stretch"), F.col("start").alias("first"), F.col("stop").alias("last"), F.col("codes").alias("block")).withColumnRenamed("uid", "lead")
    # A factor's row has the place of an anchor for its stop; its lead has that anchor in exactly one block.
    place = F.col("stop") + F.col("delta")
    factors = found.filter(F.col("kind") == FACTOR).select("uid", "lead", "start", "delta", "codes", place.alias("place"), F.floor(place / STRETCH).cast("int").alias("stretch"))
    inside = (F.col("first") <= F.col("place")) & (F.col("last") >= F.col("place") + gram)
    checked = scratch.save(_checked(factors.join(blocks, ["lead", "stretch"]).filter(inside), window, gram), "checked")
    of = lambda rows, kind: rows.filter(F.col("kind") == kind)
    spans, rest = of(found, SPAN).union(of(checked, SPAN)), of(found, OPEN).union(of(checked, OPEN))
    for k in range(more):
        rest = rest.select("uid", F.col("lead").alias("g"), "start", F.col("stop").alias("place"), "codes")
        leads = rest.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "start", "place", "codes")).alias("of")).filter("n > 1")
        leads = scratch.save(leads.select("g", F.col("of.uid").alias("lead"), F.col("of.start").alias("first"), F.col("of.place").alias("there"), F.col("of.codes").alias("block")), f"blocks{k}")
        others = rest.join(leads, "g").filter((F.col("uid") != F.col("lead")) | (F.col("start") != F.col("first")))
        checked = scratch.save(_checked(others.withColumn("delta", F.col("there") - F.col("place")), window, gram), f"checked{k}")
        spans, rest = spans.union(of(checked, SPAN)), of(checked, OPEN)
    left = scratch.save(_hashed(rest, window), "left")
    again = left.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    spans = spans.select("uid", "start", "stop").union(left.join(again, "hash").select("uid", "start", "stop"))
    return spans.groupBy("uid", "start").agg(F.max("stop").alias("stop"))


def _removed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, removed, sha, kept_text = [], [], [], []
            for uid, value, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2)):
                words = value.as_py().split()
                keep, at = [], 0
                for s in sorted((x["start"], x["stop"]) for x in spans.as_py()):
                    keep += words[at : s[0]] if s[0] > at else []
                    at = max(at, s[1])
                keep += words[at:]
                text = b" ".join(keep)
                uids.append(uid)
                removed.append(len(words) - len(keep))
                sha.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())], ["uid", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(run, "uid long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Remove every word that a repeated window covers: ``doc_id, n_words, n_removed, kept_sha256`` per row.

    Words are split at spaces and the controls tab to carriage return, and stay unchanged. A window is
    ``window`` consecutive words of one document; it is repeated if its words also start anywhere else,
    in the same document or another, in the input as it is. With ``keep_text`` the rows also hold
    ``kept_text``, which is null where nothing was removed.

    Two equal windows select the same anchor, so whatever repeats has an anchor that occurs twice. Documents
    with such anchors are factored against the reference blocks that the index names for them, greedily,
    and windows at factor boundaries that differ from all blocks met are compared by hash. No group is
    gathered: anchors and windows are counted, and a hot lead is the short side of a join.

    Defined cases: a null text has no words; rows that repeat both id and text repeat all their windows, so
    from ``window`` words on nothing of them is kept; null ids stay; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    repeats = Repeats(docs, scratch, window, gram, text, doc_id)
    spans = repeated_spans(repeats, scratch, window, gram).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = _removed(repeats.texts.select("uid", "text").join(spans, "uid"))
    if not keep_text:
        changed = changed.drop("kept_text")
    again = repeats.again.select("k1", "k2", F.lit(True).alias("twice"))
    whole = F.col("twice") & (F.col("n_words") >= window)
    out = repeats.prints.select("doc_id", "k1", "k2", "uid", "n_words", "sha256").join(changed, "uid", "left").join(again, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if keep_text else []),
    )
