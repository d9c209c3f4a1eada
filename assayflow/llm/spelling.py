"""Spelling variants: words one edit apart, found by bands of letter-parity masks."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.common import LOWER, Scratch, empty_if_null

#: Code points and occurrences of a word at least; how many times as frequent a word's form is at least.
LENGTH, OFTEN, TIMES = 6, 5, 5
#: Of so many runs one loses a letter.
EVERY = 199
#: Words that are compared in one group. Groups of more are divided by further bands.
GROUP = 8192
#: How often a group is divided by bands. What is still too large is divided by what a deleted letter leaves.
DEPTH = 4

_BITS = 63
_CACHE = 500_000


def _letter_bits() -> np.ndarray:
    """The mask bit of each code point up to U+00FF: a to z have one each, all others share the rest."""
    bits = np.arange(256) % (_BITS - 26) + 26
    bits[ord("a") : ord("z") + 1] = np.arange(26)
    return np.uint64(1) << bits.astype(np.uint64)


def parity_masks(words: list[bytes]) -> np.ndarray:
    """For each word in Latin-1, which letters it has an odd number of times. One edit flips two bits at most."""
    flat, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    return np.bitwise_xor.reduceat(_letter_bits()[flat], starts) if len(flat) else np.zeros(0, np.uint64)


def thirds(bits: int) -> list[int]:
    """A set of bits as three, dealt out in turn."""
    ones = [1 << i for i in range(_BITS) if bits >> i & 1]
    return [sum(ones[i::3]) for i in range(3)]


class Paths:
    """Bands, each divided into thirds of the bits that it leaves: a path is the third taken at each level.

    Two flipped bits leave one third as it was, whatever the bits: masks of near words are equal on one band of
    each level at least. A pair belongs to the first such band of each level, so it is found once.
    """

    def __init__(self):
        whole = (1 << _BITS) - 1
        self.same: dict[str, int] = {"": 0}
        self.differ: dict[str, list[int]] = {"": []}
        for level in range(DEPTH):
            for path in [p for p in self.same if len(p) == level]:
                parts = thirds(whole & ~self.same[path])
                for i, part in enumerate(parts):
                    self.same[f"{path}{i}"] = self.same[path] | part
                    self.differ[f"{path}{i}"] = self.differ[path] + parts[:i]

    def below(self, path: str) -> list[tuple[str, int]]:
        return [(f"{path}{i}", self.same[f"{path}{i}"]) for i in range(3)]


PATHS = Paths()


# ---- words -------------------------------------------------------------------------------------------
def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, every: int = EVERY) -> DataFrame:
    """``word, n``: runs of letters in lower case, with how often each occurs.

    Of the runs whose ``crc32("<doc_id>:<run>")`` is divisible by ``every``, the letter at that hash modulo the length goes.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                own = Counter(runs.findall(value.as_py().translate(LOWER).decode()))
                start = zlib.crc32(f"{key}:".encode())
                for word in list(own):
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        n, less = own.pop(word), word[:at] + word[at + 1 :]
                        if len(less) >= length:
                            total[less] += n
                total.update(own)
                if len(total) > _CACHE:
                    yield sent(total)
                    total.clear()
        yield sent(total)

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), empty_if_null(F.col(text).cast("string")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_masks(words: DataFrame) -> DataFrame:
    """``word, n`` with ``key`` (the word in Latin-1, a byte a letter), ``size`` and ``mask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            cells = [pa.array(keys, pa.binary()), pa.array([len(k) for k in keys], pa.int32()), pa.array(parity_masks(keys).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["word", "n", "key", "size", "mask"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key binary, size int, mask long")


# ---- comparing ---------------------------------------------------------------------------------------
def _letters(keys: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), size)


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    before, after = short == long[:, :-1], short == long[:, 1:]
    alike = np.where(before.all(1), short.shape[1], before.argmin(1))
    rest = np.where(after.all(1), short.shape[1], after[:, ::-1].argmin(1))
    return alike + rest >= short.shape[1]


def near_pairs(short: list[bytes], long: list[bytes], masks: tuple[np.ndarray, np.ndarray], differ: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (i, j) one edit apart, of words of one length among themselves (i < j, False) and with words a letter longer (True).

    Masks that differ in more than two bits, or nowhere in a set of bits of ``differ``, are not looked at. Some words at a time.
    """
    size = len(short[0])
    own, other = _letters(short, size), _letters(long, size + 1) if long else None
    for at in range(0, len(short), step := max(1, (1 << 22) // max(1, len(short), len(long)))):
        for letters, mask, longer in ((own, masks[0], False), (other, masks[1], True)):
            if letters is None:
                continue
            flips = masks[0][at : at + step, None] ^ mask[None, :]
            fit = np.bitwise_count(flips) <= 2
            i, j = np.nonzero(fit)
            flips, i = flips[i, j], i + at
            fit = np.ones(len(i), bool) if longer else i < j
            for bits in differ:
                fit &= flips & np.uint64(bits) != 0
            i, j = i[fit], j[fit]
            close = (_one_inserted if longer else _one_replaced)(own[i], letters[j])
            if close.any():
                yield i[close], j[close], longer


def _compare(by: list[str]):
    """Of each group, per word: how many near words it has there, and the one of largest n (ties: the smallest)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("long", "ascending"), ("n", "descending"), ("key", "ascending")])
        keys, n, long = table.column("key").to_pylist(), table.column("n").to_numpy(), table.column("long").to_numpy()
        masks, cut = table.column("mask").to_numpy().view(np.uint64), int((~long).sum())
        near, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if cut:
            a, b = [], []
            for i, j, longer in near_pairs(keys[:cut], keys[cut:], (masks[:cut], masks[cut:]), PATHS.differ[table.column("path")[0].as_py()]):
                j = j + cut if longer else j
                if by[-1] == "rest":
                    same_kind = np.full(len(i), table.column("insert")[0].as_py() == longer)
                    i, j = i[same_kind], j[same_kind]
                a.append(np.r_[i, j])
                b.append(np.r_[j, i])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                near = np.bincount(a, minlength=len(keys))
                place = pc.sort_indices(table, sort_keys=[("n", "descending"), ("key", "ascending")]).to_numpy()
                rank = np.empty(len(keys), np.int64)
                rank[place] = np.arange(len(keys))
                top = np.full(len(keys), len(keys) - 1, np.int64)
                np.minimum.at(top, a, rank[b])
                best = place[top]
        at = np.flatnonzero(near)
        words = table.column("word").take(pa.array(at))
        found = table.column("word").take(pa.array(best[at]))
        return pa.table([words.combine_chunks(), pa.array(near[at], pa.int64()), found.combine_chunks(), pa.array(n[best[at]], pa.int64())], ["word", "n_near", "form", "form_n"])

    return run


_FOUND = "word string, n_near long, form string, form_n long"


def _roles(words: DataFrame) -> DataFrame:
    """Each word among those of its length, and among those a letter shorter."""
    as_long = F.array(F.struct(F.col("size").alias("base"), F.lit(False).alias("long")), F.struct((F.col("size") - 1).alias("base"), F.lit(True).alias("long")))
    return words.withColumn("_r", F.explode(as_long)).select("word", "n", "key", "mask", "_r.base", "_r.long")


def _divided(rows: DataFrame, level: int) -> DataFrame:
    """Rows of some path, each under the three paths below it; ``value`` is the mask on the path's bits."""
    above = [p for p in PATHS.same if len(p) == level]
    kinds = [F.array(*(F.struct(F.lit(q).alias("path"), F.col("mask").bitwiseAND(F.lit(bits)).alias("value")) for q, bits in PATHS.below(p))) for p in above]
    chosen = kinds[0]
    if level:
        chosen = F.coalesce(*(F.when(F.col("path") == p, kind) for p, kind in zip(above, kinds)))
    return rows.withColumn("_p", F.explode(chosen)).select("word", "n", "key", "mask", "base", "long", "_p.path", "_p.value")


def _by_rest(rows: DataFrame) -> DataFrame:
    """Rows under what is left without one letter.

    Words of one length that differ in a letter leave the same there (``insert`` false). A word is what a longer one leaves
    without its extra letter, the first of equal ones side by side (``insert`` true). No group has more words than letters and places.
    """
    at = F.sequence(F.lit(1), F.length("key"))
    without = lambda i: F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key")))
    first = lambda i: (i == 1) | (F.substring("key", i, F.lit(1)) != F.substring("key", i - 1, F.lit(1)))
    cell = lambda insert, place, rest: F.struct(F.lit(insert).alias("insert"), place.cast("int").alias("place"), rest.alias("rest"))
    replaced = F.transform(at, lambda i: cell(False, i, without(i)))
    shorter = F.transform(F.filter(at, first), lambda i: cell(True, F.lit(0), without(i)))
    spots = F.when(F.col("long"), shorter).otherwise(F.concat(replaced, F.array(cell(True, F.lit(0), F.col("key")))))
    return rows.withColumn("_s", F.explode(spots)).select("word", "n", "key", "mask", "base", "long", "path", "value", "_s.*")


def near_words(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """``word, n_near, form, form_n`` of the words of ``words(word, n)`` that have near ones: how many, and the one of largest n."""
    rows, found = _roles(scratch.save(_with_masks(words), "masks")), None
    for level in range(DEPTH + 1):
        by = ["path", "base", "value"]
        if level < DEPTH:
            rows = _divided(rows, level)
        else:
            rows, by = _by_rest(rows), [*by, "insert", "place", "rest"]
        here = rows
        if level < DEPTH:
            large = scratch.save(rows.groupBy(*by).count().filter(F.col("count") > group).select(*by), f"large{level}")
            here = rows.join(large, by, "left_anti")
        part = scratch.save(here.groupBy(*by).applyInArrow(_compare(by), _FOUND), f"found{level}")
        found = part if found is None else found.union(part)
        if level < DEPTH:
            if large.isEmpty():
                break
            rows = rows.join(large, by, "left_semi")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", "b.form_n")


def _roots(forms: DataFrame, scratch: Scratch, longest: int) -> DataFrame:
    """``word, root`` of the words of ``forms(word, form)``: forms followed to the last, in steps that double."""
    at = forms.select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(longest))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = scratch.save(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots{i}")
    return at


def spelling_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, often: int = OFTEN, times: int = TIMES, every: int = EVERY, group: int = GROUP
) -> DataFrame:
    """Words of all texts and the words they are variants of: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters in lower case of ``length`` letters or more that occur ``often`` times or more; near words are
    one inserted, deleted or replaced letter apart. A word's form is its near word of largest n, if that is ``times`` its own
    n; its root is the last of the forms.

    A word's mask has a bit for each letter it has an odd number of times. An edit flips two bits at most, so of three
    bands one stays: words meet under each band, with those of their length and of one letter more, are
    looked at if their masks differ in two bits at most, and compared letter by letter. A group of more than ``group`` words is divided by
    bands of the bits left, up to ``DEPTH`` times, and then by what a deleted letter leaves; no pair is lost or found twice.
    Tasks give a row for a word, never pairs.

    Defined cases: null and empty texts have no words; a null id is empty in the hash; rows that repeat count each;
    ties of n go to the word that is smaller by code points; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms lead to an end")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, text, doc_id, length, every).filter(F.col("n") >= often), "words")
    near = scratch.save(near_words(words, scratch, group), "near")
    out = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    fits = F.col("form_n") >= times * F.col("n")
    out = scratch.save(out.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}), "forms")
    top = out.agg(F.max("n").alias("n")).first().n or 1
    longest = 1 + int(math.log(top / often, times)) if top > often else 1  # each form has ``times`` the n of its word
    roots = _roots(out.filter("form is not null"), scratch, longest)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
