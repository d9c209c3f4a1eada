"""Alignment of two tokenizers: which tokens of one overlap which of the other, and where both end."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.common import Scratch, empty_if_null

#: Links in a block of documents, about.
BLOCK = 1 << 21
#: Bytes of text that are encoded together, about.
TOGETHER = 1 << 20

# ---- fixed values: the byte-level alphabet's printable ranges, and its word pattern ------------------
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable ones themselves, others from U+0100 on."""
    own = [b for a, z in PRINTABLE for b in range(a, z + 1)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class ByteLevel:
    """A byte-level BPE file: ids of a text, and each id's bytes. Special tokens' strings are ordinary text.

    Where ids are in the order of the merges, as public byte-level vocabularies are, the merges' ranks alone
    encode, which is several times faster; other files, and texts that the fast way can't take, go through the file's own tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        special = {t["content"] for t in given.get("added_tokens", [])}
        letters, vocabulary = _byte_letters(), given["model"]["vocab"]
        plain = {t: bytes(letters[c] for c in t) for t in vocabulary if t not in special}
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in given.get("added_tokens", []))]) + 1)
        for t, b in plain.items():
            self.bytes[vocabulary[t]] = b
        pairs = [m.split(" ") if isinstance(m, str) else m for m in given["model"]["merges"]]
        ordered = [vocabulary.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        split = given.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not given.get("normalizer")
        self.fast = None
        if ordered and usual and len(plain) == 256 + len(pairs):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={b: vocabulary[t] for t, b in plain.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as error:  # the pattern's engine gives up on some very long runs
                if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model that puts a space before each text: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ---- intervals ---------------------------------------------------------------------------------------
def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token, the first and last B token + 1 that it overlaps. Both cut one stretch of bytes into tokens, empty ones never.

    The ends of the B tokens are the index: the token that a place stabs is the first one that ends after it. An A
    token overlaps what its first and its last byte stab, and all between.
    """
    a_starts = np.r_[0, a_ends[:-1]]
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_ends, a_ends - 1, "right") + 1


def unspanned(a_ends: np.ndarray, b_ends: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each A token, whether no token of either kind goes on over the gap behind it: there a group ends."""
    return b_ends[high - 1] == a_ends


class Groups:
    """Groups of tokens as text: A's ids, a bar, B's ids, a semicolon between groups."""

    def __init__(self, n: int):
        self.digits = np.zeros((n, 6), np.uint8)
        for i in range(n):
            text = str(i).encode()
            self.digits[i, : len(text)] = np.frombuffer(text, np.uint8)

    def text(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> bytes:
        closing = np.flatnonzero(ends)
        b_of = high[closing]  # B tokens up to the end of each group
        a_of = closing + 1
        a_group = np.searchsorted(closing, np.arange(len(a)))
        b_group = np.searchsorted(b_of, np.arange(len(b)), "right")
        cells = np.zeros((len(a) + len(b), 7), np.uint8)
        at_a = np.arange(len(a)) + np.r_[0, b_of][a_group]
        at_b = np.arange(len(b)) + a_of[b_group]
        cells[at_a, :6], cells[at_b, :6] = self.digits[a], self.digits[b]
        cells[:, 6] = ord(",")
        cells[at_a[closing], 6] = ord("|")
        cells[at_b[b_of - 1], 6] = ord(";")
        flat = cells.ravel()[:-1]
        return flat[flat != 0].tobytes()


def _align(rows: DataFrame, a_path: str, b_path: str, block: int, spans: bool) -> DataFrame:
    """A row per document: its figures, and its distinct links as codes with how many there are of each. Rows come in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        one, two = ByteLevel(a_path), Pieces(b_path)
        a_size, b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (one, two))
        groups, width = Groups(max(len(a_size), len(b_size))), len(b_size)
        number, held = TaskContext.get().partitionId() << 33, 0

        def aligned(text: str, b: list[int]) -> tuple:
            none = (0, 0, 0, 0, "", b"", b"") + ((b"",) if spans else ())
            whole = b" " + text.encode()
            if not text or b"".join(map(two.bytes.__getitem__, b)) != whole:
                return none
            a = one.encode(" " + text)
            if b"".join(map(one.bytes.__getitem__, a)) != whole:
                return none
            a, b = np.array(a), np.array(b)
            a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
            low, high = overlaps(a_ends, b_ends)
            ends = unspanned(a_ends, b_ends, high)
            n = high - low
            links = np.repeat(a, n) * width + b[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            pairs, times = np.unique(links, return_counts=True)
            text_ = groups.text(a, b, low, high, ends)
            out = (len(a), len(b), int(ends.sum()), len(links), hashlib.sha256(text_).hexdigest(), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())
            return (*out, text_) if spans else out

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal number, held
            found, blocks = [], []
            for text, b in zip(texts, two.encode(texts)):
                row = aligned(text, b)
                if held and held + row[3] > block:
                    number, held = number + 1, 0
                held += row[3] + 1
                found.append(row)
                blocks.append(number)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * spans
            cells = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(ids, pa.int64()), *cells], names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(key)
                texts.append(value.as_py())
                size += len(texts[-1])
                if size > TOGETHER:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    kind = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + (", groups string" if spans else "")
    names = [c.split(" ")[0] for c in kind.split(", ")]
    return rows.mapInArrow(run, kind)


def _block_pairs(docs: DataFrame) -> DataFrame:
    """``block, pair, n``: the distinct links of each block, with how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def sent():
            pairs, times = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*held))
            pairs, at = np.unique(pairs, return_inverse=True)
            n = np.bincount(at, weights=times).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(n)], ["block", "pair", "n"])

        for batch in batches:
            for number, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
                if number != block and held:
                    yield sent()
                    held = []
                block = number
                held.append((pairs, times))
        if held:
            yield sent()

    return docs.filter("n_links > 0").select("block", "pairs", "times").mapInArrow(run, "block long, pair long, n long")


def _with_counts(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """The documents' rows with ``n_best`` and ``count_sum``, from what is known of their block's links."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, order = np.unique(answers.column("pair").to_numpy(), return_index=True)
        count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for value, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
            at, times = np.searchsorted(pairs, np.frombuffer(value, "<u4")), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(times[best[at]].sum()) if len(at) else 0)
            count_sum.append(int((times * count[at]).sum()) if len(at) else 0)
        kept = docs.drop_columns(["block", "pairs", "times"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    kept = [f"{n} {k}" for n, k in docs.dtypes if n not in ("block", "pairs", "times")]
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ", ".join([*kept, "n_best long", "count_sum long"]))


class Alignment:
    """Two tokenizers over the same texts: ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model.

    A text's tokens of either kind cut the same bytes, a space and the text. The ends of B's tokens are a static index of
    intervals; a bisection for each A token lists what it overlaps: its links. A gap that no token spans ends a group.
    A document is encoded once, and kept as its figures and its distinct links. ``links`` counts links over all
    documents. Blocks of documents ask for the counts of their distinct links, so a link that all texts hold is one row of each block.

    Both paths are read in the tasks: they name files that every executor has.

    Defined cases: null and empty texts, and texts whose tokens don't give their bytes back (control characters that a model drops or
    replaces), have no tokens: zeros and empty groups; null ids stay; rows that repeat count each; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, spans: bool = False):
        self.scratch = Scratch(docs.sparkSession, "alignment")
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text).cast("string")).alias("text"))
        self.width = len(Pieces(b_path).bytes)
        self.docs = self.scratch.save(_align(rows, a_path, b_path, block, spans), "docs")
        self.pairs = self.scratch.save(_block_pairs(self.docs), "pairs")

    def counted(self) -> DataFrame:
        """``pair, count, best``: links over all documents; best says that no link of its B id has more."""
        counts = self.scratch.save(self.pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair") % self.width), "counts")
        top = counts.groupBy("b_id").agg(F.max("count").alias("top"))
        # One row for each id of a vocabulary: a bound that no corpus changes.
        return counts.join(F.broadcast(top), "b_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))

    def links(self) -> DataFrame:
        """``a_id, b_id, count, best`` of all pairs of ids that are linked."""
        return self.counted().select(F.floor(F.col("pair") / self.width).alias("a_id"), (F.col("pair") % self.width).alias("b_id"), "count", "best")

    def documents(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``, with ``spans`` also ``groups``."""
        answers = self.pairs.select("block", "pair").join(self.counted(), "pair")
        return _with_counts(self.docs, answers)
