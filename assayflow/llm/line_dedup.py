"""Repeated lines: a sharded minimal perfect hash over line hashes, probed by blocks of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assayflow.llm.anchors import keyed
from assayflow.llm.common import LOWER, Scratch

#: Code points of a line's key at least, and documents that hold it from which it is common.
LENGTH, COMMON = 40, 5
#: Keys that one shard of the index holds, about; line hashes in a block of documents, about.
SHARD, BLOCK = 1 << 17, 1 << 18

_BLANK = b" \t\n\x0b\x0c\r"
#: A line's hash: 64 bits that choose shard and slot, and 32 that are its fingerprint in the slot.
HASH = np.dtype([("h", "<u8"), ("f", "<u4")])
_HELD = np.dtype([("h", "<u8"), ("f", "<u4"), ("n", "<u4"), ("top", "<i8")])
_HIT = np.dtype([("h", "<u8"), ("f", "<u4"), ("top", "<i8")])
#: Stands for a null id, below all others.
_NO_ID = np.iinfo(np.int64).min


def line_hash(line: bytes, length: int) -> bytes | None:
    """96 bits of a line's key, None where the key is too short to count."""
    import xxhash

    key = line.strip(_BLANK)
    if len(key) < length or (len(key) < 4 * length and len(key.decode("utf-8", "replace")) < length):
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER))[:12]


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys["h"] ^ (keys["f"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct keys, as levels of bits.

    Each level has two bits for each key left. A key whose bit no other key wants is settled there, the rest go on
    to the next level; a key's slot is the number of settled bits before its own. About four bits a key in all.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.r_[0, np.cumsum(np.bitwise_count(bits))].astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = (_mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 or another key's slot for a key that wasn't among those built from."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (_mixed(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, start = left[~hit], start + size
        return out


def _by_shard(rows: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (rows["h"] >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for part in np.split(np.arange(len(rows)), cuts):
        if len(part):
            yield int(shard[part[0]]), rows[part]


def _combined(rows: np.ndarray) -> np.ndarray:
    """One row per key: documents that hold it, and the largest id among them."""
    rows = rows[np.lexsort((rows["f"], rows["h"]))]
    if not len(rows):
        return rows
    new = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["f"][1:] != rows["f"][:-1])]
    at = np.flatnonzero(new)
    out = rows[at]
    out["n"], out["top"] = np.minimum(np.add.reduceat(rows["n"].astype(np.int64), at), 0xFFFFFFFF), np.maximum.reduceat(rows["top"], at)
    return out


def _prints(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Per row of ``keyed``: its lines counted, its text's digest, and the distinct hashes of its lines. Rows come in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            blocks, n, sha, hashes = [], [], [], []
            for value in batch.column(1).cast(pa.large_binary()):
                text = value.as_py()
                lines = text.split(b"\n")
                own = dict.fromkeys(h for line in lines if (h := line_hash(line, length)))
                if held and held + len(own) > block:
                    number, held = number + 1, 0
                held += len(own) + 1
                blocks.append(number)
                n.append(len(lines))
                sha.append(hashlib.sha256(text).hexdigest())
                hashes.append(b"".join(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(sha), pa.array(hashes, pa.binary())],
                ["block", "doc_id", "k1", "k2", "n_lines", "sha256", "hashes"],
            )

    return rows.mapInArrow(run, "block long, doc_id long, k1 long, k2 long, n_lines long, sha256 string, hashes binary")


def _held(batch: pa.RecordBatch) -> np.ndarray:
    """The keys that a batch of ``doc_id, hashes`` holds, with how many rows hold each."""
    values = batch.column(1).to_pylist()
    out = np.zeros(sum(map(len, values)) // HASH.itemsize, _HELD)
    keys = np.frombuffer(b"".join(values), HASH)
    out["h"], out["f"], out["n"] = keys["h"], keys["f"], 1
    ids = batch.column(0).fill_null(_NO_ID).to_numpy()
    out["top"] = np.repeat(ids, [len(v) // HASH.itemsize for v in values])
    return _combined(out)


def line_index(prints: DataFrame, shards: int) -> DataFrame:
    """``shard, sizes, bits, fingerprints, counts, tops``: all distinct line hashes of ``prints(doc_id, hashes)``, by shards.

    Keys are combined in each task before they are sent, so a line that every document holds is one row of a task.
    The slot that the hash names has in it the key's fingerprint, the documents that hold it, and their largest id.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows):
            found = [(s, x.tobytes()) for s, x in _by_shard(rows, shards)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["shard", "keys"])

        rows = np.zeros(0, _HELD)
        for batch in batches:
            rows = _combined(np.concatenate([rows, _held(batch)]))
            if len(rows) > 2_000_000:
                yield sent(rows)
                rows = rows[:0]
        yield sent(rows)

    def build(table: pa.Table) -> pa.Table:
        rows = _combined(np.concatenate([np.frombuffer(x.as_py(), _HELD) for x in table.column("keys")]))
        mph = PerfectHash.of(rows)
        slots = np.empty(len(rows), np.int64)
        slots[mph.slots(rows)] = np.arange(len(rows))
        rows = rows[slots]
        cells = [mph.sizes, mph.bits, rows["f"], rows["n"], rows["top"]]
        return pa.table([table.column("shard")[:1].combine_chunks(), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)], ["shard", *_ARRAYS])

    kind = "shard int, " + ", ".join(f"{c} binary" for c in _ARRAYS)
    return prints.select("doc_id", "hashes").mapInArrow(pack, "shard int, keys binary").groupBy("shard").applyInArrow(build, kind)


_ARRAYS = ("sizes", "bits", "fingerprints", "counts", "tops")


def _probes(prints: DataFrame, shards: int) -> DataFrame:
    """``shard, block, keys``: the distinct line hashes of each block, by the shard that knows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def sent():
            keys = np.unique(np.concatenate([np.frombuffer(x, HASH) for x in held])) if held else np.zeros(0, HASH)
            found = [(s, x.tobytes()) for s, x in _by_shard(keys, shards)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], ["shard", "block", "keys"])

        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != block and held:
                    yield sent()
                    held = []
                block = number
                held.append(value)
        if held:
            yield sent()

    return prints.select("block", "hashes").mapInArrow(run, "shard int, block long, keys binary")


def _answers(index: DataFrame, probes: DataFrame, common: int) -> DataFrame:
    """``block, hits``: of each block's line hashes those that ``common`` documents or more hold, with the largest id."""

    def probe(index: pa.Table, probes: pa.Table) -> pa.Table:
        blocks, hits = [], []
        if index.num_rows:
            sizes, bits, prints, counts, tops = (np.frombuffer(index.column(c)[0].as_py(), d) for c, d in zip(_ARRAYS, ("<i8", "<u8", "<u4", "<u4", "<i8")))
            mph = PerfectHash(sizes, bits)
            for block, value in zip(probes.column("block").to_pylist(), probes.column("keys")):
                keys = np.frombuffer(value.as_py(), HASH)
                slot = mph.slots(keys)
                hit = (slot >= 0) & (prints[slot] == keys["f"]) & (counts[slot] >= common)
                if hit.any():
                    found = np.zeros(int(hit.sum()), _HIT)
                    found["h"], found["f"], found["top"] = keys["h"][hit], keys["f"][hit], tops[slot[hit]]
                    blocks.append(block)
                    hits.append(found.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "hits": pa.array(hits, pa.binary())})

    return index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(probe, "block long, hits binary")


def _drops(prints: DataFrame, answers: DataFrame) -> DataFrame:
    """``k1, k2, gone``: rows that lose lines, with the hashes of these lines."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[], [], []]
        hits = {x[:12]: int.from_bytes(x[12:], "little", signed=True) for v in answers.column("hits").to_pylist() for x in (v[i : i + _HIT.itemsize] for i in range(0, len(v), _HIT.itemsize))}
        if hits:
            for k1, k2, doc_id, value in zip(*(rows.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "hashes"))):
                own = _NO_ID if doc_id is None else doc_id
                gone = b"".join(h for h in (value[i : i + 12] for i in range(0, len(value), 12)) if hits.get(h, own) != own)
                if gone:
                    for column, x in zip(out, (k1, k2, gone)):
                        column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "gone"])

    rows = prints.filter("length(hashes) > 0").select("block", "k1", "k2", "doc_id", "hashes")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "k1 long, k2 long, gone binary")


def _without(texts: DataFrame, length: int) -> DataFrame:
    """``k1, k2, n_dropped, kept`` of texts from which the lines named in ``gone`` are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for value, drop in zip(batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()):
                gone = {drop[i : i + 12] for i in range(0, len(drop), 12)}
                lines = value.as_py().split(b"\n")
                stay = [line for line in lines if line_hash(line, length) not in gone]
                n.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_dropped", "kept"])

    return texts.select("k1", "k2", "text", "gone").mapInArrow(run, "k1 long, k2 long, n_dropped long, kept string")


class LineDedup:
    """Lines that many documents hold, found by an index of line hashes that documents probe.

    Every text is split at line feeds. A line's key is the line without white space at its ends, A-Z in lower case. Keys
    of ``length`` code points or more that ``common`` documents or more hold lose their lines, except in the document of the largest id.

    1. Each document's distinct line hashes (96 bits) are taken once, in blocks of documents.
    2. All distinct hashes, combined in each task first, go to shards of about ``shard`` keys. A shard is a minimal perfect hash
       and three arrays by slot: fingerprint, documents that hold the line, their largest id.
    3. Each block sends its distinct hashes to the shards in packets, and gets back those that are common. Lines are
       never joined: a line in all documents is one probe of each block.
    4. Only documents that lose lines meet their texts again.

    Defined cases: null and empty texts have one empty line; rows that repeat count as documents each, and share their
    result; of null ids, which are below all others, none is larger than another, so all of them keep a line that only they hold;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, common: int = COMMON, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD, block: int = BLOCK):
        self.scratch, self.rows, self.length = Scratch(docs.sparkSession, "lines"), keyed(docs, text, doc_id), length
        self.prints = self.scratch.save(_prints(self.rows, length, block), "prints")
        total = self.prints.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0)).alias("n")).first().n // HASH.itemsize
        shards = max(1, -(-total // shard))
        self.index = self.scratch.save(line_index(self.prints, shards), "index")
        answers = self.scratch.save(_answers(self.index, _probes(self.prints, shards), common), "answers")
        self.drops = self.scratch.save(_drops(self.prints, answers).dropDuplicates(["k1", "k2"]), "drops")

    def kept(self) -> DataFrame:
        """``k1, k2, n_dropped, kept``: the rows that lose lines, with what is left of their texts."""
        # Lines that go, and rows that lose them, grow with the corpus: no broadcast at any size.
        texts = self.rows.join(self.drops.hint("merge"), ["k1", "k2"])
        return _without(texts, self.length).dropDuplicates(["k1", "k2"])

    def digest(self) -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
        changed = self.kept().select("k1", "k2", "n_dropped", F.sha2("kept", 256).alias("left"))
        out = self.prints.select("k1", "k2", "doc_id", "n_lines", "sha256").join(changed.hint("merge"), ["k1", "k2"], "left")
        return out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("left", "sha256").alias("kept_sha256"))

    def texts(self) -> DataFrame:
        """``doc_id, text`` of every row, without the lines it loses."""
        out = self.rows.join(self.kept().select("k1", "k2", "kept").hint("merge"), ["k1", "k2"], "left")
        return out.select("doc_id", F.coalesce("kept", "text").alias("text"))
