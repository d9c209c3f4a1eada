"""SimHash near-duplicates, linked through a hierarchical index in Gray order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayflow.llm.anchors import WordCodes
from assayflow.llm.common import LOWER, Scratch, keep_rows, row_key
from assayflow.llm.components import connected_components
from assayflow.llm.near import digest, near_components, shingle_set, shingle_sets

SEED = 42
#: Bits that differ at most between linked fingerprints. Each level of the routing below makes one block more than this.
DISTANCE = 3
#: Widths of the blocks at each level of routing: 64 bits are cut in four, then the 48 others in four, and so on.
WIDTHS = (16, 12, 9, 7, 5)
#: Members of a group from which it is routed one level deeper.
GROUP = 1024
#: Children of a node of the tree: two neighbours in Gray order, which share more bits than any larger group.
FAN = 2
#: Wide fingerprints: of how many pairs at the similarity one may be missed, and words of 64 bits that a row takes to the trees.
MISS, CARRIED = 1e-5, 4
#: Members of a block pattern's group, on average, and the least width of a block of a wide fingerprint.
CROWD, NARROW = 64, 4
#: Block patterns that are routed in one pass: their shuffle is smaller than the texts.
PASS = 24
#: Rows summed in bytes at a time, and the mixing of a shingle for each word of a wide fingerprint.
_PIECE = 255
_SPREAD, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: bit i is set if it is in over half of the shingles' XXH64, repeats included."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(grams: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of 64-bit shingles in so many words: a bit is set if it is in over half of the shingles' hashes."""
    lanes = (np.arange(1, words + 1, dtype=np.uint64) * _SPREAD) | np.uint64(1)
    counts = np.zeros(words * 64, np.int64)
    for at in range(0, len(grams), _PIECE):
        x = grams[at : at + _PIECE, None] * lanes
        x ^= x >> np.uint64(32)
        x *= _STIR
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(0).view(np.uint8)  # eight counts of up to 255 in a word
    return np.packbits(counts * 2 > len(grams), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id, k1, k2, fp``: one row per input row; fp holds the 64 bits in a signed long. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(text, doc_id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


# ---------------------------------------------------------------- the index
def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order, where neighbours differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(keys: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(mask, pattern, first child) of the nodes of each level, the codes themselves first, one root for each key last.

    A node factors out the bits that all codes below it share. Below a root these are the key's bits at least: nodes
    gather neighbours in Gray rank within a key, and never span two.
    """
    of = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
    ones = both = codes
    levels = [(np.full(len(codes), ~np.uint64(0)), codes, np.zeros(0, np.int64))]
    while len(of) > of[-1] + 1:
        place = np.arange(len(of)) - np.r_[0, np.flatnonzero(np.diff(of)) + 1][of]
        first = np.flatnonzero(place % FAN == 0)
        ones, both = np.bitwise_or.reduceat(ones, first), np.bitwise_and.reduceat(both, first)
        mask = ~(ones ^ both)
        levels.append((mask, both & mask, np.r_[first, len(of)]))
        of = of[first]
    return levels


def _spans(levels: list[tuple[np.ndarray, ...]], label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least and greatest label below the nodes of each level."""
    spans = [(label, label)]
    for _, _, first in levels[1:]:
        spans.append((np.minimum.reduceat(spans[-1][0], first[:-1]), np.maximum.reduceat(spans[-1][1], first[:-1])))
    return spans


def index_links(keys: np.ndarray, codes: np.ndarray, distance: int = DISTANCE, tally: dict[str, int] | None = None, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of codes of one key within the distance, in parts. Codes are sorted by key, then Gray rank.

    Pairs of nodes descend together from the root of their key. A pair adds the differences in the bits that both nodes
    share and those above them don't; one whose accumulated differences exceed the distance is pruned with
    all that is below it. ``tally`` counts pairs of two nodes seen and pruned above the codes. Where codes have a
    ``label`` already, pairs of nodes with one label between them are left out: links there add nothing.
    """
    levels = _levels(keys, codes)
    spans = None if label is None else _spans(levels, label)
    top = np.flatnonzero(np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]) > 1)  # roots of more than one code
    work = [(len(levels) - 1, top, top, np.zeros(len(top), np.int64), np.zeros(len(top), np.uint64))] if len(levels) > 1 else []
    while work:
        level, left, right, spent, seen = work.pop()
        if len(left) > 1 << 18:  # bounded memory: halves, one after the other
            half = len(left) // 2
            work += [(level, left[:half], right[:half], spent[:half], seen[:half]), (level, left[half:], right[half:], spent[half:], seen[half:])]
            continue
        if level == 0:
            yield left, right
            continue
        first, (mask, pattern, _) = levels[level][2], levels[level - 1]
        i = (first[left][:, None] + np.arange(FAN)).repeat(FAN, axis=1)
        j = np.tile(first[right][:, None] + np.arange(FAN), FAN)
        at = np.flatnonzero((i < first[left + 1][:, None]) & (j < first[right + 1][:, None]) & ((i < j) if level == 1 else (i <= j)))
        i, j, up = i.ravel()[at], j.ravel()[at], at // (FAN * FAN)
        shared = mask[i] & mask[j]
        total = spent[up] + _popcount((pattern[i] ^ pattern[j]) & shared & ~seen[up])
        open_ = total <= distance
        if spans is not None:
            low, high = spans[level - 1]
            open_ &= np.minimum(low[i], low[j]) < np.maximum(high[i], high[j])
        keep = np.flatnonzero(open_)
        if tally is not None and level > 1:
            tally["seen"], tally["pruned"] = tally.get("seen", 0) + int((i < j).sum()), tally.get("pruned", 0) + len(i) - len(keep)
        if len(keep):
            work.append((level - 1, i[keep], j[keep], total[keep], shared[keep]))


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels in which the ends of every edge, and all that already shared a label, share the least one."""
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != (up := label[label])).any():
            label = up
        if (before == label).all():
            return label


def group_forest(keys: np.ndarray, codes: np.ndarray, distance: int = DISTANCE, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each key, what is linked there: one per member at most. Each key has a tree of its own."""
    order = np.lexsort((gray_rank(codes), keys))
    keys, codes = keys[order], codes[order]
    label, left, right = np.arange(len(keys)), [], []
    for a, b in index_links(keys, codes, distance, tally):
        left.append(a)
        right.append(b)
        if sum(map(len, left)) > 1 << 18:  # links become labels before they grow beyond bounds
            label, left, right = _join_labels(label, np.concatenate(left), np.concatenate(right)), [], []
    if left:
        label = _join_labels(label, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return codes[moved], codes[label[moved]]


def _within(codes: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of wide codes at the distance or nearer."""
    near = np.flatnonzero(_popcount(codes[a] ^ codes[b]).sum(1, dtype=np.int64) <= distance)
    return a[near], b[near]


def wide_forest(keys: np.ndarray, codes: np.ndarray, near: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of rows that connect, within each key, codes of several words at the distance; one edge for each row at most.

    First neighbours in the Gray order of either of the first two words are joined, which makes one label of most of a large group of copies.
    Then the tree over the first words, which differ in up to ``near`` bits, finds all pairs of two labels.
    """
    label = np.arange(len(keys))
    for word in codes.T[:2]:
        order = np.lexsort((gray_rank(word), keys))
        for step in (1, 2, 3):
            a, b = order[:-step], order[step:]
            same = keys[a] == keys[b]
            a, b = _within(codes, a[same], b[same], distance)
            if len(a):
                label = _join_labels(label, a, b)
    order = np.lexsort((gray_rank(codes[:, 0]), label, keys))
    found = label
    for a, b in index_links(keys[order], codes[order, 0], near, label=label[order]):
        a, b = _within(codes, order[a], order[b], distance)
        if len(a):
            found = _join_labels(found, a, b)
    moved = np.flatnonzero(found != np.arange(len(keys)))
    return moved, found[moved]


# ---------------------------------------------------------------- distribution
def _rest(bits: Column, block: Column, width: int) -> Column:
    """The bits with one block taken out."""
    low = bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), block * width) - 1)
    high = F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", bits, block * width), F.lit(width))
    return F.call_function("shiftleft", high, block * width).bitwiseOR(low)


def _route(rows: DataFrame, level: int) -> DataFrame:
    """Four rows for each of ``(key, bits, fp)``: under one block of the bits each, with the other bits left."""
    width = WIDTHS[level]
    spread = rows.withColumn("block", F.explode(F.array(*(F.lit(i) for i in range(DISTANCE + 1)))))
    value = F.call_function("shiftrightunsigned", F.col("bits"), F.col("block") * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    key = F.shiftleft(F.shiftleft("key", 2).bitwiseOR(F.col("block").cast("long")), width).bitwiseOR(value)
    return spread.select(key.alias("key"), _rest(F.col("bits"), F.col("block"), width).alias("bits"), "fp")


def _forest(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(k, f):
            a, b = group_forest(k, f.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            codes = np.concatenate([codes, batch.column(1).to_numpy()])
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on in the next batch
            if cut >= 1 << 15:
                yield edges(keys[:cut], codes[:cut])
                keys, codes = keys[cut:], codes[cut:]
        if len(keys):
            yield edges(keys, codes)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprint_edges(distinct: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints at the distance or nearer.

    Two such codes share one of four 16-bit blocks: these shared patterns are the index's top nodes, and a
    code is routed to its own four only. A node with too many codes is replaced by the four nodes below
    each code's other bits, where the same holds again; at the last level a node has room for 2^15 codes.
    So no group is unbounded, and none is dropped. What is routed to a task is sorted by node and Gray rank, and
    the trees below these nodes are searched together; a task emits a forest, never its pairs.
    """
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("bits"), "fp")
    found = None
    for level in range(len(WIDTHS)):
        rows = scratch.save(_route(rows, level), f"route-{level}")
        large = rows.groupBy("key").count().filter(F.col("count") > group).select("key")
        last = level == len(WIDTHS) - 1 or large.isEmpty()
        part = _forest(rows if last else rows.join(large, "key", "left_anti"))
        found = part if found is None else found.union(part)
        if last:
            return found
        rows = rows.join(large, "key", "left_semi")


def differing_share(similarity: float) -> float:
    """The share of bits that differ at most, on average, between sets of this Jaccard similarity.

    It is the angle between sets of one size as a share of pi; sets of few shingles, where halves are ties, come to a
    quarter more (0.1875 for four shingles and a fifth at 0.8, where the angle gives 0.152).
    """
    return 1.25 * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def differing_most(bits: int, share: float) -> int:
    """So many of the bits differ at most, but for one pair in 1 / ``MISS``."""
    rest = 1.0
    for n in range(bits):
        rest -= math.comb(bits, n) * share**n * (1 - share) ** (bits - n)
        if rest < MISS:
            return n
    return bits


def block_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(width, blocks) of wide fingerprints for so many rows: a pair at the similarity differs in every block once in 1 / ``MISS``."""
    width = max(NARROW, math.ceil(math.log2(max(1, rows) / CROWD)))
    return width, math.ceil(math.log(MISS) / math.log1p(-((1 - differing_share(similarity)) ** width))) if similarity < 1 else 1


def _wide_prints(docs: DataFrame, text: str, doc_id: str, shingle: int, words: int) -> DataFrame:
    """``none, k1, k2, fp, code`` of every row: fp names the set of its shingles. An empty set has no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordCodes()
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", of, shingle) for t in batch.column(3).cast(pa.large_binary())]
            fp = np.array([digest(x) for x in sets], np.uint64).view(np.int64)
            codes = pa.array([wide_fingerprint(x, words).view(np.int64) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp), codes], ["none", "k1", "k2", "fp", "code"])

    rows = docs.select(F.col(doc_id).cast("long").isNull().alias("none"), *row_key(text, doc_id), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "none boolean, k1 long, k2 long, fp long, code array<long>")


def _wide_route(codes: DataFrame, blocks: range, width: int) -> DataFrame:
    """A row for each of ``(fp, code)`` and block: under the block's pattern, with the first words of the code."""
    names = ["key", "fp", *(f"w{i}" for i in range(CARRIED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bits = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(len(batch), -1).view(np.uint64).T)
            carried = [pa.array(x.view(np.int64)) for x in bits[:CARRIED]]
            for block in blocks:
                word, low = divmod(block * width, 64)
                value = bits[word] >> np.uint64(low)
                if low + width > 64:
                    value = value | (bits[word + 1] << np.uint64(64 - low))
                key = (value & np.uint64((1 << width) - 1)) | np.uint64(block << width)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), *carried], names)

    return codes.select("fp", "code").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _wide_forest(rows: DataFrame, near: int, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows):
            moved, to = wide_forest(rows[0], np.ascontiguousarray(rows[2:].T).view(np.uint64), near, distance)
            return pa.RecordBatch.from_arrays([pa.array(rows[1][moved]), pa.array(rows[1][to])], ["a", "b"])

        held = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= 1 << 15 and held[-1].shape[1]:
                rows = np.concatenate(held, axis=1)
                cut = np.searchsorted(rows[0], rows[0, -1])  # the last key may go on in the next batch
                if cut:
                    yield edges(rows[:, :cut])
                held = [rows[:, cut:]]
        if held and sum(x.shape[1] for x in held):
            yield edges(np.concatenate(held, axis=1))

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def wide_edges(codes: DataFrame, scratch: Scratch, width: int, blocks: int, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect all ``(fp, code)`` whose sets have the similarity, and others whose codes are as near.

    The patterns of the blocks are the index's top nodes, below which a tree in Gray order searches the words carried along.
    A pattern has a tree of its own, so a row of a large group has an edge for each block, to another root each. Of these it
    keeps the one to the least root, to which the other roots go: most rows then have one edge, and roots share theirs.
    """
    share = differing_share(similarity)
    near, distance = differing_most(64, share), differing_most(64 * CARRIED, share)
    found = None
    for at in range(0, blocks, PASS):
        part = scratch.save(_wide_forest(_wide_route(codes, range(at, min(at + PASS, blocks)), width), near, distance), f"edges-of-{at}")
        found = part if found is None else found.union(part)
    ups = found.groupBy("a").agg(F.collect_set("b").alias("ups"))  # one for each block at most
    least = F.array_min("ups")
    each = ups.select("a", least.alias("least"), F.explode("ups").alias("b"))
    return each.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def _linked(docs: DataFrame, text: str, doc_id: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``fp, least, root`` of each fingerprint: its least id, and its component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, text, doc_id, shingle), "prints")
    codes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = connected_components(fingerprint_edges(codes, scratch), scratch)
    linked = codes.join(roots, codes.fp == roots.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return prints, scratch.save(linked, "linked")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every input row.

    Fingerprints link at three differing bits or fewer; ``component_id`` is the least id among all rows
    that can be reached over links. Copies share a fingerprint and are one vertex.

    Defined cases: a null or empty text has fingerprint zero, which links like any other; a null id never
    names a component unless all ids of the component are null; repeated rows each give a row; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    prints, linked = _linked(docs, text, doc_id, shingle)
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group, with all its columns: that of the least id, and of several the least key.

    Rows link if the sets of their word shingles have this Jaccard similarity or more; links are transitive.
    At 0.8 some ten of 64 bits differ, up to twenty, where three would find few. So fingerprints are wide: of as many
    blocks as it takes that a pair at the similarity shares one, but for one in 1 / ``MISS``. A row is routed to the
    patterns of all its blocks, below which trees in Gray order link the codes that are near in ``CARRIED`` words; star contraction
    makes groups of them, and within these the sets themselves are compared.

    Defined cases: texts without words, null ones included, are one group; a null id counts as greater than any;
    of rows that repeat id and text one stays; an empty table gives none; clashing columns stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "near")
    width, blocks = block_plan(docs.count(), similarity)
    words = max(CARRIED, -(-width * blocks // 64))
    prints = scratch.save(_wide_prints(docs, text, doc_id, shingle, words), "prints")
    codes = scratch.save(prints.filter(F.size("code") > 0).groupBy("fp").agg(F.min(F.struct("k1", "k2", "code")).alias("row")).select("fp", "row.*"), "codes")
    groups = scratch.save(connected_components(wide_edges(codes, scratch, width, blocks, similarity), scratch), "groups")
    groups = groups.select(F.col("vertex").alias("fp"), F.col("root").alias("key"))
    sets = scratch.save(shingle_sets(docs, codes.join(groups, "fp").select("fp", "k1", "k2"), text, doc_id, shingle), "sets")
    members = scratch.save(groups.join(sets.select("fp", "sketch"), "fp").select("key", "fp", "sketch"), "members")
    roots = near_components(members, sets.select("fp", "grams"), scratch, similarity)
    order = F.struct("none", "k1", "k2")
    named = prints.join(roots, prints.fp == roots.vertex, "left").select(F.coalesce("root", "fp").alias("root"), order.alias("row"))
    kept = named.groupBy("root").agg(F.min("row").alias("row"))
    return keep_rows(docs, kept.select("row.k1", "row.k2"), text, doc_id)
