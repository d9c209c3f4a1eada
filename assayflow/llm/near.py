"""Sets of word shingles, and the exact comparison of groups of them by Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayflow.llm.anchors import WordCodes, sequence_hashes
from assayflow.llm.common import LOWER, Scratch, row_key
from assayflow.llm.components import stars

#: Least hashes of a sketch.
HASHES = 288
#: Least hashes whose two bits differ at most between sets that are compared: at 0.8 some 43 of 288 do, 6 more or less.
FAR = 71
#: Members of a group up to which all its components are compared at once.
SMALL = 8
#: Members of a larger group, on average, that one task compares with the group's leaders.
TILE = 512
_R = np.random.default_rng(42)
_ODD, _ADD = (_R.integers(0, 1 << 64, (HASHES, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_MIX = _R.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1)
#: Shingles hashed at a time.
_PIECE = 4096


def shingle_set(text: bytes, code: WordCodes, shingle: int = 5) -> np.ndarray:
    """The 64-bit hashes of the word shingles of a UTF-8 text, sorted, each once; a shorter text is one shingle."""
    words = text.translate(LOWER).split()
    return np.unique(sequence_hashes(code.of(words), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def least_hashes(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(grams), _PIECE):
        np.minimum(least, (grams[at : at + _PIECE] * _ODD + _ADD).min(1), out=least)
    return least ^ (least >> np.uint64(31))


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each least hash, 32 of them in a long."""
    two = (least * _MIX) >> np.uint64(62)
    return (two.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64)


def _differing(x: str, y: str) -> Column:
    """How many least hashes differ in their two bits."""
    total = F.lit(0)
    for i in range(HASHES // 32):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.call_function("shiftrightunsigned", d, F.lit(1))).bitwiseAND(F.lit(0x5555555555555555).cast("long"))
        total = total + F.bit_count(d)
    return total


def digest(grams: np.ndarray) -> int:
    """What names a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes())


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """``fp, grams, sketch`` for the rows named by ``wanted(fp, k1, k2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCodes()
        for batch in batches:
            grams = [shingle_set(t.as_py() or b"", code, shingle) for t in batch.column(1).cast(pa.large_binary())]
            sketches = [sketch(least_hashes(x)).view(np.int64) for x in grams]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in grams], longs), pa.array(sketches, longs)], ["fp", "grams", "sketch"])

    rows = docs.select(*row_key(text, doc_id), F.col(text).cast("string").alias("text")).join(wanted, ["k1", "k2"])
    return rows.select("fp", "text").mapInArrow(run, "fp long, grams array<long>, sketch array<long>").dropDuplicates(["fp"])


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, j`` of the distinct pairs: the exact similarity. Many pairs may share an a, which has one row in ``sets``."""
    both = pairs.select("a", "b").distinct().join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a")
    common: Column = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", "x", "y", common.alias("c")).select("a", "b", (F.col("c") / (F.size("x") + F.size("y") - F.col("c"))).alias("j"))


def _leaders(rows: DataFrame, leaders: int, count: int) -> DataFrame:
    """``key, fp, root, sketch, last, n``: who leads each group of ``rows``: where ``last`` names a component, all outside it, else one of each of some so many components."""
    group = ("key", "root", "n", "parts", "low", "last")
    chosen = (F.pmod(F.xxhash64("root", F.lit(count)), F.col("parts")) < leaders) | (F.col("low") == F.col("root"))
    first = F.min(F.struct(F.xxhash64("fp", F.lit(count)).alias("place"), "fp", "sketch")).alias("first")
    some = rows.filter(F.col("last").isNull() & chosen).groupBy(*group).agg(first).select("key", "first.fp", "root", "first.sketch", "last", "n")
    return some.union(rows.filter("root <> last").select("key", "fp", "root", "sketch", "last", "n"))


def near_components(members: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, small: int = SMALL) -> DataFrame:
    """``vertex, root``: the components of all pairs of a group of ``members(key, fp, sketch)`` at the similarity or above.

    In each round some leaders of a group are compared with its other members and leave it: whom they link is
    then known. Between the rounds components are joined, and a group ends once all that is left of it is in
    one component, as a link among those adds nothing. The first round has one leader, which settles a group
    of mutual copies; then those with up to ``small`` members are compared across their components at once,
    and larger ones by a leader for each of some 16, 1024, 65536 and so on components, or by all members outside the
    largest component once these are as few, which ends the group. So no pair that could join two
    components is left out, and groups of thousands of copies take a few comparisons for each member. A root has no row of its own.
    """
    roots, leaders, kept = None, 1, ("key", "fp", "root", "sketch")
    for count in range(64):
        rows = members.withColumn("root", F.col("fp")) if roots is None else members.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("lead"))
        live = parts.groupBy("key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("parts"), F.min("lead").alias("lead"), F.min("root").alias("low"), F.max(F.struct("size", "root")).alias("top")).filter("parts > 1")
        live = live.withColumn("last", F.when(F.col("n") - F.col("top.size") <= leaders, F.col("top.root"))).drop("top")
        rows = scratch.save(rows.join(live, "key"), f"rows-{count}")
        if count:
            scratch.drop(f"rows-{count - 1}", f"leaders-{count - 1}")
        if roots is not None and rows.isEmpty():
            return roots.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        other = (F.col("x.root") != F.col("y.root")) & (_differing("x.sketch", "y.sketch") <= FAR)
        edges = None
        if count < 2:
            few = rows.filter("fp = lead") if count == 0 else rows.filter(F.col("n") <= small)
            compared = rows if count == 0 else few
            pairs = compared.alias("y").join(few.alias("x"), (F.col("x.key") == F.col("y.key")) & other)
            edges = _scored(pairs.select(F.least("x.fp", "y.fp").alias("b"), F.greatest("x.fp", "y.fp").alias("a")), sets).filter(F.col("j") >= similarity).select("a", "b")
            led = few.select("key", "fp")
        if count:  # members of large groups bring their sets along, and the join itself compares them; a group's tiles are compared apart
            many = rows.filter(F.col("n") > small) if count == 1 else rows
            picked = scratch.save(_leaders(many, leaders, count), f"leaders-{count}")
            led = picked.select("key", "fp") if count > 1 else led.union(picked.select("key", "fp"))
            x = picked.join(sets, "fp").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / TILE) - 1))).repartition("key", "tile")
            y = many.select(*kept, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE)).alias("tile")).join(sets, "fp").repartition("key", "tile")
            same = (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") == F.col("y.tile"))
            once = F.col("x.last").isNull() | (F.col("y.root") == F.col("x.last")) | (F.col("x.fp") < F.col("y.fp"))
            common = F.size(F.array_intersect("x.grams", "y.grams"))
            near = common >= similarity * (F.size("x.grams") + F.size("y.grams") - common)
            found = y.alias("y").join(x.alias("x"), same & once & other & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
            edges = found if edges is None else edges.union(found)
        edges = scratch.save(edges, f"edges-{count}")
        members = rows.select("key", "fp", "sketch").join(led, ["key", "fp"], "left_anti")
        if roots is None or not edges.isEmpty():  # all pairs were of two components, so an edge joins some
            roots = stars(edges if roots is None else edges.union(roots), scratch, f"stars-{count}")
        scratch.drop(f"edges-{count}")
        leaders = 16 if count == 0 else 64 * leaders
    raise RuntimeError("groups did not end")
