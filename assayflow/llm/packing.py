"""Length buckets of least padding, and batches of a token budget inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayflow.llm.common import Scratch, empty_if_null

BUDGET, BUCKETS = 32_768, 16
#: Rows of a bucket that are numbered together.
SHARD = 2000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over the histogram, with the least total padding.

    best[k][j] = min over i of best[k-1][i] + length[j] (n[j] - n[i]), n being counts so far: the cost of i is
    a line in length[j], lines come by falling slope and queries by rising length, so each row of the table
    takes one pass over a convex hull.
    """
    order = np.argsort(lengths)
    x = [max(1, int(v)) for v in np.asarray(lengths)[order]]
    n = [0, *np.cumsum(np.asarray(counts)[order]).tolist()]
    m = len(x)
    if not m:
        return []
    best = [0] + [None] * m  # cost of padded tokens of the first j lengths, None: can't be
    came: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        now: list = [None] * (m + 1)
        back = [0] * (m + 1)
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-n[j - 1], best[j - 1], j - 1)
                while len(hull) - at >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            if len(hull) > at:
                while len(hull) - at >= 2 and hull[at + 1][0] * x[j - 1] + hull[at + 1][1] <= hull[at][0] * x[j - 1] + hull[at][1]:
                    at += 1
                slope, base, i = hull[at]
                now[j], back[j] = base + slope * x[j - 1] + x[j - 1] * n[j], i
        came.append(back)
        # Fewer buckets may already be enough, so a row also keeps what the last one reached.
        if best[m] is not None and best[m] <= now[m]:
            came.pop()
            break
        best = [None, *now[1:]]
    bounds, j = [], m
    for back in reversed(came):
        if j == 0:
            break
        bounds.append(x[j - 1])
        j = back[j]
    return sorted(set(bounds))


def token_lengths(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens``: words, or the tokens of a tokenizer file that every executor can open at that path."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text).cast("string")).alias("text"))
    if tokenizer is None:
        return rows.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(tokenizer)
        encode.encode_special_tokens = True
        for batch in batches:
            n = [len(e.ids) for at in range(0, batch.num_rows, 64) for e in encode.encode_batch(batch.column(1)[at : at + 64].to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """Batches of padded rows: ``doc_id, n_tokens, bucket, bucket_length, batch, position, padding``.

    The histogram of all lengths goes to the driver (a row per length), where dynamic programming places the
    bucket bounds that minimise padding. A batch has budget // bucket_length rows of one bucket, and only the
    last one of a bucket has fewer. Rows get running numbers: within shards of a bucket of some ``shard`` rows
    each, whose sizes are then summed; so no bucket, however full, is sorted in one task.

    Defined cases: a null or empty text has no tokens and is padded to one; a text longer than the budget is
    a batch by itself; null ids stay; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.save(token_lengths(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = rows.groupBy("n_tokens").count().collect()
    bounds = optimal_boundaries(np.array([r.n_tokens for r in histogram]), np.array([r["count"] for r in histogram]), buckets)
    sizes = [0] * len(bounds)
    for r in histogram:
        sizes[int(np.searchsorted(bounds, r.n_tokens))] += r["count"]
    array = lambda values: F.array(*(F.lit(int(v)).cast("long") for v in values)) if values else F.array().cast("array<long>")
    bucket = F.size(F.filter(array(bounds), lambda b: b < F.col("n_tokens")))
    of = lambda values: F.element_at(array(values), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("row"), of([-(-n // shard) for n in sizes])))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row")) - 1)
    each = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = each.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).drop("n")
    number = F.col("before") + F.col("number")
    room = [max(1, budget // b) for b in bounds]
    return (
        rows.join(before, ["bucket", "shard"])
        .withColumn("number", number)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            of(bounds).alias("bucket_length"),
            F.expr("number div 1").alias("number"),
            of(room).alias("room"),
        )
        .selectExpr("doc_id", "n_tokens", "bucket", "bucket_length", "number div room as batch", "number % room as position", "bucket_length - n_tokens as padding")
    )
