"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so all documents together are described
by a histogram of that many counters. Best-fit decreasing runs on the histogram: a
segment tree over remaining capacities finds the tightest open bin in logarithmic
time, and documents of equal length that meet bins in an equal state are placed as one
run. The plan has a bounded number of runs; every piece then finds its own place from
its length and its rank among pieces of that length, with no piece passing the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, materialise, query, rebatch, table
from tickvault.llm.tokens import ENCODERS, encoder

CAPACITY = 2048
END_ID = 0
ROWS_PER_RANK_BUCKET = 250_000
# Characters encoded at a time: an executor's heap leaves its Python workers little memory.
BATCH_CHARS = 1 << 20


class CapacityTree:
    """Counts of open bins by remaining capacity, with the tightest fit by descent."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = self.leaves + capacity
        while node:
            self.total[node] += bins
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size`` that an open bin has."""
        node = self.leaves + size
        if self.total[node]:
            return size
        while node > 1:
            if not node & 1 and self.total[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.total[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, first bin, items per bin, offset): best-fit decreasing over
    a histogram of sizes. Rank r of a size lies in bin first + (r - first rank) // per."""
    tree, bins_of, runs, opened = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            bins_of.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room = capacity
                first, n = opened, -(-left // (capacity // size))
                opened += n
            else:
                first, n = bins_of[room].pop()
                tree.add(room, -n)
            per = min(room // size, left)
            used = min(n, left // per)
            runs.append((size, rank, first, per, capacity - room))
            put(room, first + used, n - used)
            put(room - per * size, first, used)
            rank, left = rank + used * per, left - used * per
    return np.array(runs, np.int64).reshape(-1, 5)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True).encode
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for some in rebatch(rows, lambda r: len(r[1] or ""), BATCH_CHARS):
            out: list[list] = [[] for _ in _PIECES]
            for (doc, _), ids in zip(some, encode([t or "" for _, t in some])):
                view, n = memoryview(np.append(ids, end)).cast("B"), len(ids) + 1
                at = 0
                for piece in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if piece == 0 else capacity
                    values = doc, piece, at, length, zlib.crc32(view[4 * at:4 * (at + length)])
                    for c, v in zip(out, values):
                        c.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)
    return run


def _place(runs: np.ndarray, capacity: int):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = runs[:, 0] << 40 | runs[:, 1]
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            nth = rank - r[:, 1]
            arrays = [b.column(f.name) for f in _PIECES]
            arrays += [pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id."""
    return map_arrow(docs.select("doc_id", "text"), _cut(tokenizer_path, capacity, end_id),
                     "doc_id long, piece int, start long, length long, ids_crc32 long", using=ENCODERS)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Null and empty texts are one piece of just the end id. Only documents longer than
    ``capacity`` are cut; the first piece takes the remainder. A null doc_id and repeated
    rows are packed like any other. An empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id), "packing-pieces")
    # At most `capacity` rows, whatever the number of documents.
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = plan(histogram, capacity)
    total = sum(histogram.values())
    # Ranks within a length: a length that very many pieces share is ranked by hash buckets.
    buckets = max(8, total // ROWS_PER_RANK_BUCKET)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (bucketed.groupBy("length", "bucket").count()
             .select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (bucketed.withColumn("nth", F.row_number().over(inside)).join(bases, ["length", "bucket"])
              .withColumn("rank", F.col("base") + F.col("nth") - 1))
    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _place(runs, capacity),
                     "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
