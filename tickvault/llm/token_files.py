"""Token-id shards in patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. Its image is

    header    magic, block size, documents, blocks, ids
    documents doc_id and id count of each
    index     byte offset of each block
    blocks    minimum, width, exceptions, then the packed low bits of id - minimum,
              the positions of the exceptions and their high bits

The width of a block is that of a percentile of its differences; ids that need more
bits are patched from the exception list. Spark writes the images as a binary column,
since executors have no common file system but Spark's own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, materialise, query, rebatch, shuffle_partitions, table
from tickvault.llm.tokens import ENCODERS, encoder

BLOCK = 256
PERCENTILE = 95
SHARD_IDS = 1 << 20
END_ID = 1
MAGIC = b"PFOR"
_HEADER = struct.Struct("<4sIQQQ")
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2")])
# Blocks whose bits are taken apart at a time.
SLAB = 1024


def _bit_widths(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)


def _slabs(width: np.ndarray):
    """(width, its kind of whole number, some blocks of that width), for all widths above 0."""
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for a in range(0, len(rows), SLAB):
            yield w, "<u2" if w <= 16 else "<u4", rows[a:a + SLAB]


def _nth(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each exception its block and its number there."""
    block = np.repeat(np.arange(len(counts)), counts)
    return block, np.arange(len(block)) - (np.cumsum(counts) - counts)[block]


def write_shard(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """The image of one shard. A null doc_id is written as the smallest 64-bit number."""
    n_blocks = -(-len(ids) // BLOCK)
    pad = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    pad[:len(ids)] = ids
    grid = pad.reshape(-1, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    rank = (BLOCK * PERCENTILE) // 100 - 1
    width = _bit_widths(np.partition(diff, rank, axis=1)[:, rank])
    at, where = np.nonzero(diff >> width[:, None].astype(np.uint32) > 0)
    heads = np.zeros(n_blocks, _BLOCK_HEAD)
    heads["low"], heads["width"] = low, width
    heads["patches"] = patches = np.bincount(at, minlength=n_blocks)
    sizes = _BLOCK_HEAD.itemsize + BLOCK * width // 8 + 5 * patches
    index = np.cumsum(sizes) - sizes
    body = np.empty(int(sizes.sum()), np.uint8)
    body[index[:, None] + np.arange(_BLOCK_HEAD.itemsize)] = heads.view(np.uint8).reshape(-1, _BLOCK_HEAD.itemsize)
    start = index + _BLOCK_HEAD.itemsize
    for w, kind, rows in _slabs(width):
        bits = np.unpackbits(diff[rows].astype(kind).view(np.uint8), bitorder="little")
        bits = bits.reshape(len(rows), BLOCK, -1)[:, :, :w].reshape(len(rows), -1)
        body[start[rows][:, None] + np.arange(BLOCK * w // 8)] = np.packbits(bits, axis=1)
    _, nth = _nth(patches)
    list_ = (start + BLOCK * width // 8)[at]
    body[list_ + nth] = where
    high = (diff[at, where] >> width[at].astype(np.uint32)).astype("<u4")
    body[(list_ + patches[at] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    docs = np.array([np.iinfo(np.int64).min if d is None else d for d in doc_ids], "<i8")
    return b"".join([_HEADER.pack(MAGIC, BLOCK, len(doc_ids), n_blocks, len(ids)), docs.tobytes(),
                     np.array(counts, "<u8").tobytes(), index.astype("<u8").tobytes(), body.tobytes()])


def read_shard(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of one shard."""
    magic, size, n_docs, n_blocks, n_ids = _HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = _HEADER.size
    doc_ids = np.frombuffer(image, "<i8", n_docs, at)
    counts = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    index = np.frombuffer(image, "<u8", n_blocks, at + 16 * n_docs).astype(np.int64)
    body = at + 16 * n_docs + 8 * n_blocks
    raw = np.frombuffer(image, np.uint8)
    heads = raw[(body + index)[:, None] + np.arange(_BLOCK_HEAD.itemsize)].reshape(-1).view(_BLOCK_HEAD)
    width, patches = heads["width"].astype(np.int64), heads["patches"].astype(np.int64)
    start = body + index + _BLOCK_HEAD.itemsize
    grid = np.zeros((n_blocks, size), np.uint32)
    for w, kind, rows in _slabs(width):
        lines = raw[start[rows][:, None] + np.arange(size * w // 8)]
        bits = np.zeros((len(rows), size, 8 * np.dtype(kind).itemsize), np.uint8)
        bits[:, :, :w] = np.unpackbits(lines, axis=1).reshape(len(rows), size, w)
        grid[rows] = np.packbits(bits.reshape(-1), bitorder="little").view(kind).reshape(len(rows), size)
    block, nth = _nth(patches)
    list_ = (start + size * width // 8)[block]
    high = raw[(list_ + patches[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    grid[block, raw[list_ + nth]] |= high << width[block].astype(np.uint32)
    return doc_ids, counts, (grid + heads["low"][:, None]).ravel()[:n_ids]


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                    ("image", pa.binary())])


def _writer(path: str, end_id: int):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path, spaced=False).encode, TaskContext.get().partitionId(), 0
        docs, counts, held = [], [], []

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [part], [seq], [len(docs)], [len(ids)], [write_shard(docs, counts, ids)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _SHARD)], schema=_SHARD)

        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for some in rebatch(rows, lambda r: len(r[1] or ""), 1 << 23):
            for (doc, _), ids in zip(some, encode([t or "" for _, t in some])):
                docs.append(doc)
                counts.append(len(ids) + 1)
                held += [ids, end]
            if sum(counts) >= SHARD_IDS:
                yield shard()
                seq, docs, counts, held = seq + 1, [], [], []
        if docs:
            yield shard()
    return run


_BACK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()),
                   ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, image in zip(*(c.to_pylist() for c in b.columns)):
            docs, counts, ids = read_shard(image)
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
            n = len(docs)
            no_id = docs == np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, mask=no_id),
                 pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=_BACK)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """The written shards (part, seq, n_docs, n_ids, image); (part, seq) is document order."""
    spark = docs.sparkSession
    ordered = (docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id"))
    shards = map_arrow(ordered, _writer(tokenizer_path, end_id),
                       "part int, seq int, n_docs long, n_ids long, image binary", using=ENCODERS)
    return materialise(shards, "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document, from the images: doc_id, start among all ids, n_tokens, ids_crc32."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per range partition; the sums before each are exact in one small window.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = (shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within"))
             .join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("within")).alias("base")))
    back = map_arrow(shards.select("part", "seq", "image"), _reader,
                     "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return back.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    """Ids of all documents written as shards in doc_id order and read back.

    Null and empty texts are the end id alone; a null doc_id comes first; rows with equal
    ids stay beside each other in any order; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))
