"""Exact dedup by Golomb-coded fingerprint exchange.

Each sender (a stretch of one scan partition) sorts the fingerprints of its normalised
texts and sends every owner of a fingerprint range one Rice-coded list of the distinct
ones. Owners answer each list with a bitmap of the fingerprints that occur more than
once anywhere. The hits set the bits of a filter of fixed size, which every task holds; only texts
that pass it leave their task, and Spark groups them by the whole normalised text, byte by
byte. A false hit of the filter is a group of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, materialise, query, table

FINGERPRINT_BITS = 52
SENDER_ROWS = 1 << 20
ROWS_PER_OWNER = 1 << 22
# Bits of the filter of suspects, 8 MB at any input size, in pieces of 2**15.
FILTER_BITS, PIECE_BITS = 26, 15
WHITE_SPACE = "\t\n\x0b\x0c\r "


def rice_parameter(span: int, n: int) -> int:
    """Low bits kept verbatim for ``n`` sorted values spread over ``span``."""
    return max(0, int(span // max(n, 1)).bit_length() - 1)


def rice_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sorted distinct values as (unary quotients, k-bit remainders) of their gaps."""
    if not len(values):
        return b"", b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(ends[-1] + 1, np.uint8)
    unary[ends] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes(), np.packbits(low.astype(np.uint8)).tobytes()


def rice_decode(unary: bytes, low: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


_MESSAGE = pa.schema([("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("k", pa.int32()),
                      ("unary", pa.binary()), ("low", pa.binary()), ("again", pa.binary())])


def _sender(owner_bits: int):
    span_bits = FINGERPRINT_BITS - owner_bits

    def messages(part: int, seq: int, chunk: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(chunk), return_counts=True)
        owners = (values >> np.uint64(span_bits)).astype(np.int32)
        cols: list[list] = [[] for _ in _MESSAGE]
        for owner in np.unique(owners):
            mine = owners == owner
            local = values[mine] & np.uint64((1 << span_bits) - 1)
            k = rice_parameter(1 << span_bits, len(local))
            unary, low = rice_encode(local, k)
            row = (int(owner), part << 32 | seq, len(local), k, unary, low,
                   np.packbits(counts[mine] > 1).tobytes())
            for c, v in zip(cols, row):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE)], schema=_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, chunk, held = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                chunk.append(b.column(0).to_numpy().astype(np.uint64))
                held += b.num_rows
            if held >= SENDER_ROWS:
                yield messages(part, seq, chunk)
                seq, chunk, held = seq + 1, [], 0
        if held:
            yield messages(part, seq, chunk)
    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of the fingerprints of one range that occur more than once."""
    lists = [rice_decode(r.unary, r.low, r.n, r.k) for r in group.itertuples()]
    again = [np.unpackbits(np.frombuffer(r.again, np.uint8), count=r.n).astype(bool) for r in group.itertuples()]
    every, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    hit = counts > 1
    hit[where[np.concatenate(again)]] = True
    flags = np.split(hit[where], np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"owner": group.owner, "sender": group.sender,
                         "bitmap": [np.packbits(f).tobytes() for f in flags]})


def _suspects(owner_bits: int):
    span_bits = FINGERPRINT_BITS - owner_bits
    schema = pa.schema([("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                values = rice_decode(r["unary"], r["low"], r["n"], r["k"])
                hit = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)
                out = values[hit].astype(np.int64) + (r["owner"] << span_bits)
                yield pa.RecordBatch.from_arrays([pa.array(out)], schema=schema)
    return run


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def fingerprint(norm: Column) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit((1 << FINGERPRINT_BITS) - 1))


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Distinct values of the one column ``fp`` that more than one row has."""
    owner_bits = max(4, (rows // ROWS_PER_OWNER).bit_length())
    sent = materialise(map_arrow(fingerprints, _sender(owner_bits),
                                 "owner int, sender long, n int, k int, unary binary, low binary, again binary"),
                       "golomb")
    answers = sent.groupBy("owner").applyInPandas(_answer, "owner int, sender long, bitmap binary")
    return map_arrow(sent.join(answers, ["owner", "sender"]), _suspects(owner_bits), "fp long").distinct()


def _bits(fp: Column) -> tuple[Column, Column]:
    """(piece of the filter, bit within it) of a fingerprint: its low bits, as the high ones choose the owner."""
    place = fp.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return F.shiftright(place, PIECE_BITS), place.bitwiseAND(F.lit((1 << PIECE_BITS) - 1))


def suspect_texts(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """(doc_id, n_chars, norm) of the rows of ``docs`` whose fingerprint is, or shares its bit of the
    filter with, one of ``suspects`` (fp). The broadcast has at most 2 ** FILTER_BITS bits."""
    piece, bit = _bits(F.col("fp"))
    held = suspects.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_held"))
    norm = normalised(F.col("text"))
    piece, bit = _bits(F.col("fp"))
    byte = F.conv(F.hex(F.substring("_held", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    chars = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return (docs.select("doc_id", "text", fingerprint(norm).alias("fp")).join(F.broadcast(held), (piece == F.col("_piece")) & hit)
            .select("doc_id", chars.alias("n_chars"), norm.alias("norm")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without ASCII white space. The row with the most code
    points, then the smallest doc_id, stays; of rows that are the same in both, one stays.
    Null text counts as empty, so empty, null and blank texts form one group. A null
    doc_id sorts after every other. An empty table gives no rows; other columns are not read.
    """
    norm = normalised(F.col("text"))
    facts = materialise(
        docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                    F.sha2(norm, 256).alias("text_sha256"), fingerprint(norm).alias("fp")), "exact-facts")
    suspects = repeated_fingerprints(facts.select("fp"), facts.count())
    texts = suspect_texts(docs, suspects)
    first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("first")
    # Grouping by the text itself is the byte check; partial aggregation leaves one row
    # per text and task, so a large group of copies is not shuffled as such.
    groups = (texts.groupBy("norm").agg(first, F.count(F.lit(1)).alias("group_size"))
              # never null, said so that no null check of the digest moves below the filter
              .select(F.coalesce(F.sha2("norm", 256), F.lit("")).alias("text_sha256"), "first", "group_size"))
    same = Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("n_chars"))
    rows = facts.withColumn("nth", F.row_number().over(same)).join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                       (keep.eqNullSafe(F.col("doc_id")) & (F.col("nth") == 1)).alias("kept"),
                       "text_sha256", "n_chars")


_ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM g
"""


@query("op9_exact_dedup", _ORACLE)
def op9_exact_dedup(spark, sf_dir):
    """Exact dedup of the whole documents table, dropped rows included."""
    return exact_dedup(table(spark, sf_dir, "documents"))
