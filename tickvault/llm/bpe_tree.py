"""Byte-level BPE as a monoid: halves are encoded by recursion and joined at the seam.

A part of a text is summed up by its ids. To join two neighbours, a window around the
seam is encoded again and grows until what lies outside provably stays as it is:

* between words: a pattern match always ends before white space that follows a visible
  character, and what follows there does not depend on what came before, so ids beyond
  such a place on either side are final;
* inside one long match: ids are those of the whole match exactly if every two
  neighbouring ids encode to themselves, so a window is final once the pairs at its two
  edges do.

Decoding concatenates the bytes of the ids up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickvault.llm.common import map_arrow, query, table

LEAF_CHARS = 2048
LEAF_BYTES = 512
WINDOW_CHARS = 32
WINDOW_IDS = 4

# The characters of the Unicode property White_Space.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {
    chr(c) for c in range(0x2000, 0x200b)}


class TreeEncoder:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pair_is_final: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> list[int]:
        return self._text(text, 0, len(text))

    def _text(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= LEAF_CHARS:
            return self.library.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        return self._join_text(text, a, seam, b, self._text(text, a, seam), self._text(text, seam, b))

    def _join_text(self, text: str, a: int, seam: int, b: int, left: list[int], right: list[int]) -> list[int]:
        start, end, reach = None, None, WINDOW_CHARS
        while True:
            lo, hi = max(a, seam - reach), min(b, seam + reach)
            if start is None:
                start = a if lo == a else self._last_cut(text, lo, seam)
            if end is None:
                end = b if hi == b else self._first_cut(text, seam, hi)
            if start is not None and end is not None:
                break
            reach *= 2
        middle = (self.library.encode_ordinary(text[start:end]) if end - start <= LEAF_CHARS
                  else self._matches(text[start:end]))
        n_left = self._trim(left, len(text[start:seam].encode()), from_end=True)
        n_right = self._trim(right, len(text[seam:end].encode()), from_end=False)
        del left[len(left) - n_left:]
        left += middle
        left += right[n_right:]
        return left

    @staticmethod
    def _last_cut(text: str, lo: int, hi: int) -> int | None:
        for i in range(hi - 1, max(lo, 1) - 1, -1):
            if text[i] in _SPACES and text[i - 1] not in _SPACES:
                return i
        return None

    @staticmethod
    def _first_cut(text: str, lo: int, hi: int) -> int | None:
        for i in range(lo + 1, hi):
            if text[i] in _SPACES and text[i - 1] not in _SPACES:
                return i
        return None

    def _trim(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many ids at that end hold exactly ``n_bytes``."""
        n = 0
        for i in reversed(ids) if from_end else ids:
            if not n_bytes:
                break
            n_bytes -= len(self.bytes_of[i])
            n += 1
        return n

    def _matches(self, text: str) -> list[int]:
        """A stretch that holds no cut within a leaf: each pattern match by the byte tree."""
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self._piece(m.group().encode())
        return out

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of the bytes of one pattern match."""
        if len(piece) <= LEAF_BYTES:
            return self.library._encode_single_piece(piece)
        half = len(piece) // 2
        return self._join_piece(self._piece(piece[:half]), self._piece(piece[half:]))

    def _final(self, first: int, second: int) -> bool:
        key = first, second
        if key not in self.pair_is_final:
            if len(self.pair_is_final) > 1_000_000:
                self.pair_is_final.clear()
            both = self.bytes_of[first] + self.bytes_of[second]
            self.pair_is_final[key] = self.library._encode_single_piece(both) == [first, second]
        return self.pair_is_final[key]

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        reach = WINDOW_IDS
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            middle = self.library._encode_single_piece(window)
            if (i == 0 or self._final(left[i - 1], middle[0])) and (
                    j == len(right) or self._final(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            reach *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_ENCODERS: dict[tuple[str, str], TreeEncoder] = {}


def tree_encoder(rank_path: str, pattern: str) -> TreeEncoder:
    """The encoder of this Python worker."""
    key = rank_path, pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(rank_path, pattern)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its whole text (null: none), in input partitioning."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tree_encoder(rank_path, pattern).encode
        for b in batches:
            ids = [np.array(encode(t or ""), np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, schema[1].type)], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tree_encoder(rank_path, pattern).decode
        for b in batches:
            out = [decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema[1].type), pa.array(out, pa.binary())],
                                             schema=schema)

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, ids and bytes not kept.

    Null and empty texts have no ids: both digests are those of nothing. Rows with a null
    or a repeated doc_id are encoded like any other; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_encoder(rank_path, pattern)
        for b in batches:
            out: list[list] = [[], [], []]
            for text in b.column(1).to_pylist():
                ids = coder.encode(text or "")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, out, [f.type for f in schema][1:])],
                                             schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op10_bpe_tree")
def op10_bpe_tree(spark, sf_dir):
    """Every whole text of documents encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN)
