"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes; where a token of each ends at the same byte, the two are
linked, and those places cut the text into groups. How often an id pair is linked is counted
over all documents by an inverted index: documents are numbered inside blocks of a bounded
size, and every pair of a block has compressed bitmaps of the documents that hold it, one
per binary digit of the number of its links there (multiplicity planes). The OR of a pair's
planes, popcounted, is its document count; the planes, popcounted by their weight, its links.
Blocks hold different documents, so counts of blocks add up. The scored pairs are then
joined to the bitmaps, which carry the scores back to their documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import materialise, query, table

# A block ends when it holds so many documents or bytes: positions fit 16 bits.
BLOCK_DOCS = 16_384
BLOCK_BYTES = 6_000_000
# Bytes of text handed to the tokenizers at once.
ENCODE_BYTES = 1_000_000
LONG_SPACE = re.compile(r"\s{1000}")

DOCS = "block long, pos int, n_a long, n_b long, n_groups long, n_links long, groups string"
PAIRS = "a int, b int, docs long, links long, planes array<binary>"


def _byte_values() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Coder:
    """Ids of texts, with the bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ByteLevel(Coder):
    """A byte-level vocabulary of the tokenizers library, its ids in the order of its merges;
    special tokens' strings are plain text.

    Texts are encoded by tiktoken with the file's own tokens as ranks, which gives the same ids in
    a quarter of the time. Its pattern engine overflows on very long white space, so texts with
    such a run are encoded by the tokenizers library itself."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        value = _byte_values()
        special = self.tokenizer.get_added_tokens_decoder()
        tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = token.encode() if i in special else bytes(value[c] for c in token)
        super().__init__(tokens)
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        self.plain = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(" " + t, add_special_tokens=False).ids if LONG_SPACE.search(t)
                else self.plain.encode_ordinary(" " + t) for t in texts]


class Pieces(Coder):
    """A sentencepiece vocabulary with byte fallback, which itself adds the space before a text."""

    def __init__(self, path: str):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


_CODERS: dict[tuple[str, ...], tuple[ByteLevel, Pieces, list[str]]] = {}


def coders(path_a: str, path_b: str, pattern: str) -> tuple[ByteLevel, Pieces, list[str]]:
    """The two vocabularies and their ids as text, loaded once per Python worker; they do not grow with the texts."""
    name = path_a, path_b, pattern
    if name not in _CODERS:
        a, b = ByteLevel(path_a, pattern), Pieces(path_b)
        _CODERS[name] = a, b, marked_names(a, b)
    return _CODERS[name]


def align(a: Coder, b: Coder, text: str, ids_a: list[int], ids_b: list[int]):
    """(ids of A, ids of B, where A's groups end, where B's do, linked ids of A, of B), or None
    where the tokens do not spell the text. Ends are counts of tokens."""
    raw = b" " + text.encode()
    if not text or a.joined(ids_a) != raw or b.joined(ids_b) != raw:
        return None
    ids_a, ids_b = np.fromiter(ids_a, np.int64, len(ids_a)), np.fromiter(ids_b, np.int64, len(ids_b))
    ends_a, ends_b = a.sizes[ids_a].cumsum(), b.sizes[ids_b].cumsum()
    # Tokens have at least one byte, so ends rise and each shared end is one link.
    at = np.searchsorted(ends_b, ends_a)
    at[at == len(ends_b)] = 0
    cut_a = np.flatnonzero(ends_b[at] == ends_a)
    cut_b = at[cut_a]
    return ids_a, ids_b, cut_a + 1, cut_b + 1, ids_a[cut_a], ids_b[cut_b]


def marked_names(a: Coder, b: Coder) -> list[str]:
    """The ids of A with a comma, of A with a bar, of B with a comma, of B with a semicolon."""
    return [f"{i}{mark}" for coder, last in ((a, "|"), (b, ";")) for mark in (",", last) for i in range(len(coder.tokens))]


def groups_text(a: Coder, b: Coder, names: list[str], found) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides, group by group. Every id's place is known
    from the ends of the groups, and its mark from whether it is the last of its group."""
    ids_a, ids_b, end_a, end_b, _, _ = found
    na, nb = len(ids_a), len(ids_b)
    which = np.empty(na + nb, np.int64)
    ids_a, ids_b = ids_a.copy(), ids_b + 2 * len(a.tokens)
    ids_a[end_a - 1] += len(a.tokens)
    ids_b[end_b - 1] += len(b.tokens)
    which[np.arange(na) + np.repeat(np.append(0, end_b[:-1]), np.diff(end_a, prepend=0))] = ids_a
    which[np.arange(nb) + np.repeat(end_a, np.diff(end_b, prepend=0))] = ids_b
    return "".join(map(names.__getitem__, which.tolist()))[:-1]


def compress(positions: np.ndarray, n: int) -> bytes:
    """A bitmap of documents 0 to n - 1: packed bits, or where that is shorter, the sorted
    positions in 16 bits each. The first byte tells which."""
    if 2 * len(positions) <= (n + 7) // 8:
        return b"\0" + positions.astype("<u2").tobytes()
    bits = np.zeros(n, np.uint8)
    bits[positions] = 1
    return b"\1" + np.packbits(bits).tobytes()


def positions(bitmap: bytes) -> np.ndarray:
    """The documents of a compressed bitmap."""
    if bitmap[:1] == b"\0":
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1)))


def popcount(bitmap: bytes) -> int:
    if bitmap[:1] == b"\0":
        return (len(bitmap) - 1) // 2
    return int.from_bytes(bitmap[1:], "big").bit_count()


def union(planes: list[bytes], n: int) -> bytes:
    """The OR of compressed bitmaps."""
    if len(planes) == 1:
        return planes[0]
    return compress(np.unique(np.concatenate([positions(p) for p in planes])), n)


def invert(a: np.ndarray, b: np.ndarray, pos: np.ndarray, n: int) -> Iterator[tuple]:
    """(a, b, documents, links, planes) of every pair linked in a block of n documents."""
    key = (a << 34) | (b << 16) | pos
    key, times = np.unique(key, return_counts=True)
    pair, pos = key >> 16, key & 0xFFFF
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    ends = np.append(starts[1:], len(pair))
    most = np.maximum.reduceat(times, starts) if len(starts) else starts
    for p, s, e, m in zip(pair[starts].tolist(), starts.tolist(), ends.tolist(), most.tolist()):
        held, t = pos[s:e], times[s:e]
        planes = [compress(held, n)] if m == 1 else [compress(held[(t >> k & 1) == 1], n) for k in range(m.bit_length())]
        links = sum(popcount(x) << k for k, x in enumerate(planes))
        yield p >> 18, p & 0x3FFFF, popcount(union(planes, n)), links, planes


class Block:
    """Documents of one task that get one set of bitmaps."""

    def __init__(self):
        self.rows, self.links, self.size = [], [], 0

    def add(self, carried: tuple, text: str, found, digest: str) -> None:
        pos = len(self.rows)
        if found is None:
            self.rows.append((*carried, pos, 0, 0, 0, 0, ""))
        else:
            left, right = found[4], found[5]
            self.links.append((left, right, np.full(len(left), pos, np.int64)))
            self.rows.append((*carried, pos, len(found[0]), len(found[1]), len(left), len(left), digest))
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or self.size >= BLOCK_BYTES

    def pairs(self) -> Iterator[tuple]:
        if not self.links:
            return iter(())
        a, b, pos = (np.concatenate(x) for x in zip(*self.links))
        return invert(a, b, pos, len(self.rows))


def _chunks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch, texts last, in lists of about ENCODE_BYTES."""
    held, size = [], 0
    for row in zip(*[c.to_pylist() for c in batch.columns]):
        held.append(row)
        size += len(row[-1])
        if size >= ENCODE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def align_documents(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256.

    Texts that are null or empty, or that either tokenizer does not spell byte for byte, have no
    tokens: zeros and ''. Repeated rows and null keys each count as a document of their own, as
    documents are numbered by block and position. Of equal counts, all pairs of a B id are
    best. Columns besides key and text are not read; an empty table gives no rows. Texts
    are tokenised once; rows and bitmaps are written under the checkpoint folder.
    """
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"block long, key {key_type}, pos int, n_a long, n_b long, n_groups long, n_links long, digest string, {PAIRS}"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, names = coders(path_a, path_b, pattern)
        part, done, block = TaskContext.get().partitionId() << 32, 0, Block()
        out = None

        def emit(block: Block, name: int) -> Iterator[pa.RecordBatch]:
            blank = (None,) * 5
            rows = [(name, *r, *blank) for r in block.rows]
            for at in range(0, len(rows), 4096):
                yield record(rows[at:at + 4096])
            held = []
            for p in block.pairs():
                held.append((name, None, None, None, None, None, None, None, *p))
                if len(held) == 8192:
                    yield record(held)
                    held = []
            if held:
                yield record(held)

        def record(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            if out is None:
                out = pa.schema([("block", pa.int64()), ("key", batch.schema[0].type), ("pos", pa.int32())]
                                + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
                                + [("digest", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()),
                                   ("links", pa.int64()), ("planes", pa.list_(pa.binary()))])
            for rows in _chunks(batch):
                texts = [r[-1] for r in rows]
                for row, ids_a, ids_b in zip(rows, a.encode(texts), b.encode(texts)):
                    found = align(a, b, row[-1], ids_a, ids_b)
                    text = groups_text(a, b, names, found) if found else ""
                    block.add(row[:1], row[-1], found, hashlib.sha256(text.encode()).hexdigest())
                    if block.full():
                        yield from emit(block, part + done)
                        done, block = done + 1, Block()
        if block.rows:
            yield from emit(block, part + done)

    read = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    index = materialise(read.mapInArrow(blocks, schema), "alignment-index")
    rows = index.where("pos is not null").select("block", "key", "pos", "n_a", "n_b", "n_groups", "n_links", "digest")
    postings = index.where("pos is null").select("block", "a", "b", "planes")
    scores = pair_counts(index)
    scored = postings.join(scores, ["a", "b"]).select(F.col("block").alias("part"), "planes", "links", "best")

    def gather(keys, rows: pa.Table, marks: pa.Table) -> pa.Table:
        n = rows.num_rows
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for planes, links, top in zip(*(marks.column(c).to_pylist() for c in ("planes", "links", "best"))):
            for k, plane in enumerate(planes):
                held = positions(plane)
                total[held] += links << k
                if top:
                    best[held] += 1 << k
        pos = rows.column("pos").to_numpy()
        rows = rows.drop_columns(["block", "pos"])
        return rows.append_column("n_best", pa.array(best[pos])).append_column("count_sum", pa.array(total[pos]))

    out = f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, digest string, n_best long, count_sum long"
    return (rows.groupBy("block").cogroup(scored.groupBy("part")).applyInArrow(gather, out)
            .select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                    F.col("digest").alias("groups_sha256")))


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, docs, links, best): over all blocks, the documents and links of each id pair, and
    whether no other pair of its B id has more links."""
    counts = (index.where("pos is null").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf_dir):
    """Byte-level against sentencepiece tokens of every document: groups, links and how the linked
    pairs count over the corpus."""
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
