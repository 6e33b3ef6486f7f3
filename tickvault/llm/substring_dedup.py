"""Removal of repeated byte strings by bucket-pointer refinement.

A string of ``LENGTH`` bytes is found through its anchor, the q-gram within it that hashes
lowest: equal strings have equal anchors at equal offsets, so only strings whose anchor
occurs in several documents need comparing.

1. Texts are dealt into blocks. Each block sends every owner of a hash range its distinct
   anchors as one Rice-coded list and gets a bitmap of the repeated ones.
2. Each block sends the bytes around its repeated anchors, each distinct stretch once with
   the least doc_id that has it, to the owner of the anchor.
3. An owner sorts all positions of its stretches into buckets by their first bytes and
   refines the buckets by the bucket pointers of later offsets, each pass reusing the
   pointers the passes before have updated, until two positions share a bucket exactly if
   their ``LENGTH`` bytes are equal. The least doc_id of each bucket goes back.
4. Each block removes the strings that some document with a smaller doc_id has.

A string that very many documents share costs one entry per block, not one per document.
An anchor with over ``HOT_RUNS`` stretches (a phrase shorter than ``LENGTH`` bytes in many
contexts) is taken apart in steps 2 to 4: each of its strings goes by itself to the owner of
the string's own hash, so that all owners share the work of that anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvault.llm.common import forget, give_back, query, shuffle_partitions, table, volume
from tickvault.llm.exact_dedup import rice_parameter

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 8 << 20
OWNER_BYTES = 4 << 20
SLICE = 1 << 16
SLICE_ROWS = 1 << 15
HASH_BITS = 40
HOT_RUNS = 1 << 16
COUNTED = 4
NO_ID = np.iinfo(np.int64).max


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    v = _words(raw)
    h = v[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ v[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _string_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings at these positions of the bytes whose ``_words`` are given."""
    h = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def anchored_runs(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: (hash of the anchor, first start, number of starts).

    ``starts`` are the offsets of the texts in ``raw``, its length last; strings never cross texts.
    """
    span = length - GRAM + 1
    out: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, max(0, len(raw) - length + 1), SLICE):
        part = raw[a:a + SLICE + length - 1]
        n = len(part) - length + 1
        h = _gram_hashes(part) if len(part) > 16 else np.zeros(0, np.uint64)
        h = np.append(h, np.zeros(len(part) - GRAM + 1 - len(h), np.uint64))
        ordered = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        low, width = ordered, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width:span - width + n])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.append(True, anchor[1:] != anchor[:-1])
        cuts = starts[np.searchsorted(starts, a):np.searchsorted(starts, a + n)] - a
        first[cuts] = True
        begin = np.flatnonzero(first)
        # Of a run within a text, the starts count whose strings end within the text too.
        last = starts[np.minimum(np.searchsorted(starts, begin + a, "right"), len(starts) - 1)] - a - length
        usable = np.minimum(np.append(begin[1:], n) - 1, last) - begin + 1
        some = usable > 0
        # Anchors have low hashes; mixed again, they spread over the owners' ranges evenly.
        mixed = (h[anchor[begin[some]]] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((mixed ^ (mixed >> np.uint64(29)), begin[some] + a, usable[some]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _joined(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of texts or byte strings, their length last, all their bytes), as Arrow has them beside each other."""
    values = pa.concat_arrays([c.cast(pa.large_binary()).fill_null(b"") for c in values.chunks] or [pa.array([], pa.large_binary())])
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of ``data`` cut at these offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])


def _ends(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums: where parts of these sizes begin and end."""
    return np.append(0, np.cumsum(counts, dtype=np.int64))


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` numbers from ``begins[i]`` on, for each i in turn."""
    ends = _ends(counts)
    return np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])


def _cut(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the strings at these positions, one after the other."""
    return np.concatenate([np.zeros(0, np.uint8), *[raw[_spread(at[a:a + SLICE_ROWS], sizes[a:a + SLICE_ROWS])]
                                                    for a in range(0, len(at), SLICE_ROWS)]])


def _pack(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of flags in parts of these sizes, each from a byte of its own on; offsets of the parts)."""
    at = _ends((counts + 7) // 8)
    bits = np.zeros(8 * at[-1], np.uint8)
    bits[_spread(8 * at[:-1], counts)] = flags
    return np.packbits(bits), at


def _unpack(data: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The flags whose bits begin at these bytes."""
    return np.unpackbits(data)[_spread(8 * begins, counts)].astype(bool)


def code_lists(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    """Lists of sorted distinct values, one after the other, each Rice-coded: (unary quotients of gaps, their k low bits)."""
    ends = _ends(counts)
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[ends[:-1]] = values[ends[:-1]]
    stop = _ends((gaps >> np.uint64(k)).astype(np.int64) + 1)
    at = _ends((np.diff(stop[ends]) + 7) // 8)
    unary = np.zeros(8 * at[-1], np.uint8)
    unary[stop[1:] - 1 + np.repeat(8 * at[:-1] - stop[ends[:-1]], counts)] = 1
    # Each list begins at a row whose number divides by 8, and so with a byte of its own.
    rows = _ends((counts + 7) // 8 * 8)
    spaced = np.zeros(rows[-1], "<u8")
    spaced[_spread(rows[:-1], counts)] = gaps
    low = [np.zeros(0, np.uint8)]
    for a in range(0, len(spaced), SLICE_ROWS):
        bits = np.unpackbits(spaced[a:a + SLICE_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low.append(np.packbits(bits[:, :k], bitorder="little"))
    return _binary(np.packbits(unary), at), _binary(np.concatenate(low), rows // 8 * k)


def decode_lists(unary: pa.ChunkedArray, low: pa.ChunkedArray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The values of lists of these sizes, one after the other."""
    at, data = _joined(unary)
    stop = np.flatnonzero(np.unpackbits(data))
    heads = _ends(counts)[:-1][counts > 0]
    gaps = np.diff(stop, prepend=-1) - 1
    gaps[heads] = stop[heads] - 8 * at[:-1][counts > 0]
    at, data = _joined(low)
    each = np.repeat(k, counts)
    bit = np.repeat(8 * at[:-1], counts) + _spread(np.zeros(len(counts), np.int64), counts) * each
    words = _words(np.append(data, np.zeros(8, np.uint8)))
    each = each.astype(np.uint64)
    gaps = gaps.astype(np.uint64) << each | words[bit >> 3] >> (bit & 7).astype(np.uint64) & ((np.uint64(1) << each) - np.uint64(1))
    sums = np.cumsum(gaps, dtype=np.uint64)
    return sums - np.repeat(sums[heads] - gaps[heads], counts[counts > 0])


def _same(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, owners: np.ndarray | None = None, owner_bits: int = 0
          ) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings at these positions, sorted by owner; where in it a new one begins).

    Strings of one group are equal byte by byte. Equal ones can be in two groups, if their hash
    is that of another string; the order depends on the strings and their places alone.
    """
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,))
    steps = range(0, int(sizes.max(initial=0)), 8)
    h = sizes.astype(np.uint64)
    live = np.arange(len(at))
    for k in steps:
        live = live[sizes[live] > k]
        x = (h[live] ^ words[at[live] + np.minimum(k, sizes[live] - 8)]) * np.uint64(0x9E3779B97F4A7C15)
        h[live] = x ^ (x >> np.uint64(32))
    if owners is not None:
        h = h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(owner_bits) | owners.astype(np.uint64) << np.uint64(64 - owner_bits)
    order = np.argsort(h, kind="stable")
    h, at, sizes = h[order], at[order], sizes[order]
    if not len(order):
        return order, order
    like = np.flatnonzero((h[1:] == h[:-1]) & (sizes[1:] == sizes[:-1]))
    live = np.arange(len(like))
    equal = np.ones(len(like), bool)
    for k in steps:
        live = live[sizes[like[live]] > k]
        i = like[live]
        step = np.minimum(k, sizes[i] - 8)
        equal[live] &= words[at[i] + step] == words[at[i + 1] + step]
    new = np.ones(len(order), bool)
    new[like[equal] + 1] = False
    return order, np.flatnonzero(new)


def _covered(begins: np.ndarray, length: int) -> np.ndarray:
    """Whether any of the last ``length`` marks up to each place is set."""
    out, width = begins.copy(), 1
    while width < length:
        step = min(width, length - width)
        out[step:] |= out[:-step]
        width += step
    return out


class Block:
    """The texts of one block as bytes in a row. Rows come in any order from a shuffle, so they are
    sorted: where slices cut runs must be the same in every step."""

    def __init__(self, rows: pa.Table, length: int):
        self.rows = rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.length = length
        self.ids = rows.column("doc_id").to_numpy()
        self.starts, self.raw = _joined(rows.column("text"))
        self.hashes, self.first, self.count = anchored_runs(self.raw, self.starts, length)
        self.doc = self.ids[np.searchsorted(self.starts, self.first, "right") - 1]

    def anchors(self, owner_bits: int) -> tuple[np.ndarray, ...]:
        """(runs in the order of their anchors, distinct anchors, number of runs of each, owners that have
        any, number of anchors of each owner)."""
        short = self.hashes >> np.uint64(64 - owner_bits - HASH_BITS)
        order = np.argsort(short, kind="stable")
        h = short[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
        values = h[begin]
        owners, counts = np.unique((values >> np.uint64(HASH_BITS)).astype(np.int64), return_counts=True)
        return order, values, np.diff(np.append(begin, len(h))), owners, counts

    def repeats(self, owner_bits: int, repeated: pa.Table) -> tuple[np.ndarray, ...]:
        """(owners of the distinct stretches in order, their sizes, their rows of ``places`` one stretch after
        the other, how many rows each has).

        A string of a hot anchor is a stretch of its own.
        """
        order, values, runs, owners, counts = self.anchors(owner_bits)
        said = np.zeros(len(values), bool)
        hot = said.copy()
        known = repeated.column("owner").to_numpy()
        if len(known) and len(owners):
            near = np.minimum(np.searchsorted(known, owners), len(known) - 1)
            found = known[near] == owners
            mine, near, n = np.repeat(found, counts), near[found], counts[found]
            at, data = _joined(repeated.column("data"))
            said[mine] = _unpack(data, at[near], n)
            at, data = _joined(repeated.column("runs"))
            if len(data):
                any_ = (at[1:] > at[:-1])[near]
                mine[mine] = np.repeat(any_, n)
                hot[mine] = _unpack(data, at[near[any_]], n[any_])
        whole = order[np.repeat(said & ~hot, runs)]
        split = np.sort(order[np.repeat(said & hot, runs)])
        n = self.count[split]
        at = _spread(self.first[split], n)
        self.places = np.append(self.first, at)
        self.place_doc = np.append(self.doc, np.repeat(self.doc[split], n))
        sizes = np.append(self.count + (self.length - 1), np.full(len(at), self.length))
        to = (self.hashes >> np.uint64(64 - owner_bits)).astype(np.int64)
        if len(at):
            mixed = _string_hashes(_words(self.raw), at, self.length) * np.uint64(0xD6E8FEB86659FD93)
            to = np.append(to, (mixed >> np.uint64(64 - owner_bits)).astype(np.int64))
        rows = np.append(whole, np.arange(len(self.first), len(self.places)))
        order, begin = _same(self.raw, self.places[rows], sizes[rows], to[rows], owner_bits)
        rows = rows[order]
        return to[rows[begin]], sizes[rows[begin]], rows, np.diff(np.append(begin, len(rows)))

    def stretches(self, owner_bits: int, repeated: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, sizes of its distinct stretches, one row of ``places`` of each, the least doc_id of each)."""
        owners, sizes, rows, counts = self.repeats(owner_bits, repeated)
        if not len(owners):
            return
        begin = _ends(counts)[:-1]
        rows, least = rows[begin], np.minimum.reduceat(self.place_doc[rows], begin)
        cuts = np.append(np.flatnonzero(np.append(True, owners[1:] != owners[:-1])), len(owners))
        for a, e, owner in zip(cuts[:-1].tolist(), cuts[1:].tolist(), owners[cuts[:-1]].tolist()):
            yield owner, sizes[a:e], rows[a:e], least[a:e]


def refine(text: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of all positions of ``text``: equal exactly where ``length`` bytes are.

    Positions too near the end for that many bytes get pointers of no meaning.
    """
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    grams = _words(np.append(text, np.zeros(length + 8, np.uint8)))[:n]
    order = np.argsort(grams, kind="stable").astype(np.int32)
    grams = grams[order]
    pointer = np.empty(n, np.int32)
    pointer[order] = np.maximum.accumulate(np.where(np.append(True, grams[1:] != grams[:-1]), place, 0))
    del grams, order
    known = 8
    while known < length:
        offset = min(known, length - known)
        open_ = np.flatnonzero((np.bincount(pointer, minlength=n) > 1)[pointer]).astype(np.int32)
        if not len(open_):
            break
        # Both pointers as one number: sorting it sorts a bucket by the buckets of later offsets.
        both = pointer[open_].astype(np.int64) << 32 | pointer[np.minimum(open_ + offset, n - 1)]
        order = np.argsort(both, kind="stable")
        at, both = open_[order], both[order]
        del open_, order
        key = both >> 32
        first = np.append(True, key[1:] != key[:-1])
        new = np.append(True, both[1:] != both[:-1])
        # A sub-bucket is named by its first place within its bucket's range of places.
        inside = place[:len(at)]
        begin = np.maximum.accumulate(np.where(first, inside, 0))
        pointer[at] = key + np.maximum.accumulate(np.where(new, inside, 0)) - begin
        known += offset
    return pointer


def _string_starts(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, position in the joined text) of every string start of stretches of these sizes."""
    counts = sizes - length + 1
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return of, inside + (np.cumsum(sizes) - sizes)[of]


def _shared(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the hash of the string at each position occurs at another one too."""
    h = _string_hashes(_words(text), at, length)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(at), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def least_ids(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each string start of each stretch in turn, the least id of a stretch with that string.

    The stretches have these sizes and lie in ``text`` one after the other. Strings with a hash of
    their own are equal to no other; buckets are refined over the stretches that hold any of the rest.
    """
    of, at = _string_starts(sizes, length)
    least = ids[of]
    shared = _shared(text, at, length)
    some = np.unique(of[shared])
    if len(some):
        inner, at = _string_starts(sizes[some], length)
        pointer = refine(_cut(text, _ends(sizes)[some], sizes[some]), length)[at]
        order = np.argsort(pointer, kind="stable")
        groups = np.flatnonzero(np.append(True, np.diff(pointer[order]) != 0))
        found = np.empty(len(at), np.int64)
        found[order] = np.repeat(np.minimum.reduceat(ids[some[inner]][order], groups),
                                 np.diff(np.append(groups, len(order))))
        within = np.zeros(len(sizes), bool)
        within[some] = True
        least[within[of]] = found
    return least


_LISTS = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("k", pa.int32()),
                    ("unary", pa.binary()), ("low", pa.binary()), ("again", pa.binary()), ("more", pa.binary())])
_ENTRIES = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("sizes", pa.binary()), ("bytes", pa.binary()),
                      ("ids", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()),
                    ("runs", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _columns(schema: pa.Schema, length: int, **columns) -> pa.Table:
    """A table of ``length`` rows; a single number stands for a column of it."""
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.broadcast_to(c, length), f.type)
                                 for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def _send_anchors(length: int, owner_bits: int):
    def run(rows: pa.Table) -> pa.Table:
        block, b = rows.column("block")[0].as_py(), Block(rows, length)
        order, values, runs, owners, counts = b.anchors(owner_bits)
        if not len(owners):
            return _table([], _LISTS)
        k = rice_parameter(1 << HASH_BITS, len(values) // len(owners))
        unary, low = code_lists(values & np.uint64((1 << HASH_BITS) - 1), counts, k)
        # Runs lie in the order of their documents, and so do those of one anchor.
        ends, doc = _ends(runs), b.doc[order]
        several = doc[ends[:-1]] != doc[ends[1:] - 1]
        # Numbers of runs matter only where they are large in sum: small ones count as one.
        cuts = _ends(counts)
        some = np.flatnonzero(runs >= COUNTED)
        list_ = np.searchsorted(cuts, some, "right") - 1
        more = np.stack([some - cuts[list_], runs[some] - 1], axis=1).astype("<u4")
        return _columns(_LISTS, len(owners), owner=owners, block=block, n=counts, k=k, unary=unary, low=low,
                        again=_binary(*_pack(several, counts)),
                        more=_binary(more, 8 * _ends(np.bincount(list_, minlength=len(owners)))))
    return run


def _repeated_anchors(hot_runs: int):
    """Per list, a bitmap of its repeated anchors, and one of the hot ones if the owner has any."""
    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy().astype(np.int64)
        values = decode_lists(group.column("unary"), group.column("low"), n, group.column("k").to_numpy().astype(np.int64))
        _, where, counts = np.unique(values, return_inverse=True, return_counts=True)
        hit = counts > 1
        at, data = _joined(group.column("again"))
        hit[where[_unpack(data, at[:-1], n)]] = True
        at, data = _joined(group.column("more"))
        more = np.frombuffer(data.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
        of = more[:, 0] + np.repeat(_ends(n)[:-1], np.diff(at) // 8)
        hot = counts + np.bincount(where[of], more[:, 1], len(counts)) > hot_runs
        runs = _binary(*_pack(hot[where], n)) if hot.any() else pa.nulls(len(n), pa.binary())
        return _columns(_REPLY, len(n), block=group.column("block").to_numpy(), owner=group.column("owner").to_numpy(), kind=0,
                        data=_binary(*_pack(hit[where], n)), runs=runs)
    return run


def _of_kind(replies: pa.Table, kind: int) -> pa.Table:
    return replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("owner")


def _bitmaps(replies: pa.Table) -> pa.Table:
    return _of_kind(replies, 0)


def _send_stretches(length: int, owner_bits: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _ENTRIES)
        block = rows.column("block")[0].as_py()
        b = Block(rows, length)
        out = []
        for owner, sizes, at, least in b.stretches(owner_bits, _bitmaps(replies)):
            out.append((owner, block, sizes.astype("<u2").tobytes(), _cut(b.raw, b.places[at], sizes).tobytes(),
                        least.astype("<i8").tobytes()))
        return _table(out, _ENTRIES)
    return run


def _owner(length: int):
    def run(group: pa.Table) -> pa.Table:
        at, data = _joined(group.column("sizes"))
        lists = np.diff(at) // 2
        sizes = np.frombuffer(data.tobytes(), "<u2").astype(np.int64)
        ids = np.frombuffer(_joined(group.column("ids"))[1].tobytes(), "<i8")
        text = _joined(group.column("bytes"))[1]
        order, begin = _same(text, _ends(sizes)[:-1], sizes)
        one, of = order[begin], np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        text, ids = _cut(text, _ends(sizes)[one], sizes[one]), np.minimum.reduceat(ids[order], begin)
        least = least_ids(text, sizes[one], ids, length)
        # Each stretch's ids as runs of equal ones: a run ends where the id or the stretch does.
        ends = _ends(sizes[one] - length + 1)
        new = np.append(True, least[1:] != least[:-1])
        new[ends[:-1]] = True
        cut = np.flatnonzero(new)
        bound = np.searchsorted(cut, ends)
        counts = np.diff(bound)[of]
        sent = _spread(bound[of], counts)
        rows = _ends(counts)[_ends(lists)]
        return _columns(_REPLY, len(lists), block=group.column("block").to_numpy(), owner=group.column("owner").to_numpy(), kind=1,
                        data=_binary(least[cut][sent].astype("<i8"), 8 * rows),
                        runs=_binary(np.diff(np.append(cut, len(least)))[sent].astype("<u2"), 2 * rows))
    return run


def _remove(length: int, owner_bits: int, with_text: bool, carried: list[str]):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(rows, length)
        _, sizes, at, counts = b.repeats(owner_bits, _bitmaps(replies))
        least = _of_kind(replies, 1)
        ids = np.frombuffer(_joined(least.column("data"))[1].tobytes(), "<i8")
        runs = np.frombuffer(_joined(least.column("runs"))[1].tobytes(), "<u2").astype(np.int64)
        # Runs of ids of each stretch, and those of its places.
        ends, begin = _ends(sizes - length + 1), _ends(runs)
        if ends[-1] != begin[-1]:
            raise ValueError("answers of owners do not fit the stretches of the block")
        bound = np.searchsorted(begin, ends)
        inside = begin[:-1] - np.repeat(ends[:-1], np.diff(bound))
        many = np.repeat(np.diff(bound), counts)
        run_ = _spread(np.repeat(bound[:-1], counts), many)
        place = np.repeat(at, many)
        hit = ids[run_] < b.place_doc[place]
        run_, place = run_[hit], b.places[place[hit]]
        # Every string start lies in one place only, so marking the starts of removed strings is enough,
        # and no two runs begin or end at the same one.
        step = np.zeros(len(b.raw) + length, np.int8)
        step[place + inside[run_]] += 1
        step[place + inside[run_] + runs[run_]] -= 1
        begins = np.cumsum(step, dtype=np.int8).view(bool)
        # A byte goes if a removed string begins at it or less than `length` bytes before it.
        gone = _covered(begins, length)[:len(b.raw)]
        out = []
        for doc, a, e in zip(b.ids.tolist(), b.starts[:-1].tolist(), b.starts[1:].tolist()):
            cut = gone[a:e]
            kept = b.raw[a:e][~cut].tobytes()
            spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (e > a and cut[0]))
            out.append((None if doc == NO_ID else doc, e - a, int(cut.sum()), spans,
                        kept.decode("utf-8", "ignore") if with_text else None, hashlib.sha256(kept).hexdigest()))
        result = _table(out, _RESULT)
        for name in carried:
            result = result.append_column(name, b.rows.column(name))
        return result
    return run


def _alone(fn):
    """``fn`` of a group, in a worker that keeps nothing of other operators or of other groups."""
    def run(rows: pa.Table) -> pa.Table:
        forget()
        out = fn(rows)
        give_back()
        return out
    return run


def _alone_with(fn):
    """The same for a group and what it is grouped with."""
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        out = fn(rows, replies)
        give_back()
        return out
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True,
                   carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256 and the
    columns named in ``carried``.

    Every UTF-8 byte covered by a string of ``length`` bytes (32 at least) that also starts
    in a document with a smaller doc_id is removed; strings are judged on the input. Null
    text counts as empty; texts shorter than ``length`` stay whole; rows that share a doc_id
    do not remove each other's strings; a null doc_id counts as the largest. An empty table
    gives no rows; other columns are not read. The digest is that of the kept bytes;
    ``kept_text`` leaves out the rest of code points that a removed string has cut.
    """
    spark = docs.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    _, size = volume(docs, "text")
    n_blocks = max(shuffle_partitions(spark), size // BLOCK_BYTES)
    owner_bits = max(4, (size // OWNER_BYTES).bit_length())
    # One shuffle of the texts; the three steps that need them read the same exchange.
    texts = (docs.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text", *carried)
             .withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)))
             .repartition(n_blocks, "block"))
    lists = texts.groupBy("block").applyInArrow(_alone(_send_anchors(length, owner_bits)), _ddl(_LISTS))
    repeated = lists.groupBy("owner").applyInArrow(_alone(_repeated_anchors(HOT_RUNS)), _ddl(_REPLY))
    stretches = (texts.groupBy("block").cogroup(repeated.groupBy("block"))
                 .applyInArrow(_alone_with(_send_stretches(length, owner_bits)), _ddl(_ENTRIES)))
    answers = stretches.groupBy("owner").applyInArrow(_alone(_owner(length)), _ddl(_REPLY))
    ddl = ", ".join([_ddl(_RESULT), *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]])
    return (texts.groupBy("block").cogroup(repeated.unionByName(answers).groupBy("block"))
            .applyInArrow(_alone_with(_remove(length, owner_bits, with_text, list(carried))), ddl))


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    """Repeated 50-byte strings removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
