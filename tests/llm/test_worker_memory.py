"""Memory that the Python workers of packing and substring dedup take beside an executor's heap."""

from __future__ import annotations

import random
import resource
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tickvault.llm import common, near_dedup, packing, substring_dedup, tokens


def test_packing_encodes_few_texts_at_a_time(monkeypatch):
    given = []

    class Coder:
        def encode(self, texts):
            given.append(sum(map(len, texts)))
            return [np.arange(len(t) // 1000, dtype=np.uint32) for t in texts]

    monkeypatch.setattr(packing, "encoder", lambda path, spaced: Coder())
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["x" * 200_000] * 59 + [None])], ["doc_id", "text"])
    out = pa.Table.from_batches(packing._cut("", 2048, 0)(iter([rows])))
    assert out.num_rows == 60 and sum(out["length"].to_pylist()) == 59 * 201 + 1
    assert sum(given) == 59 * 200_000 and max(given) <= packing.BATCH_CHARS + 200_000 < 3_000_000


def test_block_needs_little_beside_its_texts():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(300)]
    n = len(texts)
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "block": pa.array([0] * n, pa.int64())})
    replies = pa.table({f.name: pa.array([], f.type) for f in substring_dedup._REPLY})
    tracemalloc.start()
    try:
        out = substring_dedup._remove(50, 4, False, [])(rows, replies)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    size = sum(map(len, texts))
    print("bytes of memory a byte of text:", peak / size)
    assert out["n_removed"].to_pylist() == [0] * n and sum(out["n_bytes"].to_pylist()) == size
    assert peak < 15 * size


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 33, 50, 64])
def test_marks_cover_what_follows_them(length):
    rng = np.random.default_rng(length)
    for n in (0, 1, 40, 300):
        marks = rng.random(n) < 0.02
        want = [bool(marks[max(0, i - length + 1):i + 1].any()) for i in range(n)]
        assert substring_dedup._covered(marks, length).tolist() == want


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["aé", None, "", "漢字", "z"]])
def test_joined_texts(texts):
    column = pa.chunked_array([pa.array(["drop", *texts[:2]], pa.string()).slice(1), pa.array(texts[2:], pa.string())])
    starts, raw = substring_dedup._joined(column)
    coded = [(t or "").encode() for t in texts]
    assert raw.tobytes() == b"".join(coded) and starts.tolist() == np.cumsum([0, *map(len, coded)]).tolist()


class _Rows:
    """Runs what map_arrow gives to Spark on batches of its own."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_encoder_stays_for_tasks_that_use_it_only():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = _Rows(pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words, and some more"])], ["doc_id", "text"]))
    common.map_arrow(rows, packing._cut(path, 2048, 0), "", using=tokens.ENCODERS)
    first = tokens.encoder(path, True)
    common.map_arrow(rows, packing._cut(path, 2048, 0), "", using=tokens.ENCODERS)
    assert tokens.encoder(path, True) is first
    common.map_arrow(rows, near_dedup._facts(5), "")
    assert not common._KEPT
    assert tokens.encoder(path, True) is not first
    substring_dedup._alone(lambda group: group)(None)
    assert not common._KEPT


def test_table_of_parts_stays_small():
    coder = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    for k in range(4):
        words = [f"w{i:x}q" for i in range(100_000 * k, 100_000 * (k + 1))]
        coder.encode([" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)])
        assert len(coder.known) <= 310_000


def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() / 1e6

    def fn(batches):
        for b in batches:
            # Small blocks are taken from the allocator's own heap; the last one keeps the rest from being cut off.
            blocks = [bytes(20_000) for _ in range(10_000)]
            last.append(bytes(20_000))
            del blocks
            yield b

    last = []
    before = held()
    common.map_arrow(_Rows(pa.RecordBatch.from_arrays([pa.array([1])], ["doc_id"])), fn, "")
    assert held() < before + 100
