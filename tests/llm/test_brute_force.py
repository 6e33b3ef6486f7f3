"""The registered queries against plain Python or SQL over whole small tables."""

import collections
import hashlib
import random
import struct
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from tickvault.llm import bpe_tree, near_dedup, substring_dedup, tokens
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def test_exact_dedup_sql(spark):
    assert compare(spark, "op9_exact_dedup", SF, duck(SF))["status"] == "ok"


def test_near_dedup(spark, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)

    def shingles(text):
        words = text.encode().lower().split()
        return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(tuple(words) and [tuple(words)])

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = E.queries()["op1_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), find(i)) for i in ids}


def test_substring_dedup(spark, texts):
    seen, want = {}, {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        strings = [raw[k:k + 50] for k in range(len(raw) - 49)]
        for k, s in enumerate(strings):
            if seen.get(s, i) < i:
                gone[k:k + 50] = b"\1" * 50
        for s in strings:
            seen.setdefault(s, i)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()
    rows = E.queries()["op3_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_substring_dedup_of_hot_anchors(spark, texts, monkeypatch):
    """Every anchor taken apart: the same rows as by whole stretches."""
    whole = sorted(E.queries()["op3_substring_dedup"](spark, SF).collect())
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 1)
    assert sorted(E.queries()["op3_substring_dedup"](spark, SF).collect()) == whole


def test_hot_anchor_spreads_over_owners():
    rng, phrase = random.Random(3), "a phrase that is everywhere. "
    said = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + phrase + "".join(rng.choice("abcdefgh ") for _ in range(60))
            for _ in range(300)]
    block = substring_dedup.Block(pa.table({"doc_id": range(300), "text": said, "block": [0] * 300}), 50)
    lists = substring_dedup._send_anchors(50, 4)(pa.table({"doc_id": range(300), "text": said, "block": [0] * 300}))
    by_owner = [lists.filter(pa.compute.equal(lists["owner"], o)) for o in set(lists["owner"].to_pylist())]
    replies = pa.concat_tables(substring_dedup._repeated_anchors(100)(x) for x in by_owner)
    sizes = [len(keys) for _, keys, _, _ in block.stretches(4, substring_dedup._bitmaps(replies))]
    assert len(sizes) == 16 and max(sizes) < sum(sizes) / 8


def test_tree_equals_library(monkeypatch):
    monkeypatch.setattr(bpe_tree, "LEAF_CHARS", 16)
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", 8)
    monkeypatch.setattr(bpe_tree, "WINDOW_CHARS", 2)
    coder, rng = bpe_tree.TreeEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "23", "é", "漢", "!", "\x1c", "\xa0", "x" * 50]
    for _ in range(500):
        text = "".join(rng.choice(parts[:rng.randint(1, len(parts))]) for _ in range(rng.randint(0, 99)))
        ids = coder.encode(text)
        assert ids == coder.library.encode_ordinary(text) and coder.decode(ids) == text.encode()


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_library(texts, name, spaced):
    coder = tokens.PieceEncoder(P.path(name), spaced)
    odd = ["", " ", "a  b\n\n c", " x", "don't.", "İx Word", "a\x00b", "x" * 90, " a\x85b", "<|endoftext|>"]
    some = odd + [texts[i] for i in sorted(texts)[:40]]
    want = [e.ids for e in coder.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(some)] == want


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_equal_fresh_library(texts, name, spaced):
    coder, fresh = tokens.PieceEncoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    added = ["<|endoftext|>", "x <|endoftext|> y", "X<|endoftext|>\n\n <|startoftext|>Y", "A <|ENDOFTEXT|> b", "<|EndOfText|>",
             "a  <|endoftext|>  b <|endoftext", "plain <|", "\x00<|endoftext|>"]
    some = added + [texts[i] for i in sorted(texts)[:20]] + [texts[min(texts)] + a for a in added]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode(some)] == [fresh.encode(t, add_special_tokens=False).ids for t in some]


def test_fingerprint_likeness(spark, texts):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    ids = sorted(texts)
    off = []
    for r in E.queries()["op5_fingerprints"](spark, SF).collect():
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        off.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.2


def test_chat_round_trip(spark):
    turns = collections.defaultdict(list)
    for conv, role, text in duckdb.sql(
            f"select conv_id, role, coalesce(text, '') from '{SF}/conversations.parquet' order by conv_id, turn").fetchall():
        turns[conv].append((role, text))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", said), ("assistant", said)]
    for r in E.queries()["op4_chat_windows"](spark, SF).collect():
        mine = turns.pop(r.conv_id)
        loss = "".join(t for role, t in mine if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not turns


def test_quality_on_held_out_labels(spark):
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = E.queries()["op8_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline_rows_fit(spark):
    rows = E.queries()["pipeline"](spark, SF).collect()
    load = collections.Counter()
    for r in rows:
        load[r.sequence_id] += r.length
    assert rows and max(load.values()) <= 2048


def fresh_pieces(tokenizer, texts, capacity=2048, end=0):
    """{(doc_id, piece): (start, length, crc32)}: the first piece takes the remainder."""
    out = {}
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, end], 0
        for piece in range(-(-len(ids) // capacity)):
            n = (len(ids) % capacity or capacity) if piece == 0 else capacity
            out[doc, piece] = at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at:at + n]))
            at += n
    return out


def test_packing_equals_fresh_library(spark, texts):
    rows = E.queries()["op6_best_fit_packing"](spark, SF).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert len(got) == len(rows) and got == fresh_pieces(Tokenizer.from_file(P.path("byte_bpe_50k.json")), texts)


def test_token_files_equal_fresh_library(spark, texts):
    tokenizer, want, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}, 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        want[i] = at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    rows = E.queries()["op7_token_files"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


class ArticleText(HTMLParser):
    """The words of the article element of a page, whatever the blocks."""
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.said += [" "] if tag in ("p", "br", "h1", "h2", "h3", "li", "div") else []

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.said += [" "] if tag in ("p", "h1", "h2", "h3", "li", "div") else []

    def handle_data(self, data):
        self.said += [data] if self.inside else []


def test_html_text_equals_article_element(spark):
    want = {}
    for i, page in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall():
        parser = ArticleText()
        parser.feed(page)
        parser.close()
        want[i] = "".join(parser.said).split()
    rows = E.queries()["op2_html_text"](spark, SF).collect()
    assert {r.page_id: r.text.split() for r in rows} == want and len(rows) == len(want)


def test_pipeline_equals_plain_stages(spark, texts):
    scores = {r.doc_id: r.score for r in E.queries()["op8_quality_classifier"](spark, SF).collect()}
    docs = {i: texts[i] for i in sorted(texts) if scores[i] >= 0.5}

    groups = collections.defaultdict(list)
    for i, t in docs.items():
        groups["".join(c for c in t if c not in "\t\n\x0b\x0c\r ")].append((-len(t), i))
    docs = {i: docs[i] for i in sorted(min(g)[1] for g in groups.values())}

    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in docs:
        for j in docs:
            if j >= i:
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = {i: t for i, t in docs.items() if find(i) == i}

    seen, kept = set(), {}
    for i, t in docs.items():
        raw = t.encode()
        strings = [raw[k:k + 50] for k in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for k, x in enumerate(strings):
            if x in seen:
                gone[k:k + 50] = b"\1" * 50
        seen.update(strings)
        kept[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")

    assert len(kept) < len(texts)
    rows = E.queries()["pipeline"](spark, SF).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert len(got) == len(rows) and got == fresh_pieces(Tokenizer.from_file(P.path("byte_bpe_50k.json")), kept)


def test_repeats_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """Slices cut the bytes of a block in places that depend on the order of its texts, and a shuffle
    gives rows in any order: all steps must see one order."""
    import pyarrow as pa

    rows = pa.table({"doc_id": pa.array([3, 1, 2], pa.int64()), "text": ["c" * 90, "ab" * 60, None], "block": [0, 0, 0]})
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    one, other = (substring_dedup.Block(rows.take(order), 50) for order in ([0, 1, 2], [2, 0, 1]))
    assert one.raw.tobytes() == other.raw.tobytes() and (one.first == other.first).all()
    assert (one.hashes == other.hashes).all() and (one.doc == other.doc).all()


def test_lists_of_anchors_come_back():
    rng = np.random.default_rng(5)
    for sizes in ([1], [3, 1, 8, 200], [7, 9, 16, 1, 1]):
        parts = [np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64)) for n in sizes]
        parts[0][0] = 0
        n = np.array([len(p) for p in parts])
        for k in (0, 28, 31) if len(sizes) == 1 else (28, 31, 39):
            values = np.concatenate(parts) if k else np.arange(n.sum(), dtype=np.uint64)
            unary, low = substring_dedup.code_lists(values, n, k)
            back = substring_dedup.decode_lists(pa.chunked_array([unary]), pa.chunked_array([low]), n, np.full(len(n), k))
            assert back.tolist() == values.tolist()


@pytest.mark.parametrize("length", [32, 50])
def test_same_strings_are_found_once(length):
    rng = random.Random(length)
    words = ["".join(rng.choice("ab") for _ in range(length + rng.randint(0, 40))) for _ in range(60)]
    said = [rng.choice(words) for _ in range(900)]
    sizes = np.array([len(w) for w in said])
    raw = np.frombuffer("".join(said).encode(), np.uint8)
    order, begin = substring_dedup._same(raw, np.cumsum(sizes) - sizes, sizes)
    groups = [{said[i] for i in part} for part in np.split(order, begin[1:])]
    assert all(len(g) == 1 for g in groups) and sorted(w for g in groups for w in g) == sorted(set(said))


def test_work_of_a_block_does_not_grow_with_the_owners():
    """With more input come more owners; a block sends each of them less, for about the same work."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5000)]
    said = ["\n".join(rng.choice(lines) for _ in range(8)) for _ in range(1500)]
    rows = pa.table({"doc_id": pa.array(range(1500), pa.int64()), "text": said, "block": pa.array([0] * 1500, pa.int64())})

    def work(bits):
        t = time.process_time()
        lists = substring_dedup._send_anchors(50, bits)(rows)
        sent = time.process_time() - t
        replies = substring_dedup._repeated_anchors(1 << 16)(lists.slice(0, 1)).slice(0, 0)
        every = [substring_dedup._repeated_anchors(1 << 16)(lists.slice(i, 1)) for i in range(lists.num_rows)]
        t = time.process_time()
        out = substring_dedup._send_stretches(50, bits)(rows, pa.concat_tables([replies, *every]))
        return sent + time.process_time() - t, sum(map(len, out["bytes"].to_pylist())), out.num_rows

    work(4)
    few, much, owners = work(4)
    many, as_much, more_owners = work(13)
    assert as_much == much > 100_000 and owners == 16 and more_owners > 4000
    assert many < 4 * few + 2
