"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns, per operator."""

import hashlib

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tickvault.llm import (
    bpe_tree, chat, exact_dedup, fingerprints, html_text, near_dedup, packing, quality, substring_dedup, token_files)

LONG = "word " * 9000
ROWS = [(0, "A long enough text of some words to be found again, with more than fifty bytes in it."),
        (1, "A long enough text of some words to be found again, with more than fifty bytes in it."),
        (2, None), (3, ""), (4, "one"), (None, "no id at all"), (5, LONG), (6, LONG), (6, LONG), (7, " \n\t")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    # Names that the operators use themselves.
    for name in ("block", "node", "kept", "score", "norm", "fp", "grp", "words", "length", "text_sha256"):
        df = df.withColumn(name, F.lit(None).cast("int"))
    return df


OPERATORS = {
    "near": lambda d: near_dedup.near_duplicates(d, width=2),
    "repeats": substring_dedup.remove_repeats,
    "fingerprints": fingerprints.fingerprints,
    "packing": lambda d: packing.best_fit_pack(d, P.path("byte_bpe_50k.json")),
    "files": lambda d: token_files.read_token_files(token_files.write_token_files(d, P.path("word_bpe_49k.json"))),
    "exact": exact_dedup.exact_dedup,
    "bpe": lambda d: bpe_tree.digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near(docs):
    rows = by_id(OPERATORS["near"](docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert [rows[i][0].component_id for i in (0, 1, 2, 3, 4, 5, 6, 7)] == [0, 0, 2, 3, 4, 5, 5, 7]
    assert [rows[i][0].n_shingles for i in (2, 3, 4, 5, 7)] == [0, 0, 1, 1, 0]
    assert rows[None][0].component_id is None and rows[None][0].kept


def test_repeats(docs):
    rows = by_id(OPERATORS["repeats"](docs))
    assert rows[0][0].n_removed == 0 and rows[1][0].n_removed == rows[1][0].n_bytes and rows[1][0].n_spans == 1
    assert rows[5][0].n_removed == 0 and all(r.n_removed == r.n_bytes for r in rows[6])
    assert rows[2][0].n_bytes == 0 and rows[2][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[None][0].kept_text == "no id at all"


def test_exact(docs):
    rows = by_id(OPERATORS["exact"](docs))
    assert [rows[i][0].keep_id for i in (0, 1, 4, 5, 6)] == [0, 0, 4, 5, 5]
    # The blank text has the most code points of those that are empty but for white space.
    assert {rows[i][0].keep_id for i in (2, 3, 7)} == {7} and rows[2][0].group_size == 3
    assert rows[None][0].kept and sum(r.kept for rs in rows.values() for r in rs) == 5


def test_fingerprints(docs):
    rows = by_id(OPERATORS["fingerprints"](docs))
    assert rows[0][0].fingerprint == rows[1][0].fingerprint and rows[0][0].near_next == 1.0
    assert rows[2][0].fingerprint == "" and rows[2][0].near_next == 1.0
    assert rows[7][0].edited_sha256 == hashlib.sha256(b" \n\t").hexdigest()
    assert all(0 <= r.near_edited <= 1 for rs in rows.values() for r in rs)


def test_packing(docs):
    rows = OPERATORS["packing"](docs).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len([r for r in rows if r.doc_id == 2]) == 1 and len([r for r in rows if r.doc_id is None]) == 1


def test_plan_is_best_fit_decreasing():
    """Against a plain best-fit decreasing over single items."""
    counts = {700: 5, 512: 3, 300: 9, 129: 4, 64: 7, 3: 11}
    room, used = [], 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [(r, i) for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits)[1]] -= size
            else:
                room.append(1024 - size)
    runs = packing.plan(counts, 1024)
    loads = {}
    ends = {size: [] for size in counts}
    for size, rank, *_ in runs.tolist():
        ends[size].append(rank)
    for size, rank, first, per, offset in runs.tolist():
        after = [r for r in ends[size] if r > rank]
        for r in range(rank, min(after) if after else counts[size]):
            b = first + (r - rank) // per
            loads.setdefault(b, []).append((offset + (r - rank) % per * size, size))
    assert sorted(1024 - sum(s for _, s in x) for x in loads.values()) == sorted(room)
    for x in loads.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size


def test_token_files(docs):
    rows = by_id(OPERATORS["files"](docs))
    assert rows[2][0].n_tokens == 1 and rows[None][0].start == 0 and len(rows[6]) == 2


def test_shard_round_trip():
    import numpy as np
    rng = np.random.default_rng(0)
    for ids in ([], [5], [0, 2**32 - 1, 7] * 200, rng.integers(0, 50_000, 3000).tolist(), [9] * 1000):
        got = token_files.read_shard(token_files.write_shard([3, None], [len(ids), 0], np.array(ids, np.uint32)))
        assert got[2].tolist() == ids and got[1].tolist() == [len(ids), 0]


def test_bpe(docs):
    rows = by_id(OPERATORS["bpe"](docs))
    assert rows[2][0].n_tokens == 0 and rows[5][0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_quality(spark, docs):
    labels = spark.createDataFrame([(None, 1), (0, None), (4, 1), (4, 1), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    none = quality.classify(docs, labels.limit(0)).first()
    assert none.score == 0.5 and none.predicted == 1
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <|end|> brief"), (1, 1, "user", None), (1, 2, "assistant", "a \\ b <|turn:user|>"),
            (1, 2, "assistant", "again"), (1, None, "a|>b", ""), (2, 1, None, "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, budget=8, history=4)).collect()}
    assert [out[k].n_turns for k in (1, 2, None)] == [5, 1, 1]
    told = [("a|>b", ""), ("system", "be <|end|> brief"), ("user", ""), ("assistant", "a \\ b <|turn:user|>"), ("assistant", "again")]
    assert out[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"a \\ b <|turn:user|>again").hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_segments_by_rank(spark, monkeypatch):
    """Sparse, equal and null turn numbers, and history across the segments of a long run."""
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 8)
    sparse = [(1, 1000 * k, "user", f"turn {k:03}") for k in range(20)]
    same = [(2, None, "assistant", f"turn {k:03}") for k in range(30)] + [(2, None, "assistant", "turn 007")]
    turns = spark.createDataFrame(sparse + same, "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(turns, budget=60, history=40).collect()
    for conv, said in ((1, [t for _, _, _, t in sparse]), (2, sorted(t for _, _, _, t in same))):
        mine = [list(chat.parse(r.formatted)) for r in sorted(r for r in rows if r.conv_id == conv)]
        assert [t for w in mine for kind, _, t, _ in w if kind == "turn"] == said
        assert max(sum(kind == "turn" for kind, *_ in w) for w in mine) > 1
        at = 0
        for w in mine:
            past = [t for kind, _, t, _ in w if kind == "past"]
            assert past == said[max(0, at - 2):at]
            at += len(w) - len(past)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, corpus_pipeline.near])
def test_stages_decide_on_rows(spark, stage):
    """Repeated rows, and rows with one doc_id of which only some are copies of others."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(6, texts["a"]), (6, texts["a"]), (6, texts["b"]), (7, texts["c"]), (9, texts["c"]), (9, texts["d"]),
            (None, texts["d"]), (None, "no id at all, and no copy of it anywhere here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in stage(spark, docs, "").collect()]
    assert len(kept) == 5 and set(kept) == {rows[0], rows[2], rows[3], rows[5], rows[7]}
    unique = docs.where("doc_id = 7")
    assert [r.text for r in stage(spark, unique, "").collect()] == [texts["c"]]


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (None, "u", ""), (2, "u", "<nav><a>Home</a></nav><article><p>One &amp; two<br>three<p>Four</article>"
                                                     "<div class='comments'><p>I think so too, it is good.</p></div>"),
         (3, "u", "<article><p>cut <b>off</b> he"), (4, "u", "<article>" + "<p>So it goes on.</p>" * 2000 + "</article>")],
        "page_id long, url string, html string").withColumn("text", F.lit("other"))
    rows = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert rows[1] == "" and rows[None] == "" and rows[2] == "One & two three\nFour" and rows[3] == "cut off he"
    assert rows[4].count("\n") == 1999
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body><article><p>One two three.</p><p>Four.</p></article>",
    "<head><meta charset=utf-8><link rel=a><article><p>One two three.</p><p>Four.</p></article>",
    "<article><p>One two three.</p><select><option>a<option>b<p>Four.</p></article>",
    "<article><select><option>a<p>One two three.</p><p>Four.</p><select><option>b</select></article>",
    "<article><p>One two three.</p><object data=x><p>Four.</p></article>",
    "<article><svg><svg></svg>no</svg><p>One two three.</p><canvas><p>Four.</p></article>",
    "<article><p>One two three.</p><p>Four.</p><script>var x = '<p>no</p>'"])
def test_html_without_end_tags(page):
    tree = html_text.grow_tree(*html_text.labelled_rows())
    assert html_text.main_text(page, tree) == "One two three.\nFour."


@pytest.mark.parametrize("before,after", [
    ("<div class='main-content has-sidebar'>", "</div><div class=sidebar><p>Buy our good boots for cold feet now.</p></div>"),
    ("<div id='page' class='search-open'>", "</div>"),
    ("<div id='page' class='sidebar-right'><article>", "</article></div>"),
    ("<div class='post with-comments'>", "<div class=comments><p>I think so too, it is good.</p></div></div>"),
    ("<form action=a><nav><a>Home</a></nav><main>", "</main></form>"),
    ("<form action=a>", "</form><footer>All of it is ours.</footer>"),
    ("<main>", "</main><div class=sidebar><article><p>Read more of our news here.</p></article></div>"),
    ("<div class=story>", "</div><div class=comment-list><article class=comment-body><p>I think so too.</p></article></div>")])
def test_html_in_wrappers(before, after):
    tree = html_text.grow_tree(*html_text.labelled_rows())
    body = "<h1>Iron</h1><p>Iron rusts when wet, so paint a gate every other year.</p><p>Be quick.</p>"
    assert html_text.main_text(before + body + after, tree) == (
        "Iron\nIron rusts when wet, so paint a gate every other year.\nBe quick.")
