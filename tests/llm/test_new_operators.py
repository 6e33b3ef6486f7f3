"""Ball-tree search, weak supervision and tokenizer alignment against plain versions and SQL."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from tests.oracle_harness import compare, duck
from tickvault.llm import alignment, ball_tree, weak_rules

SF = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


@pytest.mark.parametrize("name", ["op11_ball_tree_search", "op12_weak_rules"])
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF, duck(SF))
    assert r["status"] == "ok", r


# ------------------------------------------------------------------ op11 ----

def plain_search(docs, items, top=10):
    term = re.compile(ball_tree.TERM)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: term.findall((t or "").translate(lower))
    counted = [(i, collections.Counter(words(t)), len(words(t))) for i, t in docs]
    n = sum(size > 0 for _, _, size in counted)
    length = sum(size for _, _, size in counted)
    df = collections.Counter(w for _, c, _ in counted for w in c)
    out = []
    for key, text in items:
        scores = []
        for doc, c, size in counted:
            if doc is None or not size:
                continue
            m = 25 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                        for w in words(text) if c[w])
            if score > 0:
                scores.append((-score, doc))
        out += [(key, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def search_tables(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "naïve"]
    text = lambda n: " ".join(rnd.choice(vocabulary[: rnd.choice((5, 63))]) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 40))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " \n\t.!"), (None, "w1 w2"), (303, docs[0][1]), (303, docs[0][1]), (304, "w3 " * 20000)]
    items = [(i, text(8)) for i in range(12)] + [(12, None), (13, ""), (14, "W1 w1, W1!"), (14, "w2"), (15, "absent")]
    return docs, items


def run_search(spark, docs, items, **kw):
    clash = [F.lit(0).alias(c) for c in ("id", "term", "tf", "n", "item", "rank", "score")]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").select("*", *clash)
    got = ball_tree.rank_documents(d, i, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_search_equals_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 2)
    monkeypatch.setattr(ball_tree, "TREE_ROWS", 50)
    docs, items = search_tables()
    assert run_search(spark, docs, items) == plain_search(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "BLOCK_CHARS", 120)
    docs, items = search_tables(4)
    assert len(list(ball_tree._blocks(spark.createDataFrame(items, "key long, text string")))) > 3
    assert run_search(spark, docs, items) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = search_tables()
    assert run_search(spark, docs, items[12:14]) == [] and run_search(spark, docs, items[:0] or [(None, None)]) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ball_tree.rank_documents(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(20 * g, 20 * g + 20, 6)) for g in range(10) for _ in range(60)]
    start = np.append(0, np.cumsum([len(r) for r in rows]))
    vectors = ball_tree.Vectors(start, np.concatenate(rows), rnd.integers(10 ** 9, 2 * 10 ** 10, start[-1]))
    tree = ball_tree.BallTree(vectors, 200)
    assert sorted(tree.rows.tolist()) == list(range(600))
    for g in range(10):
        whole = np.zeros(200, np.int64)
        whole[20 * g:20 * g + 5] = 1 + np.arange(5)
        dense = whole.astype(float)
        scores = tree.vectors.dot(0, 600, whole)
        for node, (a, b) in enumerate(zip(tree.low, tree.high)):
            assert scores[a:b].max() <= tree.bound(node, dense)
        best = []
        assert tree.search(dense, whole, best, np.arange(600), 10) < 300
        want = sorted(((int(s), -int(i)) for s, i in zip(scores, tree.rows) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want


# ------------------------------------------------------------------ op12 ----

EDGES = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "a b c d e " * 40), (5, "Line one is here.\nLine one is here.\n" * 3),
         (6, "word### " * 30), (7, "x" * 3_000_000), (7, "x"), (None, "éé ñ 你好 #|"), (8, "a b c d e f a b c d e")]


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_rule_statistics_of_edge_rows(spark):
    clash = [F.lit(0).alias(c) for c in ("n_words", "votes", "kept", "n_lines", "_w_text")]
    rows = weak_rules.judge(spark.createDataFrame(EDGES, "doc_id long, text string").select("*", *clash)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((i is None, i or 0, *plain_counts(t)) for i, t in EDGES)
    assert not any(r.kept and r.base_failed for r in rows) and all(0 <= r.posterior <= 1 for r in rows)
    assert weak_rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_equals_plain_expectation_maximisation(spark):
    rnd, size = random.Random(2), len(weak_rules.RULES)
    counts = collections.Counter()
    for _ in range(3000):
        good = rnd.random() < 0.7
        counts[tuple(rnd.choices((-1, 0, 1), (1, 10, 9) if good else (9, 10, 1))[0] for _ in range(size))] += 1
    patterns = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    prior, shares = weak_rules.estimate(patterns, rounds=5)
    p, s = weak_rules.PRIOR, [weak_rules.START] * size
    total = sum(counts.values())
    for _ in range(5):
        post = {}
        for v in counts:
            odds = math.log(p / (1 - p)) + sum(math.log(s[r]["good"][x + 1] / s[r]["bad"][x + 1]) for r, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-odds))
        mass = {"good": sum(n * post[v] for v, n in counts.items()), "bad": sum(n * (1 - post[v]) for v, n in counts.items())}
        trust = weak_rules.TRUST * total
        p = (mass["good"] + weak_rules.PRIOR * trust) / (total + trust)
        s = [{side: [(sum(n * (post[v] if side == "good" else 1 - post[v]) for v, n in counts.items() if v[r] == x)
                      + weak_rules.START[side][x + 1] * trust) / (mass[side] + trust) for x in (-1, 0, 1)]
              for side in ("bad", "good")} for r in range(size)]
    assert prior == pytest.approx(p, abs=1e-9) and abs(prior - 0.7) < 0.05
    assert all(shares[r][side] == pytest.approx(s[r][side], abs=1e-9) for r in range(size) for side in s[r])


def test_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_rules.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = dict(tuple(r) for r in rows)
    assert kept[1] > 0.98 and kept[0] < 0.05


# ------------------------------------------------------------------ op13 ----

def plain_alignment(texts):
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    value, names = alignment._byte_values(), {i: w for w, i in t.get_vocab().items()}
    parts, links = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a = [bytes(value[c] for c in names[i]) for i in ids_a]
        b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            parts.append(None)
            continue
        end_a, end_b = (dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(len(side)))) for side in (a, b))
        groups, at_a, at_b, mine = [], 0, 0, []
        for end in sorted(end_a.keys() & end_b.keys()):
            groups.append(",".join(map(str, ids_a[at_a:end_a[end] + 1])) + "|" + ",".join(map(str, ids_b[at_b:end_b[end] + 1])))
            at_a, at_b = end_a[end] + 1, end_b[end] + 1
            mine.append((ids_a[end_a[end]], ids_b[end_b[end]]))
        links.update(mine)
        parts.append((len(a), len(b), len(groups), mine, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = collections.Counter()
    for (_, b), n in links.items():
        highest[b] = max(highest[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else
            (*p[:3], len(p[3]), sum(links[x] == highest[x[1]] for x in p[3]), sum(links[x] for x in p[3]), p[4]) for p in parts]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_docs", [3, 16_384])
def test_alignment_of_edge_rows(spark, monkeypatch, block_docs):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    texts = [None, "", "a", "the the the the", "the the the the", "<|endoftext|> <s> </s> <unk>", "tab\tand  two spaces\n\nlines", "naïve 你好 🎉 é",
             " " * 3000 + "x", "long " * 20000, "▁ mark", "\x00\x01", " lead and trail ", "ﬁ ligature Ⅳ"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the cat"), (None, "the dog")]
    clash = [F.lit(0).alias(c) for c in ("block", "pos", "key", "a", "b", "links", "planes")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash)
    got = alignment.align_documents(df, *PATHS)
    want = plain_alignment([t or "" for _, t in rows])
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()), key=order) == sorted(
        ((i, *w) for (i, _), w in zip(rows, want)), key=order)
    assert alignment.align_documents(df.limit(0), *PATHS).count() == 0


def test_alignment_of_documents(spark):
    got = {r.doc_id: r for r in E.queries()["op13_tokenizer_alignment"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r, want in zip(docs, plain_alignment([r.text or "" for r in docs])):
        assert tuple(got[r.doc_id][c] for c in COLUMNS) == want, r.doc_id


def test_bitmaps_round_trip():
    rnd = random.Random(7)
    for n in (1, 9, 500):
        for share in (0.01, 0.5, 1.0):
            at = np.array(sorted({rnd.randrange(n) for _ in range(max(1, int(n * share)))}), np.int64)
            packed = alignment.compress(at, n)
            assert alignment.positions(packed).tolist() == at.tolist() and alignment.popcount(packed) == len(at)
    a, b, pos = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 5, 5, 5]), np.array([0, 0, 2, 2, 2])
    rows = {(x[0], x[1]): x[2:] for x in alignment.invert(a, b, pos, 3)}
    assert rows[1, 5][:2] == (2, 4) and rows[2, 5][:2] == (1, 1)
    planes = rows[1, 5][2]  # two links in each of documents 0 and 2: the second digit alone
    assert [alignment.positions(p).tolist() for p in planes] == [[], [0, 2]]


def test_byte_level_ids_equal_the_library():
    coder = alignment.coders(*PATHS)[0]
    texts = ["a'll 've x", "<|endoftext|>", " " * 5000, "\n \n" * 400, "数字１２３ ½ ²", "é🎉" * 50, " 　x"]
    assert coder.encode(texts) == [coder.tokenizer.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_exact_dedup_shuffles_suspects_only(spark):
    """Of 2,000 texts 5 % are copies: the texts that pass the filter are those, and the plan has no
    exchange of all texts and no broadcast but the filter's fixed bits."""
    from tickvault.llm import exact_dedup as X
    docs = spark.createDataFrame([(i, f"text {i if i >= 100 else i // 2} " + "word " * 40) for i in range(2000)],
                                 "doc_id long, text string")
    suspects = X.repeated_fingerprints(docs.select(X.fingerprint(X.normalised(docs.text)).alias("fp")), 2000)
    sent = X.suspect_texts(docs, suspects)
    assert sent.count() == 100
    assert "Exchange hashpartitioning(norm" not in sent._jdf.queryExecution().toString()
    pieces = suspects.select(X._bits(F.col("fp"))[0].alias("p")).agg(F.max("p")).first()[0]
    assert pieces < 1 << (X.FILTER_BITS - X.PIECE_BITS)
    kept = X.exact_dedup(docs).groupBy("kept", "group_size").count().collect()
    assert sorted(tuple(r) for r in kept) == [(False, 2, 50), (True, 1, 1900), (True, 2, 50)]


def test_exact_dedup_false_hits_of_the_filter(spark, monkeypatch):
    """With a filter of 2 ** 4 bits nearly every text passes; the answer is the same."""
    from tickvault.llm import exact_dedup as X
    rows = [(i, t) for i, t in enumerate(["a b", "ab", None, "", " ", "x\ty", "xy ", "z"] + [f"one {i}" for i in range(60)])]
    docs = spark.createDataFrame(rows + [rows[7], (None, "z")], "doc_id long, text string")
    answer = lambda: sorted(map(tuple, X.exact_dedup(docs).collect()), key=str)
    expected = answer()
    monkeypatch.setattr(X, "FILTER_BITS", 4)
    assert answer() == expected
    by_id = {r[0]: r for r in expected if r[0] is not None and r[0] < 7}
    assert [by_id[i][1] for i in range(7)] == [0, 0, 4, 4, 4, 5, 5]
