"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector over the terms of the queries, its entries the integer scores
its terms earn; a query is the counts of its terms, so a score is an inner product. Tasks cut
their documents into trees of bounded size. Each node is a ball: the mean of its vectors and
a radius. By the Cauchy-Schwarz inequality no vector inside scores over
``q . mean + |q'| * radius``, where q' is the part of q on terms that the ball has at all; both are
rounded upward, so that a subtree is left out only if none of its documents can enter a
query's best. Nodes are visited best bound first, and
leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import materialise, query, table

TOP = 10
# Queries are answered in blocks, each of a pass over the documents: the terms of a block are the
# only thing sent to all tasks, and there are at most so many characters of them.
BLOCK_CHARS = 4_000_000
# Documents and vector entries of a tree, and documents of a leaf.
TREE_ROWS = 4096
TREE_ENTRIES = 1_000_000
LEAF_ROWS = 32
# Doubles carry 53 bits and sums here have far fewer than 2^20 terms: so much covers all rounding.
SLACK = 1 + 2.0 ** -30

# Fixed values of the contract: what a term is, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, FLAT, LENGTH_SHARE, SPREAD = 1_000_000_000, 1000, 75, 8

_TERM = re.compile(TERM)


def terms(texts: pa.Array) -> Iterator[list[str]]:
    """The terms of each text, only A-Z lower-cased; none for null."""
    for text in pc.ascii_lower(texts).to_pylist():
        yield _TERM.findall(text) if text else []


@dataclass
class Vectors:
    """Rows of a sparse matrix: row i has entries ``start[i]`` to ``start[i + 1]``."""
    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = np.diff(self.start)[rows]
        start = np.append(0, sizes.cumsum())
        at = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], sizes)
        return Vectors(start, self.term[at], self.value[at])

    def dot(self, a: int, b: int, dense: np.ndarray) -> np.ndarray:
        """Inner products of rows a to b with a vector over all terms; every row has an entry."""
        lo, hi = self.start[a], self.start[b]
        return np.add.reduceat(self.value[lo:hi] * dense[self.term[lo:hi]], self.start[a:b] - lo)


class BallTree:
    """Balls over the rows of ``vectors`` (each with an entry), whose order it keeps in ``rows``."""

    def __init__(self, vectors: Vectors, n_terms: int):
        self.n_terms = n_terms
        self.low, self.high, self.radius, self.center, self.children = [], [], [], [], []
        exact = vectors.value
        self.vectors = Vectors(vectors.start, vectors.term, vectors.value.astype(np.float64))
        n = len(vectors.start) - 1
        self.rows = np.arange(n)
        self.square = np.add.reduceat(self.vectors.value ** 2, vectors.start[:-1])
        self._build(0, n)
        self.vectors = Vectors(vectors.start, vectors.term, exact).take(self.rows)

    def _build(self, a: int, b: int) -> int:
        node = len(self.low)
        rows = self.rows[a:b]
        part = self.vectors.take(rows)
        mean = np.bincount(part.term, part.value, self.n_terms) / (b - a)
        held = np.flatnonzero(mean)
        norm = float(mean[held] @ mean[held])
        square = self.square[rows]
        # |v - m|^2 = |v|^2 - 2 v.m + |m|^2; the error of the three terms is bounded by their sizes.
        far = square - 2 * part.dot(0, b - a, mean) + norm
        reach = math.sqrt(max(float(np.max(far + (square + norm) * (SLACK - 1))), 0.0)) * SLACK
        self.low.append(a)
        self.high.append(b)
        self.radius.append(reach)
        self.center.append((held, mean[held]))
        self.children.append(None)
        if b - a > LEAF_ROWS:
            # Two poles far apart; rows go to the nearer one, by halves, so the depth is bounded.
            one = self._dense(part, int(np.argmax(far)))
            apart = square - 2 * part.dot(0, b - a, one)
            two = self._dense(part, int(np.argmax(apart)))
            side = part.dot(0, b - a, one - two)
            self.rows[a:b] = rows[np.argsort(side, kind="stable")]
            middle = (a + b) // 2
            self.children[node] = self._build(a, middle), self._build(middle, b)
        return node

    def _dense(self, part: Vectors, i: int) -> np.ndarray:
        out = np.zeros(self.n_terms)
        lo, hi = part.start[i], part.start[i + 1]
        out[part.term[lo:hi]] = part.value[lo:hi]
        return out

    def bound(self, node: int, dense: np.ndarray) -> float:
        """No row of the node scores more. Entries are not negative, so where the mean has none,
        no row of the node has one, and that part of the query meets nothing."""
        held, mean = self.center[node]
        asked = dense[held]
        return (float(asked @ mean) + math.sqrt(float(asked @ asked)) * self.radius[node]) * SLACK + 1

    def search(self, dense: np.ndarray, whole: np.ndarray, best: list, ids: np.ndarray, top: int) -> int:
        """Add rows to ``best``, a heap of the ``top`` highest (score, -id, n) with score above 0, and
        return the number of rows scored. ``dense`` and ``whole`` are the query in doubles and
        in integers."""
        queue, scored = [(-self.bound(0, dense), 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            # Equal scores are told apart by id, so only a bound below the least kept one prunes.
            if len(best) == top and -bound < best[0][0]:
                break
            if self.children[node]:
                for child in self.children[node]:
                    limit = min(-bound, self.bound(child, dense))
                    if len(best) < top or limit >= best[0][0]:
                        heapq.heappush(queue, (-limit, child))
                continue
            a, b = self.low[node], self.high[node]
            scores = self.vectors.dot(a, b, whole)
            scored += b - a
            least = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                entry = int(scores[i]), -int(ids[self.rows[a + i]])
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _count(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(id, n, term, tf) per document: all its terms counted, those of the vocabulary listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, times = [], [], []
            for words in terms(batch.column(1)):
                n.append(len(words))
                found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                held.append([t for t, _ in found])
                times.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int64()))], names=["id", "n", "term", "tf"])
    return docs.mapInArrow(run, "id long, n long, term array<int>, tf array<long>")


def _weights(df: dict[int, int], size: int, n_docs: int) -> np.ndarray:
    """Per term of the vocabulary, its weight."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


def search_block(docs: DataFrame, items: list[tuple[object, list[str]]], top: int = TOP) -> DataFrame:
    """(item, doc, score): for every item (key, terms) its best documents of each task.

    ``items`` is one block of queries. ``docs`` has columns id and text."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
    counted = materialise(_count(docs, vocabulary), "search-counts")
    total = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
    n_docs, length = int(total["docs"]), int(total["length"] or 0)
    # One row per term of the block's queries comes to the driver.
    df = {r["t"]: r["count"] for r in counted.select(F.explode("term").alias("t")).groupBy("t").count().collect()}
    weights = _weights(df, len(vocabulary), n_docs)
    wanted = []
    for key, words in items:
        times = Counter(vocabulary[w] for w in words)
        wanted.append((key, np.fromiter(times, np.int64, len(times)), np.fromiter(times.values(), np.int64, len(times))))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Vectors]]:
        """Ids and vectors of the documents of a tree. A weight of 0 or less has no part in a score
        that counts, but keeps its entry, as scores are whole sums."""
        held, rows, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                held.append(part)
                rows += part.num_rows
                entries += len(part.column(2).flatten())
                if rows >= TREE_ROWS or entries >= TREE_ENTRIES:
                    yield vectors(held)
                    held, rows, entries = [], 0, 0
        if held:
            yield vectors(held)

    def vectors(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, Vectors]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids, n = (whole.column(c).to_numpy() for c in (0, 1))
        lists = whole.column(2).combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = whole.column(3).combine_chunks().flatten().to_numpy()
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // length
        value = weights[term] * (UNIT * tf // (FLAT * tf + SPREAD * np.repeat(m, sizes)))
        return ids, Vectors(np.append(0, sizes.cumsum()), term, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in wanted]
        for ids, rows in trees(batches):
            # Only the terms of these documents get a place in the tree's vectors.
            names, rows.term = np.unique(rows.term, return_inverse=True)
            place = np.full(len(vocabulary), -1)
            place[names] = np.arange(len(names))
            tree = BallTree(rows, len(names))
            whole, dense = np.zeros(len(names), np.int64), np.zeros(len(names))
            for (_, words, times), found in zip(wanted, best):
                at = place[words]
                at, t = at[at >= 0], times[at >= 0]
                if len(at):
                    whole[at] = dense[at] = t
                    tree.search(dense, whole, found, ids, top)
                    whole[at] = dense[at] = 0
        rows = [(i, -doc, score) for i, found in enumerate(best) for score, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc", "score"])

    return counted.where((F.size("term") > 0) & F.col("id").isNotNull()).mapInArrow(run, "item long, doc long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
                   top: int = TOP) -> DataFrame:
    """For each row of ``items``, its ``top`` rows of ``docs`` with score above 0: item, rank (from 1),
    doc and score, equal scores by ascending id.

    Null and empty texts have no terms: such items get no rows and such documents are in no
    answer. Rows of ``docs`` with a null id count for the statistics but cannot be named, so they
    are in no answer either; repeated rows are documents of their own and are ranked side by
    side. Repeated items are answered once per row. Other columns are not read. Without
    documents or items there are no rows. ``docs`` is read once per block of at most
    BLOCK_CHARS characters of items (a longer item is a block by itself).
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    numbered = items.select(F.col(item_key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for block in _blocks(numbered):
        found = search_block(named, block)
        by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc"))
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"item long, key {items.schema[item_key].dataType.simpleString()}")
        answer = ranked.join(F.broadcast(keys), "item").select(
            F.col("key").alias(item_key), "rank", F.col("doc").alias(key), "score")
        out = answer if out is None else out.unionByName(answer)
    if out is None:
        return spark.createDataFrame([], f"{item_key} {items.schema[item_key].dataType.simpleString()}, rank int, {key} long, score long")
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with terms, in lists of at most BLOCK_CHARS characters, a list at a time on the driver."""
    held, size = [], 0
    for row in items.toLocalIterator():
        words = next(terms(pa.array([row["text"]], pa.string())))
        if not words:
            continue
        if held and size + len(row["text"]) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row["key"], words))
        size += len(row["text"])
    if held:
        yield held


_ORACLE = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '{TERM}') AS w FROM documents),
    total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM docs WHERE len(w) > 0),
    flat AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM docs),
    tfs AS (SELECT doc_id, n, t, count(*) AS tf FROM flat GROUP BY ALL),
    dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
    items AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS t
      FROM benchmark),
    wanted AS (SELECT item_id, t, count(*) AS times FROM items GROUP BY ALL),
    scored AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
        * (({UNIT} * tf) // ({FLAT} * tf + {SPREAD} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // length)))) AS BIGINT) AS score
      FROM wanted JOIN tfs USING (t) JOIN dfs USING (t), total GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""


@query("op11_ball_tree_search", _ORACLE)
def op11_ball_tree_search(spark, sf_dir):
    """The 10 highest-scoring documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
