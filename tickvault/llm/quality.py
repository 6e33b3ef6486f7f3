"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every document in Arrow batches. The trees are fitted
on those of at most ``TRAIN_ROWS`` labelled documents, flattened into arrays, and applied
to whole batches by vectorised traversal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, query, table

TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 5
RATE = 0.2
L2 = 1.0
MIN_ROWS = 8

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "word_spread", "long_words", "upper", "digits", "punctuation",
    "symbols", "pipes", "non_ascii", "spaces", "shouted", "marked", "alphabetic", "capitalised", "distinct",
    "repeated_neighbours", "top_word", "distinct_pairs", "lines", "distinct_lines", "line_bytes", "ended_lines",
]

_CLASS = np.zeros((256, 7), np.float64)  # upper, digit, punctuation, symbol, pipe, non-ASCII, white space
_CLASS[65:91, 0] = _CLASS[48:58, 1] = _CLASS[128:, 5] = 1
_CLASS[[ord(c) for c in ".,;:'\"()-?!"], 2] = 1
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"], 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[[9, 10, 11, 12, 13, 32], 6] = 1
_MARKED = re.compile(r"[^\w\s.,;:'\"()?!-][.,;:]?$|!!+$")


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for one text; all are 0 for an empty one."""
    raw = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [np.log1p(len(raw)), *[0.0] * (len(STATISTICS) - 1)]
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(c for w, c in counts.items() if _MARKED.search(w))
    shouted = sum(c for w, c in counts.items() if w.isupper())
    alphabetic = sum(c for w, c in counts.items() if w.strip(".,;:'\"()?!-").isalpha())
    capitalised = sum(c for w, c in counts.items() if w[0].isupper())
    repeated = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(n), lengths.mean(), lengths.std(), (lengths > 12).mean(), *shares,
        shouted / n, marked / n, alphabetic / n, capitalised / n, len(counts) / n,
        repeated / n, max(counts.values()) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1),
        len(lines) / n, len(set(lines)) / len(lines), len(raw) / len(lines),
        sum(x.rstrip()[-1] in ".?!" for x in lines) / len(lines),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth as (tree, node) arrays; ``value`` holds the leaves."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics, a level of a tree at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def _best_split(hist: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) over a node's histograms (feature, bin, [gradient, hessian, rows])."""
    left = hist.cumsum(axis=1)[:, :-1]
    right = hist.sum(axis=1)[:, None] - left
    fit = lambda h: h[..., 0] ** 2 / (h[..., 1] + L2)
    gain = fit(left) + fit(right) - fit(hist.sum(axis=1))[:, None]
    gain[(left[..., 2] < MIN_ROWS) | (right[..., 2] < MIN_ROWS)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees under log loss; without both labels, a constant score."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    n_features = x.shape[1]
    cells = binned + np.arange(n_features) * BINS
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            split = None
            if len(rows) >= 2 * MIN_ROWS:
                flat = cells[rows].ravel()
                hist = np.stack([np.bincount(flat, np.repeat(v[rows], n_features), n_features * BINS)
                                 for v in (g, h, np.ones(len(y)))], axis=1).reshape(n_features, BINS, 3)
                gain, f, b = _best_split(hist)
                split = (f, b) if gain > 1e-6 and b < len(edges[f]) else None
            if split:
                out.feature[t, at], out.threshold[t, at] = split[0], edges[split[0]][split[1]]
                node[rows] = 2 * at + 1 + (binned[rows, split[0]] > split[1])
            else:
                node[rows] = 2 * at + 1
        leaf = node - inner
        out.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += out.value[t][leaf]
    return out


def _statistics_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    rows = [statistics(t or "") for t in batch.column(column).to_pylist()]
    return np.array(rows, np.float64).reshape(-1, len(STATISTICS))


def held_out(doc_id):
    """Whether crc32 of the decimal doc_id leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``train_rows`` labelled rows that are not held out, chosen by a hash of
    doc_id; rows without a label or an id are not used. That bound is what reaches the driver."""
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows))
    schema = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_statistics_of(b, "text")), schema[0].type), b.column("label")],
                                             schema=schema)

    # `chosen` has at most train_rows rows of twelve bytes, so it may be broadcast. A doc_id that many
    # rows share gives one of them, the first by its text's hash, so the bound holds for those too.
    few = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    one = few.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = map_arrow(one.join(F.broadcast(chosen), "doc_id").select("text", "label"), run, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    y = np.array([r["label"] for r in rows], np.float64)
    order = np.lexsort((*x.T, y))
    return fit_trees(x[order], y[order])


def score(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and its score."""
    fields = docs.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    # Texts that are kept reach the task once.
    text = "text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(trees.scores(_statistics_of(b, text)))
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, s], names=[*keep, "score"])

    return map_arrow(docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")])), run, ddl)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null text counts as empty and is scored like any other; repeated rows get equal
    scores; a null doc_id is scored and never held out. Without usable labels every score
    is 0.5. An empty table gives no rows; columns but doc_id, text and quality are not read.
    """
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    """Quality scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
