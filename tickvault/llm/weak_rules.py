"""Quality rules as weak supervision, in DataFrame functions alone.

``RULES`` look at a document's statistics; each votes good (1) or bad (-1) or abstains (0).
No rule has to pass: expectation-maximisation over the counts of vote patterns (at most
3^9 = 19,683 rows, whatever the corpus) estimates how accurate each rule is -- how it votes on
good and on bad documents -- and a document is kept if its posterior probability of being
good is at least one half. Votes are taken as independent given the quality of a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvault.llm.common import materialise, query, table

WINDOW = 5
ROUNDS = 12
# Starting shares of (bad, none, good) votes among bad and among good documents: they say which
# side is which. ``TRUST`` is their weight in each estimate, as a share of all documents.
START = {"bad": (0.3, 0.5, 0.2), "good": (0.01, 0.49, 0.5)}
PRIOR, TRUST = 0.8, 0.01

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ENDS = r"[.?!](?:[\x20\x09-\x0D]|$)"
# The end of a word that ends in a sign or in several punctuation marks.
MARKS = r"(?:[#*$%&|<>@=+_~^{}\[\]\\/]|[.,;:?!][.,;:?!])[.,;:?!]*(?:[\x20\x09-\x0D]|$)"

# Name: (bad if, good if), in integers; what is neither abstains. Most rules know one kind of
# bad text only and say nothing of the others.
RULES = {
    "length": ("n_words < 12", "n_words >= 50"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 14 * n_words",
                    "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    "symbols": ("20 * n_symbols > n_words", "false"),
    "lines": ("n_dup_lines > 0 and 10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 and 20 * n_dup_lines <= n_lines"),
    "marked": ("10 * n_marked > n_words", "false"),
    "repeats": ("n_words >= 10 and 100 * n_repeat_words > 15 * n_words", "false"),
    "neighbours": ("n_words >= 10 and 10 * n_neighbours > n_words", "false"),
    "shouting": ("3 * n_upper > word_chars", "false"),
    "sentences": ("n_words >= 40 and (100 * n_ended < n_words or 3 * n_ended > n_words)",
                  "n_words >= 10 and 50 * n_ended >= n_words and 5 * n_ended <= n_words"),
}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need
    besides (n_lines, n_neighbours, n_upper, n_ended, n_marked), all long; a null text counts as empty.

    Five-word windows are compared by 64-bit hashes, within one document only."""
    c = lambda name: F.col(f"_w_{name}")
    count = lambda a: F.size(a).cast("long")
    without = lambda pattern: F.char_length(F.regexp_replace(c("text"), pattern, "")).cast("long")
    names = [F.col(name) for name in docs.columns]
    df = docs.withColumn("_w_text", F.coalesce(F.col(text), F.lit("")))
    df = df.select(
        *names, F.array_remove(F.split(c("text"), SPACES), "").alias("_w_words"),
        F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_w_lines"),
        without(SPACES).alias("word_chars"), without(f"[^{SYMBOLS}]+").alias("n_symbols"),
        without("[^A-Z]+").alias("n_upper"), (count(F.split(c("text"), ENDS)) - 1).alias("n_ended"),
        (count(F.split(c("text"), MARKS)) - 1).alias("n_marked"))
    plain = [F.col(name) for name in ("word_chars", "n_symbols", "n_upper", "n_ended", "n_marked")]
    df = df.select(*names, *plain, count(c("lines")).alias("n_lines"),
                   (count(c("lines")) - count(F.array_distinct(c("lines")))).alias("n_dup_lines"),
                   F.transform(c("words"), lambda w: F.xxhash64(w)).alias("_w_hash"))
    n = F.size(c("hash"))
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get(c("hash"), i + k) for k in range(WINDOW)]))
    df = df.withColumn("_w_windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    # Most documents repeat no window; only the others sort theirs.
    some = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    df = df.withColumn("_w_sorted", F.when(some, F.sort_array(F.transform(
        c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(c("sorted"), lambda x, j: (x["h"] == F.get(c("sorted"), j - 1)["h"])
                     | (x["h"] == F.get(c("sorted"), j + 1)["h"]))
    df = df.withColumn("_w_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    reach = F.transform(c("at"), lambda p, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get(c("at"), j + 1), p + WINDOW) - p).cast("long"))
    return df.select(
        *names, *plain, "n_lines", "n_dup_lines", n.cast("long").alias("n_words"),
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words"),
        count(F.filter(c("hash"), lambda h, i: h == F.get(c("hash"), i - 1))).alias("n_neighbours"))


def votes() -> Column:
    """The votes of all rules, in their order, as one array."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in RULES.values()])


def log_odds(prior: float, shares: list[dict[str, list[float]]]) -> Column:
    """Log odds of a good document, from its array ``votes``."""
    weights = F.lit([math.log(g / b) for share in shares for b, g in zip(share["bad"], share["good"])])
    return F.aggregate(F.transform("votes", lambda v, i: F.get(weights, 3 * i + v + 1)),
                       F.lit(math.log(prior / (1 - prior))), lambda a, b: a + b)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[dict[str, list[float]]]]:
    """The share of good documents, and each rule's shares of (bad, none, good) votes among bad
    and among good ones, by expectation-maximisation over ``patterns`` (``votes`` and their
    count ``n``). Each round is one aggregate; one row per rule and vote comes to the driver."""
    prior, shares = PRIOR, [START] * len(RULES)
    for _ in range(rounds):
        good = 1 / (1 + F.exp(-log_odds(prior, shares)))
        sums = (patterns.select("n", good.alias("p"), F.posexplode("votes").alias("rule", "vote")).groupBy("rule", "vote")
                .agg(F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"), F.sum(F.col("n") * F.col("p")).alias("good")))
        cast = {(r["rule"], r["vote"]): r for r in sums.collect()}
        if not cast:
            break
        total = {side: sum(cast[0, v][side] for v in (-1, 0, 1) if (0, v) in cast) for side in START}
        trust = TRUST * sum(total.values())
        prior = (total["good"] + PRIOR * trust) / (sum(total.values()) + trust)
        shares = [{side: [((cast[r, v][side] if (r, v) in cast else 0.0) + START[side][v + 1] * trust) / (total[side] + trust)
                          for v in (-1, 0, 1)] for side in START} for r in range(len(RULES))]
    return prior, shares


def judge(docs: DataFrame, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics, votes, posterior (double, 0 to 1), base_failed and kept for every row.

    Null and empty texts have no words: all counts are 0, base_failed is true. Repeated rows
    and null ids are judged row by row; other columns than ``carried`` are not looked at. An
    empty table gives no rows. The statistics are computed once and written under the
    checkpoint folder.
    """
    held = [F.col(name).alias(f"_k_{i}") for i, name in enumerate(carried)]
    read = with_statistics(docs.select(*held, F.col(text).alias("_k_text")), "_k_text").drop("_k_text")
    rows = materialise(read.select("*", votes().alias("votes")), "rule-votes")
    patterns = materialise(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "rule-patterns")
    odds = log_odds(*estimate(patterns))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        *[F.col(f"_k_{i}").alias(name) for i, name in enumerate(carried)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes",
        (1 / (1 + F.exp(-odds))).alias("posterior"), failed.alias("base_failed"), (~failed & (odds >= 0)).alias("kept"))


def _oracle() -> str:
    """The same in DuckDB: windows by their words, rounds of the estimate as one query each."""
    vote = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v_{r}" for r, (b, g) in RULES.items())
    odds = " + ".join(["ln(prior / (1 - prior))"] + [
        f"CASE v_{r} WHEN -1 THEN ln(g_{r}_0 / b_{r}_0) WHEN 0 THEN ln(g_{r}_1 / b_{r}_1) ELSE ln(g_{r}_2 / b_{r}_2) END" for r in RULES])
    first = ", ".join(f"{START[side][k]}::DOUBLE AS {side[0]}_{r}_{k}" for r in RULES for side in START for k in range(3))
    parts = [f"""
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
    flat AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM cut),
    wins AS (SELECT r, i, x AS w0, lead(x, 1) OVER o AS w1, lead(x, 2) OVER o AS w2, lead(x, 3) OVER o AS w3,
      lead(x, 4) OVER o AS w4, lag(x) OVER o AS before FROM flat WINDOW o AS (PARTITION BY r ORDER BY i)),
    seen AS (SELECT r, i, count(*) OVER (PARTITION BY r, w0, w1, w2, w3, w4) AS c FROM wins WHERE w4 IS NOT NULL),
    gaps AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS reach FROM seen WHERE c > 1),
    reps AS (SELECT r, sum(reach) AS n FROM gaps GROUP BY r),
    near AS (SELECT r, count(*) FILTER (w0 = before) AS n FROM wins GROUP BY r),
    stats AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
      len(l) AS n_lines, coalesce(near.n, 0) AS n_neighbours,
      length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(list_filter(w, lambda x: regexp_matches(x, '[.?!]$'))) AS n_ended,
      len(regexp_split_to_array(t, '{MARKS}')) - 1 AS n_marked
      FROM cut LEFT JOIN reps USING (r) LEFT JOIN near USING (r)),
    voted AS MATERIALIZED (SELECT *, {vote} FROM stats),
    pat AS MATERIALIZED (SELECT {', '.join(f'v_{r}' for r in RULES)}, count(*) AS n FROM voted GROUP BY ALL),
    e0 AS MATERIALIZED (SELECT {PRIOR}::DOUBLE AS prior, {first})"""]
    for k in range(ROUNDS):
        rules = ", ".join(
            f"(sum(CASE WHEN v_{r} = {v} THEN {rows} ELSE 0 END) + {START[side][v + 1]} * {TRUST} * sum(n)) / (sum({rows}) + {TRUST} * sum(n)) AS {side[0]}_{r}_{v + 1}"
            for r in RULES for side, rows in (("bad", "n * (1 - p)"), ("good", "n * p")) for v in (-1, 0, 1))
        parts.append(f"""
    e{k + 1} AS MATERIALIZED (SELECT (sum(n * p) + {PRIOR} * {TRUST} * sum(n)) / (sum(n) + {TRUST} * sum(n)) AS prior, {rules}
      FROM (SELECT pat.*, 1 / (1 + exp(-({odds}))) AS p FROM pat, e{k}))""")
    return f"""WITH {','.join(parts)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND odds >= 0 AS kept
    FROM (SELECT voted.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, {odds} AS odds FROM voted, e{ROUNDS})"""


@query("op12_weak_rules", _oracle())
def op12_weak_rules(spark, sf_dir):
    """Every document's statistics and whether the rules' posterior keeps it."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
