"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every shingle is hashed once. The top bits of the hash name one of ``BINS`` bins; each
bin keeps its least hash. An empty bin borrows from the first non-empty bin of its own
random probe sequence (optimal densification). The low ``BITS`` bits of the bins are
packed into words, and the likeness of two fingerprints is their share of equal bins,
corrected for bins that are equal by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import query, table

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
PER_WORD = 64 // BITS
PROBES = 24
WIDTH = 5
# Rows whose ids agree but for the last bits are ordered in one task: at most 2^10 distinct ids.
GROUP_BITS = 10
LEVEL_BITS = 12


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def _pick(dense: Column, filled: Column, b: Column) -> Column:
    """The value an empty bin takes: that of the first non-empty bin it probes. Should all
    probes fail, that of the non-empty bin with the least hash for this bin."""
    probes = [F.get(dense, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
    ranked = F.transform(filled, lambda h: F.struct(F.xxhash64(b, _bin(h), F.lit(PROBES)).alias("r"), h.alias("h")))
    return F.coalesce(*probes, F.array_min(ranked)["h"])


def with_fingerprint(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """Add ``out``: the packed words (array of long) of the text column ``text``; the array is
    empty for a text without words. Fewer words than ``width`` are one shingle."""
    c = lambda name: F.col(f"_{out}_{name}")
    step = lambda df, name, e: df.withColumn(f"_{out}_{name}", e)
    df = step(df, "words", F.transform(
        F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    several = F.transform(F.sequence(F.lit(0), F.size(c("words")) - width), lambda i: F.xxhash64(
        *[F.get(c("words"), i + k) for k in range(width)]))
    df = step(df, "hashes", F.sort_array(F.array_distinct(
        F.when(F.size(c("words")) >= width, several).when(F.size(c("words")) > 0, F.array(F.xxhash64(c("words"))))
        .otherwise(F.array().cast("array<long>")))))
    # Sorted hashes come bin by bin, so the first one of each bin is its least.
    df = step(df, "filled", F.filter(c("hashes"), lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(c("hashes"), i - 1)))))
    gap = lambda h, i: _bin(h) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(c("filled"), i - 1))) - 1
    none = F.lit(None).cast("long")
    spread = F.flatten(F.transform(c("filled"), lambda h, i: F.concat(F.array_repeat(none, gap(h, i)), F.array(h))))
    df = step(df, "dense", F.concat(spread, F.array_repeat(none, BINS - 1 - _bin(F.get(c("filled"), F.size(c("filled")) - 1)))))
    # Hashed with their bin, values that several bins took from one differ in their low bits,
    # so chance makes each bin equal on its own.
    df = step(df, "full", F.transform(
        c("dense"), lambda h, b: F.xxhash64(F.coalesce(h, _pick(c("dense"), c("filled"), b)), b)))
    word = lambda k: F.aggregate(
        F.slice(c("full"), k * PER_WORD + 1, PER_WORD), F.lit(0).cast("long"),
        lambda acc, h: F.shiftleft(acc, BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << BITS) - 1))))
    # Named once per word, so that the optimizer keeps the bins as a column of their own.
    packed = F.array(*[word(k) for k in range(BINS // PER_WORD)])
    df = df.withColumn(out, F.when(F.size(c("filled")) > 0, packed).otherwise(F.array().cast("array<long>")))
    return df.drop(*[f"_{out}_{n}" for n in ("words", "hashes", "filled", "dense", "full")])


def as_text(words: Column) -> Column:
    """The packed bits as lower-case hex; empty for a text without words."""
    return F.lower(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal bins less what chance alone
    makes equal. Two fingerprints of no words are alike, one and another are not."""
    ones = F.lit(int("1" * PER_WORD, 16))

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = reduce(lambda acc, k: acc.bitwiseOR(F.shiftrightunsigned(d, k)), range(1, BITS), d)
        return F.bit_count(folded.bitwiseAND(ones)).cast("int")

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0 ** -BITS
    corrected = ((1 - unlike / F.lit(float(BINS))) - chance) / (1 - chance)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(corrected, F.lit(0.0))))


def _next_group(groups: DataFrame) -> DataFrame:
    """(grp, after): the next group that has rows, the first one after the last. Groups are
    ordered within stretches of 2^LEVEL_BITS groups; only one row per stretch meets all others."""
    stretches = groups.withColumn("stretch", F.shiftright("grp", LEVEL_BITS))
    inside = Window.partitionBy("stretch").orderBy("grp")
    firsts = stretches.groupBy("stretch").agg(F.min("grp").alias("first"))
    order = Window.orderBy("stretch")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("stretch", F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("jump"))
    return (stretches.withColumn("after", F.lead("grp").over(inside)).join(following, "stretch")
            .select("grp", F.coalesce("after", "jump").alias("after")))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last quarter of code points replaced by the first as many (or
    all) of the next document, in order of doc_id; the last document is followed by the
    first. Null text counts as empty. A null doc_id comes first; rows that share a doc_id
    are ordered by their texts. A table of one row is followed by itself; an empty one
    gives no rows; columns but doc_id and text are not read.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_fingerprint(base, "text", "words", width).withColumn("grp", F.shiftright(order, GROUP_BITS))
    dealt = base.repartition("grp")
    inside = Window.partitionBy("grp").orderBy(order, "text")
    followed = (dealt.withColumn("next_text", F.lead("text").over(inside))
                .withColumn("next_words", F.lead("words").over(inside)))
    firsts = (dealt.withColumn("nth", F.row_number().over(inside)).where("nth = 1")
              .select(F.col("grp").alias("after"), F.col("text").alias("first_text"), F.col("words").alias("first_words")))
    groups = docs.select(F.shiftright(order, GROUP_BITS).alias("grp")).distinct()
    jumps = _next_group(groups).join(firsts, "after").select(F.col("grp").alias("g"), "first_text", "first_words")
    last = F.col("next_text").isNull()
    rows = (followed.join(jumps, (F.col("grp") == F.col("g")) & last, "left")
            .withColumn("next_text", F.coalesce("next_text", "first_text"))
            .withColumn("next_words", F.coalesce("next_words", "first_words"))
            .withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("cut")),
                                           F.substring("next_text", F.lit(1), F.col("cut")))))
    rows = with_fingerprint(rows.select("doc_id", "n", "edited", "words", "next_words"), "edited", "edited_words", width)
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("words")).alias("fingerprint"), as_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        likeness(F.col("words"), F.col("next_words")).alias("near_next"))


@query("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
