"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts: the set of word shingles, a digest of the set, a MinHash
   signature and band keys. Documents with equal sets are one class from here on.
2. Every band bucket proposes its least member to all others. Signatures of a proposed
   pair are compared in batches; after each batch the pair is dropped once the posterior
   probability that its similarity reaches the threshold falls below the miss
   probability. Survivors are verified on their full sets; components follow.
3. A pair that no bucket's least member has connected may still be similar. Buckets whose
   members fall into several components are cut into blocks; tasks compare members of
   different components in the same two steps. Nothing is emitted but links found.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, materialise, query, table
from tickvault.llm.graph import components

HASHES = 128
BANDS, BAND_ROWS = 25, 5
COMPARED = 16
MISS = 1e-5
BLOCK_MEMBERS = 512
CACHED_WORDS = 200_000
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, (2, HASHES), np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; words are runs other
    than ASCII white space after lower-casing A-Z. Fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * _MIX + h[k:k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of one set under ``HASHES`` multiply-shift functions."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at:at + 512, None] * _SEEDS[0] + _SEEDS[1]
        low = np.minimum(low, part.min(axis=0) >> np.uint64(32))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = low[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    for k in range(BAND_ROWS):
        h = _mix(h * _MIX + rows[:, k])
    return h.view(np.int64)


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """Matches needed after each batch to go on: fewer, and the posterior probability of a
    similarity of at least ``threshold`` (uniform prior) is below ``miss``."""
    s = np.linspace(0, 1, 20_001)[1:-1]
    out = []
    for n in range(COMPARED, HASHES + 1, COMPARED):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Indices of the row pairs of two signature arrays that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        cut = slice(k * COMPARED, (k + 1) * COMPARED)
        matches += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        on = matches >= least
        alive, matches = alive[on], matches[on]
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the sets themselves."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_FACTS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                    ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                shingles = shingle_set(text, width)
                if not len(shingles):
                    row = 0, None, None, None
                else:
                    low = signature(shingles)
                    row = (len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()),
                           low.astype("<u2").tobytes(), band_keys(low))
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(out, list(_FACTS)[1:]))], schema=_FACTS)
        _WORDS.clear()  # the worker goes on to other stages
    return run


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], schema=schema)
        _WORDS.clear()
    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _prune(percent: int, miss: float):
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = pa.array(survivors(_signatures(b.column(2)), _signatures(b.column(3)), needed))
            yield pa.RecordBatch.from_arrays([b.column(0).take(on), b.column(1).take(on)], schema=_PAIR)
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            b = b.filter(pa.array(on, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=_PAIR)
    return run


def _links_inside(members: list[tuple], percent: int, needed: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components, enough to connect what is similar.

    Members are (node, root, band, bands, signature, shingles). A pair is taken in the first
    band that its members share, and skipped once links found here connect its components.
    """
    root = {m[1]: m[1] for m in members}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    roots = np.array([m[1] for m in members])
    band = members[0][2]
    bands = np.array([m[3] for m in members])[:, :band + 1]
    sigs = np.frombuffer(b"".join(m[4] for m in members), "<u2").reshape(-1, HASHES)
    sets = [np.frombuffer(m[5], np.uint64) for m in members]
    sizes = np.array([len(x) for x in sets])
    links = []
    for i in range(len(members) - 1):
        j = np.arange(i + 1, len(members))
        j = j[(roots[j] != roots[i]) & (bands[j, band] == bands[i, band]) & ~(bands[j, :band] == bands[i, :band]).any(axis=1)]
        j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
        if len(j):
            for k in j[survivors(np.broadcast_to(sigs[i], (len(j), HASHES)), sigs[j], needed)]:
                a, b = find(members[i][1]), find(members[k][1])
                if a != b and similar(sets[i], sets[k], percent):
                    root[max(a, b)] = min(a, b)
                    links.append((members[i][0], members[k][0]))
    return links


def _compare_blocks(percent: int, miss: float):
    needed = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, some in itertools.groupby(rows, key=lambda r: r[:4]):
            members = [r[4:] for r in some]
            u, v = zip(*links) if (links := _links_inside(members, percent, needed)) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_PAIR)
    return run


def _block_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket in every pair of blocks it must meet: members of the bucket's
    first component meet blocks of the others, and those meet every block."""
    other = F.col("root") != F.col("first")
    blocks = members.groupBy("key").agg(
        F.ceil(F.count_if(~other) / BLOCK_MEMBERS).cast("int").alias("n_first"),
        F.ceil(F.count_if(other) / BLOCK_MEMBERS).cast("int").alias("n_other"))
    m = members.join(blocks, "key")
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.when(other, F.col("n_other")).otherwise(F.col("n_first"))).cast("int"))
    ids = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    meets = F.when(other, F.concat(
        F.transform(ids(F.col("n_first")), lambda i: pair(0, i, F.col("block"))),
        F.transform(ids(F.col("n_other")), lambda i: pair(1, F.least(i, F.col("block")), F.greatest(i, F.col("block")))),
    )).otherwise(F.transform(ids(F.col("n_other")), lambda i: pair(0, F.col("block"), i)))
    return m.withColumn("meet", F.explode(meets)).select("key", "meet.kind", "meet.a", "meet.b", "node", "root", "band")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= ``percent`` * union are linked;
    component_id is the least doc_id reachable. Null, empty and blank texts have no shingles
    and link with nothing. Rows that share a doc_id are one document with the links of
    each of its texts. A row with a null doc_id links with nothing and has no component_id;
    it is kept. An empty table gives no rows; columns but doc_id and text are not read.
    """
    facts = materialise(map_arrow(docs.select("doc_id", "text"), _facts(width),
                                  "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"),
                        "minhash-facts")
    # Equal sets have equal signatures and bands, so any row's will do.
    classes = materialise(
        facts.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "minhash-classes")
    in_bands = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = in_bands.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialise(in_bands.join(buckets, "key"), "minhash-buckets")
    pairs = crowded.where("node <> hub").select("hub", "node").distinct()
    sig_of = classes.select("node", "sig")
    with_sigs = (pairs.join(sig_of, "node")
                 .join(sig_of.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub"))
    likely = materialise(map_arrow(with_sigs.select("node", "hub", "sig", "hub_sig"), _prune(percent, miss),
                                   "u long, v long"), "minhash-likely")
    wanted = (likely.select("u").union(likely.select("v")).union(crowded.where("n > 2").select("node"))
              .toDF("doc_id").distinct())
    sets = materialise(map_arrow(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), _sets(width),
                                 "node long, shingles binary"), "minhash-sets")
    with_sets = (likely.join(sets.toDF("u", "s"), "u").join(sets.toDF("v", "t"), "v").select("u", "v", "s", "t"))
    found = materialise(map_arrow(with_sets, _verify(percent), "u long, v long"), "minhash-links")
    roots = components(found)
    rooted = (crowded.where("n > 2").join(roots, "node", "left")
              .select("key", "node", "band", "hub", F.coalesce("root", "node").alias("root")))
    mixed = (rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                       F.min(F.when(F.col("node") == F.col("hub"), F.col("root"))).alias("first"))
             .where("lo <> hi").select("key", "first"))
    meetings = _block_pairs(rooted.join(mixed, "key"))
    blocks = (meetings.join(classes.select("node", "bands", "sig"), "node").join(sets, "node")
              .select("key", "kind", "a", "b", "node", "root", "band", "bands", "sig", "shingles")
              .repartition("key", "kind", "a", "b").sortWithinPartitions("key", "kind", "a", "b", "node"))
    more = materialise(map_arrow(blocks, _compare_blocks(percent, miss), "u long, v long"), "minhash-more")
    final = components(found.unionByName(more)).select("node", F.col("root").alias("least"))
    class_roots = (classes.select("digest", "node").join(final, "node", "left")
                   .select("digest", F.coalesce("least", "node").alias("class_root")))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class_root"))
    return (facts.select("doc_id", "n_shingles", "digest").join(class_roots, "digest", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents on two-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
