"""Names that contain a reference: postings intersected on consistent places, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tickvault.operators import resolve


def best(spark, probes, names):
    asked = spark.createDataFrame([(p,) for p in probes], "probe string")
    table = spark.createDataFrame([(f"id{i:04}", t) for i, t in enumerate(names)], "id string, name string")
    return {r.probe: r.id for r in resolve.containing(asked, table, F.col("name"), "id").collect()}


def candidates(spark, probes, names):
    table = spark.createDataFrame(enumerate(names), "_id bigint, _t string").withColumn("_b", F.struct(F.col("_id").alias("_o")))
    asked = spark.createDataFrame([(p,) for p in probes], "probe string")
    return {(r.probe, r._id) for r in resolve.candidates(resolve.rated_tiles(asked, table), table).collect()}


def plain(probes, names):
    held = {p: next((f"id{i:04}" for i, t in enumerate(names) if t is not None and p in t), None) for p in probes if p}
    return {p: i for p, i in held.items() if i}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é日"])
def test_best_name_equals_plain_python(spark, letters):
    rnd = random.Random(len(letters))
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    names = [word(rnd.choice([0, 1, 3, 9, 40, 200])) for _ in range(120)] + [None, "a" * 300, "ab" * 70, "ab" * 70]
    probes = [word(n) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17)] + ["a" * 129, "a" * 301, "ba" * 64, "ab" * 70]
    for t in names:
        if t:
            at, n = rnd.randrange(len(t)), rnd.randint(1, len(t))
            probes += [t[at:at + n], t, t[at:at + 6] + "b"]
    assert best(spark, probes + [None], names) == plain(probes, names)


def test_names_that_share_every_gram_are_told_apart_by_distance(spark):
    # each half of a reference is common, in every name; only their distance differs
    names = [f"{'x' * (i % 50)}GENERAL HOLDINGS{'-' * i}OF THE NORTH AND SOUTH" for i in range(1, 200)]
    probes = [f"GENERAL HOLDINGS{'-' * i}OF THE NORTH" for i in (3, 77, 150)]
    found = candidates(spark, probes, names)
    expected = {(p, i) for p in probes for i, t in enumerate(names) if p in t}
    assert expected <= found
    assert len(found) <= len(expected) + 3
    assert best(spark, probes, names) == plain(probes, names)


def test_one_common_gram_brings_no_candidates(spark):
    names = [f"company {i:05} limited partners" for i in range(400)]
    probes = ["company 00017 limited", "any 00250 limited p", "company 00399 ltd", "limited partnership"]
    found = candidates(spark, probes, names)
    assert found == {(probes[0], 17), (probes[1], 250)}


def test_references_with_a_tile_in_common_share_its_places(spark):
    # 80 references whose rarest tile is in every name: its places are not paired with each of them
    names = [f"STRASSE {i:03} {'abcdefgh' * 2}" for i in range(200)]
    probes = [f"{i:03} abcdefghabcdefgh" for i in range(80)]
    asked = spark.createDataFrame([(p,) for p in probes], "probe string")
    table = spark.createDataFrame(enumerate(names), "_id bigint, _t string").withColumn("_b", F.struct(F.col("_id").alias("_o")))
    rare = spark.createDataFrame([(p, "abcdefghabcdefgh", 4, len(p)) for p in probes], "probe string, _g string, _o int, _n int")
    assert resolve._cuts(rare, table).count() == len(names)
    assert candidates(spark, probes, names) == {(p, i) for i, p in enumerate(probes)}
    assert asked.count() == len(probes) and best(spark, probes, names) == plain(probes, names)


def test_postings_that_no_reference_wants_are_left_out_before_the_shuffle(spark):
    table = spark.createDataFrame([(i, f"name {i:05} of a fund") for i in range(500)], "_id bigint, _t string")
    wanted = spark.createDataFrame([("name 0000",), ("00007 of",)], "_g string")
    kept = resolve._wanted_postings(table, (8, 9), wanted, "_id")
    assert {r._g for r in kept.collect()} >= {"name 0000", "00007 of"} and kept.count() < 20


def test_empty_tables(spark):
    assert best(spark, ["abc"], [None]) == {}
    assert best(spark, [None], ["abc"]) == {}
