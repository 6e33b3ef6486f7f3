"""Free-text reference resolution.

All references are resolved in one job. Distinct references are matched
tier by tier with equi-joins; the best tier wins per reference, and ties go
to the earliest instrument (createdAt, then id).

"Name contains the reference" is a theta join. Distinct names are indexed by
their substrings of a few fixed lengths (``GRAMS``): linear in the text. A
reference of such a length finds its answer in the per-gram aggregate. A longer one
is cut into tiles, grams that cover it end to end. Each place (name, position) of its rarest
tile says where the reference would begin; the text of that length is cut out there and
compared. References with the same rarest tile, distance and length share the cut, so
there are at most as many cuts as places times the few distances and lengths of a tile,
however many references there are. A filter of fixed size keeps the grams that no tile can
be equal to from being shuffled. Exact, without a bound on lengths and without any job
while the query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickvault.operators.catalog import active

# fixed values: the provider type chosen first when no source is given
PREFERRED_PROVIDER_TYPE = "yahoo"
# Lengths of the indexed substrings. 1 is needed: every reference has a gram of its own length
# or shorter. Up to three characters, where grams are common, a reference is itself a gram.
GRAMS = (1, 2, 3, 4, 8, 16, 32, 64)
TILED = tuple(g for g in GRAMS if g > 3)
# Bits of the filter of wanted grams, held as 64-bit words: at most 2 ** 19 of them are broadcast.
FILTER_BITS = 25


def _order(df: DataFrame, id_col: str) -> Column:
    cols = [c for c in ("createdAt", id_col) if c in df.columns]
    return F.struct(*cols)


def _cut(text: Column, length: int) -> Column:
    """The substrings of ``text`` that are ``length`` characters long, with their places from 0."""
    starts = F.length(text) - length + 1
    return F.when(starts > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(starts, F.lit(1))),
        lambda i: F.struct(F.substring(text, i, F.lit(length)).alias("_g"), (i - 1).alias("_at")))
                  ).otherwise(F.array().cast("array<struct<_g:string,_at:int>>"))


def _postings(names: DataFrame, lengths: tuple[int, ...], *columns: str) -> DataFrame:
    """(``columns``, _g, _at): every place of every gram of the names."""
    grams = F.flatten(F.array(*[_cut(F.col("_t"), g) for g in lengths]))
    return names.select(*columns, F.inline(grams))


def _wanted_postings(names: DataFrame, lengths: tuple[int, ...], wanted: DataFrame, *columns: str) -> DataFrame:
    """``_postings`` without most of the grams that are not among the ``wanted`` (_g)."""
    place = F.xxhash64("_g").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    held = (wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    hit = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return (_postings(names, lengths, *columns).join(F.broadcast(held), (word == F.col("_word")) & hit)
            .drop("_word", "_bits"))


def _tiles() -> Column:
    """The grams that cover ``probe``: one after the other, and the one at its end."""
    n, size = F.length("probe"), F.greatest(*[F.when(F.length("probe") >= g, F.lit(g)) for g in GRAMS])
    places = F.array_union(F.sequence(F.lit(0), n - size, size), F.array(n - size))
    return F.transform(places, lambda o: F.struct(F.substring(F.col("probe"), o + 1, size).alias("_g"), o.alias("_o")))


def rated_tiles(probes: DataFrame, names: DataFrame) -> DataFrame:
    """(probe, _r, _best): each probe's tiles (_places, _g, _o) from the rarest on, and for a probe that
    is itself a gram the best of the ``names`` (_id, _t, _b) that hold it."""
    tiles = probes.select("probe", F.inline(_tiles()))
    # Summed up by gram in each task first: a common gram is one row of a task.
    per_gram = (_wanted_postings(names, GRAMS, tiles.select("_g"), "_b")
                .groupBy("_g").agg(F.count(F.lit(1)).alias("_places"), F.min_by("_b", F.col("_b")["_o"]).alias("_best")))
    rated = F.struct(F.coalesce("_places", F.lit(0)).alias("_places"), "_g", "_o")
    # as many entries as the probe itself has tiles
    return (tiles.join(per_gram, "_g", "left").groupBy("probe")
            .agg(F.array_sort(F.collect_list(rated)).alias("_r"), F.min_by("_best", F.col("_g")).alias("_best"))
            .filter(F.col("_r")[0]["_places"] > 0))  # a tile that no name has rules the probe out


def _long(rated: DataFrame) -> DataFrame:
    """(probe, _g, _o, _n): the probes that are no single gram, with their rarest tile, its place and their length."""
    rarest = F.col("_r")[0]
    return (rated.filter(F.col("probe") != rarest["_g"])
            .select("probe", rarest["_g"].alias("_g"), rarest["_o"].alias("_o"), F.length("probe").alias("_n")))


def _cuts(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(probe, _id, _b): the texts of the ``names`` that lie about the tiles of ``asked`` (``_long``)
    like a probe; each probe comes with every name that contains it, and other texts are among them."""
    shapes = asked.select("_g", "_o", "_n").distinct()
    sized = names.select("_id", "_t", F.length("_t").alias("_size"))
    begins = (_wanted_postings(sized, TILED, shapes.select("_g"), "_id", "_size").join(shapes, "_g")
              .select("_id", (F.col("_at") - F.col("_o")).alias("_start"), "_n", "_size")
              .filter((F.col("_start") >= 0) & (F.col("_start") + F.col("_n") <= F.col("_size"))))
    return (begins.join(names.select("_id", "_t", "_b"), "_id")
            .select(F.substring("_t", F.col("_start") + 1, F.col("_n")).alias("probe"), "_id", "_b"))


def candidates(rated: DataFrame, names: DataFrame) -> DataFrame:
    """(probe, _id): the ``names`` that contain a probe. Probes that are a single gram have no row."""
    asked = _long(rated)
    return _cuts(asked, names).join(asked, "probe", "left_semi").select("probe", "_id").distinct()


def containing(probes: DataFrame, df: DataFrame, text: Column, id_col: str) -> DataFrame:
    """(probe, id, _o): for every distinct non-empty ``probe`` the best row of ``df``, in
    (createdAt, id) order, whose ``text`` contains it; no row where none does. Null texts
    contain nothing. Names that share a text are indexed once."""
    names = (df.select(text.alias("_t"), _order(df, id_col).alias("_o"), F.col(id_col))
             .filter(F.length("_t") > 0)
             .groupBy("_t").agg(F.min_by(F.struct("_o", id_col), "_o").alias("_b"))
             .withColumn("_id", F.xxhash64("_t")))
    rated = rated_tiles(probes.select("probe").filter(F.length("probe") > 0).distinct(), names)
    whole = rated.filter(F.col("probe") == F.col("_r")[0]["_g"]).select("probe", F.col("_best").alias("_b"))
    asked = _long(rated)
    longer = (_cuts(asked, names).groupBy("probe").agg(F.min_by("_b", F.col("_b")["_o"]).alias("_b"))
              .join(asked.select("probe"), "probe"))
    return whole.unionByName(longer).select(
        "probe", F.col("_b")[id_col].alias(id_col), F.col("_b")["_o"].alias("_o"))


def resolve_instruments(refs: DataFrame, instruments: DataFrame, ref_col: str = "ref",
                        mode: str = "tool") -> DataFrame:
    """Reference -> instrumentId (null when unresolved), with the tier.

    Tiers (``mode="tool"``): 1 the reference already is an id (``INST_``
    prefix); 2 symbol = upper(ref); 3 upper(symbol) = upper(ref);
    4 upper(name) contains upper(ref). ``mode="exact"`` (the latest-price
    tool) uses tier 1 and an exact symbol match only.
    Only active instruments match, and unlike the reference no 200-row scan
    limit applies.
    """
    if mode not in ("tool", "exact"):
        raise ValueError("mode must be 'tool' or 'exact'")
    act = active(instruments)
    distinct = refs.select(F.col(ref_col).alias("ref")).distinct().filter(F.col("ref").isNotNull())
    o = _order(act, "instrumentId")
    if mode == "exact":
        keyed = act.select(F.col("symbol").alias("_k"), F.lit(2).alias("tier"),
                           o.alias("_o"), "instrumentId")
        probe = F.col("ref")
    else:
        # Tiers 2-4 all compare a text with upper(ref): one keyed table holds
        # every candidate text with its tier, and the references are joined
        # (and shuffled) once.
        plain = distinct.filter(~F.col("ref").startswith("INST_"))
        named = containing(plain.select(F.upper("ref").alias("probe")), act, F.upper("name"), "instrumentId")
        keyed = (act.select(F.col("symbol").alias("_k"), F.lit(2).alias("tier"),
                            o.alias("_o"), "instrumentId")
                 .unionByName(act.select(F.upper("symbol").alias("_k"), F.lit(3).alias("tier"),
                                         o.alias("_o"), "instrumentId"))
                 .unionByName(named.select(F.col("probe").alias("_k"), F.lit(4).alias("tier"),
                                           "_o", "instrumentId")))
        probe = F.upper("ref")
    best = keyed.groupBy("_k").agg(
        F.min_by(F.struct("instrumentId", "tier"), F.struct("tier", "_o")).alias("_w"))
    matched = (distinct.filter(~F.col("ref").startswith("INST_"))
               .join(best, probe == best["_k"])
               .select("ref", "_w.instrumentId", "_w.tier"))
    by_id = (distinct.filter(F.col("ref").startswith("INST_"))
             .select("ref", F.col("ref").alias("instrumentId"), F.lit(1).alias("tier")))
    won = matched.unionByName(by_id).withColumnRenamed("ref", ref_col)
    return refs.join(won, ref_col, "left")


def resolve_sources(refs: DataFrame, sources: DataFrame, ref_col: str = "ref",
                    mode: str = "tool") -> DataFrame:
    """Reference -> dataSourceId.

    A ``DS_`` prefix passes as it is; otherwise the first source (in
    createdAt, id order) whose name or type equals the reference, or whose
    name contains it, ignoring case; otherwise the reference passes through
    unchanged (``resolved`` false). ``mode="exact"`` drops the contains rule.
    """
    distinct = refs.select(F.col(ref_col).alias("ref")).distinct().filter(F.col("ref").isNotNull())
    o = _order(sources, "dataSourceId")
    by_type = sources.select(F.lower("providerType").alias("_k"), o.alias("_o"), "dataSourceId")
    if mode == "exact":
        by_name = sources.select(F.lower("providerName").alias("_k"), o.alias("_o"),
                                 "dataSourceId")
    else:
        # equality with the name is one way to be contained in it
        plain = distinct.filter(~F.col("ref").startswith("DS_"))
        by_name = containing(plain.select(F.lower("ref").alias("probe")), sources,
                             F.lower("providerName"), "dataSourceId").withColumnRenamed("probe", "_k")
    # the rules have no precedence: the first source matching any of them
    keyed = (by_type.unionByName(by_name.select("_k", "_o", "dataSourceId"))
             .groupBy("_k").agg(F.min_by("dataSourceId", "_o").alias("_id")))
    plain = distinct.filter(~F.col("ref").startswith("DS_"))
    won = (plain.join(keyed, F.lower("ref") == keyed["_k"])
           .select(F.col("ref").alias(ref_col), "_id"))
    out = refs.join(won, ref_col, "left")
    prefixed = F.col(ref_col).startswith("DS_")
    return out.select(*refs.columns,
                      F.when(prefixed, F.col(ref_col)).otherwise(F.coalesce("_id", F.col(ref_col)))
                      .alias("dataSourceId"),
                      (prefixed | F.col("_id").isNotNull()).alias("resolved"))


def default_source(instruments: DataFrame, series: DataFrame, sources: DataFrame,
                   preferred: str = PREFERRED_PROVIDER_TYPE) -> DataFrame:
    """The source to use when none is given, per instrument.

    Among the sources having data for the instrument: the preferred type if
    present, else the first. With none: any preferred source, else the first
    source overall. ``how`` tells which rule chose.
    """
    extra = [c for c in ("createdAt",) if c in sources.columns]
    rank = lambda df: F.struct((F.col("providerType") != preferred).alias("_np"),
                               *[F.col(c) for c in extra], F.col("dataSourceId"))
    pairs = (series.select("instrumentId", "dataSourceId").distinct()
             .join(sources.select("dataSourceId", "providerType", *extra), "dataSourceId"))
    per = pairs.groupBy("instrumentId").agg(F.min_by(F.struct("dataSourceId", "providerType"),
                                                     rank(pairs)).alias("_s"))
    fb = sources.agg(F.min_by(F.struct("dataSourceId", "providerType"), rank(sources)).alias("_s")
                     ).first()
    fb_id = fb["_s"]["dataSourceId"] if fb and fb["_s"] else None
    fb_how = ("fallback_preferred" if fb and fb["_s"] and fb["_s"]["providerType"] == preferred
              else "fallback_first")
    out = instruments.select("instrumentId").distinct().join(per, "instrumentId", "left")
    chosen = F.col("_s.dataSourceId")
    how = (F.when(chosen.isNull(), F.lit(fb_how if fb_id else None))
           .when(F.col("_s.providerType") == preferred, "preferred").otherwise("first"))
    return out.select("instrumentId", F.coalesce(chosen, F.lit(fb_id)).alias("dataSourceId"),
                      how.alias("how"))
