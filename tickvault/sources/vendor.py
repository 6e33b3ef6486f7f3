"""Vendor price files: CSV scan (O01), column mapping (O02), daily history
frames (O03) and external JSON payloads (O04).

Everything is read with Spark's readers and mapped with built-in
expressions: ``try_cast`` for numbers, ``try_parse_json`` / ``variant_get``
for open JSON, so a bad value nulls one cell instead of failing the task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.functions.columns import first_truthy, parse_iso_utc, split_indicators
from tickvault.schemas import INDICATORS

DATE_COLUMNS = ("Date", "date", "DATE")


@dataclass(frozen=True)
class Feed:
    """One vendor file layout: a path glob and its column map.

    ``col_map`` maps a vendor header (matched lower-cased and trimmed) to an
    indicator. Several headers may map to one indicator; the last entry with
    a usable value wins (e.g. an adjusted close over the raw close).

    In a ``bundled`` feed a stored file holds the records of many vendor files, in any order and
    each with its own header; the first cell of a record is the name of the file it belongs to.
    """
    name: str
    path: str
    col_map: tuple[tuple[str, str], ...]
    options: dict = field(default_factory=dict)
    bundled: bool = False


# The column names of the known vendor files and the indicator each one fills.
EQUITIES_COLUMNS = (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"),
                    ("volume", "volume"), ("adj. open", "open"), ("adj. close", "close"))
GOLD_COLUMNS = (("usdm", "close"), ("usd (pm)", "close"), ("usdpm", "open"), ("usdpm - pm high", "high"),
                ("usdpm - pm low", "low"))
SILVER_COLUMNS = (("usdm", "close"), ("usd (pm)", "close"))
CRYPTO_COLUMNS = (("last", "close"), ("high", "high"), ("low", "low"), ("bid", "open"),
                  ("volume", "volume"))
YIELD_COLUMNS = (("value", "close"),)


def _usable_number(text: Column) -> Column:
    t = F.trim(text)
    v = t.try_cast("double")
    ok = t.isNotNull() & (t != "") & (t != "None") & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, F.bround(v, 4))


def map_vendor_columns(raw: DataFrame, col_map, keep: list[str] | None = None
                       ) -> tuple[DataFrame, DataFrame]:
    """Vendor CSV rows (all-string columns) -> series-shaped rows.

    Rules: the date is the first non-empty of Date/date/DATE and must read as
    year-month-day; values that are empty, 'None', non-numeric or non-finite
    are skipped; numbers are rounded half-even to 4 places; a row without a
    close is dropped; open/high/low default to the close and volume to 0.
    Returns (rows, rejects-with-reason).
    """
    by_header = {c.strip().lower(): c for c in raw.columns}
    values: dict[str, Column] = {}
    for vendor_col, indicator in col_map:
        src = by_header.get(vendor_col.strip().lower())
        if src is None:
            continue
        v = _usable_number(F.col(f"`{src}`"))
        # later map entries take precedence when they hold a usable value
        values[indicator] = F.coalesce(v, values[indicator]) if indicator in values else v
    nul = F.lit(None).cast("double")
    close = values.get("close", nul)
    dates = [F.col(c) for c in DATE_COLUMNS if c in raw.columns]
    date_text = F.trim(first_truthy(*dates)) if dates else F.lit(None).cast("string")
    day = F.when(date_text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
                 F.try_to_date(date_text, "yyyy-M-d"))
    extra = {k: v for k, v in values.items() if k not in INDICATORS}
    extras = (F.map_filter(F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)]),
                           lambda k, v: v.isNotNull()) if extra else F.lit(None).cast("map<string,double>"))
    reason = (F.when(date_text.isNull(), "missing date").when(close.isNull(), "no close")
              .when(day.isNull(), "bad date"))
    keep = keep or []
    mapped = raw.select(
        *keep,
        day.cast("timestamp_ntz").alias("dataTimestamp"),
        F.coalesce(values.get("open", nul), close).alias("open"),
        F.coalesce(values.get("high", nul), close).alias("high"),
        F.coalesce(values.get("low", nul), close).alias("low"),
        close.alias("close"),
        F.coalesce(values.get("volume", nul), F.lit(0.0)).alias("volume"),
        extras.alias("extras"),
        F.lit("verified").alias("dataQuality"),
        reason.alias("reject_reason"),
    )
    good = mapped.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = mapped.filter(F.col("reject_reason").isNotNull())
    return good, bad


def scan_vendor_csv(spark: SparkSession, feeds: list[Feed], files: DataFrame,
                    instruments: DataFrame, file_name_col: str | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """Read every feed's files, map their columns and attach instruments.

    ``files`` maps a file name to a symbol (file_name, symbol); files not in
    it, and symbols not registered, are skipped (inner joins, the small side
    broadcast by AQE when it is small). All columns are read as text, and each
    file's columns are found by its own header, so files of one feed may order
    them differently. A header is a row with one of ``DATE_COLUMNS`` among its
    cells; a file without one gives no rows. The feed's widest header tells how
    many columns are read, in a job while the query is built. The file name is the file's own name, or a
    partition column (``file_name_col``) for a folder layout such as
    ``file=AAPL.csv/part-*.csv``, or the first cell of a record of a ``bundled`` feed: where files
    are many and small, opening each costs more than reading it.
    """
    parts = []
    for feed in feeds:
        rows, _ = map_vendor_columns(_rows_by_header(spark, feed, file_name_col, keep or []),
                                     feed.col_map, keep=["file_name", *(keep or [])])
        parts.append(rows.withColumn("feed", F.lit(feed.name)))
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p, allowMissingColumns=True)
    inst = instruments.select("symbol", "instrumentId")
    return allrows.join(files, "file_name").join(inst, "symbol")


def _header_width(spark: SparkSession, feed: Feed, opts: dict) -> int:
    """The most cells a header of the feed can have: one scalar, in one scan.

    Read as one column, every wider record counts as malformed and comes whole. Separators
    inside quotes count too, so a width may be too large, never too small.
    """
    separator = opts.get("sep", opts.get("delimiter", ","))
    whole = {**opts, "columnNameOfCorruptRecord": "_record"}
    records = spark.read.options(**whole).schema("c0 string, _record string").csv(feed.path)
    records = records.select(F.coalesce("_record", "c0").alias("_record"))
    named = F.greatest(*[F.contains("_record", F.lit(c)) for c in DATE_COLUMNS])
    width = F.size(F.split("_record", "\\Q" + separator.replace("\\t", "\t") + "\\E"))
    return records.agg(F.max(F.when(named, width)).alias("n")).first()["n"] or 1


def _rows_by_header(spark: SparkSession, feed: Feed, file_name_col: str | None,
                    keep: list[str]) -> DataFrame:
    """The feed's rows under the names its map asks for, whatever the order in each file."""
    opts = {"header": "false", "mode": "PERMISSIVE", **feed.options}
    cells = [f"c{i}" for i in range(_header_width(spark, feed, opts))]
    schema = ", ".join(f"{c} string" for c in cells)
    if file_name_col:
        schema += f", {file_name_col} string"
    lines = spark.read.options(**opts).schema(schema).csv(feed.path)
    name = F.col(file_name_col) if file_name_col else F.col("_metadata.file_name")
    path = F.col("_metadata.file_path")
    if feed.bundled:
        name, path, cells = F.col("c0"), F.col("c0"), cells[1:] or cells
    lines = lines.select(name.cast("string").alias("file_name"), path.alias("_path"), F.array(*cells).alias("_cells"))
    is_header = F.exists("_cells", lambda c: F.coalesce(F.trim(c).isin(*DATE_COLUMNS), F.lit(False)))
    # One row per file; a file read in several splits has one header all the same.
    headers = lines.filter(is_header).groupBy("_path").agg(F.min("_cells").alias("_names"))
    exact = F.transform("_names", F.trim)
    folded = F.transform("_names", lambda c: F.lower(F.trim(c)))

    def cell(names, wanted):
        # the last column of a repeated name counts, and a name the file lacks is null
        at = F.array_max(F.transform(names, lambda c, i: F.when(c == wanted, i)))
        return F.get("_cells", at)

    mapped = list(dict.fromkeys(c.strip().lower() for c, _ in feed.col_map))
    return (lines.filter(~is_header).join(headers, "_path")
            .select("file_name", *[cell(exact, F.lit(c)).alias(c) for c in keep],
                    F.coalesce(*[F.nullif(cell(exact, F.lit(c)), F.lit("")) for c in DATE_COLUMNS]).alias("Date"),
                    *[cell(folded, F.lit(c)).alias(c) for c in mapped if c not in keep]))


def normalise_history_frame(wide: DataFrame, date_col: str = "Date") -> DataFrame:
    """A daily OHLCV(+dividends, splits) frame -> series-shaped rows.

    Prices rounded half-even to 4 places, dividends to 6 (missing -> 0),
    volume truncated to a whole number, splits kept (missing -> 0). Rows
    whose price or volume is not a finite number are dropped.
    """
    def num(c):
        return F.col(f"`{c}`").try_cast("double") if c in wide.columns else F.lit(None).cast("double")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    o, h, lo, c = num("Open"), num("High"), num("Low"), num("Close")
    vol = F.coalesce(num("Volume"), F.lit(0.0))
    div = F.coalesce(num("Dividends"), F.lit(0.0))
    split = F.coalesce(num("Stock Splits"), F.lit(0.0))
    ok = finite(o) & finite(h) & finite(lo) & finite(c) & finite(vol)
    return (wide.filter(ok).select(
        F.col(date_col).cast("timestamp_ntz").alias("dataTimestamp"),
        F.bround(o, 4).alias("open"), F.bround(h, 4).alias("high"),
        F.bround(lo, 4).alias("low"), F.bround(c, 4).alias("close"),
        F.when(vol < 0, F.ceil(vol)).otherwise(F.floor(vol)).cast("double").alias("volume"),
        F.create_map(F.lit("dividends"), F.bround(div, 6),
                     F.lit("stock_splits"), split).alias("extras"),
        F.lit("verified").alias("dataQuality"),
        *[x for x in wide.columns if x not in
          (date_col, "Open", "High", "Low", "Close", "Volume", "Dividends", "Stock Splits")]))


# Keys of a record that are no extra indicators.
EXTERNAL_RESERVED = ("open", "close", "high", "low", "volume", "timestamp", "instrumentId",
                     "dataSourceId", "symbol", "id")


_NUMERIC_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DOUBLE", "FLOAT")
_EXTERNAL_KEYS = ("instrumentId", "symbol", "id", "timestamp", *INDICATORS)


def _truthy_text(kind: Column, text: Column, num: Column) -> Column:
    """A JSON value as text when Python would find it truthy (non-empty
    string, non-zero number, true), else null."""
    return (F.when(kind == "STRING", F.nullif(text, F.lit("")))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")))
            .when(kind.startswith("DECIMAL") | kind.isin(*_NUMERIC_KINDS),
                  F.when(num != 0, text)))


def normalise_external_json(payloads: DataFrame, batch_ts, payload_col: str = "payload",
                            keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """External API payloads -> series-shaped records.

    A payload may be a JSON list of records, an object whose ``data`` is a
    list, or a single record object; anything else yields nothing. Per
    record: instrument = first truthy of instrumentId, symbol, id; timestamp
    missing or empty -> batch time, present but unparsable -> record
    dropped; open/close/high/low/volume default to 0 and a value that is not
    a number (JSON null included) drops the record; every other key becomes
    an extra indicator (numbers in ``extras``, other values in ``texts``). Returns (records, rejects-with-reason).

    The JSON is parsed once into a VARIANT; each field's type, text and
    number are then extracted once, in stages, so no extraction is repeated
    inside the larger expressions built on them.
    """
    keep = keep or []
    v = F.try_parse_json(F.col(payload_col))
    staged = payloads.select(*keep, v.alias("_v")).select(
        *keep, "_v", F.schema_of_variant("_v").alias("_kind"),
        F.try_variant_get("_v", "$.data", "array<variant>").alias("_data"))
    items = (F.when(F.col("_kind").startswith("ARRAY"),
                    F.try_variant_get("_v", "$", "array<variant>"))
             .when(F.col("_data").isNotNull(), F.col("_data"))
             .when(F.col("_kind").startswith("OBJECT"), F.array("_v")))
    rows = staged.select(*keep, F.posexplode(items).alias("item_pos", "item"))
    # Path lookups search the variant's sorted keys; nothing is rebuilt, so
    # the checks stay cheap even where the optimizer repeats them in filters.
    typed = rows.select(*keep, "item_pos", "item", *[
        x for k in _EXTERNAL_KEYS for x in (
            F.try_variant_get("item", f"$.{k}", "variant").isNotNull().alias(f"_p_{k}"),
            F.schema_of_variant(F.try_variant_get("item", f"$.{k}", "variant")).alias(f"_k_{k}"),
            F.try_variant_get("item", f"$.{k}", "string").alias(f"_t_{k}"),
            F.try_variant_get("item", f"$.{k}", "double").alias(f"_n_{k}"))])

    def truthy(k):
        return _truthy_text(F.col(f"_k_{k}"), F.col(f"_t_{k}"), F.col(f"_n_{k}"))

    def price_ok(k):
        n = F.col(f"_n_{k}")
        return ~F.col(f"_p_{k}") | (n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))

    fields = F.try_variant_get("item", "$", "map<string,variant>")
    others = F.map_filter(fields, lambda k, x: ~k.isin(*EXTERNAL_RESERVED))
    extras, texts = split_indicators(others)
    derived = typed.select(
        *keep, "item_pos",
        F.schema_of_variant("item").startswith("OBJECT").alias("_obj"),
        F.coalesce(truthy("instrumentId"), truthy("symbol"), truthy("id")).alias("instrumentId"),
        truthy("timestamp").alias("_ts_text"),
        *[F.coalesce(F.col(f"_n_{k}"), F.lit(0.0)).alias(k) for k in INDICATORS],
        F.greatest(*[~price_ok(k) for k in INDICATORS]).alias("_bad_price"),
        "item")
    parsed = derived.withColumn("_ts", parse_iso_utc(F.col("_ts_text")))
    reason = (F.when(~F.col("_obj"), "not an object")
              .when(F.col("_ts_text").isNotNull() & F.col("_ts").isNull(), "bad timestamp")
              .when(F.col("_bad_price"), "non-numeric price")
              .when(F.col("instrumentId").isNull(), "missing instrument"))
    out = parsed.select(
        *keep, "item_pos", "instrumentId",
        F.coalesce("_ts", F.lit(batch_ts).cast("timestamp_ntz")).alias("dataTimestamp"),
        *INDICATORS, extras.alias("extras"), texts.alias("texts"), reason.alias("reject_reason"))
    # The good/bad split filters on the computed reason. Passing the record
    # through a one-element inline (a Generate) keeps those filters above
    # the parse instead of letting them be pushed down and re-expanded.
    out = out.select(F.inline(F.array(F.struct(*out.columns))))
    return (out.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            out.filter(F.col("reject_reason").isNotNull()))
