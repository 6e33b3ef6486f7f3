"""Chat formatting: conversations cut into token-budgeted, turn-aligned training windows.

Prefix sums of turn tokens choose where windows end. Every window repeats the system
turn and a limited history before its own turns; repeated turns are marked as such and
masked, so every assistant text is a target in exactly one window.

A turn is written as a header line, its escaped text and an end mark:

    <|turn:assistant|>text<|end|>        a turn of this window
    <|past:assistant|>text<|end|>        a repeated turn

A backslash keeps control strings inside texts and roles apart from those of the
template (and from those of other common templates); taking it out again restores them.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvault.llm.common import map_arrow, materialise, query, shuffle_partitions, table

BUDGET = 1024
HISTORY = 256
SEGMENT_TURNS = 512

# Control strings of common chat templates.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|(turn|past):(.*?)\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """A backslash after the first character of each control string, and doubled ones."""
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A backslash before every character a header could end with."""
    return re.sub(r"[\\<|>]", r"\\\g<0>", role)


def n_tokens(text: str, words=re.compile(r"\w+|[^\w\s]")) -> int:
    """Tokens of a formatted turn: runs of word characters and single marks, by four letters."""
    return sum(-(-len(w) // 4) for w in words.findall(text))


def format_turn(kind: str, role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"<|{kind}:{escape_role(role)}|>", escape(text)
    return f"{head}{body}<|end|>", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, role, text, offset of the text) of each turn of a formatted window."""
    for m in _TURN.finditer(formatted):
        yield m.group(1), unescape(m.group(2)), unescape(m.group(3)), m.start(3)


def windows(turns: list[tuple[str, str]], system: str | None, budget: int, history: int,
            at: int = 0) -> Iterator[tuple[str, list, int]]:
    """(formatted text, loss spans, own turns) of each window of one run of turns from ``at`` on;
    those before are history alone.

    A window takes the most turns whose tokens fit the budget that the repeated turns
    leave, and one at least: turns are never cut, so a longer one stands alone.
    """
    cost = [n_tokens(format_turn("turn", r, t)[0]) for r, t in turns]
    sums = [0, *itertools.accumulate(cost)]
    while at < len(turns):
        past, back = [], at
        while back > 0 and sums[at] - sums[back - 1] <= history:
            back -= 1
        if system is not None and not (at == 0 and turns[0] == ("system", system)):
            past.append(("system", system))
        past += [t for t in turns[back:at] if t != ("system", system)]
        room = budget - sum(n_tokens(format_turn("past", r, t)[0]) for r, t in past)
        end = at + 1
        while end < len(turns) and sums[end + 1] - sums[at] <= room:
            end += 1
        out, spans, size = [], [], 0
        for kind, (role, text) in [*(("past", t) for t in past), *(("turn", t) for t in turns[at:end])]:
            piece, a, b = format_turn(kind, role, text)
            if kind == "turn" and role == "assistant":
                spans.append([size + a, size + b])
            out.append(piece)
            size += len(piece)
        yield "".join(out), spans, end - at
        at = end


_WINDOW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()),
                     ("formatted", pa.string()), ("loss", pa.list_(pa.list_(pa.int64())))])
_WINDOW_DDL = "conv_id long, segment long, window int, formatted string, loss array<array<long>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _formatter(budget: int, history: int, size_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _WINDOW]
        size = 0
        for (conv, segment), rows in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
            rows = list(rows)
            turns = [(r[3] or "", r[4] or "") for r in rows]
            own = sum(r[2] < segment * size_of for r in rows)
            for i, (text, spans, _) in enumerate(windows(turns, rows[0][5], budget, history, own)):
                for c, v in zip(out, (conv, segment, i, text, spans)):
                    c.append(v)
                size += len(text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _WINDOW)], schema=_WINDOW)
                out, size = [[] for _ in _WINDOW], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _WINDOW)], schema=_WINDOW)
    return run


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, segment, window, formatted, loss) of (conv_id, turn, role, text) rows.

    ``loss`` lists [begin, end) code points of the target texts in ``formatted``. A
    conversation is taken in segments of ``SEGMENT_TURNS`` turns, so no task holds a long
    one whole; a segment begins a window, with the last turns of the segment before as its
    history. The system turn is the first one of that role. Null texts and roles count as
    empty; a null turn sorts first; equal turn numbers are ordered by role and text; a null
    conv_id is one conversation of its own. An empty table gives no rows.
    """
    # A formatted turn has some tokens besides its text, so few turns fit the history.
    back = history // n_tokens(format_turn("turn", "", "")[0])
    size_of = max(SEGMENT_TURNS, back)
    order = ["conv_id", "turn", "role", "text"]
    # Ranks without a task that holds a conversation: places in the global order, written
    # once, less the place of the conversation's first row in the partition. Equal rows are
    # apart by where they were read.
    laid = materialise(
        conversations.select(*order).withColumn("nth", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(conversations.sparkSession), *order, "nth")
        .sortWithinPartitions(*order, "nth")
        .select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "chat-turns")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("role") == "system", F.struct("place", "text")))
    parts = (laid.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("from"), first.alias("first"))
             .withColumn("shift", F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("from"))
             .withColumn("first", F.min("first").over(Window.partitionBy("conv_id")))
             .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "shift",
                     F.when(F.col("first").isNotNull(), F.coalesce("first.text", F.lit(""))).alias("system")))
    # A conversation and partition have one row in `parts`, so a long conversation is joined in parts.
    ranked = (laid.join(parts, laid.conv_id.eqNullSafe(parts.c) & (laid.part == parts.p))
              .withColumn("rank", F.col("place") + F.col("shift")))
    own = F.floor(F.col("rank") / size_of)
    inside = F.col("rank") % size_of
    segments = F.when(inside >= size_of - back, F.array(own, own + 1)).otherwise(F.array(own))
    placed = (ranked.select("conv_id", F.explode(segments).alias("segment"), "rank", "role", "text", "system")
              .repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "rank"))
    return map_arrow(placed, _formatter(budget, history, size_of), _WINDOW_DDL)


_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                   ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its windows in order; windows are read one at a time."""
    out: list[list] = [[] for _ in _BACK]
    for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        n = chars = size = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for _, _, _, formatted, spans in rows:
            size += len(formatted)
            for kind, role, text, _ in parse(formatted):
                if kind == "turn":
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
            for a, b in spans:
                target = unescape(formatted[a:b])
                chars += len(target)
                loss.update(target.encode())
        for c, v in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)):
            c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BACK)], schema=_BACK)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted windows and loss spans alone."""
    ordered = (formatted.select("conv_id", "segment", "window", "formatted", "loss").repartition("conv_id")
               .sortWithinPartitions("conv_id", "segment", "window"))
    return map_arrow(ordered, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                       "loss_sha256 string, formatted_chars long")


@query("op4_chat_windows")
def op4_chat_windows(spark, sf_dir):
    """All conversations and conversation -1, formatted, written and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(materialise(format_conversations(given.unionByName(extra)), "chat-windows"))
