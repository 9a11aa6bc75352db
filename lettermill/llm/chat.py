"""Chat formatting in budgeted, turn-aligned windows.

A turn is written as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and
a line end.  Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can hold a control string, and reading undoes it exactly.
Roles also write a line end as ``\\n``.

The tokens of a turn are those of the turn as written, marks and escapes included,
summed along each conversation.  A turn belongs to the window ``floor(tokens before
it / stride)``.  A conversation's stride is half of what the budget leaves beside
its system turn and the history, 1 (one turn a window) if nothing is left: a window
keeps its budget unless its last turn is longer than a stride or the system turn
takes it, and ``over_budget`` says so; turns are never cut.
A window repeats the conversation's system turn (its first turn, if that is a
system turn) and those turns of the window before that start at most ``history``
tokens before its first one.  Repeated turns are masked: only the texts of assistant
turns at their first place are in ``loss``, so each is learned once.

Prefix sums are taken in two levels, inside blocks of turns and over the blocks of
a conversation, so a long conversation is spread over many tasks.

Defined cases: null texts and roles are empty; null turns come first; turns that
tie are ordered by role, then text; conversation ids are cast to long, and null ones
form one conversation;
repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import bounded, small_batches, stage

BUDGET, HISTORY = 1024, 256
START, END = "<|im_start|>", "<|im_end|>"
TURNS_PER_BLOCK = 256
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text starts and ends in it."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn; raises on anything else."""
    out, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        start, stop = line + 1, text.find("<|", line + 1)
        if not text.startswith(START, at) or line < 0 or stop < 0 or not text.startswith(f"{END}\n", stop):
            raise ValueError(f"no turn at {at}: {text[at : at + 40]!r}")
        out.append((unescape(text[at + len(START) : line]), unescape(text[start:stop]), start, stop))
        at = stop + len(END) + 1
    return out


def written(role: Column, text: Column) -> Column:
    """What ``format_turn`` writes, as a column."""
    safe = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(START), F.replace(safe(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), safe(text), F.lit(f"{END}\n"))


def with_tokens(conversations: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text, tokens: how many tokens the turn has as it is written."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = bpe.encode(rows.withColumn("counted", written(F.col("role"), F.col("text"))), vocabulary_path, pattern, text_col="counted")
    return counted.select("conv_id", "turn", "role", "text", F.size("ids").cast("long").alias("tokens"))


def placed(turns: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """``turns`` with block, place (in the block), before (tokens of all turns before it), is_first, and system_tokens of the conversation's system turn."""
    keyed = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(-(2**53))))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    local = keyed.withColumn("place", F.row_number().over(inside)).withColumn("inner", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    along = Window.partitionBy("conv_id").orderBy("block")
    blocks = local.groupBy("conv_id", "block").agg(F.sum("tokens").alias("block_tokens"), F.max(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("tokens")).otherwise(0)).alias("system"))
    blocks = blocks.withColumn("outer", F.sum("block_tokens").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).withColumn("block_no", F.row_number().over(along))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "outer", "block_no", F.first("system").over(along).alias("system_tokens"))
    both = local.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return both.select(*turns.columns, "block", "place", (F.col("outer") + F.col("inner")).alias("before"), ((F.col("block_no") == 1) & (F.col("place") == 1)).alias("is_first"), "system_tokens")


_PIECES = "struct<part:int,block:long,place:int,role:string,text:string,tokens:long>"
_WINDOWS = "conv_id long, window long, repeated int, tokens long, over_budget boolean, text string, loss array<struct<start:int,stop:int>>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("repeated", pa.int32()), ("tokens", pa.int64()), ("over_budget", pa.bool_()),
    ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
])


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, repeated (how many turns are repeats), tokens, over_budget, text, loss.

    ``turns`` has conv_id, turn, role, text, tokens.
    """
    small_batches(turns.sparkSession)
    all_turns = stage(placed(turns), "chat-turns")
    system = all_turns.where("is_first and role = 'system'").select(F.col("conv_id").alias("s_id"), F.struct("role", "text", "tokens").alias("system"))
    stride = F.greatest(F.floor((budget - history - F.col("system_tokens")) / 2), F.lit(1))
    mine = all_turns.withColumn("window", F.floor(F.col("before") / stride))
    piece = lambda part: F.struct(F.lit(part).alias("part"), "block", "place", "role", "text", "tokens")
    new = mine.select("conv_id", "window", piece(2).alias("piece"))

    firsts = stage(mine.groupBy("conv_id", "window").agg(F.min("before").alias("first")), "chat-windows")
    along = Window.partitionBy("conv_id").orderBy("window")
    later = firsts.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), F.lead("window").over(along).alias("next"), F.lead("first").over(along).alias("next_first")).where("next is not null")
    repeats = mine.where("not (is_first and role = 'system')").join(later, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
    repeats = repeats.where(F.col("before") + history >= F.col("next_first")).select("conv_id", F.col("next").alias("window"), piece(1).alias("piece"))
    again = firsts.where("first > 0").join(system, F.col("conv_id").eqNullSafe(F.col("s_id")))
    again = again.select("conv_id", "window", F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("place"), "system.role", "system.text", "system.tokens").alias("piece"))
    grouped = new.unionByName(repeats).unionByName(again).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("piece")).cast(f"array<{_PIECES}>").alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, loss, length = [], [], 0
                for p in row["pieces"]:
                    turn, start, stop = format_turn(p["role"], p["text"])
                    if p["part"] == 2 and p["role"] == "assistant":
                        loss.append({"start": length + start, "stop": length + stop})
                    text.append(turn)
                    length += len(turn)
                tokens = sum(p["tokens"] for p in row["pieces"])
                rows.append({"conv_id": row["conv_id"], "window": row["window"], "repeated": sum(p["part"] < 2 for p in row["pieces"]), "tokens": tokens, "over_budget": tokens > budget, "text": "".join(text), "loss": loss})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return grouped.mapInArrow(bounded(run), _WINDOWS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_over_budget long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the windows hold, by parsing them in order.

    A digest of a conversation needs its turns in order; they stream through one
    task in sorted order with the state of two hashes, so memory stays bounded.
    """
    small_batches(formatted.sparkSession)

    def run(batches):
        state, done = None, []

        def close():
            done.append((state["id"], state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"], state["windows"], state["over"]))

        def flush():
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "n_over_budget")
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state["id"] != row["conv_id"]:
                    if state is not None:
                        close()
                    state = {"id": row["conv_id"], "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "windows": 0, "over": 0}
                state["windows"] += 1
                state["over"] += row["over_budget"]
                state["chars"] += len(row["text"])
                for k, (role, text, _, _) in enumerate(parse_turns(row["text"])):
                    if k >= row["repeated"]:
                        state["turns"] += 1
                        state["sha"].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["stop"]])
                    state["loss"] += len(text)
                    state["loss_sha"].update(text.encode())
            yield flush()
        if state is not None:
            close()
            yield flush()

    ordered = formatted.select("conv_id", "window", "repeated", "over_budget", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(bounded(run), _READ)
