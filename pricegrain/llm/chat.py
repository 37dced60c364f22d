"""Chat formatting in budgeted windows.

A window holds at most BUDGET tokens, all told: the conversation's system turn (its first turn, if a system turn), the last
HISTORY turns before the span, repeated as far as they have HISTORY_TOKENS together, and the span's own turns, each with its
template. What the system turn and this history leave is the window's room. Prefix sums of turn tokens choose the spans: a span
ends with the last turn whose sum still lies within the room, and the next one begins there, so windows of short turns are
nearly full. Only a system turn or a single turn that is too long itself can make a window larger. Loss falls on the texts of
assistant turns of the span alone; repeated turns carry none, so each target counts once.

Template: `<turn ROLE>` TEXT `</turn>` newline, `<again ROLE>` for repeated turns. In roles and texts `\\`, `<`, `>` and newlines in
roles are written with a backslash before (`\\n` for the newline), so no text can hold a control string, and reading back
is exact.

No conversation is gathered in one task to format it: turns take their places by ranges of the whole table, spans are chosen
from the token counts of RANGE consecutive turns (a range begins a span; it knows the turns just before it), and each window
meets its own turns alone. Only the digests of op8 hold a conversation in one row.

Defined cases: null texts and roles are empty; turns follow turn (nulls first), role and text; a null conv_id is a
conversation of its own; repeated rows are turns of their own; a single turn longer than the room stays whole; an empty
table gives an empty result; columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import blocks
from .common import Scratch, read

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BUDGET, HISTORY, HISTORY_TOKENS, RANGE = 1024, 2, 192, 4096
#: Turns of equal number and role are dealt to tasks by so many characters of their texts.
HEAD = 64
_TURN = re.compile(r"<(turn|again) ((?:[^\\>]|\\.)*)>((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)


def format_window(turns: list[tuple[bool, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of (repeated, role, text) turns and the spans, in code points, under the loss mask."""
    out, at, loss = [], 0, []
    for again, role, text in turns:
        head, body = f"<{'again' if again else 'turn'} {escape_role(role)}>", escape(text)
        out += [head, body, "</turn>\n"]
        if role == "assistant" and not again:
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), loss


def read_window(text: str) -> list[tuple[bool, str, str]]:
    """The turns of a formatted window."""
    return [(m[1] == "again", unescape(m[2], role=True), unescape(m[3])) for m in _TURN.finditer(text)]


def count_tokens(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """turns with tokens, the number of tokens of each formatted turn."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        for batch in batches:
            whole = [format_window([(False, r, t)])[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            n = [len(x) for x in sp.encode(whole, num_threads=1)] if whole else []
            yield batch.append_column("tokens", pa.array(n, pa.int64()))

    return turns.mapInArrow(run, StructType([*turns.schema.fields, StructField("tokens", LongType())]))


def spans(tokens: list[int], before: list[int], at: int, system: int, budget: int, history: int, history_tokens: int) -> list[tuple[int, int, int]]:
    """(start, end, low) of the spans of consecutive turns: turns start to end - 1 are a window's own, those from low on are repeated before them.

    tokens: of turns at, at + 1, ..., the first turn of a conversation being 0; before: of the turns just before; system: tokens of turn 0 if it is a system turn.
    """
    known, first = [*before, *tokens], at - len(before)
    sums = np.cumsum([0, *tokens])
    out, i = [], 0
    while i < len(tokens):
        low, left = at + i, history_tokens
        while low > max(first, at + i - history, 1 if system else 0) and known[low - 1 - first] <= left:
            low -= 1
            left -= known[low - first]
        room = max(budget - (system if at + i else 0) - (history_tokens - left), budget // 4)
        end = max(i + 1, int(np.searchsorted(sums, sums[i] + room, side="right")) - 1)
        out.append((at + i, at + end, low))
        i = end
    return out


def windows(turns: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """ckey, conv_id, window (the place of its first own turn), text, loss (array of start, end): every window of every conversation."""
    named = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("ckey"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = count_tokens(named, tokenizer).withColumn("head", F.left("text", F.lit(HEAD)))
    size = max(RANGE, history)
    placed = blocks.placed(counted, ["ckey"], ["turn", "role", "head"], ["text"]).withColumn("k", F.col("place") - 1).withColumn("range", F.floor(F.col("k") / size))
    sums = placed.groupBy("ckey", "range").agg(F.sort_array(F.collect_list(F.struct("k", "tokens")))["tokens"].alias("tokens"), F.max(F.when((F.col("k") == 0) & (F.col("role") == "system"), F.col("tokens"))).alias("system"))
    sums = scratch.table(sums.withColumn("tail", F.slice("tokens", F.greatest(F.size("tokens") - history + 1, F.lit(1)), history)))
    by_range = W.partitionBy("ckey").orderBy("range")
    known = sums.select("ckey", "range", F.coalesce(F.lag("tail").over(by_range), F.array().cast("array<long>")).alias("before"), F.coalesce(F.first("system").over(by_range.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("system"))

    def choose(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                for start, end, low in spans(row["tokens"], row["before"], row["range"] * size, row["system"], budget, history, history_tokens):
                    again = [0] if row["system"] and start else []
                    out += [(row["ckey"], start, k, False) for k in range(start, end)] + [(row["ckey"], start, k, True) for k in [*again, *range(low, start)]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            names = ["ckey", "window", "k", "again"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)

    chosen = sums.select("ckey", "range", "tokens").join(known, ["ckey", "range"]).mapInArrow(choose, "ckey string, window long, k long, again boolean")
    every = chosen.join(placed.select("ckey", "conv_id", "k", "role", "text"), ["ckey", "k"])
    grouped = every.groupBy("ckey", "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("k", "again", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            texts, losses = [], []
            for turns in batch.column("turns").to_pylist():
                text, loss = format_window([(t["again"], t["role"], t["text"]) for t in turns])
                texts.append(text), losses.append([{"start": a, "end": b} for a, b in loss])
            yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("conv_id"), batch.column("window"), pa.array(texts, pa.string()), pa.array(losses, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["ckey", "conv_id", "window", "text", "loss"])

    return grouped.select("ckey", "conv_id", "window", "turns").mapInArrow(run, "ckey string, conv_id long, window long, text string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """ckey, conv_id, window, n_turns, turns (role, newline, text, newline of each turn that is not repeated), loss_text, chars: from the formatted text and its mask alone."""

    def run(batches):
        for batch in batches:
            n, turns, loss, chars = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                own = [(r, t) for again, r, t in read_window(text) if not again]
                n.append(len(own)), turns.append("".join(f"{r}\n{t}\n" for r, t in own))
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans)), chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("conv_id"), batch.column("window"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["ckey", "conv_id", "window", "n_turns", "turns", "loss_text", "chars"])

    return formatted.mapInArrow(run, "ckey string, conv_id long, window long, n_turns long, turns string, loss_text string, chars long")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").union(extra)
    parts = read_back(windows(turns, Scratch(spark)))
    whole = parts.groupBy("ckey").agg(F.first("conv_id").alias("conv_id"), F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("x"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("x.loss_text", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("x.turns", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
