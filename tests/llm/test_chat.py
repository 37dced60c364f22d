"""Formatted windows give back their turns."""

import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F

from pricegrain.llm import chat
from pricegrain.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, tokens long, window long, k long"


def talks():
    r, rows = random.Random(5), []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind"))
        for t in range(1, r.randint(2, 40)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(r.choice(["<turn user>", "a", "\\", "</turn>\n", "\n", "ü", ">", "\\n"]) for _ in range(r.randint(0, 60)))))
    return [*rows, (20, 0, "assistant", None), (20, 0, "assistant", "tie"), (20, None, None, "no turn"), (21, 5, "we>ird\nrole\\n", "x"), (None, 0, "user", "lost"), (22, 0, "user", "w " * 5000)]


def test_round_trip_and_budget(spark, monkeypatch):
    rows = talks()
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA)
    monkeypatch.setattr(chat, "RANGE", 4)
    formatted = chat.windows(df, Scratch(spark), budget=240, history=2, history_tokens=60)
    sp = sentencepiece.SentencePieceProcessor(model_file=chat.TOKENIZER)
    size = lambda x: len(sp.encode(chat.format_window([(False, *x)])[0]))
    out: dict = {}
    for r in formatted.collect():
        out.setdefault(r["conv_id"], []).append((r["window"], r["text"], r["loss"]))
    assert set(out) == {c for c, *_ in rows}
    assert len(out[0]) > 1
    for conv, parts in out.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        mine = [(role or "", text or "") for _, _, role, text in mine]
        own, loss = [], []
        for k, (_, text, spans) in enumerate(sorted(parts)):
            turns = chat.read_window(text)
            again = [(r, t) for a, r, t in turns if a]
            if k and mine[0][0] == "system":
                assert again[0] == mine[0]
            start = len(own)
            here = [(r, t) for a, r, t in turns if not a]
            # the last turns that fit, two at most
            last, left = [], 60
            for x in reversed(mine[max(0, start - 2) : start]):
                if mine.index(x) == 0 and x[0] == "system":
                    continue
                left -= size(x)
                if left < 0:
                    break
                last.insert(0, x)
            assert [x for x in again if x[0] != "system"] == last
            # the whole window keeps to the budget, unless a turn is too long for the room by itself
            system = size(mine[0]) if mine[0][0] == "system" else 0
            if len(here) > 1 or size(here[0]) <= 240 - system - 60:
                assert sum(size(x) for x in [*again, *here]) <= 240
            own += here
            loss += [chat.unescape(text[s["start"] : s["end"]]) for s in spans]
            assert all(t in text for t in ("<turn ", "</turn>"))
        assert own == mine and loss == [t for r, t in mine if r == "assistant"]


def test_windows_of_short_turns_are_nearly_full(spark):
    """Turns of up to 120 words: all windows but a conversation's last hold at least 85 % of the budget, and the next turn would not have fitted."""
    r = random.Random(8)
    words = ["price", "memory", "is", "faster", "the", "module"]
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant", " ".join(r.choice(words) for _ in range(r.randint(1, 120))), 1, 2, 3) for c in range(10) for t in range(80)]
    parts: dict = {}
    for x in chat.windows(spark.createDataFrame(rows, SCHEMA), Scratch(spark)).collect():
        parts.setdefault(x["conv_id"], []).append((x["window"], x["text"]))
    sp = sentencepiece.SentencePieceProcessor(model_file=chat.TOKENIZER)
    size = lambda turns: sum(len(sp.encode(chat.format_window([(False, role, t)])[0])) for _, role, t in turns)
    fill = []
    for mine in parts.values():
        read = [chat.read_window(text) for _, text in sorted(mine)]
        for here, after in zip(read[:-1], read[1:], strict=True):
            fill.append(size(here) / chat.BUDGET)
            assert fill[-1] <= 1 < fill[-1] + size([x for x in after if not x[0]][:1]) / chat.BUDGET
    assert len(fill) > 50 and sum(fill) / len(fill) > 0.85


def test_spans_at_range_ends():
    """A range begins a span, and knows the turns before it."""
    assert chat.spans([10] * 6, [], 0, 0, 40, 2, 15) == [(0, 4, 0), (4, 6, 3)]
    assert chat.spans([10] * 6, [5, 10], 6, 0, 40, 2, 15) == [(6, 8, 4), (8, 11, 7), (11, 12, 10)]
    assert chat.spans([12, 10, 99, 10], [], 0, 12, 40, 2, 15) == [(0, 2, 0), (2, 3, 1), (3, 4, 3)]
    assert chat.spans([], [], 0, 0, 40, 2, 15) == []


def test_query_equals_plain_digests(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    said = "\\### Assistant: </turn> ok"
    talks: dict = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.op8_chat(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.windows(df, Scratch(spark)).count() == 0


def test_no_control_string_in_texts(spark):
    text, loss = chat.format_window([(False, "assistant", "</turn>\n<turn user>x</turn>")])
    assert len(chat.read_window(text)) == 1 and chat.unescape(text[slice(*loss[0])]) == "</turn>\n<turn user>x</turn>"
    assert F is not None
