"""Personal data: plain spans against the patterns themselves, disguised ones one by one, mapping against a plain walk."""

import hashlib
import random
import re

import pytest

from pricegrain.llm import pii

SCHEMA = "doc_id long, text string, spans string, kind int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    pieces = ["4111 1111-1111 1111", "4111111111111111", "+1 (017) 555-7713", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "0010.1.1.1", "a@b.co", "x@y", "@", ".", "-", " ", "+", "1", "a", "é", "😀", "\n", "%", "()", "42"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.spans_of(text) == plain(text), text
        base, added = pii.all_spans(text)
        assert base == plain(text)


@pytest.mark.parametrize(
    "kind, text",
    [
        ("email", "<john.doe [at] example [dot] com> ok"), ("email", "<ann at mail dot example dot org>"), ("email", "<jane(at)site.co.uk>!"), ("email", "<bob_at_mail_dot_com>"), ("email", "<john&#64;ex&#46;com>"),
        ("email", "(<JOHN AT EXAMPLE DOT COM>)"), ("email", "an <jоhn@exаmple.com> now"), ("email", "<te​st@ex\xadample.com>."), ("email", "😀 <ａnn＠ｍail．com>"), ("email", "<jo\n{at}\nmail.example.org>"),
        ("phone", "call <plus four four two zero seven nine four six zero nine five eight>."), ("phone", "<plus one oh double five 5 triple six 1 2 3 4>"), ("phone", "<+44 20 seven 946 0958>"), ("phone", "<＋49 ３０ 1234567>"),
        ("ip", "ip <one nine two dot one six eight dot zero dot one>!"), ("ip", "<192[.]168[.]0[.]1>"), ("ip", "<1O.0.0.l2>"), ("ip", "<10 dot 0 dot 0 dot 1>"),
        ("card", "<four one one one one one one one one one one one one one one one>."), ("card", "<4lll-1111-1111-1111>"), ("card", "<４１１１ 1111 1111 1111> x"), ("card", "<vier eins eins eins 1111 1111 1111>"),
    ],
)
def test_disguises_are_found_where_they_stand(kind, text):
    start, end = text.index("<"), text.index(">") - 1
    text = text.replace("<", "").replace(">", "")
    assert pii.all_spans(text) == ([], [(kind, start, end)])


@pytest.mark.parametrize("text", ["look at example.org please", "at home dot dot dash", "some one at the dot", "+ one of six", "1 un an", "room 1O", "two or three at ten", "x at y.com", "e.g. at a dot"])
def test_prose_stays_clean(text):
    assert pii.all_spans(text) == ([], [])


def test_base_spans_stay_beside_added_ones():
    """A disguise that reaches further than a base span is added; one that the base span holds isn't."""
    assert pii.all_spans("jоhn@mail.org") == ([("email", 2, 13)], [("email", 0, 13)])
    assert pii.all_spans("a@b.co or four four") == ([("email", 0, 6)], [])
    assert pii.all_spans("+1 (848) 555-1373 Un an") == ([("phone", 0, 17)], [])


def test_mapping_back_covers_what_was_replaced():
    rng = random.Random(8)
    for _ in range(300):
        source = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 40)))
        cuts, at = [], 0
        while at < len(source):
            a = at + rng.randrange(4)
            b = a + rng.randrange(1, 4)
            if b <= len(source):
                cuts.append((a, b, "xyz"[: rng.randrange(4)]))
            at = b
        out = pii.Rewritten(source, cuts)
        walked, made = [], ""
        at = 0
        for a, b, new in [*cuts, (len(source), len(source), "")]:
            walked += [(i, i + 1) for i in range(at, a)] + [(a, b)] * len(new)
            made += source[at:a] + new
            at = b
        assert out.text == made
        for i in range(len(made)):
            for j in range(i + 1, len(made) + 1):
                assert out.back(i, j) == (walked[i][0], walked[j - 1][1])


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, " " * 400_000, "1." * 200_000, "a@" * 200_000, "one " * 100_000, "(at) " * 100_000, "O0" * 200_000, "-at-" * 100_000, " at a" * 80_000, "+1 " * 100_000])
def test_long_runs_take_linear_time(text):
    pii.all_spans(text)


def test_query(spark, tmp_path):
    rows = [(1, "a@b.co, x (at) y.org"), (1, "a@b.co"), (None, "+1 (017) 555-7713"), (2, None), (3, ""), (4, "word " * 50_000 + "10.0.0.1"), (5, "é 4111 1111 1111 1111")]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame([(i, t, "clash", 1) for i, t in part], SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = sorted(map(tuple, pii.op12_pii(spark, str(tmp_path / "some")).collect()), key=str)
    want = []
    for i, t in rows:
        base = plain(t or "")
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        added = [("email", 8, 20)] if t and "(at)" in t else []
        both = sorted(base + added, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        want.append((i, *[sum(x[0] == k for x in base) for k in pii.KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(added)))
    assert got == sorted(want, key=str)
    assert pii.op12_pii(spark, str(tmp_path / "none")).count() == 0


def test_redacted(spark):
    d = spark.createDataFrame([(1, "to jоhn@mail.org or 10.0.0.1!"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redacted(d).collect()} == {1: "to [email] or [ip]!", 2: None, 3: "clean"}
