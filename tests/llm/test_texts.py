"""Operators on documents against plain versions, and their defined cases."""

import functools
import hashlib
import math
import random
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrain.llm import decontamination, labelled, line_dedup, lm_score, mixing, near_dedup, quality, substring_dedup, toxicity
from pricegrain.llm.common import Scratch, Words, components, inside, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key double, n int"
rng = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)] + ["È", "ü!", "x"]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@functools.cache
def corpus():
    """Copies, near copies, shared passages, ties, nulls, empty and very long texts."""
    base, passage = prose(120), prose(30)
    texts = [base, base, base.replace("w1 ", "w2 ", 3), prose(50) + "\n" + passage + "\n" + prose(10), passage, passage + " " + passage, None, "", " \t\n ", "one", "One", "a b c d", "a b c d e f", prose(3000), "w1 " * 500, passage + "\n" + passage + "\n\n" + passage.replace("w3", "w4", 1), base.upper(), "x\x0by\x0cz\rq w e r t", "\U0001f600 " * 30]
    texts += [base.replace(f"w{i} ", f"w{i + 1} ") for i in range(12)] + [prose(rng.randint(1, 80)) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """Extra columns bear names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 5, 0.5, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------------------------------------ words


def test_words_equal_pattern():
    texts = [t or "" for _, t in corpus()]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    w = Words(data, np.cumsum([0, *map(len, raw)]), lower=True)
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    flat = [lower(x) for t in texts for x in words(t)]
    seen = {}
    for h, x in zip(w.h.tolist(), flat, strict=True):
        assert seen.setdefault(h, x) == x
    assert len(set(flat)) == len(seen)
    assert inside(np.array([0, 2, 5]), 2, 5).tolist() == [True, False, True, True]
    assert len(windows(w.h[:3], 5)) == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60, 1) if i % 20 != 19] + [(5, 99), (99, 25), (7, 7)]
    got = {r["id"]: r["component"] for r in components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[19] == got[39] == got[99] == 0 and got[59] == 40


# ------------------------------------------------------------------------------------------------ near copies


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    c = {i: i for i in sets}

    def root(i):
        while c[i] != i:
            i = c[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                c[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("few", [0, 300_000])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, Scratch(spark)).collect()}
    assert got == brute_components(corpus())


def test_large_group_of_variants(spark):
    """Members whose similarity to the first lies on both sides of the threshold, so components meet late."""
    r, base = random.Random(3), [f"v{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(spark, rows), Scratch(spark)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_keep_one_judges_texts_of_one_id_apart(spark):
    """Of rows with one id only the text that copies an earlier one goes; repeated rows and rows without an id stay."""
    a, b, c = (prose(40) for _ in range(3))
    rows = [(1, a, 1), (5, a + " end", 2), (5, b, 3), (5, b, 4), (6, c, 5), (None, a, 6), (None, None, 7), (7, b + " end", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, number int")
    out = near_dedup.keep_one(d, Scratch(spark))
    assert out.columns == d.columns and sorted(r["number"] for r in out.collect()) == [1, 3, 4, 5, 6, 7]


def test_keep_one(spark, docs):
    kept = {r["doc_id"] for r in near_dedup.keep_one(docs, Scratch(spark)).collect()}
    assert kept == {i for i, (_, c) in brute_components(corpus()).items() if i == c}


# ------------------------------------------------------------------------------------------------ repeated passages


def brute_repeats(rows, n=20):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in first:
                gone.update(range(k, k + n))
            else:
                first[key] = True
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, docs):
    got = substring_dedup.remove_repeats(docs, Scratch(spark)).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in got} == brute_repeats(corpus())


def test_repeated_rows_are_one_document(spark, docs):
    assert substring_dedup.remove_repeats(docs.union(docs.where("doc_id < 5")), Scratch(spark)).count() == docs.count()


# ------------------------------------------------------------------------------------------------ lines


def brute_lines(rows):
    seen, gone = [], {}
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            s = set(words(line))
            if s:
                if any(len(s & o) * 100 >= (len(s) + len(o) - len(s & o)) * line_dedup.PER_CENT for o in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(s)
    return gone


@pytest.mark.parametrize(("few", "hot"), [(0, 2), (0, 10_000), (1_000_000, 3)])
def test_lines_equal_brute_force(spark, docs, monkeypatch, few, hot):
    """Words in common lines are joined by way of their hubs or not: the same lines go."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SLOTS", 64)
    got = {r["d"]: r["gone"] for r in line_dedup.removed_lines(docs, Scratch(spark)).collect()}
    assert got == brute_lines(corpus())
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, Scratch(spark)).collect()}
    gone = brute_lines(corpus())
    assert out == {i: t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in corpus()}


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_groups_of_varied_lines(spark, monkeypatch, hot):
    """Variants of three lines, many to a document, some of them no line's near copy; short lines and repeated ones."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SLOTS", 256)
    r = random.Random(21)
    bases = [[f"b{k}x{i}" for i in range(24)] for k in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(6):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"n{r.randrange(400)}"
            lines.append(" ".join(w[: r.choice([24, 24, 22, 12])]))
        lines += [r.choice(["", "a", "b", "a a", "a b", "}", "x y z u v w", "x y z u v w t"])]
        rows.append((i, "\n".join(lines)))
    got = {x["d"]: x["gone"] for x in line_dedup.removed_lines(frame(spark, rows), Scratch(spark)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_repeated_and_missing_ids_and_clashing_columns(spark):
    """Rows of one id with one text lose the same lines, with other texts each its own; rows without an id keep all; any column stays."""
    rows = [(1, "a b c\nd e f", 7, 8, "z", 3), (1, "a b c\nd e f", 7, 8, "z", 3), (2, "d e f\nx", 1, 2, "y", 3), (2, "q\nd e f", 1, 2, "y", 3), (None, "a b c\na b c", 0, 0, None, 3), (3, None, 0, 0, None, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _id int, line string, d int")
    got = line_dedup.dedup_lines(d, Scratch(spark))
    assert got.columns == d.columns
    want = [(1, "a b c\nd e f", 7, 8, "z", 3), (1, "a b c\nd e f", 7, 8, "z", 3), (2, "x", 1, 2, "y", 3), (2, "q", 1, 2, "y", 3), (None, "a b c\na b c", 0, 0, None, 3), (3, None, 0, 0, None, 3)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))


def test_line_plan_has_no_python(spark, docs):
    plan = line_dedup.dedup_lines(docs, Scratch(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------------------------------------ scoring


def test_lattice_sums_all_segmentations():
    pieces = [*[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "ab", "▁a", "▁ab"]
    p = np.random.default_rng(1).random(len(pieces))
    log_p = np.log(p / p.sum())
    lattice = lm_score.Lattice(pieces, np.arange(256), log_p)
    at = {s: i for i, s in enumerate(pieces)}

    def ways(rest):
        if not rest:
            return [[]]
        out = [[at[s], *tail] for s in pieces[256:] if rest.startswith(s) for tail in ways(rest[len(s) :])]
        if rest[0] != "▁":
            out += [[*rest[0].encode(), *tail] for tail in ways(rest[1:])]
        return out

    list_ = ["ab", "a", "abba", "é", "bé"]
    got, uses = lattice.marginals([w.encode() for w in list_]), lattice.expected([w.encode() for w in list_], np.arange(1.0, 6.0))
    want = np.zeros(len(pieces))
    for k, w in enumerate(list_):
        paths = ways("▁" + w)
        weight = [math.exp(sum(log_p[i] for i in x)) for x in paths]
        assert math.isclose(got[k], math.log(sum(weight)), rel_tol=1e-12)
        for x, v in zip(paths, weight, strict=True):
            for i in x:
                want[i] += (k + 1) * v / sum(weight)
    assert np.allclose(uses, want)


def test_long_words_walk_in_parts(monkeypatch):
    """Parts of a few characters and blocks of a few words give what one walk of each whole word gives, forward and expected uses."""
    pieces, weight, byte_at = lm_score.load_pieces()
    lattice = lm_score.Lattice(pieces, byte_at, np.log(weight / weight.sum()))
    r = random.Random(9)
    words = ["".join(r.choice(["the", "ing", "ü", "\u2581", "\U0001f600", "zq", "a", "0"]) for _ in range(n)).encode() for n in (1, 2, 3, 7, 7, 40, 200, 200, 900)]
    counts = np.arange(1.0, len(words) + 1)
    want, uses = lattice.marginals(words), lattice.expected(words, counts)
    for long, cells in ((1, 1), (5, 100), (64, 1 << 20)):
        monkeypatch.setattr(lm_score, "LONG", long)
        monkeypatch.setattr(lm_score, "CELLS", cells)
        assert np.allclose(lattice.marginals(words), want, rtol=1e-12)
        assert np.allclose(lattice.expected(words, counts), uses, rtol=1e-9)


def test_a_word_of_a_million_characters_takes_bounded_memory():
    pieces, weight, byte_at = lm_score.load_pieces()
    lattice = lm_score.Lattice(pieces, byte_at, np.log(weight / weight.sum()))
    one, two = lattice.marginals([b"abcde" * 20_000, b"abcde" * 40_000])
    tracemalloc.start()
    (much,) = lattice.marginals([b"abcde" * 200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the codes themselves take some 50 bytes a character; all forward values and edges at once would take ten times that
    assert peak < 100e6 and math.isclose(much - two, 8 * (two - one), rel_tol=1e-6)


@pytest.mark.parametrize("head", [0, 5, 10_000])
def test_base_score_equals_brute_force(spark, docs, head):
    got = {r["doc_id"]: r for r in lm_score.score(docs, Scratch(spark), passes=1, head=head).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus()}
    count = Counter()
    for i, t in corpus():
        if not held[i]:
            count.update([*words(lower(t)), "\n"])
    n, v = sum(count.values()), len(count)
    for i, t in corpus():
        tokens = [*words(lower(t)), "\n"]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert got[i]["score"] < 0


# ------------------------------------------------------------------------------------------------ mixing


def test_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 4)
    out = mixing.mix(docs, Scratch(spark))
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == len(corpus()) and rows == [r.asDict() for r in mixing.mix(docs.repartition(3), Scratch(spark)).orderBy("doc_id").collect()] or sorted(map(str, rows)) == sorted(map(str, [r.asDict() for r in mixing.mix(docs.repartition(3), Scratch(spark)).collect()]))
    size = {i: len(words(t)) for i, t in corpus()}
    by = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["doc_id"] % 3 if r["doc_id"] % 7 else "n", []).append(r)
    targets, sums = {}, {}
    for k, rs in by.items():
        sums[k] = sum(r["size"] for r in rs)
        targets[k] = rs[0]["target"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    total, weight, capped = 1.5 * sum(sums.values()), {0: 3.0, 1: 1.0, 2: 2.0, "n": 3.0}, set()
    while True:
        rest = total - sum(2 * sums[k] for k in capped)
        free = sum(weight[k] for k in sums if k not in capped)
        over = {k for k in sums if k not in capped and rest * weight[k] / free > 2 * sums[k]}
        if not over:
            break
        capped |= over
    for k in sums:
        assert math.isclose(targets[k], 2 * sums[k] if k in capped else rest * weight[k] / free)


# ------------------------------------------------------------------------------------------------ benchmark


def test_myers_equals_table():
    for _ in range(200):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 80)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            row = [(new := [i + 1])] and [new := i + 1] + [new := min(row[j] + (x != y), row[j + 1] + 1, new + 1) for j, y in enumerate(b)]
        assert decontamination.best_distance(a, b) == min(row)


def substring_distance(item, text):
    """Smallest edit distance of item to a substring of text, by a table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        before, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1))
    return min(row)


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text))
        text = text[:at] + r.choice(["", "#", "#" + text[at]]) + text[at + 1 :]
    return text


@pytest.mark.parametrize("limit", [150, 4_000_000])
def test_matches_equal_all_pairs(spark, monkeypatch, limit):
    """Replaced, inserted and deleted characters, at the budget and beyond; short items; ids that are null or repeat; against a table for each pair."""
    monkeypatch.setattr(decontamination, "blocks", lambda items, of=decontamination.blocks: of(items, limit))
    r = random.Random(31)
    said = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    items = [(0, said(12)), (1, said(20)), (2, "What  is\tthe answer to it"), (3, said(12)), (4, "Zq"), (5, ""), (6, None)]
    items.append((7, items[0][1]))
    rows = []
    for i in range(48):
        w = said(r.randrange(4, 30))
        k, text = r.choice(items[:4])
        part = edited(r, decontamination.normal(text), r.choice([0, 1, 2, 3, 4]))
        rows.append((r.choice([i, i, None, 7]), f"{w} {part} {w}" if i % 4 else w + r.choice([" zq", " zqx", " what is the answer to items", ""])))
    rows += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1].upper())]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        for k, x in items:
            x, text = decontamination.normal(x), decontamination.normal(t)
            if x and text:
                n = 0 if len(x) < 40 and f" {x} " in f" {text} " else substring_distance(x, text)
                if n <= len(x) * 5 // 100 and (len(x) >= 40 or f" {x} " in f" {text} "):
                    want.append((i, k, n))
    got = [(x["doc_id"], x["item_id"], x["distance"]) for x in decontamination.matches(d, bench, Scratch(spark)).collect()]
    assert set(map(str, got)) ^ set(map(str, want)) == set() and sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 20
    hit = {t for i, t in rows if any(n <= len(x) * 5 // 100 and (len(x) >= 40 or f" {x} " in f" {decontamination.normal(t)} ") for x in {decontamination.normal(x) for _, x in items if x} if t for n in [substring_distance(x, decontamination.normal(t))])}
    kept = decontamination.decontaminate(d, bench, Scratch(spark)).collect()
    assert sorted(map(str, kept)) == sorted(str(x) for x in d.collect() if x["text"] not in hit)


def test_decontamination_keeps_columns(spark):
    d = spark.createDataFrame([(1, "x y", 5, "a"), (None, "it is the answer yes", 6, "b")], "doc_id long, text string, h1 int, doc string")
    out = decontamination.decontaminate(d, spark.createDataFrame([(1, "The Answer")], "item_id long, text string"), Scratch(spark))
    assert out.columns == d.columns and [tuple(x) for x in out.collect()] == [(1, "x y", 5, "a")]


# ------------------------------------------------------------------------------------------------ classifiers


def test_toxicity_learns(spark):
    bad = ["vile", "nasty", "horrid", "odious"]
    make = lambda i: (i, " ".join(prose(60).split() + ([rng.choice(bad) for _ in range(6)] if i % 2 else [])))
    rows = [make(i) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    d = frame(spark, [*rows, (1000, None), (1001, "")])
    model = toxicity.fit(d, labels, mod=5, held=0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    right = sum((got[i] >= 0.5) == bool(i % 2) for i in range(300, 400))
    assert right >= 97 and 0 <= got[1000] == got[1001] < 0.5
    assert {r["doc_id"] for r in toxicity.reject(d, model).collect()} == {i for i, s in got.items() if s < 0.5}


def test_classifiers_with_few_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(docs, quality.fit(docs, one)).count() == docs.count()


def test_quality_learns(spark):
    junk = lambda: " ".join([rng.choice(VOCABULARY).upper() + "!!"] * 30)
    rows = [(i, prose(60) if i % 2 else junk()) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    d = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, labels, mod=3, held=1)).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200, 300))


def test_trees_equal_plain_walk():
    r = np.random.default_rng(2)
    x = r.random((400, 5))
    trees = quality.Trees(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    got = trees.predict(x[:20])
    for k in range(20):
        f = trees.start
        for split, cut, leaf in zip(trees.split, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(split):
                node = 2 * node + (2 if x[k, split[node]] > cut[node] else 1)
            f += leaf[node - len(split)]
        assert math.isclose(got[k], 1 / (1 + math.exp(-f)))


def test_sample_is_bounded_and_leaves_out(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["y"]) for r in labelled.sampled(docs, labels, "toxic", 10, 5, 0).collect()]
    assert all(zlib.crc32(str(d).encode()) % 5 for d, _ in rows) and len(set(rows)) == len(rows) < 32
    assert sum(labelled.counts(labels, "toxic", 5, 0).values()) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(40))


# ------------------------------------------------------------------------------------------------ empty tables


def test_empty_tables(spark):
    d = frame(spark, [])
    none = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (near_dedup.near_duplicates(d, Scratch(spark)), substring_dedup.remove_repeats(d, Scratch(spark)), line_dedup.dedup_lines(d, Scratch(spark)), mixing.mix(d, Scratch(spark)), decontamination.decontaminate(d, none, Scratch(spark)), toxicity.score(d, toxicity.fit(d, labels)), quality.score(d, quality.fit(d, labels)), lm_score.score(d, Scratch(spark), passes=1)):
        assert out.count() == 0


def test_quality_share_does_not_depend_on_the_sample_bound(spark):
    """Label 1 is nine times as frequent and thinned to about the number of label 0; the texts tell nothing."""
    r = random.Random(12)
    d = frame(spark, [(i, " ".join(r.choice(VOCABULARY) for _ in range(40))) for i in range(500)])
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    trees = quality.fit(d, labels, most=50)
    assert math.isclose(trees.start, math.log(9), rel_tol=1e-9)
    scores = [x["score"] for x in quality.score(d, trees).collect()]
    assert sum(scores) / len(scores) > 0.75


def test_dictionaries_are_trained_on_whole_texts(monkeypatch):
    """All words of all texts of a label are in the samples, those of the base and of the ordinary part in halves."""
    import zstandard

    seen = []
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **how: seen.append((size, sum(len(x.split()) for x in samples))) or zstandard.ZstdCompressionDict(b"x" * size))
    toxicity.dictionaries([(0, b"good word " * 350_000, 0), (9, b"fine " * 5, 0), *[(i, b"vile good", 1) for i in range(1, 9)]])
    assert sorted(seen) == sorted([(toxicity.BASE_BYTES, 700_000), (toxicity.OWN_BYTES, 16), (toxicity.OWN_BYTES, 5)])


def test_toxic_dictionary_holds_what_tells():
    """Rare telling words among much ordinary text are found, and a window without them costs the same under both dictionaries."""
    r = random.Random(23)
    stems = ["ander", "onti", "ther", "inge", "lyed", "reha", "stoul", "whea"]
    word = lambda: "".join(r.choice(stems) for _ in range(r.randrange(1, 4)))
    bad = ["scummy", "trashing", "pitiable", "moronish"]  # three of 200 words tell

    def text(y):
        words = [word() for _ in range(200)]
        for _ in range(3 * y):
            words.insert(r.randrange(len(words)), r.choice(bad))
        return " ".join(words).encode()

    rows = [(i, text(int(i % 4 == 0)), int(i % 4 == 0)) for i in range(800)]
    model = toxicity.Model(rows)
    c = toxicity.Compressors(model.toxic, model.ordinary)
    assert model.toxic.endswith(model.ordinary) and len(model.toxic) > len(model.ordinary)
    new = [(text(y), y) for y in (0, 1) for _ in range(100)]
    judged = [float(model.logistic.predict(np.array([toxicity.features(c.gains(t))]))[0]) >= 0.5 for t, _ in new]
    assert sum(judged[100:]) >= 95 and sum(judged[:100]) <= 5
    assert np.mean(np.concatenate([c.gains(t) for t, y in new if not y]) != 0) < 0.1
    # the passages of a text are runs of its bytes, and copies of one text tell nothing
    telling = toxicity._telling([b"some words here"] * 50, [b"other words there %d" % i for i in range(50)])
    assert not telling.any() and toxicity._passages(b"some words here", telling) == []
    telling[toxicity._pieces(b"abcdefgh")] = True
    assert toxicity._passages(b"xx abcdefgh yy abcdefgh", telling) == [b"abcdefgh", b"abcdefgh"]


def test_toxicity_query_equals_plain_walk(spark, tmp_path):
    """Scores of the query, text by text; labels of held-out rows change nothing."""
    r = random.Random(17)
    bad = ["vile", "nasty", "horrid", "odious"]
    rows = []
    for i in range(300):
        w = [r.choice(VOCABULARY) for _ in range(r.randrange(20, 120))]
        for _ in range(6 if i % 3 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "VILE " * 4000), (5, rows[5][1])]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    frame(spark, rows).write.parquet(str(tmp_path / "a/documents.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "b/documents.parquet"))
    labels = [(i, 1, int(i % 3 == 0)) for i in range(280)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    spark.createDataFrame([(i, q, 1 - y if held(i) else y) for i, q, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    got = sorted(map(tuple, toxicity.op1_toxicity(spark, str(tmp_path / "a")).collect()))
    assert got == sorted(map(tuple, toxicity.op1_toxicity(spark, str(tmp_path / "b")).collect()))
    model = toxicity.fit(spark.read.parquet(str(tmp_path / "a/documents.parquet")), spark.read.parquet(str(tmp_path / "a/labels.parquet")), mod=5, held=0)
    c = toxicity.Compressors(model.toxic, model.ordinary)
    want = []
    for i, t in rows:
        s = float(model.logistic.predict(np.array([toxicity.features(c.gains(lower(t).encode()))]))[0])
        want.append((i, held(i), s, int(s >= 0.5)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(math.isclose(x[2], y[2], rel_tol=1e-9) and x[3] == y[3] for x, y in zip(got, sorted(want), strict=True))
    assert sum(x[3] == (x[0] % 3 == 0) for x in got if x[0] < 300) > 270


def test_texts_of_one_id_and_rows_without_id(spark):
    """Texts of one id are documents in byte order; rows without an id keep all, and take nothing from others."""
    a, b, c, d = (prose(30) for _ in range(4))
    rows = [(1, max(a, b)), (1, min(a, b)), (1, min(a, b)), (2, c), (3, "x " + a + " y"), (4, d), (None, c), (None, d), (None, None)]
    got = [(r["doc_id"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, min(a, b)), (1, 0, max(a, b)), (2, 0, c), (3, 30, "x y"), (4, 0, d), (None, 0, c), (None, 0, d), (None, 0, "")], key=str)
    got = substring_dedup.remove_repeats(spark.createDataFrame([x for x in rows if x[0] != 1], "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (0, 0), (2, 0), (3, 0), (4, 0)]


def test_lm_scores_each_row(spark):
    """Rows that share an id, or have none, keep their own results."""
    rows = [(1, "a b"), (1, "a b c"), (1, "a b"), (None, "b"), (None, "zzzzzzzz " + "q" * 3000), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_tokens"]) for r in lm_score.score(d, Scratch(spark), passes=1, head=0).collect()]
    assert sorted(got, key=str) == sorted([(1, 3), (1, 4), (1, 3), (None, 2), (None, 3), (3, 1)], key=str)
    alone = lm_score.score(d.where("text is not null"), Scratch(spark), passes=1).collect()
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in alone) and len({r["score"] for r in alone if r["doc_id"] == 1}) == 2


def plain_statistics(text):
    """quality.NAMES of a text, counted one by one."""
    b = (text or "").encode()
    w = [x.lower() for x in b.split()]
    n, size, pairs, lines = len(w), len(b), list(zip(w, w[1:], strict=False)), b.split(b"\n")
    kinds = [range(65, 91), range(97, 123), range(48, 58), b".,;:", b"!?", [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?"], range(128, 256), b"\n"]
    per = max(n, 1)
    ends = sum(not (x[-1:].isalnum() or x[-1] >= 128) for x in w)
    return [
        *[sum(c in k for c in b) / max(size, 1) for k in map(set, kinds)], math.log1p(size), math.log1p(n), sum(map(len, w)) / per, len(set(w)) / per, sum(x == y for x, y in pairs) / per,
        (len(set(pairs)) if n > 1 else n) / per, max(Counter(w).values(), default=0) / per, ends / per, math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(len(x) > 20 for x in w) / per,
    ]


def test_quality_query_equals_plain_walk(spark, tmp_path):
    """Statistics and scores of the query, text by text; labels of held-out rows change nothing."""
    r = random.Random(19)
    rows = [(i, prose(r.randrange(5, 90)) if i % 3 else " ".join(r.choice(["!!", "x9", "A", "b#"]) for _ in range(r.randrange(5, 90))) + "\nA\nA") for i in range(200)]
    rows += [(200, None), (201, ""), (202, "long" * 9000 + " Ünï\n\n" * 300), (5, rows[5][1])]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, int(i % 3 > 0), 0) for i in range(200)]
    for name, marks in (("a", labels), ("b", [(i, 1 - q if held(i) else q, t) for i, q, t in labels])):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    got = sorted(map(tuple, quality.op6_quality(spark, str(tmp_path / "a")).collect()))
    assert got == sorted(map(tuple, quality.op6_quality(spark, str(tmp_path / "b")).collect()))
    trees = quality.fit(spark.read.parquet(str(tmp_path / "a/documents.parquet")), spark.read.parquet(str(tmp_path / "a/labels.parquet")), mod=3, held=1)
    want = []
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        x = quality.statistics(raw, np.array([0, len(raw)]))[0]
        assert np.allclose(x, plain_statistics(t)), (i, dict(zip(quality.NAMES, zip(x, plain_statistics(t), strict=True), strict=True)))
        f = trees.start
        for split, cut, leaf in zip(trees.split, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(split):
                node = 2 * node + 1 + int(x[split[node]] > cut[node])
            f += leaf[node - len(split)]
        s = 1 / (1 + math.exp(-f))
        want.append((i, held(i), s, int(s >= 0.5)))
    assert all(x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-9) and x[3] == y[3] for x, y in zip(got, sorted(want), strict=True))
    assert sum(x[3] == (x[0] % 3 > 0) for x in got if x[0] < 200) > 190


def test_lm_score_of_a_document_sums_its_words(spark):
    """log10 of the words' summed segmentations, and of the end; the same whether words are broadcast or joined."""
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 2000]
    d = frame(spark, rows)
    a, b = (sorted(map(tuple, lm_score.score(d, Scratch(spark), passes=1, head=h).collect())) for h in (0, 10_000))
    assert all(x[0] == y[0] and math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b, strict=True))
    scratch = Scratch(spark)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    pieces, byte_at, log_p, log_end = lm_score.fit(scratch.table(lm_score.count_words(d)), ends, passes=1)
    lattice = lm_score.Lattice(pieces, byte_at, log_p)
    want = {i: (sum(lattice.marginals([w])[0] for w in lower(t).encode().split()) + log_end) / math.log(10) for i, t in rows}
    assert all(math.isclose(x[5], want[x[0]], rel_tol=1e-9) for x in a)


def test_line_dedup_keeps_plans_and_rows_small(spark):
    """Rarities aren't spelled out in plans, and texts are told apart by a hash only where an id repeats."""
    d = frame(spark, [(1, "a b c\nd e f"), (2, "a b c"), (3, None)])
    assert {r["t"] for r in line_dedup.plain(d).collect()} == {0}
    assert {r["t"] for r in line_dedup.plain(d.union(frame(spark, [(1, "a b")]))).collect()} != {0}
    texts, scratch = line_dedup.plain(d), Scratch(spark)
    tiers = line_dedup.slot_tiers(texts, scratch)
    ordered = line_dedup.lines_of(texts).select("line", tiers.alias("tiers")).select(line_dedup._ordered(F.col("line"), F.col("tiers")).alias("s"))
    assert len(ordered._jdf.queryExecution().toString()) < 100_000
    assert sorted(len(r["s"]) for r in ordered.collect()) == [3, 3, 3]


def test_kept_documents_are_not_shuffled(spark):
    d = frame(spark, [(1, "one two three four five six"), (2, "one two three four five six"), (3, "seven eight nine ten eleven twelve")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_dedup.keep_one(d, Scratch(spark))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["doc_id"] for r in out.collect()} == {1, 3}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
