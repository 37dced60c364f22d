"""Importance resampling against a plain count, with chunks of a few words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pricegrain.llm import importance
from pricegrain.llm.common import Scratch

SCHEMA = "doc_id long, text string, weight string, n int, place int, row long"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + m]).encode()) % 10_000 for m in (1, 2, 3) for i in range(len(w) - m + 1))


def plain(docs, target):
    count = [features(t) for _, t in docs]
    s, t = sum(count, Counter()), sum((features(x) for x in target), Counter())
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, x), c in zip(docs, count, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(90)] + ["Ünï", "ABC", "x" * 70, "日本", "9", "q" * 49]
    prose = lambda n: rng.choice(" .-\n").join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(rng.randrange(60))) for i in range(300)] + [(300, prose(4000)), (301, "z" * 5000), (302, "!" * 3000), (303, "a " + "é" * 2000 + " b c"), (304, None), (305, ""), (306, " \t"), (7, prose(40)), (None, prose(40)), (None, None)]
    docs += [(400, docs[1][1]), (401, docs[1][1]), (5, docs[5][1])]
    return docs, [prose(25) for _ in range(20)] + [None, ""]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("chunk", [64, 333, importance.CHUNK])
def test_equals_a_plain_count(spark, chunk):
    docs, target = corpus()
    got = importance.resampled(frame(spark, docs), frame(spark, list(enumerate(target))), Scratch(spark), chunk=chunk)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)


def test_empty_tables(spark):
    docs, target = corpus()
    none = frame(spark, [])
    assert importance.resampled(none, frame(spark, list(enumerate(target))), Scratch(spark)).count() == 0
    got = importance.resampled(frame(spark, docs), none, Scratch(spark))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, [])


def test_checksums_of_joined_words():
    rng = random.Random(3)
    w = [bytes(rng.choice(b"abcz019") for _ in range(rng.choice([1, 2, 5, 47, 48, 49, 300]))) for _ in range(400)]
    data = np.frombuffer(b" ".join(w), dtype=np.uint8)
    runs = importance.Runs(data, np.array([0, len(data)]), np.array([-1]))
    for m, (_, bucket) in enumerate(runs.features):
        assert bucket.tolist() == [zlib.crc32(b" ".join(w[i : i + m + 1])) % 10_000 for i in range(len(w) - m)]
