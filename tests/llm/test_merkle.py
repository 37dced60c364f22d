"""The manifest against a plain tree, at several fans and with more nodes than the driver takes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricegrain.llm import merkle
from pricegrain.llm.common import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, hash int, pos int, grp string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, text):
    return digest([*[field(d[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text)])


def tree(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def tampered(d):
    hit = d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"]) if hit else d["text"]


def plain(docs, fan=16):
    groups = {}
    for d in docs:
        groups.setdefault(d["source"], []).append(((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[0])
    trees = {s: tree([k[2] for k, _ in groups[s]], fan) for s in names}
    over = tree([trees[s][-1][0] for s in names], fan)
    out = []
    for at, s in enumerate(names):
        for i, (key, d) in enumerate(groups[s]):
            node, siblings = leaf(d, tampered(d)), []
            for levels, k in ((trees[s], i), (over, at)):
                for level in levels[:-1]:
                    a = k // fan * fan
                    node = digest([*level[a:k], node, *level[k + 1 : a + fan]])
                    siblings += level[a:k] + level[k + 1 : a + fan]
                    k //= fan
            out.append((d["doc_id"], key[2], trees[s][-1][0], over[-1][0], digest(siblings), node, node == over[-1][0]))
    return sorted(out, key=str)


def documents():
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "B", "é", "", None, f"s{i % 9}"]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Text", "TEXT é " * 3, "", None, "plain"])) for i in range(700)]
    rows += [(None, "hot", "en", 1, "Z"), (None, None, None, None, None), (3, "hot", "en", 1, "Again"), (3, "hot", "en", 1, "Again"), (9000, "alone", "en", 2, "One"), (9001, "a", "en", 3, "Long text " * 30_000)]
    return [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows]


def frame(spark, docs):
    return spark.createDataFrame([(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"], 1, 2, "g") for d in docs], SCHEMA)


def test_query_equals_a_plain_tree(spark, tmp_path):
    docs = documents()
    one, none = docs[:1], []
    for name, rows in (("many", docs), ("one", one), ("none", none)):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = sorted((tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path / name)).collect()), key=str)
        assert got == (plain(rows) if rows else [])


@pytest.mark.parametrize("fan, height, top", [(2, 2, 3), (2, 2, 50), (3, 1, 20)])
def test_more_nodes_than_the_driver_takes(spark, fan, height, top):
    """Blocks of blocks, and more groups than top."""
    docs = documents()
    fields = [F.col(c) for c in merkle.FIELDS]
    leaves = frame(spark, docs).select("doc_id", "source", merkle.leaf(*fields).alias("hash")).withColumn("other", F.col("hash"))
    got = merkle.manifest(leaves, Scratch(spark), "source", "doc_id", proofs=True, fan=fan, height=height, top=top).collect()
    want = [(*x[:5], x[3], True) for x in plain(docs, fan)]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    for r in got[::50]:
        steps = [(s["at"], bytes(s["others"])) for s in r["proof"]]
        assert merkle.folded(bytes.fromhex(r["leaf"]), steps).hex() == r["root"]
        assert hashlib.sha256(b"".join(o for _, o in steps).hex().encode()).hexdigest() == r["proof_sha256"]


def test_a_changed_row_is_found(spark):
    docs = documents()
    leaves = frame(spark, docs).select("doc_id", "source", merkle.leaf(*[F.col(c) for c in merkle.FIELDS]).alias("hash"))
    changed = leaves.withColumn("other", F.when(F.col("doc_id") == 17, F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("hash")))
    got = merkle.manifest(changed, Scratch(spark), "source", "doc_id").where("not verified").collect()
    assert [r["doc_id"] for r in got] == [17]
