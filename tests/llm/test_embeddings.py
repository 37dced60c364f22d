"""NN-descent against all pairs."""

import numpy as np

from pricegrain.llm import embedding_dedup as e
from pricegrain.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, copies long, component long"


def vectors():
    r = np.random.default_rng(4)
    out = [r.standard_normal(16).astype(np.float32) for _ in range(300)]
    centre = r.standard_normal(16)
    out += [(centre + 0.12 * r.standard_normal(16)).astype(np.float32) for _ in range(80)]  # a group with similarities around the threshold
    out += [(out[k] + 0.05 * r.standard_normal(16)).astype(np.float32) for k in range(20)]
    out += [out[3]] * 5 + [2 * out[4], -out[5], np.zeros(16, np.float32)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    n = len(rows)
    return [*rows, (n, None), (n + 1, []), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None, 2.0]), (n + 4, [float("inf")] + [0.0] * 15), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]


def test_equals_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, 9, 9) for i, v in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(df, Scratch(spark)).collect()}
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _ in rows}
    for i, x in good.items():
        for j, y in good.items():
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[i].add(j)
    label = {i: i for i in links}
    for _ in range(len(links)):
        new = {i: min([label[i], *[label[j] for j in links[i]]]) for i in links}
        if new == label:
            break
        label = new
    assert set(got) == set(links)
    assert got == {i: (len(links[i]), label[i]) for i in links}


def test_enlarged_lists_stay_long(spark, monkeypatch):
    """A list that was doubled and is not full of links any more keeps all its entries, also in a further try."""
    r = np.random.default_rng(2)
    reps = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(4)]) for i in range(40)], "vec_id long, embedding array<float>")
    entries = [(0, v, 0.95 if v < 13 else 0.5, 1) for v in range(1, 17)]
    start = spark.createDataFrame([x[:3] for x in entries], "u long, v long, sim double")
    monkeypatch.setattr(e, "first_graph", lambda *a, **k: start.limit(0))
    monkeypatch.setattr(e, "descend", lambda *a, **k: start.limit(0))
    got = e.neighbour_graph(reps, 40, Scratch(spark), k=8, start=start, first=8)
    assert {x["v"] for x in got.collect()} == set(range(1, 17))


def test_empty_and_few(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0], 0, 0, 0), (5, [1.0, 0.0], 0, 0, 0), (6, [1.0, 0.0], 0, 0, 0)], SCHEMA)
    assert sorted(map(tuple, e.near_duplicates(one, Scratch(spark)).collect())) == [(5, 1, 5), (6, 1, 5)]


def skewed():
    """A group of a third of all vectors, pairs, and vectors on their own."""
    r = np.random.default_rng(9)
    centre = r.standard_normal(32)
    out = [centre + 0.05 * r.standard_normal(32) for _ in range(80)]
    for _ in range(40):
        x = r.standard_normal(32)
        out += [x, x + 0.05 * r.standard_normal(32)]
    out += [r.standard_normal(32) for _ in range(80)]
    return [(i, [float(v) for v in x.astype(np.float32)], 0, 9, 9) for i, x in enumerate(out)]


def test_audit_sees_small_groups_beside_a_large_one(spark, monkeypatch):
    """The graph finds the large group only: the audit must notice, and all pairs must be found all the same."""
    rows = skewed()
    graph = lambda *a, **k: spark.createDataFrame([(0, i, 0.99) for i in range(1, 80)], "u long, v long, sim double")
    monkeypatch.setattr(e, "neighbour_graph", graph)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark)).collect()}
    want = {i: (79, 0) for i in range(80)} | {i: (1, i - i % 2) for i in range(80, 160)} | {i: (0, i) for i in range(160, 240)}
    assert got == want


def test_all_links_over_several_blocks(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    scratch = Scratch(spark)
    got = {r["id"]: r["component"] for r in e.components(scratch, e.all_links(df, 240, block=50)).collect()}
    assert got == {i: 0 for i in range(80)} | {i: i - i % 2 for i in range(80, 160)}


def test_each_try_has_other_trees(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    pairs = lambda first: {(r["u"], r["v"]) for r in e.first_graph(df, 240, 2, trees=1, first=first).collect()}
    assert pairs(0) != pairs(8)
