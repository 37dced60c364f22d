"""Links of repeated and missing ids: every text and every vector links, whatever name it bears."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrain.llm import embedding_dedup as e
from pricegrain.llm import near_dedup
from pricegrain.llm.common import Scratch

WORDS = [f"w{i}" for i in range(200)]
A, B, C = " ".join(WORDS[:31]), " ".join(WORDS[40:71]), " ".join(WORDS[80:120])


def plain_near(rows):
    """component_id of each row: rows are nodes, equal (id, text) rows one node."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    label = [i for i, _ in rows]
    for _ in rows:
        for x, (i, _) in enumerate(rows):
            for y, (j, _) in enumerate(rows):
                near = sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
                if i is not None and j is not None and near and label[y] < label[x]:
                    label[x] = label[y]
    return sorted(((i, len(s), c, c == i) for (i, _), s, c in zip(rows, sets, label, strict=True)), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (2, B), (2, A + " z"), (3, B + " q")],
        [(5, A), (5, A), (5, B), (4, B), (9, C), (None, C), (None, C), (8, C + " x"), (None, None), (7, ""), (7, None)],
        [(3, A), (3, A + " z"), (2, A + " z y"), (2, B), (None, A)],
        [(None, A), (None, B)],
    ],
)
def test_every_text_of_an_id_links(spark, rows):
    d = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, copies int, number int")
    got = near_dedup.near_duplicates(d, Scratch(spark)).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_near(rows)


def plain_vectors(rows):
    """(vec_id, n_links, component_id) of each different vector of each id."""
    nodes = []
    for i, v in rows:
        fine = v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)
        x = tuple(float(np.float32(c)) for c in v) if fine else None
        if (i, x) not in nodes:
            nodes.append((i, x))
    near = lambda x, y: x is not None and y is not None and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.9
    links = {a: [b for b in range(len(nodes)) if b != a and near(nodes[a][1], nodes[b][1])] for a in range(len(nodes))}
    label = [i for i, _ in nodes]
    for _ in nodes:
        for a, bs in links.items():
            label[a] = min([label[a], *[label[b] for b in bs]])
    return sorted((i, len(links[a]), label[a]) for a, (i, _) in enumerate(nodes))


def test_every_vector_of_an_id_links(spark):
    r = np.random.default_rng(6)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (4, [0.0, 0.0]), (4, [-1.0, 0.0])]
    rows += [(10 + k % 30, [float(x) for x in r.standard_normal(3)]) for k in range(120)]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, copies int, rep int")
    got = e.near_duplicates(d, Scratch(spark))
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got.collect()) == plain_vectors(rows)


def test_the_audit_looks_on_until_it_has_links(spark):
    """2,000 vectors, of which 30 have links: all are looked at, and the recall of these is a figure, not a default."""
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(24)]) for i in range(1970)]
    rows += [(5000 + i, [x + 0.01 for x in rows[i][1]]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, recall = e.audited(d, Scratch(spark))
    assert got.where("n_links > 0").count() == 60 and recall >= 0.9
    got, recall = e.audited(d.where("vec_id < 5000"), Scratch(spark))
    assert got.where("n_links > 0").count() == 0 and recall is None


def test_tables_of_hashes_fill_no_dictionaries(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from pricegrain.llm import line_dedup as L
    from pricegrain.llm.common import Scratch

    scratch = Scratch(spark)
    texts = L.plain(spark.createDataFrame([(i, f"a b c{i}\nd e f g") for i in range(50)], "doc_id long, text string"))
    once = L.classes(texts, L.slot_tiers(texts, scratch), scratch)[1]
    (file, *_) = glob.glob(once.scratch_path.removeprefix("file:") + "/*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    assert not any("DICTIONARY" in e for k in range(group.num_columns) for e in group.column(k).encodings) and once.count() == 51
