"""The pipeline, stage by stage, against plain versions on a small corpus."""

import hashlib
import math
import random

import corpus_pipeline
from pricegrain.llm import decontamination, toxicity

from .test_texts import brute_components, brute_lines, words


def corpus():
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(80)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bad = ["vile", "nasty", "horrid", "odious"]
    items = [(k, " ".join(f"q{k}x{r.randrange(50)}" for _ in range(25))) for k in range(4)]
    shared = prose(12)
    docs = []
    for i in range(240):
        w = prose(60).split()
        if i % 4 == 0:
            w += [r.choice(bad) for _ in range(8)]
            r.shuffle(w)
        text = " ".join(w)
        if i % 10 == 3:
            text += "\n" + shared + "\n" + prose(9)
        if i % 30 == 7:
            text += "\n" + items[i % 4][1]
        docs.append((i, text, "en", f"s{i % 5}" if i % 11 else None, len(text)))
    docs += [(1000 + i, docs[4 * i + 1][1] + " end", "en", "s1", 0) for i in range(10)] + [(2000, None, None, None, None), (2001, "", "en", "s9", 0)]
    return docs, [(i, 1, int(i % 4 == 0)) for i in range(200)], items


def plain_mix(rows):
    size = {d[0]: len(words(d[1])) for d in rows}
    sources = sorted({d[3] for d in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d[0]] for d in rows if d[3] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    capped: set = set()
    while True:
        rest, free = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        over = {s for s in sources if s not in capped and rest * weight[s] / free >= 2 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * total[s] if s in capped else rest * weight[s] / free for s in sources}
    out = {}
    for s in sources:
        mine = []
        for d in rows:
            if d[3] == s:
                u = (int(hashlib.md5(str(d[0]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = 1.0 if d[1] is not None and 3.5 <= len(d[1]) / max(size[d[0]], 1) <= 12 else 0.5
                mine.append((-math.log(u) / w, d[0]))
        epochs = int(target[s] // total[s]) if total[s] else 0
        upto = 0
        for _, i in sorted(mine):
            upto += size[i]
            out[i] = size[i] * (epochs + (size[i] > 0 and upto - size[i] / 2 <= target[s] - epochs * total[s]))
    return out


def test_pipeline_equals_plain_versions(spark, tmp_path):
    docs, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing"]

    # the same model, walked text by text
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(d, spark.read.parquet(str(tmp_path / "labels.parquet")))
    c = toxicity.Compressors(model.toxic, model.ordinary)
    score = lambda t: float(model.logistic.predict(__import__("numpy").array([toxicity.features(c.gains(toxicity._lower((t or "").encode())))]))[0])
    rows = [x for x in docs if score(x[1]) < 0.5]
    assert 170 <= len(rows) <= 200
    got = corpus_pipeline.reject_toxic(spark, d, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == {x[0] for x in rows} and got.columns == d.columns

    gone = brute_lines([(x[0], x[1]) for x in rows])
    cut = lambda x: x[1] if x[0] not in gone else "\n".join(y for k, y in enumerate(x[1].split("\n")) if k not in gone[x[0]])
    rows = [(x[0], cut(x), *x[2:4], None if cut(x) is None else len(cut(x))) for x in rows]
    kept = brute_components([(x[0], x[1]) for x in rows])
    rows = [x for x in rows if kept[x[0]][1] == x[0]]
    normal = [decontamination.normal(t) for _, t in items]
    rows = [x for x in rows if not any(i in decontamination.normal(x[1]) for i in normal)]
    want = plain_mix(rows)
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_stages_take_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_toxicity_keeps_documents_that_no_model_judges(spark, tmp_path):
    """No labels, labels of other documents, labels of one class: nothing is rejected."""
    docs, _, _ = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for k, labels in enumerate(([], [(-5, 1, 1), (-6, 1, 0)], [(i, 1, 1) for i in range(9)], [(i, 1, 0) for i in range(9)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{k}/labels.parquet"))
        got = corpus_pipeline.reject_toxic(spark, d, str(tmp_path / str(k)))
        assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(x[0] for x in docs)
