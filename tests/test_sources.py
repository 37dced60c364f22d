import json
import time

import pyarrow as pa
import pytest

from pricegrain.sources import feeds, provider

FIELDS = ("name", "mpn", "feed_sku", "price", "url", "in_stock")


def typed(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def test_delimited(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('﻿Product Name;MPN;Item #;Sale Price;Buy URL;Availability\n"A ""x""; DDR5\nkit";M1;1;"$1,299.50 each";https://a;In Stock\n;;;;;\nB;;2;0;https://b;maybe\nC;;3;5;;yes\n', encoding="utf-8")
    assert typed(feeds.load_feed(spark, str(p))) == [('A "x"; DDR5\nkit', "M1", "1", 1299.5, "https://a", True), ("B", "", "2", None, "https://b", None)]


def test_xml(spark, tmp_path):
    p = tmp_path / "f.xml"
    p.write_text("<?xml version='1.0'?><catalog><item id='1'><Title>A &amp; <b>B</b></Title><price>12.5</price><link><![CDATA[https://a?x=1]]></link><stock>no</stock></item>\n<item id='2'><title>C</title><title>D</title><price>x</price><link>https://c</link></item></catalog>")
    assert typed(feeds.load_feed(spark, str(p))) == [("A &amp; B", "", "", 12.5, "https://a?x=1", False), ("C", "", "", None, "https://c", None)]


def test_headers_must_be_known(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="name"):
        feeds.load_feed(spark, str(p))


def test_sniffing():
    assert feeds.sniffed_delimiter("a|b|c,d") == "|" and feeds.sniffed_delimiter("a") == "," and feeds.mapped_headers(["Title", "Name"])["name"] == "Title"


def test_search_results(spark, tmp_path):
    p = tmp_path / "d.json"
    item = lambda a: {"id": a, "name": a, "min_price": "1"}
    jobs = [{"query_idx": 0, "category": "ram", "free_credits": "2", "results": [{"content": {"search_results": [item("x"), item("y")]}}, {"content": {"products": [item("z")]}}]}, {"query_idx": 1, "category": "ssd", "paid_credits": "n/a", "results": []}]
    p.write_text("\n".join(json.dumps(j) for j in jobs))
    assert [r["asin"] for r in feeds.search_results(spark, str(p)).orderBy("query_idx", "pos").collect()] == ["x", "y", "z"]
    row = feeds.credits(spark.read.schema(feeds.DOWNLOAD).json(str(p))).first()
    assert (row["free_credits"], row["paid_credits"], row["jobs"]) == (2.0, 0.0, 2)
    assert feeds.json_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def fetch(ids):
    return [{"asin": i, "n": len(ids)} for i in ids]


def test_provider_source(spark):
    r = provider.ProviderReader({"ids": ",".join(map(str, range(250))), "fetch": "tests.test_sources:fetch"})
    parts = r.partitions()
    assert [len(p.ids) for p in parts] == [100, 100, 50] and next(r.read(parts[0]))[0] == "0"


def test_token_bucket():
    now = [0.0]
    bucket = provider.TokenBucket(20, 5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.take(5) == 0 and bucket.take(1) == pytest.approx(3.0)


def test_batches_begin_when_their_tokens_are_there():
    bucket = provider.TokenBucket(20, 100, clock=lambda: 5.0)
    assert provider.schedule(bucket, [100, 100, 50]) == pytest.approx([0, 300, 450])


def test_lanes_keep_to_their_share_of_the_rate():
    """A lane asks in order, a batch at a time, each once its tokens are there; short and empty lanes too."""
    now, asked = [0.0], []
    bucket = lambda: provider.TokenBucket(30, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    fetch = lambda ids: asked.append((round(now[0], 6), ids)) or [{"asin": x} for x in ids if x != "c"]
    rows = [pa.record_batch({"asin": x}) for x in (["a", "b"], [], ["c", "d", "e", "f", "g"])]
    out = [b.to_pydict() for b in provider.lane(iter(rows), fetch, bucket(), size=3)]
    assert asked == [(0, ["a", "b", "c"]), (6, ["d", "e", "f"]), (8, ["g"])]
    assert [b["asin"] for b in out] == [["a", "b"], ["d", "e", "f"], ["g"]] and json.loads(out[0]["payload"][1]) == {"asin": "b"}
    assert list(provider.lane(iter([]), fetch, None)) == []


def test_fetched_asks_for_each_id_once(spark):
    ids = spark.createDataFrame([(x,) for x in [*map(str, range(250)), "7", None, ""]], "asin string")
    got = provider.fetched(ids, fetch, lanes=2, per_minute=0, size=40)
    assert got.rdd.getNumPartitions() == 2 and sorted(r["asin"] for r in got.collect()) == sorted(map(str, range(250)))
    assert provider.fetched(ids.limit(0), fetch, per_minute=0).count() == 0


def test_patient_fetch():
    """Waits as long as the provider says, pauses after a slow call, gives up after the last try."""
    waits, answers = [], [provider.Shortage(7.5), TimeoutError(), [{"asin": "a"}]]

    def once(ids):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert provider.patient(once, ["a"], sleep=waits.append) == [{"asin": "a"}] and waits == [7.5, 2.0]
    answers[:] = [provider.Shortage(1.0)] * 3
    with pytest.raises(provider.Shortage):
        provider.patient(once, ["a"], sleep=waits.append)
    with pytest.raises(TimeoutError):
        provider.patient(lambda ids: time.sleep(0.3), ["a"], attempts=2, timeout=0.05, sleep=lambda s: None)


def test_parents_come_from_the_artifact_where_the_column_is_missing_or_empty(spark):
    artifact = spark.createDataFrame([("s", "B1"), ("s", "B1")], "sku string, parent string")
    own = spark.createDataFrame([("s", "B9"), ("t", None)], "sku string, parent string")
    got = lambda d: sorted(((r["sku"], r["parent"]) for r in feeds.parent_of(d, artifact).collect()), key=str)
    assert got(own) == [("s", "B9"), ("t", None)]
    assert got(own.drop("parent")) == got(own.withColumn("parent", own["parent"].substr(99, 1)).replace("", None)) == [("s", "B1"), ("t", None)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from pricegrain import storage

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(cluster)


def test_segment_labels(spark):
    from pricegrain.operators import market

    d = spark.createDataFrame([("ddr5",), ("other",), (None,)], "segment string")
    assert [r["label"] for r in market.labelled(d).collect()] == ["DDR5", "other", None]
