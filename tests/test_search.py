"""Search by the inverted index against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from pricegrain import storage
from pricegrain.functions import text as T
from pricegrain.operators import search

WORDS = ["DDR5-6000", "G.Skill", "Trident", "Z5", "a", "ab", "32GB", "(2x16GB)", "é", "Ring", "ringing", "x", "12"]


def rows():
    rng = random.Random(6)
    out = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))), rng.choice(["G.Skill", "Ring", None])) for i in range(0, 9000, 30)]
    return [*out, (9001, None, "x"), (9002, "", ""), (9003, "ab", "ab"), (20_000_000_000, "Trident ring", "Ring"), (9003, "ab twice", "ab")]


@pytest.fixture(scope="module")
def index(spark):
    d = spark.createDataFrame([(i, t, t, b, 7) for i, t, b in rows()], "ord long, name string, search string, brand string, shardless int")
    return search.build(d, storage.new_path(spark, "search"))


def plain(query):
    tokens = T.search_tokens(query)
    keep = lambda s, space: "".join(c for c in (s or "").lower() if (c.isascii() and c.isalnum()) or (space and c.isspace()))
    out = []
    for i, t, b in rows():
        s, c = keep(t, True), keep(t, False)
        if tokens and all(x in c for x in tokens):
            score = 1000 * (keep(b, True) in tokens) + (500 if s.startswith(" ".join(tokens)) else 300 if s.startswith(tokens[0]) else 0)
            score -= sum((s if x in s else c).find(x) for x in tokens)
            out.append((-score, len(t or ""), i, score))
    return [(i, score) for _, _, i, score in sorted(out)]


QUERIES = ["ring", "g skill", "gskill trident", "a", "ab", "x 12", "2x16", "zzz", "rin ging", "", "!!", "6000 ddr5 ring", "ab ab", "trident z5 32gb a"]


@pytest.mark.parametrize("query", QUERIES)
def test_one_query(index, query):
    got = search.ranked(index, query, 1000).orderBy("place").collect()
    assert [(r["ord"], r["score"]) for r in got] == plain(query)


def test_many_queries_at_once(spark, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query long, q string").select("query", search.tokens_of(F.col("q")).alias("tokens"))
    got = {}
    for r in search.ranked(index, asked, 5).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r["ord"], r["score"]))
    assert got == {k: plain(q)[:5] for k, q in enumerate(QUERIES) if plain(q)}


def test_only_the_tokens_grams_are_read(spark, index):
    wanted = spark.createDataFrame(search._few_conditions(index, ["trident", "ring"]), "query long, cond int, gram string, n_conds long")
    plan = search.candidates(index, wanted)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    assert wanted.select("cond").distinct().count() == 2 * search.RAREST and wanted.count() == 4


def test_no_posting_is_longer_than_a_span(index):
    p = index.table("postings")
    assert p.agg(F.max("n")).first()[0] <= search.SPAN + 1  # one id is there twice
    assert p.where("gram = 'rin'").count() > 1


def test_empty_index(spark):
    d = spark.createDataFrame([], "ord long, name string, search string, brand string")
    empty = search.build(d, storage.new_path(spark, "search"))
    assert search.ranked(empty, "ring").count() == 0 and search.found(empty, "a").count() == 0


def test_a_text_is_read_once_for_all_its_queries(spark, index):
    """Hits are not texts repeated for each query: the texts that many queries ask are as many as the texts, and ranking joins none of them."""
    asked = spark.range(50).select(F.col("id").alias("query"), F.array(F.lit("ring")).alias("tokens"))
    some = search._asked(index, asked)
    assert some.count() == len([1 for _, t, _ in rows() if "ring" in (t or "").lower()]) and some.agg(F.max(F.size("_asked"))).first()[0] == 50
    assert search.ranked(index, asked, 1).count() == 50


@pytest.mark.parametrize("size", [1, 50, 4_000_000])
def test_postings_are_sorted_in_pieces(spark, index, monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(search, "SORTED", size)
    texts = {5: "abcab", 4096: "abc", 7: "", 9: "zabc"}
    batch = pa.RecordBatch.from_pydict({"ord": list(texts), "c": list(texts.values())})
    got = sorted((r["gram"], r["part"], i) for b in search.postings_of(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist() for i in r["ids"])
    assert got == sorted({((t + "$$")[k : k + 3], i // search.SPAN, i) for i, t in texts.items() for k in range(len(t))})


def test_signs_are_told_from_spaces_wherever_they_stand(one):
    kept = T.S[1:-1]
    whole = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z0-9{kept}]+", "")
    for text in [None, "", "abc", "A.b C\néé 한1", "...", " \t x$1 \\ y", "Kİz", "end!"]:
        assert one(T.search_text(F.col("t").cast("string")), t=text) == one(whole(F.col("t").cast("string")), t=text)


def test_long_texts_are_taken_apart_run_by_run(spark):
    # a class that skips to the next rare sign takes several times as long; this one matches whatever stays, too
    plan = spark.range(1).select(T.search_text(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9" in plan and "([a-z0-9" in plan


def test_equal_grams_are_sorted_by_two_bytes(monkeypatch):
    """Ids in any order, a repeated one too, come out sorted, and no sort looks at grams and ids together."""
    import pyarrow as pa

    monkeypatch.setattr(search.np, "lexsort", lambda keys: pytest.fail("a sort of all pairs"))
    batch = pa.RecordBatch.from_pylist([{"ord": i, "c": c} for i, c in [(9000, "abc"), (3, "abcd"), (-5, "abc"), (3, "abc")]])
    got = {(r["gram"], r["part"]): r["ids"] for r in next(search.postings_of(iter([batch]))).to_pylist()}
    assert got["abc", 0] == [3, 3] and got["abc", 2] == [9000] and got["abc", -1] == [-5] and got["bcd", 0] == [3]
