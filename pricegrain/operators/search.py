"""Search over an inverted index of 3-grams.

The index is three Parquet tables. postings holds, for each gram of the compact texts and each range of SPAN ids, the sorted ids of
that range: a common gram is many rows, and no row has more than SPAN ids. It is sorted by gram, so a query reads the row groups of
its own grams only. grams holds how many texts have each gram; letters and digits make at most 37 * 37 * 36 of them. texts holds
the rows themselves in SHARDS folders by id range, so hits are looked up in the folders that hold any.

A token occurs in a text if its grams occur there together, so a query takes each token's rarest grams, intersects their ids range
by range, and looks at the texts of what is left. Texts are closed by two signs, so a token of one or two characters begins some gram;
its postings are those of all grams that it begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import ship
from ..functions import text as T

SPAN, SHARDS, RAREST = 4096, 64, 2
#: Up to so many grams are pushed to the scan as a list; for more the join alone picks them.
PUSHED = 500
#: Pairs of a gram and a text that are sorted at once while indexing, and queries that are asked of one row of a text.
SORTED, ASKED = 4_000_000, 4096
SIGNS = "$0123456789abcdefghijklmnopqrstuvwxyz"


def grams_of(text: Column) -> Column:
    """All runs of three characters of a compact text."""
    return F.regexp_extract_all(text, F.lit("(?=(...))"), F.lit(1))


@cache
def _all_grams() -> pa.Array:
    return pa.array([a + b + c for a in SIGNS for b in SIGNS for c in SIGNS])


def postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, part and the sorted ids of batches' texts (ord, c: compact); a gram and part may come several times."""
    place = np.zeros(128, np.int32)
    place[[ord(x) for x in SIGNS]] = np.arange(len(SIGNS))
    seen, n = np.zeros(len(SIGNS) ** 3, bool), len(SIGNS)

    def sorted_out(grams: list, ids: list) -> pa.RecordBatch:
        # texts are put in order, not their grams' ids: what is left is one radix sort of two bytes
        texts = np.argsort(np.array(ids), kind="stable")
        gram, at = np.concatenate([grams[i] for i in texts]), np.repeat(np.array(ids)[texts], [len(grams[i]) for i in texts])
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        part = at // SPAN
        first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(at))
        return pa.RecordBatch.from_arrays([_all_grams().take(pa.array(gram[first])), pa.array(part[first]), lists], ["gram", "part", "ids"])

    grams, ids, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            signs = place[np.frombuffer(text.as_py().encode() + b"$$", np.uint8)]
            seen[(signs[:-2] * n + signs[1:-1]) * n + signs[2:]] = True
            held = np.flatnonzero(seen)
            seen[held] = False
            if len(held):
                grams.append(held.astype(np.uint16))
                ids.append(i)
                size += len(held)
            if size >= SORTED:
                yield sorted_out(grams, ids)
                grams, ids, size = [], [], 0
    if size:
        yield sorted_out(grams, ids)


@dataclass(frozen=True)
class Index:
    """A built index: where its tables lie."""

    spark: SparkSession
    path: str
    schema: StructType

    def table(self, name: str) -> DataFrame:
        schemas = {"texts": self.schema, "postings": "gram string, part long, ids array<long>, n int", "grams": "gram string, n long"}
        return self.spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}")


def _part(ord_: Column) -> Column:
    return F.floor(ord_ / SPAN).cast("long")


def _shard(ord_: Column) -> Column:
    return F.pmod(_part(ord_), F.lit(SHARDS)).cast("int")


def build(rows: DataFrame, path: str) -> Index:
    """The index of rows (ord, a number by which ties are ordered; name, search, brand and any other columns).

    Rows without an ord aren't indexed. Ids meet by (gram, id range), so a gram that all texts hold is no hot key.
    """
    known = rows.where("ord is not null").withColumn("ord", F.col("ord").cast("long"))
    # _row tells rows of one ord apart; it is written, so it stays
    texts = known.withColumn("_row", F.monotonically_increasing_id()).withColumn("shard", _shard(F.col("ord")))
    index = Index(rows.sparkSession, path, texts.schema)
    texts.repartition("shard").sortWithinPartitions("shard", "ord").write.partitionBy("shard").parquet(f"{path}/texts")
    ship(rows.sparkSession)
    held = index.table("texts").select("ord", T.compact(F.col("search")).alias("c")).mapInArrow(postings_of, "gram string, part long, ids array<long>")
    postings = held.groupBy("gram", "part").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    postings.withColumn("n", F.size("ids")).repartition("gram", "part").sortWithinPartitions("gram", "part").write.parquet(f"{path}/postings")
    index.table("postings").groupBy("gram").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/grams")
    return index


def tokens_of(query: Column) -> Column:
    """The tokens of a query string, in order."""
    return F.filter(F.split(T.search_text(query), T.S + "+"), lambda t: t != "")


def conditions(index: Index, queries: DataFrame) -> DataFrame:
    """query, cond, gram, n_conds: a text may match only if of each of its query's conds it has one of the grams."""
    tokens = queries.select("query", F.posexplode(F.array_distinct("tokens")).alias("t", "token"))
    grams = index.table("grams")
    long = tokens.where(F.length("token") >= 3).select("query", "t", F.explode(F.array_distinct(grams_of(F.col("token")))).alias("gram"))
    sized = long.join(F.broadcast(grams), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("query", "t").orderBy("n", "gram"))
    rare = sized.withColumn("_r", rank).where(F.col("_r") <= RAREST).select("query", (F.col("t") * RAREST + F.col("_r") - 1).alias("cond"), "gram")
    begins = grams.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("token")).distinct()
    short = tokens.where(F.length("token") < 3).join(F.broadcast(begins), "token", "left").select("query", (F.col("t") * RAREST).alias("cond"), F.coalesce("gram", F.lit("")).alias("gram"))
    both = rare.unionByName(short)
    return both.join(both.groupBy("query").agg(F.count_distinct("cond").alias("n_conds")), "query")


def _few_conditions(index: Index, tokens: list[str]) -> list[tuple[int, int, str, int]]:
    """conditions() of one query that was typed in, from one look at the sizes of its grams."""
    runs = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    wanted, short = sorted(set().union(*map(runs, tokens))), [t for t in tokens if len(t) < 3]
    begins = [F.startswith("gram", F.lit(t)) for t in short]
    sizes = {r["gram"]: r["n"] for r in index.table("grams").where(reduce(lambda a, b: a | b, begins, F.col("gram").isin(wanted))).collect()}
    out = []
    for t, token in enumerate(dict.fromkeys(tokens)):
        if len(token) < 3:
            out += [(0, t * RAREST, g) for g in sizes if g.startswith(token)] or [(0, t * RAREST, "")]
        else:
            out += [(0, t * RAREST + r, g) for r, g in enumerate(sorted(runs(token), key=lambda g: (sizes.get(g, 0), g))[:RAREST])]
    return [(*x, len({c for _, c, _ in out})) for x in out]


def candidates(index: Index, wanted: DataFrame) -> DataFrame:
    """query, ord: the texts that meet all conditions of a query, each once."""
    chosen = [r["gram"] for r in wanted.select("gram").distinct().limit(PUSHED + 1).collect()]
    postings = index.table("postings").drop("n")
    if len(chosen) <= PUSHED:
        postings = postings.where(F.col("gram").isin(chosen))
    met = postings.join(wanted, "gram").groupBy("query", "part", "cond", "n_conds").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    lists = met.groupBy("query", "part", "n_conds").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("n_conds"))
    return lists.select("query", F.explode(F.reduce(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)).alias("ord"))


def _written(index: Index, rows: DataFrame) -> DataFrame:
    """Rows that several steps read, written beside the index (narrow ones: conditions, ids)."""
    path = f"{index.path}/asked-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return index.spark.read.schema(rows.schema).parquet(path)


def _asked(index: Index, queries: DataFrame | str) -> DataFrame:
    """The texts that may hold all tokens of a query, with _asked: those queries (query, tokens), at most ASKED or so in a row.

    A text is read and made compact once for all its queries, not once for each.
    """
    if isinstance(queries, str):
        tokens, spark = T.search_tokens(queries), index.spark
        wanted, n = spark.createDataFrame(_few_conditions(index, tokens), "query long, cond int, gram string, n_conds long"), 1
        queries = spark.range(1).select(F.col("id").alias("query"), F.array(*[F.lit(t) for t in tokens]).cast("array<string>").alias("tokens"))
    else:
        wanted = _written(index, conditions(index, queries))
        n = wanted.select("query").distinct().count()
    pairs = candidates(index, wanted).join(queries.select("query", "tokens"), "query")
    some = pairs.groupBy("ord", F.pmod(F.xxhash64("query"), F.lit(-(-n // ASKED) or 1)).alias("_chunk")).agg(F.collect_list(F.struct("query", "tokens")).alias("_asked"))
    some = _written(index, some.drop("_chunk"))
    return some.join(_texts_of(index, some), "ord")


def _texts_of(index: Index, ids: DataFrame) -> DataFrame:
    """The texts in the folders that hold any of the ids (ord)."""
    shards = [r["shard"] for r in ids.select(_shard(F.col("ord")).alias("shard")).distinct().collect()]  # SHARDS rows at most
    return index.table("texts").where(F.col("shard").isin(shards)).drop("shard")


def _held(asked: Column, compact: Column) -> Column:
    """Those queries whose tokens a compact text all holds."""
    return F.filter(asked, lambda q: F.forall(q["tokens"], lambda t: F.contains(compact, t)))


def found(index: Index, queries: DataFrame | str) -> DataFrame:
    """query, tokens and the columns of every text that holds all tokens of a query (query, tokens); queries without tokens find nothing.

    queries may be one query string; its number is 0.
    """
    hits = T.let(T.compact(F.col("search")), lambda c: _held(F.col("_asked"), c))
    out = _asked(index, queries).withColumn("_hit", F.explode(hits))
    return out.select("_hit.*", *[c for c in out.columns if c not in ("_hit", "_asked", "_row")])


def scores(asked: Column) -> Column:
    """Of the queries asked those that a text (name, search, brand) holds, with score: 1000 if a token is the brand, 500 if the name begins with the whole query or else 300 if with its first token, less the tokens' places (in the spaced text, else in the compact one)."""
    # the first characters of a long name tell how it begins, if enough of them are letters
    begins = lambda h, start: F.when(F.length(h) >= F.length(start), F.startswith(h, start)).otherwise(F.startswith(T.search_text(F.col("name")), start))
    at = lambda t, s, c: T.let(F.position(t, s), lambda p: F.when(p > 0, p).otherwise(F.position(t, c)) - 1)

    def score(q: Column, s: Column, c: Column, b: Column, h: Column) -> Column:
        tokens = q["tokens"]
        brand = F.when((b != "") & F.array_contains(tokens, b), 1000).otherwise(0)
        start = F.when(begins(h, F.array_join(tokens, " ")), 500).when(begins(h, F.get(tokens, F.lit(0))), 300).otherwise(0)
        return brand + start - F.reduce(tokens, F.lit(0), lambda sum_, t: sum_ + at(t, s, c))

    text, head = T.search_text(F.col("search")), T.search_text(F.substring("name", 1, 256))
    each = lambda s, c, b, h: F.transform(_held(asked, c), lambda q: F.struct(q["query"].alias("query"), q["tokens"].alias("tokens"), score(q, s, c, b, h).alias("score")))
    return T.let(text, lambda s: T.let(T.compact(F.col("search")), lambda c: T.let(T.search_text(F.col("brand")), lambda b: T.let(head, lambda h: each(s, c, b, h)))))


def ranked(index: Index, queries: DataFrame | str, k: int = 8) -> DataFrame:
    """The k best texts of each query (see found) with score and place; ties: the shorter name, then ord. Hits are ranked without their texts, which join the k best only."""
    hits = _asked(index, queries).select("ord", "_row", F.length("name").alias("_long"), F.explode(scores(F.col("_asked"))).alias("_hit")).select("ord", "_row", "_long", "_hit.*")
    order = W.partitionBy("query").orderBy(F.desc("score"), "_long", "ord", "_row")
    best = _written(index, hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_long"))
    out = best.join(_texts_of(index, best), ["ord", "_row"])
    return out.select("query", "tokens", *[c for c in out.columns if c not in ("query", "tokens", "_row")])
