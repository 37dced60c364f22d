"""Embedding near-dedup by NN-descent.

Equal vectors form classes first; a class's smallest id stands for it. A first neighbour graph comes from TREES random
codes: vectors are sorted by code and a further projection (range-partitioned, so no code is a hot key) and runs of LEAF
rows compared. Rounds of NN-descent then refine it: at each vector its neighbours and reverse neighbours meet, their
cosines are computed in double precision, and each takes over those that beat the worst entry of its list. A list whose
last entry is itself a link is saturated and doubles its length in the next round. Rounds end when few lists change.

A recall audit compares about AUDIT vectors with all rows, and twice as many again and again until at least LEAST of them have links,
all were looked at, or MOST were: of each vector's true links the share that joins its component, averaged over the vectors that
have links and, apart, over those with at most FEW of them, so large groups do not hide small ones. While either is under AIM, more
rounds follow with TREES new trees and longer lists, TRIES times in all; if that does not suffice, all vectors are compared in
blocks, and each pair of blocks gives the links that join its rows. Where all were looked at and none has a link, none is sought.
The recall measured last is returned. Links form components; within each component all pairs are then checked in blocks of
vectors, so counts of links are exact even where a list was cut. No pairs are written out for that.

Defined cases: null vectors, zero vectors and those with null or non-finite components link with nothing and are their own
component (one row an id); vectors of different lengths link with nothing; rows that repeat a vec_id with an equal vector are one
vector, different vectors of a vec_id are vectors of their own, each with a row and its own links; rows without a vec_id link with
nothing; an empty table gives an empty result; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NARROW, Scratch, components, read

AT_LEAST = 0.9
TREES, BITS_LEAF, LEAF = 8, 64, 64
K, REVERSE, ROUNDS = 8, 8, 3
STOP = 0.01
AUDIT, AIM = 200, 0.98
#: How many audited vectors should have links, and how many are looked at in all to find them (their rows pass through the driver).
LEAST, MOST = 50, 4096
#: A vector with so many links or fewer is in a small group; tries before all vectors are compared.
FEW, TRIES = 8, 3
BLOCK, WHOLE_BLOCK = 1024, 2048
log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column; shorter rows are padded, the length is added as a last, separate check by the caller."""
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets)
    flat = flat[at[0] : at[-1]]
    size = np.diff(at)
    if len(size) and (size == size[0]).all():
        x = flat.reshape(len(size), -1)
    else:
        x = np.zeros((len(size), int(size.max(initial=0))))
        for k, (a, b) in enumerate(zip(at[:-1] - at[0], at[1:] - at[0], strict=True)):
            x[k, : b - a] = flat[a:b]
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x


def usable(vectors: DataFrame, yes: bool = True) -> DataFrame:
    """vec_id, embedding of the vectors that can link, or of those that can't."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    links = F.coalesce(F.expr("vec_id is not null and embedding is not null and size(embedding) > 0") & fine, F.lit(False))
    return vectors.where(links if yes else ~links).select("vec_id", "embedding")


def first_graph(reps: DataFrame, n: int, k: int = K, trees: int = TREES, first: int = 0) -> DataFrame:
    """u, v, sim: neighbours among runs of rows that random projections bring together; trees are numbered from first, and each number is another tree."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / BITS_LEAF)))))

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if not x.size:
                continue
            ids, listed = batch.column("vec_id"), batch.column("embedding")
            for tree in range(first, first + trees):
                p = np.random.default_rng([tree, x.shape[1]]).standard_normal((x.shape[1], bits + 1))
                y = x @ p
                c = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree), pa.int32()), pa.array(c, pa.int64()), pa.array(y[:, bits]), ids, listed], ["tree", "code", "p", "vec_id", "embedding"])

    kind = reps.schema["embedding"].dataType.simpleString()
    coded = reps.select("vec_id", "embedding").mapInArrow(code, f"tree int, code long, p double, vec_id long, embedding {kind}")
    parts = max(8, min(4096, n * trees // 20_000 + 1))

    def compare(batches):
        for batch in batches:
            ids, sizes = batch.column("vec_id").to_numpy(), np.diff(np.asarray(batch.column("embedding").offsets))
            tree = batch.column("tree").to_numpy()
            x = _matrix(batch.column("embedding"))
            u, v, s = [], [], []
            for a in range(0, len(ids), LEAF):
                b = min(len(ids), a + LEAF)
                a = max(0, b - LEAF)
                sim = x[a:b] @ x[a:b].T
                sim[(sizes[a:b, None] != sizes[None, a:b]) | (tree[a:b, None] != tree[None, a:b])] = -2
                np.fill_diagonal(sim, -2)
                m = min(k, b - a - 1)
                if m < 1:
                    continue
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                u.append(np.repeat(ids[a:b], m)), v.append(ids[a:b][best].ravel()), s.append(np.take_along_axis(sim, best, axis=1).ravel())
            if u:
                u, v, s = np.concatenate(u), np.concatenate(v), np.concatenate(s)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "sim"]).filter(pa.array(s > -2))

    return coded.repartitionByRange(parts, "tree", "code", "p").sortWithinPartitions("tree", "code", "p").mapInArrow(compare, "u long, v long, sim double")


def shorten(edges: DataFrame, lengths: DataFrame | None, k: int) -> DataFrame:
    """The best entries of each list: k of them, or as many as lengths (u, most) says."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    if lengths is None:
        return once.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= k)
    once = once.join(lengths.select("u", "most"), "u", "left").withColumn("most", F.coalesce("most", F.lit(k)))
    return once.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))).where("r <= most").drop("most")


def descend(graph: DataFrame, reps: DataFrame, k: int, reverse: int = REVERSE) -> DataFrame:
    """Better entries (u, v, sim) found where neighbours of one vector meet; only where an entry is new."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n")).select("u", F.when(F.col("n") < k, F.lit(-1.0)).otherwise(F.col("worst")).alias("worst"))
    forward = graph.select(F.col("u").alias("hub"), F.col("v").alias("m"), "new")
    back = graph.select(F.col("v").alias("hub"), F.col("u").alias("m"), "new").withColumn("r", F.row_number().over(W.partitionBy("hub").orderBy(F.desc("new"), F.xxhash64("hub", "m")))).where(F.col("r") <= reverse).drop("r")
    meet = forward.union(back).groupBy("hub", "m").agg(F.max("new").alias("new"))
    fresh = meet.groupBy("hub").agg(F.max("new").alias("any")).where("any = 1").select("hub")
    meet = meet.join(fresh, "hub").join(reps.select(F.col("vec_id").alias("m"), "embedding"), "m").join(worst.withColumnRenamed("u", "m"), "m", "left")
    groups = meet.groupBy("hub").agg(F.collect_list(F.struct("m", "new", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "embedding")).alias("g"))

    def run(batches):
        for batch in batches:
            g = batch.column("g")
            at, all_ = np.asarray(g.offsets), g.values
            base = at[0]
            part = all_.slice(base, at[-1] - base)
            ids, new, worst_ = part.field("m").to_numpy(), part.field("new").to_numpy(), part.field("worst").to_numpy()
            listed = part.field("embedding")
            sizes, x = np.diff(np.asarray(listed.offsets)), _matrix(listed)
            out = ([], [], [])
            for a, b in zip(at[:-1] - base, at[1:] - base, strict=True):
                if b - a < 2:
                    continue
                sim = x[a:b] @ x[a:b].T
                ok = (sim > worst_[a:b, None]) & ((new[a:b, None] + new[None, a:b]) > 0) & (sizes[a:b, None] == sizes[None, a:b])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                out[0].append(ids[a:b][i]), out[1].append(ids[a:b][j]), out[2].append(sim[i, j])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["u", "v", "sim"])

    return groups.select("g").mapInArrow(run, "u long, v long, sim double")


def neighbour_graph(reps: DataFrame, n: int, scratch: Scratch, k: int = K, rounds: int = ROUNDS, at_least: float = AT_LEAST, start: DataFrame | None = None, first: int = 0) -> DataFrame:
    """u, v, sim: the refined lists; with start (u, v, sim), of its entries and those of trees from number first on."""
    if start is None:
        graph = scratch.table(shorten(first_graph(reps, n, k).withColumn("new", F.lit(1)), None, k).drop("r"), NARROW)
    else:
        both = start.select("u", "v", "sim").union(first_graph(reps, n, k, first=first)).withColumn("new", F.lit(1))
        own = start.groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("most")).where(F.col("most") > k)
        graph = scratch.table(shorten(both, own, k).drop("r"), NARROW)
    lengths = None
    for _ in range(rounds):
        better = descend(graph, reps, k).withColumn("new", F.lit(1))
        # a list never gets shorter; a full one that ends in a link may hold twice as many
        held = graph.groupBy("u").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n"))
        full = (F.col("last") >= at_least) & (F.col("n") >= k)
        lengths = scratch.table(held.where(full | (F.col("n") > k)).select("u", F.when(full, F.col("n") * 2).otherwise(F.col("n")).cast("int").alias("most"), full.alias("full")), NARROW)
        after = scratch.table(shorten(graph.withColumn("new", F.lit(0)).union(better), lengths, k).drop("r"), NARROW)
        changed = after.where("new = 1").count()
        scratch.drop(graph)
        graph = after
        if changed < STOP * n * k and lengths.where("full").isEmpty():
            break
    return graph


def true_links(queries: list, reps: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """a, b: each link of a query, by comparing the queries with each row."""
    by_size: dict[int, tuple[list, list]] = {}
    for q in queries:
        x = np.array(q["embedding"], dtype=np.float64)
        ids, xs = by_size.setdefault(len(x), ([], []))
        ids.append(q["vec_id"]), xs.append(x / np.sqrt(x @ x))
    shared = reps.sparkSession.sparkContext.broadcast([(np.array(ids), np.stack(xs)) for ids, xs in by_size.values()])

    def run(batches):
        for batch in batches:
            listed, own = batch.column("embedding"), batch.column("vec_id").to_numpy()
            sizes, x = np.diff(np.asarray(listed.offsets)), _matrix(listed)
            for ids, y in shared.value:
                mine = np.flatnonzero(sizes == y.shape[1])
                for at in range(0, len(ids), 512):
                    i, j = np.nonzero(y[at : at + 512] @ x[mine, : y.shape[1]].T >= at_least)
                    a, b = ids[at : at + 512][i], own[mine][j]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return reps.select("vec_id", "embedding").mapInArrow(run, "a long, b long")


def audit(reps: DataFrame, n: int, scratch: Scratch, at_least: float = AT_LEAST) -> tuple[DataFrame | None, bool]:
    """(a, b: all links of audited vectors, whether every vector was looked at); None if no audited one has a link."""
    part, whole = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)), 1_000_000
    low, high, looked, found = 0, min(whole, int(whole * AUDIT / max(1, n)) + 1), 0, None
    while n:
        queries = reps.where((part >= low) & (part < high)).select("vec_id", "embedding").limit(MOST).collect()
        looked += len(queries)
        if queries:
            links = scratch.table(true_links(queries, reps, at_least), NARROW)
            found = links if found is None else found.union(links)
        if high >= whole or looked >= MOST or (found is not None and found.select("a").distinct().count() >= LEAST):
            break
        low, high = high, min(whole, 2 * high)
    return (None if found is None or found.isEmpty() else found), looked >= n


def recall(true: DataFrame, placed: DataFrame) -> list[tuple[int, int]]:
    """For each audited vector with links: (those that lie in its component, all)."""
    of = lambda x: placed.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    row = true.join(of("a"), "a", "left").join(of("b"), "b", "left").groupBy("a")
    return [(r["got"], r["all"]) for r in row.agg(F.count_if(F.col("ca") == F.col("cb")).alias("got"), F.count(F.lit(1)).alias("all")).collect()]  # at most MOST rows


def shares(found: list[tuple[int, int]], few: int = FEW) -> tuple[float, float]:
    """Average recall of a query, over all and over those with at most few links (1 where there are none)."""
    mean = lambda x: sum(g / n for g, n in x) / len(x) if x else 1.0
    return mean(found), mean([x for x in found if x[1] <= few])


def _joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: (first row, row) for each row that the first reaches."""
    left, a, b = hit.any(axis=1), [], []
    for s in np.flatnonzero(left):
        if not left[s]:
            continue
        left[s] = False
        front = np.array([s])
        while len(front):
            front = np.flatnonzero(hit[front].any(axis=0) & left)
            left[front] = False
            a.append(np.full(len(front), s)), b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def all_links(reps: DataFrame, n: int, at_least: float = AT_LEAST, block: int = WHOLE_BLOCK) -> DataFrame:
    """a, b: what joins the rows that link, by comparing all rows; of each pair of blocks at most one entry a row is returned."""
    blocks = -(-n // block)
    rows = reps.select("vec_id", "embedding").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("vec_id", "own", "embedding").alias("row"))
    groups = sent.groupBy("i", "j").agg(F.collect_list("row").alias("g"))

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                g = batch.column("g").slice(one, 1).flatten()
                i, j = batch.column("i")[one].as_py(), batch.column("j")[one].as_py()
                ids, own = g.field("vec_id").to_numpy(), g.field("own").to_numpy()
                listed = g.field("embedding")
                sizes, x = np.diff(np.asarray(listed.offsets)), _matrix(listed)
                a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
                part = (x[a] @ x[b].T >= at_least) & (sizes[a, None] == sizes[None, b])
                hit = np.zeros((len(ids), len(ids)), dtype=bool)
                hit[np.ix_(a, b)] = part
                hit[np.ix_(b, a)] |= part.T
                np.fill_diagonal(hit, False)
                u, v = _joined(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["a", "b"])

    return groups.select("i", "j", "g").mapInArrow(run, "a long, b long")


def connected(reps: DataFrame, n: int, scratch: Scratch, at_least: float = AT_LEAST) -> tuple[DataFrame, float | None]:
    """(id, component of the vectors that have links, the recall measured); None: no audited vector has a link."""
    true, all_seen = audit(reps, n, scratch, at_least)
    graph, placed, measured = None, None, None
    if true is None and all_seen:
        return reps.sparkSession.createDataFrame([], "id long, component long"), None
    for t in range(TRIES):
        graph = neighbour_graph(reps, n, scratch, K << t, at_least=at_least, start=graph, first=t * TREES)
        links = graph.where(F.col("sim") >= at_least).select(F.col("u").alias("a"), F.col("v").alias("b"))
        # what an earlier try joined stays joined
        placed = components(scratch, links if placed is None else links.union(placed.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        if true is None:
            continue
        found = recall(true, placed)
        every, few = shares(found)
        measured = min(every, few)
        log.info("try %d, %d vectors: recall %.4f of %d audited vectors with links, %.4f of %d with at most %d", t + 1, n, every, len(found), few, sum(x[1] <= FEW for x in found), FEW)
        if measured >= AIM:
            return placed, measured
    if true is None:
        return placed, None
    return components(scratch, scratch.table(all_links(reps, n, at_least), NARROW)), 1.0


def count_links(reps: DataFrame, placed: DataFrame, at_least: float = AT_LEAST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links: how many rows (each times its copies) of its component a vector links with; blocks meet in pairs."""
    rows = reps.join(placed.select(F.col("id").alias("vec_id"), "component"), "vec_id")
    size = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(size, "component").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("vec_id", "own", "copies", "embedding").alias("row"))
    groups = sent.groupBy("component", "i", "j").agg(F.collect_list("row").alias("g"))

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                g = batch.column("g").slice(one, 1).flatten()
                i, j = batch.column("i")[one].as_py(), batch.column("j")[one].as_py()
                ids, own, copies = g.field("vec_id").to_numpy(), g.field("own").to_numpy(), g.field("copies").to_numpy()
                listed = g.field("embedding")
                sizes, x = np.diff(np.asarray(listed.offsets)), _matrix(listed)
                a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
                hit = (x[a] @ x[b].T >= at_least) & (sizes[a, None] == sizes[None, b]) & (ids[a, None] != ids[None, b])
                n_a = hit @ copies[b]
                out = (ids[a], n_a) if i == j else (np.concatenate([ids[a], ids[b]]), np.concatenate([n_a, copies[a] @ hit]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["vec_id", "n"])

    return groups.select("i", "j", "g").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def audited(vectors: DataFrame, scratch: Scratch, at_least: float = AT_LEAST) -> tuple[DataFrame, float | None]:
    """(vec_id, n_links, component_id of each vector, the recall measured or None)."""
    good = scratch.table(usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding")), 50_000)
    named = good.select("vec_id", "h", "h2").distinct()
    # a class of equal vectors gets a number of its own, as an id may be the smallest of several; numbers keep the order of ids
    order = ("rep", "h", "h2")
    classes = named.groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.table(scratch.table(classes, NARROW).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    reps = good.join(classes, ["h", "h2"]).where("vec_id = rep").dropDuplicates(["number"]).select(F.col("number").alias("vec_id"), "embedding", "copies")
    reps = scratch.table(reps, 50_000)
    placed, measured = connected(reps, reps.count(), scratch, at_least)
    found = placed.select(F.col("id").alias("vec_id"), "component").join(count_links(reps, placed, at_least), "vec_id").withColumnRenamed("vec_id", "number")
    first = classes.select(F.col("number").alias("component"), F.col("rep").alias("first"))
    of_class = classes.join(found.join(first, "component"), "number", "left").select("h", "h2", F.coalesce("first", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = named.join(of_class, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = usable(vectors, False).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    return result.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))), measured


def near_duplicates(vectors: DataFrame, scratch: Scratch, at_least: float = AT_LEAST) -> DataFrame:
    """vec_id, n_links, component_id of each vector."""
    return audited(vectors, scratch, at_least)[0]


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of all vectors; recall: what the audit measured, null where no vector has a link."""
    out, measured = audited(read(spark, sf_dir, "embeddings"), Scratch(spark))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id"))).withColumn("recall", F.lit(measured).cast("double"))
