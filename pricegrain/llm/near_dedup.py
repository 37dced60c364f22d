"""MinHash near-dedup with min-max hashing: documents with Jaccard similarity of at least 0.75 on 5-word shingles are linked.

Each of PERMUTATIONS hash functions gives two values of a document's signature, the minimum and the maximum over its
shingles. The 2 * PERMUTATIONS values are cut in bands of BAND values. Documents with an equal band are candidates; each
candidate pair that counts is confirmed on the full shingle sets. At similarity 0.75 a pair shares no band with
probability (1 - 0.75^4)^32, about 5e-6; pairs with more in common are missed still less often.

Copies (equal shingle sets) form classes first and only a class's smallest id goes on. In a band the members are checked
against the smallest id (as many pairs as members). What is linked forms components. Where candidates that hang together lie in
several components, those outside the largest are compared with all the others, in indexed blocks, so large groups of near
copies never give all their pairs.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of 1 to 4 words has one shingle, the whole;
null or empty texts have none and link with nothing; rows that repeat a doc_id with the same text are one document, other texts
of a doc_id are documents of their own that link by themselves (each has a row, and its component is named by the smallest doc_id
among the documents that it reaches); rows without a doc_id have no name to be linked by: they link with nothing, their component is
null and they are kept; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, Scratch, Words, components, inside, mix, numbered, read, text_runs, windows

SHINGLE = 5
PERMUTATIONS, BAND = 64, 4
PER_CENT = 75


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(10)
    return r.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, lower=True)
    every = windows(words.h, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield windows(words.h[a:b], int(b - a), salt=1)
        else:
            yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, next to each other."""
    low = np.full(len(mult), np.iinfo(np.uint32).max, dtype=np.uint32)
    high = np.zeros(len(mult), dtype=np.uint32)
    for at in range(0, len(s), 2048):
        v = ((mult[:, None] * s[None, at : at + 2048] + add[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def sign(docs: DataFrame, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """doc_id, number of shingles, a 128-bit hash of the set and a hash of each band."""

    def run(batches):
        mult, add = _coefficients(permutations)
        spread = _coefficients(band + 1)[0]
        n_bands = 2 * permutations // band
        salts = mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(77))
        for batch, data, offsets in text_runs(batches):
            sizes, hi, lo, bands, lengths = [], [], [], [], []
            for s in shingle_sets(data, offsets):
                sizes.append(len(s))
                total = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], dtype=np.uint64)
                hi.append(mix(total)[0]), lo.append(mix(total)[1])
                if len(s):
                    values = signature(s, mult, add).astype(np.uint64).reshape(n_bands, band)
                    bands.append(mix((values * spread[None, :band]).sum(axis=1, dtype=np.uint64) ^ salts))
                lengths.append(n_bands if len(s) else 0)
            flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(hi, dtype=np.uint64).view(np.int64)), pa.array(np.array(lo, dtype=np.uint64).view(np.int64)), listed], ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets meet the threshold."""

    def run(batches):
        sets: dict[int, np.ndarray] = {}

        def get(i, text):
            s = sets.get(i)
            if s is None:
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                s = next(shingle_sets(raw, np.array([0, len(raw)])))
                if len(sets) >= 64:
                    sets.pop(next(iter(sets)))
                sets[i] = s
            return s

        for batch in batches:
            keep = []
            ids_a, ids_b, ta, tb = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                x, y = get(ids_a[k].as_py(), ta[k].as_py()), get(ids_b[k].as_py(), tb[k].as_py())
                if min(len(x), len(y)) * 100 < max(len(x), len(y)) * per_cent:
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([ids_a, ids_b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


BUILD, PROBE = 256, 1024
#: Ids of candidates are broadcast up to so many, counted first; beyond, both sides are shuffled.
FEW = 300_000


def remaining_links(scratch: Scratch, pairs: DataFrame, placed: DataFrame, texts: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Links (a, b) between different components of one neighbourhood (documents that candidate pairs connect).

    Members outside a neighbourhood's largest component, in blocks of about BUILD, meet all its members, in blocks of about
    PROBE; a block's sets are indexed and the other documents stream past, so no pair is written unless it is a link.
    """
    around = components(scratch, pairs).withColumnsRenamed({"id": "doc_id", "component": "hood"})
    where = around.join(placed.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "hood", F.coalesce("component", "doc_id").alias("c"))
    where = scratch.table(where, NARROW)
    by_c = where.groupBy("hood", "c").agg(F.count(F.lit(1)).alias("n"))
    hoods = by_c.groupBy("hood").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("m")).where("m > main.n")
    hoods = hoods.select("hood", F.col("main.c").alias("main"), F.ceil((F.col("m") - F.col("main.n")) / BUILD).cast("int").alias("is"), F.ceil(F.col("m") / PROBE).cast("int").alias("js"))
    open_ = scratch.table(where.join(hoods, "hood").join(texts, "doc_id"), 20_000)
    i, j = F.pmod(F.xxhash64("doc_id"), F.col("is")).cast("int"), F.pmod(F.xxhash64("doc_id"), F.col("js")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    build = open_.where("c <> main").select("hood", i.alias("i"), every("js").alias("j"), F.lit(0).alias("role"), "doc_id", "c", "text")
    probe = open_.select("hood", every("is").alias("i"), j.alias("j"), F.lit(1).alias("role"), "doc_id", "c", "text")

    def run(batches):
        key, ids, cs, sets, index = None, [], [], [], None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for hood, i, j, role, doc, c, text in zip(*columns, strict=True):
                if key != (hood, i, j):
                    key, ids, cs, sets, index = (hood, i, j), [], [], [], None
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                s = next(shingle_sets(raw, np.array([0, len(raw)])))
                if role == 0:
                    ids.append(doc), cs.append(c), sets.append(s)
                    continue
                if not ids:
                    continue
                if index is None:
                    size = np.array([len(x) for x in sets])
                    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], own[order], size, np.array(ids), np.array(cs)
                flat, own, size, b_ids, b_cs = index
                lo, hi = np.searchsorted(flat, s, side="left"), np.searchsorted(flat, s, side="right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(own[at], minlength=len(size))
                hit = b_ids[(100 * both >= per_cent * (size + len(s) - both)) & (b_cs != c)].tolist()
                out[0].extend([doc] * len(hit)), out[1].extend(hit)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    rows = build.union(probe).repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j", "role")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row."""
    listed = numbered(docs, scratch)
    if listed is None:
        named = of_ids(docs.where("doc_id is not null"), scratch, per_cent)
    else:
        found = of_ids(listed.select(F.col("number").alias("doc_id"), "text"), scratch, per_cent, (listed,))
        ids = listed.select(F.col("number").alias("component_id"), F.col("doc_id").alias("c"))
        rows = listed.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("id"), "copies")
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
        named = found.join(rows, "doc_id").join(ids, "component_id").select(F.col("id").cast("long").alias("doc_id"), "n_shingles", F.col("c").cast("long").alias("component_id"), every.alias("_row")).drop("_row")
    nameless = sign(docs.where("doc_id is null")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless)


def of_ids(docs: DataFrame, scratch: Scratch, per_cent: int = PER_CENT, held: tuple[DataFrame, ...] = ()) -> DataFrame:
    """near_duplicates of documents with ids that name one text each."""
    signed = scratch.table(sign(docs), 50_000)
    classes = signed.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(classes, NARROW)
    reps = signed.join(classes.where("n > 1").select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"], "left").where("n_shingles > 0 and (rep is null or rep = doc_id)")
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    shared = scratch.table(shared, NARROW)
    pairs = scratch.table(members.join(shared, "band").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), NARROW)
    scratch.drop(shared)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    wanted = wanted.persist()
    few = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    one_text = docs.select("doc_id", "text").join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.length("text")).alias("text"))
    texts = scratch.table(one_text, 20_000)
    wanted.unpersist()
    links = scratch.table(confirm(pairs, texts, per_cent), NARROW)
    first = components(scratch, links)
    late = scratch.table(remaining_links(scratch, pairs, first, texts, per_cent), NARROW)
    found = first if late.isEmpty() else components(scratch, links.union(late))
    scratch.drop(texts)
    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"), "n", "rep")
    changed = of_class.where("n > 1 or component_id <> rep").select("set_hi", "set_lo", "component_id")
    out = signed.join(changed, ["set_hi", "set_lo"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = scratch.table(out, NARROW)
    scratch.keep(out, *held)
    return out


def keep_one(docs: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id.

    Rows without a doc_id stay. Rows that repeat a doc_id and its text are one document and stay or go together; other texts of
    a doc_id are documents of their own, in byte order.
    """
    listed = numbered(docs, scratch)
    if listed is None:
        found = of_ids(docs.where("doc_id is not null"), scratch, per_cent)
        gone = found.where("component_id <> doc_id").select("doc_id").distinct()
        # else all texts are shuffled, as the size of found is taken for that of the few that go
        return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, "doc_id", "left_anti")
    found = of_ids(listed.select(F.col("number").alias("doc_id"), "text"), scratch, per_cent, (listed,))
    gone = listed.join(found.where("component_id <> doc_id").select(F.col("doc_id").alias("number")), "number")
    gone = gone.select(F.struct("doc_id", "text").alias("key")).distinct()
    own = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", "text").alias("key"))
    return own.join(gone, "key", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (
  WITH RECURSIVE r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
  SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, reach.c AS component_id, reach.c = n.doc_id AS kept FROM n JOIN reach ON reach.id = n.doc_id
"""
