"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is removed if an earlier line (smaller doc_id, or the same document and a smaller line number) has a set of words with
Jaccard similarity of at least PER_CENT percent. Lines are judged on the input.

Equal word sets form classes (a 64-bit hash of the sorted set, its 64-bit picture and its size); only classes are joined. Words are ordered by rarity: how
often a word's slot (one of SLOTS counters) was hit in the whole corpus, and then by hash, which is one order for all lines.
Two sets with similarity t share a word among the first n - ceil(t n) + 1 of either (prefix filter); for the shorter of the two
n - ceil(2t / (1 + t) n) + 1 suffice. Pairs must also meet the length filter (m >= t n) and the positional filter: from the shared
place on enough words must be left on both sides. Each set has a 64-bit picture in which each word flips one bit, so pictures
differ in no more bits than there are words that one set has alone. What passes is verified on the full sets.

One class that is similar and earlier is enough: candidates are compared with the nearest picture first, with the others only if
that does not suffice. The classes of prefix words that more than HOT classes have first meet two hubs alone, the class of
the most lines and the earliest. Those that are not late by then are joined with all classes of these words. Groups of many
variants thus need about one comparison a member, and no pair is left out.

Words are compared by 64-bit hashes (xxhash64), of which 57 bits enter the order; candidates are joined by 32 bits of it
and then verified.

Defined cases: null and empty texts and lines without words stay as they are; lines are split at \\n; words are
`[^\\x20\\x09-\\x0D]+`, unchanged; rows that repeat a doc_id with the same text are one document (they lose the same lines),
with different texts they are documents of their own, in the order of their texts' hashes; rows with a null doc_id stay
unchanged; columns besides doc_id and text are kept and not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW, Scratch, read

PER_CENT = 85
SLOTS = 1 << 19
#: A prefix word of more classes (in the shorter prefix) is met by its hubs first.
HOT = 64
#: A side of a join is broadcast up to so many narrow rows, counted first; beyond, both sides are shuffled.
FEW = 1_000_000
#: What names a line: its document's id, a hash of the document's text, and its number there. A class is named by its first line.
ID = ("d", "t", "l")
#: What tells a word set: a 64-bit hash of it, its 64-bit picture and its size.
SET = ("h", "bits", "n")


def plain(docs: DataFrame) -> DataFrame:
    """d, t and text of the rows that have lines; white space other than the line's end is a space.

    t tells texts of one id apart; where no id repeats it is 0.
    """
    known, text = docs.where("doc_id is not null and text is not null"), F.col("text")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()  # reads the ids alone
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])
    spaced = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]+", " ")).otherwise(text)
    return known.select(F.col("doc_id").alias("d"), (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("t"), spaced.alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """d, t, l and line of each line of plain() texts."""
    return texts.select("d", "t", F.posexplode(F.split("text", "\n")).alias("l", "line"))


def _split(line: Column) -> Column:
    """Words between single spaces, '' where several meet."""
    return F.split(line, " ")


def slot_tiers(texts: DataFrame, scratch: Scratch) -> Column:
    """One array: for each slot two tiers for each doubling of its hits over all words of texts; SLOTS numbers, whatever the input.

    A subquery's one value: as a literal all its numbers would be spelled out in each plan that the driver keeps.
    """
    # lines don't matter here, so a text is split once
    words = texts.select(F.explode(_split(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    hits = words.groupBy(F.xxhash64("w").bitwiseAND(SLOTS - 1).alias("slot")).count()
    tier = F.coalesce(F.least(F.floor(2 * F.log2(F.col("count").cast("double"))), F.lit(62)), F.lit(0)).cast("tinyint")
    every = texts.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(hits, "slot", "left").select("slot", tier.alias("tier"))
    listed = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "tier"))), lambda x: x["tier"]).alias("tiers"))
    return scratch.table(listed).scalar()


def _hashes(line: Column) -> Column:
    """Distinct word hashes of a line."""
    return F.array_remove(F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _ordered(line: Column, tiers: Column) -> Column:
    """The distinct words of a line, the rarest first, as numbers: tier in the top bits, then the hash."""
    return F.sort_array(F.transform(_hashes(line), lambda h: F.shiftleft(F.coalesce(F.get(tiers, h.bitwiseAND(SLOTS - 1).cast("int")), F.lit(0).cast("tinyint")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(h, 7))))


def _least(n: Column, per_cent: int) -> Column:
    """Smallest overlap that a set of n words needs with any partner: ceil(t n)."""
    return F.floor((n * per_cent + 99) / 100).cast("int")


def classes(texts: DataFrame, tiers: Column, scratch: Scratch, per_cent: int = PER_CENT) -> tuple[DataFrame, DataFrame]:
    """Lines with the id of their word set, and each set once: its first line, how many lines have it, its picture and prefix."""
    # functions on arrays take no subquery, but a column that is one, which Spark puts in its place
    sets = lines_of(texts).select(*ID, "line", tiers.alias("tiers")).select(*ID, _ordered(F.col("line"), F.col("tiers")).alias("s"))
    n = F.size("s")
    prefix = F.transform(F.slice("s", 1, n - _least(n, per_cent) + 1), lambda x: F.pmod(x, F.lit(2**31 - 1)).cast("int"))
    picture = F.expr("aggregate(s, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))")
    # lines without words are left out after the write: a filter on the words would make Spark hash each line twice
    lines = scratch.table(sets.select(*ID, F.xxhash64("s").alias("h"), n.alias("n"), picture.alias("bits"), prefix.alias("prefix")), differ=True).where("n > 0")
    once = lines.groupBy(*SET).agg(F.min(F.struct(*ID)).alias("first"), F.count(F.lit(1)).alias("lines"), F.first("prefix").alias("prefix"))
    return lines, scratch.table(once.select(*SET, "first.*", "lines", "prefix"), differ=True)


def _words(once: DataFrame, per_cent: int) -> DataFrame:
    """A row for each prefix word of a class; short: whether it is in the prefix that suffices for the shorter of two sets."""
    # a pair of n <= m words needs an overlap of t / (1 + t) * (n + m) >= 2t / (1 + t) * n
    n = F.col("n")
    shorter = n - F.floor((n * 2 * per_cent + (100 + per_cent) - 1) / (100 + per_cent)).cast("int") + 1
    words = once.select(*ID, "lines", "n", "bits", F.posexplode("prefix").alias("place", "w"))
    return words.withColumn("short", F.col("place") < shorter)


def _side(words: DataFrame, mark: str) -> DataFrame:
    return words.select("w", *[F.col(c).alias(mark + c) for c in (*ID, "n", "bits", "place", "open")])


def _pairs(a: DataFrame, b: DataFrame, per_cent: int, by_size: bool = True) -> DataFrame:
    """(early, late, far) of what meets in a word, passes the filters and has an open late side; far: bits in which their pictures differ.

    by_size: a holds the shorter set of each pair.
    """
    c = F.col
    first, second, total = F.struct(*["a" + x for x in ID]), F.struct(*["b" + x for x in ID]), c("an") + c("bn")
    meets = F.least(c("an") - c("aplace"), c("bn") - c("bplace")) * (100 + per_cent) >= total * per_cent
    meets = meets & (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * per_cent)
    # words that one set has alone number (1 - t) / (1 + t) * (n + m) at most, and each bit that differs needs one
    far = F.bit_count(c("abits").bitwiseXOR(c("bbits")))
    meets = meets & (far * (100 + per_cent) <= total * (100 - per_cent))
    if by_size:
        meets = meets & ((c("an") < c("bn")) | ((c("an") == c("bn")) & (first < second)))
    meets = meets & (((first < second) & c("bopen")) | ((second < first) & c("aopen")))
    joined = _side(a, "a").join(_side(b, "b"), "w").where(meets)
    plain = lambda x, mark: F.struct(*[x[mark + k].alias(k) for k in ID])
    a_is, b_is = plain(joined, "a"), plain(joined, "b")
    return joined.select(F.least(a_is, b_is).alias("early"), F.greatest(a_is, b_is).alias("late"), far.alias("far"))


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= FEW else df


def sets_of(texts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """id and s, the word set, of the lines in wanted (d, t, l); read again from the texts."""
    named = scratch.table(wanted, NARROW)
    some = texts.join(few(named.select("d").distinct()), "d", "left_semi")
    found = lines_of(some).join(few(named), list(ID)).dropDuplicates(list(ID))
    sets = scratch.table(found.select(F.struct(*ID).alias("id"), _hashes(F.col("line")).alias("s")), 20_000)
    scratch.drop(named)
    return sets


def similar(pairs: DataFrame, sets: DataFrame, scratch: Scratch, per_cent: int) -> DataFrame:
    """d, t, l of the late side of those of pairs (early, late) whose sets meet the threshold."""
    both = pairs.join(sets.withColumnsRenamed({"id": "early", "s": "sa"}), "early").join(sets.withColumnsRenamed({"id": "late", "s": "sb"}), "late")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * per_cent).select("late.*").distinct()
    return scratch.table(found, NARROW)


def verified(texts: DataFrame, pairs: DataFrame, scratch: Scratch, per_cent: int) -> DataFrame:
    """d, t, l of the late sides that one of their pairs (early, late, far) confirms: the nearest one first, the others where it does not."""
    ends = pairs.select("early.*").union(pairs.select("late.*")).distinct()
    sets = sets_of(texts, ends, scratch)
    nearest = pairs.groupBy("late").agg(F.min(F.struct("far", "early")).alias("x")).select("x.early", "late")
    found = similar(nearest, sets, scratch, per_cent)
    rest = pairs.select("early", "late").join(found.select(F.struct(*ID).alias("late")), "late", "left_anti").join(nearest, ["early", "late"], "left_anti")
    found = found.union(similar(rest, sets, scratch, per_cent))
    return found


def hubs_of(members: DataFrame) -> DataFrame:
    """Of each word's classes the one of the most lines and the earliest."""
    own = F.struct(*ID, "n", "bits", "place", "open")
    best = members.groupBy("w").agg(F.max(F.struct(F.col("lines").alias("most"), own.alias("x"))).alias("large"), F.min(own).alias("early"))
    return best.select("w", F.explode(F.array("large.x", "early")).alias("x")).select("w", "x.*").distinct()


def late_classes(texts: DataFrame, once: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """d, t, l of each class that is similar to one with an earlier first line."""
    words = _words(once, per_cent).withColumn("open", F.lit(True))
    hot = scratch.table(words.where("short").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("w"), NARROW)
    nearest = lambda pairs: pairs.groupBy("early", "late").agg(F.min("far").alias("far"))
    if hot.isEmpty():
        return verified(texts, scratch.table(nearest(_pairs(words.where("short"), words, per_cent)), NARROW), scratch, per_cent)
    hot = few(hot)
    members, words = scratch.table(words.join(hot, "w"), NARROW), words.join(hot, "w", "left_anti")
    hubs = scratch.table(hubs_of(members), NARROW)
    pairs = _pairs(words.where("short"), words, per_cent).union(_pairs(members, hubs, per_cent, by_size=False))
    pairs = scratch.table(nearest(pairs), NARROW)
    found = verified(texts, pairs, scratch, per_cent)
    # what is late already is not asked about: of the frequent words only pairs with an open side are looked at
    members = members.drop("open").join(few(found).withColumn("closed", F.lit(True)), list(ID), "left").withColumn("open", F.col("closed").isNull())
    members = scratch.table(members, NARROW)
    more = _pairs(members.where("short and open"), members, per_cent).union(_pairs(members.where("short and not open"), members.where("open"), per_cent))
    more = scratch.table(nearest(more).join(pairs.select("early", "late"), ["early", "late"], "left_anti"), NARROW)
    return found if more.isEmpty() else found.union(verified(texts, more, scratch, per_cent))


def removed_lines(docs: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """d, t, gone: for each document the sorted numbers (from 0) of its lines that repeat an earlier line: of each class all but the first, and the first too if its class is late."""
    texts = plain(docs)
    lines, once = classes(texts, slot_tiers(texts, scratch), scratch, per_cent)
    late = scratch.table(late_classes(texts, once, scratch, per_cent).withColumn("late", F.lit(True)), NARROW)
    judged = once.join(late, list(ID), "left").where("lines > 1 or late").select(*SET, F.struct(*ID).alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    gone = lines.select(*SET, *ID).join(judged, list(SET)).where(F.col("late") | (F.struct(*ID) != F.col("first")))
    out = scratch.table(gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("l")).alias("gone")), NARROW)
    scratch.keep(out)
    return out


def with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, h: the text's hash, and others) with gone, null where no line goes."""
    same = (rows["doc_id"] == gone["d"]) & ((gone["t"] == 0) | (gone["t"] == rows["h"]))
    return rows.join(few(gone), same, "left").drop("d", "t")


def dedup_lines(docs: DataFrame, scratch: Scratch, per_cent: int = PER_CENT) -> DataFrame:
    """docs without the removed lines; other columns as they are."""
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct("*").alias("doc"))
    left = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left)
    return with_gone(own, removed_lines(docs, scratch, per_cent)).select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of removed lines, comma-separated) of each document."""
    docs = read(spark, sf_dir, "documents")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = with_gone(rows, removed_lines(docs, Scratch(spark)))
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, list_distinct(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+')) AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, line_no, list_sort(s) AS s FROM l WHERE len(s) > 0),
k AS (SELECT s, len(s) AS n, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY s) AS id FROM c GROUP BY s),
f AS (SELECT w, count(*) AS f FROM (SELECT unnest(s) AS w FROM k) GROUP BY w),
t AS (SELECT id, n, k.w, row_number() OVER (PARTITION BY id ORDER BY f, k.w) AS p FROM (SELECT id, n, unnest(s) AS w FROM k) k JOIN f ON f.w = k.w),
x AS (SELECT id, n, w FROM t WHERE p <= n - (n * 85 + 99) // 100 + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85),
m AS (SELECT p.a, p.b, len(list_intersect(x.s, y.s)) AS m, x.n AS na, y.n AS nb, x.first AS fa, y.first AS fb FROM p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b),
g AS (SELECT * FROM m WHERE m * 100 >= (na + nb - m) * 85),
e AS (SELECT id, min(first) AS early FROM (SELECT id, first FROM k UNION ALL SELECT a, fb FROM g UNION ALL SELECT b, fa FROM g) GROUP BY id),
r AS (SELECT c.doc_id, c.line_no FROM c JOIN k ON k.s = c.s JOIN e ON e.id = k.id WHERE (c.doc_id, c.line_no) > e.early),
a AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, COALESCE(a.n_removed, 0) AS n_removed, COALESCE(a.removed, '') AS removed
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
