"""Queries on titles, families, feeds and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import money as M
from ..functions import text as X
from ..operators import blocks, catalog, listing, resolve, search, series
from . import tables as T
from .tables import AS_OF, D_SQL, H_SQL, NOW_SQL, O_SQL, P_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------ titles


@query(f"""WITH {P_SQL} SELECT id, capacity_gb AS capacity, CASE WHEN capacity_gb >= 1024 AND capacity_gb % 1024 = 0 THEN (capacity_gb // 1024) || 'TB' ELSE capacity_gb || 'GB' END AS label, 4800 + capacity_gb * 40 AS speed,
CASE WHEN 4800 + capacity_gb * 40 >= 6000 THEN '6000MHz+' WHEN 4800 + capacity_gb * 40 >= 5500 THEN '5600MHz' WHEN 4800 + capacity_gb * 40 >= 5000 THEN '5200MHz' ELSE '4800MHz & below' END AS band,
'CL' || (30 + capacity_gb % 20) AS cl, 'DDR5' AS kind FROM p""")
def title_specs(spark, sf) -> DataFrame:
    t = F.col("title")
    cap, speed = X.total_capacity_gb(t), X.speed_mhz(t)
    return T.products(spark, sf).select("id", cap.alias("capacity"), X.capacity_label(cap).alias("label"), speed.alias("speed"), X.speed_band(speed).alias("band"), X.latency(t).alias("cl"), X.ram_type(t).alias("kind"))


#: A prefix that names a maker or a line, by the part's number.
MARKS = ("Vengeance", "Trident Z5", "FURY Beast", "990 PRO", "BX500", "WD_BLACK", "Lexar", "unknown", "T500", "Silicon Power")
MADE = ("Corsair", "G.Skill", "Kingston", "Samsung", "Crucial", "Western Digital", "Lexar", None, "Crucial", "Silicon Power")


def _list_sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"""WITH {P_SQL} SELECT id, ({_list_sql(MADE)})[id % 10 + 1] AS brand FROM p""")
def brand_rules(spark, sf) -> DataFrame:
    marked = F.concat(F.element_at(X.one_of(MARKS), (F.col("id") % 10 + 1).cast("int")), F.lit(" "), F.col("title"))
    return T.products(spark, sf).select("id", X.brand_of(marked).alias("brand"))


WORDS = ", ".join(f"'{w}'" for w in X.FILLER)
KEPT = f"array_to_string(list_filter(string_split(lower(name), ' '), lambda w: w NOT IN ({WORDS})), ' ')"


@query(f"""WITH {P_SQL} SELECT id, {KEPT} AS signature, 'DDR5|' || (4800 + capacity_gb * 40) || '|CL' || (30 + capacity_gb % 20) || '|dimm' AS invariants,
'ram-' || replace(lower(brand), '#', '-') || '-' || replace({KEPT}, ' ', '-') || '-ddr5-' || (4800 + capacity_gb * 40) || '-cl' || (30 + capacity_gb % 20) || '-dimm' AS key FROM p""")
def line_signature(spark, sf) -> DataFrame:
    """Titles are taken apart once, by all tasks."""
    t, b, c = F.col("title"), F.col("brand"), F.lit("ram")
    p = blocks.spread(T.products(spark, sf).select("id", "brand", "title")).select("id", "brand", X.line_signature(t, b).alias("words"), X.invariants(c, t).alias("facts"))
    return p.select("id", F.array_join(F.filter("words", lambda w: w != F.lower(F.col("brand"))), " ").alias("signature"), F.array_join("facts", "|").alias("invariants"), X.key_of(c, b, F.col("words"), F.col("facts")).alias("key"))


@query(f"""WITH {P_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'CMK' || lpad(CAST(id AS VARCHAR), 6, '0') || 'GX5M2' WHEN id % 3 = 1 THEN 'F5-' || lpad(CAST(id AS VARCHAR), 6, '0') || 'K' END AS mpn FROM p""")
def part_number_parse(spark, sf) -> DataFrame:
    number = F.lpad(F.col("id").cast("string"), 6, "0")
    t = F.col("title")
    named = F.when(F.col("id") % 3 == 0, F.concat(t, F.lit(" (CMK"), number, F.lit("GX5M2)"))).when(F.col("id") % 3 == 1, F.concat(t, F.lit(" F5-"), number, F.lit("K"))).otherwise(F.concat(t, F.lit(" MZ 77E"), number))
    return T.products(spark, sf).select("id", X.part_number(named).alias("mpn"))


@query(f"""WITH {P_SQL} SELECT id, 'Type=DDR5;Capacity=' || capacity_gb || 'GB;Speed=' || (4800 + capacity_gb * 40) || 'MHz;Latency=CL' || (30 + capacity_gb % 20) || ';Brand=' || brand AS rows, capacity_gb || 'GB · DDR5-' || (4800 + capacity_gb * 40) || ' · CL' || (30 + capacity_gb % 20) AS summary FROM p""")
def spec_rows(spark, sf) -> DataFrame:
    rows = X.spec_rows(F.lit("ram"), F.col("title"), F.col("brand"))
    return T.products(spark, sf).select("id", F.array_join(F.transform(rows, lambda r: F.concat(r["label"], F.lit("="), r["value"])), ";").alias("rows"), X.spec_summary(F.lit("ram"), F.col("title")).alias("summary"))




@query(f"""WITH {P_SQL} SELECT id, trim(regexp_replace(lower(brand || ' ' || name || ' ' || capacity_gb || 'GB'), '[^a-z0-9]+', '-', 'g'), '-') || '-' || (4800 + capacity_gb * 40) || 'mhz' AS slug, brand || ' ' || name || ' ' || capacity_gb || 'GB' AS short FROM p""")
def slug_base(spark, sf) -> DataFrame:
    return T.products(spark, sf).select("id", X.slug_of(F.lit("ram"), F.col("title"), F.col("brand")).alias("slug"), X.short_name(F.col("title"), F.col("brand")).alias("short"))


SLUG_SQL = """s AS (SELECT p_partkey AS id, p_type AS category, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS base, p_partkey % 50 = 0 AS kept FROM part),
t AS (SELECT category, list(DISTINCT base || '-2') AS taken FROM s WHERE kept GROUP BY 1),
e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM s WHERE NOT kept),
w AS (SELECT e.category, 0::BIGINT AS r, NULL::BIGINT AS id, ''::VARCHAR AS slug, COALESCE(taken, []::VARCHAR[]) AS taken FROM e LEFT JOIN t ON t.category = e.category WHERE r = 1
  UNION ALL SELECT category, r, id, slug, list_append(taken, slug) FROM (SELECT *, CASE WHEN NOT list_contains(taken, base) THEN base ELSE base || '-' || list_filter(range(2, len(taken) + 3), lambda n: NOT list_contains(taken, base || '-' || n))[1] END AS slug
    FROM (SELECT e.*, w.taken FROM w JOIN e ON e.category = w.category AND e.r = w.r + 1)))"""


@query(f"""WITH RECURSIVE {SLUG_SQL} SELECT id, slug FROM w WHERE r > 0 UNION ALL SELECT id, base || '-2' FROM s WHERE kept""")
def slug_unique(spark, sf) -> DataFrame:
    """Every fiftieth slug is stored, as the second of its base."""
    p = T.products(spark, sf).select("id", "category", X.slugify(F.concat_ws(" ", "brand", "name")).alias("base"), F.when(F.col("id") % 50 == 0, X.slugify(F.concat_ws(" ", "brand", "name", F.lit("2")))).alias("slug"))
    return catalog.unique_slugs(p)


@query(f"""WITH {P_SQL}, g AS (SELECT *, 4800 + capacity_gb * 40 AS s, 30 + capacity_gb % 20 AS l, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY brand, name)),
k AS (SELECT brand, name, count(DISTINCT s) AS ns, count(DISTINCT l) AS nl FROM g GROUP BY 1, 2)
SELECT id, CASE WHEN n = 1 THEN NULL WHEN ns = n THEN s || 'MHz' WHEN nl = n THEN 'CL' || l ELSE right(sku, 4) END AS token FROM g JOIN k ON k.brand = g.brand AND k.name = g.name""")
def disambiguation_tokens(spark, sf) -> DataFrame:
    p = T.products(spark, sf).withColumn("short", F.col("name")).withColumn("name", F.col("title"))
    return catalog.disambiguated(p, ["brand", "short"]).select("id", "token")


@query(f"""WITH {P_SQL}, b AS (SELECT *, brand || ' ' || name || ' ' || capacity_gb || 'GB' AS base, 4800 + capacity_gb * 40 AS s, 30 + capacity_gb % 20 AS l FROM p),
g AS (SELECT *, count(*) OVER (PARTITION BY category, base) AS n FROM b)
SELECT id, base || CASE WHEN n > 1 THEN ' ' || right(sku, 4) ELSE '' END || ' Price Tracker' AS title FROM g""")
def page_titles(spark, sf) -> DataFrame:
    return catalog.page_meta(T.products(spark, sf).withColumn("name", F.col("title")), " Price Tracker")


# ------------------------------------------------------------------------------------------------ families


def _members(spark, sf) -> DataFrame:
    p, h = T.products(spark, sf), T.history(spark, sf)
    s = series.stats(series.daily(h), AS_OF).select(F.col("product_id").alias("id"), F.col("current").alias("price"), "days")
    return p.join(s, "id")


MEMBERS_SQL = f"""{P_SQL}, {H_SQL}, {D_SQL}, s AS (SELECT product_id, arg_max(price, day) AS price, count(*) AS days FROM d GROUP BY 1), m AS (SELECT p.*, s.price, s.days FROM p JOIN s ON s.product_id = p.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family_id, capacity_gb ORDER BY days DESC, sku) AS r FROM m) WHERE r = 1)"""


@query(f"""WITH {P_SQL} SELECT family_id, count(*) AS members, count(DISTINCT capacity_gb) AS capacities FROM p GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT capacity_gb) >= 2""")
def family_members(spark, sf) -> DataFrame:
    return resolve.families(T.products(spark, sf).withColumn("parent", F.lit(None).cast("string")), "family_id").select("family_id", "members", "capacities")


@query(f"""WITH {MEMBERS_SQL} SELECT family_id, capacity_gb, sku, days FROM k""")
def canonical_member(spark, sf) -> DataFrame:
    return resolve.canonical(_members(spark, sf), "days").select("family_id", "capacity_gb", "sku", "days")


@query(f"""WITH {MEMBERS_SQL}, f AS (SELECT family_id FROM k GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT m.id, k.capacity_gb AS cap, k.capacity_gb = m.capacity_gb AS viewing, CASE WHEN k.capacity_gb = m.capacity_gb THEN m.sku ELSE k.sku END AS sku, CASE WHEN k.capacity_gb = m.capacity_gb THEN m.price ELSE k.price END AS price FROM m JOIN f ON f.family_id = m.family_id JOIN k ON k.family_id = m.family_id)
SELECT id, cap, viewing, sku, price, price / cap AS per_gb, row_number() OVER (PARTITION BY id ORDER BY price / cap, cap) = 1 AS best FROM c""")
def capacity_chips(spark, sf) -> DataFrame:
    return resolve.capacity_chips(_members(spark, sf), "days").select("id", "cap", "viewing", "sku", "price", "per_gb", "best")


def _clustered(spark, sf) -> DataFrame:
    """Every seventh part has no parent; titles name no capacity-bound figures, so tier 2 can form."""
    p = T.products(spark, sf)
    parent = F.when((F.col("id") % 7 != 0) & (F.col("id") % 2 == 0), F.concat(F.lit("B"), (F.col("id") % 500).cast("string")))
    title = F.concat_ws(" ", "brand", "name", F.concat(F.col("capacity_gb").cast("string"), F.lit("GB DDR5")))
    return resolve.clustered(p.select("id", F.lit("ram").alias("category"), "brand", title.alias("name"), "capacity_gb", parent.alias("parent")))


@query(f"""WITH {P_SQL}, q AS (SELECT id, capacity_gb, CASE WHEN id % 7 <> 0 AND id % 2 = 0 THEN 'B' || (id % 500) END AS parent, 'ram-' || replace(lower(brand), '#', '-') || '-' || replace({KEPT}, ' ', '-') || '-ddr5-nospeed-nocl-dimm' AS key FROM p),
g1 AS (SELECT parent, count(DISTINCT capacity_gb) AS c FROM q WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
q2 AS (SELECT * FROM q WHERE parent IS NULL OR parent NOT IN (SELECT parent FROM g1)),
g2 AS (SELECT key, count(DISTINCT parent) AS np, count(DISTINCT capacity_gb) AS c FROM q2 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT capacity_gb) >= 2)
SELECT q.id, CASE WHEN g1.c >= 2 THEN 'p-' || lower(q.parent) WHEN g1.parent IS NULL AND g2.np < 2 THEN g2.key END AS family_id, CAST(CASE WHEN g1.c >= 2 THEN 1 WHEN g1.parent IS NULL AND g2.key IS NOT NULL THEN 2 END AS VARCHAR) AS tier,
CASE WHEN g1.parent IS NULL THEN CASE WHEN g2.np >= 2 THEN 'conflict' WHEN g2.np = 1 THEN 'one_parent' WHEN g2.c > 6 THEN 'many_capacities' END END AS flag
FROM q LEFT JOIN g1 ON g1.parent = q.parent LEFT JOIN g2 ON g2.key = q.key""")
def family_tiers(spark, sf) -> DataFrame:
    return _clustered(spark, sf).withColumn("tier", F.col("tier").cast("string"))


NEAR_KEYS = f"""{P_SQL}, k AS (SELECT DISTINCT replace(lower(brand), '#', '-') || '-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS key FROM p), t AS (SELECT key, string_split(key, '-') AS t FROM k)"""


@query(f"""WITH {NEAR_KEYS} SELECT a, b FROM (SELECT x.key AS a, y.key AS b, len(list_filter(x.t, lambda v: NOT list_contains(y.t, v))) AS l, len(list_filter(y.t, lambda v: NOT list_contains(x.t, v))) AS r, abs(len(x.t) - len(y.t)) AS d FROM t x JOIN t y ON x.key < y.key) WHERE d <= 1 AND l <= 1 AND r <= 1 AND l + r >= 1""")
def near_miss_keys(spark, sf) -> DataFrame:
    return resolve.near_misses(T.products(spark, sf).select(X.slugify(F.concat_ws(" ", "brand", "name")).alias("key")))


# ------------------------------------------------------------------------------------------------ offers

RANK_SQL = f"""WITH {O_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN contains(seller, 'S1') THEN 0 ELSE 1 END, CASE WHEN in_stock THEN 0 ELSE 1 END, price, feed_sku) AS rank FROM x)"""


def _ranked(spark, sf) -> DataFrame:
    o = T.offers(spark, sf).select("*", F.lit(None).cast("string").alias("mpn"), F.lit(None).cast("string").alias("our_mpn"), F.lit("").alias("url"))
    return resolve.best_candidate(o, "S1")


@query(f"""{RANK_SQL} SELECT product_id, seller, price, in_stock, feed_sku FROM r WHERE rank = 1""")
def offer_best_pick(spark, sf) -> DataFrame:
    return _ranked(spark, sf).where("rank = 1").select("product_id", "seller", "price", "in_stock", "feed_sku")


@query(f"""{RANK_SQL} SELECT product_id, max(CASE WHEN rank = 1 THEN feed_sku END) AS feed_sku, max(CASE WHEN rank = 1 THEN price END) AS price, COALESCE(string_agg(feed_sku, ',' ORDER BY rank) FILTER (WHERE rank > 1), '') AS competing FROM r GROUP BY 1""")
def competing_offers(spark, sf) -> DataFrame:
    return resolve.competing(_ranked(spark, sf)).select("product_id", "feed_sku", "price", F.array_join("competing", ",").alias("competing"))


@query(f"""WITH {O_SQL}, {H_SQL}, {NOW_SQL}, y AS (SELECT product_id, min(price) AS price, bool_or(in_stock) AS in_stock, seller AS retailer, 1 AS ord FROM x GROUP BY product_id, seller UNION ALL SELECT product_id, price, in_stock, 'own', 0 FROM c)
SELECT product_id, retailer, price, in_stock, CAST(row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN in_stock THEN 0 ELSE 1 END, price NULLS LAST, ord, retailer) AS INTEGER) AS place FROM y""")
def retailer_rows(spark, sf) -> DataFrame:
    own = series.latest(T.history(spark, sf), AS_OF).select("product_id", F.lit("own").alias("retailer"), "price", "in_stock", F.struct(F.lit(0).alias("o"), F.lit("own").alias("r")).alias("ord"))
    o = T.offers(spark, sf).groupBy("product_id", "seller").agg(F.min("price").alias("price"), F.bool_or("in_stock").alias("in_stock"))
    o = o.select("product_id", F.col("seller").alias("retailer"), "price", "in_stock", F.struct(F.lit(1).alias("o"), F.col("seller").alias("r")).alias("ord"))
    return listing.retailer_rows(own.union(o)).select("product_id", "retailer", "price", "in_stock", "place")


def _six_digits(number: Column) -> Column:
    """At least six digits; lpad alone would cut longer numbers, and parts would share one."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def _feed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Products whose titles end in a part number for two of three parts, and a feed of every second part in another form."""
    p = T.products(spark, sf)
    digits = _six_digits(F.col("id"))
    number = F.concat(F.lit("CMK"), digits)
    ours = p.select("id", F.lit("ram").alias("category"), "brand", F.when(F.col("id") % 3 != 0, F.concat("title", F.lit(" ("), number, F.lit(")"))).otherwise(F.col("title")).alias("name"))
    feed = p.where("id % 2 = 0").select(
        F.concat_ws(" ", "title", F.lit("Gaming Memory")).alias("name"), F.when(F.col("id") % 5 != 0, F.lower(F.concat(F.lit("cmk-"), digits))).otherwise("").alias("mpn"),
        F.concat(F.lit("N"), F.col("id").cast("string")).alias("feed_sku"), "brand", F.col("list_price").alias("price"), F.lit("shop").alias("seller"), (F.col("id") % 4 == 0).alias("in_stock"), F.concat(F.lit("https://shop.test/"), F.col("id").cast("string")).alias("url"), F.lit("ram").alias("category"),
    )
    return ours, feed


@query("""SELECT p_partkey AS product_id, 'N' || p_partkey AS feed_sku, CAST(1 AS INTEGER) AS rank FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0""")
def part_number_match(spark, sf) -> DataFrame:
    ours, feed = _feed(spark, sf)
    return resolve.match_by_part_number(ours, feed).select("product_id", "feed_sku", "rank")


@query(f"""WITH o AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, p_size AS size FROM part),
f AS (SELECT *, 'N' || id AS sku, id % 4 = 0 AS in_stock, p_retailprice AS price FROM o JOIN part ON p_partkey = id WHERE id % 2 = 0),
m AS (SELECT o.id AS product_id, f.sku AS feed_sku, row_number() OVER (PARTITION BY o.id ORDER BY CASE WHEN f.in_stock THEN 0 ELSE 1 END, f.price, f.sku) AS rank FROM o JOIN f ON o.size = f.size AND contains(lower(f.brand), lower(o.brand)) AND list_has_all(string_split(lower(f.name), ' '), list_filter(string_split(lower(o.name), ' '), lambda w: w NOT IN ({WORDS}))))
SELECT product_id, feed_sku, CAST(rank AS INTEGER) AS rank FROM m""")
def name_match(spark, sf) -> DataFrame:
    ours, feed = _feed(spark, sf)
    return resolve.match_by_name(ours.withColumn("name", F.regexp_replace("name", r" \(CMK.*", "")), feed).select("product_id", "feed_sku", "rank")


# ------------------------------------------------------------------------------------------------ search

QUERY = "the erth thon"
NORMAL = "regexp_replace(lower(COALESCE(text, '')), '[^a-z0-9\\s]', '', 'g')"
HIT = " AND ".join(f"(contains(s, '{t}') OR contains(c, '{t}'))" for t in QUERY.split())
PLACE = " + ".join(f"(CASE WHEN strpos(s, '{t}') > 0 THEN strpos(s, '{t}') ELSE strpos(c, '{t}') END - 1)" for t in QUERY.split())
INDEX_SQL = f"""i AS (SELECT doc_id, source, lang, text, {NORMAL} AS s FROM documents), j AS (SELECT *, regexp_replace(s, '\\s+', '', 'g') AS c FROM i)"""


_BUILT: dict[tuple[str, str], search.Index] = {}


def _index(spark, sf) -> search.Index:
    """The documents' index, built once a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT or not storage.exists(spark, _BUILT[key].path):
        _BUILT[key] = search.build(_texts(spark, sf), storage.new_path(spark, "search"))
    return _BUILT[key]


def _hits(spark, sf) -> DataFrame:
    return search.found(_index(spark, sf), QUERY)


def _texts(spark, sf) -> DataFrame:
    return T.read(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("name"), F.col("text").alias("search"), F.col("source").alias("brand"), F.when(F.col("lang") == "en", "ram").otherwise("ssd").alias("category"))


@query(f"""WITH {INDEX_SQL} SELECT doc_id FROM j WHERE {HIT}""")
def search_filter(spark, sf) -> DataFrame:
    return _hits(spark, sf).select(F.col("ord").alias("doc_id"))


@query(f"""WITH {INDEX_SQL}, k AS (SELECT doc_id, text, CASE WHEN source IN ('the', 'erth', 'thon') THEN 1000 ELSE 0 END + CASE WHEN starts_with(s, '{QUERY}') THEN 500 WHEN starts_with(s, 'the') THEN 300 ELSE 0 END - ({PLACE}) AS score FROM j WHERE {HIT})
SELECT doc_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY score DESC, length(text), doc_id) AS INTEGER) AS place FROM k ORDER BY score DESC, length(text), doc_id LIMIT 8""")
def search_rank(spark, sf) -> DataFrame:
    return search.ranked(_index(spark, sf), QUERY).select(F.col("ord").alias("doc_id"), F.col("score").cast("int").alias("score"), "place")


MANY_SQL = rf"""{INDEX_SQL}, b AS (SELECT item_id AS query, list_filter(string_split_regex(regexp_replace(lower(array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda t: t <> '') AS tokens FROM benchmark),
m AS (SELECT query, tokens, j.* FROM b, j WHERE len(tokens) > 0 AND len(list_filter(tokens, lambda t: NOT contains(c, t))) = 0),
k AS (SELECT query, doc_id, text, CASE WHEN list_contains(tokens, source) THEN 1000 ELSE 0 END + CASE WHEN starts_with(s, array_to_string(tokens, ' ')) THEN 500 WHEN starts_with(s, tokens[1]) THEN 300 ELSE 0 END
  - list_sum(list_transform(tokens, lambda t: CASE WHEN strpos(s, t) > 0 THEN strpos(s, t) ELSE strpos(c, t) END - 1)) AS score FROM m),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(text), doc_id) AS place FROM k)"""


@query(f"""WITH {MANY_SQL} SELECT query, doc_id, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""")
def search_many(spark, sf) -> DataFrame:
    """The first two words of every benchmark item, all searched at once."""
    words = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    queries = T.read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), search.tokens_of(words).alias("tokens"))
    return search.ranked(_index(spark, sf), queries).select("query", F.col("ord").alias("doc_id"), F.col("score").cast("int").alias("score"), "place")


@query(f"""WITH {INDEX_SQL} SELECT CASE WHEN count(*) FILTER (WHERE lang <> 'en') > count(*) FILTER (WHERE lang = 'en') THEN 'ssd' ELSE 'ram' END AS category FROM j WHERE {HIT}""")
def majority_category(spark, sf) -> DataFrame:
    return listing.majority_category(_hits(spark, sf))


MARKED = ("the", "ththe", "an", "er")


@query(f"""WITH t AS (SELECT doc_id, strpos(lower(COALESCE(text, '')), k) - 1 AS a, strpos(lower(COALESCE(text, '')), k) - 1 + length(k) AS b FROM documents, (SELECT unnest({list(MARKED)}) AS k)),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM t WHERE a >= 0),
i AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, island),
s AS (SELECT doc_id, count(*) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS places FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS INTEGER) AS ranges, COALESCE(places, '') AS places FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def highlight_ranges(spark, sf) -> DataFrame:
    """Where the first places of some tokens lie, touching ones as one range."""
    ranges = X.highlight_ranges(F.coalesce("text", F.lit("")), X.one_of(MARKED)).alias("r")
    return T.read(spark, sf, "documents").select("doc_id", ranges).select("doc_id", F.size("r").alias("ranges"), F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("places"))


# ------------------------------------------------------------------------------------------------ catalog


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem) SELECT l_partkey AS part, l_orderkey AS first_order, l_extendedprice AS price FROM r WHERE r = 1""")
def first_seen_dedupe(spark, sf) -> DataFrame:
    rows = catalog.first_seen(T.read(spark, sf, "lineitem"), "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("first_order"), F.col("l_extendedprice").alias("price"))


def _results(spark, sf) -> DataFrame:
    """Search results made of parts: prices are text, some missing or low, some names of outside drives."""
    p = T.products(spark, sf)
    kind = F.when(F.col("id") % 11 == 0, " Portable SSD").when(F.col("id") % 13 == 0, " Cable").otherwise(" DDR5")
    return p.select(
        F.col("sku").alias("asin"), F.concat("title", kind).alias("name"), F.when(F.col("id") % 13 == 0, "ssd").otherwise("ram").alias("category"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(M.fixed(F.col("list_price") / 50, 2), F.lit(" USD"))).alias("min_price"), F.lit(None).cast("string").alias("price"),
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(M.fixed(F.col("list_price") / 64, 2)).alias("max_price"), F.lit(0).alias("query_idx"), F.col("id").alias("pos"),
    )


FUNNEL_SQL = f"""{P_SQL}, q AS (SELECT id, sku, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(format('{{:.2f}}', list_price / 64) AS DOUBLE) END ELSE CAST(format('{{:.2f}}', list_price / 50) AS DOUBLE) END AS price FROM p),
k AS (SELECT *, CASE WHEN price IS NULL THEN 'noPrice' WHEN price < 15 THEN 'cheap' WHEN id % 11 = 0 THEN 'external' WHEN id % 13 = 0 THEN 'nameFilter' END AS reason FROM q)"""


@query(f"""WITH {FUNNEL_SQL} SELECT reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY 1""")
def reject_funnel(spark, sf) -> DataFrame:
    return catalog.built(_results(spark, sf))[1]


@query(f"""WITH {FUNNEL_SQL} SELECT sku AS asin, price AS amount FROM k WHERE reason IS NULL""")
def catalog_build(spark, sf) -> DataFrame:
    return catalog.built(_results(spark, sf))[0].select("asin", "amount")


@query("""SELECT COALESCE(NULLIF(lang, ''), '(null)') AS value, count(*) AS n FROM documents GROUP BY 1""")
def tally(spark, sf) -> DataFrame:
    return catalog.tally(T.read(spark, sf, "documents"), "lang")


@query("""SELECT doc_id AS id, unnest(list_filter([CASE WHEN source = 'src0' THEN 'no_brand' END, CASE WHEN n_chars < 500 THEN 'no_capacity' END, CASE WHEN lang = 'en' THEN 'no_segment' END], lambda x: x IS NOT NULL)) AS problem FROM documents""")
def data_problems(spark, sf) -> DataFrame:
    d = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") != "src0", F.col("source")).alias("brand"), F.when(F.col("n_chars") >= 500, F.col("n_chars")).alias("capacity_gb"), F.when(F.col("lang") != "en", F.col("lang")).alias("segment"), F.lit(1.0).alias("price"))
    return catalog.problems(d)


HASH_SQL = r"""h AS (SELECT page_id, url, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\?v=\d+', '?v=', 'g'), 'Last updated: [^<]*', 'Last updated: ', 'g'), '"priceValidUntil": "[^"]*"', '"priceValidUntil": ""', 'g'), '"validFrom": "[^"]*"', '"validFrom": ""', 'g')) AS hash FROM pages)"""


@query(f"""WITH {HASH_SQL} SELECT page_id, hash FROM h""")
def content_hash(spark, sf) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", X.content_hash(F.col("html")).alias("hash"))


@query(f"""WITH {HASH_SQL} SELECT CAST(page_id AS VARCHAR) AS url, hash, CASE WHEN page_id % 3 = 0 THEN '2001-01-01' ELSE '2001-06-30' END AS lastmod FROM h""")
def manifest_lastmod(spark, sf) -> DataFrame:
    """A third of the pages are as they were, a third have changed, a third are new."""
    pages = T.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), "html", "page_id")
    was = pages.where("page_id % 3 <> 2").select("url", F.when(F.col("page_id") % 3 == 0, X.content_hash(F.col("html"))).otherwise("old").alias("hash"), F.lit("2001-01-01").alias("lastmod"))
    return catalog.manifest(pages, was, "2001-06-30")


@query("""SELECT min(length(text)) AS shortest, max(length(text)) AS longest, avg(length(text)) AS mean, count(*) FILTER (WHERE length(text) NOT BETWEEN 120 AND 320) AS outside, (SELECT count(*) FROM (SELECT text FROM benchmark GROUP BY 1 HAVING count(*) > 1)) AS shared FROM benchmark""")
def length_report(spark, sf) -> DataFrame:
    r = catalog.length_report(T.read(spark, sf, "benchmark"), "text", 120, 320)
    return r.withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")})


