"""Queries on titles of all kinds, links, texts of figures, reports, feeds and their matches to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import money as M
from ..functions import text as X
from ..operators import catalog, resolve, series
from ..sources import feeds
from . import tables as T
from .entities import HASH_SQL, WORDS, _feed
from .tables import H_SQL, P_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------ drives and memory

#: What follows brand, name and capacity in a title, by the part's number, with the facts it states: category, segment, protocol,
#: form, PCIe generation, heatsink, and for memory generation, speed, latency and form.
KINDS = (
    ("NVMe M.2 2280 PCIe Gen4 SSD with Heatsink", "ssd", "nvme_ssd", "NVMe", "M.2", "g4", "hs", None, None, None),
    ("SATA III 2.5 inch Internal SSD", "ssd", "sata_ssd", "SATA", '2.5"', "", "", None, None, None),
    ("M.2 SATA Solid State Drive SSD", "ssd", "sata_ssd", "SATA", "M.2", "", "", None, None, None),
    ("PCIe 5.0 M.2 SSD without Heatsink", "ssd", "nvme_ssd", "NVMe", "M.2", "g5", "", None, None, None),
    ("Gen3 Solid State Drive", "ssd", None, None, None, "g3", "", None, None, None),
    ("DDR4-3200 CL16 Laptop Memory", "ram", "ddr4", None, None, None, None, "DDR4", 3200, "CL16"),
    ("DDR5 6000MHz Desktop Memory", "ram", "ddr5", None, None, None, None, "DDR5", 6000, None),
)
_COLUMNS = ("category", "segment", "protocol", "form", "generation", "heatsink", "ram", "speed", "latency")


def _kinds(spark, sf) -> DataFrame:
    """id, brand, category and a title of one of KINDS; every third capacity is in TB."""
    p = T.products(spark, sf)
    kind = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in KINDS]), (F.col("id") % len(KINDS) + 1).cast("int"))
    size = F.when(F.col("id") % 3 == 0, F.concat((F.col("capacity_gb") % 4 + 1).cast("string"), F.lit("TB"))).otherwise(F.concat(F.col("capacity_gb").cast("string"), F.lit(" GB")))
    return p.select("id", "brand", kind(1).alias("category"), F.concat_ws(" ", "brand", "name", size, kind(0)).alias("title"))


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


def _fact(name: str) -> str:
    k = _COLUMNS.index(name) + 1
    return f"CASE p_partkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {_sql(x[k])}" for i, x in enumerate(KINDS)) + " END"


K_SQL = f"""kinds AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, {", ".join(f"{_fact(c)} AS {c}" for c in _COLUMNS)},
  CASE WHEN p_partkey % 3 = 0 THEN (p_size % 4 + 1) * 1024 ELSE p_size END AS gb, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 4 + 1) || 'TB' ELSE p_size || 'GB' END AS label FROM part)"""


@query(f"""WITH {K_SQL} SELECT id, category, segment, CASE WHEN category = 'ssd' THEN protocol END AS protocol, CASE WHEN category = 'ssd' THEN form END AS form, CASE WHEN category = 'ssd' THEN generation END AS generation,
CASE WHEN category = 'ssd' THEN heatsink END AS heatsink, gb, label FROM kinds""")
def drive_facts(spark, sf) -> DataFrame:
    t, ssd = F.col("title"), F.col("category") == "ssd"
    gb = X.total_capacity_gb(t)
    facts = {"protocol": X.ssd_type(t), "form": X.form_factor(t), "generation": X.pcie_generation(t), "heatsink": X.heatsink(t)}
    return _kinds(spark, sf).select("id", "category", X.segment(F.col("category"), t).alias("segment"), *[F.when(ssd, v).alias(k) for k, v in facts.items()], gb.alias("gb"), X.capacity_label(gb).alias("label"))


@query(f"""WITH {K_SQL} SELECT id, CASE WHEN category = 'ram' THEN ram || '|' || speed || '|' || COALESCE(latency, 'nocl') || '|' || CASE WHEN speed = 3200 THEN 'sodimm' ELSE 'dimm' END
ELSE COALESCE(protocol, 'noproto') || '|' || COALESCE(form, 'noform') || '|' || CASE generation WHEN '' THEN 'nogen' ELSE generation END || '|' || CASE heatsink WHEN '' THEN 'nohs' ELSE heatsink END END AS invariants FROM kinds""")
def line_invariants(spark, sf) -> DataFrame:
    return _kinds(spark, sf).select("id", F.array_join(X.invariants(F.col("category"), F.col("title")), "|").alias("invariants"))


@query(f"""WITH {K_SQL} SELECT id, concat_ws('; ', 'Type=' || CASE WHEN category = 'ram' THEN ram ELSE protocol END, 'Capacity=' || label, 'Speed=' || speed || 'MHz', CASE WHEN category = 'ram' THEN 'Latency=' || latency ELSE 'Form Factor=' || form END, 'Brand=' || brand) AS facts,
concat_ws(' · ', label, CASE WHEN category = 'ram' THEN ram || '-' || speed ELSE protocol END, CASE WHEN category = 'ram' THEN latency ELSE form END) AS summary FROM kinds""")
def spec_sheet(spark, sf) -> DataFrame:
    c, t = F.col("category"), F.col("title")
    rows = F.array_join(F.transform(X.spec_rows(c, t, F.col("brand")), lambda x: F.concat(x["label"], F.lit("="), x["value"])), "; ")
    return _kinds(spark, sf).select("id", rows.alias("facts"), X.spec_summary(c, t).alias("summary"))


@query(f"""WITH {K_SQL}, f AS (SELECT category, segment, protocol, form, ram FROM kinds) SELECT category, segment, count(*) AS n FROM f GROUP BY category, segment""")
def segment_sizes(spark, sf) -> DataFrame:
    return _kinds(spark, sf).groupBy("category", X.segment(F.col("category"), F.col("title")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------ links and markup


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS in_xml FROM pages""")
def escaped_pages(spark, sf) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", X.escaped(F.col("html")).alias("escaped"), X.escaped_xml(F.col("url")).alias("in_xml"))


@query("""WITH u AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '?q=' || page_id ELSE '' END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '#' ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'tag=shop-20' END AS tagged,
'https://click.test/deep?id=A1&mid=' || '77' || '&murl=' || replace(replace(replace(replace(replace(url_encode(url || ' (a''b)*!'), '%28', '('), '%29', ')'), '%27', ''''), '%2A', '*'), '%21', '!') AS deep FROM u""")
def tagged_links(spark, sf) -> DataFrame:
    u = T.read(spark, sf, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?q="), F.col("page_id").cast("string"))).otherwise("")).alias("url"))
    deep = X.deep_link(F.concat("url", F.lit(" (a'b)*!")), F.lit("A1"), "77", "https://click.test/deep")
    return u.select("page_id", X.with_tag(F.when(F.col("page_id") % 5 != 0, F.col("url")), "shop-20").alias("tagged"), deep.alias("deep"))


@query("""SELECT p_partkey AS id, 'https://img.test/I/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '._AC_SL1200_.jpg' WHEN 1 THEN '._AC_SL1200_.png' ELSE '._XY_.jpg' END AS image FROM part""")
def large_images(spark, sf) -> DataFrame:
    end = F.element_at(F.array(F.lit("._AC_UL320_.jpg"), F.lit("._AC_SX300_SY300_.png"), F.lit("._XY_.jpg")), (F.col("id") % 3 + 1).cast("int"))
    return T.products(spark, sf).select("id", X.large_image(F.concat(F.lit("https://img.test/I/"), F.col("id").cast("string"), end)).alias("image"))


@query("""SELECT o_orderkey AS id, o_orderkey % 4 IN (0, 1) AS is_token FROM orders""")
def token_shapes(spark, sf) -> DataFrame:
    """Hashes of 64 digits are tokens; upper-case ones and those a digit short are not."""
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    token = F.when(F.col("id") % 4 == 2, F.concat(F.lit("G"), F.substring("h", 2, 63))).when(F.col("id") % 4 == 3, F.substring("h", 1, 63)).otherwise(F.col("h"))
    return o.select("id", X.is_token(token).alias("is_token"))


# ------------------------------------------------------------------------------------------------ figures


@query("""SELECT event_id, CAST(floor((epoch_ms(ts) - 1293840000000) / 60000) AS BIGINT) AS minutes, date_trunc('minute', ts) AS back FROM events""")
def provider_minutes(spark, sf) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    # the way back is that of the minute the event lies in, though its last half millisecond counts as the next one
    back = M.minutes_to_timestamp(M.timestamp_to_minutes(F.date_trunc("minute", t)))
    return T.read(spark, sf, "events").select("event_id", M.timestamp_to_minutes(t).alias("minutes"), back.cast("timestamp_ntz").alias("back"))


@query("""SELECT p_partkey AS id, greatest(1, CAST(floor(p_retailprice * 0.9::DOUBLE) AS BIGINT)) AS prefill, '$' || CASE WHEN p_retailprice / (p_size * 37.3::DOUBLE) >= 1 THEN printf('%.2f', p_retailprice / (p_size * 37.3::DOUBLE)) ELSE printf('%.3f', p_retailprice / (p_size * 37.3::DOUBLE)) END || '/GB' AS per_gb,
CASE WHEN p_retailprice >= 1200 THEN '+' ELSE '' END || printf('%.1f', p_retailprice - 1200) || '%' AS pulse FROM part""")
def price_texts(spark, sf) -> DataFrame:
    price = F.col("list_price")
    return T.products(spark, sf).select("id", M.alert_prefill(price).cast("long").alias("prefill"), M.per_gb(price / (F.col("capacity_gb") * 37.3)).alias("per_gb"), M.pulse_text(price - 1200).alias("pulse"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'average since tracking began (' || strftime(o_orderdate, '%B %-d, %Y') || ')' ELSE '90-day average' END AS label, strftime(o_orderdate, '%b %Y') AS month FROM orders""")
def average_labels(spark, sf) -> DataFrame:
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), M.average_label(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("label"), M.month_year(F.col("o_orderdate")).alias("month"))


# ------------------------------------------------------------------------------------------------ reports


@query(f"""WITH {H_SQL}, r AS (SELECT product_id, o, n, e, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at, o, n, e) AS k, count(*) OVER (PARTITION BY product_id) AS n_rows FROM h)
SELECT product_id, CAST(k AS INTEGER) AS place, greatest(n_rows - 10, 0) AS omitted FROM r WHERE k <= 5 OR k > n_rows - 5""")
def history_sample(spark, sf) -> DataFrame:
    return series.head_tail(T.history(spark, sf), "product_id", "fetched_at", "id").select("product_id", "place", "omitted")


@query(f"""WITH {P_SQL}, n AS (SELECT *, CASE WHEN id % 11 = 0 THEN NULL ELSE capacity_gb END AS cap, count(*) OVER (PARTITION BY family_id) AS members FROM p)
SELECT CASE WHEN cap IS NULL THEN 'unparseable capacity' ELSE 'no key match or shared parent' END AS reason, count(*) AS n FROM n WHERE members = 1 GROUP BY 1""")
def singleton_reasons(spark, sf) -> DataFrame:
    p = T.products(spark, sf).select("id", "family_id", F.col("title").alias("name"), "brand", F.when(F.col("id") % 11 != 0, F.col("capacity_gb")).alias("capacity_gb"))
    return resolve.singleton_reasons(p)


@query("""SELECT url AS loc, CAST('2024-01-0' || (1 + page_id % 3) AS DATE) AS lastmod, NULL AS changefreq, CAST(NULL AS DOUBLE) AS priority FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT 'https://shop.test/ram/' || p_partkey || '/', DATE '2024-02-01', 'daily', 0.6::DOUBLE FROM part""")
def sitemap_rows(spark, sf) -> DataFrame:
    """Static pages with the dates of their contents, then product pages; product pages of an old sitemap are left out."""
    pages, loc = T.read(spark, sf, "pages"), F.concat(F.lit("https://shop.test/ram/"), F.col("p_partkey").cast("string"), F.lit("/"))
    old = pages.select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://shop.test/ssd/"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.col("url")).alias("loc"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int")).alias("lastmod"))
    made = T.read(spark, sf, "part").select(loc.alias("loc"), F.lit("2024-02-01").cast("date").alias("lastmod"))
    return catalog.sitemap_entries(old, made, "^https://shop\\.test/(ram|ssd)/.+/$")


# ------------------------------------------------------------------------------------------------ feeds

FEED_SQL = """SELECT 'N' || p_partkey AS feed_sku, p_brand || ' "' || p_name || '"' AS name, p_retailprice AS price, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS in_stock FROM part WHERE p_partkey % 7 <> 0"""


def _rows(spark, sf) -> DataFrame:
    """Rows of a shop's feed as it would write them; every seventh has no link."""
    price = F.format_string("$%,.2f", F.col("list_price"))
    stock = F.element_at(F.array(F.lit("In Stock"), F.lit("no"), F.lit("ask")), (F.col("id") % 3 + 1).cast("int"))
    link = F.when(F.col("id") % 7 != 0, F.concat(F.lit("https://shop.test/"), F.col("id").cast("string"))).otherwise("")
    return T.products(spark, sf).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("n"), F.concat("brand", F.lit(' "'), "name", F.lit('"')).alias("title"), price.alias("price"), link.alias("link"), stock.alias("stock"))


def _landed(spark, lines: DataFrame) -> str:
    """lines (value) as text files in the folder that all tasks share."""
    path = storage.new_path(spark, "feed")
    lines.write.text(path)
    return path


@query(FEED_SQL)
def feed_delimited(spark, sf) -> DataFrame:
    """A feed written with semicolons and quotes, in as many files as there are tasks, each with the header, and read again."""
    path = storage.new_path(spark, "feed")
    _rows(spark, sf).toDF("Item #", "Product Name", "Sale Price", "Product URL", "Availability").write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(path)
    return feeds.load_feed(spark, path).select("feed_sku", "name", "price", "in_stock")


@query(FEED_SQL)
def feed_xml(spark, sf) -> DataFrame:
    """The same feed as XML with character data sections."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}><![CDATA["), F.col(c), F.lit(f"]]></{name}>"))
    record = F.concat(F.lit("<Item>"), tag("ItemNumber", "n"), tag("Title", "title"), tag("FinalPrice", "price"), tag("Link", "link"), tag("Stock", "stock"), F.lit("</Item>"))
    return feeds.load_feed(spark, _landed(spark, _rows(spark, sf).select(record.alias("value")))).select("feed_sku", "name", "price", "in_stock")


M_SQL = f"""o AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, p_size AS size FROM part),
f AS (SELECT *, 'N' || id AS sku, id % 4 = 0 AS in_stock, p_retailprice AS price FROM o JOIN part ON p_partkey = id WHERE id % 2 = 0),
m AS (SELECT o.id AS product_id, f.sku AS feed_sku, row_number() OVER (PARTITION BY o.id ORDER BY CASE WHEN f.in_stock THEN 0 ELSE 1 END, f.price, f.sku) AS rank FROM o JOIN f ON o.size = f.size AND contains(lower(f.brand), lower(o.brand)) AND list_has_all(string_split(lower(f.name), ' '), list_filter(string_split(lower(o.name), ' '), lambda w: w NOT IN ({WORDS})))),
x AS (SELECT id AS product_id, 'N' || id AS feed_sku, 'mpn' AS method, TRUE AS accepted FROM o WHERE id % 6 IN (2, 4) AND id % 5 <> 0
  UNION ALL SELECT product_id, feed_sku, 'name', substr(feed_sku, 2) = CAST(product_id AS VARCHAR) FROM m WHERE rank = 1 AND NOT (product_id % 6 IN (2, 4) AND product_id % 5 <> 0))"""


def _matched(spark, sf) -> DataFrame:
    """Part numbers first, then names; a name match is accepted where it is the product's own feed row."""
    ours, feed = _feed(spark, sf)
    ours = ours.withColumn("name", F.when(F.col("id") % 3 == 0, F.regexp_replace("name", r" \(CMK.*", "")).otherwise(F.col("name")))
    accepted = ours.select(F.col("id").alias("product_id"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("feed_sku"))
    return resolve.matched_offers(ours, feed, accepted)


@query(f"WITH {M_SQL} SELECT * FROM x")
def matched_offers(spark, sf) -> DataFrame:
    return _matched(spark, sf).select("product_id", "feed_sku", "method", "accepted")


@query(f"WITH {M_SQL} SELECT p_partkey AS id, x.feed_sku, x.method FROM part LEFT JOIN x ON x.product_id = p_partkey AND x.accepted")
def page_offers(spark, sf) -> DataFrame:
    """Each product's page with the accepted offer of the other shop, if there is one."""
    offers = _matched(spark, sf).where("accepted").select(F.col("product_id").alias("id"), "feed_sku", "method")
    return T.products(spark, sf).select("id").join(offers, "id", "left")


# ------------------------------------------------------------------------------------------------ harvests and rows of the database

C_SQL = """j AS (SELECT l_orderkey AS job, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber * 2 AS VARCHAR) ELSE 'n/a' END AS free, CASE WHEN l_linenumber % 3 = 0 THEN '1.5' END AS paid FROM lineitem),
c AS (SELECT job AS query_idx, COALESCE(arg_max(TRY_CAST(free AS DOUBLE), pos) FILTER (WHERE TRY_CAST(free AS DOUBLE) IS NOT NULL), 0) AS free_credits, COALESCE(arg_max(TRY_CAST(paid AS DOUBLE), pos) FILTER (WHERE paid IS NOT NULL), 0) AS paid_credits FROM j GROUP BY job)"""


def _credits(spark, sf) -> DataFrame:
    n = F.col("l_linenumber")
    free, paid = F.when(n % 2 == 1, (n * 2).cast("string")).otherwise("n/a"), F.when(n % 3 == 0, "1.5")
    return feeds.job_credits(T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_idx"), n.alias("pos"), free.alias("free_credits"), paid.alias("paid_credits")))


@query(f"WITH {C_SQL} SELECT * FROM c")
def job_credits(spark, sf) -> DataFrame:
    return _credits(spark, sf)


@query(f"WITH {C_SQL} SELECT count(*) FILTER (WHERE query_idx % 5 <> 0) AS ok, count(*) FILTER (WHERE query_idx % 5 = 0) AS failed, sum(free_credits) FILTER (WHERE query_idx % 5 <> 0) AS free_credits, sum(paid_credits) FILTER (WHERE query_idx % 5 <> 0) AS paid_credits FROM c")
def job_report(spark, sf) -> DataFrame:
    return feeds.job_report(_credits(spark, sf).withColumn("error", F.when(F.col("query_idx") % 5 == 0, "timeout")))


@query("""SELECT 'P' || p_partkey AS sku, NULLIF(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, '') AS brand, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE 'shop' END AS retailer FROM part""")
def database_rows(spark, sf) -> DataFrame:
    p = T.read(spark, sf, "part")
    rows = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 == 0, "other").otherwise("").alias("retailer"), F.lit("x").alias("unused"))
    return feeds.database_rows(rows, ["sku", "brand", "price", "retailer"], "shop")


@query(f"""WITH {HASH_SQL} SELECT pages.url, html AS payload, hash FROM pages JOIN h ON h.page_id = pages.page_id""")
def page_rows(spark, sf) -> DataFrame:
    """Every page as a row of url, payload and the hash of what doesn't change from build to build."""
    return catalog.page_rows(T.read(spark, sf, "pages"))
