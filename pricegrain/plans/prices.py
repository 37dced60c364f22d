"""Queries on prices, series and segments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import money as M
from ..operators import catalog, listing, market, merges, series
from ..streaming import jobs, pulse
from . import tables as T
from .tables import AS_OF, D_SQL, H_SQL, NOW_SQL, P_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


BASELINE = (datetime(2001, 1, 1), datetime(2000, 12, 17), datetime(2001, 1, 16))
NEAR_SQL = """b AS (SELECT product_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY abs(epoch_us(fetched_at) - epoch_us(TIMESTAMP '2001-01-01')), fetched_at, o, n, e) AS r FROM h
  WHERE fetched_at BETWEEN TIMESTAMP '2000-12-17' AND TIMESTAMP '2001-01-16') WHERE r = 1)"""


@query(f"""WITH {P_SQL}, {H_SQL}, {NOW_SQL}, {NEAR_SQL},
m AS (SELECT segment, median(c.price) AS c, median(b.price) AS b, count(*) AS n FROM p JOIN c ON c.product_id = p.id JOIN b ON b.product_id = p.id GROUP BY segment)
SELECT s.segment, floor(m.c * 100 + 0.5) / 100 AS current_avg_price, floor(m.b * 100 + 0.5) / 100 AS baseline_avg_price, floor((m.c - m.b) / m.b * 100 * 10 + 0.5) / 10 AS pct_change, COALESCE(m.n, 0) AS product_count
FROM (SELECT DISTINCT segment FROM p) s LEFT JOIN m ON m.segment = s.segment""")
def market_pulse(spark, sf) -> DataFrame:
    p, h = T.products(spark, sf), T.history(spark, sf)
    return market.market_pulse(p, series.latest(h, AS_OF), series.nearest(h, *BASELINE), p.select("segment").distinct())


@query(SQL["market_pulse"])
def pulse_kept(spark, sf) -> DataFrame:
    """market_pulse from counters that a stream keeps: the history lands in two parts, and each run goes on where the one before ended."""
    h, p, folder = T.history(spark, sf), T.products(spark, sf), storage.new_path(spark, "pulse")
    # one number that orders as (order, line, price in cents) does: 24 bits hold a line's price, 3 its number
    order = F.shiftleft(F.shiftleft(F.col("id.l_orderkey").cast("long"), 3) + F.col("id.l_linenumber"), 24) + F.round(F.col("id.l_extendedprice") * 100).cast("long")
    rows = h.join(p.select(F.col("id").alias("product_id"), "segment"), "product_id").select("product_id", "segment", "price", "fetched_at", order.alias("id"))
    table = merges.Table(spark, f"{folder}/counters").create(spark.createDataFrame([], pulse.COUNTERS), pulse.KEYS)
    jobs.with_state_store(spark)
    since = None
    for until in (BASELINE[0], AS_OF):
        part = rows.where(F.col("fetched_at") <= F.lit(until)) if since is None else rows.where((F.col("fetched_at") > F.lit(since)) & (F.col("fetched_at") <= F.lit(until)))
        tick = spark.createDataFrame([(-1, None, None, until, -1)], rows.schema)
        part.union(tick).write.mode("append").parquet(f"{folder}/landed")
        changes = pulse.price_changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/landed"))
        pulse.keep_counters(changes, table, f"{folder}/checkpoint").awaitTermination()
        since = until
    return pulse.pulse(table.read(), p.select("segment").distinct())


@query("""SELECT p_type AS category, count(*) FILTER (WHERE p_size > 40) AS excluded, count(*) AS products FROM part GROUP BY 1""")
def segment_exclusions(spark, sf) -> DataFrame:
    """Products above 40 GB count as outside all segments."""
    p = T.products(spark, sf).withColumn("segment", F.when(F.col("capacity_gb") <= 40, F.col("segment")))
    return market.excluded(p)


@query(f"""WITH {H_SQL} SELECT product_id, price, in_stock, strftime(fetched_at, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, o, n, e) AS r FROM h) WHERE r = 1""")
def latest_price(spark, sf) -> DataFrame:
    return series.latest(T.history(spark, sf)).select("product_id", "price", "in_stock", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {H_SQL}, {NOW_SQL} SELECT product_id, price, in_stock, strftime(fetched_at, '%Y-%m-%d') AS day FROM c""")
def latest_before_as_of(spark, sf) -> DataFrame:
    return series.latest(T.history(spark, sf), AS_OF).select("product_id", "price", "in_stock", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {H_SQL}, {NEAR_SQL} SELECT product_id, price FROM b""")
def nearest_baseline_exact(spark, sf) -> DataFrame:
    return series.nearest(T.history(spark, sf), *BASELINE).select("product_id", "price")


STATS_SQL = f"""{H_SQL}, {D_SQL},
w AS (SELECT product_id, min((abs(epoch_us(CAST(day AS TIMESTAMP)) - epoch_us(TIMESTAMP '2001-05-31')), day, price)) AS k FROM d WHERE day BETWEEN DATE '2001-05-26' AND DATE '2001-06-05' GROUP BY product_id),
g AS (SELECT product_id, arg_max(price, day) AS current, max(day) AS current_day, min((price, day)) AS lo, min((-price, day)) AS hi, avg(price) FILTER (WHERE day >= DATE '2001-04-01') AS mean, min(day) AS first_day, count(*) AS days FROM d GROUP BY product_id),
s AS (SELECT g.product_id, current, current_day, g.lo[1] AS low, g.lo[2] AS low_day, -g.hi[1] AS high, g.hi[2] AS high_day, floor(mean * 100 + 0.5) / 100 AS avg90, w.k[3] AS base30,
  floor((current - w.k[3]) / w.k[3] * 100 * 100 + 0.5) / 100 AS change30, first_day, days, days < 30 AS limited FROM g LEFT JOIN w ON w.product_id = g.product_id)"""


@query(f"""WITH {STATS_SQL} SELECT product_id, base30 FROM s WHERE base30 IS NOT NULL""")
def nearest_baseline_daily(spark, sf) -> DataFrame:
    return series.stats(series.daily(T.history(spark, sf)), AS_OF).where("base30 is not null").select("product_id", "base30")


def _stats(spark, sf) -> DataFrame:
    return series.stats(series.daily(T.history(spark, sf)), AS_OF)


@query(f"""WITH {STATS_SQL} SELECT product_id, current, CAST(current_day AS VARCHAR) AS current_day, low, CAST(low_day AS VARCHAR) AS low_day, high, CAST(high_day AS VARCHAR) AS high_day, avg90, base30, change30, CAST(first_day AS VARCHAR) AS first_day, days, limited FROM s""")
def product_stats(spark, sf) -> DataFrame:
    s = _stats(spark, sf)
    return s.select(*[F.col(c).cast("string").alias(c) if c.endswith("_day") else c for c in s.columns])


@query(f"""WITH {H_SQL}, {D_SQL} SELECT product_id, CAST(day AS VARCHAR) AS day, price, in_stock FROM d""")
def daily_series(spark, sf) -> DataFrame:
    return series.daily(T.history(spark, sf)).select("product_id", F.col("day").cast("string").alias("day"), "price", "in_stock")


@query(f"""WITH {H_SQL} SELECT product_id, min(price) AS all_time_low FROM h GROUP BY 1""")
def all_time_low(spark, sf) -> DataFrame:
    return series.all_time_low(T.history(spark, sf))


@query(f"""WITH {STATS_SQL} SELECT product_id, avg90 FROM s WHERE avg90 IS NOT NULL""")
def trailing_avg(spark, sf) -> DataFrame:
    return _stats(spark, sf).where("avg90 is not null").select("product_id", "avg90")


@query(f"""WITH {H_SQL}, {D_SQL} SELECT product_id, CAST(day AS VARCHAR) AS day, price, max(price) FILTER (WHERE in_stock AND day >= DATE '2001-04-01') OVER (PARTITION BY product_id) AS regular_price FROM d""")
def trailing_max_constant(spark, sf) -> DataFrame:
    return series.with_regular_price(series.daily(T.history(spark, sf)), AS_OF).select("product_id", F.col("day").cast("string").alias("day"), "price", "regular_price")


CHART_SQL = f"""{H_SQL}, {D_SQL},
k AS (SELECT product_id, day, price, CASE WHEN day >= DATE '2000-06-30' THEN strftime(day, '%Y-%m-%d') WHEN day >= DATE '2001-06-30' - 1095 THEN strftime(day, '%Y') || '-w' || CAST(date_diff('day', DATE '1970-01-01', day) // 7 AS VARCHAR) ELSE strftime(day, '%Y-%m') END AS key FROM d),
q AS (SELECT product_id, max(day) AS day, arg_max(price, day) AS price FROM k GROUP BY product_id, key)"""


@query(f"""WITH {CHART_SQL} SELECT product_id, CAST(day AS VARCHAR) AS day, price FROM q""")
def chart_points(spark, sf) -> DataFrame:
    return series.chart_points(series.daily(T.history(spark, sf)), AS_OF).select("product_id", F.col("day").cast("string").alias("day"), "price")


@query(f"""WITH {CHART_SQL} SELECT product_id, CAST(day AS VARCHAR) AS day, price FROM q WHERE day >= DATE '2001-06-30' - 182""")
def chart_half_year(spark, sf) -> DataFrame:
    return series.chart_points(series.daily(T.history(spark, sf)), AS_OF, 182).select("product_id", F.col("day").cast("string").alias("day"), "price")


@query(f"""WITH {H_SQL}, {D_SQL}, g AS (SELECT product_id, day, CASE WHEN in_stock THEN price END AS price FROM d),
f AS (SELECT product_id, day, last_value(price IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, price IS NOT NULL AS in_stock FROM g)
SELECT product_id, CAST(day AS VARCHAR) AS day, p AS price, in_stock FROM f WHERE p IS NOT NULL""")
def forward_fill_stock(spark, sf) -> DataFrame:
    d = series.daily(T.history(spark, sf)).withColumn("price", F.when(F.col("in_stock"), F.col("price")))
    return series.forward_filled(d).select("product_id", F.col("day").cast("string").alias("day"), "price", "in_stock")


def _two_series(spark, sf) -> DataFrame:
    """Lines of open orders as the primary series, others as the secondary one; a returned line has no offer. Of a day and series the last line counts."""
    li = T.read(spark, sf, "lineitem")
    km = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 60000)
    cents = F.when(F.col("l_returnflag") == "R", -1).otherwise(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)).cast("long")
    p = li.select(F.col("l_partkey").alias("product_id"), km.alias("km"), cents.alias("cents"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("source"))
    return p.groupBy("product_id", "km", "source").agg(F.max("cents").alias("cents"))


TWO_SQL = """t AS (SELECT l_partkey AS product_id, epoch_ms(l_shipdate) // 60000 AS km, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS source,
  max(CASE WHEN l_returnflag = 'R' THEN -1 ELSE CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) END) AS cents FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT *, last_value(CASE WHEN source = 0 THEN cents < 0 END IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY km, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap,
  bool_or(source = 0 AND cents >= 0) OVER (PARTITION BY product_id) AS any0 FROM t),
v AS (SELECT product_id, km, source, cents FROM u WHERE CASE WHEN NOT any0 THEN source = 1 ELSE source = 0 OR (COALESCE(gap, false) AND cents >= 0) END)"""


@query(f"""WITH {TWO_SQL} SELECT product_id, km, CAST(source AS BIGINT) AS source, cents FROM v""")
def gap_fill_two_series(spark, sf) -> DataFrame:
    return series.gap_filled(_two_series(spark, sf)).select("product_id", "km", F.col("source").cast("long").alias("source"), "cents")


@query(f"""WITH {TWO_SQL}, y AS (SELECT product_id, km, CASE WHEN cents >= 0 THEN floor(cents::DOUBLE + 0.5) / 100 END AS price FROM v),
z AS (SELECT *, median(price) OVER (PARTITION BY product_id) AS m FROM y)
SELECT product_id, km, price FROM z WHERE price IS NULL OR (price >= 5 AND price <= m * 1.25::DOUBLE)""")
def outlier_filter(spark, sf) -> DataFrame:
    """With a factor of 1.25, as the tables' prices lie close together."""
    p = series.gap_filled(_two_series(spark, sf)).withColumn("price", M.dollars(F.col("cents")))
    return series.without_outliers(p, factor=1.25).select("product_id", "km", "price")


def _provider_arrays(spark, sf) -> DataFrame:
    """The two series of each product as the provider sends them: arrays in which minutes and cents alternate."""
    flat = lambda k: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == k, F.struct("km", "cents")))), lambda x: F.array(x["km"], x["cents"])))
    return _two_series(spark, sf).groupBy("product_id").agg(flat(0).alias("primary"), flat(1).alias("secondary"))


HISTORY_SQL = f"""{TWO_SQL}, y AS (SELECT product_id, km, source, CASE WHEN cents >= 0 THEN floor(cents::DOUBLE + 0.5) / 100 END AS price FROM v), z AS (SELECT *, median(price) OVER (PARTITION BY product_id) AS m FROM y)"""


@query(f"""WITH {HISTORY_SQL} SELECT product_id, km, CAST(source AS INTEGER) AS source, price, TIMESTAMP '2011-01-01' + to_minutes(km) AS fetched_at FROM z WHERE price IS NULL OR (price >= 5 AND price <= m * 5)""")
def parsed_history(spark, sf) -> DataFrame:
    """Provider arrays to one series: pairs, gaps filled from the second series, outliers dropped. Minutes count from 2011."""
    out = series.parsed_history(_provider_arrays(spark, sf))
    return out.select("product_id", "km", F.col("source").cast("int").alias("source"), "price", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(f"""WITH {HISTORY_SQL} SELECT product_id, count(*) FILTER (WHERE source = 0) AS "primary", count(*) FILTER (WHERE source = 1) AS secondary, count(*) FILTER (WHERE price < 5 OR price > m * 1.25::DOUBLE) AS dropped FROM z GROUP BY 1""")
def outlier_counts(spark, sf) -> DataFrame:
    """How many points each series gave and how many were dropped, with a factor of 1.25."""
    p = series.gap_filled(_two_series(spark, sf)).withColumn("price", M.dollars(F.col("cents")))
    return series.outlier_counts(p, factor=1.25)


@query(f"""WITH {H_SQL}, {D_SQL} SELECT product_id, CAST(price AS DOUBLE) AS price, max(price) FILTER (WHERE day >= DATE '2001-04-01') OVER (PARTITION BY product_id) AS regular_price, true AS in_stock, strftime(day, '%Y-%m-%d') || ' 23:59:00' AS fetched_at
FROM (SELECT product_id, day, price FROM (SELECT product_id, day, floor(floor(price * 100 + 0.5)::DOUBLE + 0.5) / 100 AS price FROM (SELECT h.product_id, CAST(fetched_at AS DATE) AS day, max(price) AS price FROM h GROUP BY 1, 2)))""")
def backfill_rows(spark, sf) -> DataFrame:
    """The highest price of each day as a one-point provider series, turned to daily rows."""
    h = T.history(spark, sf).groupBy("product_id", F.date_trunc("day", "fetched_at").alias("t")).agg(F.max("price").alias("price"))
    p = h.select("product_id", (F.floor(F.unix_millis("t") / 60000)).alias("km"), M.dollars(F.floor(F.col("price") * 100 + 0.5)).alias("price"), F.lit(0).alias("source"), F.col("t").alias("fetched_at"))
    return series.backfill_rows(p, AS_OF).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {H_SQL} SELECT CAST(max(fetched_at) AS VARCHAR) AS batch_at FROM h WHERE fetched_at BETWEEN TIMESTAMP '2001-06-30' - INTERVAL 36 HOURS AND TIMESTAMP '2001-06-30'""")
def newest_batch(spark, sf) -> DataFrame:
    return series.newest_batch(T.history(spark, sf), AS_OF).select(F.date_format("batch_at", "yyyy-MM-dd HH:mm:ss").alias("batch_at"))


@query(f"""WITH {P_SQL}, {H_SQL}, {NOW_SQL}, v AS (SELECT segment, median(price / capacity_gb) AS m FROM p JOIN c ON c.product_id = p.id WHERE capacity_gb > 0 GROUP BY segment)
SELECT id, price / capacity_gb AS per_gb, m AS median_per_gb, CASE WHEN price / capacity_gb / m < 0.93 THEN 'below' WHEN price / capacity_gb / m > 1.07 THEN 'above' ELSE 'near' END AS value FROM p JOIN c ON c.product_id = p.id JOIN v ON v.segment = p.segment""")
def value_per_unit(spark, sf) -> DataFrame:
    return market.value_of_products(T.products(spark, sf), series.latest(T.history(spark, sf), AS_OF))


STATE_SQL = """CASE WHEN avg90 IS NULL THEN NULL WHEN current <= avg90 * 1.01::DOUBLE THEN CASE WHEN floor(abs((current - avg90) / avg90 * 100) + 0.5) <= 1 THEN 'typical' ELSE 'good' END ELSE 'elevated' END"""


@query(f"""WITH {STATS_SQL} SELECT product_id, {STATE_SQL} AS state FROM s""")
def buy_state(spark, sf) -> DataFrame:
    return _stats(spark, sf).select("product_id", M.buy_state(F.col("current"), F.col("avg90")).alias("state"))


@query(f"""WITH {STATS_SQL}, k AS (SELECT *, {STATE_SQL} AS state, CASE WHEN current <= low THEN 'lowest' WHEN current <= low * 1.02::DOUBLE THEN 'near_low' ELSE 'above_low' END AS "at" FROM s)
SELECT product_id, CASE WHEN state <> 'elevated' AND current >= low * 1.5::DOUBLE THEN 'inflated' ELSE state END AS verdict, "at", CASE WHEN "at" = 'above_low' THEN CAST(CAST(floor((current - low) / low * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS above_low,
CASE WHEN "at" = 'above_low' AND high > current THEN CAST(CAST(floor((high - current) / high * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS below_high FROM k""")
def price_verdict(spark, sf) -> DataFrame:
    s = _stats(spark, sf)
    return s.select("product_id", M.verdict(F.col("current"), F.col("avg90"), F.col("low")).alias("verdict"), M.assessment(F.col("current"), F.col("low"), F.col("high")).alias("x")).select("product_id", "verdict", "x.at", F.col("x.above_low").cast("string").alias("above_low"), F.col("x.below_high").cast("string").alias("below_high"))


# ------------------------------------------------------------------------------------------------ listing

LIST_SQL = f"""{P_SQL}, {H_SQL},
n1 AS (SELECT product_id, price, in_stock FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, o, n, e) AS r FROM h WHERE fetched_at >= TIMESTAMP '2001-06-28') WHERE r = 1),
n2 AS (SELECT product_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY abs(epoch_us(fetched_at) - epoch_us(TIMESTAMP '2001-05-31')), fetched_at, o, n, e) AS r FROM h WHERE fetched_at BETWEEN TIMESTAMP '2001-05-26' AND TIMESTAMP '2001-06-05') WHERE r = 1),
l AS (SELECT p.*, n1.price, n1.in_stock, n2.price AS base30, (n1.price - n2.price) / n2.price * 100 AS change30 FROM p LEFT JOIN n1 ON n1.product_id = p.id LEFT JOIN n2 ON n2.product_id = p.id)"""


def _listing(spark, sf) -> DataFrame:
    return listing.listing(T.products(spark, sf), T.history(spark, sf), AS_OF)


@query(f"""WITH {LIST_SQL} SELECT id, price, base30, change30 FROM l""")
def listing_view(spark, sf) -> DataFrame:
    return _listing(spark, sf).select("id", "price", "base30", "change30")


@query(f"""WITH {LIST_SQL} SELECT id, price, change30 FROM l ORDER BY change30 NULLS LAST, id""")
def listing_sorted(spark, sf) -> DataFrame:
    return listing.sorted_by(_listing(spark, sf), "drop").select("id", "price", "change30")


@query(f"""WITH {LIST_SQL} SELECT id, title, price FROM l WHERE capacity_gb >= 16 AND 4800 + capacity_gb * 40 >= 5500 AND 4800 + capacity_gb * 40 < 6000 AND lower(brand) = 'brand#11' AND contains(lower(title), 'ddr5') AND contains(regexp_replace(lower(title || ' ' || brand), '[^a-z0-9\\s]', '', 'g'), 'gizmo')""")
def listing_facets(spark, sf) -> DataFrame:
    named = _listing(spark, sf).withColumn("name", F.col("title"))
    return listing.filtered(named, {"type": "DDR5", "capacity": "16GB+", "speed": "5600MHz", "brand": "Brand#11", "color": None}, "gizmo").select("id", F.col("name").alias("title"), "price")


@query(f"""WITH {LIST_SQL}, f AS (SELECT id, price, change30, 0 AS mode, change30 AS key FROM l WHERE price IS NOT NULL AND change30 < 0 ORDER BY key, id LIMIT 4),
t AS (SELECT product_id, min(price) AS low FROM h GROUP BY 1),
g AS (SELECT l.id, l.price, l.change30, 1 AS mode, l.price / low AS key FROM l JOIN t ON t.product_id = l.id WHERE l.price IS NOT NULL AND low > 0 AND l.id NOT IN (SELECT id FROM f) ORDER BY key, id LIMIT 4)
SELECT id, price, change30, mode, key FROM (SELECT * FROM f UNION ALL SELECT * FROM g) ORDER BY mode, key, id LIMIT 4""")
def biggest_drops(spark, sf) -> DataFrame:
    return listing.biggest_drops(_listing(spark, sf), series.all_time_low(T.history(spark, sf)))


@query(f"""WITH {P_SQL}, {H_SQL}, {NOW_SQL}, q AS (SELECT id, segment, price FROM p JOIN c ON c.product_id = p.id)
SELECT id, rid, place FROM (SELECT a.id, b.id AS rid, CAST(row_number() OVER (PARTITION BY a.id ORDER BY abs(b.price - a.price), b.id) AS INTEGER) AS place FROM q a JOIN q b ON a.segment IS NOT DISTINCT FROM b.segment AND a.id <> b.id) WHERE place <= 3""")
def related_products(spark, sf) -> DataFrame:
    now = series.latest(T.history(spark, sf), AS_OF).select(F.col("product_id").alias("id"), "price")
    return listing.related_products(T.products(spark, sf).select("id", "segment").join(now, "id"))


@query(f"""WITH {P_SQL}, {H_SQL}, {NOW_SQL}, t AS (SELECT product_id, min(price) AS low FROM h GROUP BY 1)
SELECT sku, name, brand, category, c.price AS current_price, low AS all_time_low, concat_ws(' ', brand, name, sku) AS search FROM p JOIN c ON c.product_id = p.id LEFT JOIN t ON t.product_id = p.id""")
def search_index(spark, sf) -> DataFrame:
    h = T.history(spark, sf)
    return catalog.search_index(T.products(spark, sf).withColumn("slug", F.col("sku")), series.latest(h, AS_OF), series.all_time_low(h)).drop("slug")
