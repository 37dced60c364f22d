"""Queries on alerts, writes, requests and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import money as M
from ..functions import text as X
from ..operators import alerts, batches, catalog, merges, series, sinks
from ..sources import provider
from ..streaming import jobs
from . import tables as T
from .prices import STATS_SQL
from .tables import A_SQL, AS_OF, EVENTS_AS_OF, H_SQL, NOW_SQL, P_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


ALERT_SQL = f"""{P_SQL}, {H_SQL}, {NOW_SQL}, {A_SQL}, due AS (SELECT a.*, c.price AS current FROM a JOIN c ON c.product_id = a.product_id WHERE confirmed AND NOT triggered AND c.price <= target_price)"""


def _parts(spark, sf):
    h = T.history(spark, sf)
    return T.alerts(spark, sf), series.latest(h, AS_OF), T.products(spark, sf), series.all_time_low(h)


@query(f"""WITH {ALERT_SQL} SELECT order_id, line, due.product_id, email, current, target_price, (SELECT min(price) FROM h WHERE h.product_id = due.product_id) AS all_time_low FROM due""")
def alert_hits(spark, sf) -> DataFrame:
    a, now, p, lows = _parts(spark, sf)
    return alerts.hits(a, now, p, lows).select("order_id", "line", "product_id", "email", "current", "target_price", "all_time_low")


@query(f"""WITH {ALERT_SQL} SELECT (SELECT count(*) FROM a WHERE confirmed AND NOT triggered) AS checked, (SELECT count(*) FROM due) AS matched, (SELECT count(*) FROM due) AS sendable, (SELECT count(*) FROM a WHERE NOT confirmed AND created_at < TIMESTAMP '2001-06-30' - INTERVAL 48 HOURS) AS expired_cleaned""")
def alert_job_counters(spark, sf) -> DataFrame:
    a, now, p, _ = _parts(spark, sf)
    return alerts.job_counters(a, now, p, AS_OF)


@query(f"""WITH {ALERT_SQL} SELECT count(*) FILTER (WHERE order_id % 3 <> 0) AS sent, count(*) FILTER (WHERE order_id % 3 = 0) AS failed FROM (SELECT DISTINCT order_id, line FROM due)""")
def alert_job_outcome(spark, sf) -> DataFrame:
    """Mails to all hits, sent and marked in tasks by a sender that refuses every third order; hits of one order and line are one alert."""
    a, now, p, lows = _parts(spark, sf)
    due = alerts.hits(a, now, p, lows).select((F.col("order_id") * 10 + F.col("line")).cast("long").alias("id"), "order_id")
    before = spark.createDataFrame([], "id long")
    after = jobs.send_then_mark(due, lambda mail: mail["order_id"] % 3 != 0, before, storage.new_path(spark, "mails"))
    return jobs.sent_counters(due, before, after)


def _answers(ids: list[str]) -> list[dict]:
    """What a provider would say; it doesn't know every id."""
    return [{"asin": x, "digits": len(x)} for x in ids if not x.endswith("7")]


@query("""SELECT CAST(l_partkey AS VARCHAR) AS asin, CAST(length(CAST(l_partkey AS VARCHAR)) AS BIGINT) AS digits FROM lineitem WHERE l_partkey % 10 <> 7 GROUP BY l_partkey""")
def provider_lanes(spark, sf) -> DataFrame:
    """Every part that was sold, asked for in three lanes."""
    ids = T.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("asin"))
    found = provider.fetched(ids, _answers, lanes=3, per_minute=0)
    return found.select("asin", F.get_json_object("payload", "$.digits").cast("long").alias("digits"))


@query(f"""WITH {A_SQL} SELECT email, count(*) FILTER (WHERE NOT confirmed AND created_at >= TIMESTAMP '2001-06-30' - INTERVAL 48 HOURS) AS pending, count(*) FILTER (WHERE confirmed AND NOT triggered) AS active,
count(*) FILTER (WHERE NOT confirmed AND created_at >= TIMESTAMP '2001-06-30' - INTERVAL 48 HOURS) >= 3 OR count(*) FILTER (WHERE confirmed AND NOT triggered) >= 10 AS blocked FROM a GROUP BY 1""")
def admission_caps(spark, sf) -> DataFrame:
    return alerts.admission(T.alerts(spark, sf), AS_OF)


@query("""SELECT count(*) AS sent, count(*) >= 200 AS deferred FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '2024-01-30'""")
def send_breaker(spark, sf) -> DataFrame:
    return alerts.send_breaker(T.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("sent_at")), EVENTS_AS_OF)


@query(f"""WITH {A_SQL} SELECT order_id, line, product_id, target_price FROM a WHERE NOT confirmed AND created_at < TIMESTAMP '2001-06-30' - INTERVAL 48 HOURS""")
def expire_pending(spark, sf) -> DataFrame:
    return alerts.split_expired(T.alerts(spark, sf), AS_OF)[1].select("order_id", "line", "product_id", "target_price")


def _table(spark, rows: DataFrame, *keys: str) -> merges.Table:
    return merges.Table(spark, storage.new_path(spark, "table")).create(rows, list(keys), 16)


@query("""SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def upsert_merge(spark, sf) -> DataFrame:
    """Every third part is missing from the old table; every second has a new price, said twice, without a brand for those the table knows."""
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    table = _table(spark, p.where("id % 3 <> 0"), "id")
    priced = p.where("id % 2 = 0 and id % 3 <> 0").select("id", F.explode(F.array(F.struct((F.col("price") * 5).alias("price"), F.lit(1).alias("at")), F.struct((F.col("price") * 2).alias("price"), F.lit(2).alias("at")))).alias("x"))
    table.upsert(priced.select("id", "x.price", "x.at"), order="at")
    table.upsert(p.where("id % 2 = 0 and id % 3 = 0").withColumn("price", F.col("price") * 2))
    return table.read()


@query("""SELECT o_custkey AS email, l_partkey AS product_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'""")
def insert_if_absent(spark, sf) -> DataFrame:
    rows = T.read(spark, sf, "orders").join(T.read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("email"), F.col("l_partkey").alias("product_id"), "o_orderstatus")
    return sinks.insert_if_absent(rows.where("o_orderstatus <> 'O'").drop("o_orderstatus"), rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["email", "product_id"])[1]


@query("""SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 0.0::DOUBLE ELSE l_extendedprice END AS price FROM lineitem WHERE l_returnflag = 'R' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def replace_by_key(spark, sf) -> DataFrame:
    rows = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), "l_returnflag")
    table = _table(spark, rows.drop("l_returnflag"), "k")
    table.replace(rows.where("l_returnflag = 'R'").select("k", "line", F.lit(0.0).alias("price")))
    return table.read()


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'confirmed' ELSE o_orderstatus END AS status FROM orders""")
def keyed_update(spark, sf) -> DataFrame:
    """Open orders become confirmed; each change comes three times."""
    rows = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = _table(spark, rows, "id")
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("status")) for n, s in enumerate(("asked", "mailed", "confirmed"))]))
    table.update(rows.where("status = 'P'").select("id", steps.alias("x")).select("id", "x.status", "x.n"), order="n")
    return table.read()


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')""")
def missing_ids(spark, sf) -> DataFrame:
    recent = T.read(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return T.read(spark, sf, "part").select("p_partkey").join(recent, "p_partkey", "left_anti").withColumnRenamed("p_partkey", "id")


@query("""SELECT l_partkey AS product_id, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY 1""")
def semi_restrict(spark, sf) -> DataFrame:
    wanted = T.read(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return T.read(spark, sf, "lineitem").join(wanted, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("product_id")).agg(F.count(F.lit(1)).alias("n"))


#: Emails made of customers, one of five kinds wrong in its own way.
def _requests(spark, sf) -> DataFrame:
    c = T.read(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))
    email = F.when(k % 5 == 0, F.concat(name, F.lit("@mail"))).when(k % 5 == 1, "").otherwise(F.concat(F.lit(" "), F.upper(name), F.lit("@Mail.test ")))
    price = F.when(k % 4 == 0, "0.99").when(k % 4 == 1, "10000").when(k % 4 == 2, "10000.01").otherwise("x1")
    return c.select(k.alias("id"), email.alias("email"), price.alias("price"), F.when(k % 3 == 0, " ").otherwise("P1").alias("product"))


REQ_SQL = """q AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) AS name FROM customer),
r AS (SELECT id, CASE WHEN id % 5 = 0 THEN name || '@mail' WHEN id % 5 = 1 THEN '' ELSE ' ' || upper(name) || '@Mail.test ' END AS email FROM q)"""


@query(f"""WITH {REQ_SQL} SELECT id, array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'email_invalid' WHEN id % 5 = 1 THEN 'email_missing' END, CASE id % 4 WHEN 0 THEN 'price_too_low' WHEN 2 THEN 'price_too_high' WHEN 3 THEN 'price_not_a_number' END, CASE WHEN id % 3 = 0 THEN 'product_missing' END], lambda x: x IS NOT NULL), ',') AS errors,
CASE WHEN id % 5 > 1 AND id % 4 = 1 AND id % 3 <> 0 THEN lower(trim(email)) END AS email FROM r""")
def validation_errors(spark, sf) -> DataFrame:
    e, p, t = F.col("email"), F.col("price"), F.col("product")
    return _requests(spark, sf).select("id", F.array_join(X.alert_errors(e, p, t), ",").alias("errors"), X.sanitized_alert(e, p, t)["email"].alias("email"))


@query(f"""WITH {REQ_SQL} SELECT id, CASE WHEN contains(email, '@') THEN left(email, 2) || '***@' || split_part(email, '@', 2) ELSE '(none)' END AS masked FROM r""")
def masked_email(spark, sf) -> DataFrame:
    return _requests(spark, sf).select("id", X.masked_email(F.col("email")).alias("masked"))


@query("""SELECT event_id, strftime(date_trunc('day', ts) + to_hours(CASE WHEN hour(ts) < 6 THEN 6 WHEN hour(ts) < 18 THEN 18 ELSE 30 END), '%Y-%m-%d %H:%M:%S') AS next FROM events""")
def next_boundary(spark, sf) -> DataFrame:
    return T.read(spark, sf, "events").select("event_id", F.date_format(M.next_fetch(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("next"))


@query("""WITH m AS (SELECT event_id, CAST(floor(greatest(epoch_ms(TIMESTAMP '2024-01-30') - epoch_ms(ts), 0) / 60000 + 0.5) AS BIGINT) AS m FROM events), h AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM m), d AS (SELECT *, CAST(floor(h / 24 + 0.5) AS BIGINT) AS d FROM h)
SELECT event_id, CASE WHEN m < 2 THEN 'just now' WHEN m < 60 THEN m || ' minutes ago' WHEN h < 24 THEN h || CASE WHEN h = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END END AS said FROM d""")
def relative_time(spark, sf) -> DataFrame:
    return T.read(spark, sf, "events").select("event_id", M.relative_time(F.col("ts").cast("timestamp"), F.lit(EVENTS_AS_OF)).alias("said"))


@query("""SELECT event_id, CASE WHEN value < 0 THEN 'down' WHEN value < 10 THEN 'neutral' ELSE 'up' END AS class, greatest(1, CAST(floor(value * 0.9::DOUBLE) AS BIGINT)) AS prefill FROM events WHERE value IS NOT NULL""")
def pulse_class(spark, sf) -> DataFrame:
    v = F.col("value")
    return T.read(spark, sf, "events").where(v.isNotNull()).select("event_id", M.pulse_class(v).alias("class"), M.alert_prefill(v).cast("long").alias("prefill"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT key, id, r, TRUE AS accepted, [ts] AS times FROM e WHERE r = 1
  UNION ALL SELECT key, id, r, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END
  FROM (SELECT e.*, list_filter(w.times, lambda x: x > e.ts - INTERVAL 6 HOURS) AS kept FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1))
SELECT key, id, accepted FROM w""")
def rate_limit_decisions(spark, sf) -> DataFrame:
    """Three accepted events of a user in 6 hours."""
    e = T.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return alerts.decided(e, 3, 360).select("key", "id", "accepted")


#: Requests made of events (traps, bad emails and prices, unknown products), alerts and mails made of customers; each walk is a recursion.
ADMIT_SQL = """q AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS ip, event_id % 17 = 0 AS trap, event_id % 19 = 0 AS bot, 'u' || user_id || '@mail.test' AS email, event_id % 13 = 0 AS bad_email, event_id % 23 = 0 AS bad_price, event_id % 60 AS product FROM events),
a AS (SELECT 'u' || (c_custkey % 100) || '@mail.test' AS email, c_custkey AS product_id, c_custkey % 3 <> 0 AS confirmed, c_custkey % 5 = 0 AS triggered, TIMESTAMP '2023-12-31' + to_hours(c_custkey % 96) AS created_at FROM customer),
l AS (SELECT TIMESTAMP '2023-12-31' + to_hours(c_custkey % 96) AS sent_at FROM customer WHERE c_custkey % 4 = 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS r FROM q WHERE NOT trap AND NOT bot),
rw AS (SELECT ip, id, r, TRUE AS ok, [ts] AS times FROM ra WHERE r = 1
  UNION ALL SELECT ip, id, r, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END FROM (SELECT ra.*, list_filter(rw.times, lambda x: x > ra.ts - INTERVAL 24 HOURS) AS kept FROM rw JOIN ra ON ra.ip = rw.ip AND ra.r = rw.r + 1)),
t AS (SELECT q.*, CASE WHEN trap THEN 'honeypot_tripped' WHEN bot THEN 'turnstile_failed' WHEN NOT rw.ok THEN 'rate_limited' WHEN bad_email OR bad_price THEN 'invalid' WHEN p_partkey IS NULL THEN 'product_not_found' END AS first FROM q LEFT JOIN rw ON rw.id = q.id LEFT JOIN part ON p_partkey = product),
v AS (SELECT email, count(*) AS live FROM a WHERE confirmed AND NOT triggered GROUP BY 1),
x AS (SELECT t.email, ts, id, product, COALESCE(live, 0) >= 10 AS capped, a.email IS NOT NULL AS known, FALSE AS held FROM t LEFT JOIN v ON v.email = t.email LEFT JOIN a ON a.email = t.email AND a.product_id = t.product WHERE first IS NULL
  UNION ALL SELECT email, created_at, NULL, product_id, FALSE, TRUE, TRUE FROM a WHERE NOT confirmed AND email IN (SELECT email FROM t WHERE first IS NULL)),
ea AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, held DESC, id) AS r FROM x),
ew AS (SELECT email, 0::BIGINT AS r, NULL::BIGINT AS id, ''::VARCHAR AS outcome, []::TIMESTAMP[] AS times, []::BIGINT[] AS let_in FROM ea WHERE r = 1
  UNION ALL SELECT email, r, id, outcome, CASE WHEN outcome IN ('held', 'created') THEN list_append(kept, ts) ELSE kept END, CASE WHEN outcome = 'created' THEN list_append(let_in, product) ELSE let_in END
  FROM (SELECT *, CASE WHEN held THEN 'held' WHEN len(kept) >= 3 THEN 'email_pending_cap' WHEN capped THEN 'email_active_cap' WHEN known OR list_contains(let_in, product) THEN 'deduped' ELSE 'created' END AS outcome
    FROM (SELECT ea.*, ew.let_in, list_filter(ew.times, lambda y: y >= ea.ts - INTERVAL 48 HOURS) AS kept FROM ew JOIN ea ON ea.email = ew.email AND ea.r = ew.r + 1))),
m AS (SELECT ts, ew.id FROM ew JOIN q ON q.id = ew.id WHERE outcome = 'created' UNION ALL SELECT sent_at, NULL FROM l),
ma AS (SELECT *, row_number() OVER (ORDER BY ts, id IS NOT NULL, id) AS r FROM m),
mw AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS id, FALSE AS sent, []::TIMESTAMP[] AS times
  UNION ALL SELECT r, id, sent, CASE WHEN sent THEN list_append(kept, ts) ELSE kept END FROM (SELECT ma.*, list_filter(mw.times, lambda y: y >= ma.ts - INTERVAL 24 HOURS) AS kept, ma.id IS NULL OR len(kept) < 20 AS sent FROM mw JOIN ma ON ma.r = mw.r + 1))"""


def _admission(spark, sf) -> DataFrame:
    e, n, c = T.read(spark, sf, "events"), F.col("event_id"), T.read(spark, sf, "customer")
    email = F.when(n % 13 == 0, "nobody").otherwise(F.concat(F.lit("\t U"), F.col("user_id").cast("string"), F.lit("@Mail.test\n")))
    asked = e.select(
        n.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("ip"), F.when(n % 17 == 0, "x").otherwise("").alias("website"), (n % 19 != 0).alias("human"),
        email.alias("email"), F.when(n % 23 == 0, "0.5").otherwise("100").alias("price"), F.concat(F.lit("P"), (n % 60).cast("string")).alias("product"),
    )
    k = F.col("c_custkey")
    created = F.lit("2023-12-31").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 96).cast("int"))
    table = c.select(F.concat(F.lit("u"), (k % 100).cast("string"), F.lit("@mail.test")).alias("email"), k.alias("product_id"), (k % 3 != 0).alias("confirmed"), (k % 5 == 0).alias("triggered"), created.alias("created_at"))
    return alerts.admitted(asked, T.products(spark, sf).select("id", "sku"), table, c.where("c_custkey % 4 = 0").select(created.alias("sent_at")), rate=(3, 1440), send_cap=20)


@query(f"""WITH RECURSIVE {ADMIT_SQL} SELECT t.id, COALESCE(first, CASE WHEN ew.outcome = 'created' THEN CASE WHEN sent THEN 'created_sent' ELSE 'created_breaker_deferred' END ELSE ew.outcome END) AS outcome,
CASE WHEN first = 'invalid' THEN concat_ws(',', CASE WHEN bad_email THEN 'email_invalid' END, CASE WHEN bad_price THEN 'price_too_low' END) END AS errors FROM t LEFT JOIN ew ON ew.id = t.id LEFT JOIN mw ON mw.id = t.id""")
def alert_admission(spark, sf) -> DataFrame:
    """Every request decided through all limits: 3 an address a day, caps by email, 20 mails a day."""
    return _admission(spark, sf).select("id", "outcome", F.array_join("errors", ",").alias("errors"))


# ------------------------------------------------------------------------------------------------ the price batch


def _provider(spark, sf) -> DataFrame:
    """Own offers of two of three parts, new ones of four of five (some under the floor), buy boxes of all; every seventh part isn't returned."""
    p = T.read(spark, sf, "part").where("p_partkey % 7 <> 0")
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    own, new = F.when(k % 3 != 0, M.round2(v)), F.when(k % 5 != 0, F.when(k % 2 == 0, 4.99).otherwise(M.round2(v * 1.1)))
    none = [F.lit(None).cast("double")] * 16
    of = F.array(own, new, *none, M.round2(v * 1.2))
    return p.select(F.concat(F.lit("P"), k.cast("string")).alias("asin"), of.alias("current"), of.alias("highest"), F.concat(F.lit("B"), (k % 500).cast("string")).alias("parent"))


BATCH_SQL = f"""{P_SQL}, o AS (SELECT *, CASE WHEN id % 3 <> 0 THEN floor(list_price * 100 + 0.5) / 100 END AS a, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 2 = 0 THEN 4.99::DOUBLE ELSE floor(list_price * 1.1::DOUBLE * 100 + 0.5) / 100 END END AS b, floor(list_price * 1.2::DOUBLE * 100 + 0.5) / 100 AS c FROM p WHERE id % 7 <> 0),
r AS (SELECT id, category, COALESCE(CASE WHEN a >= 5 THEN a END, CASE WHEN b >= 5 THEN b END, CASE WHEN c >= 5 THEN c END) AS price, COALESCE(a, b, c) AS regular_price FROM o)"""


@query(f"""WITH {BATCH_SQL} SELECT id AS product_id, price, regular_price FROM r WHERE price IS NOT NULL""")
def price_fetch_batch(spark, sf) -> DataFrame:
    return batches.price_rows(T.products(spark, sf), _provider(spark, sf), AS_OF).select("product_id", "price", "regular_price")


@query(f"""WITH {BATCH_SQL} SELECT p.category, count(*) AS products, count(r.price) AS saved FROM p LEFT JOIN r ON r.id = p.id GROUP BY 1""")
def fetch_counts(spark, sf) -> DataFrame:
    c = T.products(spark, sf)
    return batches.batch_counts(c, batches.price_rows(c, _provider(spark, sf), AS_OF))


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 0""")
def not_returned(spark, sf) -> DataFrame:
    return batches.not_returned(T.products(spark, sf), _provider(spark, sf)).select("id")


@query("""WITH g AS (SELECT 'B' || (p_partkey % 500) AS parent, count(*) AS members, count(DISTINCT p_size) AS capacities FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1) SELECT *, members >= 2 AND capacities >= 2 AS family FROM g""")
def parent_report(spark, sf) -> DataFrame:
    return batches.parent_report(T.products(spark, sf), _provider(spark, sf))


MONEY_SQL = "'$' || format('{{:,.2f}}', {})"


@query(f"""WITH {STATS_SQL}, f AS (SELECT *, date_diff('day', first_day, current_day) / 365.25::DOUBLE AS y, CAST(floor(change30 + 0.5) AS BIGINT) AS ch FROM s)
SELECT product_id, CASE WHEN y >= 2 THEN CAST(CAST(floor(y + 0.5) AS BIGINT) AS VARCHAR) END AS years, days, {MONEY_SQL.format('low')} AS low, strftime(low_day, '%b %Y') AS low_month, CASE WHEN high <> low THEN {MONEY_SQL.format('high')} END AS high,
CASE WHEN ch <> 0 THEN CASE WHEN change30 < 0 THEN 'fallen' ELSE 'risen' END END AS moved, CASE WHEN ch <> 0 THEN CAST(abs(ch) AS VARCHAR) END AS percent FROM f""")
def history_facts(spark, sf) -> DataFrame:
    return batches.history_facts(series.stats(series.daily(T.history(spark, sf)), AS_OF))


@query(f"""WITH {P_SQL}, b AS (SELECT *, brand || ' ' || name || ' ' || capacity_gb || 'GB' AS base FROM p)
SELECT id, 'Prices of ' || base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN ' ' || right(sku, 4) ELSE '' END || ' over time' AS description FROM b""")
def page_descriptions(spark, sf) -> DataFrame:
    """One sentence a page; pages that would share one are told apart."""
    return catalog.page_descriptions(T.products(spark, sf).withColumn("name", F.col("title")), "Prices of ", F.lit(" over time"), 120)
