"""Which products belong together: capacity families, part numbers and names in retailers' feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from . import blocks

MIN_MEMBERS = MIN_CAPACITIES = 2
#: Rows of one join key that meet in a task; a key of more is dealt to several.
HOT = 4096


def families(members: DataFrame, key: str) -> DataFrame:
    """Groups of members (id, capacity_gb, parent) by a key that have at least two members and two capacities."""
    groups = members.where(F.col(key).isNotNull() & F.col("capacity_gb").isNotNull()).groupBy(key)
    agg = groups.agg(F.count(F.lit(1)).alias("members"), F.count_distinct("capacity_gb").alias("capacities"), F.count_distinct("parent").alias("parents"))
    return agg.where((F.col("members") >= MIN_MEMBERS) & (F.col("capacities") >= MIN_CAPACITIES))


def clustered(products: DataFrame) -> DataFrame:
    """id, family_id, tier and flag of each product with a capacity; products: id, category, brand, name, capacity_gb, parent.

    Tier 1 groups by parent. A parent that several products share claims them even if they have one capacity only. Tier 2
    groups what is not claimed by line key; a group with two parents or more is refused (conflict), one with exactly one is
    formed and flagged. What is in no family has null.
    """
    p = products.where("capacity_gb is not null")
    by_parent = p.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("capacity_gb").alias("capacities"))
    claims = by_parent.where("n >= 2")
    one = p.join(claims.where(F.col("capacities") >= MIN_CAPACITIES).select("parent"), "parent").select("id", F.concat(F.lit("p-"), F.lower("parent")).alias("family_id"), F.lit(1).alias("tier"), F.lit(None).cast("string").alias("flag"))
    pool = p.join(claims.select("parent"), "parent", "left_anti").withColumn("key", T.line_key(F.col("category"), F.col("brand"), F.col("name"))).where("key is not null")
    groups = families(pool, "key").withColumn("flag", F.when(F.col("parents") >= 2, "conflict").when(F.col("parents") == 1, "one_parent").when(F.col("capacities") > 6, "many_capacities"))
    two = pool.join(groups.select("key", "flag"), "key").select("id", F.when(F.coalesce(F.col("flag"), F.lit("")) != "conflict", F.col("key")).alias("family_id"), F.lit(2).alias("tier"), "flag")
    placed = one.union(two)
    return p.select("id").join(placed, "id", "left")


def canonical(members: DataFrame, depth: str = "depth") -> DataFrame:
    """Of each family and capacity the member with the deepest history, then the smallest sku."""
    order = W.partitionBy("family_id", "capacity_gb").orderBy(F.desc(depth), "sku")
    return members.where("family_id is not null and capacity_gb is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def capacity_chips(members: DataFrame, depth: str = "days") -> DataFrame:
    """For each member of a family with two capacities or more a chip for each capacity: itself for its own, else the canonical member; the lowest price per GB is best.

    members: id, sku, family_id, capacity_gb, price, and the depth.
    """
    chosen = canonical(members, depth).select("family_id", F.col("capacity_gb").alias("cap"), F.col("sku").alias("chip_sku"), F.col("price").alias("chip_price"))
    wide = chosen.groupBy("family_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("family_id")
    chips = members.select("id", "sku", "family_id", "capacity_gb", "price").join(wide, "family_id").join(chosen, "family_id")
    own = F.col("cap") == F.col("capacity_gb")
    chips = chips.select("id", "family_id", "cap", own.alias("viewing"), F.when(own, F.col("sku")).otherwise(F.col("chip_sku")).alias("sku"), F.when(own, F.col("price")).otherwise(F.col("chip_price")).alias("price"))
    per_gb = F.when(F.col("cap") > 0, F.col("price") / F.col("cap"))
    best = F.min(F.when(F.col("per_gb").isNotNull(), F.struct("per_gb", "cap"))).over(W.partitionBy("id"))
    return chips.withColumn("per_gb", per_gb).withColumn("best", F.coalesce(best["cap"] == F.col("cap"), F.lit(False)))


def multiset_left(a: Column, b: Column) -> Column:
    """Tokens of a that b doesn't hold; repeated ones count each time."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def _dealt(one: DataFrame, many: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with _part, so that their join on (on, _part) is their join on on: where many has more than HOT rows, it is dealt to parts and one is repeated for each."""
    hot = many.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    one = one.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # by the row's values, as a random part would change when a lost task runs again
    dealt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_parts"))).cast("int")
    return one.drop("_parts"), many.join(hot, on, "left").withColumn("_part", dealt).drop("_parts")


def near_misses(keys: DataFrame) -> DataFrame:
    """Pairs a < b of keys that differ in one token, on one side or on both, with token counts within 1.

    Keys that differ by one token agree once that token is left out, so each key is sent to itself and to its variants with
    one distinct token (all its places) left out, and only keys that meet there are compared. A pair that meets in several
    places counts at the smallest of them, so pairs need no second shuffle to be distinct; a place of many keys is many tasks.
    """
    k = keys.where("key is not null").select("key").distinct().withColumn("tokens", F.split("key", "-"))
    drops = F.transform(F.array_distinct("tokens"), lambda t: F.array_join(F.array_sort(F.array_distinct(F.filter("tokens", lambda x: x != t))), "-"))
    whole = F.array_join(F.array_sort(F.array_distinct("tokens")), "-")
    sent = k.withColumn("places", F.array_distinct(F.concat(F.array(whole), drops))).select(F.explode("places").alias("at"), "key", "tokens", "places")
    side = lambda x: sent.select("at", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "tokens", "places")])
    a, b = _dealt(side("a"), side("b"), ["at"])
    left, right = F.size(multiset_left(F.col("tokens_a"), F.col("tokens_b"))), F.size(multiset_left(F.col("tokens_b"), F.col("tokens_a")))
    close = (F.abs(F.size("tokens_a") - F.size("tokens_b")) <= 1) & (left <= 1) & (right <= 1) & (left + right >= 1)
    first = F.col("at") == F.array_min(F.array_intersect("places_a", "places_b"))
    return a.join(b, ["at", "_part"]).where((F.col("key_a") < F.col("key_b")) & close & first).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


# ------------------------------------------------------------------------------------------------ feeds


def best_candidate(candidates: DataFrame, seller_word: str, by: str = "product_id") -> DataFrame:
    """candidates (mpn, our_mpn, seller, in_stock, price, feed_sku, url) with rank: equal raw part number, own seller, in stock, price (null last), sku or url."""
    order = W.partitionBy(by).orderBy(
        F.when((F.coalesce("mpn", F.lit("")) != "") & (F.col("mpn") == F.col("our_mpn")), 0).otherwise(1), F.when(T.has(F.coalesce("seller", F.lit("")), seller_word), 0).otherwise(1),
        F.when(F.coalesce("in_stock", F.lit(False)), 0).otherwise(1), F.asc_nulls_last("price"), T.first_filled(F.col("feed_sku"), F.col("url")),
    )
    return candidates.withColumn("rank", F.row_number().over(order))


def competing(ranked: DataFrame, by: str = "product_id") -> DataFrame:
    """The best candidate of each product with the skus of the others, in order."""
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "feed_sku")))), lambda x: x["feed_sku"])
    return ranked.groupBy(by).agg(F.min_by("feed_sku", "rank").alias("feed_sku"), F.min_by("price", "rank").alias("price"), others.alias("competing"))


def match_by_part_number(products: DataFrame, feed: DataFrame, seller_word: str = "newegg") -> DataFrame:
    """Every feed row whose normalised part number equals that of a product's title, ranked; products: id, name."""
    # written before a condition asks for it, so that it is worked out after rows are dealt to tasks
    ours = storage.written(blocks.spread(products.select("id", "name")).select("id", T.part_number(F.col("name")).alias("our_mpn")), "mpns").withColumn("_k", T.normal_mpn(F.col("our_mpn"))).where("_k <> ''").select(F.col("id").alias("product_id"), "our_mpn", "_k")
    theirs = feed.withColumn("_k", T.normal_mpn(F.col("mpn"))).where("_k <> ''").withColumnRenamed("name", "feed_name")
    return best_candidate(ours.join(theirs, "_k").drop("_k"), seller_word)


def _picture(tokens: Column) -> Column:
    """One bit for each token, of 64: a set that holds another has all bits of its picture."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))


def match_by_name(products: DataFrame, feed: DataFrame, seller_word: str = "newegg") -> DataFrame:
    """Feed rows of equal capacity and invariants whose tokens hold a product's whole line signature, ranked.

    The brand's first word must occur in the feed's brand, or without one in its name; a product without a brand skips that.
    Each title is taken apart once, however many rows have it. Titles that say the same are a class, and classes are matched, not
    rows: the work doesn't grow with the copies of a title on both sides. A class of products meets only classes of feed rows that
    hold the word of its signature which is rarest among those of its capacity and invariants, not all of these. Where more than
    HOT classes hold even that word, it meets those that hold its two rarest words, and classes of a pair that is still so
    frequent are dealt to several tasks. What meets is compared by pictures of the words first. Feed rows are ranked once for a
    class of products, as their order doesn't depend on the product.
    """
    key = ["category", "_cap", "_inv"]
    name = F.col("name")
    facts = lambda d: d.withColumn("_cap", T.total_capacity_gb(name)).withColumn("_inv", F.array_join(T.invariants(F.col("category"), name), "|"))
    known = "category is not null and _cap is not null and _inv is not null"
    first = F.lower(F.split_part(F.trim(F.coalesce("brand", F.lit(""))), F.lit(" "), F.lit(1)))
    titled = ["category", "brand", "name"]
    ours = facts(blocks.spread(products.select(*titled).distinct())).withColumn("_sig", F.array_sort(F.array_distinct(T.line_signature(name, F.col("brand"))))).withColumn("_first", first)
    ours, asked = _classes(ours, titled, [*key, "_sig", "_first"], known + " and size(_sig) > 0", "_class")
    asked = asked.withColumn("_bits", _picture(F.col("_sig")))
    shown = [c for c in titled if c in feed.columns]
    theirs = feed.select(*shown).distinct()
    if "category" not in shown:  # what the title says
        theirs = theirs.withColumn("category", F.when(T.has(name, "ddr"), "ram").when(T.has(name, "ssd|nvme"), "ssd"))
    theirs = facts(blocks.spread(theirs)).withColumn("_tok", F.array_sort(F.array_distinct(F.transform(T.title_tokens(name), F.lower)))).withColumn("_where", F.lower(T.first_filled(F.col("brand"), name)))
    theirs, narrow = _classes(theirs, shown, [*key, "_tok", "_where"], known, "_group")
    narrow = narrow.withColumn("_has", _picture(F.col("_tok")))
    held = storage.written(narrow.select(*key, F.explode("_tok").alias("_t")).groupBy(*key, "_t").agg(F.count(F.lit(1)).alias("_n")), "words")
    words = asked.select("_class", *key, F.explode("_sig").alias("_t")).join(held, [*key, "_t"], "left")
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_t").alias("t")))), 1, 2)
    asked = asked.join(words.groupBy("_class").agg(rare.alias("_rare")), "_class").where("_rare[0].n > 0")
    # a frequent rarest word leaves frequent words only, so the second one is among a class's frequent words too
    often = F.col("_rare")[0]["n"] > HOT
    pair = F.array_sort(F.transform("_rare", lambda x: x["t"]))
    asked = asked.withColumn("_at", F.when(often, pair).otherwise(F.array(F.col("_rare")[0]["t"]))).drop("_rare")
    met = narrow.withColumn("_at", F.explode(F.transform("_tok", lambda t: F.array(t))))
    on = [*key, "_at"]
    hot = held.where(F.col("_n") > HOT).groupBy(*key).agg(F.collect_set("_t").alias("_hot"))
    if not hot.isEmpty():
        frequent = narrow.join(hot, key).withColumn("_hot", F.array_sort(F.array_intersect("_tok", "_hot")))
        pairs = F.flatten(F.transform("_hot", lambda t: F.transform(F.filter("_hot", lambda u: u > t), lambda u: F.array(t, u))))
        met = met.unionByName(frequent.withColumn("_at", F.explode(pairs)).drop("_hot"))
        asked = storage.written(asked, "asked")
        asked, met = _dealt(asked, met.join(asked.select(*on).distinct(), on, "left_semi"), on)
        on = [*on, "_part"]
    holds = (F.col("_bits").bitwiseAND(F.bitwise_not("_has")) == 0) & F.forall("_sig", lambda t: F.array_contains("_tok", t)) & ((F.col("_first") == "") | F.contains("_where", F.col("_first")))
    found = asked.join(met, on).where(holds).select("_class", "_group")
    rows = _of_class(feed, theirs, shown, "_group").drop("category").withColumnsRenamed({"brand": "feed_brand", "name": "feed_name"})
    ranked = best_candidate(found.join(rows, "_group").drop("_group").withColumn("our_mpn", F.lit(None).cast("string")), seller_word, "_class")
    mine = _of_class(products.select("id", *titled), ours, titled, "_class").select(F.col("id").alias("product_id"), "_class")
    out = mine.join(ranked, "_class").select("product_id", "our_mpn", *[c for c in rows.columns if c != "_group"], "rank")
    if mine.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return out
    return best_candidate(out.drop("rank"), seller_word)  # an id of several titles has one ranking


def _classes(titles: DataFrame, titled: list[str], same: list[str], keep: str, number: str) -> tuple[DataFrame, DataFrame]:
    """titles, written, and the classes of those to keep: numbered rows of the columns same, in which titles agree."""
    # a condition on what titles say comes after they are written: Spark would judge it before they are dealt to tasks
    titles = storage.written(titles.select(*{c: None for c in [*titled, *same]}), "titles").where(keep)
    classes = storage.written(titles.select(*same).distinct().withColumn(number, F.monotonically_increasing_id()), "classes")
    # keys of classes are never null
    return titles.join(classes, same).select(*[F.col(c).alias(f"_t_{c}") for c in titled], number), classes


def _of_class(rows: DataFrame, titles: DataFrame, titled: list[str], number: str) -> DataFrame:
    """rows with the number of their title's class; those of no class go."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in titled])
    return rows.join(titles, same).select(*rows.columns, number)


def matched_offers(products: DataFrame, feed: DataFrame, accepted: DataFrame | None = None, seller_word: str = "newegg") -> DataFrame:
    """product_id, method, accepted and the best feed row. Part numbers are accepted at once; names only if accepted (product_id, feed_sku) lists them."""
    # written: what is left over for the names is asked for several times
    by_mpn = storage.written(match_by_part_number(products, feed, seller_word).where("rank = 1"), "mpn")
    rest = storage.written(products.join(by_mpn.select(F.col("product_id").alias("id")), "id", "left_anti"), "rest")
    by_name = match_by_name(rest, feed, seller_word).where("rank = 1")
    cols = ["product_id", "feed_sku", "feed_name", "price", "in_stock", "url"]
    one = by_mpn.select(*cols, F.lit("mpn").alias("method"), F.lit(True).alias("accepted"))
    two = by_name.select(*cols, F.lit("name").alias("method"))
    if accepted is None:
        return one.unionByName(two.withColumn("accepted", F.lit(False)))
    marks = accepted.select("product_id", "feed_sku", F.lit(True).alias("_ok")).distinct()
    return one.unionByName(two.join(marks, ["product_id", "feed_sku"], "left").withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_ok"))


def singleton_reasons(products: DataFrame) -> DataFrame:
    """reason, n: why products (family_id, name, brand, capacity_gb) are alone in their family."""
    members = products.where("family_id is not null").groupBy("family_id").agg(F.count(F.lit(1)).alias("_members"))
    alone = products.join(members, "family_id", "left").where("_members = 1 or _members is null")
    no_line = F.size(T.line_signature(F.col("name"), F.col("brand"))) == 0
    reason = F.when(F.col("capacity_gb").isNull(), "unparseable capacity").when(no_line, "empty line signature").otherwise("no key match or shared parent")
    return alone.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
