"""Building the catalog: harvested results, rejects, tallies, slugs and page data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from .batches import fitted
from .blocks import last_known, placed

LEAST_PRICE = 15.0


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the first row in the given order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def reject_reason(price, name, category):
    """The first rule a result breaks: noPrice, cheap, external, nameFilter; null: it is kept."""
    return F.when(price.isNull(), "noPrice").when(price < LEAST_PRICE, "cheap").when(T.is_external(name), "external").when(~T.fits_category(name, category), "nameFilter")


def built(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects by reason) from results (asin, name, category, min_price, price, max_price, query_idx, pos)."""
    once = first_seen(results.where("asin is not null and asin <> ''"), "asin", "query_idx", "pos")
    priced = once.withColumn("amount", T.price_of(F.col("min_price"), F.col("price"), F.col("max_price")))
    judged = priced.withColumn("reason", reject_reason(F.col("amount"), F.col("name"), F.col("category"))).withColumn("brand", T.brand_of(F.col("name")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reprocessed(catalog: DataFrame) -> DataFrame:
    """A stored catalog again: external drives go, brands are resolved anew."""
    return catalog.where(~T.is_external(F.col("name"))).withColumn("brand", T.brand_of(F.col("name")))


def tally(rows: DataFrame, column: str) -> DataFrame:
    """value, n: most frequent first; null and '' are '(null)'."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(null)")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def problems(products: DataFrame) -> DataFrame:
    """id, problem: a row for each of four checks that a product fails."""
    found = F.array_compact(F.array(F.when(F.coalesce("brand", F.lit("")) == "", "no_brand"), F.when(F.col("capacity_gb").isNull(), "no_capacity"), F.when(F.col("segment").isNull(), "no_segment"), F.when(F.col("price").isNull(), "no_price")))
    return products.select("id", F.explode(found).alias("problem"))


#: A slug that may be a number of another base: the base, and the number as it would be written.
_NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,17})$"


def _parent(slug: Column) -> Column:
    """(base, n) of which the slug would be the n-th; null if it is no numbered one."""
    n = F.regexp_extract(slug, _NUMBERED, 2)
    return F.when(n != "", F.struct(F.regexp_extract(slug, _NUMBERED, 1).alias("base"), n.cast("long").alias("n")))


def unique_slugs(products: DataFrame) -> DataFrame:
    """id, slug: the stored slug, else base, base-2, base-3 ... in id order, without any slug that is stored or taken in the category.

    products: id (unique), category, base, slug (null: none stored). A base's k-th product takes its k-th free number. A number is
    not free if the slug is stored, or if it is a base itself whose first product comes before this base's products get that far.
    Only such numbers are decided in rounds: each round counts the numbers known to be taken below each, finds the product that would
    arrive there, and compares ids; a number's answer depends on smaller numbers and shorter bases only, so rounds end, as a rule
    after two or three. Products are ranked by ranges and merged with the taken numbers in blocks, so a base of a million products
    is spread over the tasks; what meets by base are the numbers in question.
    """
    rows = products.select(F.col("id").cast("long").alias("id"), "category", "base", "slug")
    todo = storage.written(placed(rows.where("slug is null").select("id", "category", "base"), ["category", "base"], ["id"]), "slugs")
    stored = rows.where("slug is not null").select("category", "slug").distinct()
    firsts = todo.where("place = 1").select("category", F.col("base").alias("slug"), F.col("id").alias("first"))
    claimed = firsts.join(stored.withColumn("stored", F.lit(True)), ["category", "slug"], "full").withColumn("stored", F.coalesce("stored", F.lit(False)))
    numbers = claimed.withColumn("_p", _parent(F.col("slug"))).where("_p is not null").select("category", F.col("_p.base").alias("base"), F.col("_p.n").alias("n"), "slug", "stored", "first")
    numbers = numbers.unionByName(claimed.select("category", F.col("slug").alias("base"), F.lit(1).cast("long").alias("n"), "slug", "stored", "first"))
    bases = firsts.select("category", F.col("slug").alias("base"))
    numbers = numbers.join(bases, ["category", "base"], "left_semi")
    # a base's own name is in question only if it is stored, or the number of a base that has products
    contested = numbers.where("n > 1").select("category", "slug").distinct().withColumn("_asked", F.lit(True))
    numbers = numbers.join(contested, ["category", "slug"], "left").where("n > 1 or stored or _asked").drop("_asked")
    state = storage.written(numbers.withColumn("taken", F.col("stored") | (F.col("n") > 1)), "numbers")
    by_base = W.partitionBy("category", "base").orderBy("n")
    while True:
        below = F.coalesce(F.sum(F.col("taken").cast("long")).over(by_base.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        arriving = state.withColumn("place", F.col("n") - below).join(todo.select("category", "base", "place", F.col("id").alias("comes")), ["category", "base", "place"], "left")
        decided = arriving.where("n > 1").withColumn("now", F.col("stored") | F.col("comes").isNull() | F.coalesce(F.col("first") < F.col("comes"), F.lit(False)))
        up = decided.select("category", "slug", (~F.col("now")).alias("lost")).groupBy("category", "slug").agg(F.bool_or("lost").alias("lost"))
        own = arriving.where("n = 1").join(up, ["category", "slug"], "left").withColumn("now", F.col("stored") | F.coalesce("lost", F.lit(False)))
        after = storage.written(decided.unionByName(own.drop("lost")).select(*[c for c in state.columns if c != "taken"], F.col("now").alias("taken"), (F.col("now") != F.col("taken")).alias("changed")), "numbers")
        state = after.drop("changed")
        if after.where("changed").isEmpty():
            break
    nth = F.row_number().over(by_base).cast("long")
    gone = state.where("taken").withColumn("i", nth).select("category", "base", (F.col("n") - F.col("i") + 1).alias("pos"), F.lit(0).alias("kind"), F.col("i").alias("at"), "i", F.lit(None).cast("long").alias("id"))
    mine = todo.select("category", "base", F.col("place").alias("pos"), F.lit(1).alias("kind"), F.col("id").alias("at"), F.lit(None).cast("long").alias("i"), "id")
    merged = last_known(gone.unionByName(mine), ["category", "base"], F.floor(F.col("pos") / 4096), ["pos", "kind", "at"], {"i": F.col("i")}).where("kind = 1")
    n = F.col("pos") + F.coalesce("i", F.lit(0))
    made = merged.select("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("slug"))
    return made.unionByName(rows.where("slug is not null").select("id", "slug"))


def disambiguated(products: DataFrame, group: list[str]) -> DataFrame:
    """products with token: null for those alone in their group; else the first attribute that tells all members apart, or the last four of the sku."""
    out = products
    for kind in T.TOKEN_KINDS:
        out = out.withColumn(f"_{kind}", T.token_value(F.col("name"), kind))
    # counts are combined before the shuffle; no group is gathered
    sizes = out.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(f"_{kind}").alias(f"_{kind}_n") for kind in T.TOKEN_KINDS])
    out = out.join(sizes, reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]))
    token = F.substring("sku", -4, 4)
    for kind in reversed(T.TOKEN_KINDS):
        token = F.when(F.col(f"_{kind}_n") == F.col("_n"), F.col(f"_{kind}")).otherwise(token)
    return out.withColumn("token", F.when(F.col("_n") > 1, token)).select(*[F.col(c) for c in products.columns], "token")


def page_meta(products: DataFrame, suffix: str, budget: int = 60) -> DataFrame:
    """id, title: the short name within the budget, with a token where several products of a category would share it."""
    room = budget - len(suffix)
    short = T.short_name(F.col("name"), F.col("brand"))
    told = disambiguated(products.withColumn("_short", short).withColumn("_base", T.cap_words(short, room)), ["category", "_base"])
    with_token = F.trim(F.concat(T.cap_words(F.col("_short"), F.lit(room) - F.length("token") - 1), F.lit(" "), F.col("token")))
    return told.select("id", F.concat(F.when(F.col("token").isNull(), F.col("_base")).otherwise(with_token), F.lit(suffix)).alias("title"))


def page_descriptions(products: DataFrame, prefix: str, suffix: Column, target: int) -> DataFrame:
    """id, description: prefix, the short name and suffix in about target characters, with a token where several products would share the whole."""
    short = T.short_name(F.col("name"), F.col("brand"))
    named = products.withColumn("_short", short).withColumn("_end", suffix)
    text = lambda token: fitted(F.col("_short"), prefix, F.col("_end"), token, target)
    told = disambiguated(named.withColumn("_whole", text(F.lit(None).cast("string"))), ["_whole"])
    return told.select("id", text(F.col("token")).alias("description"))


def manifest(pages: DataFrame, previous: DataFrame, build_date: str) -> DataFrame:
    """url, hash, lastmod: a page that has the hash it had keeps its date; pages that are gone drop out."""
    now = pages.select("url", T.content_hash(F.col("html")).alias("hash"))
    was = previous.select("url", F.col("hash").alias("_hash"), F.col("lastmod").alias("_lastmod"))
    return now.join(was, "url", "left").select("url", "hash", F.when(F.col("_hash") == F.col("hash"), F.col("_lastmod")).otherwise(build_date).alias("lastmod"))


def search_index(products: DataFrame, current: DataFrame, lows: DataFrame) -> DataFrame:
    """What the typeahead reads, one row a product with a price."""
    p = products.join(current.select(F.col("product_id").alias("id"), F.col("price").alias("current_price")), "id").join(lows.select(F.col("product_id").alias("id"), "all_time_low"), "id", "left")
    return p.select("sku", "name", "slug", "category", "brand", "current_price", "all_time_low", F.concat_ws(" ", "brand", "name", "sku").alias("search"))


def length_report(pages: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """One row: shortest, longest, mean length, how many lie outside the band, and how many values several pages share."""
    by_value = pages.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.length(column))
    outside = F.coalesce(F.sum(F.when(~F.col("size").between(low, high), F.col("n"))), F.lit(0))
    return by_value.agg(F.min("size").alias("shortest"), F.max("size").alias("longest"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), outside.alias("outside"), F.count_if(F.col("n") > 1).alias("shared"))


def chunks(ids: list, size: int = 100) -> Iterator[list]:
    """ids in runs of size, as the provider takes them."""
    for i in range(0, len(ids), size):
        yield ids[i : i + size]


def only_row(found: DataFrame) -> Row | None:
    """The row of a lookup by a unique key; None without one. Two rows are an error, and no more than two are fetched."""
    rows = found.take(2)
    if len(rows) > 1:
        raise ValueError("a lookup by a unique key has found several rows")
    return rows[0] if rows else None


def sitemap_entries(static: DataFrame, products: DataFrame, product_pattern: str) -> DataFrame:
    """loc, lastmod, changefreq, priority: the static entries (loc, lastmod) that are no product pages, and those of product pages."""
    kept = static.where(~F.col("loc").rlike(product_pattern)).select("loc", "lastmod", F.lit(None).cast("string").alias("changefreq"), F.lit(None).cast("double").alias("priority"))
    return kept.union(products.select("loc", "lastmod", F.lit("daily"), F.lit(0.6)))


def page_rows(pages: DataFrame) -> DataFrame:
    """url, payload and content hash of rendered pages (url, html)."""
    return pages.select("url", F.col("html").alias("payload"), T.content_hash(F.col("html")).alias("hash"))
