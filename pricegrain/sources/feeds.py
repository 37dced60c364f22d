"""Retail feeds and landed provider files as DataFrames.

Feeds are CSV of any of four delimiters, or XML. Spark reads and splits the files; the driver sees the first line, the set of
headers and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, has, leading_number

# fixed values: header names that shops use for a field, without punctuation
SYNONYMS = {
    "name": ("name", "productname", "title", "itemname", "description"),
    "mpn": ("mpn", "manufacturerpartnumber", "mfgpart", "partnumber", "mfrpartnumber"),
    "sku": ("sku", "itemnumber", "item#", "neweggitemnumber", "productid", "id"),
    "brand": ("brand", "manufacturer", "mfg", "brandname", "manufacturername"),
    "price": ("price", "saleprice", "currentprice", "finalprice", "pricecurrent", "retailprice"),
    "url": ("url", "producturl", "link", "linkurl", "buyurl", "clickurl", "deeplink"),
    "inStock": ("instock", "availability", "available", "stock", "stockavailability", "availabilitystatus"),
    "seller": ("seller", "soldby", "shipper", "fulfilledby", "marketplace"),
}
RECORD_TAGS = ("product", "item", "offer", "entry", "record")
DELIMITERS = (",", "\t", "|", ";")
IN_STOCK = "^(y|yes|true|1|in ?stock|available)$"
OUT_OF_STOCK = "^(n|no|false|0|out ?of ?stock|unavailable)$"


def normal_header(header: str) -> str:
    return "".join(c for c in header.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789#")


def mapped_headers(headers: list[str]) -> dict[str, str]:
    """field -> the first header, in file order, that means it."""
    out: dict[str, str] = {}
    for field, names in SYNONYMS.items():
        hit = next((h for h in headers if normal_header(h) in names), None)
        if hit is not None:
            out[field] = hit
    return out


def sniffed_delimiter(line: str) -> str:
    """The delimiter that splits the header line into most parts; of equals the first of DELIMITERS."""
    return max(DELIMITERS, key=lambda d: (len(line.split(d)), -DELIMITERS.index(d)))


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row["value"].lstrip("﻿") if row else ""


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted fields may hold delimiters and line ends; blank rows are left out."""
    d = sniffed_delimiter(first_line(spark, path))
    rows = spark.read.option("sep", d).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in rows.columns]) != "")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record element, with the fields (lower-case) that any record has; the first of repeated fields counts.

    The text reader splits the file at the closing tags, so records are read in parallel.
    """
    text = spark.read.text(path)
    hits = text.agg(*[F.max(F.nullif(F.regexp_extract("value", rf"(?i)<({t})(?:[\s>]|$)", 1), F.lit(""))).alias(t) for t in RECORD_TAGS]).first()
    tag = next((hits[t] for t in RECORD_TAGS if hits and hits[t]), None)
    if tag is None:
        raise ValueError(f"no element of {RECORD_TAGS} in {path}")
    record = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0).alias("r")).where("r <> ''")
    pattern = r"(?s)<([A-Za-z_][\w:.-]*)[^>]*>(.*?)</\1>"
    clean = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", ""))
    pair = F.zip_with(F.regexp_extract_all("r", F.lit(pattern), F.lit(1)), F.regexp_extract_all("r", F.lit(pattern), F.lit(2)), lambda k, v: F.struct(F.lower(k).alias("k"), clean(v).alias("v")))
    pairs = record.select(F.filter(pair, lambda p: p["v"] != "").alias("pairs"))
    value = lambda name: F.get(F.filter("pairs", lambda p: p["k"] == name), F.lit(0))["v"]
    names = [r["k"] for r in pairs.select(F.explode("pairs.k").alias("k")).distinct().orderBy("k").collect()]
    return pairs.select(*[F.coalesce(value(n), F.lit("")).alias(n) for n in names])


def typed(rows: DataFrame) -> DataFrame:
    """name, mpn, feed_sku, brand, price, url, seller, in_stock (null: not known) of rows that have a name and a link."""
    found = mapped_headers(rows.columns)
    missing = [f for f in ("name", "price", "url") if f not in found]
    if missing:
        raise ValueError(f"no header for {missing} among {rows.columns}")
    get = lambda f: F.trim(F.coalesce(F.col(f"`{found[f]}`"), F.lit(""))) if f in found else F.lit("")
    stock = get("inStock")
    price = F.nullif(leading_number(F.regexp_replace(get("price"), "[$,]", "")), F.lit(0.0))
    out = rows.select(get("name").alias("name"), get("mpn").alias("mpn"), get("sku").alias("feed_sku"), get("brand").alias("brand"), price.alias("price"), get("url").alias("url"), get("seller").alias("seller"), F.when(has(stock, IN_STOCK), True).when(has(stock, OUT_OF_STOCK), False).alias("in_stock"))
    return out.where("name <> '' and url <> ''")


def load_feed(spark: SparkSession, path: str) -> DataFrame:
    """A typed feed; XML if the text begins with '<'."""
    return typed(read_xml(spark, path) if first_line(spark, path).lstrip().startswith("<") else read_delimited(spark, path))


# ------------------------------------------------------------------------------------------------ landed files

ITEM = "struct<asin:string,id:string,name:string,title:string,min_price:string,price:string,max_price:string,image_url:string,image:string>"
DOWNLOAD = f"query_idx int, category string, free_credits string, paid_credits string, results array<struct<content:struct<search_results:array<{ITEM}>,products:array<{ITEM}>>>>"
PROVIDER = "asin string, parentAsin string, csv array<array<bigint>>, stats struct<current:array<bigint>,max:array<array<bigint>>>"


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """asin, name, category, prices, image, query_idx and pos of every result of downloaded jobs (JSON lines)."""
    jobs = spark.read.schema(DOWNLOAD).json(path)
    listed = jobs.select("query_idx", "category", F.posexplode("results").alias("block", "r"))
    items = listed.select("query_idx", "category", "block", F.posexplode(F.coalesce("r.content.search_results", "r.content.products")).alias("at", "i"))
    f = lambda *names: first_filled(*[F.col(f"i.{n}") for n in names])
    return items.select(f("asin", "id").alias("asin"), f("name", "title").alias("name"), "category", "i.min_price", "i.price", "i.max_price", f("image_url", "image").alias("image_url"), "query_idx", (F.col("block") * 10_000 + F.col("at")).alias("pos"))


def credits(downloads: DataFrame) -> DataFrame:
    """One row: the sums of what jobs cost; what isn't a number counts nothing."""
    total = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0)).alias(c)
    return downloads.agg(total("free_credits"), total("paid_credits"), F.count(F.lit(1)).alias("jobs"))


def job_credits(reports: DataFrame) -> DataFrame:
    """query_idx, free_credits, paid_credits of each job from its reports (query_idx, pos, free_credits, paid_credits as text): of each field the last that is a number, else 0."""
    last = lambda c: F.coalesce(F.max_by(F.col(c).try_cast("double"), F.when(F.col(c).try_cast("double").isNotNull(), F.col("pos"))), F.lit(0.0)).alias(c)
    return reports.groupBy("query_idx").agg(last("free_credits"), last("paid_credits"))


def job_report(jobs: DataFrame) -> DataFrame:
    """One row of jobs (error: null if it went well): ok, failed, and what the good ones cost."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0)).alias(c)
    return jobs.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), total("free_credits"), total("paid_credits"))


def database_rows(products: DataFrame, columns: list[str], retailer: str) -> DataFrame:
    """columns of products with '' as null; retailer where a product names none."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    named = [text(c).alias(c) if dict(products.dtypes)[c] == "string" else F.col(c) for c in columns if c != "retailer"]
    own = text("retailer") if "retailer" in products.columns else F.lit(None).cast("string")
    return products.select(*named, F.coalesce(own, F.lit(retailer)).alias("retailer"))


def provider_products(spark: SparkSession, path: str) -> DataFrame:
    """Provider products landed as JSON lines."""
    return spark.read.schema(PROVIDER).json(path)


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact; without one no rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def parent_of(products: DataFrame, artifact: DataFrame) -> DataFrame:
    """products with parent: their own column, or the artifact's (sku, parent) if the column is missing or all null."""
    if "parent" in products.columns and not products.where(F.col("parent").isNotNull()).isEmpty():
        return products
    return products.drop("parent").join(artifact.select("sku", "parent").dropDuplicates(["sku"]), "sku", "left")


def retail_products(raw: DataFrame) -> DataFrame:
    """Columns of the dormant retail source as catalog columns; falsy values are null."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    price: Column = F.coalesce(F.nullif(F.col("salePrice"), F.lit(0.0)), F.nullif(F.col("regularPrice"), F.lit(0.0)))
    return raw.select(text("sku").alias("sku"), text("name").alias("name"), text("manufacturer").alias("brand"), text("modelNumber").alias("model"), text("image").alias("image_url"), text("url").alias("product_url"), price.alias("price"), F.nullif(F.col("regularPrice"), F.lit(0.0)).alias("regular_price"), F.coalesce("onlineAvailability", F.lit(False)).alias("in_stock"))
