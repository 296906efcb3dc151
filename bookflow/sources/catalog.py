"""The catalogue's nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.text import in_order

BOOK = "struct<title:string,page:string,link:map<string,string>,new:boolean>"
LOG = "struct<action:string,timestamp:long,details:struct<total:long,increment:long>>"
CATALOG = f"logs array<{LOG}>, items map<string,map<string,array<{BOOK}>>>"


def read_catalog(spark: SparkSession, path: str, month: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: books (month, day, label, ord, title, page, link, new) and logs (month, ord, action, ts_ms, total, increment).

    Each file holds a month; where `month` is not given, it is the name of the file's folder or file.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:/data)?\.json$", 1) if month is None else F.lit(month)
    return flatten_catalog(spark.read.text(path, wholetext=True).select(name.alias("month"), F.col("value").alias("json")))


def flatten_catalog(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: the books and logs of (month, json)."""
    raw = texts.select("month", F.from_json("json", CATALOG).alias("c"))
    days = raw.select("month", F.posexplode("c.items").alias("d", "day", "labels"))
    labels = days.select("month", "d", "day", F.posexplode("labels").alias("l", "label", "books"))
    books = labels.select("month", F.col("day").cast("int").alias("day"), "label", "d", "l", F.posexplode("books").alias("b", "book"))
    # d, l and b are places in the file: three parts of one ordinal, of 15, 16 and 32 bits
    ordinal = F.shiftleft(F.col("d").cast("long"), 48) + F.shiftleft(F.col("l").cast("long"), 32) + F.col("b")
    flat = books.select("month", "day", "label", ordinal.alias("ord"), "book.title", "book.page", "book.link", "book.new")
    logs = raw.select("month", F.posexplode("c.logs").alias("ord", "log"))
    return flat, logs.select("month", "ord", "log.action", F.col("log.timestamp").alias("ts_ms"), "log.details.total", "log.details.increment")


def catalog_json(books: DataFrame, logs: DataFrame) -> DataFrame:
    """(month, json): the catalogue of each month as one nested JSON text; a month without books is written too."""
    one = F.struct("ord", F.struct("title", "page", "link", "new").alias("book"))
    labels = books.groupBy("month", "day", "label").agg(F.min("ord").alias("first"), in_order(F.collect_list(one), "ord").alias("own"))
    labels = labels.select("month", "day", "first", F.struct("first", "label", F.transform("own", lambda s: s["book"]).alias("books")).alias("entry"))
    days = labels.groupBy("month", "day").agg(F.min("first").alias("first"), in_order(F.collect_list("entry"), "first").alias("own"))
    days = days.select("month", F.struct("first", F.col("day").cast("string").alias("day"), F.map_from_entries(F.transform("own", lambda s: F.struct(s["label"], s["books"]))).alias("labels")).alias("entry"))
    months = days.groupBy("month").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("entry.first", "entry.day", F.to_json("entry.labels").alias("labels")))), lambda s: F.struct(s["day"], s["labels"]))).alias("items"))
    items = F.transform(F.map_entries("items"), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    text = months.select("month", F.concat(F.lit("{"), F.array_join(F.transform(items, lambda s: F.regexp_replace(s, r'^\["(.*?)"\]', '"$1"')), ","), F.lit("}")).alias("items"))
    log = F.struct("ord", F.struct("action", F.col("ts_ms").alias("timestamp"), F.struct("total", "increment").alias("details")).alias("log"))
    rows = logs.groupBy("month").agg(F.to_json(F.transform(F.array_sort(F.collect_list(log)), lambda s: s["log"])).alias("logs"))
    both = rows.join(text, "month", "full")
    return both.select("month", F.concat(F.lit('{"logs":'), F.coalesce("logs", F.lit("[]")), F.lit(',"items":'), F.coalesce("items", F.lit("{}")), F.lit("}")).alias("json"))


def write_catalog(books: DataFrame, logs: DataFrame, path: str) -> None:
    """One JSON file in a folder for each month."""
    catalog_json(books, logs).repartition("month").write.mode("overwrite").partitionBy("month").text(path)
