"""Text files as lines, documents as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.text import strip, strip_ruby


def own_lines(text: Column) -> Column:
    """The stripped lines of a text with anything in them, as an array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip), lambda x: x != "")


def document_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, pos, raw, pure): the stripped lines with anything in them, and the same without ruby."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(own_lines(F.col(text))).alias("pos", "raw")).withColumn("pure", strip(strip_ruby(F.col("raw"))))


def read_text_lines(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(doc, pos, raw, pure) for each file below `root`, one document for each."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return document_lines(files.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text")))


def write_documents(docs: DataFrame, path: str, book: str = "book", kind: str = "parquet", text: Column | str = "text") -> None:
    """One document for each row, in a folder for each book; kind 'text' writes the text alone."""
    by_book = docs.repartition(book)
    if kind == "text":
        by_book = by_book.select(book, F.col(text) if isinstance(text, str) else text)
    by_book.write.mode("overwrite").partitionBy(book).format(kind).save(path)
