"""Operator 7, native: shards by jump consistent hashing, with gapless slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Pieces that each shard is numbered in. shards * PIECES rows of counts are all that is broadcast.
PIECES = 512


def jump(key: Column, shards: int) -> Column:
    """(b, j) of Lamping and Veach's jump consistent hash: b is the bucket among `shards`, j the next jump target.

    The draws are xxhash64(key, step) instead of the paper's 64-bit generator, whose products overflow.
    With one more bucket a key moves only if j == shards, and then to the new bucket.
    """
    state = lambda b, j: F.struct(b.cast("long").alias("b"), j.cast("long").alias("j"))

    def step(s: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33)
        return F.when(s["j"] >= shards, s).otherwise(state(s["j"], F.floor((s["j"] + 1) * (F.lit(2.0**31) / (draw + 1)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state(F.lit(-1), F.lit(0)), step)


def shard(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", pieces: int = PIECES) -> DataFrame:
    """Shards 0 to `shards` - 1 by `key` alone, one row for each row of `docs`.

    Returns key, size (UTF-8 bytes of the text plus 8; 8 for null), text_crc32 (unsigned; of an empty text for
    null), law ('key'), shard, slot (gapless from 0 in each shard), grown_shard (with one shard more).
    Rows of the same key share a shard; a null key is a key like any other. An empty table gives no rows.
    Slots are dealt in pieces of a shard, picked by key and text, so that no task numbers a whole shard;
    repeated rows get slots of their own. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump(F.xxhash64(F.col(key)), shards).alias("_jump"),
    )
    rows = rows.select(
        key, "size", "text_crc32",
        F.col("_jump.b").cast("int").alias("shard"),
        F.when(F.col("_jump.j") == shards, F.lit(shards)).otherwise(F.col("_jump.b")).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(pieces)).cast("int").alias("_piece"),
    )
    counts = rows.groupBy("shard", "_piece").count()
    before = counts.select("shard", "_piece", (F.sum("count").over(W.partitionBy("shard").orderBy("_piece")) - F.col("count")).alias("_before"))
    place = F.row_number().over(W.partitionBy("shard", "_piece").orderBy(key, "text_crc32", "size")) - 1
    return (
        rows.withColumn("_place", place)
        .join(F.broadcast(before), ["shard", "_piece"])  # at most shards * pieces rows
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
    )


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)
