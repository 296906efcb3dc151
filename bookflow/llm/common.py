"""What several operators share: tables cut from their lineage, and joins that stand skewed keys."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.sources.shared import cut as cut

#: Word separators of the contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Most rows of a table that is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Keys that get the broadcast way in `lookup`; a fixed bound at any input size.
HEAVY_KEYS = 512

@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python workers `rows` at a time in jobs that run inside; outside, Spark's bound on a batch's bytes holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return memory that Arrow's and the C library's allocators keep free to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # C libraries other than glibc have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """`run` for mapInArrow; at the end of a task its worker, which lives on beside later work, gives free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether `df` (a cut table) has at most `most` rows."""
    return df.count() <= most


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it was counted to have at most `most` rows. `df` should be a cut, narrow table."""
    return F.broadcast(df) if few(df, most) else df


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join on `key`, unique in `right`, where some keys may hold a large part of `left`.

    The HEAVY_KEYS keys of most `weight` are joined by a broadcast of that many rows; all others, none of
    which can then hold more than 1/HEAVY_KEYS of the rows, by a shuffle. `left` is read twice, so it
    should be a cut, narrow table. Null keys find nothing. `weight` is not in the result.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    heavy = right.orderBy(F.desc(weight), F.desc(key)).limit(HEAVY_KEYS).select(key, *values, F.lit(True).alias("_heavy"))
    heavy = cut(heavy)
    marked = left.join(F.broadcast(heavy), key, "left")
    found = marked.filter((F.col("_heavy")) | F.col(key).isNull()).drop("_heavy")
    light = right.join(F.broadcast(heavy.select(key)), key, "left_anti").drop(weight)
    rest = left.filter(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return found.unionByName(rest.select(found.columns))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once for a row, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n
