"""Running values in order over rows of a key, where one key may hold a large part of all rows.

A window puts all rows of a key in one task. Here the rows of keys with more than `most` rows are dealt by ranges of
(key, order), so that a key lies in many blocks; each block is scanned by itself, one row for each key and block is
scanned over the blocks, and what it carries is joined back. All other keys go through the same window as one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.sources.shared import cut

#: Rows of a key beyond which it is split. At most one key in so many rows is, so the list of them is small.
MOST = 1_000_000


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of keys in which null is a key like any other."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def blocks(rows: DataFrame, keys: list[str], order: list[str], most: int = MOST) -> DataFrame:
    """`rows` with `_block`: 0 for keys of at most `most` rows; else from 1 on, in the order of a key's rows.

    Keys are counted with partial sums. The rows of split keys are written once, as the blocks must not change.
    """
    hot = cut(rows.groupBy(*keys).count().filter(F.col("count") > most))
    total = hot.agg(F.sum("count")).first()[0]
    if not total:
        return rows.withColumn("_block", F.lit(0))
    hot, parts = hot.select(*keys), 2 * -(-total // most)
    on = same("_r", "_h", keys)
    rest = rows.alias("_r").join(F.broadcast(hot.alias("_h")), on, "left_anti").withColumn("_block", F.lit(0))
    large = rows.alias("_r").join(F.broadcast(hot.alias("_h")), on, "left_semi").repartitionByRange(parts, *keys, *order)
    return rest.unionByName(cut(large.withColumn("_block", F.spark_partition_id() + 1)))


def scan_blocks(blocked: DataFrame, keys: list[str], order: list[str], adds: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """`scan` for rows that have their `_block`, which stays."""
    adds, lasts = adds or {}, lasts or {}
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    own = blocked.withColumns({k: F.sum(c).over(inside) for k, c in adds.items()} | {k: F.last(c, ignorenulls=True).over(inside) for k, c in lasts.items()})
    split = blocked.filter("_block > 0")
    place = F.struct(*order)
    ends = split.groupBy(*keys, "_block").agg(
        *(F.sum(c).alias(f"_{k}") for k, c in adds.items()),
        *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_{k}") for k, c in lasts.items()),
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", *(F.sum(f"_{k}").over(before).alias(f"_{k}") for k in adds), *(F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}") for k in lasts))
    both = own.alias("_o").join(carried.alias("_c"), same("_o", "_c", [*keys, "_block"]), "left")
    whole = {k: F.coalesce(F.col(f"_c._{k}") + F.col(f"_o.{k}"), F.col(f"_o.{k}"), F.col(f"_c._{k}")) for k in adds} | {k: F.coalesce(f"_o.{k}", f"_c._{k}") for k in lasts}
    return both.select(*(F.col(f"_o.{c}") for c in blocked.columns if c not in whole), *(c.alias(k) for k, c in whole.items()))


def scan(rows: DataFrame, keys: list[str], order: list[str], adds: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, most: int = MOST) -> DataFrame:
    """`rows` with running values over each key's rows in `order`, the row itself included.

    adds: for each new column what is summed; lasts: for each new column that whose latest value is taken that is not
    null. Null keys are a key. The order should be total; equal rows of it count as one step of a sum.
    """
    blocked = blocks(rows, keys, order, most)
    return scan_blocks(blocked, keys, order, adds, lasts).drop("_block")


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "number", start: int = 1, most: int = MOST) -> DataFrame:
    """`rows` with `out`: their place in each key's order from `start` on, without gaps even where the order has ties."""
    blocked = blocks(rows, keys, order, most)
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    own = blocked.withColumn(out, F.row_number().over(inside).cast("long"))
    ends = blocked.filter("_block > 0").groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", F.sum("_n").over(before).alias("_n"))
    both = own.alias("_o").join(carried.alias("_c"), same("_o", "_c", [*keys, "_block"]), "left")
    return both.select(*(F.col(f"_o.{c}") for c in rows.columns if c != out), (F.col(f"_o.{out}") + F.coalesce("_c._n", F.lit(0)) + (start - 1)).alias(out))
