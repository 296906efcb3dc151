"""Operator 3, native: benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.catalog import among

from .common import BROADCAST_ROWS, cut, few, let, sized, table

#: Words in a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.8
#: Ranges of hashes that items' sketches mark: 2 MB of bits, whatever the items.
RANGES = 1 << 24
#: Tasks that share the documents with one shingle, where items are too many to be broadcast.
SALTS = 16


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: int, of) -> Column:
    """`of` over every run of `n` words of `w`; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: of([F.element_at(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, runs)


def hashed(run: list[Column]) -> Column:
    """The minwise hash of a shingle."""
    return F.xxhash64(*run)


def spelt(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, s, h) for each distinct shingle of each item; an item of fewer words than SHINGLE is one shingle of all its words."""
    one = lambda n: lambda run: F.struct(F.lit(n).alias("n_words"), spelt(run).alias("s"), hashed(run).alias("h"))

    def own(w: Column) -> Column:
        return F.coalesce(shingles(w, SHINGLE, one(SHINGLE)), *[F.when(F.size(w) == n, shingles(w, n, one(n))) for n in range(1, SHINGLE)])

    rows = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", F.explode(let(tokens(F.col("text")), own)).alias("g"))
    return rows.select("item_id", "g.n_words", "g.s", "g.h").distinct()


def doc_shingles(text: Column, lengths: list[int], of) -> Column:
    """The distinct shingles of a text, of each of the lengths that items have."""

    def own(w: Column) -> Column:
        parts = [F.coalesce(shingles(w, n, of), F.filter(F.transform(w, lambda x: of([x])), lambda x: F.lit(False))) for n in lengths]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return F.array_distinct(let(tokens(text), own))


def sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The minwise sketches of items (item_id, h array): (item_id, need, h), partitioned by size.

    The items of a partition have sizes in [2^k, 2^(k+1)). If one of its largest size may lack m shingles, each
    keeps its 2 * m + 1 smallest hashes. A document that holds enough of an item lacks no more of the sketch than
    the item may lack in all, so that it holds `need` of them at least: the estimate from the sketch misses nothing.
    """
    size = F.size("h")
    lack = lambda n: F.floor(n * F.lit(1 - contained) + 1e-9)
    largest = F.least(F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) + 1) - 1, F.lit(float(1 << 30)))
    keep = F.least(size, (2 * lack(largest) + 1).cast("int"))
    need = (keep - lack(size.cast("double"))).cast("int")
    return items.filter(size > 0).select("item_id", need.alias("need"), F.explode(F.slice(F.sort_array("h"), F.lit(1), keep)).alias("h"))


def probes(rows: DataFrame, sketch: DataFrame, lengths: list[int]) -> DataFrame:
    """(_key, h): the minwise hashes of documents (_key, _text) that may lie in an item's sketch.

    The sketches of all sizes' partitions mark narrow ranges of hashes, of which there are RANGES; a
    document is asked for its hashes in marked ranges alone. What is left is as much as documents and items share,
    and of all else about (rows of `sketch`) / RANGES, before anything is shuffled.
    """
    hashes = rows.select("_key", F.explode(doc_shingles(F.col("_text"), lengths, hashed)).alias("h"))
    return among(hashes, sketch, "h", RANGES)


def met(left: DataFrame, right: DataFrame, key: str, small: bool) -> DataFrame:
    """The inner join of rows (_key, `key`) with a table of items: broadcast if that is small, else with each of its keys dealt to SALTS tasks."""
    if small:
        return left.join(F.broadcast(right), key)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", contained: float = CONTAINED, most: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (key, item_id, n_shingles of the item, n_found, containment) with at least `contained` of the item's shingles in the text.

    An item of fewer words than SHINGLE is found wherever its words stand in a row. Null and empty texts and items
    give no pair. Rows of `docs` that share a key count as one document, so repeated rows add nothing; rows without
    a key are left out. Items of the same id count as one item. A text of any length is one row's work until its
    distinct shingles are apart; there are no ties. Other columns are ignored.
    """
    bench = cut(item_shingles(benchmark))
    lengths = sorted(r["n_words"] for r in bench.select("n_words").distinct().collect()) or [SHINGLE]  # SHINGLE rows at most
    sketch = cut(sketches(bench.groupBy("item_id").agg(F.collect_list("h").alias("h")), contained))
    small = few(bench, most)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_key").isNotNull())

    found = met(probes(rows, sketch, lengths), sketch, "h", small).groupBy("_key", "item_id", "need").agg(F.count_distinct("h").alias("n"))
    found = cut(found.filter("n >= need").select("_key", "item_id"))

    # exact containment, over the candidates alone
    ids = cut(found.select("_key").distinct())
    texts = rows.join(sized(ids, most), "_key", "left_semi")
    held = texts.select("_key", F.explode(doc_shingles(F.col("_text"), lengths, spelt)).alias("s"))
    sizes = bench.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    wanted = cut(bench.select("item_id", "s").join(sizes, "item_id"))
    exact = met(held, wanted, "s", small).join(found, ["_key", "item_id"], "left_semi")
    exact = exact.groupBy("_key", "item_id", "n_shingles").agg(F.count_distinct("s").alias("n_found"))
    share = F.col("n_found") / F.col("n_shingles")
    return exact.filter(share >= contained - 1e-12).select(F.col("_key").alias(key), "item_id", "n_shingles", "n_found", share.alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no item leaks; rows without a doc_id stay."""
    bad = cut(leaks(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(sized(bad), "doc_id", "left_anti").select(docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' ')))"
SQL = rf"""
WITH b AS (SELECT DISTINCT item_id, k, unnest({_SHINGLES}) AS s FROM (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) WHERE k > 0),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= k THEN {_SHINGLES} ELSE [] END) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8 - 1e-12
"""
