"""Operator 10: lines that spread over many sites, by HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, few, lookup, sized, table, tidy

#: Distinct sites from which a line counts as boilerplate.
SITES = 8
#: lg of the sketches' buckets: a relative error of about 1.04 / sqrt(2^10), 3 %.
LG_BUCKETS = 10
#: Estimates within this share of the threshold are replaced by exact counts: over five standard errors.
NEAR = 0.2
#: Rows whose lines a task takes apart at a time.
PORTION = 1000
#: Most lines of a table that tasks get whole.
TABLE_ROWS = 200_000


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE}|{SPACE}$", "")


def site_lines(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """(h, _site, _key) for each line with a word: 64-bit hashes of the trimmed line and of the site (null: one site of its own), and the key."""
    own = docs.select(F.xxhash64(F.coalesce(F.col(site), F.lit(""))).alias("_site"), F.col(key).alias("_key"), F.explode(F.split(F.col(text), "\n", -1)).alias("_line"))
    own = own.select("_site", "_key", trimmed(F.col("_line")).alias("_line")).filter(F.col("_line") != "")
    return own.select(F.xxhash64("_line").alias("h"), "_site", "_key")


def spread_lines(docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source", key: str = "doc_id", most: int = TABLE_ROWS) -> DataFrame:
    """The lines found on `sites` distinct sites or more: h (64-bit hash of the trimmed line), n_sites, first_key.

    Lines without a word do not count; texts without a site form one site of their own. first_key is the
    smallest key of a document with the line, null if it is in documents without a key alone: there the line stays.
    """
    lines = site_lines(docs, text, site, key)
    # most lines occur once; a line that occurs less than `sites` times, or on one site only, needs no sketch
    met = lines.groupBy("h").agg(F.min("_site").alias("low"), F.max("_site").alias("high"), F.count("*").alias("n"))
    met = cut(met.filter((F.col("low") != F.col("high")) & (F.col("n") >= sites)).select("h", "n"))
    if few(met, most):
        held = lines.join(F.broadcast(met.select("h")), "h")
    else:
        held = lookup(cut(lines), met.withColumn("_met", F.lit(True)), "h", "n").filter("_met").drop("_met")
    held = cut(held)
    # one sketch for each line, of its sites: made in the tasks, merged behind the shuffle
    sketched = held.groupBy("h").agg(F.min("_key").alias("first_key"), F.hll_sketch_agg("_site", LG_BUCKETS).alias("_hll"))
    spread = cut(sketched.select("h", "first_key", F.hll_sketch_estimate("_hll").alias("n_sites")))
    sure = spread.filter(F.col("n_sites") > sites * (1 + NEAR))
    unsure = spread.filter(F.col("n_sites").between(sites * (1 - NEAR), sites * (1 + NEAR))).select("h", "first_key")
    exact = held.select("h", "_site").distinct().join(sized(cut(unsure)), "h").groupBy("h", "first_key").agg(F.count("*").alias("n_sites"))
    return sure.select("h", "n_sites", "first_key").unionByName(exact.filter(F.col("n_sites") >= sites))


def _remover(bad: dict, text: int, key: int):
    """Rows without the lines in `bad`, but for the document that keeps them."""
    digest = xxhash.xxh64_intdigest

    def clean(row_text: str | None, row_key) -> tuple[str | None, int, int]:
        if row_text is None:
            return None, 0, 0
        lines, out = row_text.split("\n"), []
        for line in lines:
            stripped = line.strip(" \t\n\x0b\x0c\r")
            if stripped:
                first = bad.get(digest(stripped.encode("utf-8", "surrogatepass"), 42), bad)
                if first is not bad and first != row_key:
                    continue
            out.append(line)
        return "\n".join(out), len(lines), len(lines) - len(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, PORTION) for b in batches for low in range(0, len(b), PORTION)):
            # Arrow keeps ids whole where some are null; pandas would make them floats
            done = [clean(t, k) for t, k in zip(batch.column(text).to_pylist(), batch.column(key).to_pylist(), strict=True)]
            columns = batch.columns
            columns[text] = pa.array([d[0] for d in done], batch.schema.field(text).type)
            counts = [pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*batch.schema.names, "_lines", "_removed"])

    return run


def drop_spread_lines(docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source", key: str = "doc_id", most: int = TABLE_ROWS) -> DataFrame:
    """`docs` with the spread lines taken out of `text`, and with _lines and _removed, the counts before and of the removed.

    A removed line stays in the document of smallest key that has it, each time it occurs there. Null texts stay
    null with 0 lines; empty texts are one line; documents without a key keep no line that one with a key has.
    Rows of one key count as one document, and repeated rows are cleaned alike. Columns named _lines or _removed
    are replaced, all others are kept as they are. A table of at most `most` spread lines goes to the tasks
    whole; beyond it documents meet it in a join, with the same result.
    """
    docs = docs.drop("_lines", "_removed")
    bad = cut(spread_lines(docs, sites, text, site, key, most))
    if few(bad, most):
        got = bad.select("h", "first_key").toArrow()  # counted above: bounded
        lines = docs.sparkSession.sparkContext.broadcast(dict(zip((h % 2**64 for h in got["h"].to_pylist()), got["first_key"].to_pylist(), strict=True)))
        at_text, at_key = docs.columns.index(text), docs.columns.index(key)

        def run(batches):
            yield from _remover(lines.value, at_text, at_key)(batches)

        schema = docs.withColumns({"_lines": F.lit(0).cast("long"), "_removed": F.lit(0).cast("long")}).schema
        return docs.mapInArrow(tidy(run), schema)
    # rows are told apart by key and text; the user's columns travel in a struct, where no name can clash
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_id"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    own = cut(rows.select("_key", "_id", F.explode(F.array_distinct(F.transform(F.split("_text", "\n", -1), lambda x: F.xxhash64(trimmed(x))))).alias("h")))
    met = lookup(own, bad.withColumn("_bad", F.lit(True)), "h", "n_sites").filter(F.col("_bad") & ~F.col("_key").eqNullSafe(F.col("first_key")))
    gone = met.groupBy(F.col("_key").alias("_k"), F.col("_id").alias("_i")).agg(F.collect_set("h").alias("_gone"))
    joined = rows.join(gone, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i")), "left")
    lines = F.split("_text", "\n", -1)
    kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("_gone", F.xxhash64(trimmed(x)))))
    joined = joined.withColumn("_kept", kept)
    return joined.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


SQL = r"""
WITH l AS (SELECT doc_id, source, i, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
           FROM (SELECT doc_id, text, coalesce(source, '') AS source, 1 AS i FROM documents)),
t AS (SELECT doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l),
bad AS (SELECT s, min(doc_id) AS first_key FROM t WHERE s <> '' GROUP BY s HAVING count(DISTINCT source) >= 8)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_key <> doc_id) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_key IS NULL OR first_key = doc_id), '') AS text
FROM t LEFT JOIN bad USING (s) GROUP BY doc_id
"""
