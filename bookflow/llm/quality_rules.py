"""Operator 6, native: rules on each text, and a verdict on each host from the rates at which its texts fail them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, let, lookup, table, words

#: Rules whose failures are counted by host, with the share of failing texts that a host must surely exceed.
RULES = (("short", 0.5), ("repeat", 0.5), ("symbol", 0.5), ("lines", 0.5))
#: Standard deviations of the posterior by which the shrunk rate must exceed the limit.
SURE = 3.0


def repeated_words(w: Column) -> Column:
    """Words of `w` that lie in a 3-word window found twice or more in `w`.

    Windows are compared by 64-bit hashes. Sorted together with their places, equal windows are neighbours;
    each repeated place covers three words, less what the next repeated place covers again.
    """

    def covered(keyed: Column) -> Column:
        last = F.size(keyed)
        key = lambda k: F.element_at(keyed, k)["h"]
        again = lambda k: ((k > 1) & (key(F.greatest(k - 1, F.lit(1))) == key(k))) | ((k < last) & (key(F.least(k + 1, last)) == key(k)))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), last), again), lambda k: F.element_at(keyed, k)["at"]))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["end"])).alias("n"), p.alias("end"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    def of(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keyed, covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. Null texts have no words."""
    body = F.coalesce(F.col(text), F.lit(""))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"))

    def doubled(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.withColumn("_w", let(words(body), counted))
        .withColumns({
            "n_words": F.col("_w.n").cast("long"),
            "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(lines, doubled).cast("long"),
            "n_repeat_words": F.col("_w.again").cast("long"),
        })
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_w")
    )


def failures(measured: DataFrame) -> DataFrame:
    """With a column fail_<rule> (0 or 1) for each of RULES."""
    n = F.col("n_words")
    return measured.withColumns({
        "fail_short": (n < 50).cast("int"),
        "fail_repeat": (100 * F.col("n_repeat_words") > 50 * n).cast("int"),
        "fail_symbol": (10 * F.col("n_symbols") > n).cast("int"),
        "fail_lines": (F.col("n_dup_lines") > 5).cast("int"),
    })


def host_verdicts(failed: DataFrame, host: str = "source") -> DataFrame:
    """For each host: n_docs, for each rule the shrunk failure rate, and host_ok.

    The beta prior of a rule has the mean of all texts and the spread of the hosts' rates, by moments weighted
    with the hosts' sizes; it is worth 1 to 1000 texts. A host is not ok if for some rule its posterior rate
    exceeds the limit by SURE standard deviations. Texts without a host (null) form one host.
    """
    names = [r for r, _ in RULES]
    hosts = failed.groupBy(F.coalesce(F.col(host), F.lit("")).alias("_host")).agg(F.count("*").alias("n_docs"), *[F.sum(f"fail_{r}").alias(f"f_{r}") for r in names])
    hosts = cut(hosts)
    n = F.col("n_docs")
    # one row: for each rule the mean, and the mean squared rate
    prior = hosts.agg(F.sum("n_docs").alias("_n"), F.count("*").alias("_hosts"), *[x for r in names for x in (F.sum(f"f_{r}").alias(f"_s_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"_q_{r}"))])
    scored = hosts.crossJoin(F.broadcast(prior))  # one row on the right
    bad = F.lit(False)
    for r, limit in RULES:
        mean = F.col(f"_s_{r}") / F.col("_n")
        spread = F.greatest(F.col(f"_q_{r}") / F.col("_n") - mean * mean, F.lit(0.0))
        # variance of the rates beyond what drawing n texts gives
        chance = mean * (1 - mean) * F.col("_hosts") / F.col("_n")
        true = F.greatest(spread - chance, F.lit(1e-9))
        worth = F.least(F.greatest(mean * (1 - mean) / true - 1, F.lit(1.0)), F.lit(1000.0))
        a, b = mean * worth + F.col(f"f_{r}"), (1 - mean) * worth + n - F.col(f"f_{r}")
        rate = a / (a + b)
        scored = scored.withColumn(f"rate_{r}", rate)
        bad = bad | ((rate - SURE * F.sqrt(rate * (1 - rate) / (a + b + 1))) > limit)
    return scored.select("_host", "n_docs", *[f"rate_{r}" for r in names], (~bad).alias("host_ok"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: key, host, the measures, base_failed, host_ok and kept.

    kept is false if base_failed, else the host's verdict. Null and empty texts fail as short. An empty table
    gives no rows; other columns are ignored; repeated rows are judged alike, each counting for its host.
    """
    measured = failures(measure(docs.select(key, F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text"))
    measured = cut(measured)
    verdicts = cut(host_verdicts(measured, "_host").select("_host", "n_docs", "host_ok"))
    joined = lookup(measured, verdicts, "_host", "n_docs").withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
    return joined.withColumnRenamed("_host", "host").drop(*[f"fail_{r}" for r, _ in RULES])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok")


SQL = r"""
WITH w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w WHERE len(w) >= 3),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_words < 50 AS INTEGER) AS f1, CAST(100 * n_repeat_words > 50 * n_words AS INTEGER) AS f2, CAST(10 * n_symbols > n_words AS INTEGER) AS f3, CAST(n_dup_lines > 5 AS INTEGER) AS f4 FROM m),
h AS (SELECT source, rule, count(*) AS n, sum(fail) AS k FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS fail FROM f) GROUP BY source, rule),
t AS (SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS square, count(*) AS hosts, sum(n) AS total FROM h GROUP BY rule),
v AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(greatest(square - mean * mean, 0) - mean * (1 - mean) * hosts / total, 1e-9) - 1, 1), 1000) AS worth FROM t),
s AS (SELECT source, n + worth AS size, (mean * worth + k) / (n + worth) AS rate FROM h JOIN v USING (rule)),
o AS (SELECT source, NOT bool_or(rate - 3 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5) AS host_ok FROM s GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_ok FROM f JOIN o USING (source)
"""
