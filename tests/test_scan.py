"""Running values where a key is split over blocks, against plain loops and against the unsplit way."""

import random

import pytest
from pyspark.sql import functions as F

from bookflow.operators import catalog, chapters, layout, scan, segments


def rows_of(spark, n, keys, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice(keys), rnd.randrange(n), i, rnd.choice([None, 1, 2, 5]), rnd.choice([None, None, "x", "y"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, tie long, v long, s string").repartition(5)


@pytest.mark.parametrize("most", [10, 300, 10**6])
def test_running_values(spark, most):
    rows, df = rows_of(spark, 4000, ["hot"] * 20 + ["b", "c", None, None])
    got = {r.tie: (r.total, r.latest, r.n) for r in scan.numbered(scan.scan(df, ["k"], ["at", "tie"], {"total": F.col("v")}, {"latest": F.col("s")}, most), ["k"], ["at", "tie"], "n", 5, most).collect()}
    want, state = {}, {}
    for k, _, tie, v, s in sorted(rows, key=lambda r: (r[1], r[2])):
        total, latest, n = state.get(k, (None, None, 4))
        total = total if v is None else (total or 0) + v
        state[k] = want[tie] = (total, latest if s is None else s, n + 1)
    assert got == want


def test_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 2)] * 3, "k string, at int")
    assert sorted(r.n for r in scan.numbered(df, ["k"], ["at"], "n", most=50).filter("k = 'a'").collect()) == list(range(1, 501))
    assert scan.scan(df.filter("at > 9"), ["k"], ["at"], {"n": F.lit(1)}).count() == 0


def test_a_hot_key_lies_in_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    blocked = scan.blocks(df, ["k"], ["at"], 100_000)
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 400_000 and sum(sizes) == 1_000_000
    last = scan.scan_blocks(blocked, ["k"], ["at"], {"n": F.lit(1)}).agg(F.max("n"), F.count_if(F.col("n") == F.col("at") + 1)).first()
    assert tuple(last) == (1_000_000, 1_000_000)


def same_rows(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_context_of_a_long_document(spark):
    rnd = random.Random(4)
    own = {d: ["文" * rnd.choice([1, 1, 2, 3, 30, 300]) for _ in range(n)] for d, n in (("long", 3000), ("short", 20), ("two", 1200))}
    own["empty lines"] = [""] * 1500
    lines = spark.createDataFrame([(d, i, x) for d, xs in own.items() for i, x in enumerate(xs)], "doc string, pos int, pure string").repartition(3)
    same_rows(segments.trailing_context(lines, 256, most=500), segments.trailing_context(lines, 256))


def test_long_books_and_titles(spark):
    rnd = random.Random(8)
    tabs = [(d, i // 50, i, rnd.choice(["chapter", *["episode"] * 30]), f"t{i}", f"h{i}") for d, n in (("a", 2500), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(tabs, "doc string, page int, pos int, kind string, text string, href string")
    same_rows(catalog.episodes(df, most=200), catalog.episodes(df))
    pages = [(d, p, rnd.random() < 0.3, [(rnd.choice(["第1话", "第一章", "正文", "后记"]), rnd.choice([10, 101])) for _ in range(rnd.randint(0, 3))]) for d, n in (("a", 900), ("b", 9)) for p in range(n)]
    ocr = spark.createDataFrame(pages, "doc string, page int, new boolean, lines array<struct<words:string,left:int>>")
    same_rows(layout.merge_ocr(ocr, most=100), layout.merge_ocr(ocr))
    books = [(i, rnd.choice(["hot", "hot", "x", "y"]), rnd.choice(["", "", None, "p/1"]), False) for i in range(2000)]
    feedback = [(i, rnd.choice(["hot", "hot", "x", "z"]), i) for i in range(1500)]
    tables = [spark.createDataFrame(books, "ord long, title string, page string, new boolean"), spark.createDataFrame(feedback, "ord long, original_title string, subject long")]
    same_rows(catalog.backfill(*tables, most=100), catalog.backfill(*tables))
    own = {}
    filled = {r.ord: r.page for r in catalog.backfill(*tables).collect()}
    items = {t: [f"{s}" for _, u, s in feedback if u == t] for t in ("hot", "x", "y")}
    for i, t, page, _ in books:
        k = own.get(t, 0)
        if page == "":
            own[t] = k + 1
            page = items[t][k] if k < len(items[t]) else ""
        assert filled[i] == page


def test_ranges_by_buckets(spark):
    rnd = random.Random(2)
    splits = [(rnd.choice("ab"), i, f"t{i}", left, left + rnd.choice([0, 1, 3, 70, 5000, 300_000, -2])) for i in range(120) for left in [rnd.randrange(-50, 20_000)]]
    pages = [(rnd.choice("abc"), rnd.randrange(-60, 21_000)) for _ in range(800)] + [(None, 3)]
    df = spark.createDataFrame(splits + [("a", 999, "null", None, 5)], "book string, ord int, title string, left long, right long")
    got = chapters.assign_ranges(spark.createDataFrame(pages, "book string, page long"), df, 16)
    assert sorted((r.book, r.page, r.ord) for r in got.collect()) == sorted((b, p, o) for b, p in pages for c, o, _, x, y in splits if b == c and x <= p < y)


def test_pairs_of_ranges_are_bounded(spark):
    """A book of n pages in n / 5 splits makes pairs in proportion to n, and not to its square."""
    n = 20_000
    pages = spark.range(n).select(F.lit("b").alias("book"), F.col("id").alias("page"))
    splits = spark.range(n // 5).select(F.lit("b").alias("book"), F.col("id").alias("ord"), F.lit("").alias("title"), (F.col("id") * 5).alias("left"), (F.col("id") * 5 + 7).alias("right"))
    found = chapters.assign_ranges(pages, splits)
    assert found.count() == sum(min(n, s * 5 + 7) - s * 5 for s in range(n // 5))
    plan = found._jdf.queryExecution().toString()
    assert "_bucket" in plan and "Cartesian" not in plan
