"""Similarity joins and retrieval, against brute force on random titles."""

import random

import pytest
from pyspark.sql import functions as F

from bookflow.functions.similarity import similarity
from bookflow.operators import match
from bookflow.plans.queries import QUERIES


def changed(rng, title, letters, most=3):
    """`title` with some letters inserted, deleted or replaced, words swapped, or more text around it."""
    out = list(title)
    for _ in range(rng.randrange(most + 1)):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.randrange(2)] = rng.choice(["", letters[0], rng.choice(letters)])
    out = "".join(out)
    if rng.random() < 0.3:
        words = out.split(" ")
        rng.shuffle(words)
        out = " ".join(words)
    if rng.random() < 0.3:
        out = rng.choice(["", "ab ", " "]) + out + rng.choice([" vol 12", "", " "])
    return out


def titles(rng, n, letters, longest=22):
    own = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)]
    return own + [changed(rng, rng.choice(own), letters) for _ in range(2 * n)] + ["", " ", "a", "b", "ab"]


@pytest.mark.parametrize("letters, least", [("abcde fgh ", 0.9), ("ab ", 0.9), ("abcdefgh あいうえお", 0.8), ("abcd", 0.3)])
def test_similar_titles(spark, letters, least):
    rng = random.Random(5)
    a, b = titles(rng, 60, letters), titles(rng, 60, letters)
    day = lambda t: len(t) % 2
    books = spark.createDataFrame([(i, t, "d") for i, t in enumerate(a)] + [(-1, None, "d")], "book_id long, title string, date string")
    subjects = spark.createDataFrame([(i, t, "d") for i, t in enumerate(b)] + [(-1, None, "d")], "id long, name string, date string")
    assert day("") == 0
    norm = {}
    for df, c in ((books, "title"), (subjects, "name")):
        norm |= {r[0]: r[1] for r in df.select(c, match.norm_title(F.col(c))).collect()}
    want = {(x, y): s for x in set(a) for y in set(b) if (s := similarity(norm[x], norm[y])) >= least}
    got = {(r.title, r.name): r.conf for r in match.similar_titles(books, subjects, least).collect()}
    assert got == want and len(want) > 30


@pytest.fixture
def days(spark, monkeypatch):
    """Books and subjects, with nulls and titles that repeat, in arrays of three; and the pairs of a day by brute force."""
    monkeypatch.setattr(match, "BLOCK", 3)
    rng = random.Random(7)
    a, b = titles(rng, 12, "abc ", 9), titles(rng, 12, "abc ", 9)
    books = [(i, rng.choice([*a[:9], t, None]), rng.choice(["d", "d", "e", None])) for i, t in enumerate(a)]
    subjects = [(i, rng.choice([*b[:9], t, None]), rng.choice(["d", "d", "e", None]), rng.random() < 0.1, rng.choice(["小说", "其他", "x"]), i) for i, t in enumerate(b)]
    tables = spark.createDataFrame(books, "book_id long, title string, date string").repartition(2), spark.createDataFrame(subjects, "id long, name string, date string, series boolean, platform string, rank int").repartition(3)
    able = [s for s in subjects if not s[3] and s[4] != "x"]
    return *tables, [(x, y) for x in books for y in able if x[2] is not None and x[2] == y[2]]


def test_all_pairs_of_a_day(days):
    books, subjects, want = days
    got = [(r.date, r.book_id, r.title, r.id, r.name, r["rank"]) for r in match.block_candidates(books, subjects).collect()]
    assert sorted(got, key=str) == sorted(((x[2], *x[:2], *y[:2], y[5]) for x, y in want), key=str) and len(want) > 200


def test_all_scores_of_a_day(spark, days):
    books, subjects, want = days
    norm = {r[0]: r[1] for df, c in ((books, "title"), (subjects, "name")) for r in df.select(c, match.norm_title(F.col(c))).collect()}
    found = match.scored_candidates(books, subjects)
    got = [(r.date, r.book_id, r.title, r.id, r.name, r["rank"], r.conf) for r in found.collect()]
    told = [(x[2], *x[:2], *y[:2], y[5], similarity(norm[x[1]], norm[y[1]])) for x, y in want if x[1] is not None and y[1] is not None]
    assert sorted(got, key=str) == sorted(told, key=str)


def test_the_pairs_of_one_day_are_many_tasks_work(spark):
    """2,000 books and 2,000 subjects of one day are few bytes, which Spark would put in one task, and four million pairs."""
    books = spark.range(2000).select(F.col("id").alias("book_id"), F.lit("t").alias("title"), F.lit("d").alias("date"))
    subjects = spark.range(2000).select("id", F.lit("t").alias("name"), F.lit("d").alias("date"), F.lit(False).alias("series"), F.lit("其他").alias("platform"), F.col("id").alias("rank"))
    for found in (match.block_candidates(books, subjects), match.scored_candidates(books, subjects)):
        made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) == 4_000_000 and max(made) <= 1_000_000, made


def test_a_key_has_few_arrays(spark):
    """Of 20 keys of 50 rows dealt to 40 tasks each has the one or two arrays that its place in the order gives."""
    rows = spark.range(1000).select((F.col("id") % 20).alias("k"), "id").repartition(40)
    got = match.gathered(rows, ["k"], "own").collect()
    assert len(got) <= 20 + 8 + 2 and sorted((r.k, x.id) for r in got for x in r.own) == sorted((i % 20, i) for i in range(1000))


@pytest.mark.parametrize("name", ["j3_candidates", "j4_similarity"])
def test_no_table_of_pairs_is_broadcast(spark, sf, name):
    """The driver collects what is broadcast, and parts of few names are hundreds of times as large there as in their file."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def pairs_made(spark, n):
    """Pairs that a day of n random titles gives, of which every tenth is nearly another."""
    rng = random.Random(n)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(8, 30))) for _ in range(n)]
    other = [changed(rng, t, "xyz", 1) if i % 10 == 0 else "".join(rng.sample(t, len(t))) for i, t in enumerate(own)]
    tables = [spark.createDataFrame([("d", t) for t in set(x)], "date string, title string") for x in (own, other)]
    return match.near_candidates(*tables).count()


def test_pairs_grow_well_below_the_square(spark):
    made = {n: pairs_made(spark, n) for n in (500, 4000)}
    assert all(made[n] < n * n / 1000 for n in made) and made[4000] < 32 * made[500], made  # the square would be 64 times as many


def test_a_day_of_one_series(spark):
    """Titles that share most of their letters meet once each way, however many pieces they share."""
    a = [("d", f"the long tale of a river volume {i}") for i in range(120)]
    df = spark.createDataFrame(a, "date string, title string")
    got = match.near_candidates(df, df)
    assert got.count() == got.distinct().count() == 120 * 120


def plain_top(items, subjects, k):
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    found = {}
    for i, t in items:
        rows = sorted((-len(grams(t) & grams(n)), rank, s) for s, n, rank in subjects if grams(t) & grams(n))
        found[i] = [(s, -c) for c, _, s in rows[:k]]
    return found


@pytest.mark.parametrize("letters, head, k", [("abc", 4, 3), ("abcdefgh", 8, 15), ("ab", 1, 2)])
def test_retrieved(spark, letters, head, k):
    rng = random.Random(11)
    subjects = [(i, t, rng.randrange(40)) for i, t in enumerate(titles(rng, 120, letters, 12))]
    items = list(enumerate(titles(rng, 20, letters, 12)))
    tables = [
        spark.createDataFrame(items, "item_id long, t string").select("item_id", match.bigrams(F.col("t")).alias("grams")),
        spark.createDataFrame(subjects, "id long, t string, rank int").select("id", "rank", match.bigrams(F.col("t")).alias("grams")),
    ]
    got = {}
    for r in match.retrieved(*tables, k, head).orderBy("item_id", "place").collect():
        got.setdefault(r.item_id, []).append((r.id, r.shared))
    want = plain_top(items, subjects, k)
    assert got == {i: rows for i, rows in want.items() if rows}


def test_items_and_subjects_of_the_same_bigrams_are_asked_once(spark, monkeypatch):
    """4,000 items that differ in what no subject has, and 4,000 subjects that differ in what no item has, are a few sets."""
    asked = []
    lists = match.retrieved_by_lists
    monkeypatch.setattr(match, "retrieved_by_lists", lambda items, subjects, *a: asked.append((items.count(), subjects.count())) or lists(items, subjects, *a))
    gram = lambda c: match.bigrams(F.col(c)).alias("grams")
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.concat(F.when(F.col("id") % 2 == 0, "en ").otherwise("fr "), F.col("id").cast("string")).alias("t")).select("item_id", gram("t"))
    subjects = spark.range(4000).select("id", (F.col("id") % 100).alias("rank"), F.concat(F.when(F.col("id") % 4 == 0, "men ").otherwise("fr "), F.translate(F.col("id").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("t")).select("id", "rank", gram("t"))
    got = {}
    for r in match.retrieved(items, subjects, 3, 4).orderBy("item_id", "place").collect():
        got.setdefault(r.item_id, []).append((r.id, r["rank"], r.shared))
    best = lambda own: [(i, i % 100, 2) for i in sorted((i for i in range(4000) if (i % 4 == 0) == own), key=lambda i: (i % 100, i))[:3]]
    assert got == {i: best(i % 2 == 0) for i in range(4000)} and asked == [(2, 6)]


def test_reads_are_bounded_where_the_heads_decide(spark):
    """However many subjects hold a common bigram, an item whose best subjects are among the heads opens no list."""
    for n in (400, 4000):
        subjects = [(i, f"xy zw {i % 7}", i) for i in range(n)]
        items = spark.createDataFrame([(0, "xy zw")], "item_id long, t string").select("item_id", match.bigrams(F.col("t")).alias("grams"))
        df = spark.createDataFrame(subjects, "id long, t string, rank int").select("id", "rank", match.bigrams(F.col("t")).alias("grams"))
        top = match.retrieved(items, df, 5, 16)
        assert [(r.id, r.shared) for r in top.orderBy("place").collect()] == [(i, 4) for i in range(5)]
