import json
import random

from pyspark.sql import functions as F

from bookflow.functions.similarity import similarity
from bookflow.operators import catalog, match
from bookflow.sources import catalog as source
from bookflow.sources import lines as files
from bookflow.streaming import jobs

BOOK = "month string, day int, label string, ord int, title string, page string, link map<string,string>, new boolean"
BOOKS = [
    ("202401", 15, "ga", 0, "A 1", "p/1", {"Amazon": "u1"}, False), ("202401", 15, "ga", 1, "B", "", {}, False), ("202401", 5, "hj", 2, "C", None, {"Yahoo": "y", "Rakuten": "r"}, False),
    ("202401", 15, "hj", 3, "B", "", {"Amazon": "u4"}, False), ("202401", 15, "??", 4, "D", "", {}, False),
]
LABELS = [("ga", "GA文庫", "GA 文库", "SB", 0), ("hj", "HJ文庫", "HJ 文库", "HJ社", 1)]


def books(spark):
    return spark.createDataFrame(BOOKS, BOOK)


def labels(spark):
    return spark.createDataFrame(LABELS, "label string, jp string, zh string, pub string, ord int")


def test_nested(spark):
    known = catalog.with_labels(books(spark), labels(spark).drop("ord"))
    assert known.count() == 4
    got = {(r.day, r.label): [b.title for b in r.books] for r in catalog.nest_catalog(known).collect()}
    assert got == {(15, "ga"): ["A 1", "B"], (5, "hj"): ["C"], (15, "hj"): ["B"]}


def test_json_round_trip(spark, tmp_path):
    logs = spark.createDataFrame([("202401", 0, "init", 1, 5, None), ("202401", 1, "newly-append", 2, None, 3), ("202402", 0, "init", 9, 0, None)], "month string, ord int, action string, ts_ms long, total long, increment long")
    found = {r.month: json.loads(r.json) for r in source.catalog_json(books(spark), logs).collect()}
    assert list(found["202401"]["items"]) == ["15", "5"] and found["202402"]["items"] == {}
    assert found["202401"]["logs"][1]["details"] == {"increment": 3}
    for month, text in found.items():
        (tmp_path / month).mkdir()
        (tmp_path / month / "data.json").write_text(json.dumps(text, ensure_ascii=False, indent=4))
    back, log = source.read_catalog(spark, f"{tmp_path}/*/data.json")
    assert log.count() == 3 and log.agg(F.sum("increment")).first()[0] == 3
    assert [r.title for r in back.orderBy("ord").collect()] == ["A 1", "B", "B", "D", "C"]
    rows = sorted((r.month, r.day, r.label, r.title, r.page, tuple(sorted((r.link or {}).items()))) for r in back.collect())
    assert rows == sorted((m, d, x, t, p, tuple(sorted(k.items()))) for m, d, x, _, t, p, k, _ in BOOKS)
    source.write_catalog(books(spark), logs, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2


def test_logs(spark):
    schema = "ord int, action string, ts_ms long, total long, increment long"
    first = spark.createDataFrame([(0, "init", 1000, 7, None)], schema)
    more = first.union(spark.createDataFrame([(1, "post-first", 2000, None, 4), (2, "newly-append", 3000, None, 2), (3, "newly-append", 4000, None, 3)], schema))
    r = catalog.log_rollup(more).first()
    assert (r.newly, r.total, r.n_logs, r.last_action, r.last_ts_ms) == (5, 7, 4, "newly-append", 4000)
    searched = books(spark).filter("page IS NOT NULL")
    late = 4000 + catalog.FAR_MS + 1
    got = lambda logs, b, now, force: [x.action for x in catalog.next_log(logs, b, now, force).collect()]
    assert got(first, searched, 5000, False) == ["post-first"] and got(more, searched, late, True) == ["post-append"]
    assert got(more, searched, late - 1, True) == got(more, books(spark), late, True) == got(more, searched, late, False) == []
    r = catalog.completeness(books(spark), F.col("page").isNotNull(), what=F.col("title")).first()
    assert (r.n, r.complete, r.n_open, r.missing) == (5, False, 1, ["C"])


def test_worklist(spark):
    items = catalog.missing_worklist(books(spark), labels(spark))
    assert sorted((r.title, r.info.date, r.info.label, r.stage) for r in items.collect()) == [("B", "2024-01-15", "GA文庫", 0), ("B", "2024-01-15", "HJ文庫", 0)]
    assert catalog.missing_worklist(books(spark), labels(spark), "Amazon").count() == 1
    box = catalog.infobox(items).filter("label = 'ga'").first().infobox
    assert box == "{{Infobox animanga/Novel\n|作者= \n|插图= \n|出版社= SB\n|书系= GA文庫\n|价格= \n|发售日= 2024-01-15\n|页数= \n|ISBN= \n}}"
    plain = items.withColumn("info", F.col("info").withField("label", F.lit(catalog.UNLABELLED)).withField("author", F.array(F.lit("a"), F.lit("b"))))
    assert "|作者= a,b\n" in catalog.infobox(plain).first().infobox and "书系" not in catalog.infobox(plain).first().infobox


def model_backfill(own, feedback):
    own = [dict(b) for b in own]
    for f in feedback:
        page = f"s/{f['subject']}"
        if any(b["title"] == f["title"] and b["page"] == page for b in own):
            continue
        for b in own:
            if b["title"] == f["title"] and b["page"] == "":
                b["page"] = page
                break
    return {b["ord"]: b["page"] for b in own}


def test_backfill(spark):
    rnd = random.Random(4)
    own = [{"ord": i, "title": rnd.choice("abc"), "page": rnd.choice(["", "", None, "s/3", "x"])} for i in range(60)]
    feedback = [{"ord": i, "title": rnd.choice("abcd"), "subject": i} for i in range(30)]
    rows = [(b["ord"], b["title"], b["page"], False) for b in own]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "ord int, title string, page string, new boolean")
    got = catalog.backfill(df, spark.createDataFrame([(f["ord"], f["title"], f["subject"]) for f in feedback], "ord int, original_title string, subject long"), "s/")
    assert {r.ord: r.page for r in got.collect()} == model_backfill(own, feedback)
    assert got.filter("new AND page = ''").count() == 0 and got.count() == 60


def test_report(spark):
    logs = spark.createDataFrame([("202401", 0, "newly-append", 1, None, 2), ("202312", 0, "newly-append", 1, None, 40)], "month string, ord int, action string, ts_ms long, total long, increment long")
    text = catalog.monthly_report(books(spark), labels(spark), logs, "来源", "注").first().text
    assert text == (
        "2023 年 12 月文库・单行本新刊情报\n已添加 2 个独立词条\n注\n[b][size=25]1/15[/size][/b]\n[b][size=20]GA 文库[/size][/b]\n[url=p/1]A 1[/url] ([url=u1]Amazon[/url])\nB\n"
        "[b][size=20]HJ 文库[/size][/b]\nB ([url=u4]Amazon[/url])\n\n[b][size=25]1/5[/size][/b]\n[b][size=20]HJ 文库[/size][/b]\nC ([url=r]Rakuten[/url])\n\n收录书系：GA 文库、HJ 文库\n来源"
    )
    assert [(r.brand, r.n) for r in catalog.shops(books(spark)).orderBy("rank").collect()] == [("Amazon", 2), ("Rakuten", 1), ("Yahoo", 1)]


def test_novels(spark):
    tabs = [(1, 0, "episode", "pre", "/0"), (1, 1, "chapter", "One", None), (1, 2, "episode", "a", "/1"), (2, 0, "episode", "b", "/2"), (2, 1, "chapter", "Two", None), (2, 2, "episode", "c", "/3")]
    df = spark.createDataFrame([("n", *t) for t in tabs] + [("m", *t) for t in tabs[1:]], "doc string, page int, pos int, kind string, text string, href string")
    got = [tuple(r) for r in catalog.episodes(df).orderBy("doc", "vol", "ord").collect()]
    assert got == [("m", 1, "One", 0, "a", "/1"), ("m", 1, "One", 1, "b", "/2"), ("m", 2, "Two", 0, "c", "/3"), ("n", 1, "", 0, "pre", "/0"), ("n", 2, "One", 0, "a", "/1"), ("n", 2, "One", 1, "b", "/2"), ("n", 3, "Two", 0, "c", "/3")]
    parts = catalog.episodes(df).withColumn("body", F.concat(F.lit(" text "), "title"))
    docs = {(r.doc, r.vol): r.text for r in catalog.volume_documents(parts, spark.createDataFrame([("n", "Novel"), ("m", "Other")], "doc string, title string")).collect()}
    assert docs["n", 1] == "# Novel\n\n### pre\n\ntext pre\n\n" and docs["n", 2] == "## One\n\n### a\n\ntext a\n\n\n\n### b\n\ntext b\n\n"
    stories = [("7", 1, None, None, "T", None, ["x "]), ("8", 2, "S #1", "5", "U", "in", ["p", "q"]), ("9", 3, "S #2", "5", "V", None, ["r"])]
    got = {r.key: r.text for r in catalog.compile_series(spark.createDataFrame(stories, "id string, crawl int, series string, series_id string, title string, intro string, parts array<string>")).collect()}
    assert got == {"7": "### T\n\nx\n", "s5": "## S\n\n### V\n\nr\n\n\n\n### U\n\nin\n\n---\n\np\n\n\n\n　◇\n\n\n\nq\n"}


def test_series_order(spark):
    volumes = [("s", 0, "V3", "2024-03-01", True), ("s", 1, "V2", "2024-02-01", True), ("s", 2, "V1", "2024-02-01", True), ("t", 0, "W1", "2024-02-01", False)]
    items = spark.createDataFrame([("s", "2024-02-01"), ("t", "2024-02-01"), ("s", "1999-01-01"), ("u", "x")], "series string, date string")
    got = [(r.series, r.date, r.order, None if r.abstract is None else [v.title for v in r.abstract]) for r in catalog.series_order(spark.createDataFrame(volumes, "series string, pos int, title string, date string, newest_first boolean"), items).collect()]
    assert sorted(got, key=str) == sorted([("s", "2024-02-01", 0, ["V1", "V2", "V3"]), ("t", "2024-02-01", 0, ["W1"]), ("s", "1999-01-01", None, ["V1", "V2", "V3"]), ("u", "x", None, None)], key=str)


def test_matching(spark):
    subjects = spark.createDataFrame([
        (1, "Title 2", "2024-01-01", False, "小说", 1), (2, "Ｔｉｔｌｅ", "2024-01-01", False, "其他", 2), (3, "Title", "2024-01-01", True, "小说", 0), (4, "Title", "2024-01-01", False, "漫画", 0),
        (5, "Title", "2024-01-02", False, "小说", 0), (6, "Quite another", "2024-01-01", False, "小说", 3),
    ], "id long, name string, date string, series boolean, platform string, rank int")
    own = spark.createDataFrame([(0, "title", "2024-01-01"), (1, "nothing", "2024-01-01"), (2, "x", "2030-01-01"), (3, "QUITE  ANOTHER", "2024-01-01")], "book_id int, title string, date string")
    best = {r.book_id: (r.subject, r.conf) for r in match.best_match(own, subjects).collect()}
    # a part that is equal scores 1.0, and the first of equals is taken
    assert best == {0: (1, 1.0), 1: (None, None), 2: (None, None), 3: (6, 1.0)}
    items = spark.createDataFrame([(0, "title"), (1, "zzz"), (2, "another one")], "item_id int, title string")
    got = {r.item_id: ([m.title for m in r.single], [m.title for m in r.series]) for r in match.shortlist(items, subjects).collect()}
    assert got[0] == (["Title", "Title 2", "Ｔｉｔｌｅ", "Quite another"], ["Title"]) and got[1] == ([], []) and got[2][0] == ["Quite another"]
    pages = own.withColumn("page", F.when(F.col("book_id") == 1, "").when(F.col("book_id") == 3, "old"))
    got = lambda force, df: {r.book_id: r.page for r in match.incremental_links(df, subjects, force, "s/").collect()}
    assert got(False, pages) == {0: "s/1", 1: "", 2: "", 3: "old"} == got(True, pages)
    done = pages.fillna("", ["page"])
    assert got(True, done) == {0: "s/1", 1: "", 2: "", 3: "old"} and got(False, done)[0] == ""
    assert similarity("title", "title 2") == 1.0


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("　一 \n\n二\r\n<ruby>三<rt>x</rt></ruby>")
    (tmp_path / "in" / "sub" / "b.txt").write_text("四")
    lines = files.read_text_lines(spark, f"{tmp_path}/in")
    assert [r.pure for r in lines.orderBy("doc", "pos").collect()] == ["一", "二", "三", "四"]
    files.write_documents(lines.select(F.col("pos").alias("book"), F.col("pure").alias("text")), f"{tmp_path}/out", kind="text")
    assert spark.read.text(f"{tmp_path}/out").count() == 4
    fresh, record = catalog.unseen(spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int"), "id")
    assert [r.id for r in fresh.collect()] == [2] and sorted(r.id for r in record.collect()) == [1, 2]

    def feed(rows):
        spark.createDataFrame(rows, "id int, stage int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema("id int, stage int").parquet(f"{tmp_path}/events")
        jobs.run_available(jobs.stage_writer(stream, f"{tmp_path}/stages", "id"))
        return {r.id: r.stage for r in jobs.current_stages(spark, f"{tmp_path}/stages", "id").collect()}

    assert jobs.current_stages(spark, f"{tmp_path}/none", "id") is None
    assert feed([(1, 0), (1, 2), (2, 0)]) == {1: 2, 2: 0}
    assert feed([(1, 1), (2, 1), (3, 0)]) == {1: 2, 2: 1, 3: 0}
