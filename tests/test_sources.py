"""Archives and files as data sources, numbered lines and keyed state as streams, records filtered by bits."""

import glob
import os
import random
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookflow.operators import catalog, segments
from bookflow.plans.queries import QUERIES, SQL
from bookflow.sources import archives, files
from bookflow.streaming import jobs, lines
from tests.oracle import spark_rows, sql_rows


@pytest.fixture
def large(tmp_path):
    """An archive of many members, a small one, a broken one and one with an empty name."""
    rnd = random.Random(1)
    with zipfile.ZipFile(tmp_path / "large.epub", "w") as z:
        for i in range(200):
            z.writestr(f"t/{i}.xhtml", bytes(rnd.randrange(256) for _ in range(1000)))
        z.writestr("pic.png", b"x" * 50_000)
        z.mkdir("empty")
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "small.epub", "w") as z:
        z.writestr("a.html", "ä")
    (tmp_path / "bad.epub").write_bytes(b"PK nothing")
    (tmp_path / "none.epub").write_bytes(b"")
    (tmp_path / "other.zip").write_bytes(b"")
    return str(tmp_path)


def test_an_archive_is_several_partitions(spark, large):
    df = archives.read_archives(spark, large, split=20_000)
    assert df.rdd.getNumPartitions() >= 10
    per_task = [r["count"] for r in df.filter("book = 'large'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 10 and max(per_task) < 40 and sum(per_task) == 201
    got = {(r.book, r.infix, r.path): r for r in df.collect()}
    assert len(got) == 204 and all(len(got["large", "", f"t/{i}.xhtml"].content) == 1000 for i in range(200))
    assert got["large", "", "pic.png"].content is None and got["large", "", "pic.png"].size == 50_000
    assert got["small", "sub", "a.html"].content.decode() == "ä" and got["bad", "", ""].error and got["none", "", ""].error
    whole = {(r.book, r.infix, r.path): r.content for r in archives.read_whole_archives(spark, large).collect()}
    assert whole == {k: r.content for k, r in got.items() if k[0] != "none"}  # Spark's own reader has no row for an empty file
    assert archives.read_archives(spark, large).rdd.getNumPartitions() == 1  # small ones share a task


def test_no_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_files_by_name(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"b{i % 3}/{i}.txt", f"text {i}" if i else None) for i in range(50)], "n string, t string").repartition(4)
    files.write_named(rows, root, F.col("n"), F.col("t"))
    there = {os.path.relpath(p, root): open(p).read() for p in glob.glob(f"{root}/**/*.txt", recursive=True)}
    assert there == {f"b{i % 3}/{i}.txt": f"text {i}" if i else "" for i in range(50)} and sorted(os.listdir(root)) == ["b0", "b1", "b2"]
    with pytest.raises(Exception, match="FileExists"):
        files.write_named(rows.limit(1), root, F.col("n"), F.col("t"))
    files.write_named(rows, root, F.col("n"), F.lit("new"), "overwrite")
    assert {open(p).read() for p in glob.glob(f"{root}/**/*.txt", recursive=True)} == {"new"}


def test_documents_come_back_whatever_their_names_and_texts(spark, tmp_path):
    sources, texts = ["src0", "a b", "a%20b", "a:b", "größe#1", "_own", ".own", None, ""], ["", " ", "\ufeffa\r\nb", "a\x00b", "\n"]
    rows = [(i, t, s) for i, (s, t) in enumerate((s, t) for s in sources for t in texts)] + [(99, None, "src0"), (None, "x", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(QUERIES["s4_named_files"](spark, str(tmp_path))) == sql_rows(con, SQL["s4_named_files"])
    with pytest.raises(Exception, match="No such file"):
        files.read_named(spark.createDataFrame([("none.txt",)], "n string"), str(tmp_path), F.col("n")).collect()


def test_the_driver_lists_no_files(spark):
    """A thousand documents are a thousand files, of which the driver sees none; tasks are as many as partitions were asked for."""
    back = QUERIES["s4_named_files"](spark, "/root/testdata/sf0.01")
    assert len(back.inputFiles()) <= 1 and back.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_moved_once(tmp_path):
    """A task that is tried again finds what it has moved; a file that is nowhere is an error."""
    (tmp_path / "w" / "b").mkdir(parents=True)
    (tmp_path / "w" / "b" / "1.txt").write_text("x")
    batch = lambda n: pa.RecordBatch.from_pydict({"name": [n], "folder": [f"{tmp_path}/w"]})
    for _ in range(2):
        assert [b.num_rows for b in files.moved(iter([batch("b/1.txt")]), str(tmp_path / "out"))] == [0]
    assert (tmp_path / "out" / "b" / "1.txt").read_text() == "x"
    with pytest.raises(OSError):
        list(files.moved(iter([batch("b/2.txt")]), str(tmp_path / "out")))


@pytest.mark.parametrize("names", [["a.txt", "a.txt"], ["a.txt", "../b.txt"], ["a.txt", "/b.txt"], ["a.txt", ""], ["a.txt", None]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, names):
    root = f"{tmp_path}/out"
    rows = spark.createDataFrame([(n, "x") for n in names], "n string, t string").repartition(2)
    with pytest.raises(Exception, match="two rows|no name"):
        files.write_named(rows, root, F.col("n"), F.col("t"))
    assert [p for p in glob.glob(f"{root}/**/*", recursive=True) if files.WAITING not in p] == []


def test_runs_go_on_at_the_next_line(spark, tmp_path):
    def run(until=None):
        out = lines.stream_lines(spark, f"{tmp_path}/in", until=until, split=7)
        jobs.run_available(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state"))
        return sorted(r.line_index for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())

    add = lambda low, high: spark.range(low, high).select(F.col("id").alias("line_index"), F.lit("t").alias("text")).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    add(0, 50)
    assert run(20) == list(range(20))
    assert run(20) == list(range(20))
    assert run() == list(range(50))
    add(50, 60)
    add(5, 9)  # numbers that have been passed
    assert run() == list(range(60))


def test_a_span_reads_its_row_groups_alone(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"line_index": list(range(1000)), "text": ["x"] * 1000}), f"{tmp_path}/a.parquet", row_group_size=100)
    reader = lines.LineReader(f"{tmp_path}/a.parquet", "line_index", 0, None, 250, ["line_index", "text"])
    assert reader.latestOffset() == {"line": 1000} and [(p.first, p.end) for p in reader.partitions({"line": 300}, {"line": 1000})] == [(300, 550), (550, 800), (800, 1000)]
    got = [x for b in reader.read(lines.Span(300, 550)) for x in b.column(0).to_pylist()]
    assert got == list(range(300, 550))


def test_stages_in_state(spark, tmp_path):
    def add(rows, name):
        spark.createDataFrame(rows, "k string, stage int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema("k string, stage int").parquet(f"{tmp_path}/in/*")
        with jobs.keyed_state(spark):
            jobs.run_available(jobs.rising_stages(stream, "k", kept="30 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state"))
        return sorted((r.k, r.stage) for r in spark.read.schema("k string, stage int").parquet(f"{tmp_path}/out").collect())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    add([("a", 0), ("a", 1), ("b", 2), ("c", None)], "1")
    assert run() == [("a", 1), ("b", 2)]
    add([("a", 0), ("b", 1), ("a", 1), ("d", 0)], "2")  # late rows and repeated ones raise nothing
    assert run() == [("a", 1), ("b", 2), ("d", 0)]
    add([("a", 2), ("a", 2)], "3")
    assert run() == [("a", 1), ("a", 2), ("b", 2), ("d", 0)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_the_record_is_only_scanned(spark, tmp_path):
    spark.range(100_000).selectExpr("id * 2 AS k").write.parquet(f"{tmp_path}/record")
    record = spark.read.parquet(f"{tmp_path}/record")
    rows = spark.createDataFrame([(k, "x") for k in [1, 1, 2, 3, 7, 8, None, None]], "k long, x string")
    fresh, whole = catalog.unseen(rows, record, "k")
    assert sorted((r.k for r in fresh.collect()), key=str) == [1, 3, 7, None] and whole.count() == 100_004
    passed = catalog.among(record, rows.select("k"), "k").count()
    assert 2 <= passed < 20  # of a hundred thousand
    assert catalog.among(record, rows.select("k").filter("k < 0"), "k").count() == 0
    plan = catalog.among(record, rows.select("k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the keys' bits


@pytest.mark.parametrize("lengths, most_chars", [([0, 1, 3, 30, 200, 600], 512), ([64], 512), ([0, 0, 0, 9], 8)])
def test_segments_of_long_documents(spark, lengths, most_chars):
    rnd = random.Random(3)
    docs = {d: ["x" * rnd.choice(lengths) for _ in range(n)] for d, n in (("long", 900), ("mid", 65), ("short", 3), ("one", 1))}
    rows = [(d, 10 * i + 4, x) for d, own in docs.items() for i, x in enumerate(own)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, pos int, pure string").repartition(4)
    got = {}
    for r in segments.segment_table(df, most_chars, block=32, most=100).orderBy("doc", "seg").collect():
        got.setdefault(r.doc, []).append((r.pos_from, r.pos_to, r.lines))
    for d, own in docs.items():
        want, now, size = [], [], 0
        for i, x in enumerate(own):
            if now and size + len(x) > most_chars:
                want.append(now)
                now, size = [], 0
            now.append(i)
            size += len(x)
        assert got[d] == [(10 * s[0] + 4, 10 * s[-1] + 4, [own[i] for i in s]) for s in [*want, now]]
