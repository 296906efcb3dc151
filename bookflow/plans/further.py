"""Registered queries on files, streams, joins and chapters: real archives and named files, runs that go on where they stopped, similar titles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import chapters, html, layout, match, segments
from bookflow.sources import archives, files
from bookflow.sources.shared import cut, shared_dir
from bookflow.streaming import jobs, lines

from . import fixtures
from .more import _ARCHIVES, _OWN_LINES, _PAIRS, _SIMILAR
from .queries import _SEGMENTS, _scratch, _stream, _titles, doc_lines, query, table, web_pages

# ---- files


@query(rf"WITH {_ARCHIVES} SELECT book, top - n AS page, concat('OEBPS/t/', n, '.xhtml') AS path, html FROM m")
def s1_archive_files(spark, sf_dir):
    """The hosts' archives written as files by name, then found and read in parts of 64 KB, so that an archive is several tasks' work."""
    pages = web_pages(spark, sf_dir)
    rows = pages.select(F.format_string("%s-%d", "book", F.floor(F.col("page") / fixtures.PAGES)).alias("book"), (F.col("page") % fixtures.PAGES).alias("n"), "html")
    zips = rows.groupBy("book").applyInPandas(fixtures.zipped, "path string, content binary")
    root = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    files.write_named(zips, root, F.substring_index("path", "/lib/", -1), F.col("content"))
    members = archives.read_archives(spark, root, split=1 << 16)
    order = chapters.reading_order(*archives.package_tables(members))
    return order.join(archives.member_texts(members), ["book", "path"])


@query("SELECT concat(source, '/', doc_id, '.txt') AS name, text FROM documents WHERE text IS NOT NULL")
def s4_named_files(spark, sf_dir):
    """Each document as a file of its own name in its source's folder, committed together, and read back by name."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    root, number = f"{shared_dir(spark)}/named-{uuid.uuid4().hex}", F.col("doc_id").cast("string")
    # SQL's name leaves nulls out; a document without a source has the folder _
    own, file = F.concat_ws("", "source", F.lit("/"), number, F.lit(".txt")), files.chapter_name(F.coalesce(F.nullif("source", F.lit("")), F.lit("_")), F.coalesce(number, F.lit("")))
    files.write_named(docs, root, file, F.col("text"))
    back = files.read_named(match.spread(docs.select(own.alias("name"), file.alias("file"))), root, F.col("file"))
    return back.select("name", F.col("content").cast("string").alias("text"))


# ---- streams


@query("""WITH n AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id AS line, user_id, CASE WHEN event_id < n // 2 THEN 0 ELSE 1 END AS run FROM events, n""")
def t2_resume_lines(spark, sf_dir):
    """Events as numbered lines; a first run stops at the middle, and a second with its checkpoint reads the rest alone."""
    path, made = f"{sf_dir}/events.parquet", _scratch(spark)
    half = table(spark, sf_dir, "events").agg(F.floor((F.max("event_id") + 1) / 2)).first()[0]
    for run, until in enumerate((half, None)):
        rows = lines.stream_lines(spark, path, "event_id", until).select(F.col("event_id").alias("line"), "user_id", F.lit(run).alias("run"))
        jobs.run_available(rows.writeStream.format("parquet").option("path", f"{made}/rows").option("checkpointLocation", f"{made}/state"))
    return spark.read.schema(rows.schema).parquet(f"{made}/rows")


@query("""SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS stage FROM events GROUP BY user_id""")
def t2_state_stages(spark, sf_dir):
    """The highest stage of each user, kept in the engine's state and given out when it rises."""
    stage = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    made = _scratch(spark)
    rising = jobs.rising_stages(_stream(spark, sf_dir).select("user_id", stage.alias("stage")), "user_id")
    with jobs.keyed_state(spark):
        jobs.run_available(rising.writeStream.format("parquet").option("path", f"{made}/rows").option("checkpointLocation", f"{made}/state"))
    return jobs.latest_stages(spark.read.schema(rising.schema).parquet(f"{made}/rows"), "user_id")


# ---- titles and links


@query(f"WITH {_PAIRS}, {_SIMILAR} SELECT book_id, id, CAST(conf AS DOUBLE) AS conf FROM p JOIN sim USING (a, b) WHERE conf >= 0.9")
def j4_similar_pairs(spark, sf_dir):
    """The pairs of a day that are similar, by a join on pieces; no other pairs are made."""
    books, subjects = _titles(spark, sf_dir)
    able = subjects.filter(~F.col("series"))
    found = match.similar_titles(books, able, 0.9)
    return found.join(books, ["date", "title"]).join(able.select("id", "name", "date"), ["date", "name"]).select("book_id", "id", "conf")


_GRAMS = "list_distinct(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, CAST(i AS INTEGER), 2)) END)"


@query(rf"""WITH i AS (SELECT page_id AS item_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)), '[-/._]', ' ', 'g') AS a FROM pages),
s AS (SELECT doc_id AS id, lower(regexp_extract(text, '^[A-Za-z]+(?: [A-Za-z]+){{0,2}}', 0)) AS b FROM documents),
ig AS (SELECT item_id, unnest({_GRAMS.format('a')}) AS g FROM i), sg AS (SELECT id, unnest({_GRAMS.format('b')}) AS g FROM s),
t AS (SELECT item_id, id, count(*) AS shared FROM ig JOIN sg USING (g) GROUP BY item_id, id)
SELECT item_id, id, shared, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, id) AS place FROM t) WHERE place <= 15""")
def j6_title_candidates(spark, sf_dir):
    """For every page's path the fifteen documents whose first words share most bigrams with it."""
    path = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1)), "[-/._]", " ")
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), match.bigrams(path).alias("grams"))
    first = F.lower(F.regexp_extract("text", "^[A-Za-z]+(?: [A-Za-z]+){0,2}", 0))
    subjects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), match.bigrams(first).alias("grams"))
    return match.retrieved(cut(items), cut(subjects)).select("item_id", "id", F.col("shared").cast("long").alias("shared"), F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://books.example/rb/' || o_custkey || '/' WHEN 1 THEN 'https://store.example/i/' || o_custkey || '?q=' || o_orderkey || '&b=%E3%81%82%20~'
WHEN 2 THEN 'https://other.example/?pc=https%3A%2F%2Fx%2F' || o_custkey ELSE 'https://hb.example/y/?m=' || o_custkey END AS clean FROM orders""")
def f1_shop_links(spark, sf_dir):
    """links of both shops by their own parameters, of a third shop, and without the parameter."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rakuten = F.concat(F.lit("https://hb.example/x/?pc=https%3A%2F%2Fbooks.example%2Frb%2F"), c, F.lit("%2F%3Fscid%3D1&m=2"))
    yahoo = F.concat(F.lit("https://ck.example/s?sid=1&vc_url=https%3A%2F%2Fstore.example%2Fi%2F"), c, F.lit("%3Fq%3D"), k.cast("string"), F.lit("%26b%3D%E3%81%82+~"))
    url = F.when(k % 4 == 0, rakuten).when(k % 4 == 1, yahoo).when(k % 4 == 2, F.concat(F.lit("https://other.example/?pc=https%3A%2F%2Fx%2F"), c)).otherwise(F.concat(F.lit("https://hb.example/y/?m="), c))
    site = F.when(k % 4 == 1, "Yahoo").when(k % 4 == 2, "Amazon").otherwise("Rakuten")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clean_url(site, url).alias("clean"))


# ---- lines and chapters


@query(f"{_SEGMENTS} SELECT doc, seg, min(pos) AS pos_from, max(pos) AS pos_to, string_agg(line, chr(10) ORDER BY pos) AS text FROM g JOIN l USING (doc, pos) GROUP BY doc, seg")
def w9_line_table(spark, sf_dir):
    """W9 on a table of lines, in which no document's lines are gathered."""
    found = segments.segment_table(doc_lines(spark, sf_dir), text="raw")
    return found.select("doc", "seg", "pos_from", "pos_to", F.array_join("lines", "\n").alias("text"))


_CHAPTERS = rf"""{_OWN_LINES}, t AS (SELECT doc_id, string_agg(CASE WHEN i % 2 = 1 THEN '#### ' || line ELSE line END, chr(10) || chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id),
d AS (SELECT doc_id, source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents),
c AS (SELECT book, page // 5 AS ord, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page) || chr(10) AS text FROM d LEFT JOIN t USING (doc_id) GROUP BY book, page // 5)"""


def _line_books(spark, sf_dir):
    """(pages, blocks): sources as books and their documents as pages, whose lines are paragraphs and headings by turns."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id")
    pages = layout.renumber(docs, ["book"], ["doc_id"], 0, "page")
    made = fixtures.line_pages(spark, sf_dir, [fixtures.tagged("<p>", "</p>"), fixtures.tagged("<h2>", "</h2>")])
    return pages.drop("doc_id"), html.extract_blocks(made.join(pages, "doc_id"), ["book", "page"])


@query(rf"WITH {_CHAPTERS} SELECT book, ord, 'part ' || (ord + 1) AS title, 'part ' || (ord + 1) || chr(10) || chr(10) || text AS text FROM c")
def x_line_chapters(spark, sf_dir):
    """The documents' lines as pages, cut into chapters of five pages each."""
    pages, blocks = _line_books(spark, sf_dir)
    ord_ = F.floor(F.col("page") / 5)
    splits = pages.select("book", ord_.alias("ord")).distinct().select("book", "ord", F.format_string("part %d", F.col("ord") + 1).alias("title"), (F.col("ord") * 5).alias("left"), (F.col("ord") * 5 + 5).alias("right"))
    texts = chapters.assign_ranges(pages, splits).join(chapters.page_texts(blocks), ["book", "page"], "left")
    return chapters.assemble(texts, ["book", "ord", "title"], ["page"], F.coalesce("text", F.lit("")), prefix=F.concat("title", F.lit("\n\n")), suffix="\n")


@query(rf"""WITH {_CHAPTERS}, z AS (SELECT *, lpad(CAST(ord AS VARCHAR), CAST(greatest(2, len(CAST(max(ord) OVER (PARTITION BY book) AS VARCHAR))) AS INTEGER), '0') AS name FROM c), y AS (SELECT *, lead(name) OVER (PARTITION BY book ORDER BY ord) AS next FROM z)
SELECT book, name, '<t>' || name || '</t>' || text || '<a href=' || coalesce(next || '.html', '') || '>' || CASE WHEN next IS NULL THEN '' ELSE 'on' END || '</a></t>' AS html FROM y""")
def r4_line_chapters(spark, sf_dir):
    """The same chapters by their starts, named and set in a template with links to the next."""
    pages, blocks = _line_books(spark, sf_dir)
    starts = pages.filter("page % 5 = 0").select("book", F.col("page").alias("start"), F.lit("TOC").alias("method"))
    texts = chapters.chapter_documents(blocks, pages, starts).withColumnRenamed("chapter", "left")
    spans = chapters.chapter_spans(starts, pages.groupBy("book").agg(F.max("page").alias("last")).withColumn("last", F.col("last") + 1))
    # chapters are numbered from 0, as if all had a front
    named = chapters.nav_titles(spans.withColumn("number", F.col("index")), least=2).join(texts, ["book", "left"])
    return chapters.html_documents(named, "<t>{TITLE}</t>", "</t>", "<a href={NEXT_LINK}>{NEXT_TEXT}</a>", next_text="on").select("book", "name", "html")
