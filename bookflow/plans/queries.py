"""The registered queries: each operator on a table of the driver, and the SQL that must give the same rows.

The tables are no books, so each query says which columns stand for the operator's inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import catalog, chapters, html, layout, match, pixels, segments
from bookflow.sources import catalog as source
from bookflow.sources.lines import document_lines, own_lines
from bookflow.sources.shared import shared_dir
from bookflow.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: doc = source, page = doc_id, lines as they are."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, raw, pure): documents as lines without blank ones; the ids are the documents."""
    return document_lines(table(spark, sf_dir, "documents"), "doc_id")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as books: book = host, page = place of the page by id, path = the URL's path."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("book"), "page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1).alias("path"), "html")
    return layout.renumber(pages, ["book"], ["page_id"], 0, "page")


_PAGE_LINES = "l AS (SELECT source AS doc, doc_id AS page, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"
_STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_DOC_LINES = r"""s AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS own FROM documents),
l AS (SELECT doc, unnest(range(0, len(own))) AS pos, unnest(own) AS line FROM s)"""
_PAGES = "p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS book, page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path, html, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) - 1 AS page FROM pages)"


# ---- chapters and pages


@query()
def x_chapter_documents(spark, sf_dir):
    """Hosts as books, cut into chapters of five pages each."""
    pages = web_pages(spark, sf_dir)
    blocks = html.extract_blocks(pages, ["book", "page"])
    last = pages.groupBy("book").agg(F.max("page").alias("last"))
    splits = last.select("book", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 5).cast("int"))).alias("ord")).select("book", "ord", F.format_string("part %d", F.col("ord") + 1).alias("title"), (F.col("ord") * 5).alias("left"), (F.col("ord") * 5 + 5).alias("right"))
    placed = chapters.assign_ranges(pages.select("book", "page"), splits)
    texts = placed.join(chapters.page_texts(blocks), ["book", "page"], "left")
    return chapters.assemble(texts, ["book", "ord", "title"], ["page"], F.coalesce("text", F.lit("")), prefix=F.concat("title", F.lit("\n\n")), suffix="\n")


@query()
def x3_blocks(spark, sf_dir):
    """The text blocks of every page."""
    return html.extract_blocks(table(spark, sf_dir, "pages"), ["page_id"]).drop("images")


@query()
def x5_story_text(spark, sf_dir):
    """Paragraphs and headings of every page."""
    return html.story_text(table(spark, sf_dir, "pages"), ["page_id"])


@query(r"SELECT page_id, unnest(range(0, len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: split_part(x, '#', 1)) AS h FROM pages)")
def x2_links(spark, sf_dir):
    return html.extract_links(table(spark, sf_dir, "pages"), ["page_id"])


@query("""SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, CAST(day(o_orderdate) AS INTEGER) AS day,
lower(replace(o_orderstatus, ' ', '')) AS label, 'Order ' || o_orderkey || ' & <' || o_orderpriority || '>' AS title FROM orders""")
def x1_listing_records(spark, sf_dir):
    """A listing page of each customer's orders, written as HTML and read back."""
    orders = table(spark, sf_dir, "orders")
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" &amp; &lt;"), "o_orderpriority", F.lit("&gt;"))
    item = F.concat(
        F.lit('<div class="x book"><a class="t_ul" href="/lightnovel/label/'), F.lower(F.replace("o_orderstatus", F.lit(" "), F.lit(""))), F.lit('">l</a><span class="book_info">'),
        F.month("o_orderdate").cast("string"), F.lit("/"), F.day("o_orderdate").cast("string"), F.lit('(月)</span><p class="book_title">'), title, F.lit('</p><div class="book_btn_box"><a href="https://www.amazon.example/1">a</a></div></div>'),
    )
    pages = orders.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda s: s["i"]), "<hr>").alias("html"))
    return html.extract_records(pages, "listing", ["page_id"]).drop("hrefs")


@query(rf"""WITH {_PAGES} SELECT book, page AS start, 'TRIVIAL' AS method FROM p""")
def w2_toc_starts(spark, sf_dir):
    """The links of these pages lead to words, not pages, so every page starts a chapter."""
    pages = web_pages(spark, sf_dir)
    return chapters.toc_starts(pages.select("book", "page", "path"), html.extract_links(pages, ["book", "page"]))


_SPANS = rf"""{_PAGES}, n AS (SELECT book, count(*) AS last FROM p GROUP BY book),
t AS (SELECT book, page AS left_, 'NAV' AS method FROM p WHERE path LIKE 'en/%' AND page > 0),
f AS (SELECT book, left_, method FROM t UNION ALL SELECT DISTINCT book, 0, method FROM t),
c AS (SELECT f.book, row_number() OVER (PARTITION BY f.book ORDER BY left_) - 1 AS index, left_, coalesce(lead(left_) OVER (PARTITION BY f.book ORDER BY left_), last) AS right_, method FROM f JOIN n USING (book))"""


def _spans(spark, sf_dir):
    """Chapters that start at a host's English pages, but the first page."""
    pages = web_pages(spark, sf_dir)
    starts = pages.filter(F.startswith("path", F.lit("en/")) & (F.col("page") > 0)).select("book", F.col("page").alias("start"), F.lit("NAV").alias("method"))
    return chapters.chapter_spans(starts, pages.groupBy("book").agg(F.count("*").alias("last")))


@query(rf'WITH {_SPANS} SELECT book, index, index AS number, left_ AS "left", right_ AS "right", method FROM c')
def w3_chapter_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(rf"""WITH {_SPANS}, z AS (SELECT book, index, lpad(CAST(index AS VARCHAR), CAST(greatest(len(CAST(max(index) OVER (PARTITION BY book) AS VARCHAR)), 2) AS INTEGER), '0') AS name FROM c)
SELECT book, name, lag(name) OVER (PARTITION BY book ORDER BY index) AS prev, lead(name) OVER (PARTITION BY book ORDER BY index) AS next FROM z""")
def w4_nav_titles(spark, sf_dir):
    """Names and neighbours of the chapters."""
    return chapters.nav_titles(_spans(spark, sf_dir), least=2).select("book", "name", "prev", "next")


@query(rf"""WITH {_SPANS}, z AS (SELECT book, index, lpad(CAST(index AS VARCHAR), CAST(len(CAST(max(index) OVER (PARTITION BY book) AS VARCHAR)) AS INTEGER), '0') AS name FROM c), y AS (SELECT *, lead(name) OVER (PARTITION BY book ORDER BY index) AS next FROM z)
SELECT book, '<t>' || name || '</t>' || book || '<a href=' || coalesce(next || '.html', '') || '>' || CASE WHEN next IS NULL THEN '' ELSE 'on' END || '</a></t>' AS html FROM y""")
def r4_html_documents(spark, sf_dir):
    """The chapters of all hosts in a template, the host's name as the body."""
    named = chapters.nav_titles(_spans(spark, sf_dir))
    return chapters.html_documents(named.withColumn("text", F.col("book")), "<t>{TITLE}</t>", "</t>", "<a href={NEXT_LINK}>{NEXT_TEXT}</a>", next_text="on").select("book", "html")


@query()
def r4_chapter_html(spark, sf_dir):
    """The chapters of all hosts, however many they have, with their pages' texts in a template; no SQL."""
    pages = web_pages(spark, sf_dir)
    spans = _spans(spark, sf_dir)
    texts = chapters.chapter_documents(html.extract_blocks(pages, ["book", "page"]), pages, spans.select("book", F.col("left").alias("start")))
    named = chapters.nav_titles(spans, least=2).join(texts.withColumnRenamed("chapter", "left"), ["book", "left"], "left").fillna("", "text")
    return chapters.html_documents(named, "<t>{TITLE}</t>", "</t>", "<a href={NEXT_LINK}>{NEXT_TEXT}</a>", next_text="on").select("book", "name", "html")


@query(rf"""WITH {_PAGES}, h AS (SELECT book, path, unnest(list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: split_part(x, '#', 1))) AS href FROM p),
u AS (SELECT DISTINCT book, href AS path FROM h) SELECT book, path FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.book = u.book AND p.path = u.path)""")
def j9_missing_assets(spark, sf_dir):
    """The links of each host's pages, taken for assets, that are no pages of it."""
    pages = web_pages(spark, sf_dir)
    links = html.extract_links(pages, ["book", "page"]).groupBy("book", "page").agg(F.collect_set("href").alias("images"))
    used = chapters.used_images(links, pages.select("book", "page", "path"))
    return chapters.missing_assets(used, pages.select("book", "path"))[0]


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[^&#]') THEN concat(regexp_extract(url, '^([a-z]+)://', 1), 'x/', regexp_extract(url, '[?&]page=([^&#]+)', 1)) ELSE url END AS clean,
regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages""")
def f1_clean_url(spark, sf_dir):
    """F1 with the pages' own parameter in place of the shops'; the value of `page` is no URL, so its path alone is left."""
    pages = table(spark, sf_dir, "pages")
    clean = T.clean_url(F.lit("Yahoo"), F.col("url"), yahoo="page")
    return pages.select("page_id", F.when(clean != F.col("url"), F.concat(F.regexp_extract("url", "^([a-z]+)://", 1), F.lit("x/"), clean)).otherwise(F.col("url")).alias("clean"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query(r"""SELECT doc_id, concat('AB:', doc_id, ' ！') AS half, replace(text, 'the', '') AS bare, doc_id % 2 = 0 AS kana,
CASE WHEN doc_id % 3 = 0 THEN concat('### 第', doc_id, '话　「', split_part(text, chr(10), 1), '」') ELSE concat('第', doc_id, '页「', split_part(text, chr(10), 1), '」') END AS marked, doc_id % 3 = 0 AS chapter FROM documents""")
def f_text_functions(spark, sf_dir):
    """F4, F9, F10, F13 on the documents' text with wide letters, ruby, kana and titles put in."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    wide = F.concat(F.lit("ＡＢ："), F.translate(number, "0123456789", "０１２３４５６７８９"), F.lit("　！"))
    ruby = F.replace("text", F.lit("the"), F.lit("<ruby><rt>the</rt></ruby>"))
    kana = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit("あ")).otherwise(F.lit("・")))
    title = F.concat(F.lit("第"), number, F.when(F.col("doc_id") % 3 == 0, F.lit("话")).otherwise(F.lit("页")), F.lit("“"), F.get(F.split("text", "\n"), 0), F.lit("”"))
    marks = T.chapter_marks(title)
    return docs.select("doc_id", T.half_width(wide).alias("half"), T.strip_ruby(ruby).alias("bare"), T.has_kana(kana).alias("kana"), marks["text"].alias("marked"), marks["chapter"].alias("chapter"))


# ---- lines and paragraphs


_REPEATED = rf"""WITH {_PAGE_LINES}, d AS (SELECT DISTINCT doc, page, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
n AS (SELECT doc, count(DISTINCT page) AS n_pages FROM l GROUP BY doc),
r AS (SELECT doc, line, count(*) AS n_found, n_pages FROM d JOIN n USING (doc) WHERE line <> '' GROUP BY doc, line, n_pages HAVING count(*) >= 0.1 * n_pages)"""


@query(f"{_REPEATED} SELECT doc, line, n_found, n_pages FROM r")
def a3_repeated_lines(spark, sf_dir):
    return layout.repeated_lines(page_lines(spark, sf_dir), 0.1)


@query(rf"{_REPEATED} SELECT doc, page, pos, line FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND r.line = regexp_replace(l.line, '^\s+|\s+$', '', 'g'))")
def a3_drop_repeated(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    return layout.drop_repeated(lines, layout.repeated_lines(lines, 0.1))


_SHEETS = "l AS (SELECT doc_id AS doc, pos // 20 AS page, pos, line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents))"


@query(rf"""WITH {_SHEETS}, m AS (SELECT doc, page, pos, line, regexp_replace(line, '^\s+|\s+$', '', 'g') = '' AS blank,
lead(page) OVER o <> page AS page_end FROM l WINDOW o AS (PARTITION BY doc ORDER BY page, pos)),
c AS (SELECT *, blank OR line LIKE '% ' OR (coalesce(page_end, false) AND regexp_matches(line, '[.?!]$')) AS closes FROM m),
o AS (SELECT *, CAST(blank OR coalesce(lag(closes) OVER (PARTITION BY doc ORDER BY page, pos), true) AS INTEGER) AS opens FROM c),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY page, pos) - 1 AS para FROM o)
SELECT doc, CAST(para AS BIGINT) AS para, rtrim(string_agg(CASE WHEN blank THEN '' ELSE line END, '' ORDER BY page, pos)) AS text FROM n GROUP BY doc, para""")
def w8_paragraphs(spark, sf_dir):
    """Documents in pages of 20 lines."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return layout.rebuild_paragraphs(rows.withColumn("page", F.floor(F.col("pos") / 20)), (".", "?", "!"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w5_renumber(spark, sf_dir):
    return layout.renumber(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 1).select("o_custkey", "o_orderkey", "number")


@query()
def w6_merge_ocr(spark, sf_dir):
    """W6 on conversations: a turn is a page, new for users; every other conversation's users open with a chapter title."""
    turns = table(spark, sf_dir, "conversations")
    title = F.when((F.col("role") == "user") & (F.col("turn") % 4 < 2), F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("话 "))).otherwise(F.lit(""))
    line = lambda x, i: F.struct(x.alias("words"), F.when(i % 3 == 2, 200).otherwise(10).alias("left"))
    ocr = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.col("role") == "user").alias("new"), F.transform(F.split(F.concat(title, "text"), r"(?<=\.) "), line).alias("lines"))
    return layout.merge_ocr(ocr)


@query()
def w7_cluster_lines(spark, sf_dir):
    """W7 on the characters of the pages' URLs, set out in lines of twelve that drift."""
    pages = table(spark, sf_dir, "pages")
    chars = pages.select(F.lit("urls").alias("doc"), F.col("page_id").alias("page"), F.posexplode(F.split("url", "")).alias("seq", "text"))
    line = F.floor(F.col("seq") / 12)
    return layout.cluster_lines(chars.select("doc", "page", "seq", "text", F.when(F.col("text") == ".", 4.0).otherwise(10.0).alias("size"), (F.col("seq") % 12 * 9.0).alias("x0"), (700.0 - line * 14 - F.col("seq") % 12 * 0.1).alias("y1")))


# ---- segments


@query(rf"WITH {_DOC_LINES} SELECT doc, pos, line AS pure, first_value(line) OVER (PARTITION BY doc, line ORDER BY pos) AS origin FROM l")
def j12_origin_lines(spark, sf_dir):
    return segments.origin_lines(doc_lines(spark, sf_dir)).select("doc", "pos", "pure", "origin")


_SEGMENTS = rf"""WITH RECURSIVE {_DOC_LINES},
g AS (SELECT doc, pos, 0 AS seg, length(line) AS n FROM l WHERE pos = 0
UNION ALL SELECT l.doc, l.pos, CASE WHEN g.n + length(l.line) > 512 THEN g.seg + 1 ELSE g.seg END, CASE WHEN g.n + length(l.line) > 512 THEN length(l.line) ELSE g.n + length(l.line) END
FROM g JOIN l ON l.doc = g.doc AND l.pos = g.pos + 1)"""


@query(f"{_SEGMENTS} SELECT doc, seg, min(pos) AS pos_from, max(pos) AS pos_to, string_agg(line, chr(10) ORDER BY pos) AS text FROM g JOIN l USING (doc, pos) GROUP BY doc, seg")
def w9_segments(spark, sf_dir):
    """W9 on whole documents: their lines are at hand in the row, so nothing is shuffled."""
    found = segments.segments_of(table(spark, sf_dir, "documents"), own_lines(F.col("text")), "doc_id")
    return found.select("doc", "seg", "pos_from", "pos_to", F.array_join("lines", "\n").alias("text"))


_CONTEXT = rf"""WITH {_DOC_LINES}, c AS (SELECT doc, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY pos) AS e FROM l)
SELECT a.doc, a.pos, coalesce(string_agg(b.line, chr(10) ORDER BY b.pos), '') AS context FROM c a
LEFT JOIN c p ON p.doc = a.doc AND p.pos = a.pos - 1 LEFT JOIN c b ON b.doc = a.doc AND b.pos < a.pos AND p.e - b.e <= 257 GROUP BY a.doc, a.pos"""


@query(_CONTEXT)
def w10_context(spark, sf_dir):
    return segments.trailing_context(doc_lines(spark, sf_dir)).select("doc", "pos", "context")


@query(rf"""{_SEGMENTS}, b AS (SELECT doc, seg, string_agg(line, chr(10) ORDER BY pos) AS body FROM g JOIN l USING (doc, pos) GROUP BY doc, seg),
t AS (SELECT string_agg(n_name || '->' || upper(n_name) || CASE WHEN n_regionkey % 2 = 0 THEN ' #' || n_regionkey ELSE '' END, chr(10) ORDER BY n_nationkey) AS terms FROM nation)
SELECT doc, seg, '{segments.TURN}system' || chr(10) || '{segments.SYSTEM_TEXT}{segments.TURN_END}' || chr(10) || '{segments.TURN}user' || chr(10) || '{segments.TERMS_TEXT.strip()}' || chr(10) || terms || chr(10) || '{segments.WITH_TERMS_TEXT.strip()}' || chr(10) || body || '{segments.TURN_END}' || chr(10) || '{segments.TURN}assistant' || chr(10) AS prompt FROM b, t""")
def r5_prompts(spark, sf_dir):
    """The documents' segments, with nations as the glossary."""
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("src"), F.upper("n_name").alias("dst"), F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("info"))
    return segments.build_prompts(segments.segments_of(table(spark, sf_dir, "documents"), own_lines(F.col("text")), "doc_id"), terms, context=None).select("doc", "seg", "prompt")


_ATTEMPTS = r"""a AS (SELECT conv_id AS doc, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, turn AS attempt, role = 'system' AS err FROM conversations),
g AS (SELECT *, NOT err AND text <> '' AND position(chr(10) IN text) = 0 AS good FROM a WHERE attempt < 5)"""


@query(rf"""WITH {_ATTEMPTS}, f AS (SELECT doc, min(attempt) FILTER (WHERE good) AS first_, max(attempt) AS last_, count(*) AS n FROM g GROUP BY doc)
SELECT f.doc, coalesce(nullif(split_part(g.text, chr(10), 1), ''), '[N/A]') AS text, CAST(coalesce(first_ + 1, n) AS INTEGER) AS n_tried FROM f JOIN g ON g.doc = f.doc AND g.attempt = coalesce(first_, last_)""")
def w12_accept_line(spark, sf_dir):
    """A conversation is a line and its turns are the attempts; system turns are errors."""
    turns = table(spark, sf_dir, "conversations")
    tries = turns.select(F.col("conv_id").alias("doc"), F.lit(0).alias("pos"), F.col("turn").alias("attempt"), "text", F.when(F.col("role") == "system", F.lit("error")).alias("err"))
    return segments.accept_line(tries).drop("pos")


_PAIRED = """t AS (SELECT conv_id AS doc, turn AS seg, string_split(replace(text, chr(10), ' '), '. ') AS own, role, lead(string_split(replace(text, chr(10), ' '), '. ')) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS by_ FROM conversations)"""


@query(rf"""WITH {_PAIRED} SELECT doc, seg, unnest(range(0, len(own))) AS pos, unnest(own) AS line, unnest(answer) AS answer FROM t WHERE role = 'user' AND by_ = 'assistant' AND len(own) = len(answer)""")
def w13_align_segments(spark, sf_dir):
    """A user's turn is a segment of sentences and the assistant's next turn the answer."""
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    turns = turns.withColumns({"after": F.lead("text").over(order), "by": F.lead("role").over(order)})
    own = turns.filter("role = 'user'")
    given = own.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg"), F.lit(0).cast("long").alias("pos_from"), F.split("text", r"\. ", -1).alias("lines"))
    said = own.filter("by = 'assistant'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg"), F.lit(0).alias("try"), F.array_join(F.split("after", r"\. ", -1), "\n").alias("text"))
    return segments.align_segments(given, said)[0]


@query(rf"""WITH {_PAIRED} SELECT doc, seg, CASE WHEN array_to_string(own, '. ') LIKE '<img%' THEN array_to_string(own, '. ') || chr(10) || chr(10) ELSE array_to_string(answer, '. ') || '  ' || chr(10) || array_to_string(own, '. ') || chr(10) || chr(10) END AS block FROM t WHERE role = 'user' AND by_ = 'assistant'""")
def r3_bilingual(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    turns = turns.withColumns({"answer": F.lead("text").over(order), "by": F.lead("role").over(order)})
    pairs = turns.filter("role = 'user' AND by = 'assistant'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg"), F.col("text").alias("line"), "answer", F.col("text").alias("origin"))
    return segments.bilingual(pairs).select("doc", "seg", "block")


# ---- volumes and series


_EPISODES = """t AS (SELECT conv_id AS doc, turn, role = 'system' AS chapter, text, sum(CAST(role = 'system' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
u AS (SELECT doc, max(CAST(NOT chapter AND n = 0 AS INTEGER)) AS untitled FROM t GROUP BY doc),
e AS (SELECT doc, CAST(n + untitled AS INTEGER) AS vol, coalesce((SELECT s.text FROM t s WHERE s.doc = t.doc AND s.n = t.n AND s.chapter), '') AS vol_title, turn, text, row_number() OVER (PARTITION BY doc, n ORDER BY turn) - 1 AS ord FROM t JOIN u USING (doc) WHERE NOT chapter)"""


def _episodes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    tabs = turns.select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "chapter").otherwise("episode").alias("kind"), "text", F.col("turn").cast("string").alias("href"))
    return catalog.episodes(tabs)


@query(f"WITH {_EPISODES} SELECT doc, vol, vol_title, ord, text AS title, CAST(turn AS VARCHAR) AS href FROM e")
def w1_episodes(spark, sf_dir):
    """A system turn opens a volume, the other turns are its episodes."""
    return _episodes(spark, sf_dir)


@query(rf"""WITH {_EPISODES}, v AS (SELECT doc, vol, vol_title, string_agg('### ' || text || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10), chr(10) || chr(10) ORDER BY ord) AS body FROM e GROUP BY doc, vol, vol_title)
SELECT doc, vol, CASE WHEN vol = min(vol) OVER (PARTITION BY doc) THEN '# novel ' || doc || chr(10) || chr(10) ELSE '' END || CASE WHEN vol_title <> '' THEN '## ' || vol_title || chr(10) || chr(10) ELSE '' END || body AS text FROM v""")
def a2_volume_documents(spark, sf_dir):
    """A2: the volumes of W1 put together; an episode's text is its title and its body."""
    parts = _episodes(spark, sf_dir).withColumn("body", F.col("title"))
    return catalog.volume_documents(parts, parts.select("doc").distinct().withColumn("title", F.concat(F.lit("novel "), F.col("doc").cast("string"))))


@query(r"""WITH s AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 's' || (conv_id // 9) ELSE CAST(conv_id AS VARCHAR) END AS key, conv_id, conv_id % 3 = 0 AS serial, conv_id // 9 AS sid,
'### t' || conv_id || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'intro' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || regexp_replace(string_agg(text, chr(10) || chr(10) || chr(10) || chr(10) || '　◇' || chr(10) || chr(10) || chr(10) || chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') AS block FROM conversations GROUP BY conv_id)
SELECT key, CASE WHEN bool_or(serial) THEN '## name ' || min(sid) || chr(10) || chr(10) ELSE '' END || string_agg(block, chr(10) || chr(10) || chr(10) || chr(10) ORDER BY conv_id DESC) || chr(10) AS text FROM s GROUP BY key""")
def a10_compile_series(spark, sf_dir):
    """A10: a conversation is a story of its turns; every third belongs to a series."""
    turns = table(spark, sf_dir, "conversations")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("parts"))
    serial, number = F.col("conv_id") % 3 == 0, F.floor(F.col("conv_id") / 9).cast("string")
    stories = parts.select(
        F.col("conv_id").cast("string").alias("id"), F.col("conv_id").alias("crawl"), F.when(serial, F.concat(F.lit("name "), number, F.lit(" #1"))).alias("series"), F.when(serial, number).alias("series_id"),
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, F.lit("intro")).alias("intro"), "parts",
    )
    return catalog.compile_series(stories)


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC) - 1 AS k FROM lineitem),
i AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY l_orderkey)
SELECT i.l_orderkey AS series, CAST(min(k) AS INTEGER) AS "order" FROM i JOIN v ON v.l_orderkey = i.l_orderkey AND v.d = i.d GROUP BY i.l_orderkey""")
def w11_series_order(spark, sf_dir):
    """An order is a series and its lines are volumes, the newest first; the item is the last shipped one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.date_format("l_shipdate", "yyyy-MM-dd"))
    volumes = lines.select(F.col("l_orderkey").alias("series"), F.struct("l_linenumber", "l_shipdate").alias("pos"), F.col("l_partkey").cast("string").alias("title"), "date", F.lit(True).alias("newest_first"))
    items = lines.groupBy(F.col("l_orderkey").alias("series")).agg(F.max("date").alias("date"))
    return catalog.series_order(volumes, items).select("series", "order")


# ---- catalogue


def _books(spark, sf_dir):
    """orders as books: month and day of the date, label = priority, ord = key; page null, '' or a link by the status."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    page = F.when(F.col("o_orderstatus") == "O", F.lit("")).when(F.col("o_orderstatus") == "F", F.concat(F.lit("p/"), key))
    shop = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Amazon")).otherwise(F.lit("Yahoo"))
    return orders.select(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.day("o_orderdate").alias("day"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("title "), F.col("o_custkey").cast("string")).alias("title"), page.alias("page"), F.create_map(shop, F.concat(F.lit("u/"), key)).alias("link"), F.lit(False).alias("new"))


_BOOKS = """b AS (SELECT strftime(o_orderdate, '%Y%m') AS month, CAST(day(o_orderdate) AS INTEGER) AS day, o_orderpriority AS label, o_orderkey AS ord, 'title ' || o_custkey AS title,
CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN 'p/' || o_orderkey END AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'Amazon' ELSE 'Yahoo' END AS brand, 'u/' || o_orderkey AS url FROM orders)"""


def _labels(books):
    names = books.select("label").distinct()
    return names.select("label", F.upper("label").alias("zh"), F.concat(F.lit("j"), "label").alias("jp"), F.concat(F.lit("p"), "label").alias("pub"), F.substring("label", 1, 1).cast("int").alias("ord"))


@query(f"WITH {_BOOKS} SELECT month, day, label, count(*) AS n, string_agg(title, '|' ORDER BY ord) AS titles FROM b GROUP BY month, day, label")
def a1_nest_catalog(spark, sf_dir):
    found = catalog.nest_catalog(_books(spark, sf_dir).withColumn("day", F.struct("month", "day")))
    return found.select("day.month", "day.day", "label", "n", F.array_join(F.transform("books", lambda b: b["title"]), "|").alias("titles"))


@query("SELECT c_custkey, c_name, n_name AS jp, n_regionkey AS pub FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j1_with_labels(spark, sf_dir):
    """Customers under the labels of their nations."""
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("jp"), F.col("n_regionkey").alias("pub"))
    return catalog.with_labels(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "label"), labels).select("c_custkey", "c_name", "jp", "pub")


@query(f"""WITH {_BOOKS}, l AS (SELECT DISTINCT label, upper(label) AS zh FROM b), e AS (SELECT b.*, zh, CASE WHEN coalesce(page, '') = '' THEN title ELSE '[url=' || page || ']' || title || '[/url]' END || ' ([url=' || url || ']' || brand || '[/url])' AS entry FROM b JOIN l USING (label)),
x AS (SELECT month, day, label, min(ord) AS f, '[b][size=20]' || zh || '[/size][/b]' || chr(10) || string_agg(entry, chr(10) ORDER BY ord) AS t FROM e GROUP BY month, day, label, zh),
y AS (SELECT month, day, min(f) AS f, '[b][size=25]' || CAST(CAST(substr(month, 5) AS INTEGER) AS VARCHAR) || '/' || day || '[/size][/b]' || chr(10) || string_agg(t, chr(10) ORDER BY f) || chr(10) AS t FROM x GROUP BY month, day),
n AS (SELECT string_agg(zh, '、' ORDER BY zh) AS names FROM l), k AS (SELECT month, count(*) AS newly FROM b WHERE page <> '' GROUP BY month),
z AS (SELECT month, string_agg(t, chr(10) ORDER BY f) AS t, CAST(substr(month, 1, 4) AS INTEGER) AS yy, CAST(substr(month, 5) AS INTEGER) AS mm FROM y GROUP BY month)
SELECT month, CASE WHEN mm = 1 THEN (yy - 1) || ' 年 12 月' ELSE yy || ' 年 ' || (mm - 1) || ' 月' END || '文库・单行本新刊情报' || chr(10) || '已添加 ' || coalesce(newly, 0) || ' 个独立词条' || chr(10) || chr(10) || t || chr(10) || '收录书系：' || names || chr(10) AS text FROM z LEFT JOIN k USING (month), n""")
def r1_monthly_report(spark, sf_dir):
    """The report of every month of orders; a month's found orders are the increments of its log."""
    books = _books(spark, sf_dir)
    logs = books.filter("page <> ''").select("month", F.lit("newly-append").alias("action"), F.lit(1).alias("increment"), F.lit(0).alias("ord"), F.lit(0).alias("ts_ms"), F.lit(None).cast("long").alias("total"))
    return catalog.monthly_report(books, _labels(books), logs)


@query(f"""WITH {_BOOKS} SELECT month, day, ord, 'p' || label AS publisher, substr(month, 1, 4) || '-' || substr(month, 5) || '-' || lpad(CAST(day AS VARCHAR), 2, '0') AS date,
'{{{{Infobox animanga/Novel' || chr(10) || '|作者= ' || chr(10) || '|插图= ' || chr(10) || '|出版社= p' || label || chr(10) || '|书系= j' || label || chr(10) || '|价格= ' || chr(10) || '|发售日= ' || substr(month, 1, 4) || '-' || substr(month, 5) || '-' || lpad(CAST(day AS VARCHAR), 2, '0') || chr(10) || '|页数= ' || chr(10) || '|ISBN= ' || chr(10) || '}}}}' AS infobox FROM b WHERE page = '' AND brand = 'Amazon'""")
def j8_worklist_infobox(spark, sf_dir):
    """The orders that were searched and not found, with a link at one shop, as worklist items with their infobox."""
    books = _books(spark, sf_dir)
    items = catalog.infobox(catalog.missing_worklist(books, _labels(books), "Amazon"))
    return items.select("month", "day", "ord", "info.publisher", "info.date", "infobox")


@query("""WITH l AS (SELECT l_partkey AS title, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'q/' || l_returnflag END AS page FROM lineitem),
b AS (SELECT *, CASE WHEN page = '' THEN row_number() OVER (PARTITION BY title, page = '' ORDER BY ord) END AS k FROM l),
f AS (SELECT p_partkey AS title, o_orderkey AS subject, row_number() OVER (PARTITION BY p_partkey ORDER BY o_orderkey) AS k FROM orders JOIN part ON o_custkey = p_partkey)
SELECT b.title, b.ord, coalesce('n/' || f.subject, page) AS page, f.subject IS NOT NULL AS new FROM b LEFT JOIN f ON f.title = b.title AND f.k = b.k""")
def j7_backfill(spark, sf_dir):
    """Lines as books titled by their part; orders whose customer has a part's number are that part's feedback."""
    lines = table(spark, sf_dir, "lineitem")
    books = lines.select(F.col("l_partkey").alias("title"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("q/"), "l_returnflag")).alias("page"), F.lit(False).alias("new"))
    found = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "part"), F.col("o_custkey") == F.col("p_partkey"))
    return catalog.backfill(books, found.select(F.col("o_orderkey").alias("ord"), F.col("p_partkey").alias("original_title"), F.col("o_orderkey").alias("subject")), "n/")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)")
def j10_unseen(spark, sf_dir):
    """The parts of lines that are not on record, the record being the parts of size up to 40."""
    record = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return catalog.unseen(table(spark, sf_dir, "lineitem").select("l_partkey"), record, "l_partkey")[0]


@query("""SELECT user_id, count(*) AS n_logs, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS newly,
min_by(event_type, event_id) AS first_action, max_by(event_type, event_id) AS last_action FROM events GROUP BY user_id""")
def a8_log_rollup(spark, sf_dir):
    """The log of each user; purchases are the increments."""
    events = table(spark, sf_dir, "events")
    logs = events.select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_type") == "purchase", "newly-append").otherwise(F.col("event_type")).alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("total"), F.floor("value").alias("increment"))
    rolled = catalog.log_rollup(logs, ("user_id",))
    return rolled.select("user_id", "n_logs", "newly", F.col("total").alias("first_action"), F.when(F.col("last_action") == "newly-append", "purchase").otherwise(F.col("last_action")).alias("last_action"))


@query("""SELECT event_type, count(*) AS n, bool_and(value > 1) AS complete, count(*) FILTER (WHERE NOT value > 1) AS n_open FROM events GROUP BY event_type""")
def a9_completeness(spark, sf_dir):
    return catalog.completeness(table(spark, sf_dir, "events"), F.col("value") > 1, ("event_type",))


@query(f"WITH {_BOOKS} SELECT month, day, label, title, page, brand || ' ' || url AS link FROM b")
def s5_catalog_round_trip(spark, sf_dir):
    """Every month of orders written as the catalogue's JSON and flattened again."""
    books = _books(spark, sf_dir)
    logs = books.select("month").distinct().select("month", F.lit(0).alias("ord"), F.lit("init").alias("action"), F.lit(0).cast("long").alias("ts_ms"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("increment"))
    back, _ = source.flatten_catalog(source.catalog_json(books, logs))
    return back.select("month", "day", "label", "title", "page", F.array_join(F.transform(F.map_entries("link"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ",").alias("link"))


@query("""SELECT o_orderkey, 'c' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '+d' END AS author, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey ELSE 'x' END AS illust,
strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(10 * o_custkey AS VARCHAR) AS price, 'k' || o_orderkey || '.jpg' AS cover FROM orders""")
def f_product_fields(spark, sf_dir):
    """Product pages' fields made of orders."""
    orders = table(spark, sf_dir, "orders")
    number = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    creators = F.when(F.col("o_custkey") % 2 == 0, F.concat(number, F.lit("(著・絵)"))).otherwise(F.concat(number, F.lit("(著) , x(絵),d(著),y(訳)")))
    date = F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), F.month("o_orderdate").cast("string"), F.lit("月"), F.day("o_orderdate").cast("string"), F.lit("日"))
    cover = F.concat(F.lit("https://i.example/a/k"), F.col("o_orderkey").cast("string"), F.lit(".jpg?x=1"))
    made = orders.select("o_orderkey", T.product_fields(F.create_map(F.lit("著者／編集"), creators), F.col("o_custkey") * 11, F.array(F.lit("d")), cover).alias("f"), T.parse_jp_date(F.concat(F.lit("発売 "), date)).alias("date"))
    return made.select("o_orderkey", F.array_join("f.author", "+").alias("author"), F.array_join("f.illust", "+").alias("illust"), "date", F.replace("f.price", F.lit("￥"), F.lit("")).alias("price"), "f.cover")


# ---- matching


def _titles(spark, sf_dir):
    """parts as books and as subjects, on the same day if type and brand agree; large ones are series."""
    part = table(spark, sf_dir, "part")
    day = F.concat_ws("/", "p_type", "p_brand")
    books = part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), day.alias("date"))
    subjects = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), day.alias("date"), (F.col("p_size") > 25).alias("series"), F.lit("其他").alias("platform"), F.col("p_partkey").alias("rank"))
    return books, subjects


@query("SELECT a.p_partkey AS book_id, b.p_partkey AS id FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand WHERE b.p_size <= 25")
def j3_candidates(spark, sf_dir):
    return match.block_candidates(*_titles(spark, sf_dir)).select("book_id", "id")



# ---- images and streams


@query("""SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda v: v > 0.1)) / len(embedding) AS high_share, CAST(list_max(embedding) - list_min(embedding) AS FLOAT) AS spread FROM embeddings""")
def a5_array_stats(spark, sf_dir):
    """A5 on one array for each image, as the embeddings are."""
    return pixels.array_stats(table(spark, sf_dir, "embeddings"), "embedding", 0.1).select("vec_id", "n", "high_share", "spread")


@query("""SELECT page_id, CAST(length(url) < 60 AS INTEGER) + CAST(length(html) < 2000 AS INTEGER) + CAST(page_id % 9 < 4 AS INTEGER) >= 2 AS inline FROM pages""")
def a6_inline_images(spark, sf_dir):
    """A page as an image of the URL's length and height 1, of its own size, coloured by its id."""
    facts = table(spark, sf_dir, "pages").select("page_id", F.length("url").alias("width"), F.lit(1).alias("height"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 9).cast("double").alias("color"))
    return pixels.inline_images(facts, 60, 2000, 4.0).select("page_id", "inline")


@query("SELECT DISTINCT user_id FROM events")
def t1_stream_unseen(spark, sf_dir):
    """Events as a stream of files; each user's first event passes."""
    return _drained(spark, sf_dir, lambda s: jobs.stream_unseen(s, "user_id").select("user_id"))


@query("""SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS stage FROM events GROUP BY user_id""")
def t2_stream_stages(spark, sf_dir):
    """The highest stage that each user reaches in a stream of events."""
    stage = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    path = f"{_scratch(spark)}/stages"
    stream = _stream(spark, sf_dir).select("user_id", stage.alias("stage"))
    jobs.run_available(jobs.stage_writer(stream, path, "user_id"))
    return jobs.current_stages(spark, path, "user_id")


def _scratch(spark) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: the table may be a file or a folder


def _drained(spark, sf_dir, job) -> DataFrame:
    """What a job makes of the events' stream, worked off and read back."""
    path = _scratch(spark)
    out = job(_stream(spark, sf_dir))
    writer = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    jobs.run_available(writer)
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


from . import further, more  # noqa: E402, F401  (register the further queries)
