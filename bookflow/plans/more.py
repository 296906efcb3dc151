"""Further registered queries: archives, page layouts, lines and matching, on pages and names made of the driver's tables.

What an operator reads (archives, pages of shops and novels, pixels, recognised lines) is built from the tables
row by row inside the query, so that each query's work grows with its table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions import text as T
from bookflow.operators import catalog, chapters, html, layout, match, pixels, segments
from bookflow.sources import archives, lines
from bookflow.sources.shared import shared_dir

from . import fixtures
from .queries import _BOOKS, _PAGES, _SEGMENTS, _books, _titles, query, table, web_pages


# ---- archives


def _members(spark, sf_dir) -> DataFrame:
    """The members of archives that hold PAGES pages of a host each."""
    pages = web_pages(spark, sf_dir)
    rows = pages.select(F.format_string("%s-%d", "book", F.floor(F.col("page") / fixtures.PAGES)).alias("book"), (F.col("page") % fixtures.PAGES).alias("n"), "html")
    return archives.unzipped(rows.groupBy("book").applyInPandas(fixtures.zipped, "path string, content binary"), "/lib")


_ARCHIVES = rf"""{_PAGES}, a AS (SELECT concat(book, '-', page // 20) AS book, page % 20 AS n, html FROM p),
m AS (SELECT *, max(n) OVER (PARTITION BY book) AS top FROM a)"""


@query(rf"WITH {_ARCHIVES} SELECT book, top - n AS page, concat('OEBPS/t/', n, '.xhtml') AS path, html FROM m")
def s1_archive_pages(spark, sf_dir):
    """Archives unzipped, their packages read, and the pages put in the spine's order."""
    members = _members(spark, sf_dir)
    order = chapters.reading_order(*archives.package_tables(members))
    return order.join(archives.member_texts(members), ["book", "path"])


@query(rf"""WITH {_ARCHIVES}, s AS (SELECT book, top - n AS start FROM m WHERE n % 3 = 0), t AS (SELECT book, start FROM s UNION SELECT DISTINCT book, 0 FROM s),
c AS (SELECT book, start AS left_, lead(start) OVER (PARTITION BY book ORDER BY start) AS next FROM t), z AS (SELECT DISTINCT book, top + 1 AS last FROM m)
SELECT book, left_ AS "left", coalesce(next, last) AS "right", 'NAV' AS method FROM c JOIN z USING (book)""")
def w2_archive_chapters(spark, sf_dir):
    """X6, W2 by NAV, W3: chapters from the archives' tables of contents."""
    members = _members(spark, sf_dir)
    manifest, spine = archives.package_tables(members)
    pages = chapters.reading_order(manifest, spine)
    texts = archives.member_texts(members)
    contents = texts.join(manifest.filter("properties = 'nav'").select("book", "path"), ["book", "path"])
    nav = html.nav_links(contents, ["book", "path"]).select("book", T.folder(F.col("path")).alias("base"), "href")
    links = html.extract_links(pages.join(texts, ["book", "path"]), ["book", "page"])
    starts = chapters.toc_starts(pages, links, nav)
    return chapters.chapter_spans(starts, pages.groupBy("book").agg(F.count("*").alias("last"))).select("book", "left", "right", "method")


@query(rf"""WITH {_PAGES}, k AS (SELECT *, len(book) % 4 AS way, max(page) OVER (PARTITION BY book) AS top FROM p),
s AS (SELECT book, page AS start, 'MANUAL' AS method FROM k WHERE way = 0 AND page % 2 = 0
UNION ALL SELECT book, page, 'NAV' FROM k WHERE way = 1 AND page % 3 = 0
UNION ALL SELECT book, page, 'TOC' FROM k WHERE way = 2 AND page % 2 = 1
UNION ALL SELECT book, page, 'TRIVIAL' FROM k WHERE way = 3 OR (way = 2 AND top = 0)) SELECT * FROM s""")
def w2_all_ways(spark, sf_dir):
    """Hosts by the length of their names: split by hand, by a navigation page, by the page of most links, or by pages, where links lead nowhere."""
    pages = web_pages(spark, sf_dir).select("book", "page", F.concat(F.lit("t/"), F.col("page").cast("string")).alias("path"), (F.length("book") % 4).alias("way"))
    splits = pages.filter("way = 0 AND page % 2 = 0").select("book", F.col("page").alias("left"))
    nav = pages.filter("way = 1").select("book", F.lit("nav/x").alias("base"), F.when(F.col("page") % 3 == 0, F.concat(F.lit("../../"), "path", F.lit("#a"))).otherwise(F.lit("../none")).alias("href"))
    toc = pages.filter("way = 2 AND page % 2 = 1").select("book", F.lit(0).alias("page"), F.col("page").alias("pos"), F.concat(F.lit("./"), F.col("page").cast("string")).alias("href"))
    odd = pages.filter("way = 3").select("book", "page", F.lit(0).alias("pos"), F.lit("none").alias("href"))
    return chapters.toc_starts(pages.drop("way"), toc.unionByName(odd), nav, splits)


@query(rf"""WITH {_PAGES}, i AS (SELECT book, CAST(length(html) % 2 = 0 AS INTEGER) AS inline FROM p WHERE page % 2 = 0), g AS (SELECT book, count(*) AS n_images, sum(inline) AS n_inline FROM i GROUP BY book)
SELECT book, count(*) AS n_texts, any_value(n_images) AS n_images, CAST(any_value(n_inline) AS BIGINT) AS n_inline, count(*) FILTER (WHERE page % 5 = 0) AS n_chapters, 'NAV' AS method FROM p JOIN g USING (book) GROUP BY book""")
def a7_book_summary(spark, sf_dir):
    """Every other page counts as an image, and every fifth opens a chapter."""
    pages = web_pages(spark, sf_dir)
    images = pages.filter("page % 2 = 0").select("book", (F.length("html") % 2 == 0).alias("inline"))
    return chapters.book_summary(pages, images, pages.filter("page % 5 = 0").select("book", F.lit("NAV").alias("method")))


@query(rf"""WITH {_PAGES}, s AS (SELECT DISTINCT book, page // 5 AS ord FROM p) SELECT p.book, p.page, s.ord, 'part ' || s.ord AS title FROM p JOIN s ON s.book = p.book AND p.page >= 5 * s.ord - 1 AND p.page < 5 * s.ord + 5""")
def j11_ranges(spark, sf_dir):
    """Splits of five pages that also hold the last page before them."""
    pages = web_pages(spark, sf_dir).select("book", "page")
    ord_ = F.floor(F.col("page") / 5)
    splits = pages.select("book", ord_.alias("ord")).distinct().select("book", "ord", F.concat(F.lit("part "), F.col("ord").cast("string")).alias("title"), (5 * F.col("ord") - 1).alias("left"), (5 * F.col("ord") + 5).alias("right"))
    return chapters.assign_ranges(pages, splits)


@query("""SELECT n_name AS book, CASE WHEN n_nationkey % 3 = 0 THEN 'own' || n_regionkey ELSE 'all' END AS mode, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '0' END AS fill, 'd' AS page FROM nation""")
def j13_overlay_config(spark, sf_dir):
    """Every third nation has overrides of its own, the first of which counts."""
    nation = table(spark, sf_dir, "nation")
    own = F.create_map(F.lit("mode"), F.concat(F.lit("own"), F.col("n_regionkey").cast("string")), F.lit("fill"), F.lit("x"))
    first = nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.lit(1).alias("ord"), own.alias("config"))
    later = first.select("name", F.lit(2).alias("ord"), F.create_map(F.lit("mode"), F.lit("later")).alias("config"))
    found = chapters.overlay_config(nation.select(F.col("n_name").alias("book")), {"mode": "none", "fill": "0", "page": "d"}, later.unionByName(first), {"mode": "all"})
    return found.select("book", F.col("config")["mode"].alias("mode"), F.col("config")["fill"].alias("fill"), F.col("config")["page"].alias("page"))


# ---- pages of shops and novels


@query("""SELECT p_partkey, p_brand AS author_field, 'https://i.example/' || p_partkey || '.jpg' AS cover_url, CAST(p_size AS VARCHAR) AS price, p_name AS description, '/series/' || p_type AS series_url FROM part""")
def x1_product_records(spark, sf_dir):
    """A product page for each part, written and read back."""
    part = table(spark, sf_dir, "part")
    row = lambda key, value: F.concat(F.lit(f'<li class="x productInfo"><span class="category"> {key} </span><span class="categoryValue">'), value, F.lit("</span></li>"))
    page = F.concat(
        F.lit("<ul>"), row("著者／編集", F.col("p_brand")), row("シリーズ", F.concat(F.lit('<a href="/series/'), "p_type", F.lit('">s</a>'))), F.lit('</ul><span class="price" content="'), F.col("p_size").cast("string"),
        F.lit('">y</span><div class="saleDesc"><h3>d</h3><p> '), fixtures.escaped(F.col("p_name")), F.lit(' </p></div><div id="imageSliderWrap"><img src="//i.example/'), F.col("p_partkey").cast("string"), F.lit('.jpg"></div>'),
    )
    found = html.extract_records(part.select("p_partkey", page.alias("html")), "product", ["p_partkey"])
    return found.select("p_partkey", F.col("meta")["著者／編集"].alias("author_field"), "cover_url", "price", F.get("descriptions", 0).alias("description"), "series_url")


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos, 'v ' || l_partkey || ' & ' || l_linenumber AS title, strftime(l_shipdate, '%Y-%m-%d') AS date, l_orderkey % 2 = 0 AS newest_first FROM lineitem""")
def x1_volume_records(spark, sf_dir):
    """A series page for each order, its lines as volumes."""
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"))
    title = F.concat(F.lit("v "), F.col("l_partkey").cast("string"), F.lit(" &amp; "), F.col("l_linenumber").cast("string"))
    date = F.concat(F.year("l_shipdate").cast("string"), F.lit("年"), F.month("l_shipdate").cast("string"), F.lit("月"), F.day("l_shipdate").cast("string"), F.lit("日 発売"))
    item = F.concat(F.lit('<li class="list__info"><p class="info__title">'), title, F.lit('</p><p class="info__date">'), date, F.lit("</p></li>"))
    pages = fixtures.joined(rows, "l_orderkey", "at", item)
    order = F.when(F.col("l_orderkey") % 2 == 0, F.lit("新しい順")).otherwise(F.lit("古い順"))
    pages = pages.withColumn("html", F.concat(F.lit('<div class="sort__order__list"><span class="active">'), order, F.lit("</span></div>"), "html"))
    return html.extract_records(pages, "volumes", ["l_orderkey"])


@query(r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN role = 'system' THEN 'chapter' ELSE 'episode' END AS kind, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, CASE WHEN role <> 'system' THEN '/n/' || conv_id || '/' || turn END AS href FROM conversations""")
def x1_episode_records(spark, sf_dir):
    """The index page of a novel for each conversation."""
    turns = table(spark, sf_dir, "conversations")
    number = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    item = F.when(F.col("role") == "system", F.concat(F.lit('<div class="p-eplist__chapter-title">'), fixtures.escaped(F.col("text")), F.lit("</div>"))).otherwise(F.concat(F.lit('<div class="p-eplist__sublist"><a href="/n/'), number, F.lit('">'), fixtures.escaped(F.col("text")), F.lit("</a> date</div>")))
    return html.extract_records(fixtures.joined(turns, "conv_id", "turn", item, '<div class="p-eplist">', "</div>"), "episodes", ["conv_id"])


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, CAST(event_id AS VARCHAR) AS work_id FROM events WHERE event_type <> 'view'""")
def x1_work_records(spark, sf_dir):
    """The list of works of each user; a view is an entry without a work."""
    events = table(spark, sf_dir, "events")
    href = F.when(F.col("event_type") == "view", F.lit("/users/1")).otherwise(F.concat(F.lit("/novel/show.php?id="), F.col("event_id").cast("string")))
    item = F.concat(F.lit('<li offset="0"><a href="/u">u</a><a href="'), href, F.lit('">w</a></li>'))
    return html.extract_records(fixtures.joined(events, "user_id", "event_id", item, "<ul>", "</ul>"), "works", ["user_id"])


_OWN_LINES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS own FROM documents),
l AS (SELECT doc_id, unnest(own) AS line, unnest(range(0, len(own))) AS i FROM s), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l)"""


@query(rf"""WITH {_OWN_LINES}, b AS (SELECT doc_id, i, CASE WHEN i % 6 = 1 THEN 'heading' ELSE 'text' END AS kind, CASE WHEN i % 6 = 1 THEN 2 ELSE 0 END AS level,
CASE i % 6 WHEN 0 THEN line WHEN 1 THEN '#### ' || line WHEN 2 THEN '<div><b>' || line || '</b>tail</div>' || coalesce(next || 'x', '') WHEN 4 THEN 'a|' || line ELSE '<ruby>漢<rt>' || line || '</rt></ruby>' END AS line FROM n WHERE i % 6 <> 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, kind, level, line FROM b""")
def x4_line_blocks(spark, sf_dir):
    """The documents' lines as paragraphs, headings, loose pieces that make one block, line breaks and ruby."""
    forms = [fixtures.tagged("<p>", "</p>\n"), fixtures.tagged("<h2>", "</h2>"), fixtures.tagged("<div><b>", "</b> tail</div>"), fixtures.tagged("<span>", "</span> x <!-- c -->"), fixtures.tagged("<p>a<br/>", "</p>"), fixtures.tagged("<p><ruby>漢<rt>", "</rt></ruby></p><script>s()</script>")]
    return html.extract_blocks(fixtures.line_pages(spark, sf_dir, forms), ["doc_id"], style=html.Style(break_text="|")).drop("images")


@query(rf"""WITH {_OWN_LINES} SELECT doc_id, string_agg(CASE i % 3 WHEN 0 THEN line WHEN 1 THEN '##### ' || line ELSE 'a' || chr(10) || line END, chr(10) || chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id""")
def x5_line_stories(spark, sf_dir):
    """The documents' lines as a story's paragraphs and headings."""
    return html.story_text(fixtures.line_pages(spark, sf_dir, [fixtures.tagged("<p> ", " </p>"), fixtures.tagged("<div><h3>", "</h3></div>"), fixtures.tagged("<p>a<br>", "</p>")]), ["doc_id"])


# ---- text functions and files


@query(r"""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS line, doc_id AS d FROM documents)
SELECT doc_id, d || 'ab！ ' || regexp_replace(regexp_replace(replace(replace(line, '!', '！'), '.', '．'), '\s+', ' ', 'g'), '[（(]([0-9．.]+)[）)]', '\1', 'g') AS norm, CASE WHEN d % 2 = 0 THEN 'がぱ' ELSE 'か' END AS marks,
CASE WHEN d % 4 = 0 THEN '<p style="opacity: 0.4; font-size: 1em; top: 0px; ">あ' || d || '</p>' WHEN d % 4 = 2 THEN 'x' || d ELSE 'x' || d END AS faded,
CASE WHEN d % 3 = 0 THEN 'Amazon https://b.amazon.example/' || d WHEN d % 3 = 1 THEN 'Yahoo https://x.valuecommerce.example/' || d ELSE '' END AS link, CAST(CASE WHEN d % 3 = 0 THEN 2 WHEN d % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_shops FROM t""")
def f_titles_and_links(spark, sf_dir):
    """F2, F3, F5, F10's fading and F11 on the documents' first lines and ids, with wide letters, marks, kana and shops put in."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id").cast("string")
    norm = T.norm_title(F.concat(F.lit("（"), d, F.lit("）ＡＢ!　"), F.get(F.split("text", "\n"), 0)))
    marks = T.compose_marks(F.when(F.col("doc_id") % 2 == 0, F.lit("か゛は゜")).otherwise(F.lit("か")))
    faded = T.fade(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("あ"), d)).otherwise(F.concat(F.lit("x"), d)), True)
    shop = lambda name: F.concat(F.lit(f"https://{name}.example/"), d)
    hrefs = F.when(F.col("doc_id") % 3 == 0, F.array(shop("a.amazon"), shop("y.yodobashi"), shop("none"), shop("b.amazon"))).when(F.col("doc_id") % 3 == 1, F.array(shop("x.valuecommerce"))).otherwise(F.array(shop("none")))
    made = docs.select("doc_id", norm.alias("norm"), marks.alias("marks"), faded.alias("faded"), T.brand_links(hrefs).alias("links"))
    best = T.preferred_link(F.col("links"))
    return made.select("doc_id", "norm", "marks", "faded", F.when(best.isNull(), F.lit("")).otherwise(F.concat_ws(" ", best["brand"], best["url"])).alias("link"), F.size("links").alias("n_shops"))


@query(r"""WITH t AS (SELECT conv_id, list_filter(string_split(string_agg(regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY turn), chr(10)), lambda x: trim(x) <> '') AS own FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS book, unnest(range(0, len(own))) AS pos, trim(unnest(own)) AS line FROM t""")
def s2_files_round_trip(spark, sf_dir):
    """A text file for each conversation, read again as lines."""
    turns = table(spark, sf_dir, "conversations")
    texts = chapters.assemble(turns, ["conv_id"], ["turn"], F.regexp_replace("text", r"\s+", " "), "\n")
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    lines.write_documents(texts.select(F.col("conv_id").cast("string").alias("book"), "text"), path, kind="text")
    back = lines.read_text_lines(spark, path)
    return back.select(F.regexp_extract("doc", "book=([^/]+)/", 1).alias("book"), "pos", F.col("pure").alias("line"))


# ---- pixels and logs


@query("""WITH p AS (SELECT vec_id AS image, i, CAST(floor(abs(v) * 2000) AS INTEGER) % 256 AS r, CAST(floor(abs(v) * 700) AS INTEGER) % 256 AS g, 245 AS b FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings))
SELECT image, count(*) AS n, avg(CASE WHEN r > 240 AND g > 240 AND b > 240 THEN 1.0 ELSE 0.0 END) AS white, avg(CASE WHEN r > 240 AND g > 240 AND b > 240 THEN 1.0 ELSE 0.0 END) > 0.8 AS placeholder,
round(avg(CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE)), 2) AS color, count(*) FILTER (WHERE i % 2 = 1 AND b = 245 AND r > 0 AND r < 200) = 4 AS new FROM p GROUP BY image""")
def a5_pixel_stats(spark, sf_dir):
    """A5: each vector as an image of two rows of pixels, their colours made of its values."""
    v = F.posexplode("embedding").alias("i", "v")
    pixels_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), v)
    colour = lambda k: (F.floor(F.abs(F.col("v")) * k).cast("int") % 256)
    pixels_ = pixels_.select("image", "i", colour(2000).alias("r"), colour(700).alias("g"), F.lit(245).alias("b"))
    stats = pixels.pixel_stats(pixels_)
    line = pixels_.select("image", (F.col("i") % 2).alias("y"), F.when((F.col("r") > 0) & (F.col("r") < 200), 7).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return stats.join(pixels.chapter_line(line, 1, (7, 0, 0), 4), "image")


_LOGS = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, epoch_ms(ts) AS ms, event_type, event_id FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e),
k AS (SELECT user_id, ms, event_type, ord, n FROM n WHERE user_id % 3 > 0 OR ord = 0), l AS (SELECT user_id, count(*) AS n_logs, max_by(ms, ord) AS last_ms FROM k GROUP BY user_id),
b AS (SELECT c_custkey AS user_id, bool_and(o_orderstatus <> 'P') AS searched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""


@query(f"""WITH {_LOGS}, a AS (SELECT l.user_id, CAST(n_logs AS INTEGER) AS ord, CASE WHEN n_logs = 1 THEN 'post-first' WHEN coalesce(searched, true) AND 1706313600000 - last_ms > 43200000 THEN 'post-append' END AS action, CAST(0 AS BIGINT) AS increment FROM l LEFT JOIN b USING (user_id))
SELECT * FROM a WHERE action IS NOT NULL""")
def a8_next_log(spark, sf_dir):
    """Each user's events are a log, of every third user the first one alone, and the orders of the customer of that number the books; a forced search on the 27th of January adds a row after one log, or where all were searched and the last log is 12 hours old."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).filter("user_id % 3 > 0 OR ord = 0")
    logs = events.select("user_id", "ord", F.col("event_type").alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("increment"))
    books = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("page"))
    return catalog.next_log(logs, books, 1706313600000, True, ("user_id",)).select("user_id", "ord", "action", "increment")


# ---- layout


@query(r"""WITH t AS (SELECT conv_id AS doc, turn AS page, role = 'user' AS new, role = 'user' AND turn % 4 < 2 AS titled, turn % 4 = 0 AS first_, string_split(CASE WHEN role = 'user' AND turn % 4 = 0 THEN '第一章 ' WHEN role = 'user' AND turn % 4 = 1 THEN '第' || (turn + 1) || '话 ' ELSE '' END || text, '. ') AS own FROM conversations),
l AS (SELECT doc, page, new, titled, first_, unnest(own) AS line, unnest(range(0, len(own))) AS pos FROM t),
m AS (SELECT *, pos = 0 AND new AS head, pos = 0 AND titled AS chapter, pos = 0 AND new AND ((titled AND first_) OR page = 0) AS volume FROM l),
s AS (SELECT *, last_value(CASE WHEN head THEN NOT chapter END IGNORE NULLS) OVER o AS skipping, sum(CAST(volume AS INTEGER)) OVER o AS vol FROM m WINDOW o AS (PARTITION BY doc ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, vol ORDER BY page, pos) = 1 AS lead_ FROM s WHERE NOT coalesce(skipping, false) AND vol > 0),
g AS (SELECT doc, CAST(vol AS INTEGER) AS volume, string_agg(CASE WHEN chapter AND NOT lead_ THEN repeat(chr(10), 4) WHEN NOT head AND pos % 3 = 2 THEN repeat(chr(10), 2) ELSE '' END || CASE WHEN chapter THEN '### ' || regexp_replace(line, '^(第一章|第[0-9]+话)', '\1　') ELSE line END, '' ORDER BY page, pos) AS body FROM k GROUP BY doc, vol)
SELECT doc, volume, '## 第' || CASE WHEN volume <= 10 THEN ['一','二','三','四','五','六','七','八','九','十'][volume] WHEN volume < 20 THEN '十' || ['一','二','三','四','五','六','七','八','九'][volume - 10] END || '卷' || chr(10) || chr(10) || body || chr(10) AS text FROM g""")
def w6_volumes(spark, sf_dir):
    """Turns as recognised pages; users' turns are new, and those that open with a chapter title begin chapters and volumes."""
    turns = table(spark, sf_dir, "conversations")
    user, turn = F.col("role") == "user", F.col("turn")
    title = F.when(user & (turn % 4 == 0), F.lit("第一章 ")).when(user & (turn % 4 == 1), F.concat(F.lit("第"), (turn + 1).cast("string"), F.lit("话 "))).otherwise(F.lit(""))
    line = lambda x, i: F.struct(x.alias("words"), F.when(i % 3 == 2, 200).otherwise(10).alias("left"))
    return layout.merge_ocr(turns.select(F.col("conv_id").alias("doc"), turn.alias("page"), user.alias("new"), F.transform(F.split(F.concat(title, "text"), r"\. ", -1), line).alias("lines")))


_CHARS = "c AS (SELECT page_id AS page, unnest(range(0, length(url))) AS seq, unnest(string_split(url, '')) AS ch FROM pages)"


@query(f"WITH {_CHARS} SELECT 'urls' AS doc, page, seq, ch AS text FROM c WHERE ch <> '.'")
def a4_larger_chars(spark, sf_dir):
    return layout.drop_small_chars(fixtures.chars(spark, sf_dir)).select("doc", "page", F.col("seq").cast("long").alias("seq"), "text")


@query(f"""WITH {_CHARS}, e AS (SELECT page, (min(seq % 12) + max(seq % 12)) * 9.0 / 2 AS centre FROM c GROUP BY page),
l AS (SELECT page, seq // 12 AS n, string_agg(ch, '' ORDER BY seq) AS line, min(seq % 12) * 9.0 AS x FROM c WHERE ch <> '.' GROUP BY page, seq // 12)
SELECT 'urls' AS doc, page, CAST(row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS INTEGER) AS pos, line FROM l JOIN e USING (page) WHERE NOT (abs(x - centre) < 20 AND length(line) <= 3)""")
def w7_url_lines(spark, sf_dir):
    """The URLs' characters back in lines."""
    return layout.cluster_lines(fixtures.chars(spark, sf_dir))


# ---- alignment in rounds


@query(rf"""{_SEGMENTS}, c AS (SELECT doc, pos, line, sum(length(line)) OVER (PARTITION BY doc ORDER BY pos) AS cum FROM l),
h AS (SELECT doc, min(pos) AS a, max(pos) AS b, 0 AS round FROM g GROUP BY doc, seg
UNION ALL SELECT h.doc, CASE k WHEN 0 THEN a ELSE a + (b - a + 1) // 2 END, CASE k WHEN 0 THEN a + (b - a + 1) // 2 - 1 ELSE b END, round + 1
FROM h JOIN c s ON s.doc = h.doc AND s.pos = h.a JOIN c e ON e.doc = h.doc AND e.pos = h.b, (SELECT unnest([0, 1]) AS k) WHERE b - a >= 2 AND e.cum - s.cum + length(s.line) > 128),
f AS (SELECT h.*, b - a < 2 AS fit FROM h JOIN c s ON s.doc = h.doc AND s.pos = h.a JOIN c e ON e.doc = h.doc AND e.pos = h.b WHERE b - a < 2 OR e.cum - s.cum + length(s.line) <= 128)
SELECT c.doc, c.pos, c.line, CASE WHEN fit OR length(c.line) % 3 > 0 THEN '>' || c.line ELSE '[N/A]' END AS answer, CAST(CASE WHEN fit THEN round ELSE -1 END AS INTEGER) AS round FROM c JOIN f ON f.doc = c.doc AND c.pos BETWEEN f.a AND f.b""")
def w13_rounds(spark, sf_dir):
    """The documents' segments; an answer has the right number of lines for two lines or less, and lines by themselves sometimes get none."""
    own = segments.segments_of(table(spark, sf_dir, "documents"), lines.own_lines(F.col("text")), "doc_id")

    def answer(left: DataFrame, number: int) -> DataFrame:
        said = F.transform("lines", lambda x: F.concat(F.lit(">"), x))
        said = F.when(F.size("lines") > 2, F.slice(said, 1, F.size("lines") - 1)).otherwise(said)
        return left.withColumn("tries", F.array(F.lit(None).cast("string"), F.array_join(said, "\n")))

    def answer_lines(rows: DataFrame) -> DataFrame:
        late = F.struct(F.concat(F.lit(">"), "line").alias("text"), F.lit("late").alias("err"))
        return rows.withColumn("tries", F.array(late, F.struct(F.when(F.length("line") % 3 > 0, F.concat(F.lit(">"), "line")).otherwise(F.lit("")).alias("text"), F.lit(None).cast("string").alias("err"))))

    return segments.align_rounds(own, answer, answer_lines)


# ---- matching


_SHORT = "FROM u, (SELECT unnest(range(1, 40)) AS i)"
_SIMILAR = rf"""u AS (SELECT a, b, CASE WHEN s THEN a ELSE b END AS x, CASE WHEN s THEN b ELSE a END AS y FROM (SELECT a, b, unnest(CASE WHEN length(a) = length(b) THEN [true, false] ELSE [length(a) < length(b)] END) AS s FROM ab)),
w AS (SELECT a, b, x, substr(y, CAST(i AS INTEGER), length(x)) AS y {_SHORT} WHERE i <= length(y) - length(x) + 1
UNION SELECT a, b, x, substr(y, 1, CAST(i AS INTEGER)) {_SHORT} WHERE i < length(x) UNION SELECT a, b, x, right(y, CAST(i AS INTEGER)) {_SHORT} WHERE i < length(x)
UNION SELECT a, b, a, b FROM ab UNION SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ') FROM ab),
xy AS (SELECT DISTINCT x, y FROM w),
lcs AS (SELECT x, y, length(x) - bit_count(list_reduce(list_prepend((CAST(1 AS BIGINT) << length(x)) - 1, list_transform(string_split(y, ''), lambda c: CAST(coalesce(list_sum(list_transform(range(length(x)), lambda i: CASE WHEN substr(x, CAST(i + 1 AS INTEGER), 1) = c THEN CAST(1 AS BIGINT) << CAST(i AS BIGINT) ELSE 0 END)), 0) AS BIGINT))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS BIGINT) << length(x)) - 1))) AS n FROM xy),
sim AS (SELECT a, b, max(2.0 * n / (length(w.x) + length(w.y))) AS conf FROM w JOIN lcs ON lcs.x = w.x AND lcs.y = w.y GROUP BY a, b)"""
_PAIRS = "p AS (SELECT a.p_partkey AS book_id, b.p_partkey AS id, lower(a.p_name) AS a, lower(b.p_name) AS b, a.p_size % 2 = 1 AS open_ FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand WHERE b.p_size <= 25), ab AS (SELECT DISTINCT a, b FROM p)"
_BEST = "m AS (SELECT book_id, max_by(id, (conf, -id)) AS subject, max(conf) AS conf FROM p JOIN sim USING (a, b) WHERE conf >= 0.9 GROUP BY book_id)"


@query(f"WITH {_PAIRS}, {_SIMILAR} SELECT book_id, id, CAST(conf AS DOUBLE) AS conf FROM p JOIN sim USING (a, b)")
def j4_similarity(spark, sf_dir):
    """Parts as books and as subjects, on the same day if type and brand agree."""
    return match.scored_candidates(*_titles(spark, sf_dir)).select("book_id", "id", "conf")


@query(f"WITH {_PAIRS}, {_SIMILAR}, {_BEST} SELECT p_partkey AS book_id, p_name AS title, p_type || '/' || p_brand AS date, subject, CAST(conf AS DOUBLE) AS conf FROM part LEFT JOIN m ON book_id = p_partkey")
def j5_best_match(spark, sf_dir):
    return match.best_match(*_titles(spark, sf_dir))


@query(f"WITH {_PAIRS}, {_SIMILAR}, {_BEST} SELECT p_partkey AS book_id, p_name AS title, p_type || '/' || p_brand AS date, CASE WHEN p_size % 2 = 0 THEN '' ELSE coalesce('s/' || subject, '') END AS page FROM part LEFT JOIN m ON book_id = p_partkey")
def t3_incremental_links(spark, sf_dir):
    """Parts that were never searched get a page; those of even size were, and found nothing."""
    books, subjects = _titles(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.when(F.col("p_size") % 2 == 0, "").alias("page"))
    return match.incremental_links(books.join(part, "book_id"), subjects, base="s/")


_GRAMS = "list_distinct(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substr({0}, CAST(i AS INTEGER), 2)) END)"


@query(rf"""WITH i AS (SELECT n_nationkey AS item_id, n_name AS title, lower(replace(n_name, '.', '．')) AS a FROM nation), s AS (SELECT p_partkey AS id, p_name AS name, lower(replace(p_name, '.', '．')) AS b, p_size > 25 AS is_series FROM part),
ig AS (SELECT item_id, unnest({_GRAMS.format('a')}) AS g FROM i), sg AS (SELECT id, unnest({_GRAMS.format('b')}) AS g FROM s),
t AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, id) AS place FROM ig JOIN sg USING (g) GROUP BY item_id, id),
p AS (SELECT item_id, id, a, b, name, is_series FROM t JOIN i USING (item_id) JOIN s USING (id) WHERE place <= 15), ab AS (SELECT DISTINCT a, b FROM p), {_SIMILAR}
SELECT item_id, title AS item, is_series, id, name, CAST(conf AS DOUBLE) AS conf, row_number() OVER (PARTITION BY item_id, is_series ORDER BY conf DESC, id) AS place FROM p JOIN sim USING (a, b) JOIN i USING (item_id) WHERE conf >= 0.3""")
def j6_shortlist(spark, sf_dir):
    """For each nation's name the most similar of the fifteen parts that share most bigrams with it; large parts are series."""
    _, subjects = _titles(spark, sf_dir)
    items = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("title"))
    found = match.shortlist(items, subjects, 0.3)
    rows = [found.select("item_id", F.col("title").alias("item"), F.lit(own == "series").alias("is_series"), F.posexplode(own).alias("place", "m")) for own in ("single", "series")]
    return rows[0].unionByName(rows[1]).select("item_id", "item", "is_series", F.col("m.link").cast("long").alias("id"), F.col("m.title").alias("name"), F.col("m.conf").alias("conf"), (F.col("place") + 1).alias("place"))
