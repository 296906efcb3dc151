"""Archives, reading order, chapters and images."""

import zipfile

import pytest
from pyspark.sql import functions as F

from bookflow.functions.text import folder
from bookflow.operators import chapters, html, pixels
from bookflow.sources import archives

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def package(items, spine):
    manifest = "".join(f'<item id="{i}" href="{h}" media-type="{t}"' + (f' properties="{p}"' if p else "") + "/>" for i, h, t, p in items)
    refs = "" if spine is None else "<spine>" + "".join(f'<itemref idref="{s}"/>' for s in spine) + "</spine>"
    return f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{manifest}</manifest>{refs}</package>'


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    page = lambda body: f"<html><body>{body}</body></html>"
    kind = "application/xhtml+xml"

    def book(name, items, spine, files, at=""):
        (root / at).mkdir(exist_ok=True)
        with zipfile.ZipFile(root / at / f"{name}.epub", "w") as z:
            z.writestr("META-INF/container.xml", CONTAINER)
            z.writestr("OEBPS/content.opf", package(items, spine))
            for f, text in files.items():
                z.writestr(f"OEBPS/{f}", text)

    pages = {f"t/{i}.xhtml": page(f"<p>page {i}</p><p><img src='../i/{i}.png'/></p>") for i in range(4)}
    items = [(f"p{i}", f"t/{i}.xhtml", kind, None) for i in range(4)] + [("c", "i/0.png", "image/png", None)]
    nav = ("n", "nav.xhtml", kind, "nav")
    book("nav", [*items, nav], ["p1", "p0", "n", "zz", "p2", "p3"], {**pages, "i/0.png": "png", "nav.xhtml": page('<nav epub:type="toc"><a href="t/0.xhtml#x">0</a><a href="t/2.xhtml">2</a><a href="t/none.xhtml">?</a></nav>')}, "sub")
    linked = {**pages, "t/0.xhtml": page('<p><a href="1.xhtml">1</a><a href="3.xhtml#a">3</a></p>')}
    book("toc", items, ["p0", "p1", "p2", "p3"], linked)
    book("broken", items, ["p0", "p1", "p2", "p3"], {**pages, "t/0.xhtml": page('<p><a href="1.xhtml">1</a><a href="gone.xhtml">x</a></p>')})
    book("nospine", items, None, pages)
    book("space ", items, None, pages)
    (root / "bad.epub").write_bytes(b"no archive")
    return archives.read_archives(spark, str(root)).cache()


def test_archives(books):
    assert {(r.book, bool(r.error)) for r in books.select("book", "error").distinct().collect()} == {("nav", False), ("toc", False), ("broken", False), ("nospine", False), ("space ", True), ("bad", True)}
    row = books.filter("book = 'nav' AND path = 'OEBPS/i/0.png'").first()
    assert row.infix == "sub" and row.size == 3 and row.content is None


@pytest.fixture(scope="module")
def read(books):
    manifest, spine = archives.package_tables(books)
    pages = chapters.reading_order(manifest, spine)
    own = pages.join(archives.member_texts(books), ["book", "path"]).cache()
    nav = archives.member_texts(books).join(manifest.filter("properties = 'nav'").select("book", "path"), ["book", "path"])
    navs = html.nav_links(nav, ["book", "path"]).select("book", folder(F.col("path")).alias("base"), "href")
    return manifest, own, html.extract_links(own, ["book", "page"]).cache(), navs.cache()


def test_order(read):
    _, pages, _, _ = read
    got = {}
    for r in pages.orderBy("book", "page").collect():
        got.setdefault(r.book, []).append(r.path[-7:])
    assert got["nav"] == ["1.xhtml", "0.xhtml", "2.xhtml", "3.xhtml"] and got["nospine"] == [f"{i}.xhtml" for i in range(4)]


def starts(df):
    out = {}
    for r in df.orderBy("book", "start").collect():
        out.setdefault((r.book, r.method), []).append(r.start)
    return out


def test_starts_and_spans(spark, read):
    _, pages, links, navs = read
    found = chapters.toc_starts(pages, links, navs).cache()
    assert starts(found) == {("nav", "NAV"): [1, 2], ("toc", "TOC"): [1, 3], ("broken", "TRIVIAL"): [0, 1, 2, 3], ("nospine", "TRIVIAL"): [0, 1, 2, 3]}
    splits = spark.createDataFrame([("toc", 0, "A", 2, 4), ("toc", 1, None, 0, 3)], "book string, ord int, title string, left int, right int")
    assert starts(chapters.toc_starts(pages, links, navs, splits))["toc", "MANUAL"] == [0, 2]
    last = pages.groupBy("book").agg(F.count("*").alias("last"))
    spans = [tuple(r) for r in chapters.chapter_spans(found, last).filter("book = 'toc'").orderBy("left").collect()]
    assert spans == [("toc", 0, 0, 0, 1, "TOC"), ("toc", 1, 1, 1, 3, "TOC"), ("toc", 2, 2, 3, 4, "TOC")]
    spans = [tuple(r) for r in chapters.chapter_spans(found, last, front=False).filter("book = 'toc'").orderBy("left").collect()]
    assert spans == [("toc", 0, 1, 1, 3, "TOC"), ("toc", 1, 2, 3, 4, "TOC")]
    # spans tile the pages
    every = chapters.chapter_spans(found, last)
    assert every.groupBy("book").agg(F.sum(F.col("right") - F.col("left")).alias("n")).join(last, "book").filter("n <> last").count() == 0
    named = [(r.name, r.prev, r.next) for r in chapters.nav_titles(every.filter("book = 'toc'"), least=2).orderBy("name").collect()]
    assert named == [("00", None, "01"), ("01", "00", "02"), ("02", "01", None)]
    ranges = {(r.page, r.title) for r in chapters.assign_ranges(pages.select("book", "page"), splits).collect()}
    assert ranges == {(2, "A"), (3, "A"), (0, None), (1, None), (2, None)}


def test_documents_and_assets(books, read):
    _, pages, links, navs = read
    found = chapters.toc_starts(pages, links, navs)
    blocks = html.extract_blocks(pages, ["book", "page"]).cache()
    docs = {(r.book, r.chapter): r.text for r in chapters.chapter_documents(blocks, pages, found).collect()}
    assert docs["toc", 1] == 'page 1\n\n<img src="assets/1.png"/>\n\npage 2\n\n<img src="assets/2.png"/>\n'
    assert len([k for k in docs if k[0] == "toc"]) == 3
    missing, there = chapters.missing_assets(chapters.used_images(blocks, pages), books)
    assert {(r.book, r.path) for r in there.collect()} == {("nav", "OEBPS/i/0.png")}
    assert ("toc", "OEBPS/i/1.png") in {(r.book, r.path) for r in missing.collect()}
    page = chapters.html_documents(found.sparkSession.createDataFrame([("01", None, "02", "body")], "name string, prev string, next string, text string"), "<t>{TITLE}</t>", "</x>", "<a href='{PREV_LINK}'>{PREV_TEXT}</a><a href='{NEXT_LINK}'>{NEXT_TEXT}</a>", "back", "on").first().html
    assert page == "<t>01</t>body<a href=''></a><a href='02.html'>on</a></x>"


def test_config(spark):
    books = spark.createDataFrame([("a",), ("b",)], "book string")
    own = spark.createDataFrame([("a", 1, {"x": "late"}), ("a", 0, {"x": "first", "z": "9"})], "name string, ord int, config map<string,string>")
    got = {r.book: r.config for r in chapters.overlay_config(books, {"x": "0", "y": "1"}, own, {"y": "2"}).collect()}
    assert got == {"a": {"x": "first", "y": "2", "z": "9"}, "b": {"x": "0", "y": "2"}}


def test_images(spark):
    facts = [("none", 300, 300, 9000, 5.0), ("size", 300, 300, 10, 5.0), ("two", 300, 300, 10, 1.0), ("all", 10, 10, 10, 0.0), ("edge", 32768, 1, 8192, 4.0), ("null", None, 5, 10, None), ("nulls", None, None, 10, 1.0)]
    df = spark.createDataFrame(facts, "name string, width int, height int, size long, color double")
    assert {r.name for r in pixels.inline_images(df).filter("inline").collect()} == {"two", "all", "nulls"}
    points = [("w", x, 0, 255, 255, 255) for x in range(9)] + [("w", 9, 0, 10, 20, 40)] + [("e", x, 1, 255, 255, 241 if x < 8 else 240) for x in range(10)]
    df = spark.createDataFrame(points, "image string, x int, y int, r int, g int, b int")
    got = {r.image: (r.n, r.white, r.placeholder, r.color) for r in pixels.pixel_stats(df).collect()}
    assert got == {"w": (10, 0.9, True, 3.0), "e": (10, 0.8, False, round((14 * 8 + 15 * 2) / 10, 2))}
    assert {r.image: r.new for r in pixels.chapter_line(df, 0, (255, 255, 255), 9).collect()} == {"w": True, "e": False}
    assert pixels.array_stats(spark.createDataFrame([([1.0, 250.0, 241.0, 240.0],)], "values array<double>")).first().high_share == 0.5
    summary = chapters.book_summary(spark.createDataFrame([("b", 0), ("b", 1)], "book string, page int"), spark.createDataFrame([("b", True)], "book string, inline boolean"), spark.createDataFrame([("b", 0, "NAV")], "book string, index int, method string")).first()
    assert tuple(summary) == ("b", 2, 1, 1, 1, "NAV")


def test_chapter_html_of_all_hosts(spark, sf):
    """Every span becomes a document, of hosts with ten chapters and more too, in order and with its pages' texts."""
    from bookflow.plans.queries import QUERIES, web_pages

    pages = web_pages(spark, sf)
    lines = {}
    for r in chapters.page_texts(html.extract_blocks(pages, ["book", "page"])).collect():
        lines[r.book, r.page] = r.text
    books = {}
    for r in pages.select("book", "page", "path").collect():
        books.setdefault(r.book, {})[r.page] = r.path
    want = set()
    for book, paths in books.items():
        starts = sorted(p for p in paths if p > 0 and paths[p].startswith("en/"))
        if not starts:
            continue
        starts = [0, *starts]
        width = max(2, len(str(len(starts) - 1)))
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(paths)], strict=True)):
            body = "\n\n".join(lines.get((book, p), "") for p in range(a, b)) + "\n"
            on = f"<a href={str(i + 1).zfill(width)}.html>on</a>" if i + 1 < len(starts) else "<a href=></a>"
            want.add((book, str(i).zfill(width), f"<t>{str(i).zfill(width)}</t>{body}{on}</t>"))
    found = [tuple(r) for r in QUERIES["r4_chapter_html"](spark, sf).collect()]
    assert len(found) == len(want) and set(found) == want
    assert any(int(name) > 9 for _, name, _ in found)
