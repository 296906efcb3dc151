import html
import re

import pytest

import __spark_entry__ as entry
from bookflow.plans.queries import QUERIES, SQL
from tests.oracle import connect, spark_rows, sql_rows

SMALL = "/root/testdata/sf0.001"
CHECKED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(CHECKED)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, CHECKED)) == sql_rows(con, SQL[name])


def test_without_sql(spark):
    """Queries that SQL cannot express are held against the parser's own words, and against each other."""
    assert sorted(QUERIES.keys() - SQL.keys()) == ["r4_chapter_html", "w6_merge_ocr", "w7_cluster_lines", "x3_blocks", "x5_story_text", "x_chapter_documents"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    words = lambda s: re.sub(r"\s+", "", html.unescape(re.sub(r"<[^>]*>|#", "", s)))
    whole = {k: words(re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->|^.*<body[^>]*>", "", r.html)) for k, r in pages.items()}
    found = {}
    for r in QUERIES["x3_blocks"](spark, SMALL).orderBy("page_id", "pos").collect():
        found[r.page_id] = found.get(r.page_id, "") + r.line
    assert {k: words(html.escape(t, quote=False) if "<" not in t else t) for k, t in found.items()} == {k: v.replace("#", "") for k, v in whole.items()}
    story = QUERIES["x5_story_text"](spark, SMALL).collect()
    assert {r.page_id for r in story} == pages.keys() and all(words(r.text) for r in story)
    chapters = QUERIES["x_chapter_documents"](spark, SMALL).collect()
    assert sum(len(words(r.text.split("\n\n", 1)[1])) for r in chapters) == sum(len(words(t)) for t in found.values())
    named = QUERIES["r4_chapter_html"](spark, SMALL).collect()
    hosts = {r.book for r in named}
    own = [t for k, t in found.items() if re.match("[a-z]+://([^/?#]*)", pages[k].url)[1] in hosts]
    assert hosts and sum(len(words(t)) for t in own) <= sum(len(words(r.html)) for r in named)
    ocr = QUERIES["w6_merge_ocr"](spark, SMALL).collect()
    assert ocr and all(r.text.startswith("## 第") and r.text.endswith("\n") for r in ocr)
    lines = QUERIES["w7_cluster_lines"](spark, SMALL).collect()
    assert {r.page for r in lines} == pages.keys() and all(r.line in pages[r.page].url.replace(".", "") for r in lines)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys() >= QUERIES.keys()
