"""What the registered queries read where no table of the driver holds it: pages, archives and characters made of the tables' rows.

Each fixture is a Spark job over its whole table, so that a query's work grows with it. None of this is an operator.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions import text as T


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(s: Column) -> Column:
    """Text as it stands in a page."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def joined(rows: DataFrame, key: str, order: str, item: Column, before: str = "", after: str = "") -> DataFrame:
    """(key, html): the items of each key in order, as one page."""
    parts = F.array_sort(F.collect_list(F.struct(order, item.alias("item"))))
    return rows.groupBy(key).agg(F.concat(F.lit(before), F.array_join(parts["item"], ""), F.lit(after)).alias("html"))


#: Pages in an archive: larger hosts make several.
PAGES = 20
_KIND = "application/xhtml+xml"
_CONTAINER = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    """One archive of a book's pages: spine from the last page to the first, contents with every third page."""
    pdf = pdf.sort_values("n")
    names = [f"t/{n}.xhtml" for n in pdf["n"]]
    items = "".join(f'<item id="p{i}" href="{h}" media-type="{_KIND}"/>' for i, h in enumerate(names)) + f'<item id="nav" href="nav/nav.xhtml" media-type="{_KIND}" properties="nav"/>'
    spine = "".join(f'<itemref idref="p{i}"/>' for i in reversed(range(len(names)))) + '<itemref idref="nav"/><itemref idref="unknown"/>'
    links = "".join(f'<a href="../{h}#top">x</a>' for h in names[::3])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", _CONTAINER)
        z.writestr("OEBPS/content.opf", f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>")
        z.writestr("OEBPS/nav/nav.xhtml", f'<html><body><nav epub:type="toc">{links}</nav></body></html>')
        for h, page in zip(names, pdf["html"], strict=True):
            z.writestr(f"OEBPS/{h}", page)
    return pd.DataFrame({"path": [f"/lib/{pdf['book'].iloc[0]}.epub"], "content": [out.getvalue()]})


def line_pages(spark, sf_dir, forms: list[Column]) -> DataFrame:
    """documents as pages: the i-th line that is not blank stands in the (i mod n)-th of `forms`, made of the columns i and e, the escaped line."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    own = F.filter(F.transform(F.split("text", "\n", -1), T.strip), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(own).alias("i", "line")).withColumn("e", escaped(F.col("line")))
    item = forms[-1]
    for k, form in enumerate(forms[:-1]):
        item = F.when(F.col("i") % len(forms) == k, form).otherwise(item)
    return joined(rows, "doc_id", "i", item, "<html><head><title>t</title></head><body>", "</body></html>")


def tagged(before: str, after: str) -> Column:
    return F.concat(F.lit(before), "e", F.lit(after))


def chars(spark, sf_dir) -> DataFrame:
    """The characters of the pages' URLs, set out in lines of twelve that drift down; full stops are small."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("url", "")).alias("seq", "text")).filter("text <> ''")
    line = F.floor(F.col("seq") / 12)
    return pages.select(F.lit("urls").alias("doc"), F.col("page_id").alias("page"), "seq", "text", F.when(F.col("text") == ".", 4.0).otherwise(10.0).alias("size"), (F.col("seq") % 12 * 9.0).alias("x0"), (700.0 - line * 14 - F.col("seq") % 12 * 0.1).alias("y1"))
