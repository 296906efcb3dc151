"""From positioned characters and recognised lines to paragraphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import CHAPTER, VOLUME, compose_marks, corner_quotes, rstrip, strip
from bookflow.operators.scan import MOST, numbered, scan


def drop_small_chars(chars: DataFrame, share: float = 0.7) -> DataFrame:
    """A4: the characters of each page that have at least `share` of the page's median size, with that median.

    A median of a page is small to hold, and a page is never large; the work is by (doc, page).
    """
    pages = W.partitionBy("doc", "page")
    return chars.withColumn("median_size", F.median("size").over(pages)).filter(F.col("size") >= share * F.col("median_size"))


def cluster_lines(chars: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """The lines (doc, page, pos, line) of each page, from its larger characters.

    From the top down a character joins the first line whose running mean height is nearer than `tolerance`
    times the median size. Lines of at most three characters that begin within 20 of the page's centre are
    page numbers. A page is one group; documents of any length spread over tasks.
    """
    pages = W.partitionBy("doc", "page")
    ready = drop_small_chars(chars.withColumn("centre", (F.min("x0").over(pages) + F.max("x0").over(pages)) / 2))

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y1", "seq"], ascending=[False, True], kind="stable")
        near, centre = tolerance * pdf["median_size"].iloc[0], pdf["centre"].iloc[0]
        # the lines so far: sums of heights and numbers of characters, with room for all that may come
        heights, total, count = pdf["y1"].to_numpy(np.float64), np.zeros(len(pdf)), np.ones(len(pdf))
        own, n = np.empty(len(pdf), np.int64), 0
        for i, y in enumerate(heights):
            fits = np.flatnonzero(np.abs(total[:n] / count[:n] - y) < near)
            if len(fits):
                own[i] = fits[0]
                total[own[i]] += y
                count[own[i]] += 1
            else:
                own[i], total[n], n = n, y, n + 1
        set_out = pdf.assign(own=own).sort_values(["own", "x0"], kind="stable").groupby("own", sort=True)
        joined = set_out.agg(line=("text", "".join), chars=("text", "size"), x=("x0", "first"))
        kept = joined[~((joined["x"] - centre).abs().lt(20) & (joined["chars"] <= 3))]
        k = len(kept)
        return pd.DataFrame({"doc": pdf["doc"].iloc[[0] * k].reset_index(drop=True), "page": pdf["page"].iloc[[0] * k].reset_index(drop=True), "pos": np.arange(k, dtype=np.int32), "line": kept["line"].reset_index(drop=True).astype(object)})

    kinds = dict(chars.dtypes)
    found = ready.groupBy("doc", "page").applyInPandas(lines, f"doc {kinds['doc']}, page {kinds['page']}, pos int, line string")
    return found.withColumn("line", compose_marks("line"))


def page_counts(pages: DataFrame) -> DataFrame:
    """How many pages each document has, from rows of any kind with (doc, page)."""
    return pages.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n_pages"))


def repeated_lines(lines: DataFrame, ratio: float = 0.8, counts: DataFrame | None = None) -> DataFrame:
    """A3: (doc, line, n_found, n_pages): stripped lines on at least `ratio` of a document's pages, counted once a page.

    `counts` (doc, n_pages) gives the pages where some have no lines. Lines of white space do not count. A line
    is a key with its document, pre-aggregated before the shuffle, so a frequent line makes no large group.
    """
    counts = page_counts(lines) if counts is None else counts
    stripped = lines.select("doc", "page", strip(F.col("line")).alias("line")).filter("line <> ''")
    found = stripped.distinct().groupBy("doc", "line").agg(F.count("*").alias("n_found"))
    return found.join(counts, "doc").filter(F.col("n_found") >= ratio * F.col("n_pages")).select("doc", "line", "n_found", "n_pages")


def drop_repeated(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """A3: the lines that are not among the repeated ones of their document."""
    keys = repeated.select("doc", F.col("line").alias("_line"))
    return lines.withColumn("_line", strip(F.col("line"))).join(keys, ["doc", "_line"], "left_anti").select(lines.columns)


def rebuild_paragraphs(lines: DataFrame, closers: tuple[str, ...] = ("。", "」", "）")) -> DataFrame:
    """(doc, para, text): lines joined over lines and pages.

    A line of white space ends a paragraph and is one, empty. A line that ends in a space ends its paragraph; so
    does the last line of a page if the text so far ends in one of `closers`. The end of the document ends it.
    Lines are numbered within their page; over a document only one row of each page is put in order.
    """
    order = W.partitionBy("doc", "page").orderBy("pos")
    blank = strip(F.col("line")) == ""
    ends = F.regexp_like(F.col("line"), F.lit("[" + "".join("\\" + c for c in closers) + "]$"))
    text = F.when(F.col("blank"), F.lit("")).when(F.endswith("line", F.lit(" ")), rstrip(F.col("line"))).otherwise(F.col("line"))
    marked = lines.select("doc", "page", "pos", "line", blank.alias("blank"), (blank | F.endswith("line", F.lit(" "))).alias("closes"), ends.alias("ends"))
    # whether a line opens a paragraph: of a page's first line the page before it decides
    opens = F.when(F.col("blank"), True).otherwise(F.lag("closes").over(order))
    marked = marked.withColumn("opens", opens).withColumn("within", F.sum(F.coalesce("opens", F.lit(False)).cast("int")).over(order))
    pages = marked.groupBy("doc", "page").agg(F.max("within").alias("n"), F.max_by(F.col("closes") | F.col("ends"), "pos").alias("closed"), F.min_by(F.struct("opens"), "pos").alias("first"))
    along = W.partitionBy("doc").orderBy("page")
    joins = F.coalesce(F.col("first.opens"), F.coalesce(F.lag("closed").over(along), F.lit(True)))
    pages = pages.withColumn("head", (joins & F.col("first.opens").isNull()).cast("int"))
    pages = pages.select("doc", "page", "head", (F.sum(F.col("n") + F.col("head")).over(along) - F.col("n")).alias("before"))
    numbered = marked.join(pages, ["doc", "page"]).withColumn("para", F.col("before") + F.col("within") - 1)
    joined = numbered.groupBy("doc", "para").agg(F.array_sort(F.collect_list(F.struct("page", "pos", text.alias("line")))).alias("parts"))
    return joined.select("doc", F.col("para").cast("long").alias("para"), rstrip(F.array_join(F.col("parts.line"), "")).alias("text"))


def renumber(df: DataFrame, keys: list[str], order: list[str], start: int = 0, out: str = "number", most: int = MOST) -> DataFrame:
    """Numbers without gaps from `start`, in order, for each key; a key of over `most` rows is numbered in pieces."""
    return numbered(df, keys, order, out, start, most).withColumn(out, F.col(out).cast("int"))


def chinese_number(n: Column) -> Column:
    """0 to 9999 in Chinese numerals: a gap of zeros is one 〇, 10 to 19 begin with 十. Any other number stays in figures."""
    number, out = n.cast("long"), F.lit("")
    for place, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = F.floor(number / place) % 10
        name = F.element_at(F.array(*map(F.lit, "〇一二三四五六七八九")), (F.abs(d) + 1).cast("int"))
        out = F.concat(out, F.when(d > 0, F.concat(name, F.lit(unit))).when(number > place, F.lit("〇")).otherwise(F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, "〇+", "〇"), "〇$|^一(?=十)", "")
    return F.when(number == 0, F.lit("〇")).when(number.between(1, 9999), out).otherwise(number.cast("string"))


def ocr_lines(ocr: DataFrame, first_volume: int = 1, indent: int = 100, most: int = MOST) -> DataFrame:
    """W6, first part: every recognised line with what becomes of it.

    (doc, page, pos, text, volume, opens_volume, opens_chapter, opens_paragraph, skipped, title_skipped). The
    first line of a page marked `new` opens a chapter if it is a chapter title; else it is a skipped title, and
    all lines are left out until the next new page. Such a line opens a volume if it begins like a first
    chapter, or on page 0. Lines before any volume are skipped. Documents of any length spread over tasks.
    """
    lines = ocr.select("doc", "page", F.col("new"), F.posexplode("lines").alias("pos", "line")).select("doc", "page", "new", "pos", corner_quotes(F.col("line.words")).alias("text"), F.col("line.left").alias("left"))
    head = (F.col("pos") == 0) & F.col("new")
    volume = head & (F.regexp_like("text", F.lit(VOLUME)) | (F.col("page") == 0))
    chapter = head & F.regexp_like("text", F.lit(CHAPTER))
    marked = lines.withColumns({"head": head, "opens_volume": volume, "opens_chapter": chapter, "title_skipped": head & ~chapter})
    # the latest head decides whether a line is kept; lines before any head are kept, if a volume is open
    marked = scan(marked, ["doc"], ["page", "pos"], {"number": F.col("opens_volume").cast("int")}, {"state": F.when(F.col("head"), F.col("title_skipped"))}, most)
    marked = marked.withColumn("skipped", F.coalesce("state", F.lit(False)) | (F.col("number") == 0))
    return marked.select(
        "doc", "page", "pos", F.when(F.col("opens_chapter"), F.regexp_replace("text", CHAPTER, "### $1　")).otherwise(F.col("text")).alias("text"),
        (F.col("number") + (first_volume - 1)).cast("int").alias("volume"), "opens_volume", "opens_chapter",
        (~F.col("head") & (F.col("left") > indent)).alias("opens_paragraph"), "skipped", "title_skipped",
    )


def merge_ocr(ocr: DataFrame, first_volume: int = 1, indent: int = 100, most: int = MOST) -> DataFrame:
    """(doc, volume, text): the kept lines of each volume, four line ends between chapters, an empty line between paragraphs."""
    kept = ocr_lines(ocr, first_volume, indent, most).filter(~F.col("skipped"))
    own = F.array_sort(F.collect_list(F.struct("page", "pos", "text", "opens_chapter", "opens_paragraph")))
    joined = kept.groupBy("doc", "volume").agg(own.alias("own"))

    def piece(s: Column, i: Column) -> Column:
        """A line and what stands before it; a volume's first chapter has nothing before it."""
        before = F.when(s["opens_chapter"] & (i > 0), F.lit("\n\n\n\n")).when(s["opens_paragraph"], F.lit("\n\n")).otherwise(F.lit(""))
        return F.concat(before, s["text"])

    heading = F.concat(F.lit("## 第"), chinese_number(F.col("volume")), F.lit("卷\n\n"))
    return joined.select("doc", "volume", F.concat(heading, F.array_join(F.transform("own", piece), ""), F.lit("\n")).alias("text"))
