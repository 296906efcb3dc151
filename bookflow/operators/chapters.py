"""Reading order, chapter starts, spans and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import fade, folder, resolve_path
from bookflow.sources.shared import cut

PAGE_TYPES = ("application/xhtml+xml", "text/html")


def reading_order(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(book, page, path): a book's text files in the spine's order; without a spine in the manifest's.

    manifest: (book, ord, id, path, media_type, properties); spine: (book, ord, idref). The navigation page is
    no text file; unknown idrefs are dropped. A spine that names no text file leaves the book empty.
    """
    is_text = F.lit(False)
    for kind in PAGE_TYPES:
        is_text = is_text | F.startswith("media_type", F.lit(kind))
    texts = manifest.filter(is_text & (F.coalesce("properties", F.lit("")) != "nav")).select("book", "ord", "id", "path")
    named = spine.select("book", F.col("ord").alias("s_ord"), F.col("idref").alias("id")).join(texts.drop("ord"), ["book", "id"]).select("book", F.col("s_ord").alias("ord"), "path")
    plain = texts.join(spine.select("book").distinct(), "book", "left_anti").select("book", "ord", "path")
    pages = named.unionByName(plain)
    return pages.select("book", (F.row_number().over(W.partitionBy("book").orderBy("ord")) - 1).alias("page"), "path")


def overlay_config(books: DataFrame, defaults: dict[str, str], overrides: DataFrame | None = None, everywhere: dict[str, str] | None = None) -> DataFrame:
    """Books with `config`: the defaults, under the global overrides, under the book's first override of its name.

    books: (book, ...); overrides: (name, ord, config map).
    """
    plain = {**defaults, **(everywhere or {})}
    base = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv]) if plain else F.create_map().cast("map<string,string>")
    if overrides is None:
        return books.withColumn("config", base)
    first = overrides.groupBy(F.col("name").alias("book")).agg(F.min_by("config", "ord").alias("_own"))
    own = F.coalesce("_own", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    return books.join(first, "book", "left").withColumn("config", F.map_concat(kept, own)).drop("_own")


def toc_starts(pages: DataFrame, links: DataFrame, nav: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """(book, start, method): the pages at which chapters start, by the first way that gives any for the book.

    MANUAL: the book's `splits`; NAV: links of the navigation page (book, base, href) that lead to pages; TOC:
    the page with most links (the first of equals), if all its links lead to pages; TRIVIAL: every page.
    pages: (book, page, path); links: (book, page, pos, href). Links are counted before any is resolved, and
    only the chosen page's are. Starts stay rows: the best way of a book is a minimum, and no book's pages are gathered.
    """
    paths = pages.select("book", "path", F.col("page").alias("start"))
    counted = links.groupBy("book", "page").agg(F.count("*").alias("n"))
    best = counted.groupBy("book").agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("page"))
    chosen = links.join(best, ["book", "page"], "left_semi").join(pages.select("book", "page", folder(F.col("path")).alias("base")), ["book", "page"])
    toc = chosen.select("book", resolve_path(F.col("base"), F.col("href")).alias("path")).join(paths, ["book", "path"], "left")
    whole = toc.groupBy("book").agg(F.bool_and(F.col("start").isNotNull()).alias("whole")).filter("whole").select("book")
    way = lambda df, start, method, rank: df.select("book", F.col(start).alias("start"), F.lit(method).alias("method"), F.lit(rank).alias("rank"))
    every = way(toc.join(whole, "book", "left_semi"), "start", "TOC", 2).unionByName(way(pages, "page", "TRIVIAL", 3))
    if nav is not None:
        found = nav.select("book", resolve_path(F.col("base"), F.col("href")).alias("path")).join(paths, ["book", "path"])
        every = every.unionByName(way(found, "start", "NAV", 1))
    if splits is not None:
        every = every.unionByName(way(splits, "left", "MANUAL", 0))
    every = cut(every)  # narrow rows, read twice, of which some were parsed out of pages
    best = every.groupBy("book").agg(F.min("rank").alias("rank"))
    return every.join(best, ["book", "rank"]).select("book", "start", "method").distinct()


def chapter_spans(starts: DataFrame, last: DataFrame, front: bool = True) -> DataFrame:
    """(book, index, number, left, right, method): the pages [left, right) of each chapter, right being the next start or `last`.

    With `front`, pages before the first start are chapter number 0, else they are dropped and numbers begin at
    1. last: (book, last). Spans at or behind `last` are empty. MANUAL starts are no spans; see `assign_ranges`.
    """
    order = W.partitionBy("book").orderBy("left")
    own = starts.filter("method <> 'MANUAL'").select("book", F.col("start").alias("left"), "method")
    low = own.groupBy("book", "method").agg(F.min("left").alias("low")).filter("low > 0")
    if front:
        own = own.unionByName(low.select("book", F.lit(0).cast(dict(own.dtypes)["left"]).alias("left"), "method"))
    shifted = own.join(low.select("book", F.lit(True).alias("fronted")), "book", "left") if front else own.withColumn("fronted", F.lit(False))
    index = F.row_number().over(order) - 1
    spans = shifted.join(last, "book").select("book", index.alias("index"), (index + F.when(F.coalesce("fronted", F.lit(False)), 0).otherwise(1)).alias("number"), "left", F.coalesce(F.lead("left").over(order), "last").alias("right"), "method")
    return spans


def assign_ranges(pages: DataFrame, splits: DataFrame, width: int = 64) -> DataFrame:
    """The pages with every split (ord, title) of their book that holds them, left <= page < right.

    A split is dealt to the buckets of `width` pages that it touches, a page to its own, and they are joined by book
    and bucket, with the exact ends checked after: pairs made are bounded by the splits near a page and not by all of
    the book's. A split over more than 64 buckets goes by coarser ones, of 64 times the width, and so on; a page looks
    there too. Empty and null ranges hold no page.
    """
    ranges = splits.filter(F.col("left") < F.col("right")).select(F.col("book").alias("_book"), "ord", "title", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    bucket = lambda page, level: F.floor(page / (width * 64**level)).cast("long")
    top = 9  # 64 ** 10 pages are more than a long can count
    wide = [bucket(F.col("right") - 1, k) - bucket(F.col("left"), k) <= 64 for k in range(top + 1)]
    level = F.coalesce(*(F.when(ok, k) for k, ok in enumerate(wide)))
    reach = F.coalesce(*(F.when(level == k, F.sequence(bucket(F.col("left"), k), bucket(F.col("right") - 1, k))) for k in range(top + 1)))
    dealt = ranges.withColumn("_level", level).withColumn("_bucket", F.explode(reach))
    used = cut(dealt.select("_level").distinct())  # a row for each level that any split needs: ten at most
    looked = pages.crossJoin(F.broadcast(used)).withColumn("_at", F.coalesce(*(F.when(F.col("_level") == k, bucket(F.col("page"), k)) for k in range(top + 1))))
    joined = looked.join(dealt.withColumnRenamed("_level", "_own"), (F.col("book") == F.col("_book")) & (F.col("_level") == F.col("_own")) & (F.col("_at") == F.col("_bucket")))
    return joined.filter((F.col("page") >= F.col("left")) & (F.col("page") < F.col("right"))).select(*pages.columns, "ord", "title")


def chapter_of(pages: DataFrame, starts: DataFrame, front: bool = True) -> DataFrame:
    """W3 as it is used: pages with `chapter`, the latest start at or before them, by one window over the book and no range join."""
    both = pages.join(starts.select("book", F.col("start").alias("page"), F.lit(True).alias("_start")), ["book", "page"], "left")
    at = F.last(F.when(F.col("_start"), F.col("page")), ignorenulls=True).over(W.partitionBy("book").orderBy("page"))
    found = both.withColumn("chapter", F.coalesce(at, F.lit(0)) if front else at).drop("_start")
    return found if front else found.filter("chapter IS NOT NULL")


def nav_titles(spans: DataFrame, fill: int = -1, least: int = 1) -> DataFrame:
    """With name, prev and next: zero-padded numbers; as wide as the largest number of the book, if `fill` is negative."""
    book = W.partitionBy("book")
    width = F.lit(fill) if fill >= 0 else F.greatest(F.length(F.max("number").over(book).cast("string")), F.lit(least))
    digits = F.col("number").cast("string")
    named = spans.withColumn("_w", width)
    named = named.withColumn("name", F.concat(F.repeat(F.lit("0"), F.greatest(F.col("_w") - F.length(digits), F.lit(0))), digits)).drop("_w")
    order = book.orderBy("number")
    return named.withColumns({"prev": F.lag("name").over(order), "next": F.lead("name").over(order)})


def assemble(rows: DataFrame, keys: list[str], order: list[str], text: Column, sep: str = "\n\n", prefix: Column | None = None, suffix: str = "", out: str = "text") -> DataFrame:
    """A2: one document for each key: the texts in order, joined by `sep`; `prefix` (constant for a key) before, `suffix` after.

    The order is sorted inside the array, and never that of the shuffle; a key should be a chapter, not a book.
    """
    first = [] if prefix is None else [F.first(prefix, ignorenulls=True).alias("_prefix")]
    joined = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))).alias("_parts"), *first)
    body = F.array_join(F.transform("_parts", lambda s: s["_text"]), sep)
    whole = F.concat(*([F.coalesce("_prefix", F.lit(""))] if first else []), body, F.lit(suffix))
    return joined.select(*keys, whole.alias(out))


def page_texts(blocks: DataFrame, kana: bool | None = None) -> DataFrame:
    """(book, page, text): each page's block lines, faded by their having kana, joined by empty lines."""
    return assemble(blocks, ["book", "page"], ["pos"], fade(F.col("line"), kana))


def chapter_documents(blocks: DataFrame, pages: DataFrame, starts: DataFrame, kana: bool | None = None) -> DataFrame:
    """(book, chapter, text): the pages of each chapter joined by empty lines; pages without blocks add an empty text."""
    placed = chapter_of(pages, starts).select("book", "page", "chapter")
    lines = placed.join(page_texts(blocks, kana), ["book", "page"], "left")
    return assemble(lines, ["book", "chapter"], ["page"], F.coalesce("text", F.lit("")), suffix="\n")


def used_images(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, path): the images of blocks on the pages (book, page, path) that are given out."""
    found = blocks.join(pages.select("book", "page", "path"), ["book", "page"]).select("book", folder(F.col("path")).alias("base"), F.explode("images").alias("href"))
    return found.select("book", resolve_path(F.col("base"), F.col("href")).alias("path")).distinct()


def missing_assets(used: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The used assets that an archive lacks, and those to copy."""
    there = members.select("book", "path")
    return used.join(there, ["book", "path"], "left_anti"), used.join(there, ["book", "path"], "left_semi")


def book_summary(pages: DataFrame, images: DataFrame, spans: DataFrame) -> DataFrame:
    """For each book its text files, images, inline images, chapters and the way its chapters were found."""
    texts = pages.groupBy("book").agg(F.count("*").alias("n_texts"))
    art = images.groupBy("book").agg(F.count("*").alias("n_images"), F.count_if("inline").alias("n_inline"))
    cut = spans.groupBy("book").agg(F.count("*").alias("n_chapters"), F.min("method").alias("method"))
    joined = texts.join(art, "book", "left").join(cut, "book", "left")
    return joined.fillna(0, ["n_images", "n_inline", "n_chapters"])


def html_documents(named: DataFrame, prefix: str, suffix: str, nav: str = "", prev_text: str = "", next_text: str = "", text: str = "text") -> DataFrame:
    """With `html`: the text in the caller's template; {TITLE} in the prefix and {PREV_LINK}, {NEXT_LINK}, {PREV_TEXT}, {NEXT_TEXT} in `nav` are filled in."""

    def fill(template: str, values: dict[str, Column]) -> Column:
        out = F.lit(template)
        for key, value in values.items():
            out = F.replace(out, F.lit("{" + key + "}"), value)
        return out

    link = lambda c: F.coalesce(F.concat(F.col(c), F.lit(".html")), F.lit(""))
    word = lambda c, t: F.when(F.col(c).isNotNull(), F.lit(t)).otherwise(F.lit(""))
    around = fill(nav, {"PREV_LINK": link("prev"), "NEXT_LINK": link("next"), "PREV_TEXT": word("prev", prev_text), "NEXT_TEXT": word("next", next_text)})
    return named.withColumn("html", F.concat(fill(prefix, {"TITLE": F.col("name")}), F.col(text), around, F.lit(suffix)))
