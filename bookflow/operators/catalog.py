"""The monthly catalogue: nesting, logs, worklists, back-fill, series and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import BRANDS, in_order, preferred_link
from bookflow.operators.scan import MOST, numbered, same, scan

# The label whose line an infobox leaves out.
UNLABELLED = "KADOKAWA 単行本"
#: Milliseconds after which a catalogue may be searched anew.
FAR_MS = 12 * 3600 * 1000


def with_labels(books: DataFrame, labels: DataFrame) -> DataFrame:
    """The books of known labels, with what is known on them. Labels that Spark knows to be few are broadcast."""
    return books.join(labels, "label")


def nest_catalog(books: DataFrame, keys: tuple[str, str] = ("day", "label"), order: tuple[str, ...] = ("ord",), fields: tuple[str, ...] = ("title", "page", "link", "new")) -> DataFrame:
    """A1: (day, label, n, books): each day's and label's books in order of arrival."""
    one = F.struct(*order, F.struct(*fields).alias("_book"))
    found = books.groupBy(*keys).agg(F.count("*").alias("n"), in_order(F.collect_list(one), *order).alias("_books"))
    return found.select(*keys, "n", F.transform("_books", lambda s: s["_book"]).alias("books"))


def log_rollup(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Newly (sum of the increments of `newly-append`), total of the first log, number and time of the last."""
    newly = F.sum(F.when(F.col("action") == "newly-append", F.coalesce("increment", F.lit(0))).otherwise(F.lit(0)))
    return logs.groupBy(*keys).agg(F.count("*").alias("n_logs"), newly.alias("newly"), F.min_by("total", "ord").alias("total"), F.max_by("action", "ord").alias("last_action"), F.max_by("ts_ms", "ord").alias("last_ts_ms"))


def next_log(logs: DataFrame, books: DataFrame, now_ms: int, force: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """The log row to add before a search, if any: `post-first` after one log; `post-append` when forced, all books were searched and 12 hours have gone.

    With `keys` (such as the month) each key's logs and books count by themselves; a key without books has all of them searched.
    """
    state = books.groupBy(*keys).agg(F.bool_and(F.col("page").isNotNull()).alias("searched"))
    rolled = log_rollup(logs, keys)
    rolled = rolled.join(state, list(keys), "left") if keys else rolled.crossJoin(F.broadcast(state))  # one row
    again = F.lit(force) & F.coalesce("searched", F.lit(True)) & (F.lit(now_ms) - F.col("last_ts_ms") > FAR_MS)
    action = F.when(F.col("n_logs") == 1, F.lit("post-first")).when(again, F.lit("post-append"))
    return rolled.select(*keys, F.col("n_logs").cast("int").alias("ord"), action.alias("action"), F.lit(now_ms).alias("ts_ms"), F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("increment")).filter("action IS NOT NULL")


def completeness(rows: DataFrame, done: Column, keys: tuple[str, ...] = (), what: Column | None = None) -> DataFrame:
    """For each key whether all rows are done, how many are not, and (given `what`) the sorted distinct names of those."""
    extra = [] if what is None else [F.array_sort(F.collect_set(F.when(~F.coalesce(done, F.lit(False)), what))).alias("missing")]
    good = F.coalesce(done, F.lit(False))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(good).alias("complete"), F.count_if(~good).alias("n_open"), *extra)


def backfill(books: DataFrame, feedback: DataFrame, base: str = "", most: int = MOST) -> DataFrame:
    """The books with pages filled in: the k-th feedback item of a title goes to the k-th book of that title whose page is ''.

    books: (ord, title, page, new); feedback: (ord, original_title, subject). Items whose page some book of the
    title has already are left out. Filled books are `new`; count them for the log's increment. The join is by title
    and k, so that a title of many books and items is no hot key; see `scan` for its numbers.
    """
    page = F.concat(F.lit(base), F.col("subject").cast("string"))
    items = feedback.filter(F.col("subject").isNotNull()).select(F.col("original_title").alias("title"), F.col("ord").alias("_ord"), page.alias("_page"))
    known = books.filter("page <> ''").select("title", F.col("page").alias("_page")).distinct()
    items = items.join(known, ["title", "_page"], "left_anti")
    items = numbered(items, ["title"], ["_ord", "_page"], "_k", most=most)
    # only open books are numbered; the others keep what they have
    opened = numbered(books.filter("page = ''"), ["title"], ["ord"], "_k", most=most)
    joined = opened.join(items.drop("_ord"), ["title", "_k"], "left")
    filled = joined.withColumns({"page": F.coalesce("_page", "page"), "new": F.col("_page").isNotNull() | F.col("new")}).select(books.columns)
    return filled.unionByName(books.filter(F.coalesce(F.col("page") != "", F.lit(True))))


def missing_worklist(books: DataFrame, labels: DataFrame, shop: str | None = None) -> DataFrame:
    """The worklist of books that were searched and not found, with empty fields; `shop` keeps those with a link there."""
    wanted = books.filter("page = ''")
    if shop is not None:
        wanted = wanted.filter(F.map_contains_key("link", F.lit(shop)))
    text, names = F.lit(""), F.array().cast("array<string>")
    matches = F.array().cast("array<struct<title:string,link:string,conf:double>>")
    date = F.concat(F.substring("month", 1, 4), F.lit("-"), F.substring("month", 5, 2), F.lit("-"), F.lpad(F.col("day").cast("string"), 2, "0"))
    return wanted.join(labels.select("label", "jp", "pub"), "label").select(
        "month", "day", "label", "ord", "title", F.lit(None).cast("string").alias("page"), "link",
        F.struct(names.alias("author"), names.alias("illust"), F.col("pub").alias("publisher"), F.col("jp").alias("label"), text.alias("price"), date.alias("date"), text.alias("pages"), text.alias("isbn")).alias("info"),
        text.alias("desc"), text.alias("cover"),
        F.struct(text.alias("name"), F.lit(0).alias("order"), F.array().cast("array<struct<title:string,date:string>>").alias("abstract")).alias("series"),
        F.struct(matches.alias("single"), matches.alias("series")).alias("search"),
        F.lit(0).alias("stage"), F.struct(F.lit(None).cast("long").alias("subject"), F.lit(False).alias("cover")).alias("feedback"),
    )


#: Bits of the filter that new keys make: in rows of 2^15, of which there are 2^12 at most, 16 MB whatever the keys.
BITS = 1 << 27


def among(record: DataFrame, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows of `record` whose key may be one of `keys`: all that are, and of the others about len(keys) / bits.

    Each key sets one bit of a table of bits, which is broadcast, so that `record` is only scanned. Null keys are not found.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    row, bit = F.floor(place / 32768).cast("int"), place % 32768
    table = keys.filter(F.col(key).isNotNull()).groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (bit % 8 + 1).cast("int"))) > 0
    return record.withColumn("_row", row).join(F.broadcast(table), "_row").filter(hit).drop("_row", "_bits")


def unseen(rows: DataFrame, record: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key the record lacks, the first of each key in any order, and the record with them.

    However large the record, it is read once and not shuffled: only those of its rows are that a filter of the new
    keys lets through (see `among`), and these settle what is new. Rows of a null key count as new, one of them.
    """
    firsts = rows.dropDuplicates([key])
    seen = among(record.select(key), rows.select(key), key)
    fresh = firsts.join(seen, key, "left_anti")
    return fresh, record.select(key).unionByName(fresh.select(key))


def compile_series(stories: DataFrame, part_sep: str = "\n\n\n\n　◇\n\n\n\n") -> DataFrame:
    """A10: (key, text): stories of one series in a document `s<id>`, the later crawled first; others by themselves.

    stories: (id, crawl, series, series_id, title, intro, parts).
    """
    intro = F.when(F.col("intro").isNotNull(), F.concat("intro", F.lit("\n\n---\n\n"))).otherwise(F.lit(""))
    body = F.regexp_replace(F.array_join("parts", part_sep), r"(?U)^\s+|\s+$", "")
    block = F.concat(F.lit("### "), "title", F.lit("\n\n"), intro, body)
    key = F.coalesce(F.concat(F.lit("s"), "series_id"), "id")
    rows = stories.select(key.alias("key"), "crawl", "series", "series_id", block.alias("block"))
    joined = rows.groupBy("key").agg(F.min_by("series", "crawl").alias("name"), F.max("series_id").alias("own"), F.reverse(F.array_sort(F.collect_list(F.struct("crawl", "block")))).alias("parts"))
    heading = F.when(F.col("own").isNotNull(), F.concat(F.lit("## "), F.split("name", " #")[0], F.lit("\n\n"))).otherwise(F.lit(""))
    return joined.select("key", F.concat(heading, F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n\n\n"), F.lit("\n")).alias("text"))


def episodes(tabs: DataFrame, keys: tuple[str, ...] = ("doc",), first_vol: int = 1, most: int = MOST) -> DataFrame:
    """(keys, vol, vol_title, ord, title, href): a chapter tab opens a volume and episodes join the latest; before any they form an untitled one.

    tabs: (keys, page, pos, kind, text, href), kind being 'chapter' or 'episode'.
    """
    own = list(keys)
    chapter = F.col("kind") == "chapter"
    marked = scan(tabs, own, ["page", "pos"], {"_n": chapter.cast("int")}, {"_name": F.when(chapter, F.col("text"))}, most)
    first = tabs.groupBy(*own).agg((F.min_by("kind", F.struct("page", "pos")) != "chapter").cast("int").alias("_untitled"))
    marked = marked.alias("_t").join(first.alias("_f"), same("_t", "_f", own)).select("_t.*", "_f._untitled").filter(~chapter)
    marked = numbered(marked.withColumn("vol", (F.col("_n") + F.col("_untitled") + (first_vol - 1)).cast("int")), [*own, "vol"], ["page", "pos"], "ord", 0, most)
    return marked.select(*own, "vol", F.coalesce("_name", F.lit("")).alias("vol_title"), F.col("ord").cast("int").alias("ord"), F.col("text").alias("title"), "href")


def volume_documents(parts: DataFrame, titles: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """A2 for novels: (keys, vol, text): `# title` in the first volume, `## volume` if it has a name, then `### episode` and its body.

    parts: (keys, vol, vol_title, ord, title, body); titles: (keys, title).
    """
    one = F.concat(F.lit("### "), "title", F.lit("\n\n"), F.regexp_replace("body", r"(?U)^\s+|\s+$", ""), F.lit("\n\n"))
    joined = parts.groupBy(*keys, "vol").agg(F.first("vol_title").alias("name"), F.array_sort(F.collect_list(F.struct("ord", one.alias("block")))).alias("own"))
    first = F.min("vol").over(W.partitionBy(*keys)) == F.col("vol")
    joined = joined.withColumn("first", first).join(titles.withColumnRenamed("title", "book_title"), list(keys), "left")
    head = F.when(F.col("first"), F.concat(F.lit("# "), F.coalesce("book_title", F.lit("")), F.lit("\n\n"))).otherwise(F.lit(""))
    volume = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("## "), "name", F.lit("\n\n"))).otherwise(F.lit(""))
    return joined.select(*keys, "vol", F.concat(head, volume, F.array_join(F.transform("own", lambda s: s["block"]), "\n\n")).alias("text"))


def series_order(volumes: DataFrame, items: DataFrame) -> DataFrame:
    """Items (series, date, ...) with `order`, the place from 0 of the first volume of their date, and `abstract`, the volumes from the oldest.

    volumes: (series, pos, title, date, newest_first); with that flag the list is turned around.
    """
    listed = volumes.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "date"))).alias("own"), F.bool_or("newest_first").alias("turned"))
    plain = F.transform("own", lambda v: F.struct(v["title"].alias("title"), v["date"].alias("date")))
    listed = listed.select("series", F.when(F.col("turned"), F.reverse(plain)).otherwise(plain).alias("abstract"))
    at = F.array_position(F.transform("abstract", lambda v: v["date"]), F.col("date")) - 1
    return items.join(listed, "series", "left").withColumn("order", F.when(at >= 0, at.cast("int")))


def infobox(items: DataFrame) -> DataFrame:
    """R2: with `infobox`, the fixed block of fields of each worklist item; the label's line is left out for UNLABELLED."""
    field = lambda name: F.coalesce(F.col(f"info.{name}"), F.lit(""))
    label = F.when(field("label") == UNLABELLED, F.lit("")).otherwise(F.concat(F.lit("\n|书系= "), field("label")))
    lines = [
        F.lit("{{Infobox animanga/Novel"), F.concat(F.lit("|作者= "), F.array_join("info.author", ",")), F.concat(F.lit("|插图= "), F.array_join("info.illust", ",")),
        F.concat(F.lit("|出版社= "), field("publisher"), label), F.concat(F.lit("|价格= "), field("price")), F.concat(F.lit("|发售日= "), field("date")),
        F.concat(F.lit("|页数= "), field("pages")), F.concat(F.lit("|ISBN= "), field("isbn")), F.lit("}}"),
    ]
    return items.withColumn("infobox", F.concat_ws("\n", *lines))


def month_title(month: Column, months_before: int = 0) -> Column:
    """`YYYY 年 M 月` of a YYYYMM month, or of one before it; January is followed by December of the year before."""
    day = F.add_months(F.to_date(F.concat(month, F.lit("01")), "yyyyMMdd"), -months_before)
    return F.concat(F.year(day).cast("string"), F.lit(" 年 "), F.month(day).cast("string"), F.lit(" 月"))


def report_entries(books: DataFrame) -> DataFrame:
    """Books with `entry`: the title, linked where a page is known, and the preferred shop's link."""
    title = F.when(F.coalesce("page", F.lit("")) == "", F.col("title")).otherwise(F.concat(F.lit("[url="), "page", F.lit("]"), "title", F.lit("[/url]")))
    link = preferred_link(F.col("link"))
    shop = F.when(link.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ([url="), link["url"], F.lit("]"), link["brand"], F.lit("[/url])")))
    return books.withColumn("entry", F.concat(title, shop))


def monthly_report(books: DataFrame, labels: DataFrame, logs: DataFrame, source: str = "", notes: str = "") -> DataFrame:
    """(month, text): for each month the count of new subjects in its own logs, then days, labels and entries, then the list of labels.

    books: (month, day, label, ord, title, page, link); labels: (label, zh, ord); logs: (month, ord, action, ts_ms,
    total, increment). Days and labels stand in the order of their first book. A month is one row; its days are
    put together before it.
    """
    known = labels.select("label", "zh", F.col("ord").alias("label_ord"))
    entries = report_entries(books.join(known, "label"))
    by_label = entries.groupBy("month", "day", "label", "zh").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "entry"))).alias("own"))
    block = F.concat(F.lit("[b][size=20]"), "zh", F.lit("[/size][/b]\n"), F.array_join(F.transform("own", lambda s: s["entry"]), "\n"))
    by_day = by_label.groupBy("month", "day").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", block.alias("block")))).alias("own"))
    number = F.substring("month", 5, 2).cast("int").cast("string")
    day = F.concat(F.lit("[b][size=25]"), number, F.lit("/"), F.col("day").cast("string"), F.lit("[/size][/b]\n"), F.array_join(F.transform("own", lambda s: s["block"]), "\n"), F.lit("\n"))
    months = by_day.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("first", day.alias("block")))).alias("own"))
    months = months.join(log_rollup(logs, ("month",)).select("month", "newly"), "month", "left")
    names = F.broadcast(labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "zh"))), lambda s: s["zh"]), "、").alias("names")))  # one row
    text = F.concat_ws(
        "\n", F.concat(month_title(F.col("month"), 1), F.lit("文库・单行本新刊情报")), F.concat(F.lit("已添加 "), F.coalesce("newly", F.lit(0)).cast("string"), F.lit(" 个独立词条")), F.lit(notes),
        F.array_join(F.transform("own", lambda s: s["block"]), "\n"), F.concat(F.lit("收录书系："), "names"), F.lit(source),
    )
    return months.crossJoin(names).select("month", text.alias("text"))


def shops(books: DataFrame) -> DataFrame:
    """How many books each shop of `link` has, in the shops' order of preference."""
    rank = F.coalesce(*[F.when(F.col("brand") == name, F.lit(i)) for i, (_, name) in enumerate(BRANDS)])
    return books.select(F.explode(F.map_keys("link")).alias("brand")).groupBy("brand").agg(F.count("*").alias("n")).withColumn("rank", rank)
