"""Column functions on titles, links, names, dates and lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Shops in order of preference, the part of a link that names each, and the link parameter
# that holds the shop's own address.
BRANDS = (("amazon", "Amazon"), ("rakuten", "Rakuten"), ("valuecommerce", "Yahoo"), ("yodobashi", "Yodobashi"))
RAKUTEN_PARAMETER, YAHOO_PARAMETER = "pc", "vc_url"
# Kana without the middle dot.
KANA = "[ぁ-ゖ゛-ヺー-ヿ]"
# How chapter and volume titles begin.
DIGITS, NUMERALS = "[0-9]", "[〇零一两二三四五六七八九十百千万]"
CHAPTERS = (f"第{DIGITS}+话", f"第{NUMERALS}+章", f"(?:番外|特典){NUMERALS}*", "序章|序幕|引子", "间章|间幕", "终章|终幕|后话", "后记|完结")
CHAPTER = f"^({'|'.join(CHAPTERS)})"
VOLUME = "^(?:第0话|第一章|序章|序幕|引子)"
RUBY = "<rt>.*?</rt>|</?ruby>|</?rb>"


def strip(s: Column) -> Column:
    """`s` without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def query_value(url: Column, name: str) -> Column:
    """The decoded first non-empty value of a link's parameter; null if there is none."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def percent_encoded(s: Column) -> Column:
    """UTF-8 percent encoding that keeps letters, digits, `_.-~` and `:/?=&`."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_url(site: Column, url: Column, rakuten: str = RAKUTEN_PARAMETER, yahoo: str = YAHOO_PARAMETER) -> Column:
    """an affiliate link reduced to the shop's own address; unchanged for other shops or without the parameter."""
    own = query_value(url, rakuten)
    part = lambda k: F.regexp_extract(own, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", k)
    plain = F.concat(F.lower(part(1)), F.lit("://"), part(2), F.regexp_replace(part(3), ";[^/]*$", ""))
    other = percent_encoded(query_value(url, yahoo))
    return F.when((site == "Rakuten") & own.isNotNull(), plain).when((site == "Yahoo") & other.isNotNull(), other).otherwise(url)


def brand_of(href: Column) -> Column:
    """The first shop, in order, whose mark is in the link; null if none."""
    return F.coalesce(*[F.when(F.contains(href, F.lit(key)), F.lit(name)) for key, name in BRANDS])


def brand_links(hrefs: Column) -> Column:
    """map from shop to its last link among `hrefs`; links of no shop are dropped."""
    last = lambda name: F.get(F.reverse(F.filter(hrefs, lambda h: brand_of(h) == name)), 0)
    every = F.create_map(*[x for _, name in BRANDS for x in (F.lit(name), last(name))])
    return F.map_filter(every, lambda k, v: v.isNotNull())


def preferred_link(link: Column) -> Column:
    """(brand, url) of the first shop, in order of preference, in the map; null if empty."""
    return F.coalesce(*[F.when(F.map_contains_key(link, F.lit(name)), F.struct(F.lit(name).alias("brand"), F.try_element_at(link, F.lit(name)).alias("url"))) for _, name in BRANDS])


def half_width(s: Column) -> Column:
    """full-width forms as ASCII, the wide space as a space; the wide ! and ? stay."""
    wide = [c for c in range(0xFF01, 0xFF5F) if c not in (0xFF01, 0xFF1F)]
    return F.translate(s, "　" + "".join(map(chr, wide)), " " + "".join(chr(c - 0xFEE0) for c in wide))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in s], dtype=object)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in s], dtype=object)


def norm_title(s: Column) -> Column:
    """a title as it is compared: NFKC, lower case, wide ! and full stop, single spaces, no brackets around numbers."""
    out = F.replace(F.replace(F.lower(nfkc(s)), F.lit("!"), F.lit("！")), F.lit("."), F.lit("．"))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"(?U)[（(]([\d．.]+)[）)]", "$1")


def split_creators(s: Column) -> Column:
    """(author, illust) from a list like `A(著) , B(絵)`; `(著・絵)` is both, other suffixes neither."""
    parts = F.transform(F.split(s, ","), strip)
    cut = lambda end: lambda p: F.substring(p, F.lit(1), F.length(p) - len(end))

    def of(suffix: str) -> Column:
        own = F.filter(parts, lambda p: F.endswith(p, F.lit("(著・絵)")) | F.endswith(p, F.lit(suffix)))
        return F.transform(own, lambda p: F.when(F.endswith(p, F.lit("(著・絵)")), cut("(著・絵)")(p)).otherwise(cut(suffix)(p)))

    return F.struct(of("(著)").alias("author"), of("(絵)").alias("illust"))


def parse_jp_date(s: Column) -> Column:
    """the first `YYYY年M月D日` as YYYY-MM-DD; null if there is none."""
    pattern = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    part = lambda k: F.regexp_extract(s, pattern, k)
    return F.when(F.regexp_like(s, F.lit(pattern)), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def product_fields(meta: Column, price: Column, descriptions: Column, cover_url: Column) -> Column:
    """F8: what a product page says: net price, pages, isbn, first description, cover name (null for .gif), series (null if none), creators."""
    get = lambda key: F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit(""))
    url = F.regexp_extract(cover_url, r"^([^?]*)", 1)
    creators = split_creators(get("著者／編集"))
    return F.struct(
        creators["author"].alias("author"), creators["illust"].alias("illust"),
        F.concat(F.lit("￥"), F.round(price.cast("long") * 10 / 11).cast("long").cast("string")).alias("price"),
        F.regexp_replace(get("ページ数"), "^p+|p+$", "").alias("pages"), get("ISBN").alias("isbn"),
        F.coalesce(F.get(descriptions, 0), F.lit("")).alias("desc"),
        F.when(~F.endswith(url, F.lit(".gif")), F.regexp_extract(url, r"([^/]*)$", 1)).alias("cover"),
        F.try_element_at(meta, F.lit("シリーズ")).alias("series"),
    )


def strip_ruby(s: Column) -> Column:
    """a line without ruby readings and tags."""
    return F.regexp_replace(s, RUBY, "")


def has_kana(s: Column) -> Column:
    """whether there is kana in the line."""
    return F.regexp_like(s, F.lit(KANA))


def fade(line: Column, kana: bool | None, opaque: str = "0.4", size: str = "1em", top: str = "0px") -> Column:
    """the line in a faded paragraph if its having kana equals `kana`; with None no line is."""
    if kana is None:
        return line
    styled = F.concat(F.lit(f'<p style="opacity: {opaque}; font-size: {size}; top: {top}; ">'), line, F.lit("</p>"))
    return F.when(has_kana(line) == F.lit(kana), styled).otherwise(line)


def compose_marks(s: Column) -> Column:
    """spaced voice marks joined to the kana before them, in NFC."""
    return nfc(F.translate(s, "゛゜", "゙゚"))


def resolve_path(base: Column, href: Column) -> Column:
    """`href` without its fragment, seen from the folder `base`, with `.` and `..` worked out; an empty path is `.`."""
    bare = F.regexp_extract(href, r"^([^#]*)", 1)
    path = F.when(F.startswith(bare, F.lit("/")) | (F.coalesce(base, F.lit("")) == ""), bare).otherwise(F.concat(base, F.lit("/"), bare))
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.get(F.reverse(done), 0) != "..")
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", F.when(up, back).when(rooted, done).otherwise(F.array_append(done, part))).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(whole == "", F.lit(".")).otherwise(whole)


def absolute_url(site: str, href: Column) -> Column:
    """links that begin with `/` made absolute; others unchanged."""
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href)).otherwise(href)


def folder(path: Column) -> Column:
    """The folder of a path; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def corner_quotes(s: Column) -> Column:
    return F.translate(s, "“”", "「」")


def chapter_marks(s: Column) -> Column:
    """(text, volume, chapter): corner quotes, a chapter title marked as heading, and whether the line opens either."""
    text = corner_quotes(s)
    return F.struct(F.regexp_replace(text, CHAPTER, "### $1　").alias("text"), F.regexp_like(text, F.lit(VOLUME)).alias("volume"), F.regexp_like(text, F.lit(CHAPTER)).alias("chapter"))


def in_order(parts: Column, *keys: str) -> Column:
    """An array of structs sorted by the fields `keys` alone; the other fields may be of any type."""
    key = lambda x: F.struct(*[x[k].alias(k) for k in keys])
    return F.array_sort(parts, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
