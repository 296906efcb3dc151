import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from bookflow.functions import similarity as S
from bookflow.functions import text as T


def one(spark, make, *values, kinds="string"):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {kinds}" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(("site", "url", "want"), [
    ("Rakuten", "https://hb.example/x?pc=https%3A%2F%2Fbooks.example%2Frb%2F1%2F%3Fscid%3Da&m=1", "https://books.example/rb/1/"),
    ("Rakuten", "https://hb.example/x?m=1", "https://hb.example/x?m=1"),
    ("Rakuten", "https://hb.example/x?pc=", "https://hb.example/x?pc="),
    ("Yahoo", "https://ck.example/?sid=1&vc_url=http%3A%2F%2Fshop.example%2Fa+b%2F%E6%9C%AC%2A~%3Fk%3D1%26z%3D2", "http://shop.example/a%20b/%E6%9C%AC%2A~?k=1&z=2"),
    ("Yahoo", "https://ck.example/?sid=1", "https://ck.example/?sid=1"),
    ("Amazon", "https://a.example/?pc=x&vc_url=y", "https://a.example/?pc=x&vc_url=y"),
])
def test_clean_url(spark, site, url, want):
    assert one(spark, T.clean_url, site, url) == want


def test_brands(spark):
    hrefs = ["https://x.example/", "https://www.amazon.co.example/1", "https://ck.valuecommerce.example/2", "https://www.amazon.co.example/3", "https://rakuten.example/?to=amazon"]
    df = spark.createDataFrame([(hrefs,), ([],), (["https://z.example"],)], "h array<string>").select(T.brand_links(F.col("h")).alias("m"))
    rows = df.select("m", T.preferred_link(F.col("m")).alias("p")).collect()
    # the last link that names the shop counts, even one of another shop that mentions it
    assert rows[0].m == {"Amazon": "https://rakuten.example/?to=amazon", "Yahoo": "https://ck.valuecommerce.example/2"}
    assert (rows[0].p.brand, rows[0].p.url) == ("Amazon", "https://rakuten.example/?to=amazon")
    assert rows[1].m == {} and rows[1].p is None and rows[2].p is None
    got = spark.createDataFrame([({"Yodobashi": "y", "Rakuten": "r"},)], "m map<string,string>").select(T.preferred_link(F.col("m")).alias("p")).first().p
    assert (got.brand, got.url) == ("Rakuten", "r")


def test_titles(spark):
    assert one(spark, T.half_width, "ＡＢ　１２！？（３）～ａｚ「") == "AB 12！？(3)~az「"
    assert one(spark, T.norm_title, "Ｔｉｔｌｅ！  第（１０）巻　（1.5） (x)") == "title！ 第10巻 1．5 (x)"
    assert one(spark, T.compose_marks, "か゛は゜ア゛") == unicodedata.normalize("NFC", "がぱア゙")
    assert one(spark, T.strip_ruby, "<ruby><rb>漢</rb><rt>かん</rt></ruby>字") == "漢字"
    assert one(spark, T.strip, "　 a b\t　") == "a b"
    assert one(spark, T.parse_jp_date, "発売日 2024年1月5日 他") == "2024-01-05" and one(spark, T.parse_jp_date, "2024/1/5") is None
    assert one(spark, T.norm_title, None) is None


def test_creators(spark):
    for s, author, illust in (("泉サリ(著・絵)", ["泉サリ"], ["泉サリ"]), ("浅葱(著) , しの(絵)", ["浅葱"], ["しの"]), ("", [], []), ("だれか,a(訳)", [], [])):
        got = one(spark, T.split_creators, s)
        assert (got.author, got.illust) == (author, illust)


def test_product(spark):
    df = spark.createDataFrame([({"著者／編集": "甲(著)", "ページ数": "320p", "ISBN": "978", "シリーズ": "S"}, "770", ["d1", "d2"], "https://i.example/a/b.jpg?x"), ({}, "1", [], "https://i.example/n.gif")], "m map<string,string>, p string, d array<string>, c string")
    a, b = (r.x for r in df.select(T.product_fields(F.col("m"), F.col("p"), F.col("d"), F.col("c")).alias("x")).collect())
    assert (a.author, a.price, a.pages, a.isbn, a.desc, a.cover, a.series) == (["甲"], "￥700", "320", "978", "d1", "b.jpg", "S")
    assert (b.author, b.price, b.pages, b.desc, b.cover, b.series) == ([], "￥1", "", "", None, None)


def test_kana(spark):
    for s, want in (("漢字", False), ("あ", True), ("・", False), ("ー", True), ("ヺ", True), ("abc", False)):
        assert one(spark, T.has_kana, s) is want
    assert one(spark, lambda c: T.fade(c, True), "あ").startswith("<p style=") and one(spark, lambda c: T.fade(c, False), "あ") == "あ" and one(spark, lambda c: T.fade(c, None), "あ") == "あ"


def test_paths(spark):
    import posixpath

    for base, href in (("OEBPS/text", "../img/a.png"), ("OEBPS", "./b.xhtml#x"), ("", "c.html"), ("a", "../../d"), ("a/b", "/e/../f"), ("a", "b//c/."), ("", ""), ("a", "..")):
        want = posixpath.normpath(posixpath.join(base, href.split("#")[0]))
        assert one(spark, T.resolve_path, base, href) == want
    assert one(spark, lambda c: T.absolute_url("https://n.example", c), "/n1/2/") == "https://n.example/n1/2/"


def test_chapter_marks(spark):
    for s, text, volume, chapter in (("第12话 x", "### 第12话　 x", False, True), ("第0话", "### 第0话　", True, True), ("第一章“甲”", "### 第一章　「甲」", True, True), ("番外三", "### 番外三　", False, True), ("后记", "### 后记　", False, True), ("序章", "### 序章　", True, True), ("他说第1话", "他说第1话", False, False)):
        got = one(spark, T.chapter_marks, s)
        assert (got.text, got.volume, got.chapter) == (text, volume, chapter)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def brute_similarity(a, b):
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0
    words = lambda s: " ".join(sorted(s.split()))

    def part(x, y):
        if not x or not y:
            return float(x == y)
        if len(x) > len(y):
            x, y = y, x
        pieces = [y[i : i + len(x)] for i in range(len(y) - len(x) + 1)] + [y[:i] for i in range(1, len(x))] + [y[-i:] for i in range(1, len(x))]
        return max(ratio(x, p) for p in pieces)

    return max(ratio(a, b), ratio(words(a), words(b)), part(a, b), part(b, a) if len(a) == len(b) else 0)


def test_similarity(spark):
    rnd = random.Random(1)
    pairs = [("", ""), ("a", ""), ("x", "x 2"), ("b a", "a b"), ("abc", "cba"), ("a" * 80, "a" * 79 + "b")]
    pairs += [tuple("".join(rnd.choice("abc 本") for _ in range(rnd.randint(0, 12))) for _ in range(2)) for _ in range(1500)]
    for a, b in pairs:
        assert abs(S.similarity(a, b) - brute_similarity(a, b)) < 1e-12, (a, b)
    got = spark.createDataFrame(pairs[:50] + [(None, "a")], "a string, b string").select("a", "b", S.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s is None if r.a is None else abs(r.s - brute_similarity(r.a, r.b)) < 1e-12 for r in got)
