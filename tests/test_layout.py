"""Sequential models of the order-dependent operators, against shuffled rows in several partitions."""

import random
import re
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookflow.operators import layout

ENDS = ("。", "」", "）")


def shuffled(spark, rows, schema, parts):
    rows = list(rows)
    random.Random(parts).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(parts)


def model_paragraphs(pages):
    done, now = [], ""
    for i, lines in enumerate(pages):
        for line in lines:
            if not line.strip():
                if now:
                    done.append(now.rstrip())
                    now = ""
                done.append("")
            elif line.endswith(" "):
                done.append(now + line.rstrip())
                now = ""
            else:
                now += line
        if i < len(pages) - 1 and now and now.endswith(ENDS):
            done.append(now.rstrip())
            now = ""
    return done + [now.rstrip()] if now else done


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_paragraphs(spark, parts):
    rnd = random.Random(parts)
    docs, rows = {}, []
    for d in range(60):
        pages = [[rnd.choice(["あ。", "い", "う ", "", "  ", "え」", "お）", "か 。", "き\t"]) for _ in range(rnd.randint(1, 6))] for _ in range(rnd.randint(1, 6))]
        docs[f"d{d}"] = model_paragraphs(pages)
        rows += [(f"d{d}", p, i, x) for p, own in enumerate(pages) for i, x in enumerate(own)]
    got = {}
    for r in layout.rebuild_paragraphs(shuffled(spark, rows, "doc string, page int, pos int, line string", parts)).orderBy("doc", "para").collect():
        got.setdefault(r.doc, []).append(r.text)
    assert got == docs


def model_lines(chars):
    sizes = [c[4] for c in chars]
    mid = statistics.median(sizes)
    xs = [c[5] for c in chars]
    centre = (min(xs) + max(xs)) / 2
    lines = []
    for c in sorted((c for c in chars if c[4] >= 0.7 * mid), key=lambda c: -c[6]):
        for line in lines:
            if abs(c[6] - line["y"]) < 0.3 * mid:
                line["c"].append(c)
                line["y"] = (line["y"] * (len(line["c"]) - 1) + c[6]) / len(line["c"])
                break
        else:
            lines.append({"y": c[6], "c": [c]})
    out = []
    for line in lines:
        own = sorted(line["c"], key=lambda c: c[5])
        if abs(own[0][5] - centre) < 20 and len(own) <= 3:
            continue
        out.append(unicodedata.normalize("NFC", "".join(c[3] for c in own).replace("゛", "゙").replace("゜", "゚")))
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_lines(spark, parts):
    rnd = random.Random(parts)
    rows, want = [], {}
    for page in range(40):
        chars = [("d", page, i, rnd.choice("あか゛文字。"), rnd.choice([10.0, 10.0, 10.0, 5.0, 12.0]), float(rnd.randint(0, 300)), 700 - 14.0 * rnd.randint(0, 6) + rnd.choice([0, 1.5, -2.5])) for i in range(rnd.randint(1, 50))]
        rows += chars
        want[page] = model_lines(chars)
    got = {}
    for r in layout.cluster_lines(shuffled(spark, rows, "doc string, page int, seq int, text string, size double, x0 double, y1 double", parts)).orderBy("page", "pos").collect():
        got.setdefault(r.page, []).append(r.line)
    assert got == {k: v for k, v in want.items() if v}


def test_repeated(spark):
    rows = [("d", p, 0, " head ") for p in range(79)] + [("d", p, 1, "often") for p in range(80)] + [("d", p, 2, "all") for p in range(100)] + [("d", 0, 3, "twice"), ("d", 0, 4, "twice"), ("d", 5, 5, " ")]
    lines = spark.createDataFrame(rows, "doc string, page int, pos int, line string")
    found = layout.repeated_lines(lines)
    assert {(r.line, r.n_found, r.n_pages) for r in found.collect()} == {("often", 80, 100), ("all", 100, 100)}
    kept = layout.drop_repeated(lines, found)
    assert kept.count() == 79 + 3 and kept.columns == lines.columns
    more = spark.createDataFrame([("d", 101)], "doc string, n_pages long")
    assert {r.line for r in layout.repeated_lines(lines, counts=more).collect()} == {"all"}


AR, CN = "[0123456789]", "[〇零一两二三四五六七八九十百千万]"
CHAPTER = re.compile(f"^(第{AR}+话|第{CN}+章|(番外|特典){CN}*|序章|序幕|引子|间章|间幕|终章|终幕|后话|后记|完结)")
VOLUME = re.compile("^(第0话)|^(第一章)|^(序章)|^(序幕)|^(引子)")


def model_ocr(pages, volume, indent):
    out, numbers, first, skip, skipped = {}, "〇一二三四五六七八九十", True, False, []
    now = None
    for index, (new, lines) in enumerate(pages):
        for i, (words, left) in enumerate(lines):
            text = words.replace("”", "」").replace("“", "「")
            if i == 0 and new:
                if VOLUME.search(text) or index == 0:
                    now = volume
                    out[now] = f"## 第{numbers[volume]}卷\n\n"
                    volume += 1
                    first = True
                if CHAPTER.search(text):
                    skip = False
                    if not first:
                        out[now] += "\n\n\n\n"
                    text = CHAPTER.sub("### \\1　", text)
                else:
                    skipped.append(text)
                    skip = True
                    break
            elif skip:
                break
            elif left > indent:
                if now is not None:
                    out[now] += "\n\n"
            if now is None:
                continue
            out[now] += text
            first = False
    return {k: v + "\n" for k, v in out.items()}, skipped


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_ocr(spark, parts):
    rnd = random.Random(parts)
    rows, want, skips = [], {}, Counter()
    for d in range(40):
        pages = [(rnd.random() < 0.4, [(rnd.choice(["第1话“甲”", "第一章", "番外二", "序幕", "正文", "后记", "x第1话", "乙”"]), rnd.choice([10, 100, 101])) for _ in range(rnd.randint(1, 4))]) for _ in range(rnd.randint(1, 8))]
        if d % 4:
            pages[0] = (True, [("第一章", 10), *pages[0][1]])
        text, skipped = model_ocr(pages, 1, 100)
        # a volume of skipped lines alone has no row
        want |= {(d, v): t for v, t in text.items() if t != f"## 第{'〇一二三四五六七八九十'[v]}卷\n\n\n"}
        skips.update((d, s) for s in skipped)
        rows += [(d, p, new, [(w, x) for w, x in lines]) for p, (new, lines) in enumerate(pages)]
    ocr = shuffled(spark, rows, "doc int, page int, new boolean, lines array<struct<words:string,left:int>>", parts)
    assert {(r.doc, r.volume): r.text for r in layout.merge_ocr(ocr).collect()} == want
    assert Counter((r.doc, r.text) for r in layout.ocr_lines(ocr).filter("title_skipped").collect()) == skips


def test_numbers(spark):
    got = [r.x for r in spark.range(1, 31).orderBy("id").select(layout.chinese_number(F.col("id")).alias("x")).collect()]
    assert got[0] == "一" and got[9:12] == ["十", "十一", "十二"] and got[19:22] == ["二十", "二十一", "二十二"]
    odd = {0: "〇", 99: "九十九", 100: "一百", 101: "一百〇一", 110: "一百一十", 111: "一百一十一", 200: "二百", 1000: "一千", 1005: "一千〇五", 1050: "一千〇五十", 2340: "二千三百四十", 9999: "九千九百九十九", 10000: "10000", -3: "-3"}
    got = {r.n: r.x for r in spark.createDataFrame([(n,) for n in odd], "n int").select("n", layout.chinese_number(F.col("n")).alias("x")).collect()}
    assert got == odd
    pages = spark.createDataFrame([("b", 3), ("b", 9), ("b", 4), ("c", 1)], "book string, page int")
    assert [(r.book, r.page, r.number) for r in layout.renumber(pages, ["book"], ["page"], 1).orderBy("book", "page").collect()] == [("b", 3, 1), ("b", 4, 2), ("b", 9, 3), ("c", 1, 1)]
