import random
import re
from collections import Counter

from bookflow.llm import quality_rules
from tests.llm.helpers import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def check(df):
    for r in quality_rules.measure(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_random(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b", "c", " ", "\U00020b9f", "#"]) + rnd.choice([" ", "\n", "\t", "  ", "\r\n", "\x1c"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    check(documents(spark, list(enumerate(texts)) + ODD))


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(300)]
    rows += [(5000, good, "tiny"), (5001, bad, "tiny"), (5002, bad, "one"), (5003, good, None), (5003, good, None)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept for i in range(300)) and not got[1000].base_failed
    assert got[5000].kept and got[5003].kept and not got[5001].kept and got[5002].host_ok


def test_odd_rows(spark):
    got = quality_rules.judge(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert quality_rules.judge(documents(spark, [(1, "a")]).filter("doc_id > 1")).count() == 0
