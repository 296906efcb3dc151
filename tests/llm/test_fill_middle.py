import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from bookflow.llm import fill_middle
from tests.llm.helpers import ODD, documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_example(key, text):
    """The example by the rule's own words: units cut one by one."""
    text = text or ""
    digest = sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def strange(rng, n):
    return "".join(rng.choice(["a", "é", " ", "\U0001f600", " ", "\n", "\t", "\x0b", "\x0e", "\x08", "\x85", "<", "S>", "<S", "\x1f", "!"]) for _ in range(n))


def check(df):
    rows = fill_middle.fill_in_middle(df)
    got = rows.select("*", fill_middle.restored(rows.example, rows.form).alias("text")).collect()
    want = sorted(((d.doc_id, *plain_example(d.doc_id, d.text), d.text or "") for d in df.collect()), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.example, r.text) for r in got), key=str) == want
    return got


def test_strange_texts(spark):
    rng = random.Random(3)
    rows = [(i, strange(rng, rng.choice([0, 1, 2, 7, 8, 9, 40, 300]))) for i in range(800)]
    got = check(documents(spark, rows))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    marked = [(i, f"a text with {m} inside") for i in range(20) for m in fill_middle.MARKS]
    assert all(r.form == "plain" for r in check(documents(spark, marked)))
    check(documents(spark, ODD * 2 + [(i, "a  b\n c " * 30_000) for i in range(6)]))
    assert fill_middle.fill_in_middle(documents(spark, ODD).filter("doc_id > 99")).count() == 0


def test_other_marks(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = fill_middle.fill_in_middle(documents(spark, [(i, "uno <S> dos tres") for i in range(60)]), plain=100, spm=50, marks=marks)
    back = rows.select("example", "form", fill_middle.restored(rows.example, rows.form, marks).alias("text")).collect()
    assert {r.form for r in back} == {"psm", "spm"} and {r.text for r in back} == {"uno <S> dos tres"} and all("[mid]" in r.example for r in back)


def test_words_of_eight_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 8 * 500, dtype=np.uint8)
    data[::3] = rng.choice([8, 9, 13, 14, 32, 31, 33, 0x89, 0xA0], len(data[::3]))
    high = (fill_middle.spaces(data.view("<u8")).view(np.uint8) >> 7).astype(bool)
    assert (high == ((data == 32) | (data >= 9) & (data <= 13))).all()
    marks = fill_middle.Marks(fill_middle.unit_ends(data.view("<u8")))
    at = np.flatnonzero(~high & np.append(high[1:], True))
    assert (marks.select(np.arange(1, len(at) + 1)) == at).all()
    assert (marks.rank(np.arange(len(data) + 1)) == np.concatenate([[0], np.cumsum(np.isin(np.arange(len(data)), at))])).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_parts_of_a_batch(kind, monkeypatch):
    texts = pa.array(["a b", None, "", "é é  ", "c", "d  e\n"], kind)
    h = pa.array([1, 1, 1, 1, 1, 1]), pa.array([2, 2, 2, 2, 2, 2])
    whole = fill_middle.cut_batch(texts, *h).to_pylist()
    assert [x["n"] for x in whole] == [2, 0, 0, 3, 1, 3]
    monkeypatch.setattr(fill_middle, "PART", 4)
    assert fill_middle.cut_batch(texts, *h).to_pylist() == whole
    for i in range(6):
        assert fill_middle.cut_batch(texts.slice(i), *(x.slice(i) for x in h)).to_pylist() == whole[i:]
