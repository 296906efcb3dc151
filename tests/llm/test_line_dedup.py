import random

from bookflow.llm import line_dedup
from tests.llm.helpers import ODD, documents


def brute(rows, sites):
    seen, first = {}, {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            x = x.strip(" \t\n\x0b\x0c\r")
            if x:
                seen.setdefault(x, set()).add(s or "")
                if d is not None:
                    first[x] = min(first.get(x, d), d)
    bad = {x for x, s in seen.items() if len(s) >= sites}
    out = []
    for d, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (y := x.strip(" \t\n\x0b\x0c\r")) not in bad or first.get(y) == d]
        out.append((str(d), None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(spark, rows, sites):
    df = documents(spark, rows)
    want = brute([(r[0], r[1], r[2] if len(r) > 2 else "s1") for r in rows], sites)
    for most in (1_000_000, -1):  # the broadcast way, and the way by joins
        out = line_dedup.drop_spread_lines(df, sites, most=most)
        assert out.columns == [*df.columns, "_lines", "_removed"]
        assert sorted(((str(r.doc_id), r.text, r["_lines"], r["_removed"]) for r in out.collect()), key=str) == want
    return sum(r[3] for r in want)


def test_random(spark):
    rnd = random.Random(2)
    pool = [f"line {i}" for i in range(60)] + ["", "  ", "\t", " line 3 ", "ünï \U00020b9f"]
    rows = [(d, "\n".join(rnd.choice(pool[: rnd.choice([8, 65])]) for _ in range(rnd.randint(1, 9))), rnd.choice([f"s{i}" for i in range(12)])) for d in range(120)]
    assert check(spark, rows, 6) > 50


def test_odd_rows(spark):
    same = [(20 + i, "a notice\nown line %d" % i, f"s{i}") for i in range(10)] + [(40, "a notice", None)]
    assert check(spark, ODD + same, 8) == 10
    assert line_dedup.drop_spread_lines(documents(spark, ODD).filter("doc_id > 99")).count() == 0


def test_near_the_threshold(spark):
    rows = [(100 * k + i, f"line of {k}", f"s{i}") for k in (38, 39, 40, 41, 42, 60) for i in range(k)]
    df = line_dedup.spread_lines(documents(spark, rows), 40)
    assert sorted(r.first_key // 100 for r in df.collect()) == [40, 41, 42, 60]


def test_null_and_wide_ids(spark):
    """A line that only rows without an id hold stays in them, and ids over 2^53 stay exact beside null ones."""
    big = 2**59
    rows = [(None, "no id\nown", f"s{i}") for i in range(10)] + [(big + 1 + i, "wide id", f"s{i}") for i in range(10)]
    assert check(spark, rows, 8) == 9


def test_clashing_columns(spark):
    """Columns of the names used inside stay, with wide integers beside nulls whole; _lines and _removed are replaced."""
    big = 2**60 + 1
    rows = [(i, "a notice\nown %d" % i, f"s{i}", None if i % 3 else big + i, "k", [1], "r", "old", "old") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h long, _key string, _gone array<int>, _row string, _lines string, _removed string")
    for most in (1_000_000, -1):
        out = line_dedup.drop_spread_lines(df, 8, most=most)
        assert out.columns == df.columns and dict(out.dtypes)["_removed"] == "bigint"
        got = sorted((r.doc_id, r.text, r.h, r["_key"], r["_gone"], r["_row"], r["_lines"], r["_removed"]) for r in out.collect())
        assert got == [(i, "a notice\nown 0" if i == 0 else "own %d" % i, None if i % 3 else big + i, "k", [1], "r", 2, int(i > 0)) for i in range(10)]
