import random
from collections import Counter
from re import findall
from zlib import crc32

import pytest

from bookflow.llm import spelling
from tests.llm.helpers import ODD, documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(rows, least=3):
    seen = Counter()
    for key, text in rows:
        for run in findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc32(f"{'null' if key is None else key}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def grouped(df, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_spellings(df, **options).collect()}


@pytest.mark.parametrize("letters, most", [("ab", 2000), ("ab", 3), ("aBcé", 4), ("aÀÿb", 50)])
def test_dense_words(spark, letters, most):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 7, 8]))) for _ in range(200))) for i in range(40)]
    want = plain_groups(rows)
    assert len(want) > 100 and any(x[2] for x in want.values())
    assert grouped(documents(spark, rows), most=most) == want


def test_chains_and_ties(spark):
    counts = {"rivers": 3, "river": 6, "rive": 9, "riverr": 12, "riverrr": 24, "riverrrr": 48, "stonea": 8, "stoneb": 8, "stone": 4, "ztone": 3, "lonely": 5}
    rows = [(i, f"{w}-{w.upper()}1{w}") for i, (w, n) in enumerate(counts.items()) for _ in range(n)]
    want = plain_groups(rows)
    got = grouped(documents(spark, rows))
    assert got == want and got["river"][4] == "riverrrr" and got["lonely"][2] is None and got["stone"][2] == "stonea"


def test_long_words(spark):
    long = "ab" * 20_000
    words = [long, long + "a", long[:9_999] + "c" + long[10_000:], "c" + long, long[:-1], "a" * 30_000, "a" * 30_001, "a" * 15_000 + "b" + "a" * 15_000]
    rows = [(i, w) for w in words for i in range(8)]
    assert grouped(documents(spark, rows), most=2) == plain_groups(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD * 3] + [(None, "rivér") for _ in range(3)] + [(9, "ríver River")] * 3
    assert grouped(documents(spark, rows)) == plain_groups(rows)
    assert grouped(documents(spark, rows).filter("doc_id > 99")) == {}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("sing", "ring", "bring", "cling") for b in ("", "ing", "s", "er"))
    known = spelling.Acceptor(words)
    assert known.count[known.start] == len(words)
    right = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(known.final) == len(right)  # a state for each distinct set of continuations
    pairs = {(words[i], words[j]) for i, j, _, _ in known.pairs()}
    assert len(pairs) == len(list(known.pairs()))
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
