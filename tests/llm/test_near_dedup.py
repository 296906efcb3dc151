import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookflow.llm import near_dedup
from tests.llm.helpers import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        near = set()
        for g in s:
            near.update(index.setdefault(g, []))
            index[g].append(i)
        for j in near:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(near_dedup.link_documents(df, percent=85)) == brute([(r.doc_id, r.text) for r in df.collect()], 85)


def family(rnd, n, words, most):
    vocab = [f"w{i}" for i in range(500)]
    base = rnd.choices(vocab, k=words)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, most)):
            w[rnd.randrange(words)] = rnd.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "deepest"), [(512, 10), (12, 1), (40, 3)])
def test_large_groups(spark, small, deepest):
    """A group of near copies far larger than a node may be, with copies and strangers: also by the ways for large nodes."""
    rnd = random.Random(small)
    texts = family(rnd, 150, 120, 7) + family(rnd, 40, 60, 2) + ["Equal text of Six words here"] * 30 + ["equal TEXT of six words here"]
    texts += [" ".join(rnd.choices([f"v{i}" for i in range(300)], k=50)) for _ in range(60)] + ["two words", "two words", "words two"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_dedup, "LEADERS", 3)
        assert got(near_dedup.link_documents(documents(spark, rows), percent=85, small=small, deepest=deepest)) == brute(rows, 85)


def twins_met(spark, n, small, like, base=0.72):
    """Of n twins in a family of 2n texts, less alike than a link needs, the share that meets in a leaf. Twins agree in `like` of their tokens."""
    rnd = np.random.RandomState(80)
    t, step = near_dedup.TOKENS, like - base
    kind, own = rnd.rand(n, t), lambda: rnd.randint(1000, 2**31 - 1, (n, t))
    a = np.where((kind < like - step) | (kind > 0.9), np.arange(t), own())
    b = np.where(kind < base, np.arange(t), np.where(kind < like, a, np.where(kind < 0.9, np.arange(t), own())))
    pdf = pd.DataFrame({"rep": np.arange(2 * n), "comp": np.arange(2 * n), "n_shingles": 100, "tokens": np.concatenate([a, b]).tolist()})
    classes = near_dedup.cut(spark.createDataFrame(pdf, "rep long, comp long, n_shingles long, tokens array<int>"))
    leaves, rest, _ = near_dedup.nodes(classes, small)
    held = leaves.unionByName(rest).select("node", (F.col("rep") % n).alias("twin"))
    return held.groupBy("node", "twin").count().filter("count > 1").select("twin").distinct().count() / n


def test_large_loose_family(spark):
    """Twins in a family of many texts, less alike than a link needs, are not parted on the way to small nodes."""
    assert twins_met(spark, 1000, 24, 0.8) >= 0.999


@pytest.mark.parametrize(("like", "least"), [(0.8, 0.98), (0.85, 0.995)])
def test_recall_in_large_nodes(spark, like, least):
    """The same in a family of 8,000 texts, with nodes as large as they are in use."""
    assert twins_met(spark, 4000, near_dedup.SMALL, like) >= least


def test_rows_meet_their_nodes_once(spark):
    """What a level ends is read back, not joined again, and a ruled node's rows come with the number of its parts and groups."""
    pdf = pd.DataFrame({"rep": np.arange(40), "comp": np.where(np.arange(40) < 30, 0, np.arange(40)), "n_shingles": 100, "tokens": [[1] * near_dedup.TOKENS] * 40})
    classes = near_dedup.cut(spark.createDataFrame(pdf, "rep long, comp long, n_shingles long, tokens array<int>"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_dedup, "LEADERS", 3)
        leaves, rest, ruled = near_dedup.nodes(classes, 12)
        for df in (leaves, ruled):
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert leaves.count() == rest.count() == 0
        assert sorted((r.rep, r.comp, r.top, r.parts, r.groups) for r in ruled.collect()) == [(i, 0 if i < 30 else i, 0, 10, 3) for i in range(40)]


def test_odd_rows(spark):
    out = near_dedup.link_documents(documents(spark, [*ODD, (50, "shared id one two three four"), (50, "other text of the same id"), (49, "other text of the same id")]))
    seen = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    want = [(None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 0, 7, True), (50, 2, 49, False), (50, 2, 49, False), (49, 2, 49, True)]
    assert seen == sorted(want, key=str)
    empty = documents(spark, ODD).filter("doc_id > 99")
    assert near_dedup.link_documents(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).columns == empty.columns
