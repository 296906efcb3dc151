import zlib

import numpy as np

from bookflow.llm import language
from tests.llm.helpers import ODD, documents


def brute_kneser_ney(words):
    """The probability of each character of ' word ' by the textbook recursion, with dictionaries."""
    n = language.ORDER
    grams = [{} for _ in range(n + 1)]
    for w, c in words.items():
        s = " " * (n - 1) + w + " "
        for i in range(n - 1, len(s)):
            for k in range(1, n + 1):
                g = s[i - k + 1 : i + 1]
                grams[k][g] = grams[k].get(g, 0) + c
    for k in range(1, n):
        grams[k] = {g: len({h[0] for h in grams[k + 1] if h[1:] == g}) for g in grams[k]}

    def p(s, k):
        if k == 0:
            return 1 / 4000
        ctx, low = s[:-1][-(k - 1) :] if k > 1 else "", p(s, k - 1)
        after = {g: c for g, c in grams[k].items() if g[:-1] == ctx}
        if not after:
            return low
        total = sum(after.values())
        got = after.get(ctx + s[-1], 0)
        return max(got - language.DISCOUNT, 0) / total + language.DISCOUNT * len(after) / total * low

    return lambda w: sum(np.log(p((" " * (n - 1) + w + " ")[: i + 1], n)) for i in range(n - 1, n + len(w)))


def test_against_brute_force():
    a = "the cat sat on the mat that the rat ate banana bandana".split()
    b = "le chat est sur la natte que le rat mange".split()
    model = language.train([" ".join(a), " ".join(b)], ["a", "b"])
    probe = ["the", "rat", "zebra", "ban", "natte", "é", "t"]
    logs, sizes = model.words(probe)
    for k, own in enumerate((a, b)):
        want = brute_kneser_ney({w: own.count(w) for w in own})
        assert np.allclose(logs[:, k], [want(w) for w in probe])
    assert sizes.tolist() == [len(w) + 1 for w in probe]


def test_held_out(spark, sf):
    rows = {r.doc_id: r for r in language.op5_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= rows[d.doc_id].score <= 1 for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert np.mean([rows[d.doc_id].lang_reliable for d in held]) > 0.9


def test_odd_rows(spark):
    model = language.train(["the river of words", "der fluss der wörter"], ["en", "de"])
    rows = [*ODD, (30, "12 34 -- !"), (31, "DER FLUSS"), (32, "the river")]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(documents(spark, rows), model).collect()}
    assert got[30] == got[1] == got[2] == ("und", 0.0) and got[31][0] == "de" and got[32][0] == "en" and 0.5 <= got[32][1] <= 1
    empty = documents(spark, ODD).filter("doc_id > 99")
    none = language.fit(empty)
    assert {r.lang_pred for r in language.identify(documents(spark, ODD), none).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
