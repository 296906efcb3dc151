import random
import re

from pyspark.sql import functions as F

from bookflow.llm import decontaminate
from tests.llm.helpers import LONG, ODD, documents


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, s in items:
            n = min(5, len(words(s)))
            g, q = grams(w, n), grams(words(s), n)
            if d is not None and q and len(g & q) >= 0.8 * len(q):
                out.add((d, i, len(q), len(g & q)))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in df.collect()}


def test_random(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 8, 20, 40, 90])))) for i in range(40)] + [(90, None), (91, ""), (92, "Same. same, SAME same same same")]
    docs = []
    for d in range(150):
        words = rnd.choices(vocab, k=rnd.choice([4, 30, 300]))
        if d % 2:
            w = items[d % 40][1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = "other"
            at = rnd.randrange(len(words))
            words[at:at] = [x.upper() + rnd.choice(["", ",", "!"]) for x in w]
        docs.append((d, " ".join(words)))
    docs += [(500, items[0][1]), (501, "same same same same same same")]
    want = brute(docs, items)
    assert len(want) > 30
    for most in (1_000_000, -1):  # items by broadcast, and by a salted shuffle
        assert got(decontaminate.leaks(documents(spark, docs), bench(spark, items), most=most)) == want


def test_short_items_inside_long_documents(spark):
    items = [(1, "what is love now"), (2, "zebra"), (3, "no such words"), (4, "zebra")]
    docs = [(1, "deep river " * 3000 + "and WHAT, is love; now? " + "deep river " * 3000), (2, "what is love"), (3, "now what is love and a zebra"), (4, "zebras no such")]
    want = {(1, 1, 1, 1), (3, 2, 1, 1), (3, 4, 1, 1)}
    assert brute(docs, items) == want and got(decontaminate.leaks(documents(spark, docs), bench(spark, items))) == want


def test_odd_rows(spark):
    items = [(1, "deep river deep river deep"), (1, "deep river deep river deep"), (2, "one"), (3, None)]
    assert got(decontaminate.leaks(documents(spark, ODD), bench(spark, items))) == {(4, 1, 1, 1), (5, 2, 1, 1)}
    kept = decontaminate.decontaminate(documents(spark, ODD), bench(spark, items))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in ODD if d[0] not in (4, 5))
    assert LONG and decontaminate.leaks(documents(spark, ODD), bench(spark, items).filter("item_id > 9")).count() == 0
    assert decontaminate.leaks(documents(spark, ODD).filter("doc_id > 9"), bench(spark, items)).count() == 0


def test_few_hashes_are_probed(spark, sf):
    """Of the documents' hashes only what items may share is looked up, and nothing that they do share is left out."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.select(docs.doc_id.alias("_key"), docs.text.alias("_text"))
    found = decontaminate.item_shingles(items)
    sketch = decontaminate.sketches(found.groupBy("item_id").agg(F.collect_list("h").alias("h")))
    hashes = rows.select("_key", F.explode(decontaminate.doc_shingles(F.col("_text"), [5], decontaminate.hashed)).alias("h"))
    probes = decontaminate.probes(rows, sketch, [5]).cache()
    shared = hashes.join(sketch.select("h").distinct(), "h")
    assert 0 < shared.count() <= probes.count() < 0.1 * hashes.count()
    assert shared.join(probes, ["_key", "h"], "left_anti").count() == 0
