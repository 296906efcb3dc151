import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bookflow.llm import quality_model
from tests.llm.helpers import ODD, documents


def test_features_by_the_word():
    """A batch of words gives each word the features that it has alone."""
    words = [b"the", b"a", "größer".encode(), b"x" * 50, b"the,"]
    f, begin = quality_model.features(words)
    for i, w in enumerate(words):
        own, _ = quality_model.features([w])
        assert sorted(own) == sorted(f[begin[i] : [*begin, len(f)][i + 1]])
        assert len(own) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in quality_model.GRAMS)


def plain_logit(model, words):
    """A text's logit by loops over its words' own features: the word, and the n-grams of its bytes between < and >."""
    k, mask = 0x9E3779B97F4A7C15, 2**64 - 1

    def bucket(h):
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask
        return (h >> 20) % quality_model.BUCKETS

    total = 0.0
    for w in words:
        chars = [c + 1 for c in b"<" + w + b">"]
        found = [bucket((sum(c * pow(k, i, 2**64) for i, c in enumerate(chars)) + 77) & mask)]
        for n in quality_model.GRAMS:
            for i in range(len(chars) - n + 1):
                h = n
                for c in chars[i : i + n]:
                    h = (h * k + c) & mask
                found.append(bucket(h))
        total += sum(float(model.logits[f]) for f in found) / len(found)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return model.bias + (total + model.again * again) / (len(words) + quality_model.SHRINK)


def test_scores_by_plain_loops():
    rnd = np.random.RandomState(3)
    texts = [" ".join(rnd.choice(["calm", "river", "größe", "SPAM!!", "x", "words"], rnd.randint(1, 30))) for _ in range(40)]
    model = quality_model.train(texts, [int("SPAM" not in t) for t in texts])
    for t in texts:
        words = t.encode().split()
        known = dict(zip(words, model.words(words).tolist(), strict=True))
        assert abs(model.text(words, known) - plain_logit(model, words)) < 1e-4


def test_held_out(spark, sf):
    from bookflow.llm.quality_model import op2_quality_classifier

    rows = {r.doc_id: r for r in op2_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [r for r in labels if rows[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_held_out_labels_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_model.labelled(docs, labels, ~held) == quality_model.labelled(docs, turned, ~held)


def test_score_is_that_of_the_whole_text(spark):
    good, bad = ["calm river words of a story"] * 8, ["SPAM!! BUY!! NOW!!"] * 8
    model = quality_model.train(good + bad, [1] * 8 + [0] * 8)
    got = {r.doc_id: r.score for r in quality_model.score(documents(spark, [(1, good[0]), (2, bad[0]), (3, bad[0] * 200 + good[0])]), model).collect()}
    assert got[1] > 0.7 and got[2] < 0.3 and got[3] < 0.5
    words = (bad[0] * 200 + good[0]).encode().split()
    assert abs(got[3] - 1 / (1 + np.exp(-model.text(words, dict(zip(words, model.words(words).tolist(), strict=True)))))) < 1e-9


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 0), (6, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, ODD)
    model = quality_model.fit(docs, labels)
    got = quality_model.score(docs, model, out="h")
    assert got.count() == len(ODD) and got.filter("h IS NULL OR h < 0 OR h > 1").count() == 0 and sorted(got.columns) == sorted(docs.columns)
    none = quality_model.fit(docs, labels.filter("doc_id > 99"))
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.keep_good(docs.filter("doc_id > 99"), labels).count() == 0


def test_whole_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """A filter by quality sends a thousand rows at a time, and a task takes some thousands of words apart at a time."""

    def sized(docs, model, text="text", out="score"):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(len(b) <= 1000)] * len(b))], [*b.schema.names, out])

        return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.5)).schema)

    monkeypatch.setattr(quality_model, "score", sized)
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "'some text' AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_model.keep_good(docs, labels).count() == 3000
    assert quality_model.PORTION <= quality_model.KNOWN <= 100_000
