"""Operator 2: a text quality classifier on learned subword embeddings, trained with numpy."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches, table, tidy

#: Labelled rows of each class that training takes at most, by the smallest hashes of their ids: about 25 MB of text.
PER_CLASS = 1500
#: Hashed features, the size of a vector, the lengths of character n-grams, and passes over the sample.
BUCKETS, DIM, GRAMS, EPOCHS, RATE = 1 << 17, 8, (3, 4, 5), 6, 0.5
CUT = 0.3
#: Words that every text has besides its own, with no vector: the average of a short text stays near the middle.
SHRINK = 3
#: Words of texts that a task takes apart at a time, and distinct words whose logits it keeps: some MB of a worker.
PORTION, KNOWN = 50_000, 100_000

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)


def features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of words, one after the other, and where each word's features begin.

    A word's features are the word itself and the n-grams of its bytes between < and >.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    chars = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(_U) + _U(1)
    owner = np.repeat(np.arange(len(words)), size)
    end = begin + size
    # the whole word: a polynomial of its bytes
    power = np.ones(int(size.max()), _U)
    power[1:] = _K
    power = np.cumprod(power)
    at = np.arange(len(chars)) - begin[owner]
    whole = np.add.reduceat(chars * power[at], begin) + _U(77)
    found, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, _U)
        for k in range(n):
            h = h * _K + chars[k : len(chars) - n + 1 + k]
        inside = np.flatnonzero(np.arange(len(h)) + n <= end[owner[: len(h)]])
        found.append(h[inside])
        owners.append(owner[inside])
    h, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    h = h[order]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return ((h >> _U(20)) % _U(buckets)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


def repeats(words: list[bytes]) -> float:
    """The share of words that equal the word before: the bigram of a word with itself is one feature for all words."""
    return sum(map(operator.eq, words[1:], words)) / (len(words) + SHRINK)


@dataclass
class Model:
    """What a word's features and the repeated-word bigram add to the logit of class 1, and the logit of a text without words."""

    logits: np.ndarray
    again: float
    bias: float

    def text(self, words: list[bytes], known: dict[bytes, float]) -> float:
        """The logit of a text, with what `words` gives for each of its words in `known`."""
        n = len(words)
        return self.bias + (sum(map(known.__getitem__, words)) / (n + SHRINK) + self.again * repeats(words) if n else 0.0)

    def words(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), np.float32)
        for low in range(0, len(words), 20_000):
            f, begin = features(words[low : low + 20_000])
            n = np.diff(np.append(begin, len(f)))
            out[low : low + 20_000] = np.add.reduceat(self.logits[f], begin) / n
        return out


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Vectors of hashed words and n-grams, averaged for a word, then for a text; softmax of two classes; SGD, one text at a time.

    Classes weigh alike in a step but the bias moves the scores back to the classes' shares. With rows of one
    class only, or none, the score is that class's smoothed share everywhere.
    """
    y = np.array(labels, np.int64)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    rng = np.random.RandomState(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    docs = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            docs.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        f, begin = features(words)
        n = np.diff(np.append(begin, len(f)))
        ids, back = np.unique(f, return_inverse=True)
        w = np.bincount(back, np.repeat(1.0 / (n * (len(words) + SHRINK)), n))
        docs.append((np.append(ids, BUCKETS).astype(np.int32), np.append(w, repeats(words)).astype(np.float32)))
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, w = docs[i]
            rate = RATE * (1 - step / steps) * weight[y[i]]
            step += 1
            e = emb[ids]
            v = w @ e if len(ids) else np.zeros(DIM, np.float32)
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = (p @ out).astype(np.float32)
            out -= rate * np.outer(p, v).astype(np.float32)
            bias -= np.float32(rate * 0.1) * p.astype(np.float32)
            if len(ids):
                # a feature moves by its share of the text's average relative to the largest share, else long texts would teach nothing
                move = w / w[:-1].max()
                move[-1] = w[-1]
                emb[ids] = e - np.float32(rate) * np.outer(move, g)
    logits = emb @ (out[1] - out[0])
    return Model(logits[:-1], float(logits[-1]), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """The bounded training sample: texts and labels of rows for which `learn` holds, at most about `per_class` of each class.

    An id with labels of both kinds counts as 0; null labels and ids do not count. Rows of `docs` that repeat id and
    text count once, and those of one id with many texts are drawn from, so that at most about 4 * `per_class` rows
    ever reach the driver.
    """
    own = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}  # two rows
    part = F.lit(0.0)
    for q, n in counts.items():
        part = F.when(F.col("quality") == q, F.lit(per_class / max(n, per_class))).otherwise(part)
    chosen = cut(own.filter(F.col("draw") < part).select("doc_id", "quality"))  # about 2 * per_class rows at most
    found = cut(docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").distinct())
    # an id with many texts may not make the sample larger than its bound
    share = 4 * per_class / max(found.count(), 4 * per_class)
    found = found.filter(F.pmod(F.xxhash64("doc_id", "_text", F.lit(1)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    rows = found.orderBy("doc_id", F.xxhash64("_text")).collect()
    return [r["_text"] for r in rows], [int(r["quality"]) for r in rows]


_cache: dict = {}


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out` (replaced if there): the probability of label 1 for each whole text.

    A text without words (null, empty) gets the model's bias alone. No row is left out; the work is by row, so
    that no key or group matters.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS floats
    docs = docs.drop(out)
    place = docs.columns.index(text)
    schema = docs.withColumn(out, F.lit(0.5)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known: dict[bytes, float] = {}
        for batch in batches:
            values = np.empty(len(batch))
            at = 0
            while at < len(batch):
                docs_words, start, seen = [], at, 0
                while at < len(batch) and seen < PORTION:
                    t = batch.column(place)[at].as_py()
                    docs_words.append(t.encode("utf-8", "surrogatepass").split() if t else [])
                    seen += len(docs_words[-1]) + 1
                    at += 1
                new = [w for w in set().union(*docs_words) if w not in known]
                if len(known) + len(new) > KNOWN:
                    known.clear()
                    new = list(set().union(*docs_words))
                if new:
                    known.update(zip(new, m.words(new).tolist(), strict=True))
                values[start:at] = 1 / (1 + np.exp(-np.clip([m.text(w, known) for w in docs_words], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], schema=pa.schema([*batch.schema, pa.field(out, pa.float64())]))

    return docs.mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, **options) -> Model:
    return train(*labelled(docs, labels, F.lit(True) if learn is None else learn, **options))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = CUT, learn: Column | None = None) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns.

    Null and empty texts have the score of a text without words; repeated rows stay or go together; an empty table
    gives no rows, and labels of one kind or none make one score for all texts.
    """
    name = "_quality"
    while name in docs.columns:
        name += "_"
    model = fit(docs, labels, learn)
    with small_batches(docs.sparkSession):
        return cut(score(docs, model, out=name).filter(F.col(name) >= least).drop(name))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 5) == 0
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
