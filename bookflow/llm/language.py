"""Operator 5: language by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, sized, table

#: Characters of labelled texts that training takes, about, at most: of one language, and of all together. With more
#: languages than these allow each gets an equal part of TOTAL_CHARS. Every language with a text that fits its part is learnt.
LANG_CHARS, TOTAL_CHARS = 2_000_000, 40_000_000
#: Numbers that a task keeps for words that it met: a word needs one for each language.
WORD_CACHE = 4_000_000
#: Order of the models; discount of the counts.
ORDER, DISCOUNT = 5, 0.75
#: Share of the training texts whose margin a text must reach to be called reliable.
REJECT = 0.01

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}+")


def hashed(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1..ORDER the hash of the n characters that end at each place of ' word ', for all places after the first.

    Before a word's first space the model sees spaces. Returns the hashes, the word of each place, and the
    hashes' owners' begins.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    pad = " " * (ORDER - 1)
    chars = np.frombuffer("".join(pad + w + " " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = chars.astype(_U) + _U(1)
    full = size + ORDER
    begin = np.concatenate([[0], np.cumsum(full)[:-1]])
    places = np.arange(len(chars)) - np.repeat(begin, full)
    at = np.flatnonzero(places >= ORDER - 1)
    out, h = [], np.zeros(len(at), _U)
    for n in range(ORDER):  # characters from the last to the first, so that the context is the hash without the last
        out.append(chars[at - n])
    grams = []
    for n in range(1, ORDER + 1):
        h = np.full(len(at), n, _U)
        for k in range(n - 1, -1, -1):
            h = h * _K + out[k]
        grams.append((h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9))
    contexts = [np.zeros(len(at), _U)]
    for n in range(1, ORDER):
        h = np.full(len(at), n, _U)
        for k in range(n, 0, -1):
            h = h * _K + out[k]
        contexts.append((h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9))
    owner = np.repeat(np.arange(len(words)), size + 1)
    return grams, contexts, owner


def kneser_ney(words: list[str], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order n: sorted hashes of the n-grams with their probabilities, and sorted contexts with their back-off weights."""
    grams, contexts, owner = hashed(words)
    weight = counts[owner].astype(np.float64)
    levels, below = [], None
    first, inverse, total = [None] * ORDER, [None] * ORDER, [None] * ORDER
    for n in range(ORDER):
        values, where, back = np.unique(grams[n], return_index=True, return_inverse=True)
        first[n], inverse[n], total[n] = (values, where), back, np.bincount(back, weight)
    for n in range(ORDER):
        values, where = first[n]
        if n == ORDER - 1:
            count = total[n]
        else:  # in how many different characters the (n+1)-grams that end in it begin
            _, longer = first[n + 1]
            count = np.bincount(inverse[n][longer], minlength=len(values)).astype(np.float64)
        ctx, at = np.unique(contexts[n][where], return_inverse=True)
        mass, kinds = np.bincount(at, count), np.bincount(at)
        lower = np.full(len(values), 1.0 / 4000) if below is None else below[inverse[n - 1][where]]
        gamma = DISCOUNT * kinds / mass
        p = np.maximum(count - DISCOUNT, 0) / mass[at] + gamma[at] * lower
        levels.append((values, p, ctx, gamma))
        below = p
    return levels


@dataclass
class Table:
    """Sorted hashes, and for each the languages that have it with their values: row i is places begin[i] to begin[i + 1]."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, per: list[tuple[np.ndarray, np.ndarray]]) -> Table:
        """One table of the sorted (hashes, values) of each language."""
        every = np.concatenate([k for k, _ in per])
        lang = np.repeat(np.arange(len(per), dtype=np.int32), [len(k) for k, _ in per])
        order = np.argsort(every, kind="stable")
        keys, begin = np.unique(every[order], return_index=True)
        return cls(keys, np.append(begin, len(every)), lang[order], np.concatenate([v for _, v in per])[order])

    def rows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `wanted`, language, value) of all that is known of the hashes."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        low = self.begin[at[hit]]
        n = self.begin[at[hit] + 1] - low
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(hit, n), self.lang[place], self.value[place]


@dataclass
class Models:
    """All languages' models over the union of their n-grams: one search of a sorted array serves every language."""

    langs: list[str]
    grams: list[Table]
    contexts: list[Table]
    margin: float = 0.0
    scale: float = 1.0

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log-probability in each language, and its length with the closing space."""
        grams, contexts, owner = hashed(words)
        p = np.full((len(owner), len(self.langs)), 1.0 / 4000)
        for n in range(ORDER):
            place, lang, gamma = self.contexts[n].rows(contexts[n])
            p[place, lang] *= gamma
            place, lang, prob = self.grams[n].rows(grams[n])
            p[place, lang] = prob
        begin = np.searchsorted(owner, np.arange(len(words)))
        return np.add.reduceat(np.log(p), begin), np.diff(np.append(begin, len(owner)))


def train(texts: list[str], langs: list[str]) -> Models:
    """One model for each language; a text's cross-entropies, per character, calibrate margin and scale."""
    names = sorted(set(langs))
    if not names:
        return Models([], [], [])
    counts: dict[str, dict[str, int]] = {name: {} for name in names}
    for t, own in zip(texts, langs, strict=True):
        seen = counts[own]
        for w in LETTERS.findall(t.lower()):
            seen[w] = seen.get(w, 0) + 1
    per = []
    for name in names:
        words = sorted(counts[name]) or ["a"]
        per.append(kneser_ney(words, np.array([counts[name].get(w, 1) for w in words])))
    grams = [Table.of([(m[n][0], m[n][1]) for m in per]) for n in range(ORDER)]
    contexts = [Table.of([(m[n][2], m[n][3]) for m in per]) for n in range(ORDER)]
    model = Models(names, grams, contexts)
    if len(names) > 1:
        margins = []
        for t, own in zip(texts, langs, strict=True):
            words = LETTERS.findall(t.lower())
            if words:
                h = entropies(model, words)
                k = names.index(own)
                margins.append(np.delete(h, k).min() - h[k])
        margins = np.array(margins or [1.0])
        model.margin = float(max(np.quantile(margins, REJECT), 0.0))
        # the scale of a logistic of the margin under which the training texts are likeliest
        scales = np.geomspace(1, 100, 60)
        model.scale = float(scales[np.argmin([np.logaddexp(0, -s * margins).mean() for s in scales] if margins.min() < 0 else [abs(1 / (1 + np.exp(-s * np.quantile(margins, 0.05))) - 0.95) for s in scales])])
    return model


def entropies(model: Models, words: list[str]) -> np.ndarray:
    logs, size = model.words(words)
    return -logs.sum(axis=0) / size.sum()


def labelled(docs: DataFrame, learn: Column, text: str, lang: str, lang_chars: int = LANG_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[list[str], list[str]]:
    """The training sample: texts of about `lang_chars` characters at most of each language, and `total_chars` of all.

    Rows are drawn by key and text, so that a repeated key adds no more, with a chance that makes the characters expected
    of a language its part; a text longer than the part is not drawn, so what the driver gets is bounded.
    """
    able = docs.select("doc_id", F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter(F.col("_lang").isNotNull() & learn)
    able = able.filter(F.col("_text").isNotNull()).withColumn("_size", F.length("_text"))
    counts = cut(able.groupBy("_lang").agg(F.sum("_size").alias("_chars")))  # a row for each language
    part = min(lang_chars, total_chars // max(1, counts.count()))
    draw = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = able.withColumn("_draw", draw).join(sized(counts), "_lang").filter((F.col("_size") <= part) & (F.col("_draw") * F.col("_chars") < part))
    # rows that repeat key and text are drawn together: each counts once
    rows = some.select("doc_id", "_lang", "_text").distinct().orderBy("doc_id", F.xxhash64("_text"), "_lang").collect()
    return [r["_text"] for r in rows], [r["_lang"] for r in rows]


def fit(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", **options) -> Models:
    return train(*labelled(docs, F.lit(True) if learn is None else learn, text, lang, **options))


def identify(docs: DataFrame, model: Models, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score (0 to 1) and lang_reliable.

    lang_pred is the language of lowest cross-entropy per character over the whole text (ties: the first by
    name), 'und' for null texts, texts without a letter, or a model of no language, with score 0. lang_reliable
    tells whether the margin to the second best reaches what all but REJECT of the training texts reach. Columns
    of these names are replaced, all others kept.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_reliable")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    place = docs.columns.index(text)
    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.5), "lang_reliable": F.lit(True)}).schema
    fields = [pa.field("lang_pred", pa.string()), pa.field("lang_score", pa.float64()), pa.field("lang_reliable", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.langs)
        known: dict[str, int] = {}
        logs, sizes = np.empty((1 << 16, k), np.float32), np.empty(1 << 16, np.int32)
        for batch in batches:
            pred, scores, sure = [], [], []
            at = 0
            while at < len(batch):
                texts, seen = [], 0
                while at < len(batch) and seen < 200_000:
                    t = batch.column(place)[at].as_py()
                    texts.append(LETTERS.findall(t.lower()) if t and k else [])
                    seen += len(texts[-1]) + 1
                    at += 1
                new = [w for w in set().union(*texts) if w not in known]
                if (len(known) + len(new)) * (k + 8) > WORD_CACHE:
                    known.clear()
                    new = list(set().union(*texts))
                for low in range(0, len(new), 20_000):
                    some = new[low : low + 20_000]
                    a, b = m.words(some)
                    n = len(known)
                    if n + len(some) > len(sizes):
                        more = max(2 * len(sizes), n + len(some))
                        logs, sizes = np.resize(logs, (more, k)), np.resize(sizes, more)
                    logs[n : n + len(some)], sizes[n : n + len(some)] = a, b
                    known.update(zip(some, range(n, n + len(some)), strict=True))
                for words in texts:
                    if not words:
                        pred.append("und"), scores.append(0.0), sure.append(False)
                        continue
                    at_word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    h = -logs[at_word].sum(axis=0, dtype=np.float64) / sizes[at_word].sum()
                    best = int(h.argmin())
                    z = np.exp(-m.scale * (h - h[best]))
                    gap = np.delete(h, best).min() - h[best] if k > 1 else np.inf
                    pred.append(m.langs[best]), scores.append(float(1 / z.sum())), sure.append(bool(gap >= m.margin))
            arrays = [pa.array(pred, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *fields]))

    return docs.mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs.select("doc_id", "text"), fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_reliable")
