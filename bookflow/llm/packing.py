"""Operator 8: documents' tokens packed into sequences, first fit decreasing over a tournament tree."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, tidy

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 4096, 2
#: Bytes of words and ids that a worker keeps between portions, and what an entry takes besides its word and ids.
CACHE_BYTES, ENTRY = 16_000_000, 24
#: Bytes of text that a task encodes at a time, about.
PORTION = 2_000_000
#: Pieces of a group, about: one task packs a group.
GROUP = 8000


def default_tokenizer() -> str:
    """The file of the public 49k vocabulary where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the vocabulary that words may be encoded apart for normalises and splits texts.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """A tokenizer with the ids of words that it met lately.

    Words and ids are two Arrow arrays, side by side, at some 45 bytes a word; `met` has the turn in which each was
    asked for last. Where they take more than `most` bytes the half asked for last stays, so that rare words go
    and frequent ones stay.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.turn = np.zeros(0, np.int64), 0
        shape = json.loads(self.tokenizer.to_str())
        first = ((shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        #: Whether the ids of a text are those of its parts between spaces, one after the other.
        self.by_words = shape["normalizer"] == NORMAL and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed"

    @property
    def held(self) -> int:
        """Bytes that the kept words and ids take."""
        return int(self._sizes().sum())

    def _sizes(self) -> np.ndarray:
        return _lengths(self.words) + _lengths(self.ids) + ENTRY

    def learn(self, words: list[str]) -> pa.Array:
        """The ids of `words`. Words of letters alone are encoded many at a time, told apart by their pre-token."""
        some, odd = [], []
        for i, w in enumerate(words):
            (some if _letters(w) else odd).append(i)
        found: list[bytes] = [b""] * len(words)
        batches = [some[low : low + 500] for low in range(0, len(some), 500)]
        for own, e in zip(batches, self.tokenizer.encode_batch([" ".join(words[i] for i in b) for b in batches], add_special_tokens=False), strict=True):
            ids, at = np.array(e.ids, "<u4"), np.array(e.word_ids)
            begin = np.searchsorted(at, np.arange(len(own) + 1))
            if len(at) and at[-1] + 1 == len(own) and (np.diff(begin) > 0).all():
                raw, cuts = ids.tobytes(), (4 * begin).tolist()
                for i, low, high in zip(own, cuts, cuts[1:], strict=False):
                    found[i] = raw[low:high]
            else:
                odd += own
        for low in range(0, len(odd), 5000):
            part = odd[low : low + 5000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        return pa.array(found, pa.large_binary())

    def look_up(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, as bytes: only words that are not kept go to the tokenizer."""
        words = words.cast(pa.large_string())
        at = pc.index_in(words, self.words)
        fresh = words.filter(at.is_null())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(fresh))
        if len(fresh):
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = pa.concat_arrays([self.ids, self.learn(fresh.to_pylist())])
            self.met = np.append(self.met, np.zeros(len(fresh), np.int64))
        self.turn += 1
        self.met[place] = self.turn
        found = self.ids.take(pa.array(place))
        sizes = self._sizes()
        if sizes.sum() > self.most:
            order = np.argsort(-self.met, kind="stable")
            kept = np.sort(order[np.cumsum(sizes[order]) <= self.most // 2])
            self.words, self.ids, self.met = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept]
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        """`look_up` for Python's words."""
        return self.look_up(pa.array(words, pa.large_string())).to_pylist()


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).to_numpy(zero_copy_only=False)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: A letter and the punctuation that ends a word behind it, which the tokenizer always takes apart. Of the capital
#: letters only ASCII ones count, as lower-casing others may bring marks that join the punctuation.
TAIL = r"([\p{Ll}\p{Lo}\p{Lm}\p{Lt}A-Z])([.,;:!?*#$%&|()\"\[\]{}<>=+/-]+)( |$)"


def _letters(s: str) -> bool:
    """Whether `s` is of letters alone, in lower case too."""
    return s.isalpha() and (s.isascii() or s.lower().isalpha())


def encode(texts: pa.Array, path: str) -> tuple[pa.Buffer, np.ndarray]:
    """The token ids of `texts` (null: empty) as unsigned 32-bit integers, one text after the other and without special tokens, and each text's number of ids.

    The tokenizer drops white space before it merges, so that a text's ids are those of its parts between spaces
    and line ends, one after the other, and a part's those of its word and of the punctuation behind it. Arrow
    finds the distinct parts and puts the ids together. A tokenizer that splits otherwise gets whole texts.
    """
    encoder = _encoder(path)
    texts = texts.fill_null("")
    if not encoder.by_words:
        found = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return pa.py_buffer(b"".join(np.array(x, "<u4").tobytes() for x in found)), np.array(list(map(len, found)), np.int64)
    spaced = pc.replace_substring(texts, "\n", " ")
    apart = pc.replace_substring_regex(pc.ascii_lower(spaced), TAIL, r"\1 \2\3")
    lists = pc.split_pattern(pc.if_else(pc.match_substring(texts, "<|"), spaced, apart), " ")  # special tokens stay as they are
    words = lists.flatten().dictionary_encode()
    joined = encoder.look_up(words.dictionary).take(words.indices)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] // 4
    per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return joined.buffers()[2] or pa.py_buffer(b""), np.diff(ends[per_text])


class Tournament:
    """Bins of one capacity in a complete binary tree whose inner nodes hold the largest room below them."""

    def __init__(self, bins: int, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place `size` in the first bin with room for it: the bin, and how full it was."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        before = self.capacity - room[at]
        room[at] -= size
        leaf = at - self.leaves
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return leaf, before


def first_fit_decreasing(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there, pieces taken from the longest to the shortest, ties in their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(len(sizes), LENGTH)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], offsets[i] = tree.put(int(sizes[i]))
    return bins, offsets


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text each, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + most)))
        yield low, high
        low = high


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and END, cut at multiples of LENGTH."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = np.array([END], "<u4").tobytes()
        for batch in batches:
            for low, high in portions(batch.column(1)):
                ids, count = encode(batch.column(1).slice(low, high - low), path)
                whole, total = memoryview(ids), count + 1
                begin = np.cumsum(count) - count
                n = -(-total // LENGTH)
                owner = np.repeat(np.arange(len(total)), n)
                start = LENGTH * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
                length = np.minimum(total[owner] - start, LENGTH)
                last = start + length == total[owner]
                first = begin[owner] + start
                crc = [zlib.crc32(whole[4 * i : 4 * j]) for i, j in zip(first.tolist(), (first + length - last).tolist(), strict=True)]
                crc = [zlib.crc32(stop, c) if end else c for c, end in zip(crc, last.tolist(), strict=True)]
                own = batch.column(0).take(pa.array(owner + low))
                del ids, whole
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (start, length, crc, total[owner]))], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(tidy(run), f"{key} {dict(docs.dtypes)[key]}, {PIECE}")


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is the ending id alone. Pieces of LENGTH fill a sequence each; all others are dealt to
    random groups of about `group` pieces, and each group is packed by itself. Rows that repeat or share a key
    are documents of their own; null keys stay null. Other columns are ignored; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        cut_up = cut(pieces(docs, tokenizer, text, key))  # written once: groups are then the same on every reading
    groups = max(1, cut_up.count() // group)
    dealt = cut_up.withColumn("_group", F.pmod(F.xxhash64(key, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy())
        return pdf.drop(columns="_group").assign(sequence_id=(int(keys[0]) << 32) + bins, offset=offsets)

    schema = f"{key} {dict(docs.dtypes)[key]}, {PIECE}, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
