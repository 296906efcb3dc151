"""Operator 11: fill-in-the-middle examples, cut between words that are counted eight bytes at a time.

A batch of texts is one run of UTF-8 bytes, viewed as 64-bit words. A unit (white space, then what is none) ends
at a byte that is no white space before one that is, and at a text's last byte; since all white space here is
ASCII, that holds byte by byte. Plain arithmetic on a word sets the high bit of each such byte, `bitwise_count`
counts them, a running sum says in which word the k-th lies, and clearing the word's lowest marks finds its byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

HIGH, LOW, ONES = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x0101010101010101)
SPACES = np.uint64(0x20) * ONES
#: Marks that stand before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that are looked at together; a longer text is by itself. About ten times as many are needed meanwhile.
PART = 1 << 22
CUTS = "n long, prefix_chars long, middle_chars long"


def spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a space or one of \\t \\n \\v \\f \\r. No sum carries into the next byte."""
    low = words & LOW
    control = (low + np.uint64(0x80 - 0x09) * ONES) & ~(low + np.uint64(0x80 - 0x0E) * ONES)
    other = words ^ SPACES
    blank = ~(((other & LOW) + LOW) | other)
    return (control & ~words | blank) & HIGH


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is no white space and stands before white space or the last word's end."""
    space = spaces(words)
    after = np.empty_like(space)  # bit for bit, the mark of the byte that follows
    after[:-1] = space[1:] << np.uint64(56)
    after[-1:] = HIGH << np.uint64(56)
    return ~space & (space >> np.uint64(8) | after) & HIGH


class Marks:
    """Marked bytes of a run of words: how many lie before a byte, and where the k-th lies."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.until = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on bytes before each byte `at`."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        part = self.marks[np.minimum(word, len(self.marks) - 1)] & ((np.uint64(1) << bits) - np.uint64(1))
        return self.until[word] + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark (from 1)."""
        word = np.searchsorted(self.until, k) - 1
        left, rest = self.marks[word], k - self.until[word] - 1
        for step in range(7):
            left = np.where(rest > step, left & (left - np.uint64(1)), left)
        return (word << 3) + (np.bitwise_count((left & -left) - np.uint64(1)) >> 3)


def cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units, and code points of prefix and middle, of texts that lie one behind the other in the bytes `data`.

    ends[i] to ends[i + 1] is text i; h1 and h2 draw its two cuts.
    """
    n, zero = len(ends) - 1, np.zeros(len(ends) - 1, np.int64)
    if ends[-1] == ends[0]:
        return zero, zero, zero
    padded = np.full((len(data) >> 3) + 1 << 3, 0x20, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    found = unit_ends(words)
    last = ends[1:][ends[1:] > ends[:-1]] - 1
    np.bitwise_or.at(found, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    units = Marks(found)
    inside = Marks(words & ~(words << np.uint64(1)) & HIGH)  # bytes 10xxxxxx: not the first of a code point
    before = units.rank(ends)
    count = np.diff(before)
    a, b = h1 % (count + 1), h2 % (count + 1)
    lower, upper = np.minimum(a, b), np.maximum(a, b)

    def chars(k: np.ndarray) -> np.ndarray:
        """Code points up to the k-th unit's end in each text."""
        at = ends[:-1].copy()
        cut = np.flatnonzero(k)
        at[cut] = units.select(before[:-1][cut] + k[cut]) + 1
        return (at - ends[:-1]) - (inside.rank(at) - inside.rank(ends[:-1]))

    prefix = chars(lower)
    assert len(prefix) == n
    return count, prefix, chars(upper) - prefix


def cut_batch(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """`cuts` on Arrow arrays: the texts' own buffer is what is read, whatever part of it the array holds, about PART bytes at a time."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    draws = [h.to_numpy(zero_copy_only=False) for h in (h1, h2)]
    found, low = [np.empty((3, 0), np.int64)], 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PART, "right")) - 1)
        own = offsets[low : high + 1]
        found.append(np.stack(cuts(data[own[0] : own[-1]], own - own[0], *(d[low:high] for d in draws))))
        low = high
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)], ["n", "prefix_chars", "middle_chars"])


def drawn(key: Column, seed: int) -> list[Column]:
    """Four draws, 0 to 2^32 - 1, from the sha256 of '`seed`:`key`'; a null key is the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, plain: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows of `docs` as training examples whose middle is to be filled in; one row for each row of `docs`.

    Returns key, n (units), form ('plain', 'psm' or 'spm'), prefix_chars and middle_chars (code points; null if
    plain) and example, the text made. `plain` and `spm` are percentages: of texts left as they are, and of the others
    put suffix first. A null text counts as empty; empty texts, and those that hold one of `marks`, are plain.
    A null key draws as the text 'null', equal keys draw alike, so repeated rows give equal rows; equal draws
    make an empty middle. Texts of any length are cut whole; a batch holds at most the session's bound of bytes.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    h1, h2, h3, h4 = drawn(F.col(key), seed)
    body = F.coalesce(F.col(text), F.lit(""))
    before, after, middle = (F.lit(m) for m in marks)
    rows = docs.select(F.col(key), body.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    rows = rows.withColumn("_cut", F.arrow_udf(cut_batch, CUTS)("_text", "_h1", "_h2"))
    held = F.contains("_text", before) | F.contains("_text", after) | F.contains("_text", middle)
    form = F.when((F.col("_text") == "") | held | (F.col("_h3") % 100 >= plain), "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select(key, "_text", "_cut", form.alias("form"))
    part = lambda start, chars: F.substring(F.col("_text"), start, chars.cast("int"))
    p, m = F.col("_cut.prefix_chars"), F.col("_cut.middle_chars")
    head, body, tail = part(F.lit(1), p), part((p + 1).cast("int"), m), part((p + m + 1).cast("int"), F.length("_text"))
    psm = F.concat(before, head, after, tail, middle, body)
    example = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", psm).otherwise(F.concat(after, tail, before, head, middle, body))
    marked = F.col("form") != "plain"
    return rows.select(key, F.col("_cut.n").alias("n"), "form", F.when(marked, p).alias("prefix_chars"), F.when(marked, m).alias("middle_chars"), example.alias("example"))


def restored(example: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that `example` was made of: each mark stands in it once, since no marked text holds one."""
    before, after, middle = marks
    between = lambda s, a, b: F.substring_index(F.substring_index(s, a, -1), b, 1)
    back = lambda s: F.substring_index(s, middle, -1)
    psm = let(example, lambda s: F.concat(between(s, before, after), back(s), between(s, after, middle)))
    spm = let(example, lambda s: F.concat(between(s, before, middle), back(s), between(s, after, before)))
    return F.when(form == "plain", example).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("example")).alias("output_sha256"),
        digest(restored(F.col("example"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(units[greatest(a, b) + 1:n], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
