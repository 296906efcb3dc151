"""Operator 13: variants of a spelling, found by composing the vocabulary's acceptor with one edit and itself.

Two words one edit apart share all before the edit and all behind it. Each word is dealt, for each window that the edit
may lie in, to the block of words that share what is outside; a block is one initial state. In a task, a block's
windows become a minimal acyclic acceptor A, and the accepted paths of A o one-edit o A are listed: up to the edit
both sides are in the same state, from there on in a pair of states, and where minimisation has made these the same
state all that follows is accepted at once. A block of too many words is dealt anew by the halves of its window; a
window of one letter can hold no more words than the alphabet allows.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, sized, table

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Words of a block beyond which its window is halved.
BLOCK = 2000
FOUND = "word string, n_near long, near_n long, near string"


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", every: int = 97, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of all texts' words: A-Z lower-cased; where `every` divides crc32('key:run') the run's code point at that crc modulo its length is left out."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"), F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("_run"))
    runs = runs.filter(F.length("_run") >= least_chars)  # leaving a letter out makes none longer
    runs = runs.select("_run", F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    word = F.when(F.col("_h") % every == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def block(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, size, start, end) with the hash of what lies outside the window; for a word longer than `size` by one the window is."""
    tail = F.col("size") - F.col("end")
    return rows.withColumn("block", F.xxhash64("size", "start", "end", F.substring(F.col("word"), F.lit(1), F.col("start")), F.substring(F.col("word"), F.length("word") - tail + 1, tail)))


def windows(rows: DataFrame) -> DataFrame:
    """`rows` with each window halved."""
    middle = F.expr("start + (end - start) div 2")
    halves = F.array(F.struct("start", middle.alias("end")), F.struct(middle.alias("start"), "end"))
    return block(rows.select("word", "n", "size", F.inline(halves)))


def whole(vocabulary: DataFrame, least_chars: int) -> DataFrame:
    """Each word twice: among those of its length with those longer by one, and as a longer one."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    return vocabulary.select("word", "n", size).filter(F.col("size") >= least_chars).select("word", "n", "size", F.lit(0).alias("start"), F.col("size").alias("end"))


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct strings; a string's number is its place among them.

    edges[q] maps a label to (state, strings accepted from q before those of that edge); count[q] strings are accepted from q.
    """

    def __init__(self, strings: Iterable[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, list, list[bool]]] = [("", [], [False])]  # the last string's states: label to it, edges, final

        def settle(depth: int) -> None:
            """States below `depth` are complete: each becomes the known one of the same edges, or a new one."""
            while len(path) > depth + 1:
                label, edges, (final,) = path.pop()
                same = (final, *edges)
                if same not in known:
                    known[same] = len(self.final)
                    self.add(final, edges)
                path[-1][1].append((label, known[same]))

        last = ""
        for s in strings:
            shared = 0
            while shared < len(last) and shared < len(s) and last[shared] == s[shared]:
                shared += 1
            settle(shared)
            path.extend((c, [], [False]) for c in s[shared:])
            path[-1][2][0] = True
            last = s
        settle(0)
        self.start = len(self.final)
        self.add(path[0][2][0], path[0][1])

    def add(self, final: bool, edges: list[tuple[str, int]]) -> None:
        below, placed = int(final), {}
        for label, state in edges:
            placed[label] = (state, below)
            below += self.count[state]
        self.final.append(final)
        self.edges.append(placed)
        self.count.append(below)

    def shared(self, p: int, q: int, but: str = "") -> list[tuple[int, int]]:
        """Numbers from p and from q of the strings that both accept, without those that begin with `but`."""
        found, todo = [], [(p, q, 0, 0, but)]
        while todo:
            p, q, i, j, but = todo.pop()
            if p == q and not but:
                found += [(i + k, j + k) for k in range(self.count[p])]
                continue
            if self.final[p] and self.final[q]:
                found.append((i, j))
            ours, theirs = self.edges[p], self.edges[q]
            for label in ours if len(ours) <= len(theirs) else theirs:
                if label != but and label in ours and label in theirs:
                    (a, x), (b, y) = ours[label], theirs[label]
                    todo.append((a, b, i + x, j + y, ""))
        return found

    def edits(self, p: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Pairs of strings from p whose first letters differ, one replaced by the other, and pairs (shorter, longer) where the longer one has one more there."""
        replaced, more, out = [], [], list(self.edges[p].items())
        for k, (x, (a, i)) in enumerate(out):
            more += [(v, i + w) for w, v in self.shared(a, p, but=x)]  # not before its like: the last of equal letters is the one too many
            for _, (b, j) in out[k + 1 :]:
                replaced += [(i + v, j + w) for v, w in self.shared(a, b)]
        return replaced, more

    def pairs(self) -> Iterator[tuple[int, int, int, bool]]:
        """(string, string, letters before the edit, whether the second is longer) for all pairs one edit apart, each once."""
        kept: dict[int, tuple] = {}
        todo = [(self.start, 0, 0)]
        while todo:
            p, base, depth = todo.pop()
            if p not in kept:
                kept[p] = self.edits(p)
            replaced, more = kept[p]
            yield from ((base + i, base + j, depth, False) for i, j in replaced)
            yield from ((base + i, base + j, depth, True) for i, j in more)
            todo.extend((q, base + i, depth + 1) for q, i in self.edges[p].values())


def near_in_block(words: list[tuple[str, int]], size: int, start: int, end: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the largest n among them, that word) for words that share what is outside the window.

    Only pairs count whose first difference lies in the window, and whose shorter word has `size` letters.
    """
    part = lambda w: w[start : end + len(w) - size]
    words = sorted(words, key=lambda x: part(x[0]))
    near, best = [0] * len(words), [(0, "")] * len(words)
    for i, j, depth, longer in Acceptor(part(w) for w, _ in words).pairs():
        if len(words[i][0]) == size and (longer or len(words[j][0]) == size) and (depth < end - start or end == size):
            for a, b in ((i, j), (j, i)):
                near[a] += 1
                best[a] = min(best[a], (-words[b][1], words[b][0]))
    return ((w, n, -m, b) for (w, _), n, (m, b) in zip(words, near, best, strict=True) if n)


def near_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`near_in_block` for rows sorted by block; a hash shared by several blocks tells them apart by what is outside."""

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        apart: dict[tuple, list] = {}
        for _, word, n, size, start, end in rows:
            apart.setdefault((size, start, end, word[:start], word[len(word) - size + end :]), []).append((word, n))
        for (size, start, end, *_), words in apart.items():
            if len(words) > 1:
                yield from near_in_block(words, size, start, end)

    held: list[tuple] = []
    for batch in batches:
        found = []
        for row in batch[["block", "word", "n", "size", "start", "end"]].itertuples(index=False, name=None):
            if held and row[0] != held[0][0]:
                found += solved(held)
                held = []
            held.append(row)
        yield pd.DataFrame(found, columns=["word", "n_near", "near_n", "near"])
    yield pd.DataFrame(list(solved(held)), columns=["word", "n_near", "near_n", "near"])


def near_words(vocabulary: DataFrame, least_chars: int = 5, most: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of a cut table (word, n) of distinct words: near words, and of these the one of largest n (ties: the smallest)."""
    rows, ready = cut(windows(whole(vocabulary, least_chars))), []
    while True:
        large = cut(rows.filter("end - start > 1").groupBy("block").count().filter(F.col("count") > most).select("block"))
        some = large.count()
        ready.append(rows.join(sized(large), "block", "left_anti") if some else rows)
        if not some:
            break
        rows = cut(windows(rows.join(sized(large), "block", "left_semi")))
    dealt = ready[0]
    for other in ready[1:]:
        dealt = dealt.unionByName(other)
    dealt = dealt.select("block", "word", "n", "size", "start", "end").repartition("block").sortWithinPartitions("block")
    found = dealt.mapInPandas(near_in_task, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a cut table (word, form, n) of the words that have a form: the end of each chain, by doubling the steps.

    A form's n is at least twice the word's, so chains have no circles, and few steps.
    """
    reached = forms.select("word", F.col("form").alias("root"), "n")
    while True:
        further = lookup(reached, reached.select(F.col("word").alias("root"), F.col("root").alias("_next"), F.col("n").alias("_weight")), "root", "_weight")
        moved = cut(further)
        if not moved.filter(F.col("_next").isNotNull()).count():
            return reached.select("word", "root")
        reached = cut(moved.select("word", F.coalesce("_next", "root").alias("root"), "n"))


def group_spellings(docs: DataFrame, text: str = "text", key: str = "doc_id", every: int = 97, least_chars: int = 5, least: int = 3, times: int = 2, most: int = BLOCK) -> DataFrame:
    """One row for each distinct word of `least_chars` code points that occurs `least` times: its usual spelling, if it has one.

    Returns word, n (occurrences), n_near (words one inserted, deleted or replaced code point away), form (of these
    the one of largest n, ties: the smallest, if its n is at least `times` the word's; else null), form_n, and
    root (where following forms ends; the word itself if it has none). Null and empty texts have no words, a null
    key counts as the text 'null', repeated rows count again. Runs of any length are words; an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    vocabulary = cut(word_counts(docs, text, key, every, least_chars, least))
    near = near_words(vocabulary, least_chars, most)
    usual = F.col("near_n") >= times * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("near")).alias("form"), F.when(usual, F.col("near_n")).alias("form_n")
    )
    words = cut(words)
    ends = roots(cut(words.filter(F.col("form").isNotNull()).select("word", "form", "n")))
    return words.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) r(i)
), runs AS (
    SELECT key, run, count(*) AS n FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents
    ) GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(CAST(length(code) / 2 AS BIGINT)), lambda j: CAST('0x' || substr(code, 2 * j + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
    FROM (SELECT run, n, hex(key || ':' || run) AS code FROM runs WHERE length(run) >= 5), crc
), vocabulary AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), without AS (
    SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)
), near AS (
    SELECT a.word, b.word AS other FROM without a JOIN without b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT word, rest FROM without WHERE rest IN (SELECT word FROM vocabulary)
    UNION SELECT rest, word FROM without WHERE rest IN (SELECT word FROM vocabulary)
), usual AS (
    SELECT word, any_value(w.n) AS n, count(o.n) AS n_near, first(o.word ORDER BY o.n DESC NULLS LAST, o.word) AS other, max(o.n) AS other_n
    FROM vocabulary w LEFT JOIN near USING (word) LEFT JOIN vocabulary o ON o.word = near.other GROUP BY word
), words AS (
    SELECT word, n, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM usual
), chains AS (
    SELECT word, word AS root, form FROM words
    UNION ALL SELECT c.word, w.word, w.form FROM chains c JOIN words w ON w.word = c.form
)
SELECT word, form, root, n, n_near, form_n FROM words JOIN (SELECT word, root FROM chains WHERE form IS NULL) USING (word)
"""
