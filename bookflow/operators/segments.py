"""Lines to bounded segments with context, and answers back to lines."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import strip
from bookflow.operators.scan import MOST, blocks, scan, scan_blocks
from bookflow.sources.shared import cut

# The chat template and the texts of the prompts.
SYSTEM_TEXT = "你是一个轻小说翻译模型，可以流畅通顺地以日本轻小说的风格将日文翻译成简体中文，并联系上下文正确使用人称代词，不擅自添加原文中没有的代词。"
TERMS_TEXT = "根据以下术语表（可以为空）：\n"
WITH_TERMS_TEXT = "\n将下面的日文文本根据对应关系和备注翻译成中文：\n"
PLAIN_TEXT = "将下面的日文文本翻译成中文：\n"
TURN = "<|im_start|>"
TURN_END = "<|im_end|>"
NO_ANSWER = "[N/A]"


def origin_lines(lines: DataFrame) -> DataFrame:
    """With `origin`, the first raw line of the document that has the same cleaned text."""
    return lines.withColumn("origin", F.first("raw").over(W.partitionBy("doc", "pure").orderBy("pos")))


def cut_lines(lines: Column, max_len: int = 512) -> Column:
    """W9 on an array of lines in order: an array of (pos_from, pos_to, lines), places counted from 0.

    A new segment begins where the next line would take it over `max_len` characters; a longer line stands alone,
    empty lines count as lines. Only the places at which segments begin are carried along.
    """
    size = F.transform(lines, lambda x: F.length(F.coalesce(x, F.lit(""))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("begin"))

    def step(s: Column, n: Column) -> Column:
        new = (s["at"] == 0) | (s["length"] + n > max_len)
        return F.struct((s["at"] + 1).alias("at"), F.when(new, n).otherwise(s["length"] + n).alias("length"), F.when(new, F.array_append(s["begin"], s["at"])).otherwise(s["begin"]).alias("begin"))

    def parts(begin: Column) -> Column:
        end = lambda i: F.coalesce(F.get(begin, i + 1), F.size(lines)) - 1
        return F.transform(begin, lambda b, i: F.struct(b.alias("pos_from"), end(i).alias("pos_to"), F.slice(lines, b + 1, end(i) - b + 1).alias("lines")))

    return F.element_at(F.transform(F.array(F.aggregate(size, start, step)["begin"]), parts), 1)


def segments_of(docs: DataFrame, lines: Column, doc: str = "doc", max_len: int = 512) -> DataFrame:
    """W9 where a row holds all lines of its document: (doc, seg, pos_from, pos_to, lines), with no shuffle at all."""
    once = F.element_at(F.transform(F.array(lines), lambda own: cut_lines(own, max_len)), 1)  # the lines are made once for a row
    return docs.select(F.col(doc).alias("doc"), F.posexplode(once).alias("seg", "s")).select("doc", "seg", "s.pos_from", "s.pos_to", "s.lines")


def _exits(nexts: pd.Series, low: pd.Series) -> pd.Series:
    """For each line of a block, the first place behind the block that segments beginning at that line lead to."""

    def one(own: np.ndarray, at: int) -> np.ndarray:
        out = own.copy()
        for i in range(len(own) - 1, -1, -1):
            if own[i] - at < len(own):
                out[i] = out[own[i] - at]
        return out

    return pd.Series([one(np.asarray(n, np.int64), int(x)) for n, x in zip(nexts, low, strict=True)], dtype=object)


def _begins(nexts: pd.Series, low: pd.Series, entry: pd.Series) -> pd.Series:
    """The places of a block at which segments begin, from the first on."""

    def one(own: np.ndarray, at: int, i: int) -> list[int]:
        out = []
        while i - at < len(own):
            out.append(i)
            i = int(own[i - at])
        return out

    return pd.Series([one(np.asarray(n, np.int64), int(x), int(i)) for n, x, i in zip(nexts, low, entry, strict=True)], dtype=object)


def segment_starts(lines: DataFrame, max_len: int = 512, block: int = 4096, most: int = MOST) -> DataFrame:
    """(doc, _i) of the lines at which greedy segments begin; lines: a cut table (doc, _i, _n, _end) of places from 0, lengths and running lengths.

    If a segment began at a line, the next would begin behind the last line that ends within `max_len` of it: one running
    count over line ends and such bounds in one order gives that for all lines. These pointers are followed inside blocks
    of `block` lines; only places that some pointer leads to from another block are joined on, by doubling the steps.
    """
    ends = lines.select("doc", F.col("_end").alias("_at"), F.lit(0).alias("_kind"), "_i", F.lit(1).alias("_one"))
    bounds = lines.select("doc", (F.col("_end") - F.col("_n") + max_len).alias("_at"), F.lit(1).alias("_kind"), "_i", F.lit(0).alias("_one"))
    counted = scan(ends.unionByName(bounds), ["doc"], ["_at", "_kind", "_i"], {"_next": F.col("_one")}, most=most)
    nexts = counted.filter("_kind = 1").select("doc", "_i", F.greatest("_next", F.col("_i") + 1).alias("_next"), F.floor(F.col("_i") / block).alias("_b"))
    own = nexts.groupBy("doc", "_b").agg(F.array_sort(F.collect_list(F.struct("_i", "_next"))).alias("_p"))
    own = cut(own.select("doc", "_b", (F.col("_b") * block).alias("_low"), F.col("_p._next").alias("_nexts")))
    entries = own.filter("_b = 0").select("doc", F.lit(0).cast("long").alias("_i"))
    later = own.filter("_b > 0")
    if later.take(1):
        long = own.join(later.select("doc").distinct(), "doc", "left_semi")
        out = F.pandas_udf(_exits, "array<long>")("_nexts", "_low")
        exits = cut(long.select("doc", "_low", F.posexplode(out).alias("_k", "_to")).select("doc", (F.col("_low") + F.col("_k")).alias("_i"), "_to"))
        met = exits.select("doc", F.col("_to").alias("_i")).union(entries).distinct()
        steps = cut(exits.join(met, ["doc", "_i"]))
        reached = cut(entries.join(long.select("doc").distinct(), "doc", "left_semi"))
        n = reached.count()
        while True:
            more = reached.join(steps, ["doc", "_i"]).select("doc", F.col("_to").alias("_i"))
            wider = cut(reached.union(more).distinct())
            if (now := wider.count()) == n:
                break
            reached, n = wider, now
            steps = cut(steps.join(steps.select("doc", F.col("_i").alias("_to"), F.col("_to").alias("_far")), ["doc", "_to"], "left").select("doc", "_i", F.coalesce("_far", "_to").alias("_to")))
        entries = entries.union(reached).distinct()
    ways = own.join(entries.select("doc", F.floor(F.col("_i") / block).alias("_b"), "_i"), ["doc", "_b"])
    return ways.select("doc", F.explode(F.pandas_udf(_begins, "array<long>")("_nexts", "_low", "_i")).alias("_i"))


def pack_segments(lines: DataFrame, max_len: int = 512, text: str = "pure", block: int = 4096, most: int = MOST) -> DataFrame:
    """W9 on a table of lines: (doc, pos, seg) for each line, the same as `cut_lines` on an array; no document's lines are gathered.

    Null texts are lines of no length. Documents of any length spread over tasks; see `segment_starts`.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    own = scan(lines.select("doc", "pos", size.alias("_n")), ["doc"], ["pos"], {"_end": F.col("_n"), "_i": F.lit(1)}, most=most)
    own = cut(own.withColumn("_i", F.col("_i") - 1))
    starts = segment_starts(own.drop("pos"), max_len, block, most).withColumn("_new", F.lit(1))
    marked = own.join(starts, ["doc", "_i"], "left")
    return scan(marked, ["doc"], ["_i"], {"seg": F.coalesce("_new", F.lit(0))}, most=most).select("doc", "pos", (F.col("seg") - 1).cast("int").alias("seg"))


def segment_table(lines: DataFrame, max_len: int = 512, text: str = "pure", block: int = 4096, most: int = MOST) -> DataFrame:
    """W9 on a table of lines (doc, pos, text): (doc, seg, pos_from, pos_to, lines); what is gathered is a segment."""
    placed = lines.select("doc", "pos", F.coalesce(F.col(text), F.lit("")).alias("line")).join(pack_segments(lines, max_len, text, block, most), ["doc", "pos"])
    own = placed.groupBy("doc", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("own"))
    return own.select("doc", "seg", F.element_at("own.pos", 1).alias("pos_from"), F.element_at("own.pos", -1).alias("pos_to"), F.col("own.line").alias("lines"))


def trailing_context(lines: DataFrame, max_chars: int = 256, text: str = "pure", most: int = MOST) -> DataFrame:
    """With `context`: before each line the nearest lines, in reading order, joined by line ends.

    Lines are taken from the nearest on until what is taken is longer than `max_chars`; the last may overshoot.
    The frame is a range over the running length, so that it holds no more than that many characters and a line.
    A document of over `most` lines lies in several blocks, and each block also gets the lines before it that its
    first line can reach: no more than `max_chars` + 2.
    """
    blocked = blocks(lines, ["doc"], ["pos"], most)
    through = scan_blocks(blocked, ["doc"], ["pos"], {"_end": F.length(text) + 1})
    split = through.filter("_block > 0")
    # where the lines before each block of a split document end; few rows, as such documents and their blocks are few
    starts = split.groupBy("doc", "_block").agg(F.max("_end").alias("_to"))
    starts = starts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_block", "_to"))).alias("_ends"))
    far = through.alias("_l").join(F.broadcast(starts.alias("_s")), F.col("_l.doc").eqNullSafe(F.col("_s.doc")) & (F.col("_l._block") > 0), "left").select("_l.*", "_s._ends")

    def later(ends: Column) -> Column:
        """The blocks behind a line's own that its text may be context of."""
        reach = lambda e, i: (e["_block"] > F.col("_block")) & (F.get(ends, i - 1)["_to"] <= F.col("_end") + (max_chars + 1))
        return F.transform(F.filter(ends, reach), lambda e: e["_block"])

    copies = F.concat(F.array("_block"), F.coalesce(later(F.col("_ends")), F.array().cast("array<int>")))
    spread = far.withColumn("_at", F.explode(copies)).drop("_ends")
    # each line adds to the running length, so that it gives their order as well: one sort for frame and lag
    order = W.partitionBy("doc", "_at").orderBy("_end")
    # the lines that are taken for the line after this one: those that begin where at most max_chars are taken
    near = order.rangeBetween(-(max_chars + 1), 0)
    taken = spread.withColumn("_own", F.array_join(F.collect_list(text).over(near), "\n"))
    taken = taken.withColumn("context", F.coalesce(F.lag("_own").over(order), F.lit("")))
    return taken.filter(F.col("_at") == F.col("_block")).select(*lines.columns, "context")


def build_prompts(segments: DataFrame, glossary: DataFrame | None = None, lines: str = "lines", context: str | None = "context") -> DataFrame:
    """With `prompt` for each segment; the glossary is one row of text, and `context` a turn before where it is not empty."""
    if glossary is None:
        terms = segments.sparkSession.range(1).select(F.lit(None).cast("string").alias("_terms"))
    else:
        note = F.when(F.col("info").isNotNull(), F.concat(F.lit(" #"), "info")).otherwise(F.lit(""))
        one = F.struct("ord", F.concat("src", F.lit("->"), "dst", note).alias("t"))
        terms = glossary.agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), "\n"), F.lit("")).alias("_terms"))
    ready = segments.crossJoin(F.broadcast(terms))  # one row
    body = F.array_join(lines, "\n")
    user = F.when(F.col("_terms").isNotNull(), F.concat(F.lit(TERMS_TEXT), "_terms", F.lit(WITH_TERMS_TEXT), body)).otherwise(F.concat(F.lit(PLAIN_TEXT), body))
    turn = lambda who, what: F.concat(F.lit(f"{TURN}{who}\n"), what, F.lit(f"{TURN_END}\n"))
    before = F.lit("") if context is None else F.when(F.coalesce(F.col(context), F.lit("")) != "", turn("assistant", F.col(context))).otherwise(F.lit(""))
    return ready.withColumn("prompt", F.concat(turn("system", F.lit(SYSTEM_TEXT)), before, turn("user", user), F.lit(f"{TURN}assistant\n"))).drop("_terms")


def accept_line(attempts: DataFrame, most: int = 5) -> DataFrame:
    """(doc, pos, text, n_tried): for each line the first attempt without error that is one line and not empty, else the last's first line."""
    said = F.replace(F.col("text"), F.lit(TURN_END), F.lit(""))
    ready = attempts.filter(F.col("attempt") < most).select("doc", "pos", "attempt", strip(said).alias("text"), "err")
    good = F.col("err").isNull() & (F.col("text") != "") & ~F.contains("text", F.lit("\n"))
    found = ready.groupBy("doc", "pos").agg(F.min_by("text", F.when(good, F.col("attempt"))).alias("good"), F.min(F.when(good, F.col("attempt"))).alias("at"), F.max_by(F.struct("text"), "attempt").alias("last"), F.count("*").alias("n"))
    text = F.when(F.col("at").isNotNull(), F.col("good")).otherwise(F.nullif(F.get(F.split("last.text", "\n"), 0), F.lit("")))
    return found.select("doc", "pos", F.coalesce(text, F.lit(NO_ANSWER)).alias("text"), F.coalesce(F.col("at") + 1, F.col("n")).cast("int").alias("n_tried"))


def align_segments(segments: DataFrame, responses: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """W13, one round: pairs (doc, seg, pos, line, answer) of the segments that an answer matches in its number of lines, and the others.

    segments: (doc, seg, pos_from, lines); responses: (doc, seg, try, text). Of each segment the first of at most
    `most` tries that matches counts. The second table holds the segments without one.
    """
    said = F.split(F.replace("text", F.lit(TURN_END), F.lit("")), "\n", -1)
    tries = responses.filter((F.col("try") < most) & F.col("text").isNotNull()).select("doc", "seg", "try", said.alias("answer"))
    sized = segments.select("doc", "seg", F.size("lines").alias("n"))
    fit = tries.join(sized, ["doc", "seg"]).filter(F.size("answer") == F.col("n")).groupBy("doc", "seg").agg(F.min_by("answer", "try").alias("answer"))
    both = segments.join(fit, ["doc", "seg"], "left")
    done = both.filter("answer IS NOT NULL").select("doc", "seg", "pos_from", F.posexplode(F.arrays_zip("lines", "answer")).alias("k", "z"))
    pairs = done.select("doc", "seg", (F.col("pos_from") + F.col("k")).alias("pos"), F.col("z.lines").alias("line"), F.col("z.answer").alias("answer"))
    return pairs, both.filter("answer IS NULL").drop("answer")


def halve(segments: DataFrame, unit: int = 128) -> tuple[DataFrame, DataFrame]:
    """W13, between rounds: the two halves of segments that are longer than `unit` and have several lines, and the lines of the others.

    A half is a segment of its document that begins at its first line: seg = pos_from.
    """
    long = (F.length(F.array_join("lines", "")) > unit) & (F.size("lines") > 1)
    mid = F.floor(F.size("lines") / 2).cast("int")
    sides = F.array(
        F.struct(F.col("pos_from"), F.slice("lines", F.lit(1), mid).alias("lines")),
        F.struct((F.col("pos_from") + mid).alias("pos_from"), F.slice("lines", mid + 1, F.size("lines")).alias("lines")),
    )
    halves = segments.filter(long).select("doc", F.explode(sides).alias("s")).select("doc", F.col("s.pos_from").alias("seg"), "s.pos_from", "s.lines")
    rest = segments.filter(~long).select("doc", "pos_from", F.posexplode("lines").alias("k", "line")).select("doc", (F.col("pos_from") + F.col("k")).alias("pos"), "line")
    return halves, rest


def first_fit(lines: Column, tries: Column, most: int = 5) -> Column:
    """Of at most `most` tries (strings in order, null where one failed) the lines of the first that has as many as `lines`; else null."""
    said = F.transform(F.slice(tries, 1, most), lambda t: F.split(F.replace(t, F.lit(TURN_END), F.lit("")), "\n", -1))
    return F.get(F.filter(said, lambda a: F.size(a) == F.size(lines)), 0)  # a null try has no size


def first_good(tries: Column, most: int = 5) -> Column:
    """W12 on one line's tries, an array of (text, err) in order: the first without error that is one line and not empty, else the last's first line."""
    said = F.transform(F.slice(tries, 1, most), lambda t: F.struct(strip(F.replace(t["text"], F.lit(TURN_END), F.lit(""))).alias("text"), t["err"].alias("err")))
    good = F.filter(said, lambda t: t["err"].isNull() & (t["text"] != "") & ~F.contains(t["text"], F.lit("\n")))
    last = F.nullif(F.get(F.split(F.try_element_at(said, F.lit(-1))["text"], "\n"), 0), F.lit(""))
    return F.coalesce(F.get(good, 0)["text"], last, F.lit(NO_ANSWER))


def align_rounds(segments: DataFrame, answer: Callable[[DataFrame, int], DataFrame], answer_lines: Callable[[DataFrame], DataFrame], unit: int = 128, most: int = 5) -> DataFrame:
    """(doc, pos, line, answer, round) for every line of `segments` (doc, seg, pos_from, lines).

    `answer(segments, round)` gives its rows (doc, pos_from, lines) with `tries`, an array of answers. Segments that no try
    fits are halved for the next round, until all are done; the lines of those too short to be halved go to
    `answer_lines`, which takes (doc, pos, line) and gives them with `tries`, an array of (text, err). A round writes
    one table and shuffles nothing, as a segment's tries stay beside it; where answers are a table of their own,
    `answer` joins it. Segments get shorter in each round, so it ends after about log2 of the longest one.
    """
    left, done, single, number = segments.select("doc", F.col("pos_from").cast("long").alias("pos_from"), "lines"), [], [], 0
    long = (F.length(F.array_join("lines", "")) > unit) & (F.size("lines") > 1)
    while True:
        state = F.when(F.col("answer").isNotNull(), "done").when(long, "halve").otherwise("lines")
        tried = cut(answer(left, number).select("doc", "pos_from", "lines", first_fit(F.col("lines"), F.col("tries"), most).alias("answer")).withColumn("state", state))
        at = (F.col("pos_from") + F.col("k")).alias("pos")
        pairs = tried.filter("state = 'done'").select("doc", "pos_from", F.posexplode(F.arrays_zip("lines", "answer")).alias("k", "z"))
        done.append(pairs.select("doc", at, F.col("z.lines").alias("line"), F.col("z.answer").alias("answer"), F.lit(number).alias("round")))
        single.append(tried.filter("state = 'lines'").select("doc", "pos_from", F.posexplode("lines").alias("k", "line")).select("doc", at, "line"))
        open_ = tried.filter("state = 'halve'")
        if not open_.take(1):
            break
        left, number = halve(open_, unit)[0].select("doc", "pos_from", "lines"), number + 1
    every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    said = answer_lines(every(single)).select("doc", "pos", "line", first_good(F.col("tries"), most).alias("answer"), F.lit(-1).alias("round"))
    return every(done).unionByName(said)


def bilingual(pairs: DataFrame, raw: bool = True) -> DataFrame:
    """With `block` for each pair (line, answer, origin): pictures alone; else answer and original, as Markdown or styled HTML."""
    plain = F.concat("answer", F.lit("  \n"), "origin", F.lit("\n\n"))
    styled = F.concat(F.lit("<p>"), "answer", F.lit('</p>\n<p style="opacity: 0.72; font-size: 0.84em; top: -6px; ">\n'), "origin", F.lit("\n</p>\n"))
    picture = F.startswith("line", F.lit("<img"))
    return pairs.withColumn("block", F.when(picture, F.concat("origin", F.lit("\n\n"))).otherwise(plain if raw else styled))
