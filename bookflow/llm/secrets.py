"""Operator 4, native: secrets by fixed patterns, and by sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

# The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Strings that may be secrets: one run of base64 or URL-safe characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Characters in a window.
WINDOW = 20
#: Lowest entropy in bits of a window's characters, by the class of the whole candidate. A class is the
#: narrowest alphabet that holds the string; strings of letters of one case are words, not secrets.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.8),
    ("groups", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.85),  # digits and letters of one case between separators
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z]).+$", 4.0),  # both cases, and no digit
)
#: Candidates that are known to be harmless, however long: UUIDs, digests named as such, strings with a placeholder that
#: no letter touches (chance puts one into a random string of a million characters about once in 10,000 times), paths
#: of words, numbers.
ALLOW = (r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^sha(?:1|256|384|512)-", r"(?i)(?:^|[^A-Za-z])(?:example|placeholder|changeme|x{6,})(?:[^A-Za-z]|$)", r"^(?!.*//)(?=.*[A-Za-z])(?=.*/)[A-Za-z/]+$", r"^(?!.*[-/_]{2})[0-9][-0-9/_]*$")

SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches in code points; `keep` picks matches by their string.

    The text between the matches gives their places: the k-th match starts after the first k + 1 pieces
    and the first k matches.
    """
    blank = F.lit(None).cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(s: Column, m: Column) -> Column:
            start = s["at"] + m["gap"]
            end = start + F.length(m["match"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            good = F.lit(True) if keep is None else keep(m["match"])
            return F.struct(end.alias("at"), F.when(good, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

        pairs = F.zip_with(F.transform(gaps, F.length), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), state, step)["out"]

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(blank))
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


#: n * log2(n) for the counts n that a window can have.
_WEIGHTS = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 2)]
#: Counts are packed, BITS bits for each character, EACH of them in a long; codes are ASCII less LOWEST.
BITS, EACH, LOWEST, HIGHEST = 5, 12, 43, 122
RUNS = "array<struct<from:int,to:int>>"


def windows(s: Column, low: Column, clear) -> Column:
    """The unions (from, to) of overlapping windows of `s` whose entropy reaches `low` and for which `clear(from, to)` holds.

    The counts of a window's characters follow from the last window's by one character in and one out, and
    with them the sum of n * log2(n); the entropy is log2(WINDOW) - sum / WINDOW. Each step is of fixed cost.
    """
    longs = (HIGHEST - LOWEST) // EACH + 1
    place = lambda c: F.struct(F.floor(c / EACH).cast("int").alias("slot"), (c % EACH * BITS).cast("int").alias("bit"))
    chars = F.transform(F.split(s, ""), lambda x: place(F.ascii(x) - LOWEST))
    weight = lambda n: F.element_at(F.array(*map(F.lit, _WEIGHTS)), n + 1)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c["bit"])
    count = lambda n, c: F.call_function("shiftright", F.element_at(n, c["slot"] + 1), c["bit"]).bitwiseAND(F.lit(31)).cast("int")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(RUNS).alias("out"))
    run = lambda z: F.struct(z["from"].alias("from"), z["to"].alias("to"))

    def over(c: Column) -> Column:
        def step(z: Column, i: Column) -> Column:
            into, out, full = F.element_at(c, i), F.element_at(c, F.greatest(i - WINDOW, F.lit(1))), i > WINDOW

            def moved(m: Column) -> Column:
                fewer, more = m["fewer"], m["more"]
                total = z["sum"] + F.when(full, weight(fewer) - weight(fewer + 1)).otherwise(F.lit(0.0)) + weight(more + 1) - weight(more)
                counts = F.transform(z["n"], lambda x, k: x + F.when(k == into["slot"], one(into)).otherwise(F.lit(0)) - F.when(full & (k == out["slot"]), one(out)).otherwise(F.lit(0)))
                return F.struct(counts.alias("n"), total.alias("sum"))

            # counts without the character that leaves: of itself, and of the one that enters
            fewer = count(z["n"], out) - 1
            more = count(z["n"], into) - F.when(full & (into == out), 1).otherwise(0)

            def seen(y: Column) -> Column:
                high = (i >= WINDOW) & ((F.lit(math.log2(WINDOW)) - y["sum"] / WINDOW) >= low - 1e-9) & clear(i - WINDOW, i)
                apart = high & (z["from"] >= 0) & (i - WINDOW > z["to"])
                return F.struct(
                    y["n"].alias("n"), y["sum"].alias("sum"),
                    F.when(high & ((z["from"] < 0) | apart), i - WINDOW).otherwise(z["from"]).alias("from"),
                    F.when(high, i).otherwise(z["to"]).alias("to"),
                    F.when(apart, F.array_append(z["out"], run(z))).otherwise(z["out"]).alias("out"),
                )

            return let(let(F.struct(fewer.alias("fewer"), more.alias("more")), moved), seen)

        return F.aggregate(F.sequence(F.lit(1), F.size(c)), start, step, lambda z: F.when(z["from"] >= 0, F.array_append(z["out"], run(z))).otherwise(z["out"]))

    return let(chars, over)


def threshold(s: Column) -> Column:
    """The entropy that the class of `s` asks for; null for strings of no class or on the allow-list."""
    allowed = reduce(lambda a, b: a | b, [F.regexp_like(s, F.lit(p)) for p in ALLOW])
    level = F.lit(None).cast("double")
    for _, pattern, low in reversed(CLASSES):
        level = F.when(F.regexp_like(s, F.lit(pattern)), F.lit(low)).otherwise(level)
    return F.when(~allowed, level)


def entropy_spans(text: Column, base: Column, kind: int) -> Column:
    """Spans of candidate strings' high-entropy windows that no base span overlaps."""

    def parts(c: Column) -> Column:
        def measured(s: Column) -> Column:
            own = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            clear = lambda inside: lambda low, high: ~F.exists(inside, lambda b: (b["start"] < c["start"] + high) & (c["start"] + low < b["end"]))
            return let(own, lambda inside: let(threshold(s), lambda low: windows(s, low, clear(inside))))

        found = let(F.substring(text, c["start"] + 1, c["end"] - c["start"]), measured)
        return F.transform(found, lambda w: F.struct((c["start"] + w["from"]).alias("start"), F.lit(kind).alias("kind"), (c["start"] + w["to"]).alias("end")))

    candidates = F.coalesce(spans(text, CANDIDATE, kind, lambda m: threshold(m).isNotNull()), F.array().cast(SPAN))
    return F.flatten(F.transform(candidates, parts))


KINDS = ("assign", "access", "hex", "entropy")


def listed(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base_spans` and `entropy_spans`: arrays of (start, kind number, end) in code points, end exclusive.

    Base kinds are assign (a value of 12 characters or more), access and hex; entropy spans never replace one.
    An entropy span is the union of overlapping windows of high entropy that touch no base span. Null and empty
    texts have no spans. The work grows with a text's length, however long its candidates are. Every row is scanned alike and repeated rows give equal spans; columns
    of `docs` named base_spans or entropy_spans are replaced, others kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    assign = spans(body, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 12)
    base = F.concat(*[F.coalesce(x, none) for x in (assign, spans(body, ACCESS, 1), spans(body, HEX, 2))])
    docs = docs.withColumn("base_spans", F.sort_array(base))
    # long candidates only: most texts have none and go no further
    found = let(F.col("base_spans"), lambda b: entropy_spans(body, b, 3))
    return docs.withColumn("entropy_spans", F.when(F.regexp_like(body, F.lit(CANDIDATE)), found).otherwise(none))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base_spans", "entropy_spans")).alias("spans"),
    )
