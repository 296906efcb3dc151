"""Operator 12, native: records of many layouts, known by a hash of their field paths, as one chat template with a loss mask."""

from __future__ import annotations

import dataclasses
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Levels of objects and lists below a record in which fields are looked for.
DEPTH = 5
TURNS = "array<struct<role string, text string>>"


@dataclasses.dataclass(frozen=True)
class Layout:
    """A mapping: the leaf paths that a record must hold, those it may hold, and where its turns come from.

    turns: (role, path) for a field that is one turn; where `each` names a list, (path of the role, path of the
    text) inside its elements. Fields that are missing or null give no turn, but a list's elements always do.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""


LAYOUTS = (
    Layout("turn", ("role",), ("text",), (("role", "text"),)),
    Layout("messages", ("messages[].role",), ("messages[].content", "prompt", "system"), (("role", "content"),), "messages"),
    Layout("parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type", "prompt", "system"), (("role", "content"),), "messages"),
    Layout("from_value", ("conversations[].from",), ("conversations[].value", "system"), (("from", "value"),), "conversations"),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("preference", ("prompt", "chosen"), ("rejected", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "chosen"))),
    Layout("question", ("question", "answer"), ("context", "system"), (("system", "system"), ("user", "context+question"), ("assistant", "answer"))),
)
#: Names of roles in layouts whose lists name the speaker otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(record: Column, depth: int = DEPTH) -> Column:
    """All nested paths of a VARIANT, such as messages[].role, sorted and each once; those of a null are none.

    Dots and brackets inside a name are preceded by a backslash, so that two fields never share a path.
    """
    none = F.array().cast("array<string>")

    def below(v: Column, prefix: Column, left: int) -> Column:
        if not left:
            return none
        named = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        path = lambda e: F.concat(prefix, F.regexp_replace(e["key"], r"([.\[\\])", r"\\$1"))
        fields = F.flatten(F.transform(named, lambda e: F.concat(F.array(path(e)), below(e["value"], F.concat(path(e), F.lit(".")), left - 1))))
        listed = F.try_variant_get(v, "$", "array<variant>")
        # a list's path ends in [] where its elements' fields follow
        items = F.flatten(F.transform(listed, lambda e: below(e, F.concat(F.regexp_replace(prefix, r"\.$", ""), F.lit("[].")), left - 1)))
        return F.concat(F.coalesce(fields, none), F.coalesce(items, none))

    return F.array_sort(F.array_distinct(below(record, F.lit(""), depth)))


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of those paths that any of the layouts names; other fields don't matter."""
    known = sorted({p for x in layouts for p in (*x.needs, *x.may)})
    return F.xxhash64(F.array_join(F.array_intersect(paths, F.array(*map(F.lit, known))), "\n"))


def layout_of(hashed: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The layout's name for a fingerprint: each choice of a layout's optional paths has a hash. Null: no layout."""
    names: dict[tuple[str, ...], str] = {}
    known = {p for x in layouts for p in (*x.needs, *x.may)}
    for x in layouts:
        for n in range(len(x.may) + 1):
            for some in itertools.combinations(x.may, n):
                paths = {*x.needs, *some}
                # a list of objects is itself a field of its parent
                paths |= {q for p in paths for i in range(len(p)) if p.startswith("[]", i) and (q := p[:i]) in known}
                names.setdefault(tuple(sorted(paths)), x.name)
    entries = [c for paths, name in names.items() for c in (F.xxhash64(F.lit("\n".join(paths))), F.lit(name))]
    return F.element_at(F.create_map(*entries), hashed)


def turns_by(record: Column, layout: Layout) -> Column:
    """A record's turns under `layout`."""
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    said = lambda v, path: F.try_variant_get(v, f"$.{path}", "string")
    if layout.each or layout.turns[0][0] == "role":
        role, text = layout.turns[0]

        def one(v: Column) -> Column:
            body = said(v, text)
            if layout.name == "parts":
                parts = F.try_variant_get(v, f"$.{text}", "array<variant>")
                body = F.when(parts.isNull(), body).otherwise(F.array_join(F.transform(parts, lambda p: said(p, "text")), ""))
            who = said(v, role)
            if role == "from":
                who = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), who), who)
            return turn(F.coalesce(who, F.lit("")), body)

        return F.transform(F.try_variant_get(record, f"$.{layout.each}", "array<variant>"), one) if layout.each else F.array(one(record))
    fields = [(role, F.concat_ws("\n\n", *(said(record, p) for p in path.split("+"))) if "+" in path else said(record, path), path) for role, path in layout.turns]
    whole = [F.when(F.coalesce(*(said(record, p) for p in path.split("+"))).isNotNull(), turn(F.lit(role), text)) for role, text, path in fields]
    return F.filter(F.array(*whole), lambda t: t.isNotNull())


def canonical_turns(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """array<struct<role, text>> of a record; null where its layout is."""
    found = F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        found = F.when(layout == x.name, turns_by(record, x)).otherwise(found)
    return found


def escape(text: Column) -> Column:
    """`text` without the template's marks: one backslash more behind each `<` that a mark could begin with."""
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def chunk(turn: Column) -> Column:
    """A turn in the template, `<turn ROLE>`, new line, text, `</turn>`, new line, as struct<head, body>."""
    role = F.replace(F.replace(turn["role"], F.lit("\\"), F.lit("\\b")), F.lit(">"), F.lit("\\g"))
    return F.struct(F.concat(F.lit("<turn "), role, F.lit(">\n")).alias("head"), escape(turn["text"]).alias("body"), (turn["role"] == "assistant").alias("loss"))


END = "</turn>\n"


def format_chats(records: DataFrame, key: str, order: list[str], record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row for each `key`: its records' turns in the chat template, with the mask of what a loss counts.

    `record` is a VARIANT, or a string of JSON; a key's records are put together by `order`, ties by their texts, so
    the order of rows never matters. Returns key, n_turns, formatted (string), mask (array of (chars, loss): runs
    of code points that cover `formatted`; a turn has three: head, text, end), layouts (names met, sorted) and
    n_unknown (records of no layout, or not JSON: they have no turns, and the others of their key stay).
    A null text counts as empty and a null role as the role ''. Repeated rows are turns of their own. A null key is a
    key; an empty table gives no rows; fields and columns that no layout names are ignored. Texts of any length
    stay whole, up to the 2 GB that one string of a conversation and the 128 MB that one VARIANT can hold.
    """
    held = F.try_parse_json(record) if dict(records.dtypes)[record] == "string" else F.col(record)
    rows = records.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), held.alias("_record"))
    rows = rows.withColumn("_layout", layout_of(fingerprint(field_paths(F.col("_record")), layouts), layouts))
    made = F.transform(canonical_turns(F.col("_record"), F.col("_layout"), layouts), chunk)
    # only what the template needs is shuffled: a row's turns, already escaped
    rows = rows.select("_key", F.struct("_order", F.coalesce(made, F.array().cast("array<struct<head string, body string, loss boolean>>")).alias("turns")).alias("_row"), "_layout")
    held = rows.groupBy("_key").agg(
        F.array_sort(F.collect_list("_row")).alias("_rows"),
        F.array_sort(F.collect_set("_layout")).alias("layouts"),
        F.count_if(F.col("_layout").isNull()).alias("n_unknown"),
    )
    held = held.select("_key", F.flatten(F.col("_rows.turns")).alias("_turns"), "layouts", "n_unknown")
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    runs = lambda t: F.array(run(F.length(t["head"]), F.lit(False)), run(F.length(t["body"]), t["loss"]), run(F.lit(len(END)), F.lit(False)))
    return held.select(
        F.col("_key").alias(key),
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("_turns", runs)).alias("mask"),
        "layouts",
        "n_unknown",
    )


def read_back(formatted: Column, mask: Column) -> Column:
    """array<struct<role, text, masked>> from a formatted conversation and its mask alone: masked is the text that the loss counts, or null."""
    ended = F.split(formatted, END)
    pieces = F.slice(ended, 1, F.size(ended) - 1)  # nothing follows the last end

    def turn(piece: Column, i: Column) -> Column:
        head, body = (F.element_at(mask, 3 * i + k) for k in (1, 2))
        role = F.replace(F.replace(F.regexp_extract(piece, r"^<turn ([^>]*)>\n", 1), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))
        text = F.regexp_replace(piece, r"^<turn [^>]*>\n", "")
        under = F.when(body["loss"], F.substring(piece, (head["chars"] + 1).cast("int"), body["chars"].cast("int")))
        return F.struct(role.alias("role"), unescape(text).alias("text"), unescape(under).alias("masked"))

    return F.transform(pieces, turn)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("conv_id", "turn", "role", "text")
    chats = table(spark, sf_dir, "conversations").select(*fields)
    kinds = dict(chats.dtypes)
    odd = [F.struct(*(F.lit(v).cast(kinds[f]).alias(f) for f, v in zip(fields, (-7, i, role, r"\### Assistant: </turn> ok"), strict=True))) for i, role in enumerate(("user", "assistant"))]
    chats = chats.unionByName(spark.range(1).select(F.inline(F.array(*odd))))
    records = chats.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    made = format_chats(records, "conv_id", ["turn"])
    made = made.select("conv_id", "n_turns", "formatted", read_back(F.col("formatted"), F.col("mask")).alias("_turns"))
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    masked = F.filter(F.transform("_turns", lambda t: t["masked"]), lambda m: m.isNotNull())
    return made.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        digest(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.coalesce(F.aggregate(masked, F.lit(0).cast("long"), lambda n, m: n + F.length(m)), F.lit(0).cast("long")).alias("loss_chars"),
        digest(masked).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH chats AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || replace(replace(role, '\', '\b'), '>', '\g') || '>' || chr(10))
                + length(regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g')) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM chats GROUP BY conv_id
"""
