"""Operator 1: near duplicates by chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, give_back, lookup, sized, small_batches, table, tidy

#: Words in a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80
#: Minwise tokens of a document; independent trees over them; tokens that the first level of a tree chooses.
#: Two documents of similarity s meet in a tree's first nodes with s^FIRST, so that of the pairs at 0.8 fewer
#: than 2 in 100,000 meet in no tree's first nodes.
TOKENS, TREES, FIRST = 64, 16, 3
#: A node of at most so many documents is compared exhaustively; a larger one branches at most DEEPEST times, each
#: time by STEP tokens, on as many paths as keep the number of rows about the same: MOST where its documents are
#: loosely alike, so that sub-nodes are small, 2 where they are nearly alike.
SMALL, DEEPEST, STEP, MOST = 512, 6, 3, 4
#: A large node branches no more, and is compared by its leaders, if half of one in SAMPLE of its members agree with
#: HEADS of them in as many tokens as a link needs. This only chooses the cheaper way: neither loses a link in a node.
SAMPLE, HEADS = 16, 4
#: Trees of the first round. Its components spare later rounds all nodes whose texts are one component already.
EARLY = 2
#: A node of more shingles than this counts as large, however few its texts.
WEIGHT = 2_000_000
#: Shingles that a task of sketches holds at a time, and words whose hashes a worker keeps: some MB, also while later work goes on.
PORTION, KNOWN = 50_000, 100_000
#: Members of a node that is large still, and so nearly all alike, which meet all its blocks.
LEADERS = 16

_U = np.uint64
_MIX = np.random.RandomState(7).randint(1, 2**62, SHINGLE + 3).astype(_U) * _U(2) + _U(1)
_DRAW = np.random.RandomState(11).randint(1, 2**62, TOKENS).astype(_U) * _U(2) + _U(1)
_MASK = 2**64 - 1
_words: dict[bytes, int] = {}


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; A-Z count as a-z, words are split at ASCII white space."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U)
    if len(_words) > KNOWN:
        _words.clear()
    for w in [w for w in set(words) if w not in _words]:
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), _U, n)
    if n < SHINGLE:
        s = np.array([(sum(int(x) * int(c) for x, c in zip(h, _MIX)) + n * int(_MIX[SHINGLE])) & _MASK], _U)
    else:
        s = h[: n - SHINGLE + 1] * _MIX[0]
        for k in range(1, SHINGLE):
            s += h[k : n - SHINGLE + 1 + k] * _MIX[k]
    return np.unique(mixed(s, _MIX[SHINGLE + 1]))


def mixed(s: np.ndarray, by: np.uint64) -> np.ndarray:
    s = (s ^ (s >> _U(31))) * by
    return s ^ (s >> _U(29))


def _token_rows(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """For each set its minwise tokens, and a 128-bit fingerprint; zeros and b'' for empty sets."""
    full = [i for i, s in enumerate(sets) if len(s)]
    tokens, prints = np.zeros((len(sets), TOKENS), np.int32), [b""] * len(sets)
    if full:
        every = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for j in range(TOKENS):
            tokens[full, j] = (np.minimum.reduceat(every * _DRAW[j], starts) >> _U(33)).astype(np.int32)
        a = np.add.reduceat(mixed(every, _MIX[SHINGLE + 2]), starts)
        b = np.bitwise_xor.reduceat(mixed(every, _MIX[0]), starts)
        for k, i in enumerate(full):
            prints[i] = int(a[k]).to_bytes(8, "big") + int(b[k]).to_bytes(8, "big")
    return tokens, prints


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < len(batch):  # some MB of text at a time
            sets, start, seen = [], at, 0
            while at < len(batch) and seen < PORTION:
                sets.append(shingle_set(batch.column(1)[at].as_py()))
                seen += len(sets[-1]) + 20
                at += 1
            tokens, prints = _token_rows(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TOKENS), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists], ["doc_id", "n_shingles", "fp", "tokens"])
    _words.clear()  # the worker lives on, beside later work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([shingle_set(batch.column(1)[i].as_py()).tobytes()], pa.binary())], ["rep", "shingles"])
    _words.clear()


def linked(reps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: every set is compared with every other, exactly."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), size)
    shared = count[where] > 1  # a shingle of one set only adds to no intersection
    row, (_, col) = row[shared], np.unique(where[shared], return_inverse=True)
    both = np.zeros((k, k), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    step = min(width, max(256, (1 << 20) // k)) or 1
    for low in range(0, width, step):
        a, b = np.searchsorted(col, (low, low + step))
        part = np.zeros((k, step), np.float32)
        part[row[a:b], col[a:b] - low] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    near = np.argwhere(np.triu((100 * both >= percent * union) & (union > 0), 1))
    root = list(range(k))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in near:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(int(reps[find(i)]), int(reps[i])) for i in range(k) if find(i) != i and reps[find(i)] != reps[i]]


def compare(blocks: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (u < v) that span what is linked in each block. blocks: (node, rep), each of bounded size; docs: (doc_id, text)."""
    needed = sized(cut_ids(blocks.select(F.col("rep").alias("doc_id")).distinct()))
    with small_batches(docs.sparkSession):
        sets = cut(docs.join(needed, "doc_id", "left_semi").mapInArrow(tidy(_sets), "rep long, shingles binary"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        sets = [np.frombuffer(x, _U) for x in pdf["shingles"]]
        found = linked(pdf["rep"].to_numpy(), sets, percent)
        if sum(map(len, sets)) > PORTION:  # smaller nodes leave little
            give_back()
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return blocks.join(sets, "rep").groupBy("node").applyInPandas(link, "u long, v long").distinct()


def cut_ids(df: DataFrame) -> DataFrame:
    """`cut` for what is left of a shuffle of ids: no more tasks and files than four for each core."""
    return cut(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism))


def components(links: DataFrame) -> DataFrame:
    """(v, u): each vertex of the links (u < v) but the smallest of its component, with that smallest one.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder. Links are not
    dealt by their vertices, of which one may have most: see `lookup`.
    """
    stars, before = cut_ids(links), None
    n = stars.count()
    while n:
        small = 2 * n <= BROADCAST_ROWS
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
        up = both.filter("y > x")
        met = up.join(F.broadcast(least), "x") if small else lookup(cut(up), cut(least), "x", "n")
        large = cut_ids(met.select(F.col("m").alias("u"), F.col("y").alias("v")).distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        met = large.join(F.broadcast(low), "v") if small else lookup(large, cut(low), "v", "n")
        # the star that `low` makes has its rows in `met` too: where u is the least of its v, the link is u - v itself
        own = F.col("u") == F.col("m")
        stars = cut_ids(met.select("m", F.when(own, F.col("v")).otherwise(F.col("u")).alias("v")).select(F.col("m").alias("u"), "v").distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return stars.select("u", "v")


def agreement(rows: DataFrame, percent: int) -> DataFrame:
    """(node, share, mean): the share of a sample of each node's members that agree in `percent` of the tokens with its heads, and the mean agreement.

    rows: (node, rep, tokens) of large nodes.
    """
    some = cut(rows.filter(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(SAMPLE)) == 0).select("node", "rep", "tokens"))
    slot = F.pmod(F.xxhash64("rep"), F.lit(HEADS))
    heads = some.groupBy("node").agg(*[F.min_by("tokens", F.when(slot == k, F.col("rep"))).alias(f"h{k}") for k in range(HEADS)])
    heads = cut_ids(heads.select("node", F.array_compact(F.array(*[f"h{k}" for k in range(HEADS)])).alias("heads")))
    agree = lambda head: F.aggregate(F.zip_with("tokens", head, lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    same = F.aggregate(F.transform("heads", agree), F.lit(0), lambda x, y: x + y) / (F.size("heads") * TOKENS)
    each = some.join(sized(heads), "node").select("node", same.alias("same"))
    return each.groupBy("node").agg(F.avg((100 * F.col("same") >= percent).cast("int")).alias("share"), F.avg("same").alias("mean"))


def nodes(classes: DataFrame, small: int = SMALL, deepest: int = DEEPEST, percent: int = PERCENT, trees: range = range(TREES)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees' leaves: (node, rep, n_shingles) of all nodes of 2 to `small` documents, and of larger ones that branch no more; and ruled nodes.

    classes: (rep, comp, n_shingles, tokens). A node's documents branch by tokens that the node chooses. Nodes of
    one component (comp) have nothing to find and are left out, wherever they come up; equal nodes of different
    trees are taken once. Nodes of documents that are mostly alike, or `deepest` levels down, stay large. A large
    node is ruled, and branches no more, if all but `small` of its documents are of one component:
    those rows (node, rep, comp, top, parts, groups) have their component and the one that rules, and into how many
    parts all the node's documents go, and into how many groups those of other components.
    """
    rows = classes.select("rep", "comp", "n_shingles", "tokens", F.explode(F.array(*map(F.lit, trees))).alias("tree"))
    pick = [F.get("tokens", (F.col("tree") * FIRST + k) % TOKENS) for k in range(FIRST)]
    # written once without tokens: most nodes need none, and all that follows would deal the classes to trees again
    rows = cut(rows.select("rep", "comp", "n_shingles", F.xxhash64("tree", *pick).alias("node")))
    leaves, rest, ruled = [], [], []
    one = lambda parts: reduce(DataFrame.unionByName, parts)
    for level in range(deepest + 1):
        own = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("rep")).alias("all"))
        sizes = own.groupBy("node").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.bit_xor("all").alias("all"), F.max(F.struct("n", "comp", "weight")).alias("first"), F.count("*").alias("comps"))
        sizes = sizes.filter("comps > 1").groupBy("n", "all", "weight").agg(F.min("node").alias("node"), F.max("first").alias("first"))
        fits = (F.col("n") <= small) & ((F.col("weight") <= WEIGHT) | (F.col("n") == 2))
        kind = F.when(fits, "leaf").when(F.col("n") - F.col("first.n") <= small, "ruled").otherwise("large")
        parts, groups = parts_of(F.col("n"), F.col("weight"), small), parts_of(F.col("n") - F.col("first.n"), F.col("weight") - F.col("first.weight"), small)
        sizes = cut_ids(sizes.select("node", kind.alias("kind"), F.col("first.comp").alias("top"), parts.alias("parts"), groups.alias("groups")))
        # each row of a node that is left goes through one join a level: what is made of it is read back
        bare = rows.select("node", "rep", "n_shingles", "comp")
        done = cut(bare.join(sizes.filter("kind <> 'large'"), "node"))
        leaves.append(done.filter("kind = 'leaf'").select("node", "rep", "n_shingles"))
        ruled.append(done.filter("kind = 'ruled'").select("node", "rep", "comp", "top", "parts", "groups"))
        large = sizes.filter("kind = 'large'").select("node")
        if level == deepest or not large.take(1):
            rest.append(bare.drop("comp").join(sized(large), "node"))
            return one(leaves), one(rest), one(ruled)
        rows = cut(rows.join(sized(large), "node"))
        if not level:
            rows = cut(classes.select("rep", "tokens").join(sized(rows), "rep"))
        rows = rows.join(sized(cut_ids(agreement(rows, percent))), "node", "left")
        rest.append(rows.filter("share >= 0.5").select("node", "rep", "n_shingles"))
        paths = F.least(F.greatest(F.round(1.25 / F.pow("mean", F.lit(STEP))), F.lit(2)), F.lit(MOST)).cast("int")
        rows = rows.filter("share IS NULL OR share < 0.5").withColumn("path", F.explode(F.sequence(F.lit(1), F.coalesce(paths, F.lit(2)))))
        chosen = [F.get("tokens", F.pmod(F.xxhash64("node", "path", F.lit(level * STEP + k)), F.lit(TOKENS)).cast("int")) for k in range(STEP)]
        rows = cut(rows.withColumn("node", F.xxhash64("node", "path", *chosen)).drop("path", "share", "mean"))
    raise AssertionError


def parts_of(n: Column, weight: Column, small: int) -> Column:
    """Into how many parts of half a node, in texts and in shingles, so many documents go."""
    return F.ceil(F.greatest(n / max(1, (small - LEADERS) // 2), weight / (WEIGHT // 2))).cast("int")


def strays_with_all(placed: DataFrame, strays: DataFrame) -> DataFrame:
    """Blocks (node, rep) in which each of a node's strays meets all its members. placed: (node, rep, part, groups) and strays: (node, rep, parts, groups)."""
    every = placed.select("node", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    odd = strays.withColumn("group", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("groups")).cast("int"))
    odd = odd.select("node", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "group")
    return cut_ids(every.unionByName(odd).distinct().select(F.xxhash64("node", "part", "group").alias("node"), "rep"))


def part_of() -> Column:
    """The part of its node that a member is in, of `parts`."""
    return F.pmod(F.xxhash64("rep", "node"), F.col("parts")).cast("int")


def joined_by(classes: DataFrame, known: DataFrame, texts: DataFrame, trees: range, percent: int, small: int, deepest: int) -> DataFrame:
    """The components (v, u) of the links `known` (u < v) and of those that `trees` find."""
    comps = classes.join(sized(known.select(F.col("v").alias("rep"), "u")), "rep", "left").withColumn("comp", F.coalesce("u", "rep")).drop("u")
    leaves, rest, ruled = nodes(cut(comps), small, deepest, percent, trees)
    blocks, ruled, rest = leaves.select("node", "rep"), cut(ruled), cut(rest)
    if ruled.take(1):
        blocks = blocks.unionByName(strays_with_all(ruled.withColumn("part", part_of()), ruled.filter("comp <> top")))
    links = known.select("u", "v").unionByName(compare(cut(blocks), texts, percent))
    if not rest.take(1):
        return components(links)
    slots = rest.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)).alias("slot")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("rep").alias("lead"))
    counted = cut_ids(slots.groupBy("node").agg(parts_of(F.sum("n"), F.sum("weight"), small).alias("parts"), F.array_sort(F.collect_list("lead")).alias("leaders")))
    placed = cut(rest.join(sized(counted.select("node", "parts")), "node").withColumn("part", part_of()))
    leads = counted.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.explode("leaders").alias("rep"))
    blocks = placed.select("node", "part", "rep").unionByName(leads.select("node", "part", "rep")).distinct()
    links = cut_ids(links.unionByName(compare(cut_ids(blocks.select(F.xxhash64("node", "part").alias("node"), "rep")), texts, percent)))
    joined = components(links)
    # strays: members outside the component of their node's first leader
    named = placed.join(sized(joined.select(F.col("v").alias("rep"), "u")), "rep", "left").withColumn("comp", F.coalesce("u", "rep")).drop("u")
    heads = counted.select("node", F.element_at("leaders", 1).alias("v")).join(joined, "v", "left").select("node", F.coalesce("u", "v").alias("head"))
    strays = cut(named.join(sized(cut(heads)), "node").filter("comp <> head").select("node", "rep", "n_shingles", "parts"))
    if not strays.take(1):
        return joined
    groups = sized(cut_ids(strays.groupBy("node").agg(parts_of(F.count("*"), F.sum("n_shingles"), small).alias("groups"))))
    met = strays_with_all(placed.join(groups, "node"), strays.join(groups, "node"))
    return components(joined.select("u", "v").unionByName(compare(met, texts, percent)))


def link_documents(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id", small: int = SMALL, deepest: int = DEEPEST) -> DataFrame:
    """One row for each row of `docs`: key, n_shingles, component_id and kept.

    Two texts are linked if 100 * shared >= percent * joint of their distinct 5-word shingles; a component is all
    that links reach, named by its smallest key; kept marks the rows of that key. Texts without a word (null,
    empty) have 0 shingles and no links; rows with a null key have no links and are kept. Rows that share a key
    are one vertex, with all their links. Other columns are ignored.

    Equal sets are one class from the start. The classes' minwise tokens are branched by chosen paths in TREES
    trees until nodes are small; a node is compared exhaustively on full sets. The first EARLY trees make
    components; the others only look into nodes that hold more than one, and where one of them rules a large node its
    strays meet all its members. Nodes that stay large hold texts that
    are mostly alike or agree in all tokens chosen: they are compared in blocks which all hold the node's leaders,
    and then every member outside the leaders' component against the whole node, so that no link between
    components is lost. Blocks are bounded in texts and, but for single texts, in shingles.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        sketched = cut(texts.mapInArrow(tidy(_sketch), "doc_id long, n_shingles long, fp binary, tokens array<int>"))
    able = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut(able.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")))
    # a key that several texts share links their classes
    keyed = able.select("doc_id", "fp").distinct().groupBy("doc_id").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    joined = keyed.select(F.explode("fps").alias("fp"), "doc_id").join(classes.select("fp", "rep"), "fp").filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    joined = components(joined)
    for trees in (range(EARLY), range(EARLY, TREES)):
        joined = joined_by(classes.select("rep", "n_shingles", "tokens"), joined, texts, trees, percent, small, deepest)

    found = classes.join(sized(joined.select(F.col("v").alias("rep"), "u")), "rep", "left")
    found = cut(found.select("fp", F.coalesce("u", "rep").alias("component"), "members", "rep").filter("members > 1 OR component <> rep").drop("rep"))
    labelled = lookup(sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp")), found, "fp", "members")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return labelled.select(F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: of each component those of its smallest doc_id, and rows without a doc_id."""
    gone = cut(link_documents(docs, **options).filter("NOT kept").select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(m) AS component_id, min(m) = n.doc_id AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
