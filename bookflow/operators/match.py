"""Titles matched to an external table of subjects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.similarity import title_similarity
from bookflow.functions.text import norm_title
from bookflow.sources.shared import cut

# Platforms of subjects that are books.
PLATFORMS = ("小说", "其他")


#: Rows that `gathered` puts into one array at most.
BLOCK = 512


def gathered(rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """(*keys, into): the rows in arrays of at most BLOCK structs, of one key each; no task needs all rows of a key.

    Rows are ordered over all tasks, whatever task they come from, so that a key has few arrays more than its rows fill.
    """
    numbered = rows.orderBy(*keys, F.xxhash64(*rows.columns)).withColumn("_block", F.floor(F.monotonically_increasing_id() / BLOCK))
    # cut, as the numbers must not change where a task is run again
    return cut(numbered).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys))).alias(into)).drop("_block")


def paired(met: DataFrame, *sides: str) -> DataFrame:
    """The pairs of `met`, whose columns `sides` are two arrays by `gathered`: rows of few arrays are dealt to all tasks before their pairs are made."""
    one, other = sides
    keys = [c for c in met.columns if c not in sides]
    return spread(met).select(*keys, F.explode(one).alias("_l"), other).select(*keys, "_l.*", F.explode(other).alias("_r")).select("*", "_r.*").drop("_r")


def block_candidates(books: DataFrame, subjects: DataFrame, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """Pairs of books and subjects of equal date, without series and platforms that are no books.

    books: (book_id, title, date); subjects: (id, name, date, series, platform, rank). A date is a release day and may
    hold many of both, so arrays of a day's books meet arrays of its subjects, each a few of BLOCK * BLOCK pairs. The
    join is merged, since Spark underestimates arrays and would broadcast them.
    All pairs of a day is what this gives; whoever wants similar ones alone should ask `similar_titles`.
    """
    return paired(gathered(books, ["date"], "_books").join(gathered(_able(subjects, platforms), ["date"], "_able").hint("merge"), "date"), "_books", "_able")


def _able(subjects: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    return subjects.filter(~F.col("series") & F.col("platform").isin(*platforms)).select("id", "name", "date", "rank")


def scored_candidates(books: DataFrame, subjects: DataFrame, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """The pairs of `block_candidates` with `conf`, without those of null titles and names.

    The distinct titles and names of a day are paired and scored; then arrays of the books of each title and of the
    subjects of each name take their score, and are made pairs last.
    """
    able = _able(subjects, platforms)
    titles, names = books.select("date", "title").distinct(), able.select("date", "name").distinct()
    pairs = paired(gathered(titles, ["date"], "_titles").join(gathered(names, ["date"], "_names").hint("merge"), "date"), "_titles", "_names")
    known = scored(cut(pairs)).join(gathered(books, ["date", "title"], "_books").hint("merge"), ["date", "title"])
    return paired(known.join(gathered(able, ["date", "name"], "_able").hint("merge"), ["date", "name"]), "_books", "_able")


def shared_letters(a: Column, b: Column) -> Column:
    """How many characters two titles have in common, each as often as it is in both: no common subsequence is longer."""
    own = F.array_distinct(F.split(a, ""))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.filter(own, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def scored(pairs: DataFrame, left: str = "title", right: str = "name", least: float = 0.0) -> DataFrame:
    """Pairs with `conf`, the similarity of their normalised titles; each distinct pair of titles is compared once.

    Pairs that cannot reach `least` are left out before Python sees them: if n is the shorter length and c the
    number of shared characters, no part of a title is nearer than 2 * c / (n + c). The joins are merged: pairs of few
    titles take so little room in a file that Spark would broadcast millions of them.
    """
    distinct = pairs.select(left, right).distinct()
    titles = distinct.select(F.col(left).alias("_t")).union(distinct.select(right)).distinct().withColumn("_n", norm_title(F.col("_t")))
    ready = distinct.join(titles.withColumnsRenamed({"_t": left, "_n": "_a"}).hint("merge"), left).join(titles.withColumnsRenamed({"_t": right, "_n": "_b"}).hint("merge"), right)
    if least > 0:
        c, n = shared_letters(F.col("_a"), F.col("_b")), F.least(F.length("_a"), F.length("_b"))
        ready = ready.withColumn("_c", c).filter((n == 0) | (2 * F.col("_c") >= (least - 1e-9) * (n + F.col("_c"))))
    return pairs.join(ready.select(left, right, title_similarity(F.col("_a"), F.col("_b")).alias("conf")).hint("merge"), [left, right])


#: Letters of a piece at most, so that the grams of a title stay few.
PIECE = 6


def n_pieces(n: int, least: float) -> int:
    """Into how many pieces a title of n letters is cut, so that one lies whole in every title of similarity `least`.

    If 2 * lcs >= least * (n + m) for a part of m letters of a title that is no shorter, m is at most n * (2 - least)
    / least, and the letters that the two don't share number (1 - least) * (n + m) at most. Each spoils one piece at
    most. Where that would leave no letters to a piece, pieces are letters: some letter must be shared.
    """
    if least <= 0:
        raise ValueError("a similarity above 0 is needed")
    longest = math.floor(n * (2 - least) / least + 1e-9)
    return max(1, min(n, max(math.floor((1 - least) * (n + longest) + 1e-9) + 1, -(-n // PIECE))))


def title_pieces(title: Column, least: float) -> Column:
    """The pieces of a title, by `n_pieces`; an empty title is one empty piece."""
    n = F.length(title)
    longest = F.floor(n * ((2 - least) / least) + 1e-9)
    count = F.greatest(F.lit(1), F.least(n, F.greatest(F.floor((n + longest) * (1 - least) + 1e-9) + 1, F.ceil(n / PIECE)))).cast("int")
    cut_at = lambda i: F.floor(i.cast("long") * n / count).cast("int")
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(title, cut_at(i) + 1, cut_at(i + 1) - cut_at(i))))


def title_grams(title: Column, least: float) -> Column:
    """All parts of a title that are as long as some title's piece; an empty title has the empty one."""
    sizes = sorted({x for n in range(1, 513) for x in (n // n_pieces(n, least), -(-n // n_pieces(n, least)))})  # longer titles have pieces of the same few lengths
    n = F.length(title)

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
        return F.when(n >= size, F.transform(starts, lambda i: F.substring(title, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    parts = [of(size) for size in sizes]
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(*parts)))


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all tasks: few bytes, which Spark would put in one, but much to do for each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def met_by_pieces(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (date, a, b) of two cut tables (date, title) of distinct normalised titles of which the shorter has a piece that lies in the other.

    Words may be in any order: a title with its words sorted has pieces too. Titles meet by date and piece, and pairs
    that share none are never made. A pair is made once for each side that is no longer, at the first of its pieces.
    A piece that many titles of a day hold is a skewed key of a plain join, which Spark splits.
    """
    ordered = F.array_join(F.array_sort(F.filter(F.split("title", r"(?U)\s+"), lambda w: w != "")), " ")

    def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = spread(df).select("date", "title", ordered.alias("sorted"))
        pieces = F.array_distinct(F.concat(title_pieces(F.col("title"), least), title_pieces(F.col("sorted"), least)))
        grams = F.array_distinct(F.concat(title_grams(F.col("title"), least), title_grams(F.col("sorted"), least)))
        short = own.select("date", F.col("title").alias("x"), pieces.alias("pieces")).select("date", "x", "pieces", F.posexplode("pieces").alias("at", "piece"))
        return short, own.select("date", F.col("title").alias("y"), F.col("sorted").alias("y_sorted"), F.explode(grams).alias("piece"))

    def met(short: DataFrame, long: DataFrame) -> DataFrame:
        """(date, x, y): titles x that are no longer than y, as they are or as they are when words are sorted."""
        before = F.exists(F.slice("pieces", F.lit(1), F.col("at")), lambda p: F.contains("y", p) | F.contains("y_sorted", p))
        shorter = (F.length("x") <= F.length("y")) | (F.length(_bare("x")) <= F.length(_bare("y")))
        return short.join(long, ["date", "piece"]).filter(shorter & ~before).select("date", "x", "y")

    (x, y), (u, v) = halves(left), halves(right)
    found = met(x, v).withColumnsRenamed({"x": "a", "y": "b"})
    return found.unionByName(met(u, y).withColumnsRenamed({"x": "b", "y": "a"})).distinct()


def _bare(title: str) -> Column:
    """A normalised title without the space before and behind it, as it is when its words are sorted."""
    return F.regexp_replace(title, "^ | $", "")


def possible_pairs(met: DataFrame, least: float) -> DataFrame:
    """The distinct (a, b) of `met` that have letters enough in common."""

    def near(x: Column, y: Column) -> Column:
        c, n = shared_letters(x, y), F.least(F.length(x), F.length(y))
        return (n == 0) | (2 * c >= (least - 1e-9) * (n + c))

    # cut, as Spark would move the filter to where each pair is many rows
    return cut(met.select("a", "b").distinct()).filter(near(F.col("a"), F.col("b")) | near(_bare("a"), _bare("b")))


def near_candidates(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """The pairs that `met_by_pieces` makes and `possible_pairs` keeps: all that can be as similar as `least`, and few others."""
    met = cut(met_by_pieces(left, right, least))
    return met.join(possible_pairs(met, least), ["a", "b"]).select("date", "a", "b")


def similar_titles(books: DataFrame, subjects: DataFrame, least: float = 0.9) -> DataFrame:
    """J3 and J4 in one: (date, title, name, conf) for the distinct titles (date, title) and names (date, name) of a day that are at least so similar.

    Null titles and names are like nothing. Pairs are made by shared pieces, and of them the distinct possible ones scored.
    """
    if least <= 0:
        pairs = books.select("date", "title").distinct().join(subjects.select("date", "name").distinct(), "date")
        return scored(pairs).filter(F.col("conf") >= least)
    titles = cut(books.select("date", "title").distinct().withColumn("a", norm_title(F.col("title"))))
    names = cut(subjects.select("date", "name").distinct().withColumn("b", norm_title(F.col("name"))))
    plain = lambda df, c: df.filter(F.col(c).isNotNull()).select("date", F.col(c).alias("title")).distinct()
    met = cut(met_by_pieces(plain(titles, "a"), plain(names, "b"), least))
    conf = spread(possible_pairs(met, least)).withColumn("conf", title_similarity(F.col("a"), F.col("b"))).filter(F.col("conf") >= least)
    return met.join(conf, ["a", "b"]).join(titles, ["date", "a"]).join(names, ["date", "b"]).select("date", "title", "name", "conf")


def best_match(books: DataFrame, subjects: DataFrame, threshold: float = 0.9, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """Books with subject and conf of the most similar candidate (of equals the first by rank); null below the threshold.

    Books of one title and date have the same best match, and of subjects of one name and date only the first by
    rank can be one, so that pairs are made of distinct titles and names; see `similar_titles`.
    """
    first = F.min_by(F.struct("id", "rank"), F.struct("rank", "id"))
    able = subjects.filter(~F.col("series") & F.col("platform").isin(*platforms)).groupBy("name", "date").agg(first.alias("s")).select("name", "date", "s.*")
    found = similar_titles(books, able, threshold).join(able, ["name", "date"])
    best = found.groupBy("title", "date").agg(F.max_by(F.struct(F.col("id").alias("subject"), "conf"), F.struct("conf", -F.col("rank"))).alias("_m"))
    return books.join(best, ["title", "date"], "left").select(*books.columns, "_m.subject", "_m.conf")


def bigrams(title: Column) -> Column:
    """The distinct pairs of neighbouring characters of a title; a title of one character is itself."""
    n = F.length(title)
    return F.array_distinct(F.when(n < 2, F.array(title)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(title, i, F.lit(2)))))


#: Subjects that are read of each bigram at first: those of best rank. Below the number for which Spark limits groups before it shuffles.
HEAD = 128


#: Rows of a table of grams, and of one of a few columns for each set of grams, that are broadcast at most.
GRAMS, SETS = 1_000_000, 10_000


def retrieved(items: DataFrame, subjects: DataFrame, k: int = 15, head: int = HEAD, salts: int = 16) -> DataFrame:
    """(item_id, id, rank, shared, place): the k subjects that share most bigrams with each item, of equals the first by rank.

    items: a cut table (item_id, grams); subjects: a cut table (id, rank, grams). Only bigrams that both sides have
    count. Items that have the same of them have the same subjects, so that one is asked for all; and of subjects that
    have the same of them no item's best hold others than the first k. What is left is asked by `retrieved_by_lists`.
    """
    asked, held = (df.select(*own, F.explode("grams").alias("g")) for df, own in ((items, ["item_id"]), (subjects, ["id", "rank"])))
    both = cut(asked.select("g").distinct().join(held.select("g").distinct(), "g"))
    both = F.broadcast(both) if both.count() <= GRAMS else both
    sets = lambda df, own: df.join(both, "g").groupBy(*own).agg(F.array_sort(F.collect_set("g")).alias("grams"))
    wanted = cut(sets(asked, ["item_id"]))
    first = F.row_number().over(W.partitionBy("grams").orderBy("rank", "id"))
    able = cut(sets(held, ["id", "rank"]).withColumn("_p", first).filter(F.col("_p") <= k).drop("_p"))
    one = cut(wanted.groupBy("grams").agg(F.min("item_id").alias("item_id")))
    best = F.collect_list(F.struct("id", "rank", "shared", "place"))  # k at most
    found = retrieved_by_lists(one, able, k, head, salts).groupBy("item_id").agg(best.alias("_best")).join(one, "item_id").select("grams", "_best")
    found = F.broadcast(found) if one.count() <= SETS else found
    return wanted.join(found, "grams").select("item_id", F.explode("_best").alias("_b")).select("item_id", "_b.*")


def retrieved_by_lists(items: DataFrame, subjects: DataFrame, k: int, head: int, salts: int) -> DataFrame:
    """`retrieved` for items and subjects of which no two have the same bigrams, or few.

    The index is ordered by rank, and of each bigram's subjects only the first `head` are read. A subject that is not
    met there shares bigrams with longer lists alone, and is ranked behind the heads of all these: where the k-th best
    met shares as many as there are such lists and is ranked before, or more, the k are certain. For the other items a
    subject that is missing must share c of its m long lists, c being what the k-th shares; so it is on one of the
    rarest m - c + 1, and those are read whole.
    """
    asked = items.select("item_id", F.explode("grams").alias("g"))
    index = subjects.select("id", "rank", F.explode("grams").alias("g"))
    wanted = asked.select("g").distinct()
    index = index.join(wanted, "g", "left_semi")
    by_rank = W.partitionBy("g").orderBy("rank", "id")
    heads = cut(index.withColumn("_p", F.row_number().over(by_rank)).filter(F.col("_p") <= head))
    sizes = cut(index.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > head).join(heads.groupBy("g").agg(F.max("rank").alias("edge")), "g"))
    best = W.partitionBy("item_id").orderBy(F.desc("shared"), "rank", "id")

    def ranked(pairs: DataFrame) -> DataFrame:
        """The k best of distinct pairs (item_id, id), by all their bigrams."""
        both = pairs.join(subjects.select("id", "rank", F.col("grams").alias("_g")), "id").join(items.select("item_id", F.col("grams").alias("_i")), "item_id")
        return both.select("item_id", "id", "rank", F.size(F.array_intersect("_g", "_i")).alias("shared")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)

    met = asked.join(heads.select("g", "id"), "g").select("item_id", "id").distinct()
    top = cut(ranked(met))
    last = top.filter(F.col("place") == k).select("item_id", F.col("shared").alias("_c"), F.col("rank").alias("_rank"))
    long = cut(asked.join(sizes, "g"))
    state = long.groupBy("item_id").agg(F.count("*").alias("_m"), F.max("edge").alias("_edge")).join(last, "item_id", "left")
    certain = (F.col("_c") > F.col("_m")) | ((F.col("_c") == F.col("_m")) & (F.col("_rank") < F.col("_edge")))
    open_ = cut(state.filter(~F.coalesce(certain, F.lit(False))).select("item_id", (F.col("_m") - F.greatest(F.coalesce("_c", F.lit(1)), F.lit(1)) + 1).alias("_lists")))
    rarest = F.row_number().over(W.partitionBy("item_id").orderBy("n", "g"))
    whole = long.join(open_, "item_id").withColumn("_p", rarest).filter(F.col("_p") <= F.col("_lists")).select("item_id", "g")
    salted = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = index.join(whole.select("g").distinct(), "g", "left_semi").select("g", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"))
    more = salted.join(lists, ["g", "_salt"]).select("item_id", "id").union(top.join(open_, "item_id", "left_semi").select("item_id", "id")).distinct()
    return top.join(open_, "item_id", "left_anti").unionByName(ranked(more))


def shortlist(items: DataFrame, subjects: DataFrame, threshold: float = 0.5, k: int = 15, base: str = "", platforms: tuple[str, ...] = PLATFORMS, head: int = HEAD) -> DataFrame:
    """Items (item_id, title) with `single` and `series`: arrays (title, link, conf) of the retrieved subjects, best first.

    Retrieval takes the k subjects that share most bigrams with the title; see `retrieved`.
    """
    able = subjects.filter(F.col("platform").isin(*platforms)).select("id", "name", F.coalesce("series", F.lit(False)).alias("is_series"), "rank").withColumn("_n", norm_title(F.col("name")))
    able = cut(able.withColumn("grams", bigrams(F.col("_n"))).drop("_n"))
    wanted = cut(items.select("item_id", norm_title(F.col("title")).alias("_n")).select("item_id", bigrams(F.col("_n")).alias("grams")))
    top = cut(retrieved(wanted, able.select("id", "rank", "grams"), k, head))
    pairs = top.select("item_id", "id", "rank").join(able.drop("rank", "grams"), "id").join(items.select("item_id", "title"), "item_id")
    good = scored(pairs, least=threshold).filter(F.col("conf") >= threshold)
    one = F.struct((-F.col("conf")).alias("o"), "rank", "id", F.struct(F.col("name").alias("title"), F.concat(F.lit(base), F.col("id").cast("string")).alias("link"), "conf").alias("m"))
    found = good.groupBy("item_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(cond, one))), lambda s: s["m"]).alias(name) for name, cond in (("single", ~F.col("is_series")), ("series", F.col("is_series")))])
    none = F.array().cast("array<struct<title:string,link:string,conf:double>>")
    return items.join(found, "item_id", "left").withColumns({"single": F.coalesce("single", none), "series": F.coalesce("series", none)})


def incremental_links(books: DataFrame, subjects: DataFrame, force: bool = False, base: str = "", threshold: float = 0.9, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """Books with pages searched for where they never were (page null), or with `force`, if all were, also where nothing was found.

    Found pages are base + subject, others ''. Rows that need no search take no part in the matching.
    """
    if force:
        state = F.broadcast(books.agg(F.coalesce(F.bool_and(F.col("page").isNotNull()), F.lit(True)).alias("_all")))  # one row
        marked = books.crossJoin(state).withColumn("_open", F.col("page").isNull() | (F.col("_all") & (F.col("page") == ""))).drop("_all")
    else:
        marked = books.withColumn("_open", F.col("page").isNull())
    found = best_match(marked.filter("_open").select("book_id", "title", "date"), subjects, threshold, platforms).select("book_id", "subject")
    page = F.when(F.col("_open"), F.coalesce(F.concat(F.lit(base), F.col("subject").cast("string")), F.lit(""))).otherwise(F.col("page"))
    return marked.join(found, "book_id", "left").withColumn("page", page).select(books.columns)
