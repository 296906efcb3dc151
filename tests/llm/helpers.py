"""Small tables that the tests of several operators use."""

LONG = "deep river " * 4000


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or ""), 7, "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int, h int, shard string")


ODD = [(1, None), (2, ""), (3, "   \n \t"), (None, "a text without an id"), (4, LONG), (4, LONG), (5, "one"), (6, "ünï \U00020b9f cödé"), (7, None, None)]
