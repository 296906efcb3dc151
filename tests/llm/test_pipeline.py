from collections import Counter

from corpus_pipeline import STAGES, run
from tests.llm.helpers import ODD, documents


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        docs = spark.createDataFrame(after.collect(), docs.schema)
        now = {r.doc_id: r for r in docs.collect()}
        assert now.keys() < before.keys() or (name == "lines" and now.keys() == before.keys() and now != before)
        if name == "quality":
            known = [(d in now) == bool(q) for d, q in labels.items()]
            assert sum(known) > 0.98 * len(known)
        elif name != "lines":
            assert all(before[d] == r for d, r in now.items())
        before = now
    packed = STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert run(spark, sf).count() == len(packed)


def test_odd_rows(spark, sf):
    for rows in (documents(spark, ODD), documents(spark, ODD).filter("doc_id > 99")):
        docs = rows
        for _, stage in STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == rows.columns
        packed, left = STAGES[-1][1](spark, docs, sf).collect(), docs.collect()
        ids = lambda found: Counter(r.doc_id for r in found)
        assert ids(packed).keys() == ids(left).keys() <= {r[0] for r in ODD} and sum(r.length for r in packed if r.start == 0) > 0 or not left
        # a null or repeated id is as good as any other, and a document is packed once
        assert all(n == ids(left)[d] for d, n in ids(r for r in packed if r.start == 0).items())
