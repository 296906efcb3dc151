import struct
from collections import Counter
from zlib import crc32

import xxhash

from bookflow.llm import sharding
from tests.llm.helpers import ODD, documents


def check(docs, rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(df).collect()
    check(df.collect(), rows)
    assert 0.015 < sum(r.grown_shard == 24 for r in rows) / len(rows) < 0.075
    grown = {r.doc_id: r.shard for r in sharding.shard(df, 25).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 3 * min(sizes.values())


def test_odd_rows(spark):
    df = documents(spark, ODD * 3)
    check(df.collect(), sharding.shard(df).collect())
    assert sharding.shard(df.filter("doc_id > 100")).count() == 0


def plain_jump(doc_id, shards):
    """The paper's loop over whole numbers, with the draws of two hashes: the bucket, and the next jump."""
    key = xxhash.xxh64_digest(struct.pack("<q", doc_id), 42)[::-1]
    seed = xxhash.xxh64_intdigest(key, 42)
    b, j, step = -1, 0, 0
    while j < shards:
        b, step = j, step + 1
        draw = xxhash.xxh64_intdigest(struct.pack("<i", step), seed) >> 33
        j = int((b + 1) * (2.0**31 / (draw + 1)))
    return b, j


def test_against_the_plain_loop(spark):
    ids = [*range(500), -1, -(2**63), 2**63 - 1, 2**60 + 1]
    for shards in (1, 2, 24, 25, 300):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(documents(spark, [(d, "t") for d in ids]), shards).collect()}
        for d in ids:
            b, j = plain_jump(d, shards)
            assert got[d] == (b, shards if j == shards else b) and plain_jump(d, shards + 1)[0] == got[d][1]
