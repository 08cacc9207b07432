import hashlib
from collections import defaultdict

from trellis.llm import sharding


def brute(rows, limit):
    """Split a bucket on its next bit until it fits or holds one row."""
    def split(prefix, members):
        size = sum(n for _, n, _ in members)
        if size <= limit or len(members) == 1:
            return [(d, prefix, len(prefix), n, size) for d, n, _ in members]
        return [x for bit in "01" if (own := [m for m in members if m[2][len(prefix)] == bit]) for x in split(prefix + bit, own)]

    hashed = [(d, len((t or "").encode()), f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}") for d, t in rows]
    return sorted(split("", hashed), key=str)


def test_equal_brute_force(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for limit in (10**9, 50_000, 3_000):
        assert sorted(map(tuple, sharding.shards(docs, limit).collect()), key=str) == brute(rows, limit)
    assert sharding.shards(no_docs).count() == 0


def test_one_key_over_the_limit(spark, edge_docs):
    same = spark.createDataFrame([(1, "x" * 100)] * 300 + [(2, None), (3, "y" * 5000)], "doc_id bigint, text string")
    got = sharding.shards(same, 1000).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
        assert r.depth == len(r.shard)
    assert len(got) == 302 and all(r.shard_bytes == size[r.shard] for r in got)
    assert all(n <= 1000 or n == 5000 for n in size.values())
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    assert sharding.shards(edge_docs, 100).count() == edge_docs.count()
