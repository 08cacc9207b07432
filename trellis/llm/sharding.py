"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split on another bit.

Bucket sizes are partial sums by prefix; rows are joined with the finished directory, never gathered. The hash is
the row key's, 60 bits; a bucket that holds one key too often to split on it goes on with 60 bits of a number
that each row has for itself, so every shard fits unless one row alone is larger than the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import discard, materialize

LIMIT = 64 << 20
BITS, STEP = 60, 12


def _sixty(c) -> F.Column:
    return F.conv(F.substring(F.md5(c), 1, BITS // 4), 16, 10).cast("bigint")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard (its prefix bits as text), depth, n_bytes (UTF-8 text) and shard_bytes of every row.

    Null and empty texts have 0 bytes. A null doc_id hashes like an empty key. Repeated rows each come back and share a
    shard as long as it fits. An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", size.alias("n_bytes"), _sixty(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows, "shard-rows").withColumn("g", _sixty(F.col("uid").cast("string")))

    def bits(depth):
        """The first ``depth`` of the 120 bits, as text."""
        text = F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lpad(F.bin("g"), BITS, "0"))
        return F.substring(text, 1, depth)

    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = 0
    while total > limit << depth and depth < BITS:
        depth += 1
    depth = min(depth + 4, 2 * BITS)
    # Each round sizes every prefix of the rows that are still unplaced, from the depth reached so far to `depth`.
    low, leaves, open_rows = 0, None, rows.select("n_bytes", "h", "g")
    while True:
        cells = open_rows.select("n_bytes", bits(depth).alias("cell")).groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        sized = cells.select("b", "n", F.explode(F.transform(F.sequence(F.lit(low), F.lit(depth)), lambda d: F.substring(F.col("cell"), F.lit(1), d))).alias("shard")).groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        sized = materialize(sized, "directory")
        whole = (F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.length("shard") == 2 * BITS)
        # A leaf fits, and the bucket it was split from did not.
        parent = sized.where(~whole).select(F.col("shard").alias("_p"))
        fits = sized.where(whole)
        found = fits.where(F.length("shard") == low) if low == 0 else None
        split = fits.where(F.length("shard") > low).join(parent, F.substring(F.col("shard"), F.lit(1), F.length("shard") - 1) == F.col("_p"), "left_semi")
        found = split if found is None else found.unionByName(split)
        found = materialize(found.select("shard", "shard_bytes"), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = sized.where(~whole & (F.length("shard") == depth)).select(F.col("shard").alias("cell"))
        if not large.limit(1).count():
            break
        open_rows = materialize(open_rows.join(large, bits(depth) == F.col("cell"), "left_semi"), "unplaced")
        low, depth = depth, min(depth + STEP, 2 * BITS)
        discard(sized)
    # Rows find their leaf by the prefix of each depth that occurs: one equi-join, as a row has one leaf alone.
    depths = sorted(r[0] for r in leaves.select(F.length("shard")).distinct().collect())  # at most 121 numbers
    leaves = leaves.withColumn("depth", F.length("shard"))
    if not depths:
        return rows.select("doc_id", F.lit("").alias("shard"), F.lit(0).alias("depth"), "n_bytes", F.lit(0).cast("bigint").alias("shard_bytes"))
    tried = rows.select("doc_id", "n_bytes", bits(2 * BITS).alias("_b")).withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("shard", F.expr("substring(_b, 1, depth)"))
    return tried.join(leaves, ["shard", "depth"]).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes")
