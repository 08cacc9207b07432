"""Ranked lexical search as a blocked sparse matrix product.

Rows of the left matrix are items, with how often each term occurs in the item; rows of the right one are terms, with the int64 impact of the
term on each document. Items come in blocks of bounded text, so the left block and its vocabulary are broadcast; documents come in blocks
of one Arrow batch. For each item the rows of its terms are merged into one accumulator over the block's documents (Gustavson), the best are
kept while the blocks of a task pass by, and the best of tasks are reduced in two levels, so no group grows with the corpus.

Documents are read and split into terms once for each block of items; what the product reads is a written table of their terms that the items have.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import materialize

TOP = 10
#: Text of the items in one block; one item may be longer and is then a block of its own.
BLOCK_BYTES = 8 << 20
#: Groups of tasks whose best rows are reduced first.
FAN = 64
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII."""
    return _TERM.findall(text.lower()) if text else []


class Items:
    """One block of items as a sparse matrix: term ids and multiplicities of row i from starts[i] on; the vocabulary numbers the columns."""

    def __init__(self, rows: list[tuple[int, object, bytes | None]]):
        self.uids, self.ids = [r[0] for r in rows], [r[1] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        starts, columns, times = [0], [], []
        for _, _, text in rows:
            for term, n in Counter(terms(text)).items():
                columns.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                times.append(n)
            starts.append(len(columns))
        self.starts, self.columns, self.times = starts, np.array(columns, np.int64), np.array(times, np.int64)


def weights(df: dict[int, int], size: int, n_docs: int) -> np.ndarray:
    """The weight of each of size terms from its document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each entry (term weight, occurrences in the document, document length)."""
    exact = 75 * int(length.max(initial=0)) * n_docs < 2**63
    m = 25 + (75 * length * n_docs if exact else 75 * length.astype(object) * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m.astype(np.int64)))


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n and the distinct terms (ids, occurrences) of documents with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number = vocabulary.value.get
        lists = pa.list_(pa.int32())
        for b in batches:
            keep, lengths, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                counts = Counter(map(number, found))
                counts.pop(None, None)
                keep.append(i)
                lengths.append(len(found))
                ids.append(list(counts))
                tfs.append(list(counts.values()))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(ids, lists), pa.array(tfs, lists)], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tf array<int>")


def _by_id(column: pa.Array) -> np.ndarray:
    """Positions of ids in ascending order, nulls last."""
    if not column.null_count and pa.types.is_integer(column.type):
        return np.argsort(column.to_numpy(), kind="stable")
    ids = column.to_pylist()
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i])), np.int64)


def block_scores(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, length: np.ndarray, at: np.ndarray, columns: np.ndarray, tf: np.ndarray):
    """One row of the product for each item: int64 scores over the block's documents. at, columns and tf are its entries (document, term, occurrences)."""
    value = impacts(weight[columns], tf, length[at], n_docs, n_terms)
    order = np.argsort(columns, kind="stable")
    at, value = at[order], value[order]
    row = np.searchsorted(columns[order], np.arange(len(weight) + 1)).tolist()
    own, times = items.columns.tolist(), items.times.tolist()
    for i in range(len(items.ids)):
        scores = np.zeros(len(length), np.int64)
        for j in range(items.starts[i], items.starts[i + 1]):
            a, b = row[own[j]], row[own[j] + 1]
            if a < b:  # a document has a term once, so no position comes twice
                scores[at[a:b]] += times[j] * value[a:b]
        yield i, scores


def _best(postings: DataFrame, shared, weight, n_docs: int, n_terms: int, k: int, item_kind: str) -> DataFrame:
    """uid, item_id, doc_id, score and task: the k best documents of each item in each task."""
    kind = postings.schema["doc_id"].dataType.simpleString()

    def run(batches):
        items, w = shared.value, weight.value
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        best: list[list[tuple]] = [[] for _ in items.ids]
        schema = None
        for b in batches:
            schema = b.schema.field(0).type
            order = _by_id(b.column(0))
            b = b.take(pa.array(order))
            ids, length = b.column(0).to_pylist(), b.column(1).to_numpy()
            found = b.column(2)
            at = np.repeat(np.arange(len(ids)), np.diff(found.offsets.to_numpy()))
            columns, tf = found.flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)
            for i, scores in block_scores(items, w, n_docs, n_terms, length, at, columns, tf):
                own = best[i]
                near = np.flatnonzero(scores >= (-own[-1][0] if len(own) == k else 1))
                if len(near):
                    near = near[np.argsort(-scores[near], kind="stable")[:k]]
                    own += [(-int(scores[d]), ids[d] is None, 0 if ids[d] is None else ids[d]) for d in near]
                    own.sort()
                    del own[k:]
        rows = [(items.uids[i], items.ids[i], None if null else d, -score, task) for i, own in enumerate(best) for score, null, d in own]
        if rows:
            cols = list(zip(*rows))
            made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], item_type), pa.array(cols[2], schema), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())]
            yield pa.record_batch(made, names=["uid", "item_id", "doc_id", "score", "task"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    item_type = to_arrow_schema(_parse_datatype_string(f"x {item_kind}")).field(0).type
    return postings.where(F.size("terms") > 0).mapInArrow(run, f"uid bigint, item_id {item_kind}, doc_id {kind}, score bigint, task int")


def _blocks(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """items with uid and block, and the number of blocks: as many as hold no more than twice the limit each, unless one item alone is longer."""
    own = materialize(items.select(F.monotonically_increasing_id().alias("uid"), "item_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")), "items")
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not total[1]:
        return own.withColumn("block", F.lit(0)), 0
    n = -(-max(total[0], 1) // limit)
    while True:
        dealt = own.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)))
        over = dealt.groupBy("block").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where(f"s > {2 * limit} AND n > 1").limit(1).count()
        if not over:
            return dealt, n
        n *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of items, scores above 0 only.

    docs has doc_id and text, items item_id and text; other columns are left alone. Equal scores go by ascending doc_id, null ids last. A null or
    empty text has no terms: such a document isn't counted, such an item has no rows. Repeated rows count each: a document twice in docs can
    take two ranks, an item twice in items is ranked twice. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = (x.schema[c].dataType.simpleString() for x, c in ((items, "item_id"), (docs, "doc_id")))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    dealt, n_blocks = _blocks(items, block_bytes)
    for block in range(n_blocks):
        # Bounded by the block's text.
        left = Items([tuple(r) for r in dealt.where(F.col("block") == block).orderBy("uid").select("uid", "item_id", "text").collect()])
        if not left.vocabulary:
            continue
        postings = materialize(_postings(docs, spark.sparkContext.broadcast(left.vocabulary)), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = {r[0]: r[1] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        weight = spark.sparkContext.broadcast(weights(df, len(left.vocabulary), n_docs))
        best = _best(postings, spark.sparkContext.broadcast(left), weight, n_docs, n_terms, k, item_kind)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = best.withColumn("group", F.col("task") % FAN)
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy("uid", "group").orderBy(*order))).where(f"_r <= {k}")
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).where(f"rank <= {k}")
        out = out.unionByName(last.select("item_id", "rank", "doc_id", "score"))
    return out
