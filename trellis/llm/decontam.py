"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of w k-grams, with k + w - 1 equal to the shortest
span that counts (10 words), so every shared span of that length leaves a common fingerprint on the same diagonal.
Fingerprint hits are extended word by word along that diagonal. Items shorter than the span are looked up whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN, K = 10, 5
#: Benchmark text up to this size is broadcast; a larger one is joined through a shuffle.
BROADCAST_BYTES = 8 << 20
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256))
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.empty(0, np.int64)


class _Hashes(dict):
    """Word -> 64-bit hash, refilled when it grows beyond its bound."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text: ASCII lower-cased, runs of ASCII letters, digits and any other characters beyond ASCII."""
    words = (text or b"").translate(_TABLE).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _MULT
        g += h[j : j + n]
    g ^= g >> np.uint64(32)
    g *= _MIX
    g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest value of each window of w values, each position once."""
    n = len(g) - w + 1
    if n <= 0:
        return _EMPTY
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = g[j : j + n]
        np.copyto(at, np.arange(j, j + n), where=other <= low)
        np.minimum(low, other, out=low)
    return at[np.r_[True, at[1:] != at[:-1]]]


class Index:
    """Fingerprints of benchmark items: sorted hashes with their item and position, and short items by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        values, owner, place = [], [], []
        short: dict[int, list[tuple[np.uint64, int]]] = {}
        for n, h in enumerate(self.words):
            if len(h) >= span:
                g = grams(h, k)
                at = winnow(g, span - k + 1)
                values.append(g[at])
                owner.append(np.full(len(at), n))
                place.append(at)
            elif len(h):
                short.setdefault(len(h), []).append((grams(h, len(h))[0], n))
        self.value = np.concatenate(values) if values else np.empty(0, np.uint64)
        order = np.argsort(self.value, kind="stable")
        self.value = self.value[order]
        self.owner = np.concatenate(owner)[order] if values else _EMPTY
        self.place = np.concatenate(place)[order] if values else _EMPTY
        self.short = {m: (np.array([x for x, _ in sorted(v)], np.uint64), [n for _, n in sorted(v)]) for m, v in short.items()}

    def match(self, h: np.ndarray) -> tuple[int, list[str]]:
        """Words of the text inside occurrences of the items' windows, and the ids of those items."""
        n = len(h)
        hit = np.zeros(n, bool)
        found: set[int] = set()
        if len(self.value) and n >= self.span:
            g = grams(h, self.k)
            at = winnow(g, self.span - self.k + 1)
            v = g[at]
            low = np.searchsorted(self.value, v)
            here = self.value[np.minimum(low, len(self.value) - 1)] == v
            if here.any():
                self._extend(h, at[here], v[here], hit, found)
        for m, (values, owners) in self.short.items():
            g = grams(h, m)
            low, high = np.searchsorted(values, g), np.searchsorted(values, g, "right")
            for p in np.flatnonzero(high > low):
                hit[p : p + m] = True
                found.update(owners[low[p] : high[p]])
        return int(hit.sum()), sorted({self.ids[i] for i in found if self.ids[i] is not None})

    def _extend(self, h, at, v, hit, found):
        diagonals: dict[int, set[int]] = {}
        for value in np.unique(v):
            a, b = np.searchsorted(self.value, value), np.searchsorted(self.value, value, "right")
            places, owners, mine = self.place[a:b], self.owner[a:b], at[v == value]
            for item in np.unique(owners):
                own = places[owners == item]
                for i in range(0, len(mine), 1024):
                    diagonals.setdefault(int(item), set()).update(np.unique(mine[i : i + 1024, None] - own).tolist())
        for item, offsets in diagonals.items():
            words = self.words[item]
            for d in offsets:
                a, b = max(0, d), min(len(h), d + len(words))
                same = np.r_[False, h[a:b] == words[a - d : b - d], False]
                edge = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edge[::2], edge[1::2]):
                    if e - s >= self.span:
                        hit[a + s : a + e] = True
                        found.add(item)


_OUT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _batch(b: pa.RecordBatch, marks: list[tuple[int, int, list[str]]], head: int) -> pa.RecordBatch:
    words, hits, ids = zip(*marks) if marks else ((), (), ())
    cols = [*b.columns[:head], pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string()))]
    return pa.record_batch(cols, names=[*b.schema.names[:head], "n_words", "n_hit", "item_ids"])


def _mark(h: np.ndarray, index: Index) -> tuple[int, int, list[str]]:
    return (len(h), *index.match(h))


def mark(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_words, n_hit, item_ids): row is the whole row of docs as a struct, item_ids the sorted items with a window in its text.

    Null and wordless texts have no words and no hits. Null and wordless items match nothing; hits of an item
    without an id count as hits but name no item. Repeated items count once by id; repeated rows each come back.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = T.StructType([rows.schema["row"], *_OUT])
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([(r[0], None if r[1] is None else r[1].encode()) for r in items.collect()])

        def near(batches):
            index = Index(sent.value, span, k)
            for b in batches:
                yield _batch(b, [_mark(word_hashes(t), index) for t in b.column(1).cast(pa.binary()).to_pylist()], 1)

        return rows.mapInArrow(near, schema)

    w = span - k + 1
    short = [r[0] for r in items.mapInArrow(_lengths(span), "m int").distinct().collect()]  # at most span - 1 numbers
    keyed = rows.withColumn("key", F.xxhash64("text"))  # texts that share a key share candidates, which are then checked exactly

    def prints(batches):
        for b in batches:
            keys, hashes = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                h = word_hashes(t)
                g = grams(h, k)
                own = np.unique(np.concatenate([g[winnow(g, w)], *(grams(h, m) for m in short)]))
                keys.append(np.full(len(own), key))
                hashes.append(own.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(keys) if keys else _EMPTY), pa.array(np.concatenate(hashes) if hashes else _EMPTY)], names=["key", "hash"])

    def item_prints(batches):
        for b in batches:
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                h = word_hashes(t)
                g = grams(h, k)
                own = np.unique(g[winnow(g, w)] if len(h) >= span else grams(h, len(h)) if len(h) else g[:0]).view(np.int64)
                ids += [i] * len(own)
                hashes += own.tolist()
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(hashes, pa.int64())], names=["item_key", "hash"])

    keyed_items = items.withColumn("text_hash", F.xxhash64("text"))
    theirs = keyed_items.select(F.concat_ws(":", "text_hash", "item_id").alias("item_key"), "text").mapInArrow(item_prints, "item_key string, hash bigint")
    ours = keyed.select("key", "text").mapInArrow(prints, "key bigint, hash bigint")
    pairs = ours.join(theirs, "hash").select("key", "item_key").distinct()
    texts = keyed_items.select(F.concat_ws(":", "text_hash", "item_id").alias("item_key"), F.struct("item_id", "text").alias("item"))
    candidates = pairs.join(texts, "item_key").groupBy("key").agg(F.collect_list("item").alias("items"))

    def far(batches):
        for b in batches:
            out = []
            for t, own in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                index = Index([(x["item_id"], None if x["text"] is None else x["text"].encode()) for x in own or []], span, k)
                out.append(_mark(word_hashes(t), index))
            yield _batch(b, out, 1)

    return keyed.join(candidates, "key", "left").select("row", "text", "items").mapInArrow(far, schema)


def _lengths(span: int):
    def run(batches):
        for b in batches:
            found = {len(word_hashes(t)) for t in b.column(1).cast(pa.binary()).to_pylist()}
            yield pa.record_batch([pa.array([m for m in found if 0 < m < span], pa.int32())], names=["m"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a benchmark window; columns as given."""
    return mark(docs, benchmark, **options).where("n_hit = 0").select("row.*")
