"""SimHash near-duplicates: 64-bit fingerprints of word shingles, searched with BK-trees.

A BK-tree over all fingerprints would visit most of its nodes (random fingerprints lie about 32 bits apart and
the search keeps every edge within the radius of that), and it could not be broadcast: it grows with the corpus.
So fingerprints are first dealt into shards by the pigeonhole rule (of 5 bit blocks, two fingerprints that differ
in at most 4 bits share one whole block), each shard gets its own BK-tree, and the trees travel with the shuffle
instead of a broadcast. Shards above ``split_over`` members are dealt once more by the remaining bits, again
without losing a pair.

Copy groups (the pipeline's) add links of Jaccard similarity: 4 bits only reach copies that are nearly equal. Texts that
share one of 32 bands of 6 minimum hashes of their 5-word shingles are candidates (a pair at similarity 0.8 is missed with
probability (1 - 0.8^6)^32, 6e-5), and a candidate pair is linked if the exact similarity of its shingle sets is 0.8 or more.
First each text is compared with the most connected text of each of its bands (of copies of one text, that text), which
gathers most groups; pairs that links already connect needn't be looked at. What is left apart in a band of CROWD texts or
fewer is compared in pairs. In larger bands a main group has a common set: the shingles of one pivot text and all that more
than CROWD of the bands' texts hold. Of a text x, 0.8 must be shared by whatever is alike to it. What the common set can't give
must come from other shingles, so partners share one at least of all but that many (less one), rarest first: an equi-join of
keys that CROWD texts or fewer hold. If the common set gives 0.8 of x, it also suffices for texts that are small enough, and x is compared with those.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import components, materialize, scratch

WORDS, RADIUS, SEED = 4, 4, 42
#: Copy groups: words of a shingle, smallest Jaccard similarity in tenths, minimum hashes of a band and bands.
COPY_WORDS, ALIKE, ROWS, BANDS = 5, 8, 6, 32
#: Texts of one band that are compared in pairs.
CROWD = 24
#: Text hashes up to this number are broadcast to find their texts (8 bytes each); more are joined through a shuffle.
BROADCAST_HASHES = 2_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 16


def _shingles(text: bytes | None, width: int) -> list[int]:
    """Hashes of the text's shingles of ``width`` words; fewer words: of the whole sequence."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return [h(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprint(text: bytes | None, width: int = WORDS) -> int:
    """Signed 64-bit SimHash of the text's shingles of ``width`` words; fewer words: the whole sequence; none: 0."""
    return _simhash(_shingles(text, width))


def _simhash(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        part = np.array(hashes[i : i + _STEP], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, fp) for every row; null and empty texts get fingerprint 0."""
    return _marked(docs, width).select("doc_id", "fp")


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, fp) for every row."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            yield pa.record_batch([b.column(0), b.column(1), pa.array([fingerprint(t, width) for t in texts], pa.int64())], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def copy_shingles(text: bytes | None, four: list[int] | None = None) -> np.ndarray:
    """Distinct hashes of the text's 5-word shingles; fewer words: of the whole sequence; none: none.

    A 5-word shingle is two consecutive 4-word shingles (four, if at hand), so its hash is made of theirs.
    """
    h = np.array(_shingles(text, WORDS) if four is None else four, np.uint64)
    if len(h) > 1:
        h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        h ^= h >> np.uint64(31)
    return np.unique(h)


_turned: dict[tuple[int, int], np.ndarray] = {}


def bands(hashes: np.ndarray, rows: int = ROWS, count: int = BANDS) -> list[int]:
    """One signed key for each of ``count`` bands of ``rows`` minimum hashes; none for a text without words."""
    if not len(hashes):
        return []
    if (rows, count) not in _turned:
        _turned[rows, count] = np.random.default_rng([SEED, rows]).integers(1, 1 << 63, (2, rows * count, 1), dtype=np.uint64) | np.uint64(1)
    mul, add = _turned[rows, count]
    low = np.full(rows * count, (1 << 64) - 1, np.uint64)
    step = max(64, (1 << 17) // (rows * count))
    for i in range(0, len(hashes), step):
        np.minimum(low, (hashes[None, i : i + step] * mul + add).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(r.tobytes(), j) - (1 << 63) for j, r in enumerate(low.reshape(count, rows))]


class BKForest:
    """BK-trees of many shards side by side: children are keyed by their integer Hamming distance to the parent.

    Built and searched a level at a time over arrays, so one numpy call serves every tree of a batch.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: sorted shard numbers; fp: uint64 fingerprints, aligned."""
        self.fp = fp
        n = len(fp)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, sizes)
        keys, nodes = [], []
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[rest]
        while len(rest):
            key = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.r_[True, key[1:] != key[:-1]]
            child = rest[head]
            keys.append(key[head])
            nodes.append(child)
            at = np.repeat(child, np.diff(np.r_[np.flatnonzero(head), len(rest)]))[~head]
            rest = rest[~head]
        self.key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], (np.concatenate(nodes)[order] if nodes else np.empty(0, np.int64))

    def near(self, query: np.ndarray, radius: int):
        """Pairs (query, node) of positions within the radius, following only edges within the radius, in chunks."""
        q, node = query, self.root[query]
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
            q = np.repeat(q, many)
            node = self.child[np.repeat(low, many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)]


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root of its group within the shard): they connect exactly what the pairs within the radius connect."""
    forest, label = BKForest(shard, fp), np.arange(len(fp))
    largest = int(np.bincount(forest.root).max()) if len(fp) else 1
    chunk = max(1, min(4096, 2_000_000 // largest))  # bounds the (query, node) pairs held at once
    for i in range(0, len(fp), chunk):
        for a, b in forest.near(np.arange(i, min(i + chunk, len(fp))), radius):
            while True:
                la, lb = label[a], label[b]
                if (la == lb).all():
                    break
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label[label] != label).any():
                    label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _searched(radius: int, flush: int):
    names = ["a", "b"]

    def out(shard, fp):
        a, b = shard_links(shard, fp.view(np.uint64), radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, full = 0, flush
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows < full:
                continue
            shard, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if cut:
                yield out(shard[:cut], fp[:cut])
            held, rows = [(shard[cut:], fp[cut:])], len(shard) - cut
            full = max(flush, 2 * rows)
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return run


def _blocks(total: int, parts: int) -> list[tuple[int, int]]:
    edges = [round(total * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shards(distinct_fp: DataFrame, radius: int = RADIUS, split_over: int = 4096) -> DataFrame:
    """(shard, fp): every pair within the radius meets in at least one shard."""
    parts = _blocks(64, radius + 1)

    def bits(c, start, width):
        return F.shiftrightunsigned(c, start).bitwiseAND(F.lit((1 << width) - 1))

    fp = F.col("fp")
    one = distinct_fp.select("fp", F.explode(F.array(*[F.struct(F.lit(j).alias("block"), bits(fp, s, w).alias("value")) for j, (s, w) in enumerate(parts)])).alias("k")).select("fp", "k.block", "k.value")
    large = one.groupBy("block", "value").count().where(F.col("count") > split_over).select("block", "value", F.lit(True).alias("large"))
    # Beside the block they share, two near fingerprints also share one of 5 parts of the remaining bits.
    inner = []
    for j, (s, w) in enumerate(parts):
        positions = [p for p in range(64) if not s <= p < s + w]
        for i, (a, n) in enumerate(_blocks(len(positions), radius + 1)):
            own = positions[a : a + n]
            mask = sum(1 << p for p in own)
            inner.append((j, i, mask - (1 << 64) if mask >= 1 << 63 else mask))
    subs = F.array(*[F.struct(F.lit(i).alias("sub"), fp.bitwiseAND(F.coalesce(*[F.when(F.col("block") == j, F.lit(m)) for j, k, m in inner if k == i])).alias("part")) for i in range(radius + 1)])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("part")))
    dealt = one.join(large, ["block", "value"], "left").withColumn("s", F.explode(F.when(F.col("large"), subs).otherwise(whole)))
    return dealt.select("block", "value", F.col("s.sub").alias("sub"), F.col("s.part").alias("part"), "fp")


def _rooted(marked: DataFrame, radius: int, split_over: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) for every fingerprint: root is the same for all that links of at most ``radius`` bits, or more links (a, b), connect."""
    nodes = marked.select("fp").distinct()
    dealt = shards(nodes, radius, split_over)
    dealt = dealt.select(F.xxhash64("block", "value", "sub", "part").alias("shard"), "fp")
    links = dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_searched(radius, 200_000), "a bigint, b bigint")
    roots = components(links if more is None else links.unionByName(more))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WORDS, radius: int = RADIUS, split_over: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable by links of at most ``radius`` bits.

    Null and empty texts share fingerprint 0 and link like any other. Repeated rows each come back. A null
    doc_id takes part; a group of null ids alone gets a null component_id. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    grouped = marked.groupBy("fp").agg(F.min("doc_id").alias("low")).join(_rooted(marked, radius, split_over), "fp")
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = grouped.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def _copy_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, bands) for every row."""

    def run(batches):
        for b in batches:
            fps, keys = [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                four = _shingles(t, WORDS)
                fps.append(_simhash(four))
                keys.append(bands(copy_shingles(t, four)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(h, s) for each text hash (column h): the shingle set of its text."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([copy_shingles(t).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))], names=["h", "s"])

    few = hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    return texts.mapInArrow(run, "h bigint, s array<bigint>").dropDuplicates(["h"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, fa, fb), each once, with alike: whether the exact Jaccard similarity of their texts is ALIKE tenths or more."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.select("a", "b", "fa", "fb", (10 * inter >= ALIKE * (F.size("sa") + F.size("sb") - inter)).alias("alike")), "compared")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("alike").select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) after more links between fingerprints."""
    linked = components(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(links))
    return materialize(roots.select("fp").join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def copy_groups(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root): roots are equal where op10's links or links of Jaccard similarity connect."""
    with scratch() as own:
        marked = materialize(_copy_marks(docs), "fingerprints")
        w = Window.partitionBy("band")
        placed = marked.dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("h"), "fp", F.explode("bands").alias("band"))
        placed = materialize(placed.withColumn("n", F.count("*").over(w)).where("n > 1"), "bands")
        score = placed.groupBy("h").agg(F.sum("n").alias("score"))
        placed = materialize(placed.join(score, "h").withColumn("first", F.max(F.struct("score", "h", "fp")).over(w)), "bands")
        sets = materialize(_shingle_sets(docs, placed.select("h").distinct()), "shingles")
        star = placed.select(F.col("h").alias("a"), F.col("fp").alias("fa"), F.col("first.h").alias("b"), F.col("first.fp").alias("fb")).where("a <> b").distinct()
        star = _compared(star, sets)
        roots = materialize(_rooted(marked, RADIUS, 4096, _links(star)), "roots")
        tried = placed.join(roots, "fp")
        mixed = tried.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        tried = materialize(tried.join(mixed, "band"), "mixed")
        rest = _within(tried.where(F.col("n") <= crowd), ["band"]).unionByName(_beyond_common(tried.where(F.col("n") > crowd), sets, crowd)).distinct()
        done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        roots = linked(roots, _links(_compared(rest.join(done, ["a", "b"], "left_anti"), sets)))
        own.keep(marked, roots)
    return marked.drop("bands"), roots


def _sides(texts: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(texts.select(*key, F.col("h").alias(c), F.col("fp").alias(f"f{c}"), F.col("root").alias(f"r{c}")) for c in "ab")


def _within(texts: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b, fa, fb) of texts (h, fp, root) of one key and different roots."""
    x, y = _sides(texts, key)
    return x.join(y, key).where("a < b AND ra <> rb").select("a", "b", "fa", "fb")


def _beyond_common(tried: DataFrame, sets: DataFrame, crowd: int) -> DataFrame:
    """Pairs of crowded bands that may be alike, by what they share beyond the common set of their band's main group."""
    main = tried.where("h = first.h").select("band", F.col("root").alias("main"))
    tried = materialize(tried.join(main, "band"), "crowded")
    pivots = tried.where("root = main").groupBy("main").agg(F.max(F.struct("score", "h", "fp")).alias("p")).select("main", F.col("p.h").alias("p"), F.col("p.fp").alias("fp_p"))
    own = tried.select("main", "h", "fp", "root").distinct().join(pivots.select("main", "p"), "main")
    own = own.join(sets, "h").join(sets.select(F.col("h").alias("p"), F.col("s").alias("sp")), "p")
    held = F.size("s") - F.size(F.array_except("s", "sp"))
    alike = 10 * held >= ALIKE * (F.size("s") + F.size("sp") - held)
    own = own.select("main", "p", "h", "fp", "root", F.size("s").alias("size"), F.array_except("s", "sp").alias("beyond"), alike.alias("alike"))
    own = materialize(own, "beyond-pivot")
    keys = own.select("main", "h", "fp", "root", "size", "alike", F.explode_outer("beyond").alias("k"))
    often = keys.where("k IS NOT NULL").groupBy("main", "k").agg(F.count("*").alias("n"))
    rare = F.when(F.col("n") <= crowd, F.struct("n", "k"))
    own = materialize(keys.join(often, ["main", "k"], "left").groupBy("main", "h", "fp", "root", "size", "alike").agg(F.array_sort(F.collect_list(rare)).alias("rare")), "rare")
    held = F.col("size") - F.size("rare")
    missing = F.greatest(F.lit(1), F.ceil(F.col("size") * ALIKE / 10).cast("int") - held)
    keys = own.where(missing <= F.size("rare")).select("main", "h", "fp", "root", F.explode(F.slice("rare", F.lit(1), F.size("rare") - missing + 1)).alias("k")).select("main", "h", "fp", "root", "k.k")
    shared = keys.groupBy("main", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("main", "k")
    pairs = _within(materialize(keys.join(shared, ["main", "k"]), "beyond-pivot"), ["main", "k"])
    other = own.where("root <> main")
    near = other.where("alike").join(pivots, "main").where("h <> p").select("h", "fp", F.col("p").alias("h2"), F.col("fp_p").alias("fp2"))
    x = other.withColumn("held", held).where(10 * F.col("held") >= ALIKE * F.col("size")).where("NOT alike").select("main", "h", "fp", "root", "size", "held")
    y = own.select("main", F.col("h").alias("h2"), F.col("fp").alias("fp2"), F.col("root").alias("root2"), F.col("size").alias("size2"))
    small = x.join(y, "main").where(f"root <> root2 AND 10 * size2 >= {ALIKE} * size AND {ALIKE} * (size + size2) <= {10 + ALIKE} * held").select("h", "fp", "h2", "fp2")
    either = lambda a, b: F.when(F.col("h") < F.col("h2"), F.col(a)).otherwise(F.col(b))
    near, small = (df.select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b"), either("fp", "fp2").alias("fa"), either("fp2", "fp").alias("fb")) for df in (near, small))
    return pairs.unionByName(near).unionByName(small)


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of copy_groups, of its smallest doc_id (null only if it has no other); columns as given.

    Null and wordless texts are one group, as their fingerprints link. Of equal rows one stays; an empty table gives no rows.
    """
    return _one_each(docs, *copy_groups(docs, **options))


def drop_near_duplicates(docs: DataFrame, width: int = WORDS, radius: int = RADIUS, split_over: int = 4096) -> DataFrame:
    """One row of docs for each group of near copies, of its smallest doc_id (null only if it has no other); columns as given."""
    marked = materialize(_marked(docs, width), "fingerprints")
    return _one_each(docs, marked, _rooted(marked, radius, split_over))


def _one_each(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    # One key for the join and for repeated rows, null ids included, so the texts are shuffled once. Rows equal in both are one document.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    kept = marked.join(roots, "fp").groupBy("root").agg(F.min(row).alias("r"))
    key = [F.coalesce(F.col("r.doc_id").cast("string"), F.lit("")).alias("_k"), F.col("r.no_id").alias("_n"), F.col("r.text_hash").alias("_h")]
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("doc_id").isNull().alias("_n"), F.xxhash64("text").alias("_h"))
    names = ["_k", "_n", "_h"]
    return own.join(kept.select(*key), names, "left_semi").dropDuplicates(names).select("row.*")
