import random

import numpy as np
import xxhash

from trellis.llm import simhash


def brute_print(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(rows):
    """rows: (doc_id, fp); smallest doc_id reachable by links of at most 4 bits."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return sorted(((d, f, low.get(find(f))) for d, f in rows), key=str)


def collected(df):
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect()), key=str)


def test_fingerprints(edge_docs):
    texts = {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None and r.text and len(r.text) < 1000}
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(edge_docs).collect()}
    for k, t in texts.items():
        assert got[k] == brute_print(t), t
    assert got[0] == got[1] == 0


def test_groups_equal_brute_force(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for split in (4096, 2):
        for d in (docs, edge_docs):
            rows = [(r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(d).collect()]
            assert collected(simhash.near_duplicates(d, split_over=split)) == brute_groups(rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns


def test_shards_meet_and_forest_finds_every_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for k in range(1, 8):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    forest = simhash.BKForest(np.zeros(len(arr), np.int64), arr)
    pairs = {tuple(sorted((int(a), int(b)))) for q, n in forest.near(np.arange(len(arr)), 4) for a, b in zip(q, n)}
    assert pairs == {(j, i) for i in range(len(arr)) for j in range(i) if (int(arr[i]) ^ int(arr[j])).bit_count() <= 4}
    for split in (10**9, 3):
        met = simhash.shards(spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp bigint"), split_over=split).toPandas()
        rows = met.groupby(["block", "value", "sub", "part"])["fp"].apply(set)
        seen = {(a, b) for g in rows for a in g for b in g}
        assert all((int(arr.view(np.int64)[i]), int(arr.view(np.int64)[j])) in seen for i, j in pairs)


def test_null_and_repeated_ids_of_unlike_text_survive(spark):
    text = lambda c: " ".join(f"{c}{chr(97 + i)}" for i in range(20))
    rows = [(None, text("p")), (None, text("q")), (None, text("q")), (5, text("r")), (5, text("s")), (6, text("r")), (2, text("s")), (None, text("s")), (None, None), (None, "")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    named = [tuple(r) for r in kept if r.text]
    assert sorted(named, key=str) == sorted([(None, text("p")), (None, text("q")), (5, text("r")), (2, text("s"))], key=str)
    assert len(kept) == 5


def test_copies_of_jaccard_similarity_are_found(spark):
    """Kept documents are exactly one of each component of pairs with exact 5-word Jaccard >= 0.8 or 4 bits."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for n in (2, 3, 4, 5, 8, 30):
            other = list(base)
            for at in rng.sample(range(200), n):
                other[at] = word()
            texts.append(other)
    passage = [word() for _ in range(160)]
    texts += [[*passage[: 100 + i], *(word() for _ in range(60 - i))] for i in range(0, 60, 2)]  # share much, some of them enough
    texts += [passage[i : 160 - i] for i in range(0, 40, 3)]  # within each other
    texts += [["a", "b"], ["a", "b"], []]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(len(t) - 4, min(len(t), 1)))}
    sets = [shingles(t) for t in texts]
    fps = [simhash.fingerprint(" ".join(t).encode()) & (2**64 - 1) for t in texts]
    label, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            alike = 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and bool(sets[i])
            far += alike and (fps[i] ^ fps[j]).bit_count() > 4
            if alike or (fps[i] ^ fps[j]).bit_count() <= 4:
                label = [label[j] if x == label[i] else x for x in label]
    want = sorted(min(i for i, x in enumerate(label) if x == c) for c in set(label))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    for options in ({}, {"crowd": 2}):  # the second sends most bands past the comparison in pairs
        assert far and sorted(r.doc_id for r in simhash.drop_copies(docs, **options).collect()) == want


def test_columns_of_any_name_survive(spark):
    names = ["doc_id", "text", "_k", "_n", "_h", "row", "fp", "root"]
    docs = spark.createDataFrame([(1, "some words of a text here", "x", 7, 8, "y", 9, 1), (2, "other words in another text there", "z", 5, 4, "w", 3, 2)], names)
    for kept in (simhash.drop_copies(docs), simhash.drop_near_duplicates(docs)):
        assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_components(spark):
    from trellis.llm.common import components

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (1, 0), (1, 0)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {x: low if v == high else v for x, v in label.items()}
    want = sorted((x, v) for x, v in label.items() if x != v)
    assert sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()) == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
