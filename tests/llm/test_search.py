import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm.conftest import SMALL
from trellis.llm import queries, search


def parts(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=search.TOP):
    made = [(d, Counter(w), len(w)) for d, w in ((d, parts(t)) for d, t in docs) if w]
    n_docs, n_terms = len(made), sum(n for _, _, n in made)
    df = Counter(t for _, c, _ in made for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in made:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in Counter(parts(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]


def test_query_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs.select("doc_id", "text")), pairs(items.select("item_id", "text")))
    assert rows(queries.op12_blocked_product_search(spark, SMALL)) == want and want


def test_blocks_ties_and_edges(spark, edge_docs, no_docs):
    rng = random.Random(2)
    words = ["the", "The", "naïve", "ÉCOLE", "x1", "界", "rare", "a", "b", "mark", "two", "words"]
    made = [(i % 70, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(160)] + [(200 + i, "tie tie") for i in range(15)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string")).repartition(7)
    items = [(i % 9, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(25)]
    items += [(30, "tie"), (31, None), (None, "the mark"), (32, ""), (33, "unknownword"), (34, "fox " * 900), (30, "tie")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", search.F.lit("clash")).withColumn("score", search.F.lit(0))
    want = brute(pairs(docs), items)
    for limit in (search.BLOCK_BYTES, 60):
        assert rows(search.ranked(docs, bench, block_bytes=limit)) == want
    assert rows(search.ranked(docs, bench, k=3)) == brute(pairs(docs), items, 3)
    tied = [r for r in want if r[0] == 30]
    assert sorted(r[2] for r in tied) == sorted(list(range(200, 210)) * 2)
    assert search.ranked(no_docs, bench).count() == 0
    assert search.ranked(docs, bench.limit(0)).count() == 0
    assert search.ranked(docs.where("text IS NULL"), bench).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([(d, "same words here") for d in ("b", None, "a", "c")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "words")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in search.ranked(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, None)]


def test_product_rows_equal_a_dense_product():
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 4, (50, 30)) * (rng.random((50, 30)) < 0.3)
    at, columns = np.nonzero(dense)
    names = [f"t{i}" for i in range(30)]
    left = search.Items([(i, i, " ".join(rng.choice(names, 8)).encode()) for i in range(6)])
    of = np.array([left.vocabulary.get(n.encode(), -1) for n in names])
    held = of[columns] >= 0
    weight = rng.integers(1, 9, len(left.vocabulary))
    length = dense.sum(1) + 1
    scores = dict(search.block_scores(left, weight, 50, int(length.sum()), length, at[held], of[columns[held]], dense[at, columns][held]))
    for i in range(6):
        for d in range(50):
            m, want = 25 + (75 * int(length[d]) * 50) // int(length.sum()), 0
            for t, x in zip(left.columns[left.starts[i] : left.starts[i + 1]], left.times[left.starts[i] : left.starts[i + 1]]):
                tf = int(dense[d, list(of).index(t)])
                want += int(x) * int(weight[t]) * ((10**9 * tf) // (1000 * tf + 8 * m)) if tf else 0
            assert scores[i][d] == want


def test_long_corpora_do_not_overflow():
    got = search.impacts(np.array([1]), np.array([2]), np.array([10**12]), 10**10, 10**14)
    m = 25 + (75 * 10**22) // 10**14
    assert got.tolist() == [(2 * 10**9) // (2000 + 8 * m)]
