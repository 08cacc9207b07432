import random
import re

from trellis.llm import decontam

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        m = min(10, len(v))
        own = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if m else set()
        for p in range(len(w) - m + 1):
            if m and tuple(w[p : p + m]) in own:
                hit.update(range(p, p + m))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def fixture(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(30)] + ["É", "the", "The"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(25)] + [(3, "again an item with id three that has more than ten words"), (None, "an item without any id at all but with eleven words here"), (90, None), (91, "same " * 30)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(pool, k=rng.choice([0, 3, 30]))) for _ in range(3)]
        i = rng.choice(items)[1] or ""
        cut = i.split()[rng.choice([0, 2]) :]
        docs.append((d, "; ".join([parts[0], " ".join(cut).upper(), parts[1], parts[2]])))
    docs += [(100, None), (101, ""), (102, "same " * 500), (7, docs[7][1]), (None, "an item without any id at all but with eleven words here")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


def test_both_joins_equal_brute_force(spark):
    docs, bench, rows, items = fixture(spark)
    want = sorted([(d, *brute(t, items)) for d, t in rows], key=str)
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = decontam.mark(docs, bench, broadcast_bytes=limit).select("row.doc_id", "n_words", "n_hit", "item_ids").collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in got], key=str) == want


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "same line same line same line"), (2, "你好")], "item_id bigint, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = decontam.mark(edge_docs, bench, broadcast_bytes=limit)
        assert got.count() == edge_docs.count() and got.where("n_hit > 0").count() == 2
        assert decontam.drop_contaminated(edge_docs, bench, broadcast_bytes=limit).columns == edge_docs.columns
        assert decontam.mark(no_docs, bench, broadcast_bytes=limit).count() == 0
        assert decontam.mark(edge_docs, bench.where("false"), broadcast_bytes=limit).where("n_hit > 0").count() == 0
