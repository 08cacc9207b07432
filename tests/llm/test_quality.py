import re
from collections import Counter

import numpy as np

from trellis.llm import quality


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    cover = {j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def brute(stats):
    """kept by the documented method in numpy: the same quantile grid, starts, subset share, steps, ridge and cutoff."""
    x = np.array([[np.log(max(s[0], 1)), np.log(max(s[1], 1) / max(s[0], 1)), np.sqrt(s[2] / max(s[1], 1)), np.sqrt(s[3] / max(s[0], 1)), np.sqrt(s[4] / max(s[0], 1))] for s in stats], float)
    floors = np.array(list(quality.FLOORS.values()))
    rank = lambda v, share: np.sort(v)[int(np.ceil(len(v) * share)) - 1]
    bins = np.sign(x) * np.floor(np.abs(x) * 1024 + 0.5)
    mean = np.array([rank(b, 0.5) for b in bins.T]) / 1024
    spread = np.maximum(np.array([rank(b, 0.75) - rank(b, 0.25) for b in bins.T]) / (1.349 * 1024), floors)
    k = x.shape[1]
    factor = quality.H / quality.chi_square_cdf(quality.chi_square_quantile(quality.H, k), k + 2)

    def step(d):
        b = np.round(np.log(d + 1e-6) * 256)
        near = x[b <= rank(b, quality.H)]
        cov = ((near - near.mean(0)).T @ (near - near.mean(0)) / len(near)) * factor + np.diag(floors**2)
        return np.linalg.det(cov), np.einsum("ni,ij,nj->n", x - near.mean(0), np.linalg.inv(cov), x - near.mean(0))

    z = np.abs((x - mean) / spread)
    tried = [step(step(d)[1]) for d in ((z**2).sum(1), z.max(1), z.sum(1))]
    det, d = min(tried, key=lambda t: t[0])
    dets = [det]
    for _ in range(quality.STEPS):
        det, d = step(d)
        dets.append(det)
    assert all(b <= a * (1 + 1e-3) for a, b in zip(dets, dets[1:]))  # ties in the histogram aside, no step raises it
    return d


def test_base_columns(edge_docs, no_docs):
    got = {(r.doc_id, r.n_words): r for r in quality.statistics(edge_docs).collect()}
    for r in edge_docs.collect():
        want = base(r.text)
        g = got[(r.doc_id, want[0])]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.judged(no_docs).count() == 0
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 0


def test_estimates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' AND source = 'src0'")
    rows = {r.doc_id: r for r in quality.judged(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) >= quality.MIN_GROUP
    passed = [k for k, r in rows.items() if not r.base_failed]
    want = dict(zip(passed, brute([base(texts[k]) for k in passed])))
    limit = quality.chi_square_quantile(1 - quality.TAIL, 5)
    for k in passed:
        assert abs(rows[k].distance - want[k]) < 1e-6 * max(1, want[k])
        assert rows[k].kept == (want[k] <= limit)
    assert 0 < sum(not rows[k].kept for k in passed) < 0.2 * len(passed)
    assert not any(rows[k].kept for k in rows if k not in passed)


def test_chi_square():
    assert abs(quality.chi_square_cdf(11.0705, 5) - 0.95) < 1e-5
    assert abs(quality.chi_square_quantile(0.75, 5) - 6.6257) < 1e-3


def test_labelled_junk_goes_and_clean_rows_stay(spark):
    sf = "/root/testdata/sf0.01"
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [r for r in quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect() if not r.base_failed]
    kept = {q: [r.kept for r in passed if quality_of.get(r.doc_id) == q] for q in (0, 1)}
    assert kept[0] and not any(kept[0])
    assert kept[1] and all(kept[1])
