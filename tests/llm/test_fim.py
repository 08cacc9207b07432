import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import SMALL
from trellis.llm import fim, queries


def brute(doc_id, text, seed=fim.SEED, rate=fim.RATE, spm=fim.SPM):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_query_equals_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = [(*w[:5], sha(w[5]), sha(w[6])) for w in (brute(r.doc_id, r.text) for r in docs)]
    got = list(map(tuple, queries.op13_fill_in_middle(spark, SMALL).collect()))
    assert sorted(got) == sorted(want) and len({g[2] for g in got}) > 1


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_edges(spark, edge_docs, no_docs, rate, spm):
    more = [(100 + i, t) for i, t in enumerate(["a\nb\n", "a\nb", "\n", "\n\n\nx", "has <P> in it\n", "near <P", "S><M", "<", "<\n<S\n<P\n", "é界🙂\nß\n" * 40, "x\n" * 9000, "y" * 70_000, "\\Q<\\E $1\n\\2"])]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = [brute(r.doc_id, r.text, 11, rate, spm) for r in docs.collect()]
    got = fim.restored(fim.fill_in_middle(docs, 11, rate, spm)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert fim.restored(fim.fill_in_middle(no_docs)).count() == 0


def test_other_sentinels(spark):
    marks = ("<|pre|>", "(suf)", "[mid]*")
    docs = spark.createDataFrame([(i, f"line {i}\n<P> two\nthree") for i in range(20)] + [(20, "has (suf) in it")], "doc_id bigint, text string")
    for r in fim.restored(fim.fill_in_middle(docs, sentinels=marks), marks).join(docs, "doc_id").collect():
        assert r.restored == r.text and (r.form == "plain") == (r.doc_id == 20)


@given(st.lists(st.booleans(), max_size=3000))
def test_rank_and_select(flags):
    bits = fim.Bits(np.array(flags, bool))
    ones = [i for i, x in enumerate(flags) if x]
    assert bits.total == len(ones)
    assert [bits.select(k + 1) for k in range(len(ones))] == ones
    assert [bits.rank(i) for i in range(0, len(flags) + 1, 7)] == [sum(flags[:i]) for i in range(0, len(flags) + 1, 7)]
    with pytest.raises(ValueError):
        bits.select(len(ones) + 1)


def test_blocks_of_many_words():
    flags = np.zeros(50_000, bool)
    flags[[0, 63, 64, 511, 512, 4095, 4096, 49_999]] = True
    bits = fim.Bits(flags)
    assert [bits.select(k) for k in range(1, 9)] == np.flatnonzero(flags).tolist()
    assert [bits.rank(i) for i in (0, 1, 64, 512, 513, 49_999, 50_000)] == [0, 1, 2, 4, 5, 7, 8]
