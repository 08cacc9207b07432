import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE_TEXTS, SMALL
from trellis.llm import bpe, queries
from trellis.llm.tokens import path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path(bpe.FILE))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def same(library, text, coder=None):
    coder = coder or bpe.coder()
    want = library.encode(text, add_special_tokens=False).ids
    packed = coder.encode(text)
    assert ids(packed) == want
    assert bpe.coder(kind=bpe.Decoder).decode(packed) == library.decode(want, skip_special_tokens=False) == text


def test_classes_of_every_code_point(library):
    """Letters, numbers, blanks and others split as in the library, character by character, whoever splits."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 29 == 0 or 0xA700 < c < 0xAC00 or 0x10000 < c < 0x11000)]
    for i in range(0, len(points), 64):
        text = "".join(f"a{c}1{c}!{c} {c}b" for c in map(chr, points[i : i + 64]))
        assert bpe.coder().words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


_LIBRARY = Tokenizer.from_file(path(bpe.FILE))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab é\n\t '’sn't1<|endoftext|>界🙂‍", max_size=60), st.text(alphabet="athe", min_size=90, max_size=300)))
def test_any_text_equals_the_library(text):
    same(_LIBRARY, text)


def test_edge_texts_and_long_words(library):
    rng = random.Random(5)
    texts = [t for t in EDGE_TEXTS if t] + ["a" * 50_000, "".join(rng.choices("abcdefghijklmnop", k=20_000)), "Ŝ" * 3000, " " * 5000 + "x", "<|endoftext|>" * 3, "x<|endoftext|", "ᲉꟋ\U0002ebf0 x"]
    for text in texts:
        same(library, text)


def test_scan_and_heap_merge_alike():
    rng, scan, heap = random.Random(1), bpe.ByteLevelBPE(short=1 << 30), bpe.ByteLevelBPE(short=0)
    for _ in range(300):
        word = "".join(rng.choices("aaabthein é界", k=rng.randint(1, 150))).encode()
        assert scan.merge(word) == heap.merge(word)


def test_bytes_that_are_no_text(library):
    parts = library.encode("界é", add_special_tokens=False).ids
    cut = np.array(parts[:1], "<u4").tobytes()
    assert bpe.coder(kind=bpe.Decoder).decode(cut) == library.decode(parts[:1], skip_special_tokens=False)


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op11_rank_array_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        own = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        back = library.decode(own, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_edges(library, edge_docs, no_docs):
    want = sorted(((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in edge_docs.collect()), key=str)
    got = bpe.decoded(bpe.encoded(edge_docs)).collect()
    assert sorted(((r.doc_id, len(r.ids) // 4, r.text) for r in got), key=str) == want
    assert bpe.digests(bpe.decoded(bpe.encoded(no_docs))).count() == 0
