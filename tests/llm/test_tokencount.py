import random
import time

import sentencepiece

from tests.llm.conftest import EDGE_TEXTS, LONG
from trellis.llm import tokencount
from trellis.llm.tokens import path


def test_counts_equal_the_library(spark, edge_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for docs in (edge_docs.select("doc_id", "text"), whole):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect()), key=str)
        assert sorted(map(tuple, tokencount.token_counts(docs).collect()), key=str) == want
    assert tokencount.token_counts(no_docs, budget=3, tables=True).count() == 0


def test_every_prefix_and_truncation():
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    c = tokencount.counter()
    for text in [t for t in EDGE_TEXTS if t and t != LONG]:
        table = c.table(text)
        assert [c.at(text, p, table) for p in range(len(text) + 1)] == [len(sp.encode(text[:p])) for p in range(len(text) + 1)]
        for budget in (0, 1, 3, 1000):
            cut = c.truncate(text, budget, table)
            assert len(sp.encode(text[:cut])) <= budget


def test_budget_columns(edge_docs):
    for r in tokencount.token_counts(edge_docs, budget=5, tables=True).collect():
        assert r.prefix_tokens[-1] == r.n_tokens and r.prefix_chars[0] == 0
        assert r.fits_chars in r.prefix_chars


def test_truncation_is_the_longest_prefix():
    c = tokencount.counter()
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    made = ["国际货币基金组织在东京举行会议讨论世界经济" * 4, "https://example.org/a/long/path?with=internationalization&of=unbelievable_words" * 2, "YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo" * 4, "internationalization of words  and\n lines unquestionably", "🙂é" * 9]
    for text in made + [t for t in EDGE_TEXTS if t and t != LONG]:
        counts = [len(sp.encode(text[:p])) for p in range(len(text) + 1)]
        for budget in (0, 1, 2, 3, 5, 8, 13, 21, 34, 1000):
            want = max(p for p, n in enumerate(counts) if n <= budget)
            assert c.truncate(text, budget) == c.truncate(text, budget, c.table(text, budget)) == want, (text, budget)
            assert [c.at(text, p, c.table(text, budget)) for p in range(len(text) + 1)] == counts


def test_long_texts_with_marks_and_nul():
    """200 000 characters with word marks and NUL at the speed of others, and equal to the library."""
    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), tokencount.counter(), random.Random(8)
    words = ["the", "▁", "▁mark", "\0", "nul\0byte", "界", "x▁y", "line\n", "  ", "internationalization", "é"]
    text = " ".join(rng.choices(words, k=50_000))[:200_000]
    for made in (text, "▁" + "plain words here " * 12_000, "words " * 40_000 + "\0"):
        start = time.perf_counter()
        table = c.table(made)
        assert time.perf_counter() - start < 1
        assert table[1][-1] == c.count(made) == len(sp.encode(made))
        for p in rng.choices(range(len(made)), k=20):
            assert c.at(made, p, table) == len(sp.encode(made[:p]))
    short = "".join(rng.choices("▁ \0\nab界é", k=400))
    assert c.table(short, every=True)[1] == [len(sp.encode(short[:p])) for p in range(len(short) + 1)]


def test_every_prefix_without_encoding_it():
    """Once segments and pairs of pieces are known, no question about a prefix calls the library."""
    c = tokencount.PrefixCounter()
    text = "unquestionable internationalization of words\n  and lines"
    want = c.table(text, every=True)[1]
    c.known, c.apart, c.sizes = dict(c.known), dict(c.apart), dict(c.sizes)  # these would raise where the library had to be asked
    c.filled.clear()
    assert [c.at(text, p) for p in range(len(text) + 1)] == want
    assert c.truncate(text, want[-1] - 1) == max(p for p, n in enumerate(want) if n < want[-1])


def test_counts_are_the_last_entries_of_the_table(monkeypatch):
    """Counts of whole texts come from the pieces of their prefixes too: every segment is filled, none goes to the library."""
    sp, filled, fill = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), [], tokencount.PrefixCounter._fill
    monkeypatch.setattr(tokencount.PrefixCounter, "_fill", lambda self, segment: filled.append(segment) or fill(self, segment))
    c = tokencount.PrefixCounter()
    text = "unquestionable internationalization of words\n  and \0 lines 国际货币 ▁▁ 🙂"
    assert c.count(text) == len(sp.encode(text)) and set(filled) == set(c.segments(text))
    assert c.prefixes(text).tolist() == [len(sp.encode(text[:p])) for p in range(len(text) + 1)]
    assert c.prefixes(None).tolist() == c.prefixes("").tolist() == [0]


def test_small_tables_of_segments(monkeypatch):
    """Bounds that are met all the time change nothing."""
    monkeypatch.setattr(tokencount, "_BOUND", 6)
    monkeypatch.setattr(tokencount, "_HELD", 40)
    monkeypatch.setattr(tokencount, "_LONG", 9)
    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), tokencount.PrefixCounter(), random.Random(4)
    for _ in range(60):
        text = "".join(rng.choices("▁ \0\nabehst国é", k=50)) + " " * rng.randrange(40) + "internationalization the"
        assert c.prefixes(text).tolist() == [len(sp.encode(text[:p])) for p in range(len(text) + 1)]
        assert len(c.filled) <= 4 and c.filled.held <= 40
