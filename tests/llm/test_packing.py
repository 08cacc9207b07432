import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from trellis.llm import packing
from trellis.llm.tokens import path


def truth(text, tok):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


def check(docs, rows):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for d in docs:
        want[d["doc_id"]].append(truth(d["text"], tok))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for k, texts in want.items():
        pieces = sorted(by_doc[k], key=lambda r: r["start"])
        if len(set(texts)) == 1:
            ids = texts[0]
            assert sum(p["length"] for p in pieces) == len(ids) // 4 * len(texts)
            for p in pieces:
                assert p["doc_tokens"] == len(ids) // 4
                assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return by_seq


def test_edges(edge_docs, no_docs):
    check(edge_docs.collect(), packing.pack_documents(edge_docs).collect())
    assert packing.pack_documents(no_docs).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seqs = check(docs.collect(), packing.pack_documents(docs).collect())
    assert sum(sum(n for _, n in p) < 1024 for p in seqs.values()) <= docs.rdd.getNumPartitions()


def test_pack_balances_and_fills():
    sizes = [5, 700, 300, 1024, 0, 2500, 1, 1, 900, 513, 512, 511]
    pieces, count = packing.pack(sizes)
    assert count == -(-sum(sizes) // 1024)
    filled = defaultdict(int)
    for d, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == filled[s]
        filled[s] += n
    assert sorted(filled.values())[1:] == [1024] * (count - 1)
    assert packing.pack([]) == ([], 0)


def test_only_what_fits_nowhere_is_cut():
    """Brute force over every sequence: each tail goes to the cheapest with room, and is cut only if none has."""
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 3000, 1500)]
    pieces, count = packing.pack(sizes)
    full = sum(n // 1024 for n in sizes)
    room = {s: 1024 for s in range(full, count)}
    room[count - 1] = sum(sizes) - (count - 1) * 1024
    load, cut = dict.fromkeys(room, 0.0), set()
    whole = {(d, start): (n, s) for d, start, n, s, _ in pieces}
    for n, d in sorted(((n % 1024, d) for d, n in enumerate(sizes) if n % 1024), key=lambda x: (-x[0], x[1])):
        fits = [(load[s], s) for s in room if room[s] >= n]
        if not fits:
            cut.add(d)
            continue
        s = min(fits)[1]
        assert whole[d, sizes[d] // 1024 * 1024] == (n, s)
        room[s] -= n
        load[s] += packing.cost(n)
    assert cut == {d for d, n in enumerate(sizes) if n % 1024 and whole[d, n // 1024 * 1024][0] < n % 1024}
