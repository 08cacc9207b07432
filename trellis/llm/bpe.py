"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is cut at the special tokens of its vocabulary, then into words by the vocabulary's own pattern. A word holds its parts'
boundaries and ids in one array and the ranks of adjacent parts in another: the smallest rank is looked for by a scan, its boundary is
deleted, and the two ranks beside it are looked up again, until no neighbours can merge. A word of more than SHORT bytes, where scans would
grow with the square of its length, takes the same merges in the same order from a heap over linked parts. Ids of words are kept in a table of
bounded size, as most words come again.

Ids are packed as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.tokens import path

FILE = "byte_bpe_50k.json"
#: Words of more bytes than this are merged over a heap.
SHORT = 96
_BOUND = 300_000
_NEVER = 1 << 40

# The pattern that splits text into words, as the public vocabulary publishes it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters on whose class two releases of Unicode differ lie outside these ranges; texts with others are split by the library's splitter.
_UNSURE = re.compile("[^\x00-\u0557\u058d-\u088e\u0890-\u0c5b\u0c5d-\u0cdb\u0cdd-\u208e\u20a0-\ua7cd\uab6e-\U000107ba\U0001e700-\U0002b739]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next letter from U+0100 on."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


def _token_bytes(made: dict) -> dict[int, bytes]:
    """Bytes of each token id of a vocabulary file, special tokens included."""
    byte_of = {x: b for b, x in enumerate(byte_letters())}
    out = {i: bytes(byte_of[x] for x in t) for t, i in made["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in made["added_tokens"]}


class Decoder:
    """Texts of packed ids of one vocabulary file."""

    def __init__(self, file: str = FILE):
        self.bytes_of = _token_bytes(_read(file))

    def decode(self, ids: bytes | None) -> str:
        """Text of packed ids, special ones included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, _unpacked(ids or b""))).decode("utf-8", "replace")


def _read(file: str) -> dict:
    with open(path(file), encoding="utf-8") as f:
        return json.load(f)


class ByteLevelBPE:
    """Encoder of one vocabulary file of the tokenizers library (byte-level BPE without prefix space)."""

    def __init__(self, file: str = FILE, short: int = SHORT):
        made = _read(file)
        model, split = made["model"], made["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or made["normalizer"]:
            raise ValueError(f"{file} is no plain byte-level BPE vocabulary")
        self.file, self.short = file, short
        vocab = model["vocab"]
        self.byte_id = [vocab[x] for x in byte_letters()]
        #: (left id, right id) as one number -> rank and id of the merge as one number.
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        cuts = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._cut = re.compile(f"({cuts})") if cuts else None
        self._words = regex.compile(PATTERN).findall
        self._library = None
        merge = self.merge

        class Known(dict):
            def __missing__(self, word):
                if len(self) > _BOUND:
                    self.clear()
                out = self[word] = _packed(merge(word.encode()))
                return out

        self.known = Known()

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = [self.byte_id[b] for b in word]
        return self._scan(ids) if len(ids) <= self.short else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << 32 | b, _NEVER << 32) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low >> 32 == _NEVER:
                break
            i = ranks.index(low)
            ids[i] = low & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], _NEVER << 32)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], _NEVER << 32)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        get, end = self.merges.get, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(low, i) for i in range(end - 1) if (low := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            low, i = heapq.heappop(queue)
            j = after[i]
            # What the entry was made for may have been merged since.
            if ids[i] < 0 or j >= end or get(ids[i] << 32 | ids[j]) != low:
                continue
            ids[i], ids[j] = low & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (new := get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, (new, i))
            if (h := before[i]) >= 0 and (new := get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, (new, h))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        if not _UNSURE.search(text):
            return self._words(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path(self.file)).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; special strings in it become their ids."""
        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.known.__getitem__, self.words(text)))
        out = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(_packed([self.special[part]]))
            elif part:
                out.extend(map(self.known.__getitem__, self.words(part)))
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _unpacked(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out


_coders: dict[tuple[type, str], ByteLevelBPE | Decoder] = {}


def coder(file: str = FILE, kind: type = ByteLevelBPE) -> ByteLevelBPE | Decoder:
    """One coder of each kind and file in a process."""
    if (kind, file) not in _coders:
        _coders[kind, file] = kind(file)
    return _coders[kind, file]


def encoded(docs: DataFrame, file: str = FILE) -> DataFrame:
    """doc_id and ids (packed) of every row; null and empty texts have no ids, repeated rows each come back, an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = coder(file)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.encode(t.as_py()) for t in b.column(1)], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(tokens: DataFrame, file: str = FILE) -> DataFrame:
    """doc_id, ids and text of every row of doc_id and ids (packed); null ids give an empty text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = coder(file, Decoder)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([bpe.decode(x.as_py()) for x in b.column(1)], pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and text of decoded()."""
    return tokens.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
