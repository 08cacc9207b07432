"""Exact token counts at every prefix of a text, by dynamic programming over its segments.

No piece of the vocabulary holds a word mark behind another character, and a line feed and NUL are always tokens of their
own, so no merge crosses into a run of blanks or over one of those; a word mark in a text counts like the blank it stands for.
The table therefore obeys

    T[end of segment i] = T[end of segment i - 1] + last entry of D(segment i)
    T[inside segment i] = T[end of segment i - 1] + D(segment i)[part]

and each entry is the count the library gives for that prefix encoded alone. D holds the counts at every prefix of a segment, one row
for all places where the segment stands: a sequence of pieces is what the library makes of its text exactly if each two neighbours are, so
the last piece of a prefix is the one that stands beside the last piece of what is before it, and its count is one more than there. The
library is asked about pieces and pairs of pieces only. Counts of whole texts, truncation and budget questions read the table; neither a
text nor a segment nor a prefix is encoded.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.tokens import path

FILE, LIMIT = "piece_bpe_32k.model", 4096
_MARK = "▁"
_SEGMENT = re.compile("[\n\0]| *[^ \n\0]+| +")
_BOUND = 800_000
#: Code points of the segments whose counts are kept at most; one of more than the second is filled anew at each place.
_HELD, _LONG = 8_000_000, 4096


class PrefixCounter:
    """Counts of one sentencepiece BPE model; a model whose pieces break the rule above is refused."""

    def __init__(self, file: str = FILE):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path(file))
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        probe, made = f"a  b \n c\0{_MARK}d", f"{_MARK}a{_MARK * 2}b{_MARK}<0x0A>{_MARK}c<0x00>{_MARK}d"
        if any(_MARK in p.lstrip(_MARK) or "\n" in p or "\0" in p for p in pieces) or "".join(m.encode(probe, out_type=str)) != made:
            raise ValueError(f"merges of {file} cross blanks or line feeds")
        head = len(m.encode("\n"))  # the mark put before a text, and the line feed
        normal = lambda i: not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
        self.pieces = {p for i, p in enumerate(pieces) if normal(i)}
        self.longest = max(map(len, self.pieces))
        made = lambda text: m.encode("\n" + text.replace(_MARK, " "), out_type=str)[head:]

        class Known(dict):
            def __missing__(self, piece):
                if len(self) > _BOUND:
                    self.clear()
                out = self[piece] = made(piece)
                return out

        self.known = known = Known()

        class Apart(dict):
            def __missing__(self, pair):
                if len(self) > _BOUND:
                    self.clear()
                a, b = pair
                self[pair] = ok = made(a + b) == known[a] + known[b]
                return ok

        class Sizes(dict):
            def __missing__(self, piece):
                if len(self) > _BOUND:
                    self.clear()
                n = len(known[piece])
                self[piece] = n if n == 1 or len(piece) == 1 else 0
                return self[piece]

        class Filled(dict):
            """When full, its rows are kept aside until it is full again, so frequent ones aren't filled anew."""

            def __init__(self, fill):
                self.fill, self.held, self.aside = fill, 0, {}

            def __missing__(self, segment):
                out = self.aside.get(segment) or self.fill(segment)
                if len(segment) <= _LONG:
                    if self.held > _HELD // 2 or len(self) > _BOUND // 2:
                        self.held, self.aside = 0, dict(self)
                        self.clear()
                    self.held += len(segment)
                    self[segment] = out
                return out

        self.apart, self.sizes, self.filled, self.runs = Apart(), Sizes(), Filled(self._fill), Filled(self._run)
        self.joins = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}

    def segments(self, text: str) -> list[str]:
        """Segments of a text behind the mark that the library puts first."""
        return _SEGMENT.findall(" " + text.replace(_MARK, " "))

    def count(self, text: str | None) -> int:
        """The last entry of the table."""
        return int(self.prefixes(text)[-1])

    def _fill(self, segment: str) -> bytes:
        """Tokens of each prefix of a segment, from one code point on, as int32; no piece holds two neighbours between which it is cut."""
        s = segment.replace(" ", _MARK)
        joins = self.joins
        ends = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in joins]
        if not ends:
            return self.runs[s]
        counts, n, a = array("i"), 0, 0
        for b in (*ends, len(s)):
            counts.extend([n + k for k in array("i", self.runs[s[a:b]])])
            n, a = counts[-1], b
        return counts.tobytes()

    def _run(self, s: str) -> bytes:
        """The same of a run, piece by piece."""
        pieces, sizes, apart, longest = self.pieces, self.sizes, self.apart, self.longest
        counts, last = array("i", [0]), deque([""], longest)
        for p in range(1, len(s) + 1):
            w, piece = 1, s[p - 1]
            while not ((w == 1 or piece in pieces) and (n := sizes[piece]) and (w == p or apart[last[-w], piece])):
                w += 1
                if w > p or w > longest:
                    raise ValueError(f"no pieces for the first {p} characters of a segment")
                piece = s[p - w : p]
            counts.append(counts[p - w] + n)
            last.append(piece)
        return counts[1:].tobytes()

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at every prefix of a text from its mark on, and code points at the ends of its segments."""
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        counts = np.frombuffer(b"".join(map(self.filled.__getitem__, parts)), np.int32)
        own = counts[ends - 1]
        return counts + np.repeat(np.cumsum(own, dtype=np.int32) - own, np.diff(ends, prepend=0)), ends

    def prefixes(self, text: str | None) -> np.ndarray:
        """The table: tokens of every prefix of a text, from the empty one on."""
        if not text:
            return np.zeros(1, np.int32)
        counts, _ = self._joined(self.segments(text))
        counts[0] = 0  # the mark alone stands for no text
        return counts

    def _inside(self, segment: str, first: bool) -> list[int]:
        """Tokens of each prefix of a segment of the text; the first one stands behind the mark that the library puts before a text."""
        segment = segment.replace(_MARK, " ")
        counts = np.frombuffer(self.filled[" " + segment if first else segment], np.int32).tolist()
        return counts[1:] if first else counts

    def table(self, text: str | None, budget: int | None = None, every: bool = False) -> tuple[list[int], list[int]]:
        """Extract of the table, code points and tokens: at the end of each segment, from (0, 0), and at every prefix inside the one that crosses the budget; every: at every prefix of the text."""
        if not text:
            return [0], [0]
        if every:
            return list(range(len(text) + 1)), self.prefixes(text).tolist()
        counts, ends = self._joined(self.segments(text))
        ends, tokens = [0, *(ends - 1).tolist()], [0, *counts[ends - 1].tolist()]
        if budget is not None and tokens[-1] > budget >= 0:
            i = bisect_right(tokens, budget)
            a, b = ends[i - 1], ends[i]
            if b - a > 1:
                ends[i:i], tokens[i:i] = range(a + 1, b), counts[a + 1 : b].tolist()
        return ends, tokens

    def at(self, text: str, prefix: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of the first ``prefix`` code points."""
        ends, tokens = table or self.table(text)
        if prefix <= 0 or not text:
            return 0
        prefix = min(prefix, len(text))
        i = bisect_right(ends, prefix) - 1
        if ends[i] == prefix:
            return tokens[i]
        return tokens[i] + self._inside(text[ends[i] : ends[i + 1]], i == 0)[prefix - ends[i] - 1]

    def truncate(self, text: str, budget: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """The most code points that take at most ``budget`` tokens; a given table must be made for the budget."""
        ends, tokens = table or self.table(text, budget)
        return next((e for e, n in zip(reversed(ends), reversed(tokens)) if n <= budget), 0)


_counters: dict[str, PrefixCounter] = {}


def counter(file: str = FILE) -> PrefixCounter:
    if file not in _counters:
        _counters[file] = PrefixCounter(file)
    return _counters[file]


def token_counts(docs: DataFrame, file: str = FILE, budget: int | None = None, tables: bool = False) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, from the table of counts at every prefix of its text.

    budget adds fits_chars, the code points kept when cut to that many tokens; tables adds prefix_chars and
    prefix_tokens, those tables. Null and empty texts: 0 bytes, 0 tokens. Repeated rows each come back.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", fits_chars bigint" * (budget is not None) + ", prefix_chars array<int>, prefix_tokens array<int>" * tables

    def run(batches):
        c = counter(file)
        for b in batches:
            n_tokens, fits, chars, tokens = [], [], [], []
            for text in b.column(1).to_pylist():
                made = c.prefixes(text)
                n_tokens.append(made[-1])
                if budget is not None:
                    fits.append(np.flatnonzero(made <= budget)[-1] if budget >= 0 else 0)
                if tables:
                    chars.append(np.arange(len(made), dtype=np.int32))
                    tokens.append(made)
            cols, names = [b.column(0), b.column(2), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            if budget is not None:
                cols.append(pa.array(fits, pa.int64()))
                names.append("fits_chars")
            if tables:
                cols += [pa.array(t, pa.list_(pa.int32())) for t in (chars, tokens)]
                names += ["prefix_chars", "prefix_tokens"]
            yield pa.record_batch(cols, names=names)

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    return docs.select("doc_id", "text", n_bytes).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint{more}")
