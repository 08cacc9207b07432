"""Fill-in-middle transformation over succinct boundary bitvectors.

The last byte of each unit (line) is a bit in a packed vector with a directory of popcounts per block. Its total is the number n of
units; two ranks drawn from the document's id are turned into byte cuts by select, and a second vector of first bytes of code points turns
byte cuts into code points by rank. The parts are moved behind sentinels; texts that hold a sentinel stay plain, so the exact
text can always be rebuilt from output and form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM = 7, 100, 50
SENTINELS = ("<P>", "<S>", "<M>")
#: Words of 64 bits in a block of the directory.
BLOCK = 8
PLAIN, PSM_FORM, SPM_FORM = "plain", "psm", "spm"


class Bits:
    """A bitvector packed into 64-bit words, with the number of ones before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(-(-max(len(packed), 1) // (8 * BLOCK)) * BLOCK, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words, self.size = words, len(flags)
        self.counts = np.bitwise_count(words).astype(np.int64)
        self.directory = np.r_[0, np.cumsum(self.counts.reshape(-1, BLOCK).sum(1))]

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def _bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")

    def rank(self, position: int) -> int:
        """Ones before a position."""
        word, rest = divmod(min(position, self.size), 64)
        block = word // BLOCK
        n = int(self.directory[block]) + int(self.counts[block * BLOCK : word].sum())
        return n + int(self._bits(word)[:rest].sum()) if rest else n

    def select(self, k: int) -> int:
        """Position of the k-th one, counted from 1."""
        if not 1 <= k <= self.total:
            raise ValueError(f"no one number {k} of {self.total}")
        block = int(np.searchsorted(self.directory, k)) - 1
        rest = k - int(self.directory[block])
        ahead = np.cumsum(self.counts[block * BLOCK : (block + 1) * BLOCK])
        word = int(np.searchsorted(ahead, rest))
        rest -= int(ahead[word - 1]) if word else 0
        word += block * BLOCK
        return word * 64 + int(np.flatnonzero(self._bits(word))[rest - 1])


def line_ends(text: np.ndarray) -> Bits:
    """The last byte of each line: a line feed, or the last byte of the text."""
    flags = text == 10
    if len(flags):
        flags[-1] = True
    return Bits(flags)


def cut(text: bytes, first: int, second: int) -> tuple[int, int, int, int, int]:
    """n, the two byte cuts behind first % (n + 1) and second % (n + 1) lines in order, and the code points before each cut."""
    raw = np.frombuffer(text, np.uint8)
    ends = line_ends(raw)
    n = ends.total
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends.select(k) + 1 if k else 0 for k in (low, high))
    starts = Bits((raw & 0xC0) != 0x80)
    return n, a, b, starts.rank(a), starts.rank(b)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    rate is the percentage of documents that are transformed, spm that of the suffix-first form among them. A null text is empty, an empty
    one plain with n = 0, and so is a text with a sentinel (with its n). A null doc_id is hashed as an empty one. Repeated rows each
    come back, cut alike. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = [s.encode() for s in sentinels]

    def run(batches):
        before, behind, between = marks
        for b in batches:
            ns, forms, prefixes, middles, outputs = [], [], [], [], []
            for text, digest in zip(b.column(1), b.column(2)):
                raw, h = text.as_py() or b"", digest.as_py()
                h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
                n, x, y, chars, chars_to = cut(raw, h1, h2)
                ns.append(n)
                if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
                    forms.append(PLAIN)
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                prefix, middle, suffix = raw[:x], raw[x:y], raw[y:]
                first = h4 % 100 < spm
                forms.append(SPM_FORM if first else PSM_FORM)
                prefixes.append(chars)
                middles.append(chars_to - chars)
                outputs.append(b"".join((behind, suffix, before, prefix, between, middle) if first else (before, prefix, behind, suffix, between, middle)))
            cols = [b.column(0), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.record_batch(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), digest.alias("_h")).mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made with restored, the exact text rebuilt from output and form. A null output gives null."""
    parts = F.split("output", "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    order = {PSM_FORM: (1, 3, 2), SPM_FORM: (2, 3, 1)}
    text = F.when(F.col("form") == PLAIN, F.col("output"))
    for form, at in order.items():
        text = text.when(F.col("form") == form, F.concat(*[F.get("_parts", F.lit(i)) for i in at]))
    return made.withColumn("_parts", F.when(F.col("form") != PLAIN, parts)).withColumn("restored", text).drop("_parts")
