"""Tokenizers of the packing and counting operators. Files are looked up by name; nothing is copied here."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which the regular expressions of both byte-level BPE libraries agree: printable ASCII and Latin letters.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
_CHUNK = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_BOUND = 800_000


#: Files that hold the vocabulary of another as ranks.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}


def path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class ByteBPE:
    """ids of a byte-level BPE as little-endian uint32 bytes.

    No merge crosses from a character that isn't white space into white space, so a text splits into
    independent chunks (white space and the run behind it) whose ids are kept in a bounded table. Texts
    with other characters than plain Latin ones, or with a special string, go to the tokenizers library whole.
    Chunks that aren't in the table go to the faster of the two libraries that hold the same vocabulary (``ranks``);
    tests compare its ids with the other's.
    """

    def __init__(self, file: str = "byte_bpe_50k.json", ranks: str | None = "same"):
        from tokenizers import Tokenizer

        ranks = RANKS.get(file) if ranks == "same" else ranks
        self.tokenizer = Tokenizer.from_file(path(file))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = lambda text: _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        encode = self.whole
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ordinary = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            encode = lambda chunk: _packed(ordinary(chunk))

        class Known(dict):
            def __missing__(self, chunk):
                if len(self) > _BOUND:
                    self.clear()
                out = self[chunk] = encode(chunk)
                return out

        self.known = Known()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, _CHUNK.findall(text)))
