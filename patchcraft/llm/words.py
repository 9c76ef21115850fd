"""Token ids of the lower-case word tokenizer, with caches of what a worker has met.

The tokenizer's file splits text at white space, so the ids of a text are the
ids of its space-separated parts in order.  That holds without its normaliser
for texts whose characters are plain (below); any other text goes through the
library as a whole.
"""

from __future__ import annotations

import re

import numpy as np

# Fixed: the letters and digits among the plain characters, and the tokenizer's own split rule over them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = " \t-\r"
#: Characters outside printable ASCII, the blanks above and Latin letters and signs; also the capital that lower-cases to two.
UNPLAIN_SIGN = "[^ -~\t-\r\xa1-įı-ɏ]"
UNPLAIN = re.compile(UNPLAIN_SIGN + "|<\\|")
#: Of the plain characters, those of one byte.
_PLAIN_BYTES = bytes([*range(0x20, 0x7F), *range(0x09, 0x0E)])
#: Entries of a generation of a cache.
CACHE = 300_000


def is_plain(text: str, raw: bytes) -> bool:
    """Nothing of UNPLAIN is in ``text``, whose UTF-8 is ``raw``: only what bytes leave is searched."""
    left = raw.translate(None, _PLAIN_BYTES)
    return "<|" not in text and not (left and UNPLAIN.search(left.decode("utf-8", "surrogatepass")))


def byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable Latin-1, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache:
    """Values of the keys met of late: two generations, so that memory is bounded and what comes often stays.

    ``now`` is the young generation, for a quick look; ``get`` finds in the
    old one or makes what is not there.  Once the young one is full it becomes
    the old one, whose other keys are forgotten.
    """

    def __init__(self, make, most: int = CACHE):
        self.make, self.most = make, most
        self.now, self.old = {}, {}

    def get(self, key):
        value = self.now.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.now) >= self.most:
                self.now, self.old = {}, self.now
            self.now[key] = value
        return value


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.signs = byte_signs()
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+").findall
        self.parts, self.words = Cache(self._part), Cache(self._word)

    def _word(self, word: str) -> bytes:
        signs = word.encode().decode("latin-1").translate(self.signs)
        return np.array([t.id for t in self.tokenizer.model.tokenize(signs)], "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.words.get, self.split(part)))

    def encode(self, text: str) -> bytes:
        if UNPLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, made = self.parts.now.get, self.parts.get
        return b"".join([known(p) or made(p) for p in text.lower().split()])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
