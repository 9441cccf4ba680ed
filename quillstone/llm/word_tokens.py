"""Encoding with a word-level BPE file of the tokenizers library, word by word.

Such a tokenizer drops white space and never merges across it, so a text's ids
are the ids of its space-separated words in order. Words repeat: a store, bounded by
bytes (and one batch), keeps the ids of the words met so far, and only new words reach
the library (words of Latin letters its model alone, since what comes before the
model is known for them). The result equals ``Tokenizer.encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

from array import array
from string import punctuation

import numpy as np
import pyarrow as pa

from .joined_words import CACHE_BYTES, WordStore, encode_words
from .support import caches

_loaded: dict[str, "WordTokenizer"] = {}
caches["word_tokens"] = _loaded.clear


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str, cache_bytes: int = CACHE_BYTES) -> "WordTokenizer":
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path, cache_bytes)
    _loaded[path].known.limit = cache_bytes
    return _loaded[path]


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the
    others by the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.known = WordStore(self._ids, cache_bytes)
        self.marks: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        # Latin letters are composed already and lower-cased letter by letter; they
        # are one piece, which the model takes in the vocabulary's writing. Marks after
        # letters are another piece, unless the lower case ends in a mark of its own
        # (as that of U+0130 does), which would join them.
        if not word:
            return b""
        if not word.isascii() and max(word) >= "\u0250":
            return self._by_library(word)
        core = word if word.isalpha() else word.rstrip(punctuation)
        low = core.lower()
        if not core.isalpha() or not low.isalpha():
            return self._by_library(word)
        ids = array("I", [t.id for t in self.lib.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return ids if core is word else ids + self._marks(word[len(core) :])

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= 4096:
                self.marks.clear()
            self.marks[marks] = self._by_library(marks)
        return self.marks[marks]

    def _by_library(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id in end, and their numbers."""
        return encode_words(texts, self.known, end)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def word_ends(self) -> np.ndarray:
        """For each id, whether it ends a word."""
        vocab = self.lib.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            ends[i] = token.endswith("</w>")
        return ends
