"""Encoding with a byte-level BPE file of the tokenizers library, word by word.

The file's pattern starts a piece at a single space before anything but white space, and
a line end between others is a piece, so a line's ids are those of its first word and of
each space with the word after it. Words repeat: stores, bounded by bytes, keep the ids
of the words met so far. Words of Latin letters are one piece, which the model takes
in the vocabulary's writing; others go to the library. Texts with other runs of white
space, or with the text of a special token, go to the library whole. The result equals ``Tokenizer.encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .joined_words import CACHE_BYTES, WordStore, encode_words
from .support import caches
from .word_tokens import _byte_letters

_loaded: dict[str, "ByteTokenizer"] = {}
caches["byte_tokens"] = _loaded.clear
_SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}"
#: White space by which a text isn't cut into words: a space before other white space or
#: the end; three line ends in a row, two before white space or the end, or one beside
#: other white space than a space after it.
ODD = rf" [\n{_SPACE}]| \z|\n\n[\n{_SPACE}]|\n\n\z|[{_SPACE}]\n|\n[\t\x0b\x0c\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{3000}}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str) -> "ByteTokenizer":
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


class ByteTokenizer:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.line_end = self._library("\n")
        self.marks = {m: self._library(m) for m in ".,;:!?"}
        # The words after a space, and those that begin a line.
        self.later = WordStore(lambda word: self._ids(" ", word), cache_bytes)
        self.first = WordStore(lambda word: self._ids("", word) if word else b"", cache_bytes // 4)

    def _ids(self, space: str, word: str) -> bytes:
        core = word[:-1] if word[-1:] in self.marks and len(word) > 1 else word
        if not core.isalpha() or max(core) >= "\u0250":
            return self._library(space + word)
        written = (space + core).encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.lib.model.tokenize(written)]).tobytes()
        return ids if core is word else ids + self.marks[word[-1]]

    def _library(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id in end, and their numbers."""
        odd = pc.match_substring_regex(texts, ODD)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        return encode_words(texts, self.later, end, first=self.first, line_end=self.line_end, odd=pc.fill_null(odd, False), whole=self._library)
