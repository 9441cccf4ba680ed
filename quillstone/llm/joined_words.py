"""Ids of many texts at once, from the ids of their words.

The words of a batch of texts are split by Arrow and found in a store of the words met so
far, an Arrow array beside the ids of its words; only words that are new reach the
tokenizer. The ids are then gathered in the order of the words, so no occurrence of a word
is handled by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a store holds.
CACHE_BYTES = 48_000_000


class WordStore:
    """Words with their ids. When it holds more than limit bytes, the older half goes."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.words = pa.array([], pa.string())
        self.size, self.flat = np.empty(0, np.int64), np.empty(0, "<u4")

    def held(self) -> int:
        return self.words.nbytes + self.size.nbytes + self.flat.nbytes

    def places(self, words: pa.Array) -> np.ndarray:
        """Where in the store each word is; new ones are added."""
        while self.held() > self.limit:
            half = (len(self.words) + 1) // 2
            self.flat = self.flat[self.size[:half].sum() :].copy()
            self.words, self.size = pa.concat_arrays([self.words[half:]]), self.size[half:].copy()
        found = pc.index_in(words, value_set=self.words)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            coded = words.take(pa.array(new)).dictionary_encode()
            ids = list(map(self.encode, coded.dictionary.to_pylist()))
            at[new] = coded.indices.to_numpy().astype(np.int64) + len(self.words)
            self.words = pa.concat_arrays([self.words, coded.dictionary.cast(pa.string())])
            self.size = np.append(self.size, np.fromiter(map(len, ids), np.int64, len(ids)) >> 2)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
        return at


def encode_words(texts: pa.Array, words: WordStore, end: bytes, *, first: WordStore | None = None, line_end: bytes | None = None, odd: pa.Array | None = None, whole: Callable[[str], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each followed by the ids in end, and how
    many ids each text has, those included.

    A text is split at spaces and line ends. With a store first, the word that begins a
    line has ids of its own, and line_end stands between lines; without it, line ends
    count as spaces. Texts marked in odd are given to whole."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    if not n:
        return np.empty(0, "<u4"), np.empty(0, np.int64)
    strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if odd is not None else np.empty(0, np.int64)
    apart = [whole(texts[int(i)].as_py()) for i in strange]
    if len(strange):
        texts = pc.if_else(odd, "", texts)
    if first is None:
        lines, line_count = pc.replace_substring(texts, "\n", " "), np.ones(n, np.int64)
    else:
        split = pc.split_pattern(texts, "\n")
        lines, line_count = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    split = pc.split_pattern(lines, " ")
    count = pc.list_value_length(split).to_numpy().astype(np.int64)
    every = split.flatten()
    closing = np.cumsum(count + 1) - 1  # what follows each line
    begin = closing - count
    kind = np.zeros(closing[-1] + 1, np.int8)
    kind[closing] = 2
    elements = np.empty(len(kind), np.int64)
    if first is None:
        elements[kind == 0] = words.places(every)
        sizes, flats = [words.size], [words.flat]
    else:
        kind[begin] = 1
        heads = kind[kind < 2] == 1
        elements[kind == 0] = words.places(every.filter(pa.array(~heads)))
        elements[kind == 1] = first.places(every.filter(pa.array(heads))) + len(words.size)
        sizes, flats = [words.size, first.size], [words.flat, first.flat]
    known = sum(map(len, sizes))
    last = np.cumsum(line_count) - 1
    elements[closing] = known
    elements[closing[last]] = known + 1
    elements[begin[last - line_count + 1][strange]] = known + 2 + np.arange(len(strange))
    more = [line_end or b"", end, *apart]
    size = np.concatenate([*sizes, [len(x) >> 2 for x in more]])
    flat = np.concatenate([*flats, np.frombuffer(b"".join(more), "<u4")])
    took = size[elements]
    upto = np.cumsum(took)
    at = np.repeat((np.cumsum(size) - size)[elements] - (upto - took), took)
    at += np.arange(len(at))
    return flat[at], np.diff(upto[closing[last]], prepend=0)
