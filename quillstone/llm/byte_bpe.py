"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece the table holds the one token that can stand last in
the prefix's encoding: a token t fits at the end of a prefix if the prefix without
it is encoded with a last token u, and the pair (u, t) stays apart, that is, no
merge would cross their border. Exactly one fits, so the table is the encoding of
every prefix at once: a byte is appended by finding one more entry, and after an
edit only the entries from the edit on are made again.

Whether a pair stays apart is found by undoing merges from the newest on, at the
border, and remembered. Ranks order the merges, as in the rank files of tiktoken;
the results equal tiktoken's ``encode_ordinary``.

Defined results: a null text counts as empty, with no ids; rows that repeat are
encoded each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ODD
from .joined_words import CACHE_BYTES as STORE_BYTES
from .joined_words import WordStore, encode_words
from .support import caches, chunks, release, small_batches

#: Bytes of words and ids remembered by a worker (texts without spaces are long
#: words), and pairs of tokens, some 100 bytes each; a store is emptied when full.
CACHE_BYTES, CACHE_PAIRS = 40_000_000, 400_000
#: What a store's entry takes beside its characters and ids.
ENTRY = 160

_loaded: dict[tuple[str, str], "PrefixEncoder"] = {}
caches["byte_bpe"] = _loaded.clear


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str, pattern: str) -> "PrefixEncoder":
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = PrefixEncoder(ranks, pattern)
    return _loaded[path, pattern]


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, owner: "PrefixEncoder", piece: bytes = b""):
        self.owner, self.piece, self.last = owner, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; entries made before stay valid."""
        at = len(self.piece)
        self.piece += more
        self.owner._fill(bytes(self.piece), self.last, at)

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace piece[begin:end]; only entries from begin on are made again."""
        rest = bytes(self.piece[end:])
        del self.piece[begin:], self.last[begin:]
        self.append(new + rest)

    def ids(self) -> list[int]:
        return self.owner._walk(self.last)


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        # White space, unless it is one space between others, or line ends alone.
        self.odd_space = regex.compile(r"  | [^\S ]| \Z").search
        top = max(ranks.values()) + 1
        self.text: list[bytes] = [b""] * top
        for token, i in ranks.items():
            self.text[i] = token
        self.size = [len(t) for t in self.text]
        self.ends: dict[int, int] = {}
        # The longest token that ends in three given bytes; others have two at most.
        self.longest: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self.longest[token[-3:]] = max(self.longest.get(token[-3:], 0), len(token))
        self.halves: dict[int, tuple[int, int]] = {}
        self.apart: dict[int, bool] = {}
        self.known = _Known(self)
        # The words after a space, and those that begin a line.
        self.later = WordStore(self.known.ids_of)
        self.first = WordStore(lambda word: b"".join(self.known.piece(p) for p in self.find(word)), STORE_BYTES // 4)
        self.line_end = self.known.piece("\n")

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made the token; itself twice if it is a byte
        or no merge makes it."""
        got = self.halves.get(token)
        if got is None:
            parts = self._merged(self.text[token], token)
            got = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return got

    def _merged(self, raw: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under a bound."""
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether left, right is the encoding of their bytes."""
        text, ranks, a, b, limit = self.text, self.ranks, left, right, 1 << 60
        while True:
            joined = ranks.get(text[a] + text[b])
            if joined is not None and joined < limit:
                return False
            # The newer of the two was the last to be made: look at the border
            # as it was before. On the left side an older merge wins ties.
            if a > b:
                limit, a = a, self._halves(a)[1]
                if a == limit:
                    limit, b = b + 1, self._halves(b)[0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self._halves(b)[0]
                if b + 1 == limit:
                    limit, a = a, self._halves(a)[1]
                    if a == limit:
                        return True

    def _fill(self, piece: bytes, last: list[int], at: int) -> None:
        """Entries of last for piece[:at + 1], piece[:at + 2], ..."""
        get, longest, apart = self.ranks.get, self.longest.get, self.apart.get
        for i in range(at + 1, len(piece) + 1):
            far = i - longest(piece[i - 3 : i], 2) if i > 2 else 0
            for j in range(far if far > 0 else 0, i):
                token = get(piece[j:i])
                if token is None:
                    continue
                # A whole prefix that is a token is encoded as that token.
                if not j:
                    break
                left = last[j - 1]
                fits = apart(left << 20 | token)
                if fits if fits is not None else self._fits(left, token):
                    break
            last.append(token)

    def _fits(self, left: int, right: int) -> bool:
        """Whether the pair stays apart; pairs found once are remembered."""
        if len(self.apart) >= CACHE_PAIRS:
            self.apart.clear()
        fits = self.apart[left << 20 | right] = self._stays_apart(left, right)
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece, from the table of all its prefixes."""
        last: list[int] = []
        self._fill(piece, last, 0)
        return self._walk(last)

    def _walk(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece: its last token, the last one before it, ..."""
        out, i, size = [], len(last), self.size
        while i:
            token = last[i - 1]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. Texts with runs
        of white space are left to the pattern."""
        odd = pc.fill_null(pc.match_substring_regex(texts, ODD), False)
        return encode_words(texts, self.later, b"", first=self.first, line_end=self.line_end, odd=odd, whole=self.encode)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = text.split(" ")
        # A space before anything but white space starts a piece, so a text is
        # encoded word by word; runs of white space are left to the pattern.
        if self.odd_space(text):
            return b"".join(self.known.piece(p) for p in self.find(text))
        first = b"".join(self.known.piece(p) for p in self.find(parts[0]))
        return first + b"".join(map(self.known.__getitem__, parts[1:]))


class _Known(dict):
    """Word -> ids of a space and the word; made when first asked for. Pieces that are
    no such word have a store of their own."""

    def __init__(self, owner: "PrefixEncoder", limit: int = CACHE_BYTES):
        super().__init__()
        self.owner, self.limit, self.held = owner, limit, 0
        self.pieces: dict[str, bytes] = {}

    def _keep(self, store: dict[str, bytes], word: str, ids: bytes) -> bytes:
        cost = ENTRY + 4 * len(word) + len(ids)
        if self.held + cost > self.limit:
            self.clear()
            self.pieces.clear()
            self.held = 0
            if cost > self.limit:
                return ids
        self.held += cost
        store[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._keep(self.pieces, piece, array("I", self.owner.encode_piece(piece.encode())).tobytes())
        return ids

    def ids_of(self, word: str) -> bytes:
        # Letters are one piece with the space, a mark after them is another.
        core = word[:-1] if word[-1:] in (".", ",") and len(word) > 1 else word
        if not core.isalpha():
            return b"".join(map(self.piece, self.owner.find(" " + word)))
        ids = array("I", self.owner.encode_piece((" " + core).encode())).tobytes()
        return ids if core is word else ids + self.piece(word[-1])

    def __missing__(self, word: str) -> bytes:
        return self._keep(self, word, self.ids_of(word))


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in chunks(batches, "text", owner="byte_bpe"):
            tokens, sizes = own.encode_all(batch.column("text"))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(tokens.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column("ids")
                flat, at = ids.flatten().to_numpy(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
                texts = [own.decode(flat[b:e].tolist()) for b, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])
        release()

    return run


def encode_documents(docs: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every whole text."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(_encode(ranks_path or default_ranks(), pattern or default_pattern()), "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The same rows with the decoded bytes."""
    return encoded.mapInArrow(_decode(ranks_path or default_ranks(), pattern or default_pattern()), "doc_id long, n_tokens long, ids array<int>, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    both = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", "n_tokens", F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
