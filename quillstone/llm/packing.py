"""Packing documents into training windows by lexical retrieval.

Similar documents are brought together first: each has a route, the smallest hashes of
its rare words (those of more than one token) by two functions, which two documents
share as often as they share such words. Documents are dealt by the first and sorted
by both; adaptive execution splits the partitions that a hot route makes too large
(``REBALANCE``). They are taken in shards, bounded runs of the sorted rows. Each shard has an inverted index
with BM25 weights over its words. A seed document's rarest words query the index; the
unused neighbours it returns follow the seed, best first, until the window is full,
and each of them asks in turn when the seed's neighbours end. What overhangs a window
opens the next one. What a shard has left at its end is cut at powers of two, so no
sequence has padding.

A shard is bounded by ``SHARD_TOKENS`` and ``SHARD_DOCS``; a longer document is a shard
of its own. The documents' ids are shuffled once, in two bytes where they fit.

Defined results: a null text is an empty one, a document of the end id only;
repeated rows and rows with null ids are documents of their own; other columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joined_words import CACHE_BYTES
from .support import chunks, release, small_batches
from .word_tokens import default_path, tokenizer

WINDOW = 4096
#: A shard's bounds: ids held by a task at a time, and documents in one index.
SHARD_TOKENS, SHARD_DOCS = 1_500_000, 8192
#: BM25's usual parameters; words of a query; neighbours fetched at a time.
K1, B, QUERY_WORDS, NEIGHBOURS = 1.2, 0.75, 24, 16
_DOC_BITS = np.uint64(SHARD_DOCS - 1)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """An inverted index over one shard: word -> (documents, weights)."""

    def __init__(self, docs: list[np.ndarray], ends: np.ndarray):
        n = len(docs)
        words, owner = _words(docs, ends)
        length = np.bincount(owner, minlength=n)
        # One sort of 51 bits of the name over 13 bits of the document.
        both = np.sort((words & ~_DOC_BITS) | owner.astype(np.uint64))
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(both)))
        words, owner = both[at] & ~_DOC_BITS, (both[at] & _DOC_BITS).astype(np.int64)
        first = np.ones(len(words), bool)
        first[1:] = words[1:] != words[:-1]
        self.begin = np.append(np.flatnonzero(first), len(words))
        df = np.diff(self.begin)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        term = np.cumsum(first) - 1
        norm = K1 * (1 - B + B * length / max(length.mean(), 1)) if n else length
        self.docs = owner.astype(np.int32)
        self.weights = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        # Each document's query: its rarest words that another document has too.
        shared = np.flatnonzero(df[term] > 1)
        # One sort of the document, the word's frequency and its place.
        ranked = np.sort((owner[shared] << 45) | (df[term[shared]] << 32) | shared) & 0xFFFFFFFF
        self.query_of = np.searchsorted(owner[ranked], np.arange(n + 1))
        self.query_terms = term[ranked]
        self.scores = np.zeros(n, np.float32)

    def neighbours(self, doc: int, unused: np.ndarray) -> list[int]:
        """Unused documents by falling score, ties by place in the shard."""
        begin, end = self.query_of[doc], self.query_of[doc + 1]
        terms = self.query_terms[begin : min(end, begin + QUERY_WORDS)]
        if not len(terms):
            return []
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        hit = np.concatenate([self.docs[s] for s in spans])
        np.add.at(self.scores, hit, np.concatenate([self.weights[s] for s in spans]))
        found = np.unique(hit)
        found = found[unused[found]]
        best = found[np.argsort(-self.scores[found], kind="stable")[:NEIGHBOURS]].tolist()
        self.scores[hit] = 0
        return best


def _spans(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many ids, one after another: each word's first id, number of
    ids (those up to one that ends a word) and document."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    last = ends[ids]
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    stop = np.flatnonzero(last)
    begin = np.append(0, stop[:-1] + 1)
    return begin, stop - begin + 1, np.searchsorted(np.cumsum(lengths), begin, "right")


def _names(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word."""
    if not len(begin):
        return np.empty(0, np.uint64)
    place = (np.arange(len(ids)) - np.repeat(begin, size)).astype(np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), begin)


def _words(docs: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each word, and the document it stands in."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    begin, size, owner = _spans(ids, np.array([len(d) for d in docs], np.int64), ends)
    return _names(ids, begin, size), owner


def routes(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows: the smallest hash of each document's rare words by two functions; the
    largest number for a document without any."""
    begin, size, owner = _spans(ids, lengths, ends)
    rare = size > 1
    names, of = _names(ids, begin, size)[rare], owner[rare]
    out = np.full((2, len(lengths)), 2**63 - 1, np.int64)
    if len(of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for k in range(2):
            h = (names ^ np.uint64(0x632BE59BD9B4E019 * k)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            out[k, of[first]] = (np.minimum.reduceat(h, first) >> np.uint64(1)).astype(np.int64)
    return out


def pack_shard(docs: list[np.ndarray], ends: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the shard's documents."""
    pieces, sequence, filled = [], 0, 0
    unused = np.ones(len(docs), bool)
    index = Bm25Shard(docs, ends)
    queue: list[int] = []
    last = seed = -1
    for _ in range(len(docs)):
        doc = next((d for d in queue if unused[d]), -1)
        if doc < 0 and last >= 0:
            queue = index.neighbours(last, unused)
            doc = queue[0] if queue else -1
        if doc < 0:
            seed += 1 + int(np.argmax(unused[seed + 1 :]))
            doc = seed
        if not filled or not queue:
            queue = index.neighbours(doc, np.where(np.arange(len(docs)) == doc, False, unused)) if len(docs) > 1 else []
        unused[doc] = False
        last, start, rest = doc, 0, len(docs[doc])
        while rest:
            take = min(rest, window - filled)
            pieces.append((doc, start, take, sequence, filled))
            start, rest, filled = start + take, rest - take, filled + take
            if filled == window:
                sequence, filled, queue = sequence + 1, 0, []
    return _cut_at_powers(pieces, sequence, filled)


def _cut_at_powers(pieces: list[tuple[int, int, int, int, int]], sequence: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """The last sequence as several whose lengths are powers of two, largest first."""
    tail = [p for p in pieces if p[3] == sequence]
    out, at = pieces[: len(pieces) - len(tail)], 0
    for bit in range(filled.bit_length() - 1, -1, -1):
        size = 1 << bit
        if not filled & size:
            continue
        for doc, start, length, _, offset in tail:
            low, high = max(offset, at), min(offset + length, at + size)
            if low < high:
                out.append((doc, start + low - offset, high - low, sequence, low - at))
        at, sequence = at + size, sequence + 1
    return out


def _tokeniser(path: str, end_id: int, width: str, cache_bytes: int = CACHE_BYTES):
    """doc_id, ids and the routes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, cache_bytes)
        ends, end = tok.word_ends(), np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, "text", 2 << 20, owner="word_tokens"):
            ids, lengths = tok.encode_all(batch.column("text"), end)
            at = np.append(0, np.cumsum(lengths)) * np.dtype(width).itemsize
            column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype(width))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, *map(pa.array, routes(ids, lengths, ends))], ["doc_id", "ids", "route", "route2"])

    return run


def _packer(path: str, window: int, width: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = tokenizer(path).word_ends()
        base = TaskContext.get().partitionId() << 33
        names, held, total = [], [], 0

        def flush():
            nonlocal base
            pieces = pack_shard(held, ends, window)
            for i in range(0, len(pieces), 128):  # 2 MB of ids at most
                some = pieces[i : i + 128]
                doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*some))
                ids = [held[d][s : s + n].tobytes() for d, s, n, _, _ in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array([len(held[d]) for d in doc], pa.int64()), pa.array(sequence + base), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += pieces[-1][3] + 1 if pieces else 0

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(raw, width).astype("<u4")
                if held and (total + len(ids) > SHARD_TOKENS or len(held) == SHARD_DOCS):
                    yield from flush()
                    names, held, total = [], [], 0
                names.append(name)
                held.append(ids)
                total += len(ids)
        yield from flush()
        release()

    return pack


def pack_documents(docs: DataFrame, *, window: int = WINDOW, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. cache_bytes bounds what a worker remembers
    of words: less costs time, more costs memory."""
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)
    width = "<u2" if max(tokenizer(path).lib.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = table.mapInArrow(_tokeniser(path, end_id, width, cache_bytes), "doc_id long, ids binary, route long, route2 long")
    dealt = known.withColumn("place", F.monotonically_increasing_id()).hint("rebalance", "route").sortWithinPartitions("route", "route2", "place")
    return dealt.select("doc_id", "ids").mapInArrow(_packer(path, window, width), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
