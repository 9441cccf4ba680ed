"""Best-fit packing on counts, and its tokenizer, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import best_fit as bf
from quillstone.llm import byte_tokens

from .common import CLASH, docs, nothing


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokens.default_path())


def check_tokens(own, lib, texts):
    ids, sizes = own.encode(pa.array([*texts, None]), np.array([7], "<u4").tobytes())
    for text, one in zip([*texts, ""], np.split(ids, np.cumsum(sizes)[:-1])):
        assert one.tolist() == [*lib.encode(text, add_special_tokens=False).ids, 7], repr(text)


def test_tokens_equal_the_library(lib):
    own, rng = byte_tokens.ByteTokenizer(byte_tokens.default_path()), random.Random(3)
    bits = ["a", "The", "I'm", "don't", "é", "ɐx", "ʼn", "日本", "😀", "1", "42nd", ".", ",", "...", "\n", "\n\n", "\t", " ", "  ", "\r\n", " ", " ", "\x85", "_", "x" * 40, "<|endoftext|>", "End.", "ß;", "\x00", "İ"]
    texts = ["", " ", "\n", "\n\nb", "a\n\nb", "a\n\n b", "a\n\n\nb", "a\u2003\nb", "a\n\u2003b", "a\n\n", "\na", "a\nb", "a \nb", "a\n b", "a.\nb c", "end\n", " a", "a\x1fb"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    check_tokens(own, lib, texts)


def test_words_kept_are_bounded(lib):
    own = byte_tokens.ByteTokenizer(byte_tokens.default_path(), cache_bytes=4000)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(20)] + ["y" * 5000]
    check_tokens(own, lib, texts)
    for text in texts:  # batch by batch
        check_tokens(own, lib, [text])
    own.encode(pa.array([""]))
    assert own.later.held() <= 4000 and own.first.held() <= 1000


def brute_best_fit(lengths, window):
    """Number of sequences, documents one by one, longest first."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_best_fit_over_single_pieces(window, lengths):
    lengths = [min(n, window) for n in lengths]
    hist = Counter(lengths)
    runs = bf.plan_slots(hist, window)
    slots, used = defaultdict(list), Counter()
    for length, low, n, first, each, place in runs:
        assert low == used[length]
        used[length] += n
        for i in range(n):
            slots[first + i // each].append((place + i % each * length, length))
    assert used == hist
    rooms = []
    for held in slots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
        rooms.append(window - at)
    assert sorted(rooms) == brute_best_fit(lengths, window)
    assert sorted(slots) == list(range(len(slots)))


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(5)
    hist = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    small = bf.plan_slots(hist)
    large = bf.plan_slots({n: c * 10**9 for n, c in hist.items()})
    assert len(small) < 8192 and len(large) < 8192
    total = sum(n * c for n, c in hist.items()) * 10**9
    used = 1 + max(first + -(-n // each) - 1 for _, _, n, first, each, _ in large)
    assert used <= total / 1024 * 1.01


def check(lib, rows, out, window):
    """Every id in one piece, pieces as told, sequences gapless."""
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % window or window
        cuts = [0, *range(head, len(ids), window), len(ids)] if len(ids) > window else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    lengths = [n for _, _, _, n, _ in want.elements()]
    assert len(held) == len(brute_best_fit(lengths, window)) if len(lengths) < 3000 else True


@pytest.mark.parametrize("window", [7, 64, 1024])
def test_pieces_of_odd_documents(spark, lib, window):
    df = docs(spark).filter("text is null or length(text) < 100000").repartition(3)
    out = [r.asDict() | {"crc": zlib.crc32(r["ids"])} for r in bf.pack_best_fit(df, window=window).collect()]
    check(lib, [(r["doc_id"], r["text"]) for r in df.collect()], out, window)


def test_query_against_brute_force(spark, sf_dir, lib):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = [r.asDict() | {"crc": r["ids_crc32"]} for r in bf.op11_best_fit(spark, sf_dir).collect()]
    check(lib, rows, out, 1024)


def test_a_hot_length_in_many_partitions(spark, lib):
    rows = [(i, "one two three" if i % 3 else f"w{i} " * (i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    out = [r.asDict() | {"crc": zlib.crc32(r["ids"])} for r in bf.pack_best_fit(df, window=16).collect()]
    check(lib, rows, out, 16)


def test_empty_table_and_other_columns(spark):
    assert bf.pack_best_fit(nothing(spark)).count() == 0
    clash = docs(spark).filter("doc_id < 4").withColumns({c: F.lit("x") for c in ("part", "nth", "length", "rank", "size", "low")})
    assert bf.pack_best_fit(clash).columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
