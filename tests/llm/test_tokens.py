"""Token files, byte-level BPE and packing against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import byte_bpe as bb
from quillstone.llm import packing as pk
from quillstone.llm import token_files as tf
from quillstone.llm.word_tokens import WordTokenizer, default_path

from .common import docs, nothing, words


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    own = bb.encoder(bb.default_ranks(), bb.default_pattern())
    return own, tiktoken.Encoding("own", pat_str=bb.default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


ODD = ["", " ", "a  b", "\n\n", "it's<|endoftext|>x <|startoftext|>", "ÀÉ́ ΑΣ Σ a b\x85c\x0b d é", "123abc I'll", "日本語 テキスト😀", "\x1c\x1d a", "ﬁ ½", "K., a.b, . , .. x.' İ", "a" * 5000, " \nb", "b \n", "x  ", " y z"]


@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "The", "é", "😀", "12", ".,", "'s", "ß", "日", "\t", "́", "\xa0", "<|endoftext|>", "İ"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_word_tokens_equal_the_library(lib, text):
    got = np.frombuffer(WordTokenizerOnce.get().encode([text])[0], np.uint32).tolist()
    assert got == lib.encode(text, add_special_tokens=False).ids


class WordTokenizerOnce:
    made = None

    @classmethod
    def get(cls):
        cls.made = cls.made or WordTokenizer(default_path(), cache_bytes=9000)
        return cls.made


def test_word_tokens_odd_texts(lib):
    got = WordTokenizer(default_path(), cache_bytes=600).encode(ODD)
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in ODD]


def test_words_of_latin_letters_and_marks(lib):
    """Every character below U+0250 in a word, before marks and letters."""
    own = WordTokenizer(default_path())
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    texts = [w for c in chars for w in (c, f"{c}.,", f"a{c}!", f"{c}B'", f"X{c}\"y", f"'{c}.")]
    got = [np.frombuffer(g, np.uint32).tolist() for g in own.encode(texts)]
    wrong = [t for t, g in zip(texts, got) if g != lib.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_stores_are_bounded_by_bytes(tik):
    """Words without spaces between them are long; the stores empty in time."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 2000))) for _ in range(60)]
    own = WordTokenizer(default_path(), cache_bytes=200_000)
    own.encode(texts)
    own.encode([""])  # what is too much goes before the next batch
    assert own.known.held() <= 200_000
    known = bb._Known(tik[0], limit=200_000)
    for text in texts:
        known[text]
    held = sum(4 * len(w) + len(i) for store in (known, known.pieces) for w, i in store.items())
    assert held <= 200_000
    want = [tik[1].encode_ordinary(" " + t) for t in texts[-2:]]
    assert [np.frombuffer(known[t], np.uint32).tolist() for t in texts[-2:]] == want


def test_batches_of_texts_equal_tiktoken(tik):
    """Runs of white space, line ends and words, split and gathered by batches."""
    rng = random.Random(9)
    bits = ["a", "The", "I'm", "é", "日本", "😀", "42nd", ".", ",", "\n", "\n\n", "\t", " ", " ", " ", "  ", "\r\n", "\xa0", "\u2003", "\x85", "\x1f", "End."]
    texts = ["", "\n", "a\n\nb", "a\n\n b", "a\n\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    for begin in range(0, len(texts), 1000):
        some = texts[begin : begin + 1000]
        ids, sizes = tik[0].encode_all(pa.array([*some, None]))
        for text, one in zip([*some, ""], np.split(ids, np.cumsum(sizes)[:-1])):
            assert one.tolist() == tik[1].encode_ordinary(text), repr(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("dtype", [None, "<u4"])
def test_token_files_round_trip(spark, lib, dtype):
    df = docs(spark)
    manifest = tf.write_token_files(df, dtype=dtype)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tf.read_token_files(manifest).collect())
    rows = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in df.collect()]
    assert Counter((d, n, c) for _, d, n, c in got) == Counter((d, len(ids), crc(ids)) for d, ids in rows)
    at = 0
    for start, _, n, _ in got:  # gapless, in id order, nulls first
        assert start == at
        at += n
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert {r["width"] for r in manifest.collect()} == {4 if dtype else 2}


def test_token_files_split_rows_that_share_an_id(spark, lib):
    rows = [(None if k % 2 else 7, words(k, 20)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tf.write_token_files(df, partitions=6)
    assert manifest.filter("n_docs > 0").count() > 3
    got = tf.read_token_files(manifest).collect()
    assert len(got) == 200 and sum(r["n_tokens"] for r in got) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_remote_files_are_read_by_slices(tmp_path):
    ids = np.arange(1000, dtype="<u2")
    (tmp_path / "x").write_bytes(ids.tobytes())
    with open(tmp_path / "x", "rb") as raw:
        source = type("Source", (), {"size": lambda self: 2000, "read_at": lambda self, n, at: (raw.seek(at), raw.read(n))[1]})()
        part = tf._Slices(source, ids.dtype)
        assert np.array_equal(part[:7], ids[:7]) and np.array_equal(part[990:], ids[990:]) and np.array_equal(part[5:9], ids[5:9])


def test_token_files_empty(spark):
    assert tf.read_token_files(tf.write_token_files(nothing(spark))).count() == 0


@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "the", "ing", "é", "😀", "12", "!!", "'s", "\t", "AAAA", "\xa0", "\x1c", "日本"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_byte_bpe_equals_tiktoken(tik, text):
    own, ref = tik
    ids = np.frombuffer(own.encode(text), np.uint32).tolist()
    assert ids == ref.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_byte_bpe_long_pieces(tik):
    own, ref = tik
    for text in ["a" * 3000, " " * 500, "=" * 700, "abc" * 1000, *ODD]:
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == ref.encode_ordinary(text)


@given(st.text("abcdetin ", max_size=30), st.text("abcdetin ", max_size=10), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_prefix_table_appends_and_edits(tik, text, new, a, b):
    own, _ = tik
    raw, a, b = text.encode(), *sorted((min(a, len(text)), min(b, len(text))))
    table = bb.PrefixTable(own, raw[: len(raw) // 2])
    table.append(raw[len(raw) // 2 :])
    assert table.ids() == own._merged(raw, 1 << 60)
    table.edit(a, b, new.encode())
    assert table.ids() == own._merged(raw[:a] + new.encode() + raw[b:], 1 << 60)


def test_byte_bpe_query(spark, sf_dir, tik):
    _, ref = tik
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bb.op7_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ref.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_every_prefix_has_its_entry(tik):
    """The table's entry of each prefix is the last token of that prefix's encoding."""
    own, ref = tik
    for piece in (b" unbelievably", b"hello", "日本語".encode(), b"aaaaaaaaab", b" the"):
        table = bb.PrefixTable(own, piece)
        assert len(table.last) == len(piece)
        for i in range(1, len(piece) + 1):
            assert table.last[i - 1] == own._merged(piece[:i], 1 << 60)[-1]


def test_byte_bpe_edge_rows(spark, tik):
    _, ref = tik
    df = docs(spark)
    want = Counter((r["doc_id"], tuple(ref.encode_ordinary(r["text"] or ""))) for r in df.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in bb.encode_documents(df).collect()) == want
    assert bb.decode_documents(bb.encode_documents(nothing(spark))).count() == 0


def check_packing(pieces, documents, window=4096):
    """Each id in one piece; sequences gapless and not too long; texts whole."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= window
    for d, ids in documents.items():
        got = b"".join(x for _, x in sorted(by_doc[d]))
        assert got == np.array(ids, "<u4").tobytes()
    # Sequences are padded to the window, unless they end at a power of two.
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    return 1 - sum(sizes) / sum(n if n & (n - 1) == 0 else window for n in sizes)


def test_packing(spark, lib):
    df = docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in df.collect()}
    check_packing(pk.pack_documents(df).collect(), want)
    assert pk.pack_documents(docs(spark)).select(F.sum("length")).first()[0] == sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs(spark).collect())
    assert pk.pack_documents(nothing(spark)).count() == 0


def test_packing_has_little_padding(spark, sf_dir, lib):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: lib.encode(r["text"], add_special_tokens=False).ids + [2] for r in df.collect()}
    pieces = pk.pack_documents(df).collect()
    assert check_packing(pieces, want) == 0
    # Whole windows hold nearly all ids.
    filled = Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert sum(n for n in filled.values() if n == 4096) > 0.8 * sum(filled.values())


def test_routes_meet_where_words_are_shared(lib):
    own = WordTokenizer(default_path())
    ends = own.word_ends()
    base = words(3, 80)
    texts = [base, base.replace(base.split()[40], "another", 1), words(4, 80), "", "the the"]

    def route(some):
        got = [np.frombuffer(r, "<u4") for r in own.encode(some)]
        return pk.routes(np.concatenate(got), np.array([len(g) for g in got]), ends).T

    found = route(texts)
    assert (found[0] == found[1]).any() and not (found[0] == found[2]).any() and (found[3:] == 2**63 - 1).all()
    same = 0
    for k in range(60):  # a route is shared as often as a rare word is
        w = words(100 + k, 40).split()
        a, b = route([" ".join(w), " ".join(w[:30] + words(500 + k, 10).split())])
        same += int(a[0] == b[0])
    assert 20 < same < 50


def test_packing_query_equals_the_library(spark, sf_dir, lib):
    want = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    total = 0
    for r in pk.op4_packing(spark, sf_dir).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        total += r["length"]
    assert total == sum(map(len, want.values()))


def test_token_file_query_equals_the_library(spark, sf_dir, lib):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.op8_token_files(spark, sf_dir).collect()}
    at = 0
    for doc_id, text in rows:
        ids = lib.encode(text, add_special_tokens=False).ids + [1]
        assert got.pop(doc_id) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_neighbours_share_words():
    """Documents of one topic follow one another."""
    ends = np.zeros(200, bool)
    ends[100:] = True
    rng = np.random.default_rng(3)
    docs_, topic = [], []
    for k in range(60):
        own = np.arange(k % 6 * 15, k % 6 * 15 + 15)
        w = np.empty(200, np.uint32)
        w[::2], w[1::2] = rng.choice(own, 100), 100 + rng.choice(own, 100)
        docs_.append(w)
        topic.append(k % 6)
    order = []
    for doc, *_ in pk.pack_shard(docs_, ends, window=600):
        if doc not in order:
            order.append(doc)
    same = sum(topic[a] == topic[b] for a, b in zip(order, order[1:]))
    assert sorted(order) == list(range(60)) and same > 40


def test_shards_are_bounded(spark, monkeypatch, lib):
    rows = [(k, words(k, 50)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(pk, "SHARD_TOKENS", 700)
    want = {k: lib.encode(t, add_special_tokens=False).ids + [2] for k, t in rows}
    pieces = [r for batch in run_packer(df, pk) for r in batch.to_pylist()]
    check_packing(pieces, want)
    assert len({p["sequence_id"] for p in pieces}) > 5


def run_packer(df, module):
    """The packing task on the driver, where its bounds can be changed."""
    from types import SimpleNamespace
    from unittest import mock

    import pyarrow as pa

    table = pa.Table.from_pylist([{"doc_id": r["doc_id"], "text": r["text"]} for r in df.collect()])
    with mock.patch.object(module, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))):
        yield from module._packer(default_path(), 4096, "<u2")(module._tokeniser(default_path(), 2, "<u2")(iter(table.to_batches())))
