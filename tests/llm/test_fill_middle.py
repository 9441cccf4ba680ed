"""Fill-in-the-middle against regular expressions and slices."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import fill_middle as fm

from ..compare import assert_twins
from .common import docs, nothing

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = LINE.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in fm.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "a\n", "\n", "\n\n\n", "a\nb", "a\nb\n", "é\n日本\n😀", "x<P>y\nz", "<", "<P", "<<P>", "<P\n>", "<S", "a<M>", "<\n<M\n>", "\r\n\r\na\tb", "<p>\n<P >"]


def odd_rows():
    rng = random.Random(8)
    rows = list(enumerate(TEXTS)) + [(None, "no id\nat all\n"), (None, None), (3, "a\n"), (3, "a\n")]
    return rows + [(100 + i, "".join(rng.choice("ab\n\n<PSM>é日") for _ in range(rng.randint(0, 120)))) for i in range(200)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, fm.CHUNK_BYTES])
def test_all_sizes_of_chunks_against_slices(spark, size):
    """Small chunks send every text through the distributed scan."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fm.fill_in_middle(df, chunk_bytes=size).select("*", fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute(*r) for r in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)


def test_rates(spark):
    rows = odd_rows()
    got = fm.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=60, spm_rate=20).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute(*r, rate=60, spm_rate=20) for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts_and_other_columns(spark):
    df = docs(spark).withColumns({c: F.lit("x") for c in ("text2", "h1", "met", "low", "part", "k", "form", "output")})
    long = spark.createDataFrame([(900, "line of a text\n" * 40_000), (901, "y" * 300_000), (902, "\n" * 200_000), (903, "x\n" * 70_000 + "<M>")], "doc_id long, text string")
    df = df.unionByName(long, allowMissingColumns=True)
    got = fm.fill_in_middle(df).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_empty_table(spark):
    out = fm.fill_in_middle(nothing(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_twin(spark, sf_dir):
    assert_twins(spark, sf_dir, fm.op13_fill_middle, fm.ORACLE)


def walk(own, data, state):
    """One byte after another."""
    begun = []
    for i, byte in enumerate(data):
        c = own.class_of[byte]
        if own.begins[c, state]:
            begun.append(i)
        state = own.steps[c, state]
    return state, begun


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n<PSM>", max_size=30), min_size=1, max_size=5))
def test_tree_equals_walking(texts):
    """Functions, counts and places of every unit for every entry state."""
    own = fm.Automaton()
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.cumsum([0, *map(len, raws)])
    tree, places = own.scan(data, starts[:-1])
    steps, counts = tree.whole()
    for run, raw in enumerate(raws):
        for state in range(own.states):
            end, begun = walk(own, raw, state)
            assert steps[run, state] == end and counts[run, state] == len(begun)
            if begun:
                nth = np.arange(len(begun))
                node, _, _ = tree.find(np.full(len(nth), run), np.full(len(nth), state), nth)
                assert (places[tree.levels[0][2][run] + node] - starts[run]).tolist() == begun


def test_words_that_overlap():
    own = fm.Automaton([b"aab", b"ab", b"ba"], b"|")
    for text in (b"aab", b"xab", b"aaab", b"bba", b"a|b", b"aa"):
        state, _ = walk(own, text, 0)
        assert bool(own.met(np.array([state]))[0]) == any(w in text for w in (b"aab", b"ab", b"ba"))
