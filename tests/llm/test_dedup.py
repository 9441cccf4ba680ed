"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import exact_dedup as ed
from quillstone.llm import near_dedup as nd

from ..compare import assert_twins
from .common import CLASH, docs, nothing, words


def brute_exact(rows):
    groups = defaultdict(list)
    for place, (i, t) in enumerate(rows):
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0d]", "", t)].append((-len(t), i is None, i or 0, place))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out[(rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("size", [3, 64, 8192])
def test_exact_against_brute_force(spark, size):
    """Small blocks make many levels of names."""
    df = docs(spark).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["text"] is None or len(r["text"]) < 1000 or size > 3]
    df = df.filter("text is null or length(text) < 1000" if size == 3 else "true")
    got = ed.exact_dedup(df, block_bytes=size).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})


def test_exact_filter_keeps_columns_and_one_of_each(spark):
    df = docs(spark)
    out = ed.drop_exact_duplicates(df)
    assert out.columns == df.columns
    norm = [re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "") for r in out.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "") for r in df.collect()})


def test_exact_twin(spark, sf_dir):
    assert_twins(spark, sf_dir, ed.op2_exact_dedup, ed.ORACLE)


def test_exact_is_native(spark, sf_dir):
    plan = ed.op2_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_signature_clash_changes_the_salt(spark, monkeypatch):
    """With a signature that confuses all blocks, names are made again."""
    from pyspark.sql import functions as F

    real = ed._signature
    monkeypatch.setattr(ed, "_signature", lambda b, salt: (F.lit(0).cast("long"), F.lit(0).cast("long")) if salt < 2 else real(b, salt))
    got = ed.exact_dedup(docs(spark)).collect()
    assert len({(r["level"], r["name"]) for r in got}) == len({r["text_sha256"] for r in got})


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = comp[i], comp[j]
                if x != y:
                    comp = [y if c == x else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return Counter((rows[k][0], len(sets[k]), least[comp[k]]) for k in range(len(rows)))


def near(df, **more):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_dedup(df, **more).collect())


def test_near_against_brute_force(spark):
    df = docs(spark)
    assert near(df) == brute_near([(r["doc_id"], r["text"]) for r in df.collect()])


def variants(n, edits, size=90, seed=5):
    """Copies of one text with random edits, so that links form chains and stars."""
    rng, base, out = random.Random(seed), words(seed, size).split(), []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((k + 100, " ".join(w)))
    return out


def test_near_group_at_the_threshold(spark):
    """A dense group around the threshold: stars alone would not find all links."""
    rows = variants(120, 4) + variants(40, 2, size=9, seed=6) + [(k, words(k, 40)) for k in range(50)]
    rows = [(i if i < 100 else i + 1000 * (k >= 120), t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == brute_near(rows)
    assert near(df, percent=85, band_rows=6) == brute_near(rows, 85)


def test_near_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.op6_near_dedup(spark, sf_dir).collect())
    assert got == brute_near(rows, 85)


@pytest.mark.parametrize("limits", [(0, 1, 1), (0, 4, 3), (2, 1000, 1)])
def test_near_leftover_paths(spark, monkeypatch, limits):
    """Without listed pairs, and with small blocks, also of large components."""
    monkeypatch.setattr(nd, "SMALL", limits[0])
    monkeypatch.setattr(nd, "OWN_BLOCKS", limits[1])
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(nd, "UNITS", limits[2])
    rows = variants(60, 4, seed=8)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


def test_near_members_of_large_buckets(spark):
    """Texts with much in common: none of their buckets is small, few are linked, and
    what they have in common does not bring them together."""
    common, rng, rows = words(90, 70), random.Random(4), []
    for k in range(150):
        own = words(1000 + k // 2, 12).split()
        own[rng.randrange(12)] = f"e{k % 3}"
        rows.append((k, f"{common} {' '.join(own)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert near(df) == want and 1 < len({c for _, _, c in want}) < 150


def test_short_codes_lose_no_link(monkeypatch):
    """Counts over codes are upper bounds, also where codes clash and widths differ."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    monkeypatch.setattr(nd, "LONG_SET", 700)
    pool = np.unique(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    pool[:900] = (pool[:900] << np.uint64(16)) | (np.arange(900, dtype=np.uint64) % np.uint64(60))
    sets = [np.unique(rng.choice(pool, rng.integers(500, 1400), replace=False)) for _ in range(12)]
    batch = pa.RecordBatch.from_pylist([{"cls": bytes([i]), "n": len(s), "members": s.tobytes()} for i, s in enumerate(sets)])
    rows = next(nd._codes(iter([batch]))).to_pylist()
    for percent in (20, 50, 60):
        found = set(zip(*(a.tolist() for a in nd.possible_links(rows[:6], rows[6:], percent))))
        for i in range(6):
            for j in range(6):
                common = len(np.intersect1d(sets[i], sets[6 + j]))
                if 100 * common >= percent * (len(sets[i]) + len(sets[6 + j]) - common):
                    assert (i, j) in found


def test_prefixes_of_linked_sets_meet():
    """Linked sets share an element of their prefixes, however elements are ranked."""
    rng = np.random.default_rng(6)
    for percent in (80, 85, 100):
        for _ in range(300):
            base = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
            other = base.copy()
            for i in rng.integers(0, len(base), rng.integers(0, 6)):
                other[i] = rng.integers(0, 2**63, dtype=np.uint64)
            other = np.unique(other)
            common = len(np.intersect1d(base, other))
            if 100 * common >= percent * (len(base) + len(other) - common):
                counts = rng.integers(0, 5, nd.SLOTS)
                assert len(np.intersect1d(nd.prefix(base, percent, counts), nd.prefix(other, percent, counts)))


def test_near_filter(spark):
    df = docs(spark)
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns and {5, 6, 7} & {r["doc_id"] for r in out.collect()} == {5}


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 900):
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = rng.integers(0, 2**63, max(n // 5, 1), dtype=np.uint64)
        a, b = np.sort(common), np.sort(np.append(common, extra))
        s = nd.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != 0).all() and abs((s[0] == s[1]).mean() - len(a) / len(b)) < 0.2


def test_block_products_count_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(23)]
    got = nd.common_counts(sets[:10], sets[10:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[10 + j])) for i in range(10) for j in range(13))


@pytest.mark.parametrize("f", [ed.exact_dedup, nd.near_dedup, ed.drop_exact_duplicates, nd.drop_near_duplicates])
def test_empty_table(spark, f):
    assert f(nothing(spark)).count() == 0


def test_near_has_no_pairs_in_a_table_of_strangers(spark):
    rows = [(k, words(k + 1, 30)) for k in range(30)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == brute_near(rows)


assert len(CLASH) > 10


def test_near_duplicates_go_row_by_row(spark):
    """Null and repeated ids: a copy goes, another text of the same id stays."""
    base, alone, other = words(70, 60), words(71, 60), words(72, 60)
    rows = [(5, base), (None, base), (None, alone), (9, base), (9, other), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {tuple(r) for r in nd.drop_near_duplicates(df).collect()}
    assert left == {(5, base), (None, alone), (9, other), (None, None)}


def test_exact_filter_of_rows_without_ids(spark):
    """Many kept rows share the null id; copies go, the others stay."""
    rows = [(None, f"text {k}") for k in range(50)] + [(None, "text 3"), (1, "text  4"), (2, "other"), (2, "text 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(tuple(r) for r in ed.drop_exact_duplicates(df).collect())
    want = Counter((None, f"text {k}") for k in range(50) if k not in (4, 5)) + Counter([(1, "text  4"), (2, "other"), (2, "text 5")])
    assert left == want
