"""Nearest neighbours, personal data and the pipeline against brute force."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import ann, pii

from .common import BASE, docs, nothing, words


def brute_nearest(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def search(df, **more):
    got = defaultdict(list)
    for r in ann.nearest(df, **more).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in w}) / max(len(w), 1) for q, w in want.items()])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string, ids string")


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_exact_scores(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:  # inner products of vectors of different lengths
        x *= rng.uniform(0.5, 1.5, (3000, 1)).astype(np.float32)
    want = brute_nearest(np.arange(3000), x.astype(float), 20, 20)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, found in got.items():
        assert all(abs(s - float((x[i].astype(float) * x[q]).sum())) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))


def test_second_hash_for_many_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 2000)] + 0.15 * rng.normal(size=(2000, 16))).astype(np.float32)
    want = brute_nearest(np.arange(2000), x.astype(float), 20, 5)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]), k=5, per_bucket=8, probes=24)
    assert recall(got, want) >= 0.9


def test_recall_stays_when_buckets_are_many_times_too_large(spark):
    """Unclustered vectors, the defaults' tables and probes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = brute_nearest(np.arange(4000), x.astype(float), 100, 20)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]), every=100, per_bucket=4)
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("lengths", ["one", "lognormal"])
def test_skewed_lengths(spark, lengths):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(3000) == 7, 10, 1)[:, None].astype(np.float32) if lengths == "one" else rng.lognormal(0, 1, (3000, 1)).astype(np.float32)
    want = brute_nearest(np.arange(3000), x.astype(float), 20, 20)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]))
    assert set(got) == set(want) and all(len(f) == 20 for f in got.values()) and recall(got, want) >= 0.9


@pytest.mark.parametrize("n", [10, 21])
def test_small_tables_give_all_candidates(spark, n):
    x = np.random.default_rng(10).normal(size=(n, 64)).astype(np.float32)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)] + [(0, x[0].tolist(), 0, "", "")]), every=1)
    assert all({a for a, _ in got[i]} == set(range(n)) - {i} for i in range(n))


def test_copies_and_ties(spark, monkeypatch):
    """A vector that most rows repeat: blocks, ties by id, each id once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:450] = x[50]
    want = brute_nearest(np.arange(600), x.astype(float), 20, 20)
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)] + [(60, x[60].tolist(), 0, "", "")]
    got = search(vectors(spark, rows), probes=8)
    assert recall(got, want) >= 0.9
    assert [a for a, _ in got[60]] == [a for a, _ in want[60]]


def test_a_hot_vector_is_one_class(spark):
    """Half of all rows are equal: each of their queries finds the smallest other ids,
    and blocks of rows and queries are smaller than the bucket."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[100:500] = x[100]
    want = brute_nearest(np.arange(800), x.astype(float), 20, 20)
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]), per_bucket=5)
    assert recall(got, want) >= 0.9
    assert [a for a, _ in got[120]] == [a for a, _ in want[120]] and [a for a, _ in got[480]] == [a for a, _ in want[480]]


def test_dimensions_are_searched_apart(spark):
    rng = np.random.default_rng(17)
    rows = [(i, rng.normal(size=(3, 8, 33)[i % 3]).astype(np.float32)) for i in range(90)]
    got = search(vectors(spark, [(i, v.tolist(), 0, "", "") for i, v in rows]), every=1)
    size, want = dict((i, len(v)) for i, v in rows), {}
    for n in (3, 8, 33):
        same = [(j, w) for j, w in rows if len(w) == n]
        want |= brute_nearest(np.array([j for j, _ in same]), np.stack([w for _, w in same]).astype(float), 1, 20)
    assert all(len(f) == 20 and {size[j] for j, _ in f} == {size[i]} for i, f in got.items()) and recall(got, want) >= 0.9


def test_query_recall(spark, sf_dir):
    """The registered query, on two sizes of the test table."""
    for folder in (sf_dir, sf_dir.replace("sf0.001", "sf0.1")):
        if not os.path.isdir(folder):
            continue
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
        rows = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] is not None]
        want = brute_nearest(np.array([i for i, _ in rows]), np.array([v for _, v in rows], float), 20, 20)
        got = defaultdict(list)
        for r in ann.op9_ann(spark, folder).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert set(got) == set(want) and all(len(f) == len(want[q]) for q, f in got.items()) and recall(got, want) >= 0.9


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 0, "", ""), (1, [0.5, 0.5], 0, "", ""), (20, None, 0, "", ""), (40, [0.0, 0.0], 0, "", ""), (60, [float("nan"), 1.0], 0, "", ""), (80, [1.0, None], 0, "", ""), (100, [float("inf"), 1.0], 0, "", ""), (None, [1.0, 1.0], 0, "", ""), (120, [2.0], 0, "", ""), (140, [], 0, "", ""), (1, [0.5, 0.5], 0, "", "")]
    assert dict(search(vectors(spark, rows))) == {0: [(1, 0.5)]}
    assert ann.nearest(vectors(spark, [])).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(7).normal(size=(5, 16))
    y = ann.hadamard(x.copy())
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(ann.hadamard(y), x)


RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx) in enumerate(RX.items()) for m in re.finditer(rx, text or "") if holds(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


TRICKY = [
    "a@b.c@d.e", "a@b.cx_y@d.e", "x@y", "x@y.", "a.b+c%d@e-f.g.h", "éa@b.co", "@@a@b.c", "1.2.3.4.5.6.7.8", "01.002.0003.255", "256.1.1.1 1.1.1.1", "4111-1111 1111-1111", "4111 1111 1111 1112", "+1 (650) 555-0199", "+1234567890123456",
    "++1 234 567 8901", "9" * 400, "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "😀 a@b.c 日本 10.0.0.1", "4111111111111111+14155550199", "a@b.c" * 40, "1.1.1.1" * 9, "\n+44 20 7946 0958\n", "x" * 5000 + "@", "1" * 20000,
]


def digest_of(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    return {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(df)).collect()}


def check(got, texts):
    for k, t in enumerate(texts):
        want = brute_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:80], want, got[k]["spans"])
        assert [s for s in got[k]["spans"].split(",") if s and not s.startswith("term")] == want
        assert Counter(s.split(":")[0] for s in want) == Counter({n: got[k][f"n_{n}"] for n in RX if got[k][f"n_{n}"]})


def test_patterns_on_tricky_texts(spark):
    check(digest_of(spark, TRICKY), TRICKY)


@given(st.lists(st.lists(st.sampled_from(["a@b", ".c", "@", "x", "_", "1.1.", "255", "256.0.0.1", "4111 1111 1111 1111", " ", "-", "+1", "(650)", "5550199", "12345", "é", "😀", "."]), max_size=14).map("".join), min_size=20, max_size=40))
@settings(max_examples=8, deadline=None)
def test_patterns_on_random_texts(spark, texts):
    check(digest_of(spark, texts), texts)


def test_pii_query_is_native_and_right(spark, sf_dir):
    df = pii.op10_pii(spark, sf_dir)
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", df._jdf.queryExecution().toString())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in df.collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(brute_spans(texts[r["doc_id"]])).encode()).hexdigest()


def revealing_corpus():
    """The value's owner is named beside it in several texts, and nowhere else."""
    rows = [(k, words(k, 30)) for k in range(200)]
    for k in range(6):
        rows[k * 20] = (k * 20, f"{words(900 + k, 9)} the director Quibblewick writes from q@secret.example.org {words(950 + k, 9)} to the others")
    for k in range(1, 200):
        if k % 20:
            rows[k] = (k, rows[k][1] + " the others")
    return rows


def test_revealing_terms_are_found_and_common_ones_are_not(spark):
    rows = revealing_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(df).collect()
    terms = {dict(rows)[r["doc_id"]][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] == 4}
    assert "Quibblewick" in terms and not {"the", "others"} & {t.lower() for t in terms}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Quibblewick" not in clean[0] and "[EMAIL]" in clean[0] and "@" not in clean[0] and clean[1] == dict(rows)[1]


@pytest.mark.parametrize("contexts", [1, 2])
def test_terms_of_rare_values_are_found(spark, contexts):
    rows = [(k, words(k, 12) + " the others") for k in range(5000)]
    for k in range(contexts):
        rows[k] = (k, f"{words(9000 + k, 9)} the director Quibblewick writes from q@secret.example.org {words(9100 + k, 9)} to the others")
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).filter(f"doc_id < {contexts}").collect()
    terms = {dict(rows)[r["doc_id"]][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] == 4}
    assert "Quibblewick" in terms and not {"the", "others"} & terms


def test_copies_of_a_revealing_text_do_not_hide_its_term(spark):
    rows = [(k, words(k, 12)) for k in range(300)]
    for k in range(4):
        rows[k] = (k, f"{words(9000 + k, 9)} the director Quibblewick writes from q@secret.example.org {words(9100 + k, 9)} to the others")
    rows += [(1000 + k, rows[0][1]) for k in range(500)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marks = {rows[r["doc_id"]][1][s["start"] : s["end"]]: s["mark"] for r in found if r["doc_id"] < 4 for s in r["spans"]}
    assert marks["Quibblewick"] == "[TERM]"


def test_copies_reveal_nothing(spark):
    df = spark.createDataFrame([(k, "Mortimer writes from a@b.example.org today") for k in range(30)] + [(k, words(k, 20)) for k in range(30, 60)], "doc_id long, text string")
    assert all(s["kind"] < 4 for r in pii.find_personal_data(df).collect() for s in r["spans"])


def test_sanitiser_edges(spark):
    df = docs(spark)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    # Words beside the values may be marked as terms, the values always are.
    assert re.fullmatch(r"\S+ \[PHONE\], \S+ \[CARD\], \S+ \[IP\] \S+ 10\.0\.0\.256", text[10]), text[10]
    unnamed = [r["text"] for r in out.collect() if r["doc_id"] is None]
    assert None in unnamed and [x for x in unnamed if x and "[EMAIL]" in x and "@" not in x]
    assert text[5] == BASE and text[1] is None
    assert pii.sanitise(nothing(spark)).count() == 0 and pii.find_personal_data(nothing(spark)).count() == 0
    wide = spark.createDataFrame([(1, "😀é a@b.example.org, 10.0.0.1😀")], "doc_id long, text string")
    assert pii.sanitise(wide).first()["text"] == "😀é [EMAIL], [IP]😀"
    one = spark.createDataFrame([(1, "+4111111111111111 x")], "doc_id long, text string")
    assert pii.sanitise(one).first()["text"] == "+[CARD] x"


def test_pipeline_against_brute_force(spark, sf_dir):
    """The stages in turn, each on what the one before kept."""
    import corpus_pipeline as cp

    from .test_dedup import brute_exact, brute_near

    stages = dict(cp.STAGES)
    assert [k for k, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"] and cp.ORACLE_SQL is None
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = spark.createDataFrame(stages["language_id"](spark, df, sf_dir).collect(), df.schema)
    assert one.count() == df.count()
    two = spark.createDataFrame(stages["exact_dedup"](spark, one, sf_dir).collect(), df.schema)
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    assert {r["doc_id"] for r in two.collect()} == {keep for _, keep, _, _ in brute_exact(rows)}
    three = spark.createDataFrame(stages["near_dedup"](spark, two, sf_dir).collect(), df.schema)
    rows = sorted((r["doc_id"], r["text"]) for r in two.collect())
    assert {r["doc_id"] for r in three.collect()} == {c for _, _, c in brute_near(rows)}
    four = stages["pii"](spark, three, sf_dir)
    assert four.columns == df.columns and four.count() == three.count()
    assert not any(re.search(RX["email"], r["text"]) for r in four.collect())
    five = cp.run(spark, sf_dir)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == {r["doc_id"] for r in three.collect()}


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_empty_and_odd_tables(spark, tmp_path, kind):
    """No rows; null and repeated ids, clashing columns, texts of all sizes."""
    import corpus_pipeline as cp

    df = nothing(spark) if kind == "empty" else docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert got == []
        return
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    kept = {r["doc_id"] for r in got}
    assert kept <= {r["doc_id"] for r in df.collect()} and not kept & {1, 2, 3} and len(kept & {5, 6, 7}) == 1
