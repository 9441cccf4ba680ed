"""Language ID, toxicity and URL verdicts: held-out accuracy, gradients, edges."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language_id as li
from quillstone.llm import toxicity as tx
from quillstone.llm import url_filter as uf
from quillstone.llm.support import held_out

from .common import docs, nothing


def numeric(f, p, count=6, step=1e-2):
    """Slopes of f at some entries of p."""
    rng = np.random.default_rng(0)
    for _ in range(count):
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep = p[at]
        p[at] = keep + step
        up = f()
        p[at] = keep - step
        down = f()
        p[at] = keep
        yield at, (up - down) / (2 * step)


def test_language_gradients():
    net = li.ByteConvNet.fresh(["a", "b", "c"])
    rng = np.random.default_rng(1)
    w, y = rng.integers(0, 256, (9, 40)).astype(np.uint8), rng.integers(0, 3, 9)
    loss = lambda: -net.log_probabilities(w)[np.arange(9), y].mean()
    for p, g in zip(net.parameters(), net._gradients(w, y)):
        for at, slope in numeric(loss, p):
            assert abs(g[at] - slope) < 2e-2, (at, g[at], slope)


def test_toxicity_gradients():
    net, rng = tx.BiGru(30), np.random.default_rng(2)
    known = [f"{c}w{i}é" for c in "abc" for i in range(10)]
    words = tx.Words.of(known, {w: i + 1 for i, w in enumerate(known)})
    index, there = rng.integers(0, 30, (5, tx.TIMES)), np.ones((5, tx.TIMES), np.float32)
    there[0, 4:] = there[1, 20:] = 0
    y, weight = np.array([0, 1, 1, 0, 1], np.float32), np.array([1, 2, 1, 1, 0.5], np.float32)

    def loss():
        p = net.score(net.weighted(net.inputs(words.row, words.grid, words.begin)), index, there).astype(float)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean())

    for name, g in zip(net.NAMES, net._gradients(words, index, there, y, weight)):
        p = getattr(net, name)
        for at, slope in numeric(loss, p[1:] if name == "ew" else p, step=2e-3 if name in ("eb", "cf", "cb") else 1e-2):
            assert abs(g[at] - slope) < 1e-2, (name, at, g[at], slope)


def test_words_as_bytes():
    """Whole words between edges, whatever characters they hold."""
    words = ["a", "b\x01c", "\x00", "é" * 300, "x" * 5000]
    grid, begin = tx.byte_grid(words)
    ends = np.append(begin, len(grid))
    for w, b, e in zip(words, begin, ends[1:]):
        raw = [tx.EDGE, *w.encode(), tx.EDGE]
        assert grid[b:e].tolist() == [raw[i : i + 3] for i in range(len(raw) - 2)]
    some = tx.Words.of(words, {}).part(np.array([1, 3]))
    assert np.array_equal(some.grid, np.concatenate([grid[begin[1] : ends[2]], grid[begin[3] : ends[4]]])) and some.begin.tolist() == [0, 3]


def test_letters():
    assert not any(map(li.has_letter, ["", "12", "½ ²", "_-!", "\u0301", "😀"])) and all(map(li.has_letter, ["a", "é", "日", "1ß"]))


def test_windows_cover_whole_texts():
    grid, owner, size = li.windows_of([b"", b"x" * 300, b"y" * 128])
    assert size.sum() == 428 and np.bincount(owner).tolist() == [1, 3, 1]
    owner, first, size = tx.windows_of([0, 10, 32, 33, 100])
    for k, n in enumerate([0, 10, 32, 33, 100]):
        seen = {first[i] + j for i in np.flatnonzero(owner == k) for j in range(size[i])}
        assert len(seen) == n


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_accuracy_on_held_out_rows(spark, sf_dir, labelled):
    got = li.op1_language_id(spark, sf_dir).join(labelled.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == labelled.count()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_language_ignores_held_out_labels(spark, labelled):
    """Other labels on held-out rows change nothing."""
    other = labelled.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    model = li.train_language_model(other)
    assert "xx" not in model.labels
    same = li.train_language_model(labelled)
    assert all(np.array_equal(a, b) for a, b in zip(model.parameters(), same.parameters()))


def test_language_windows_of_all_epochs():
    """Each epoch draws its own windows, from all of a long text."""
    text = "".join(chr(97 + k % 26) * li.WINDOW for k in range(300))
    rows = [{"doc_id": 5, "text": text, "label": "x"}, {"doc_id": 6, "text": "short", "label": "y"}, {"doc_id": 7, "text": "", "label": "y"}]
    long, short, none = next(li._window_picker(8)(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    assert len(long["pieces"]) == li.EPOCHS * 8 * li.WINDOW and set(long["epochs"]) == set(range(li.EPOCHS))
    assert len({long["pieces"][i : i + li.WINDOW] for i in range(0, len(long["pieces"]), li.WINDOW)}) > 20
    assert len(short["epochs"]) == li.EPOCHS and none["epochs"] == b""


def test_language_edges(spark, labelled):
    model = li.train_language_model(labelled)
    df = docs(spark)
    got = {}
    for r in li.predict_language(df, model).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len([x for v in got.values() for x in v]) == df.count()
    assert got[1] == got[2] == got[3] == [("und", 0.0)] and got[8][0][0] != "und" and got[12][0][0] != "und"
    assert li.predict_language(nothing(spark), model).count() == 0
    assert li.train_language_model(nothing(spark)) is None
    assert {r["lang_pred"] for r in li.predict_language(df, None).collect()} == {"und"}
    kept = li.keep_known_language(df)
    assert kept.columns == df.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


TOXIC, PLAIN = ("vile", "rotten", "awful"), [f"w{i}" for i in range(200)]


def toxic_rows(n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        w = [PLAIN[i] for i in rng.integers(0, 200, rng.integers(5, 150))]
        bad = k % 4 == 0
        if bad:
            w[int(rng.integers(0, len(w)))] = TOXIC[k % 3].upper() + "," if k % 8 else TOXIC[k % 3]
        rows.append((k, " ".join(w), int(bad)))
    return rows


def test_toxicity_finds_one_word_anywhere(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(5, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    model = tx.train_toxicity(df, labels)
    out = tx.score_toxicity(df, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in out if r["held"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    again = tx.train_toxicity(df, labels)
    assert all(np.array_equal(getattr(model.net, k), getattr(again.net, k)) for k in tx.BiGru.NAMES)
    edge = tx.score_toxicity(docs(spark), model)
    assert edge.count() == docs(spark).count() and edge.filter("score is null or score < 0 or score > 1").count() == 0
    long = " ".join(PLAIN * 300 + ["vile"] + PLAIN * 300)
    assert model.scores([long, "", "vile"])[0] > 0.3


def test_toxicity_query_on_held_out_rows(spark, sf_dir):
    """The registered query, with enough labelled rows to learn from."""
    larger = sf_dir.replace("sf0.001", "sf0.1")
    if not os.path.isdir(larger):
        pytest.skip("the larger test tables are not here")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = tx.op3_toxicity(spark, larger).collect()
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert toxic and clean and np.mean(toxic) >= 0.75 and np.mean(clean) <= 0.03


def test_toxicity_of_control_characters(spark):
    rows = toxic_rows(120)
    model = tx.fit([[t.split()] for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = ["".join(map(chr, range(32))) + " a", "a\x01b c", "\x00\x00", "\x7f\x80", "日本" * 3000, "\ud800 x".encode("utf-8", "replace").decode()]
    assert ((0 <= model.scores(texts)) & (model.scores(texts) <= 1)).all()


def test_toxicity_of_long_labelled_texts(spark):
    """A long text is learned by some of its windows, spread over all of it."""
    rows = [(k, " ".join([*PLAIN * 40, *["vile"] * (k % 2 * 900), *PLAIN * 40])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = tx.train_toxicity(df, labels, windows=64)
    assert isinstance(model, tx.ToxicityModel)
    pieces = next(tx._window_texts(64)(iter([pa.RecordBatch.from_pylist([{"at": 1, "doc_id": 3, "label": 1, "text": rows[3][1]}])]))).to_pylist()[0]
    assert len(pieces["pieces"]) == 64 and 0 < pieces["share"] < 0.1


def test_toxicity_edges(spark):
    """Without both classes: a warning, and the label's share as every score."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no labelled rows"):
        model = tx.train_toxicity(docs(spark), labels)
    assert {r["score"] for r in tx.score_toxicity(docs(spark), model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 1) for i in (5, 8, 10)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no labelled rows"):
        assert tx.train_toxicity(docs(spark), one).share > 0.5
    assert tx.score_toxicity(nothing(spark), model).count() == 0
    few = tx.fit([[["bad", "word"]], [["good", "word"]]], np.array([1, 0]))
    assert few.scores(["bad word"])[0] >= few.scores(["good word"])[0]


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(h + p, says) for h, p, says in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: len(r[0]), default=(None, None))
    return host, path, best[0], best[1]


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org/es/", "http://x.example.org/es", "http://notexample.org/es/1", "ftp://com/fr/", "http://a.com?q=/fr/", "http://a.com#/de/", "http://a.com/de/x?y",
    "x://y://z/fr/", "http://é.COM/fr/ü", "http://example.org/en/1", "http://example.org/en/2", "http://org/", "http://org", "http://cheap-pills.net/buy", "http://a.com/\n/fr/", "https://casino.net/win/bonus",
]


def test_url_rules_against_brute_force(spark):
    df = spark.createDataFrame([(k, u, None, "x", "y") for k, u in enumerate([*URLS, URLS[4]])] + [(None, "http://org/", None, "", "")], "page_id long, url string, html string, host string, score string")
    got = uf.judge_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = ([*URLS, URLS[4]])[r["page_id"]] if r["page_id"] is not None else "http://org/"
        host, path, rule, verdict = brute_url(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert uf.judge_urls(df.limit(0)).count() == 0


def test_url_model_learns_its_table():
    weights, bias = uf.train()
    right = []
    for url, y in uf.LABELLED:
        host, path, *_ = brute_url(url)
        f = uf.features(host, path)
        right.append((weights[f].sum() / np.sqrt(len(f)) + bias > 0) == bool(y))
    assert np.mean(right) == 1.0
    for url, y in (("http://cheap-pills.example.net/order", 1), ("http://free-casino.example.com/bonus", 1), ("https://news.example.net/article/12", 0), ("https://museum.example.com/guide", 0)):
        host, path, *_ = brute_url(url)
        f = uf.features(host, path)
        assert (weights[f].sum() / np.sqrt(len(f)) + bias > 0) == bool(y), url


def test_language_rejects_row_by_row(spark, monkeypatch):
    """Null and repeated ids: a blank text goes, a clean one of the same id stays."""

    class Sure:
        labels = ["en"]

        def predict(self, texts):
            return np.ones((len(texts), 1))

    monkeypatch.setattr(li, "train_language_model", lambda *a, **k: None)
    predictor = li._predictor
    monkeypatch.setattr(li, "_predictor", lambda model, *more: predictor(Sure(), *more))
    rows = [(None, None), (None, "a clean text"), (7, " \n"), (7, "another clean text"), (8, "12 34")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in li.keep_known_language(df).collect()} == {(None, "a clean text"), (7, "another clean text")}


def test_url_query_against_brute_force(spark, sf_dir):
    """Hosts, paths and rules by plain Python; the rest by the model's score."""
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = uf.op5_url_filter(spark, sf_dir).collect()
    assert {r["page_id"] for r in got} == set(urls) and len(got) == len(urls)
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
        fits = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[2] if fits else None)
        assert r["verdict"] == (max(fits)[1] if fits else "block" if r["score"] >= 0.5 else "allow")
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_language_scores_against_one_text_at_a_time(spark, sf_dir):
    """Batches and partitions change nothing: each text scored by itself."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    model = li.train_language_model(df)
    for r in li.predict_language(df.repartition(5), model).join(df.select("doc_id", "text"), "doc_id").collect():
        if r["text"] and li.has_letter(r["text"]):
            row = model.predict([r["text"].encode()])[0]
            assert r["lang_pred"] == model.labels[int(row.argmax())] and abs(r["score"] - min(row.max(), 1.0)) < 1e-5
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
