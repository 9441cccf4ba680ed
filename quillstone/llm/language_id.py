"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, the
largest response of each filter in a window is kept, and a softmax layer names the
language. A text's scores are the mean over all of its windows, weighted by their
bytes. The network is trained here in numpy (Adam on mini-batches of windows).

Training uses a bounded sample: at most ``per_language`` documents of each label,
the ones with the smallest hash of their id. Each epoch draws ``windows`` windows of
each document anew, at random over its whole text (all of them, if it has no more).

Defined results: a text that is null or has no letter is ``und`` with score 0.
Without any labelled row every text is ``und``. Languages with the same score are
decided by the label's order. Rows that repeat are judged alike, extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import Scratch, chunks, held_out, only_ids, text_key, without_rows

UND = "und"
WINDOW = 128
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 6
PER_LANGUAGE, WINDOWS, EPOCHS, BATCH, RATE = 400, 8, 24, 64, 3e-3
_ascii_letter = re.compile(r"[A-Za-z]").search


def has_letter(text: str) -> bool:
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text))


def windows_of(raws: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows side by side over each text (the last one padded with zeros),
    the text each belongs to, and its number of bytes."""
    lengths = np.array([len(r) for r in raws])
    counts = np.maximum(1, -(-lengths // size))
    flat = np.zeros(int(counts.sum()) * size, np.uint8)
    at = np.append(0, np.cumsum(counts))
    for raw, b in zip(raws, at.tolist()):
        flat[b * size : b * size + len(raw)] = np.frombuffer(raw, np.uint8)
    owner = np.repeat(np.arange(len(raws)), counts)
    within = np.arange(len(owner)) - at[owner]
    return flat.reshape(-1, size), owner, np.clip(lengths[owner] - within * size, 0, size)


@dataclass
class ByteConvNet:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(labels: list[str], seed: int = 7) -> "ByteConvNet":
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return ByteConvNet(
            labels, draw(256, EMBED, scale=0.5), [draw(w * EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, len(labels), scale=0.2), np.zeros(len(labels), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def _grams(self, x: np.ndarray, width: int) -> np.ndarray:
        """Embedded windows (n, size, EMBED) as rows of width neighbours."""
        n, size, dim = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, size * dim), width * dim, axis=1)[:, ::dim]
        return np.ascontiguousarray(view).reshape(-1, width * dim)

    def features(self, windows: np.ndarray) -> np.ndarray:
        """The largest response of each filter; at least 0, as after a rectifier."""
        x, out = self.embed[windows], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            y = (self._grams(x, w) @ f).reshape(len(windows), -1, FILTERS)
            out.append(np.maximum(y.max(axis=1) + b, 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _gradients(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, x = len(windows), self.embed[windows]
        kept = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            grams = self._grams(x, w)
            r = (grams @ f).reshape(n, -1, FILTERS)
            top = r.argmax(axis=1)
            kept.append((grams.reshape(n, -1, grams.shape[1]), top, np.take_along_axis(r, top[:, None], 1)[:, 0] + b))
        h = np.concatenate([np.maximum(v, 0) for _, _, v in kept], axis=1)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_embed = np.zeros_like(self.embed)
        back, d_filters, d_biases = p @ self.out.T, [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            grams, top, value = kept[k]
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * (value > 0)
            rows = grams[np.arange(n)[:, None], top]  # n, FILTERS, w * EMBED
            d_filters.append(np.einsum("nfd,nf->df", rows, g))
            d_biases.append(g.sum(axis=0))
            d_rows = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(d_embed, windows[np.arange(n)[:, None], top + j], d_rows[:, :, j])
        return [d_embed, *d_filters, *d_biases, h.T @ p, p.sum(axis=0)]

    def train(self, windows: np.ndarray, y: np.ndarray, *, epoch: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> "ByteConvNet":
        """epoch: the one that each window was drawn for; without it, all are for all."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for now in range(epochs):
            order = rng.permutation(len(y) if epoch is None else np.flatnonzero(epoch == now))
            for begin in range(0, len(order), BATCH):
                some = order[begin : begin + BATCH]
                step += 1
                for p, g, m, v in zip(self.parameters(), self._gradients(windows[some], y[some]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, raws: list[bytes]) -> np.ndarray:
        """Probabilities of the labels for each text."""
        windows, owner, size = windows_of(raws)
        total = np.zeros((len(raws), len(self.labels)))
        for begin in range(0, len(windows), 1024):
            part = slice(begin, begin + 1024)
            np.add.at(total, owner[part], np.exp(self.log_probabilities(windows[part])) * size[part, None])
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def train_language_model(docs: DataFrame, *, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", exclude_held_out: bool = True) -> ByteConvNet | None:
    """Train on labelled rows that are not held out; None without any."""
    scratch = Scratch(docs.sparkSession, "language_id")
    known = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if exclude_held_out:
        known = known.filter(~held_out(F.col(id_col)))
    # The sample is chosen on ids and labels alone.
    rows = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().toLocalIterator()}
    if not counts:
        return None
    mixed = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 1.5 * per_language / c + 20.0 / c))])
    # The share bounds what reaches the ranking, to about 1.5 times the sample.
    place = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
    sample = scratch.write(rows.withColumn("at", mixed).filter(F.col("at") < share[F.col("label")]).withColumn("nth", place).filter(F.col("nth") <= per_language), "sample")
    texts = only_ids(docs.select(id_col, text_col, label_col), sample.select("doc_id").distinct(), id_col)
    data = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).alias("label"))
    thin = data.filter(F.col("label").isNotNull()).mapInArrow(_window_picker(windows), "doc_id long, label string, pieces binary, epochs binary")
    got = sorted((r["label"], r["doc_id"], bytes(r["pieces"]), bytes(r["epochs"])) for r in thin.toLocalIterator())
    labels = sorted(counts)
    if not got:
        return None
    grid = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, WINDOW)
    epoch = np.frombuffer(b"".join(r[3] for r in got), np.uint8)
    y = np.repeat([labels.index(r[0]) for r in got], [len(r[3]) for r in got])
    return ByteConvNet.fresh(labels).train(grid, y, epoch=epoch)


def _window_picker(windows: int):
    """Each document's windows for all epochs, one after another, and their epochs."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                grid, _, size = windows_of([(text or "").encode()])
                n = len(grid) if size[0] else 0
                rng = np.random.Generator(np.random.PCG64(abs(int(doc_id))))
                drawn = [rng.permutation(n)[:windows] for _ in range(EPOCHS)]
                epochs = np.repeat(np.arange(EPOCHS), min(windows, n)).astype(np.uint8)
                rows.append((doc_id, label, grid[np.concatenate(drawn)].tobytes(), epochs.tobytes()))
            columns = zip(("doc_id", "label", "pieces", "epochs"), zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))
            yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})

    return pick


def _predictor(model: ByteConvNet | None, *more: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            names, scores = [UND] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t and has_letter(t)]
            if some and model is not None:
                p = model.predict([texts[i].encode() for i in some])
                for i, row in zip(some, p):
                    best = int(row.argmax())
                    names[i], scores[i] = model.labels[best], min(float(row[best]), 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *more)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *more, "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, model: ByteConvNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")


def keep_known_language(docs: DataFrame, *, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows whose language is recognised; und and unsure texts go, each row by
    its own text."""
    scratch = Scratch(docs.sparkSession, "keep_language")
    model = train_language_model(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("text_key"))
    found = table.mapInArrow(_predictor(model, "text_key"), "doc_id long, text_key long, lang_pred string, score double")
    gone = scratch.write(found.filter((F.col("lang_pred") == UND) | (F.col("score") < least)).select("doc_id", "text_key").distinct(), "rejected")
    return without_rows(docs, gone, id_col, text_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs, train_language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
