"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words are cut into overlapping windows (half of each is in the next).
Every word enters as two learned vectors: a word input, the embedding of a word that
``LEAST`` texts of the sample hold (others have the zero vector), and a character
input, the largest responses of filters that slide over the embedded bytes of the word
between its edges. A gated recurrent unit reads the
window in each direction, attention weighs the words, and a logistic unit scores
the window. The text's score is its worst window's. Everything is trained here in
numpy by back-propagation, from the score down to the embeddings.

Training uses a bounded sample: at most ``per_class`` toxic and twice as many clean
rows, those with the smallest hash of their id, and of each at most ``windows``
windows, spread evenly by a hash over the whole text (a toxic text of which some are
left out weighs less, by the share that is in). One half of each class gives the
first entry of the word embeddings their start, the log odds of the label; the other
half trains the network, on the worst window of a toxic text and the worst ones and
some others of a clean text. The worst are chosen by the start values first, and by
the network itself in later rounds.

Defined results: a null, empty or blank text has one window without words, and so
the score of nothing. Labels that are null are not learned. Without labelled rows of
both classes there is nothing to learn: a warning is given and every score is the
smoothed share of the label (0.5 without any labelled row). Rows that repeat are
scored each; repeated labels of an id count by the larger; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, chunks, held_out, only_ids

TIMES, STRIDE = 32, 16
HIDDEN, ATTEND = 8, 8
PER_CLASS, WINDOWS = 1500, 512
#: Texts that must hold a word that has an embedding, and its size; size of the byte
#: embeddings, width and number of the filters over them.
LEAST, WORD_SIZE = 3, 8
BYTE_SIZE, WIDTH, FILTERS = 6, 3, 12
FEATURES = WORD_SIZE + FILTERS
#: Rounds of training and epochs of each.
ROUNDS, EPOCHS = 3, 2
#: Steps of a round at least, for small samples.
STEPS = 100
BATCH, RATE = 128, 5e-3
#: Share of the words whose word input is left out in training, and of those whose
#: character input is, so that both learn.
DROP, DROP_CHARS = 0.05, 0.7
#: Decay of the parameters but the word embeddings, as a share of the rate.
DECAY = 0.02
#: The word embeddings' rate, as a share of the others'.
WORD_RATE = 0.2
#: Bytes of words and their inputs that a worker remembers.
CACHE_BYTES = 100_000_000
THRESHOLD = 0.3
#: Beyond the edges of a word.
EDGE = 256


def plain(word: str) -> str:
    """The word as the vocabulary has it: case and marks at the ends don't count."""
    return (word.strip(".,;:!?\"'()[]*#$%&") or word).lower()


def byte_grid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """WIDTH neighbouring bytes a row, for all places of all words with an edge on
    each side; and the first row of each word."""
    raws = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(r) for r in raws], np.int64)
    flat = np.full(int(sizes.sum()) + 2 * len(raws), EDGE, np.int16)
    # Words are not empty, so each has as many places as bytes.
    begin = np.cumsum(sizes + 2) - sizes - 1
    inside = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    flat[inside] = np.frombuffer(b"".join(raws), np.uint8)
    return np.stack([flat[inside - 1], flat[inside], flat[inside + 1]], axis=1), np.cumsum(sizes) - sizes


def windows_of(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, its first word's place among
    all words, and its number of words. The windows overlap by half."""
    n = np.array(counts)
    per = np.maximum(1, -(-(n - TIMES) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(n)), per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(n) - n, per) + within * STRIDE
    return owner, first, np.clip(n[owner] - within * STRIDE, 0, TIMES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class BiGru:
    """Word and byte embeddings, two gated recurrent units, attention over their
    states, a logistic unit."""

    NAMES = ("ew", "eb", "cf", "cb", "wf", "uf", "bf", "wb", "ub", "bb", "wa", "va", "wo", "bo")

    def __init__(self, n_words: int = 0, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        # Row 0 is that of all words without an embedding, and stays zero.
        self.ew = rng.normal(0, 0.05, (n_words + 1, WORD_SIZE)).astype(np.float32)
        self.ew[0] = 0
        self.eb = rng.normal(0, 0.5, (EDGE + 1, BYTE_SIZE)).astype(np.float32)
        self.cf, self.cb = draw(WIDTH * BYTE_SIZE, FILTERS), np.zeros(FILTERS, np.float32)
        for d in "fb":
            setattr(self, f"w{d}", draw(FEATURES, 3 * HIDDEN))
            setattr(self, f"u{d}", draw(HIDDEN, 3 * HIDDEN))
            setattr(self, f"b{d}", np.zeros(3 * HIDDEN, np.float32))
        self.wa, self.va = draw(2 * HIDDEN, ATTEND), draw(ATTEND)
        self.wo, self.bo = draw(2 * HIDDEN), np.zeros(1, np.float32)

    def inputs(self, row: np.ndarray, grid: np.ndarray, begin: np.ndarray, keep: np.ndarray | None = None, cache: dict | None = None) -> np.ndarray:
        """The input of each word: its word vector and its character vector."""
        own = self.ew[row]
        if keep is not None:
            own = own * keep[:, :1]
        around = self.eb[grid].reshape(len(grid), -1)
        response = around @ self.cf
        most = np.maximum.reduceat(response, begin, axis=0) if len(begin) else np.zeros((0, FILTERS), np.float32)
        chars = np.maximum(most + self.cb, 0)
        if keep is not None:
            chars = chars * keep[:, 1:]
        if cache is not None:
            cache |= {"around": around, "response": response, "most": most, "chars": chars}
        return np.concatenate([own, chars], axis=1)

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        """Inputs times the weights of both directions, side by side."""
        return np.concatenate([rows @ self.wf + self.bf, rows @ self.wb + self.bb], axis=1)

    def _read(self, xs: list[np.ndarray], there: np.ndarray, d: str, keep: list | None) -> list[np.ndarray]:
        """States of one direction; xs: the inputs times the weights, by time."""
        u, n = getattr(self, f"u{d}"), len(there)
        h, out = np.zeros((n, HIDDEN), np.float32), []
        for t in range(TIMES) if d == "f" else range(TIMES - 1, -1, -1):
            x, hu = xs[t], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = h + (1 - z) * (c - h) * there[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, hu, z, r, c))
            h = new
            out.append(h)
        return out if d == "f" else out[::-1]

    def _forward(self, table: np.ndarray, index: np.ndarray, there: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logits of windows; table: weighted() of the words, index: their rows."""
        states, inputs = [], table[index.T.ravel()].reshape(TIMES, len(there), -1)
        for k, d in enumerate("fb"):
            keep = [] if cache is not None else None
            part = inputs[:, :, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            states.append(np.stack(self._read(list(part), there, d, keep), axis=1))
            if cache is not None:
                cache[d] = keep
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ self.wa)
        e = np.where(there > 0, a @ self.va, -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True)) * (there > 0)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        context = np.einsum("nt,ntd->nd", w, h)
        if cache is not None:
            cache |= {"h": h, "a": a, "w": w, "context": context}
        return context @ self.wo + self.bo[0]

    def score(self, table: np.ndarray, index: np.ndarray, there: np.ndarray) -> np.ndarray:
        return _sigmoid(self._forward(table, index, there))

    def _gradients(self, words: "Words", index: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: np.ndarray | None = None) -> list[np.ndarray]:
        """Gradients by NAMES; that of ew is for the rows words.row names."""
        cache: dict = {}
        rows = self.inputs(words.row, words.grid, words.begin, keep, cache)
        table = self.weighted(rows)
        d_logit = ((_sigmoid(self._forward(table, index, there, cache)) - y) * weight / len(y)).astype(np.float32)
        h, a, w, context = (cache[k] for k in ("h", "a", "w", "context"))
        g = {"wo": context.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_context = d_logit[:, None] * self.wo
        dh = w[:, :, None] * d_context[:, None]
        dw = np.einsum("nd,ntd->nt", d_context, h)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * self.va * (1 - a * a)
        g["wa"] = np.einsum("ntd,nta->da", h, da)
        dh += da @ self.wa.T
        d_rows = np.zeros_like(rows)
        for k, d in enumerate("fb"):
            u = getattr(self, f"u{d}")
            du, dx_all = np.zeros_like(u), np.zeros((TIMES, len(y), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(y), HIDDEN), np.float32)
            for t, before, hu, z, r, c in reversed(cache[d]):
                whole = carry + dh[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                now, skip = whole * there[:, t : t + 1], whole * (1 - there[:, t : t + 1])
                dc = now * (1 - z) * (1 - c * c)
                dz = now * (before - c) * z * (1 - z)
                dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
                dx_all[t] = np.concatenate([dz, dr, dc], axis=1)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                carry = skip + now * z + dhu @ u.T
                du += before.T @ dhu
            # Sums over the places of each word, then back through the weights.
            by_word = np.stack([np.bincount(index.T.ravel(), column, minlength=len(rows)) for column in dx_all.reshape(-1, 3 * HIDDEN).T], axis=1).astype(np.float32)
            g |= {f"u{d}": du, f"w{d}": rows.T @ by_word, f"b{d}": by_word.sum(axis=0)}
            d_rows += by_word @ getattr(self, f"w{d}").T
        moves = words.row > 0 if keep is None else keep[:, 0] * (words.row > 0)
        g["ew"] = d_rows[:, :WORD_SIZE] * moves[:, None]
        d_chars = d_rows[:, WORD_SIZE:] * (cache["chars"] > 0)  # none where they were left out
        g["cb"] = d_chars.sum(axis=0)
        # The largest response's place takes the gradient; of equal ones, all do in part.
        owner = np.repeat(np.arange(len(words.begin)), np.diff(np.append(words.begin, len(words.grid))))
        top = cache["response"] == cache["most"][owner]
        ties = np.maximum(np.add.reduceat(top, words.begin, axis=0), 1) if len(words.begin) else top
        d_response = np.where(top, (d_chars / ties)[owner], 0).astype(np.float32)
        g["cf"] = cache["around"].T @ d_response
        d_around = (d_response @ self.cf.T).reshape(-1, BYTE_SIZE)
        g["eb"] = np.stack([np.bincount(words.grid.ravel(), column, minlength=EDGE + 1) for column in d_around.T], axis=1).astype(np.float32)
        return [g[k] for k in self.NAMES]

    def train(self, words: "Words", index: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 9) -> "BiGru":
        """Adam; of the word embeddings, the rows that a batch holds move."""
        rng = np.random.Generator(np.random.PCG64(seed))
        own = [getattr(self, k) for k in self.NAMES]
        first, second, step = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), batch):
                some = order[begin : begin + batch]
                step += 1
                used, place = np.unique(index[some], return_inverse=True)
                part = words.part(used)
                keep = (rng.random((len(used), 2)) >= (DROP, DROP_CHARS)).astype(np.float32)
                grads = self._gradients(part, place.reshape(index[some].shape), there[some], y[some], weight[some], keep)
                rows, at = np.unique(part.row, return_inverse=True)
                total = np.zeros((len(rows), WORD_SIZE), np.float32)
                np.add.at(total, at, grads[0])
                up, down = 1 - 0.9**step, 1 - 0.999**step
                for p, g, m, v in zip(own[1:], grads[1:], first[1:], second[1:]):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * ((m / up) / (np.sqrt(v / down) + 1e-8) + DECAY * p)
                first[0][rows] += 0.1 * (total - first[0][rows])
                second[0][rows] += 0.001 * (total * total - second[0][rows])
                own[0][rows] -= WORD_RATE * rate * (first[0][rows] / up) / (np.sqrt(second[0][rows] / down) + 1e-8)
        return self


class Words:
    """Distinct words as the network takes them."""

    def __init__(self, row: np.ndarray, grid: np.ndarray, begin: np.ndarray):
        self.row, self.grid, self.begin = row, grid, begin

    @staticmethod
    def of(words: list[str], vocabulary: dict[str, int]) -> "Words":
        return Words(np.array([vocabulary.get(plain(w), 0) for w in words], np.int64), *byte_grid(words))

    def weighted(self, net: BiGru) -> np.ndarray:
        """The network's weighted() of all words, made in parts of bounded size."""
        parts = [np.zeros((0, 6 * HIDDEN), np.float32)]
        for begin in range(0, len(self.row), 8192):
            some = self.part(np.arange(begin, min(begin + 8192, len(self.row))))
            parts.append(net.weighted(net.inputs(some.row, some.grid, some.begin)))
        return np.concatenate(parts)

    def part(self, rows: np.ndarray) -> "Words":
        ends = np.append(self.begin, len(self.grid))
        sizes = ends[rows + 1] - ends[rows]
        begin = np.cumsum(sizes) - sizes
        take = np.repeat(ends[rows] - begin, sizes) + np.arange(int(sizes.sum()))
        return Words(self.row[rows], self.grid[take], begin)


class ToxicityModel:
    """A trained network, and what a worker remembers of the words it has met."""

    def __init__(self, net: BiGru, vocabulary: dict[str, int]):
        self.net, self.vocabulary = net, vocabulary
        self._reset()

    def __getstate__(self):
        return {"net": self.net, "vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.__init__(**state)

    def _reset(self):
        self.index: dict[str, int] = {}
        self.held = 0
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        """Rows of self.table for all words in order."""
        missing = {w for words in texts for w in words if w not in self.index}
        # Twice the row, since the table doubles.
        cost = sum(len(w) for w in missing) * 4 + len(missing) * (150 + 2 * self.table.itemsize * 6 * HIDDEN)
        if self.held and self.held + cost > CACHE_BYTES:
            self._reset()
            return self.rows(texts)
        self.held += cost
        new = sorted(missing)
        at = len(self.index)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(new)] = Words.of(new, self.vocabulary).weighted(self.net)
        self.index.update(zip(new, range(at, at + len(new))))
        find = self.index.__getitem__
        return np.fromiter((i for words in texts for i in map(find, words)), np.int64)

    def window_scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The score of every window, and the text it belongs to."""
        flat = self.rows(texts)
        owner, first, size = windows_of([len(w) for w in texts])
        parts = [np.zeros(0, np.float32)]
        for begin in range(0, len(owner), 4096):
            part = slice(begin, begin + 4096)
            parts.append(self.net.score(self.table, *_grid(flat, first[part], size[part])))
        return np.concatenate(parts), owner

    def scores(self, texts: list[str]) -> np.ndarray:
        """The worst window's score of each text."""
        found, owner = self.window_scores([t.split() for t in texts])
        out = np.zeros(len(texts))
        np.maximum.at(out, owner, found)
        return out


class Constant:
    """What is known without labels of both classes: the label's share."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.share)


def _grid(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(TIMES)
    there = (at[None] < size[:, None]).astype(np.float32)
    place = np.minimum(first[:, None] + at[None], max(len(flat) - 1, 0))
    return (flat[place] if len(flat) else np.zeros(place.shape, np.int64)), there


def log_odds(texts: list[np.ndarray], y: np.ndarray, rows: int) -> np.ndarray:
    """Shrunken log odds of the label for each row of the word embedding, by the number
    of texts that hold its word; texts: each one's distinct rows. Row 0 has 0."""
    counts = np.zeros((2, rows))
    for held, label in zip(texts, y):
        counts[int(label), held] += 1
    n = np.array([max((y == 0).sum(), 1), max((y == 1).sum(), 1)])
    every = counts.sum(axis=0)
    rate = (counts + (every + 1) / n.sum()) / (n[:, None] + 2)
    odds = np.log((rate[1] + 1 / n.sum()) / (rate[0] + 1 / n.sum()))
    out = np.where(every > 0, np.clip(odds, -4, 4) * (1 - np.exp(-every / 4)), 0).astype(np.float32)
    out[0] = 0
    return out


def fit(texts: Iterable[list[list[str]]], y: np.ndarray, share: np.ndarray | None = None) -> ToxicityModel:
    """Train on texts and 0/1 labels, in their order. A text is a list of pieces, each
    a list of words; share: how much of each text is there."""
    share = np.ones(len(y)) if share is None else share
    # Words are numbered while the texts are read, so that each is held once.
    number: dict[str, int] = {}
    coded = [[np.fromiter((number.setdefault(w, len(number)) for w in p), np.int32, len(p)) for p in t] for t in texts]
    known = list(number) or ["-"]
    shown = [plain(w) for w in known]
    same = {w: i for i, w in enumerate(sorted(set(shown)))}
    of = np.array([same[w] for w in shown])
    held = [np.unique(of[np.concatenate(t)]) if t else np.zeros(0, np.int64) for t in coded]
    frequent = np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=len(same)) >= LEAST
    row = np.where(frequent, np.cumsum(frequent), 0)
    vocabulary = {w: int(row[i]) for w, i in same.items() if frequent[i]}
    # Every second text of each class gives the start values, if there are two.
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    start = nth % 2 == 1
    rest = ~start
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        start = rest = np.ones(len(y), bool)
    net = BiGru(len(vocabulary))
    net.ew[:, 0] = log_odds([row[held[k]] for k in np.flatnonzero(start)], y[start], len(vocabulary) + 1)
    odds = net.ew[:, 0].copy()
    pieces = [(i, p) for i, k in enumerate(np.flatnonzero(rest)) for p in coded[k]]
    y, share = y[rest], share[rest]
    words = Words.of(known, vocabulary)
    flat = np.concatenate([np.zeros(0, np.int32), *(p for _, p in pieces)])
    owner, first, size = windows_of([len(p) for _, p in pieces])
    owner = np.array([k for k, _ in pieces])[owner]
    del coded, held, pieces, number
    index, there = _grid(flat, first, size)
    value = odds[words.row]
    worst = (np.maximum(value[index], 0) * there).max(axis=1)
    clean = np.zeros(0, np.int64)
    for again in range(ROUNDS):
        if again:
            table = words.weighted(net)
            worst = np.concatenate([net.score(table, index[b : b + 1024], there[b : b + 1024]) for b in range(0, len(index), 1024)])
        order = np.lexsort((-worst, owner))
        nth = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        # Of a toxic text its worst window is learned as toxic; of a clean text the
        # two worst and every tenth other one as clean.
        use = np.where(y[owner[order]] == 1, nth == 0, (nth < 2) | (nth % 10 == 5))
        # Clean windows that were picked before stay.
        clean = np.union1d(clean, order[use & (y[owner[order]] == 0)])
        pick = np.concatenate([order[use & (y[owner[order]] == 1)], clean])
        target = y[owner[pick]].astype(np.float32)
        weight = np.where(target == 1, share[owner[pick]], 1)
        net.train(words, index[pick], there[pick], target, weight.astype(np.float32), epochs=max(EPOCHS, -(-STEPS * BATCH // len(pick))), rate=RATE / (1 + again), seed=9 + again)
    return ToxicityModel(net, vocabulary)


def _window_texts(windows: int):
    """Texts as lists of words joined by one space: the whole text, or some windows of
    a text that has more than that many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            pieces, shares = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").split()
                _, first, size = windows_of([len(words)])
                if len(first) <= windows:
                    pieces.append([" ".join(words)])
                    shares.append(1.0)
                    continue
                some = np.random.Generator(np.random.PCG64(abs(doc_id))).permutation(len(first))[:windows]
                pieces.append([" ".join(words[first[i] : first[i] + size[i]]) for i in np.sort(some)])
                shares.append(windows / len(first))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("at", "doc_id", "label")), pa.array(shares, pa.float64()), pa.array(pieces, pa.list_(pa.string()))], ["at", "doc_id", "label", "share", "pieces"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | Constant:
    """Learn from labelled rows that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = scratch.write(known.withColumn("at", F.xxhash64(F.lit("sample"), F.col("doc_id"))), "known")
    parts = [known.filter(F.col("label") == k).orderBy("at", "doc_id").limit(per_class * (1 if k else 2)) for k in (0, 1)]
    sample = scratch.write(parts[0].unionByName(parts[1]), "sample")
    some = only_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), sample.select("doc_id"))
    rows = some.join(F.broadcast(sample), "doc_id").select("at", F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    rows = rows.mapInArrow(_window_texts(windows), "at long, doc_id long, label int, share double, pieces array<string>")
    got = sorted((r["at"], r["doc_id"], r["label"], r["share"], r["pieces"]) for r in rows.toLocalIterator())
    labelled = np.array([r[2] for r in got], int)
    if len(set(labelled.tolist())) < 2:
        warnings.warn("toxicity: no labelled rows of both classes; all scores are the label's share", stacklevel=2)
        return Constant((float(labelled.sum()) + 0.5) / (len(labelled) + 1))
    return fit(([p.split() for p in r[4]] for r in got), labelled, np.array([r[3] for r in got]))


def _scorer(model: ToxicityModel | Constant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(texts), pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel | Constant, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = table.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, train_toxicity(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
