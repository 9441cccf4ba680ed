"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is cut at two unit ends (line ends) into prefix, middle and suffix, which are
written anew with sentinels. Unit ends, and sentinels that stand in the text already, are
found by one deterministic automaton over bytes. It is never run from the left: a stretch
of text becomes the function that leads each state to the state after it, with the number
of units that begin in it for each state. Functions of neighbouring stretches are
composed pairwise, level by level (``Tree``); the tree that composes a text is also the
one that finds its n-th unit, by descending from the root to a byte.

Texts longer than ``CHUNK_BYTES`` are exploded into chunks of that size, which tasks scan
independently. The chunks' functions are small; each text's are composed in one place,
the two chunks that hold its cuts are chosen there, and only these two are scanned again
with their entry states.

Bytes of no interest do not count: a run of bytes whose function, applied twice, is the
same function without a further unit, is one symbol. Ordinary prose is a symbol a line.

Defined results: a null text is an empty one, which stays plain with no units; a null id
counts as an empty one in the hash. Rows that repeat are transformed each; texts that hold
a sentinel stay as they are; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, chunks, release, small_batches

SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of more bytes are scanned by several tasks. A row holds 2 GB at most, so at most
#: 32,768 chunks' functions meet in one place.
CHUNK_BYTES = 1 << 16
#: Bytes scanned at once.
BATCH_BYTES = 1 << 19


class Automaton:
    """Units that end with a byte, and whether a word of some has been met.

    A state is twice the longest end of what was read that begins a word, plus one inside
    a unit; the last word state is for a whole word and is never left."""

    def __init__(self, words: Sequence[bytes] = tuple(s.encode() for s in SENTINELS), end: bytes = b"\n"):
        begun = sorted({w[:k] for w in words for k in range(len(w))} | {b""}, key=lambda p: (len(p), p))
        found = len(begun)
        self.states = 2 * (found + 1)
        table = np.zeros((self.states, 256), np.uint8)
        begins = np.zeros((self.states, 256), bool)
        for k in range(found + 1):
            for byte in range(256):
                to = found
                if k < found:
                    read = begun[k] + bytes([byte])
                    if not any(read.endswith(w) for w in words):
                        to = max((begun.index(read[i:]) for i in range(len(read) + 1) if read[i:] in begun), key=lambda j: len(begun[j]))
                table[2 * k : 2 * k + 2, byte] = 2 * to + (bytes([byte]) != end)
                begins[2 * k, byte] = True
        # Bytes that act alike are one class.
        both, self.class_of = np.unique(np.concatenate([table, begins]), axis=1, return_inverse=True)
        self.class_of = self.class_of.reshape(-1).astype(np.uint8)
        self.steps, self.begins = both[: self.states].T.copy(), both[self.states :].T.astype(np.int32)
        self.once = np.array([(f[f] == f).all() and not b[f].any() for f, b in zip(self.steps, self.begins)])

    def met(self, state: np.ndarray) -> np.ndarray:
        """Whether a whole word had been read in these states."""
        return state >= self.states - 2

    def scan(self, data: np.ndarray, starts: np.ndarray) -> tuple["Tree", np.ndarray]:
        """The tree of each stretch of data (bytes from one start to the next), and each
        symbol's first byte."""
        classes = self.class_of[data]
        new = ~self.once[classes]
        new[1:] |= classes[1:] != classes[:-1]
        new[starts[starts < len(data)]] = True
        at = np.flatnonzero(new)
        symbols = classes[at]
        return Tree(self.steps[symbols], self.begins[symbols], np.append(np.searchsorted(at, starts), len(at))), at


class Tree:
    """The pairwise composition of runs of functions: levels of (steps, counts, offsets),
    from the symbols to one node a run. Node i of a level joins 2i and 2i+1 below."""

    def __init__(self, steps: np.ndarray, counts: np.ndarray, offsets: np.ndarray):
        self.levels = [(steps, counts, offsets)]
        while (lengths := np.diff(offsets)).max(initial=0) > 1:
            above = np.append(0, np.cumsum((lengths + 1) // 2))
            run = np.repeat(np.arange(len(lengths)), np.diff(above))
            left = offsets[run] + 2 * (np.arange(above[-1]) - above[run])
            pair = np.flatnonzero(left + 1 < offsets[run + 1])
            right = left[pair] + 1
            joined, sums = steps[left], counts[left]
            via = joined[pair].astype(np.intp)
            joined[pair] = np.take_along_axis(steps[right], via, 1)
            sums[pair] += np.take_along_axis(counts[right], via, 1)
            steps, counts, offsets = joined, sums, above
            self.levels.append((steps, counts, offsets))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Each run's function and counts; those of an empty run change nothing."""
        steps, counts, offsets = self.levels[-1]
        full = np.flatnonzero(np.diff(offsets))
        f = np.tile(np.arange(steps.shape[1], dtype=steps.dtype), (len(offsets) - 1, 1))
        n = np.zeros(f.shape, counts.dtype)
        f[full], n[full] = steps[offsets[full]], counts[offsets[full]]
        return f, n

    def find(self, run: np.ndarray, state: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol in which the nth unit (from 0) of a run entered in a state begins:
        its place in the run, the state before it and the units begun before it there."""
        node, state, nth = np.zeros(len(run), np.int64), state.astype(np.intp), nth.copy()
        for steps, counts, offsets in self.levels[-2::-1]:
            node *= 2
            left = offsets[run] + node
            before = counts[left, state]
            go = nth >= before
            nth[go] -= before[go]
            state[go] = steps[left[go], state[go]]
            node += go
        return node, state, nth


def _automaton(words: Sequence[str], end: str) -> Automaton:
    return Automaton([w.encode() for w in words], end.encode())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each value begins (and the end)."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def _cuts(words: Sequence[str], end: str):
    """n, met, low and high (bytes before the cuts) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(words, end)
        for batch in chunks(batches, "text", BATCH_BYTES, 1 << 16):
            data, at = _bytes_of(batch.column("text"))
            tree, places = own.scan(data, at[:-1])
            steps, counts = tree.whole()
            n = counts[:, 0].astype(np.int64)
            draws = np.array([batch.column("h1").to_numpy() % (n + 1), batch.column("h2").to_numpy() % (n + 1)])
            ends = [_ends(tree, places, at, draw, n) for draw in (draws.min(0), draws.max(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(own.met(steps[:, 0])), *map(pa.array, ends)], [*batch.schema.names, "n", "met", "low", "high"])

    return run


def _ends(tree: Tree, places: np.ndarray, at: np.ndarray, units: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes in a text's first so many units."""
    out = np.diff(at)
    some = np.flatnonzero(units < n)
    node, _, _ = tree.find(some, np.zeros(len(some)), units[some])
    out[some] = places[tree.levels[0][2][some] + node] - at[some]
    return out


def _summaries(words: Sequence[str], end: str):
    """Each chunk's function and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(words, end)
        for batch in chunks(batches, "part", BATCH_BYTES, 1 << 16):
            data, at = _bytes_of(batch.column("part"))
            steps, counts = own.scan(data, at[:-1])[0].whole()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([s.tobytes() for s in steps]), pa.array([c.astype("<i8").tobytes() for c in counts])], ["row", "k", "steps", "counts"])

    return run


def _choose(words: Sequence[str], end: str):
    """One text's functions composed: n, met, and for each cut the chunk that holds it,
    the state that enters the chunk and the unit there; chunk -1 is the text's end."""
    states = _automaton(words, end).states

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        steps = np.frombuffer(b"".join(table.column("steps").to_pylist()), np.uint8).reshape(-1, states)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8").reshape(-1, states)
        tree = Tree(steps, counts, np.array([0, len(steps)]))
        whole, total = tree.whole()
        n, met = int(total[0, 0]), bool(whole[0, 0] >= states - 2)
        draws = sorted(table.column(h)[0].as_py() % (n + 1) for h in ("h1", "h2"))
        rows = []
        for cut, units in zip(("low", "high"), draws):
            k, state, nth = -1, 0, 0
            if units < n:
                k, state, nth = (int(x[0]) for x in tree.find(np.zeros(1, np.int64), np.zeros(1), np.array([units])))
            rows.append({"row": table.column("row")[0].as_py(), "n": n, "met": met, "cut": cut, "k": k, "state": state, "nth": nth})
        return pa.Table.from_pylist(rows, pa.schema([("row", pa.int64()), ("n", pa.int64()), ("met", pa.bool_()), ("cut", pa.string()), ("k", pa.int64()), ("state", pa.int64()), ("nth", pa.int64())]))

    return choose


def _places(words: Sequence[str], end: str):
    """The byte of a chosen chunk at which the unit begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(words, end)
        for batch in chunks(batches, "part", BATCH_BYTES, 1 << 16):
            data, at = _bytes_of(batch.column("part"))
            tree, places = own.scan(data, at[:-1])
            full = np.flatnonzero(np.diff(at))
            node, _, _ = tree.find(full, batch.column("state").to_numpy()[full], batch.column("nth").to_numpy()[full])
            place = np.zeros(batch.num_rows, np.int64)
            place[full] = places[tree.levels[0][2][full] + node] - at[full]
            keep = [c for c in batch.schema.names if c != "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(place)], [*keep, "place"])

    return run


def _giant_cuts(giants: DataFrame, words: Sequence[str], end: str, size: int) -> DataFrame:
    """row, n, met, low and high of texts that several tasks scan."""
    raw = F.col("text").cast("binary")
    last = F.ceil(F.octet_length("text") / size).cast("long") - 1
    parts = giants.select("row", F.col("text"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    parts = parts.select("row", "k", F.substring(raw, (F.col("k") * size + 1).cast("int"), F.lit(size)).alias("part")).repartition("row", "k")
    functions = parts.mapInArrow(_summaries(words, end), "row long, k long, steps binary, counts binary")
    drawn = functions.join(giants.select("row", "h1", "h2"), "row")
    chosen = drawn.groupBy("row").applyInArrow(_choose(words, end), "row long, n long, met boolean, cut string, k long, state long, nth long")
    held = chosen.join(giants.select("row", "text"), "row").withColumn("part", F.when(F.col("k") < 0, F.lit(b"")).otherwise(F.substring(raw, (F.col("k") * size + 1).cast("int"), F.lit(size))))
    held = held.withColumn("bytes", F.octet_length("text").cast("long")).select("row", "n", "met", "cut", "k", "state", "nth", "bytes", "part")
    found = held.mapInArrow(_places(words, end), "row long, n long, met boolean, cut string, k long, state long, nth long, bytes long, place long")
    at = F.when(F.col("k") < 0, F.col("bytes")).otherwise(F.col("k") * size + F.col("place"))
    cut = lambda name: F.max(F.when(F.col("cut") == name, at)).alias(name)
    return found.groupBy("row").agg(F.max("n").alias("n"), F.bool_or("met").alias("met"), cut("low"), cut("high"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sequence[str] = SENTINELS, unit_end: str = "\n", chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output.

    sentinels: those before prefix, suffix and middle; unit_end: one ASCII character.
    rate: how many of a hundred texts are transformed; spm_rate: how many of these have
    the suffix first."""
    scratch = Scratch(docs.sparkSession, "fill_middle")
    small_batches(docs.sparkSession)
    h = draws(F.col(id_col), seed)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[c.alias(f"h{i + 1}") for i, c in enumerate(h)])
    size = F.octet_length("text")
    shape = "doc_id long, text string, h1 long, h2 long, h3 long, h4 long, n long, met boolean, low long, high long"
    short = table.filter(size <= chunk_bytes).mapInArrow(_cuts(sentinels, unit_end), shape)
    giants = scratch.write(table.filter(size > chunk_bytes).withColumn("row", F.monotonically_increasing_id()), "giants")
    long = giants.join(_giant_cuts(giants, sentinels, unit_end, chunk_bytes), "row").select(*short.columns)
    return _rendered(short.unionByName(long), sentinels, rate, spm_rate)


def _rendered(cut: DataFrame, sentinels: Sequence[str], rate: int, spm_rate: int) -> DataFrame:
    raw = F.col("text").cast("binary")
    part = lambda begin, n: F.substring(raw, (begin + 1).cast("int"), n.cast("int")).cast("string")
    low, high, size = F.col("low"), F.col("high"), F.octet_length("text").cast("long")
    plain = (F.col("text") == "") | F.col("met") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = cut.select("doc_id", "n", form.alias("form"), "text", part(F.lit(0), low).alias("p"), part(low, high - low).alias("m"), part(high, size - high).alias("s"))
    before = [F.lit(s) for s in sentinels]
    psm = F.concat(before[0], "p", before[1], "s", before[2], "m")
    spm = F.concat(before[1], "s", before[0], "p", before[2], "m")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return rows.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from which an output was made."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(('0x' || d[1:8]) AS BIGINT) AS h1, CAST(('0x' || d[9:16]) AS BIGINT) AS h2,
             CAST(('0x' || d[17:24]) AS BIGINT) AS h3, CAST(('0x' || d[25:32]) AS BIGINT) AS h4,
             regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM t),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM h),
f AS (SELECT doc_id, n, text,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[:lo], '') AS p, array_to_string(u[lo + 1 : hi], '') AS m, array_to_string(u[hi + 1 :], '') AS s FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
