"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct shingles of five lower-cased words. One hash
of each shingle fills one of 256 bins; the smallest value in each bin is the
sketch, and empty bins borrow from bins chosen by a hash of (bin, attempt) until a
full one is met (optimal densification). Bands of bins are the buckets: two sets of
similarity 0.8 miss all 51 bands of five bins, and two of 0.85 all 42 bands of six,
with a probability of about 1e-9.

Pairs are bounded in this way:

* equal sets are one class; only classes meet in buckets;
* a bucket links each member to its hub alone, the member with the most bucket
  mates (a star: n - 1 pairs for n members);
* links are confirmed on the full sets, and components are built of them;
* only buckets that still hold more than one component go on, and these are worked
  off exactly, whatever their size: in small ones the pairs across components are
  listed; the members of all others are dealt anew by a prefix filter on their full
  sets. Linked sets share an element among the rarest (1 - similarity) of either, so
  only members that share such an element are compared, and what many documents have
  in common brings none of them together;
* many members that share such an element are compared by a product of incidence
  matrices of two blocks of them, over short codes of their elements. Its counts are
  upper bounds of the intersections, so it leaves few pairs, and no link out; these
  are confirmed on the full sets. Members of one component have blocks of their own,
  which are not compared with one another.

So no link is lost to the stars, and the only pairs left out are those that share no
bucket. What remains quadratic are sets of many components that all share rare
elements and yet are too different: any exact search has to compare them.

Buckets, links and components are tables; nothing of them reaches the driver but
counts, and a table of ``SLOTS`` sums that ranks elements by frequency. Joins on hot
keys are made between stored tables, which lets Spark split their partitions. A
shingle is told by a hash of 64 bits, a set by a name of 128 bits: sets of equal names
are taken as equal without a look (for 10^10 sets, wrong with a probability of 1e-19).

Defined results: a null, empty or blank text has no shingles and is linked with
nothing; fewer than five words are one shingle. Rows that repeat an id are judged
together (the smallest id of a component stays, with all rows of that id). A null
id is never the smallest; a component of null ids only has a null id and is kept.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, chunks, only_ids, release, text_key, without_rows

WORDS = 5
BINS = 256
#: Links have 100 * intersection >= PERCENT * union; bins of a band.
PERCENT, BAND_ROWS = 80, 5
#: Members of a bucket whose pairs are listed.
SMALL = 8
#: Sets of more elements have codes of four bytes, the others of two.
LONG_SET = 4096
#: Members and bytes of codes in a block; members of a component that has its own blocks.
BLOCK_MEMBERS, BLOCK_BYTES, OWN_BLOCKS = 256, 8 << 20, 64
#: Sums by which elements are ranked; any ranking that all sets share is exact.
SLOTS = 1 << 16
#: Units of work (pairs of blocks) of a task, about.
UNITS = 16

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_BLANK] = 0
_RADIX = int(_rng.integers(1, 2**62)) * 4 + 3
_PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_PROBES = _rng.integers(0, BINS, (4096, BINS))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _RADIX, np.uint64), np.full(size, pow(_RADIX, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after another,
    and n+1 offsets."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=total[1:])
    words = _mix((total[end] - total[begin]) * down[begin])
    # Words of text i: first[i] to first[i + 1].
    first = np.searchsorted(begin, np.append(0, text_end))
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    m = len(words)
    if m >= WORDS:
        mixed = np.zeros(m - WORDS + 1, np.uint64)
        for j in range(WORDS):
            mixed += words[j : m - WORDS + 1 + j] * _PLACE[j]
        whole = owner[: m - WORDS + 1] == owner[WORDS - 1 :]
        hashes, of = _mix(mixed[whole] + _U(WORDS)), owner[: m - WORDS + 1][whole]
    else:
        hashes, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        own = [int(np.sum(words[first[i] : first[i + 1]] * _PLACE[: n_words[i]], dtype=np.uint64)) + int(n_words[i]) for i in short]
        hashes = np.append(hashes, _mix(np.array([x % 2**64 for x in own], np.uint64)))
        of = np.append(of, short)
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        hashes[b:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(texts))))


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set; the sets must not be empty."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bins = (hashes >> _U(56)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    out, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    out[owner[first], bins[first]] = hashes[first]
    full[owner[first], bins[first]] = True
    rows = np.flatnonzero(~full.all(1))
    value, there, empty = out[rows], full[rows], ~full[rows]
    for probe in _PROBES:
        if not len(rows):
            break
        hit = empty & there[:, probe]
        value[hit] = value[:, probe][hit]
        empty &= ~hit
        open_ = empty.any(1)
        if not open_.all():
            out[rows[~open_]] = value[~open_]
            rows, value, there, empty = rows[open_], value[open_], there[open_], empty[open_]
    for r, v, t, e in zip(rows, value, there, empty):  # as good as never
        full_bins = np.flatnonzero(t)
        v[e] = v[full_bins[np.arange(BINS)[e] % len(full_bins)]]
        out[r] = v
    return out


def band_keys(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    count = BINS // rows
    bands = sketch[:, : count * rows].reshape(-1, count, rows)
    return _mix((bands * _PLACE[:rows]).sum(2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * _PLACE[7]).view(np.int64)


def _set_names(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit name for each set."""
    n = len(offsets) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some, 0] = np.add.reduceat(_mix(hashes + _U(1)), offsets[some])
        out[some, 1] = np.add.reduceat(_mix(hashes ^ _PLACE[6]), offsets[some])
    out[:, 1] += np.diff(offsets).astype(np.uint64) * _PLACE[5]
    raw = out.tobytes()
    return [raw[i * 16 : i * 16 + 16] for i in range(n)]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _sketch(rows: int):
    count = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            hashes, offsets = shingle_sets(_bytes(batch.column("text")))
            sizes = np.diff(offsets)
            keys = np.zeros((len(sizes), count), np.int64)
            some = sizes > 0
            if some.any():
                keys[some] = band_keys(sketches(hashes, np.append(0, np.cumsum(sizes[some]))), rows)
            flat = pa.array(keys[some].ravel())
            at = pa.array(np.append(0, np.cumsum(some * count)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(_set_names(hashes, offsets), pa.binary()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "text_key", "n", "cls", "keys"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 1 << 20):
        hashes, offsets = shingle_sets(_bytes(batch.column("text")))
        raw, at = hashes.tobytes(), (offsets * 8).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(_set_names(hashes, offsets), pa.binary()), pa.array([raw[b:e] for b, e in zip(at, at[1:])], pa.binary())], ["cls", "members"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    return confirm


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    every = left + right
    if not left or not right:
        return out
    names, column = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    twice = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[twice] = np.arange(len(twice))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(twice), 4096):
        span = slice(*np.searchsorted(column, [low, low + 4096]))
        there = np.zeros((len(every), min(4096, len(twice) - low)), np.float32)
        there[row[span], column[span] - low] = 1
        out += there[: len(left)] @ there[len(left) :].T
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes + _U(7)) % _U(SLOTS)).astype(np.int64)


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of the task's sets fall into each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for members in batch.column("members"):
            total += np.bincount(_slot(np.frombuffer(members.as_buffer(), np.uint64)), minlength=SLOTS)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "count"])


def prefix(members: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The rarest elements of a set, so many that a linked set shares one of them
    among its own rarest."""
    order = np.lexsort((members, counts[_slot(members)]))
    return members[order[: len(members) + percent * len(members) // -100 + 1]]


def _prefixes(percent: int, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(np.frombuffer(m.as_buffer(), np.uint64), percent, counts).view(np.int64) for m in batch.column("members")]
            at = np.append(0, np.cumsum([len(f) for f in found]))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            sizes = [len(m.as_buffer()) // 8 for m in batch.column("members")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["cls", "n", "elements"])

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's elements cut to four or two bytes, each code once."""
    for batch in batches:
        found = []
        for members in batch.column("members"):
            short = np.frombuffer(members.as_buffer(), np.uint64).astype(np.uint32)
            found.append(np.unique(short if len(short) > LONG_SET else short.astype(np.uint16)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(found, pa.binary())], ["cls", "n", "codes"])


def possible_links(left: list[dict], right: list[dict], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose sets, of n elements and with these codes, may be
    linked. Elements of both sets that share a code are counted once, so the smaller
    number of codes that are missing is added."""
    long = all(r["n"] > LONG_SET for r in (*left, *right))

    def codes(r: dict) -> np.ndarray:
        raw = np.frombuffer(r["codes"], np.uint32 if r["n"] > LONG_SET else np.uint16)
        return raw if long or raw.dtype == np.uint16 else np.unique(raw.astype(np.uint16))

    x, y = [codes(r) for r in left], [codes(r) for r in right]
    n, m = np.array([r["n"] for r in left])[:, None], np.array([r["n"] for r in right])[None]
    lost = np.minimum(n - np.array([len(c) for c in x])[:, None], m - np.array([len(c) for c in y])[None])
    common = np.minimum(common_counts(x, y) + lost, np.minimum(n, m))
    return np.nonzero(100 * common >= percent * (n + m - common))


def _pairs_of_blocks(percent: int):
    """Pairs across components inside each unit, between its two blocks, that may be
    linked: rows sorted by unit."""

    def found(held: list[dict]) -> pa.RecordBatch:
        left, right = ([r for r in held if r[side]] for side in ("is_low", "is_high"))
        both = ((left[k], right[m]) for k, m in zip(*possible_links(left, right, percent)))
        pairs = sorted({(min(a["cls"], b["cls"]), max(a["cls"], b["cls"])) for a, b in both if a["comp"] != b["comp"]})
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["unit"] != at and held:
                    yield found(held)
                    held = []
                at = row["unit"]
                held.append(row)
        if held:
            yield found(held)
        release()

    return run


class _Finder:
    """The steps of one run over one table."""

    def __init__(self, docs: DataFrame, percent: int, band_rows: int):
        self.spark = docs.sparkSession
        self.docs, self.percent = docs, percent
        self.scratch = Scratch(self.spark, "near_dedup")
        self.table = self.scratch.write(docs.select("*", text_key(F.col("text")).alias("text_key")).mapInArrow(_sketch(band_rows), "doc_id long, text_key long, n long, cls binary, keys array<long>"), "documents")
        some = self.table.filter("n > 0")
        self.classes = self.scratch.write(some.groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "classes")

    def close(self, a: str, b: str):
        """The sizes allow a link."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def shared(self, buckets: DataFrame, tag: str) -> DataFrame:
        """(key, cls, n, size) of the buckets with two members or more; of buckets with
        the same members, which their number and 128 bits tell, the first alone."""
        marks = [F.bit_xor(F.xxhash64(F.lit(k), "cls")).alias(f"mark{k}") for k in (0, 1)]
        sizes = buckets.groupBy("key").agg(F.count("*").alias("size"), *marks).filter("size > 1")
        first = sizes.groupBy("size", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "size")
        return self.scratch.write(buckets.join(self.scratch.write(first, f"{tag}_sizes"), "key"), tag)

    def stars(self, members: DataFrame) -> DataFrame:
        """Pairs of each bucket's hub with the other members."""
        degree = self.scratch.write(members.groupBy("cls").agg(F.sum("size").alias("degree")), "degree")
        ranked = self.scratch.write(members.join(degree, "cls").select("key", "cls", "n", "degree"), "ranked")
        hubs = self.scratch.write(ranked.groupBy("key").agg(F.max(F.struct("degree", F.col("cls").alias("hub"), F.col("n").alias("hub_n"))).alias("best")).select("key", "best.hub", "best.hub_n"), "hubs")
        return ranked.join(hubs, "key").filter("cls <> hub").filter(self.close("n", "hub_n")).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs between the components of each small bucket."""
        right = members.select("key", F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("comp").alias("b_comp"))
        pairs = members.select("key", F.col("cls").alias("a"), "n", "comp").join(right, "key")
        return pairs.filter("a < b and comp <> b_comp").filter(self.close("n", "b_n")).select("a", "b").distinct()

    def sets_of(self, asked: DataFrame) -> DataFrame:
        """The full sets of the classes asked for (a stored table of cls)."""
        ids = self.scratch.write(self.classes.join(asked, "cls").select("doc_id").distinct(), "asked_ids")
        found = only_ids(self.docs, ids).mapInArrow(_sets, "cls binary, members binary")
        return self.scratch.write(found.join(asked, "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("a_set")), "a").join(sets.select(F.col("cls").alias("b"), F.col("members").alias("b_set")), "b")
        return both.select("a", "b", "a_set", "b_set").mapInArrow(_confirm(self.percent), "a binary, b binary")

    def mixed(self, members: DataFrame, tag: str) -> DataFrame:
        """The members (key, cls, n, size, comp) of buckets that hold more than one
        component."""
        some = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
        return self.scratch.write(members.join(self.scratch.write(some, f"{tag}_keys"), "key"), tag)

    def dealt(self, sets: DataFrame, comps: DataFrame) -> DataFrame:
        """The sets (a stored table) by the elements of their prefixes: key, cls, n,
        size, comp of the elements that stand in several components."""
        sums = sets.select("members").mapInArrow(_slot_sums, "slot long, count long").groupBy("slot").agg(F.sum("count").alias("count"))
        counts = np.zeros(SLOTS, np.int64)
        for r in sums.toLocalIterator():  # SLOTS rows at most
            counts[r["slot"]] = r["count"]
        rare = sets.select("cls", "members").mapInArrow(_prefixes(self.percent, counts), "cls binary, n long, elements array<long>")
        members = self.shared(rare.select(F.explode("elements").alias("key"), "cls", "n"), "dealt")
        known = self.scratch.write(members.join(comps, "cls", "left").select("key", "cls", "n", "size", F.coalesce("comp", "cls").alias("comp")), "dealt_known")
        return self.mixed(known, "dealt_left")

    def in_blocks(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs across the components of large buckets that may be linked. A bucket is cut into blocks of
        bounded size, large components apart from the others; each pair of blocks that
        are not of one component is one unit of work."""
        pools = members.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("sum_n"))
        pools = pools.withColumn("pool", F.when(F.col("rows") >= OWN_BLOCKS, F.col("comp")))
        wanted = F.greatest(F.ceil(F.sum("rows") / BLOCK_MEMBERS), F.ceil(F.sum("sum_n") * 4 / BLOCK_BYTES)).cast("int")
        pools = self.scratch.write(pools.groupBy("key", "pool").agg(wanted.alias("blocks")), "pools")
        sized = members.join(self.scratch.write(pools.filter("pool is not null").select("key", F.col("pool").alias("comp"), F.lit(True).alias("alone")), "large"), ["key", "comp"], "left")
        sized = sized.withColumn("pool", F.when(F.col("alone"), F.col("comp")))
        placed = sized.join(pools.withColumnRenamed("key", "p_key").withColumnRenamed("pool", "p_pool"), (F.col("key") == F.col("p_key")) & F.col("pool").eqNullSafe(F.col("p_pool")))
        placed = self.scratch.write(placed.select("key", "cls", "comp", "pool", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")), "placed")
        blocks = pools.select("key", "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        name = F.struct(F.coalesce("pool", F.lit(b"")).alias("pool"), "block")
        blocks = blocks.select("key", "pool", name.alias("name"))
        other = blocks.select(F.col("key").alias("o_key"), F.col("pool").alias("o_pool"), F.col("name").alias("high"))
        units = blocks.join(other, (F.col("key") == F.col("o_key")) & (F.col("name") <= F.col("high")) & (F.col("pool").isNull() | ~F.col("pool").eqNullSafe(F.col("o_pool"))))
        units = self.scratch.write(units.select("key", F.col("name").alias("low"), "high").withColumn("unit", F.monotonically_increasing_id()), "units")
        sides = units.select("key", "unit", F.explode(F.array_distinct(F.array("low", "high"))).alias("name"), "low", "high")
        sides = sides.select("key", "unit", "name", (F.col("name") == F.col("low")).alias("is_low"), (F.col("name") == F.col("high")).alias("is_high"))
        rows = placed.select("key", "cls", "comp", name.alias("name")).join(sides, ["key", "name"]).select("unit", "is_low", "is_high", "cls", "comp")
        codes = self.scratch.write(sets.join(members.select("cls", "n").distinct(), "cls").select("cls", "n", "members").mapInArrow(_codes, "cls binary, n long, codes binary"), "codes")
        full = self.scratch.write(rows, "unit_rows").join(codes, "cls")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(units.count() // UNITS, 100_000))
        # Units are numbered one by one in each of few partitions, so they are dealt
        # evenly; each is bounded, so tasks are.
        dealt = full.repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("unit")
        return dealt.mapInArrow(_pairs_of_blocks(self.percent), "a binary, b binary")

    def components(self, links: DataFrame) -> DataFrame:
        """(cls, comp) of all linked classes; comp is the smallest class reachable.

        Labels sink along links and then jump to their label's label, so the
        rounds follow the logarithm of a component's width.
        """
        edges = self.scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
        labels = self.scratch.write(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
        while True:
            near = edges.join(labels, edges["b"] == labels["cls"]).groupBy("a").agg(F.min("comp").alias("near"))
            sunk = self.scratch.write(labels.join(near, labels["cls"] == near["a"]).select("cls", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), "sunk")
            jump = sunk.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
            moved = self.scratch.write(sunk.join(jump, "comp").select("cls", F.least("comp", "far").alias("comp"), "old"), "moved")
            changed = moved.filter("comp <> old").limit(1).count()
            self.scratch.drop(labels, sunk)
            labels = moved.select("cls", "comp")
            if not changed:
                return labels

    def run(self) -> DataFrame:
        """(cls, comp) of the linked classes."""
        bands = self.classes.select(F.explode("keys").alias("key"), "cls", "n")
        members = self.shared(bands, "members")
        stars = self.scratch.write(self.stars(members), "stars")
        asked = self.scratch.write(stars.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "asked")
        links = self.scratch.write(self.confirmed(stars, self.sets_of(asked)), "links")
        comps = self.components(links)
        known = self.scratch.write(members.join(comps, "cls", "left").select("key", "cls", "n", "size", F.coalesce("comp", "cls").alias("comp")), "known")
        left = self.mixed(known, "left")
        pairs = self.scratch.write(self.across(left.filter(F.col("size") <= SMALL)).join(stars, ["a", "b"], "left_anti"), "pairs")
        large = self.scratch.write(left.filter(F.col("size") > SMALL).select("cls").distinct(), "large")
        asked = self.scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(large).distinct(), "asked")
        self.scratch.drop(members, known, left)
        if not asked.limit(1).count():
            return comps
        sets = self.sets_of(asked)
        more = self.confirmed(pairs, sets)
        if large.limit(1).count():
            dealt = self.dealt(self.scratch.write(sets.join(large, "cls", "left_semi"), "large_sets"), comps)
            few = self.scratch.write(self.across(dealt.filter(F.col("size") <= SMALL)).join(pairs.unionByName(stars), ["a", "b"], "left_anti"), "few")
            # Elements of one family of texts have much the same members: those with the
            # same first member are one bucket, which each class joins once.
            many = dealt.filter(F.col("size") > SMALL)
            first = self.scratch.write(many.groupBy("key").agg(F.min("cls").alias("first")), "first")
            many = self.scratch.write(many.join(first, "key").select(F.col("first").alias("key"), "cls", "n", "comp").distinct(), "many")
            known = pairs.unionByName(stars).unionByName(few)
            some = self.scratch.write(self.in_blocks(many, sets).distinct().join(known, ["a", "b"], "left_anti"), "block_pairs")
            more = more.unionByName(self.confirmed(few.unionByName(some), sets))
        more = self.scratch.write(more.distinct(), "more")
        self.scratch.drop(sets)
        if more.limit(1).count():
            comps = self.components(self.scratch.write(links.unionByName(more), "links"))
        return comps


def _judged(docs: DataFrame, percent: int, band_rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, component_id, kept."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    finder = _Finder(table, percent, band_rows)
    comps = finder.run()
    some = finder.table.filter("n > 0").select("doc_id", "text_key", "n", "cls")
    named = finder.scratch.write(some.join(comps, "cls", "left").select("doc_id", "text_key", "n", F.coalesce("comp", "cls").alias("comp")), "named")
    least = finder.scratch.write(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "components")
    linked = named.join(least, "comp").select("doc_id", "text_key", "n", "component_id")
    alone = finder.table.filter("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, *, percent: int = PERCENT, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, percent, band_rows, id_col, text_col).drop("text_key")


def drop_near_duplicates(docs: DataFrame, *, percent: int = PERCENT, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that near_dedup keeps, with their own columns. Rows that share an id
    (or have none) go by their own text."""
    scratch = Scratch(docs.sparkSession, "drop_near")
    found = _judged(docs, percent, band_rows, id_col, text_col)
    return without_rows(docs, scratch.write(found.filter("not kept").select("doc_id", "text_key").distinct(), "dropped"), id_col, text_col)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, band_rows=6)
