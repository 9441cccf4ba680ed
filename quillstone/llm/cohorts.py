"""Cohort retention with two states of knowledge.

Clicks arrive late. State 0 knows the clicks that had arrived before a cut-off, state 1
knows all. In each state a client's start is its earliest known click of one kind, its
cohort the day of the start, and each of its known clicks from the start on has a period,
the whole days since. A cell (state, segment, cohort, period) counts clients and sums
cents.

How the work is laid out:

* Rows that are equal in every column are one click: a distinct over all columns, dealt
  by all of them, so a client's rows are spread.
* One aggregation with conditional minima gives each client both starts and its number of
  clicks. The starts go back to the clicks by a shuffle join (a hint keeps it one).
* A client with more than one of ``SLICES`` parts of all clicks is cut into slices of
  that size, by a hash of the click: its starts are repeated once a slice. The clicks
  learn the number of slices from a broadcast of those clients, who are fewer than
  ``SLICES`` whatever the input.
* Clicks become rows of (state, client, period) by partial aggregation before the next
  shuffle, and those become cells. Nothing that grows with the input goes to one task,
  to the driver or into a broadcast.

Built of DataFrame functions only.

Defined results: clicks without a time or a client are dropped; a click whose arrival is
unknown is known to state 1 only; a null or non-finite value has no cents; a null kind
starts nothing. A client that the clients table lacks, or whose segment is null there,
has the segment ''; of several rows of one client the smallest segment counts. Further
columns tell clicks apart and have no other use, whatever their names. Without clicks, or
without starts, there are no rows. Times without a zone are taken as they stand,
whatever the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .support import Scratch

DAY = 86_400_000_000
#: A client with a larger share of all clicks than one of so many parts is sliced. There
#: are fewer such clients than this number.
SLICES = 4096


def micros(table: DataFrame, time: str) -> Column:
    """Microseconds since 1970. A time without a zone is counted from its own fields, so
    that no zone with its summer time comes in."""
    c = F.col(time)
    if not isinstance(table.schema[time].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + second


def cents(value: Column) -> Column:
    """Hundredths, halves upwards; none for a null, an infinity or no number."""
    v = value.cast("double")
    return F.when(F.abs(v) < 9e15, F.floor(v * 100 + 0.5)).otherwise(0).cast("long")


def distinct_clicks(clicks: DataFrame, delay: Column | None, cutoff: int, start_kind: str) -> DataFrame:
    """client, at, early (known to state 0), opens (a start), cents and deal (a hash of the
    row) of every click."""
    rows = clicks.filter(F.col("ts").isNotNull() & F.col("client_id").isNotNull()).distinct()
    arrives = micros(clicks, "arrived_at") + (F.lit(0) if delay is None else F.coalesce(delay, F.lit(0)).cast("long"))
    return rows.select(
        F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("at"), F.coalesce(arrives < cutoff, F.lit(False)).alias("early"),
        F.coalesce(F.col("kind") == start_kind, F.lit(False)).alias("opens"), cents(F.col("value")).alias("cents"),
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in clicks.columns]), F.lit(1 << 15)).cast("short").alias("deal"),
    )


def client_starts(table: DataFrame) -> DataFrame:
    """client, start_0, start_1 (microseconds; null without one) and n, its clicks."""
    opens = F.col("opens")
    found = table.groupBy("client").agg(F.min(F.when(opens & F.col("early"), F.col("at"))).alias("start_0"), F.min(F.when(opens, F.col("at"))).alias("start_1"), F.count("*").alias("n"))
    return found.filter("start_1 is not null")


def cohort_retention(clicks: DataFrame, clients: DataFrame, *, cutoff: int, delay: Column | None = None, start_kind: str = "signup", cohort_days: int = 1, period_days: int = 1, slices: int = SLICES) -> DataFrame:
    """One row a nonempty cell: state, segment, cohort, period, users, users_crc32, moved
    and cents.

    clicks: click_id, ts, arrived_at, client_id, kind, value; clients: client_id,
    segment. cutoff: microseconds since 1970; delay: a column of microseconds by which a
    click arrives after arrived_at. moved counts the clients with starts in both states
    and different cohorts."""
    scratch = Scratch(clicks.sparkSession, "cohorts")
    table = scratch.write(distinct_clicks(clicks, delay, cutoff, start_kind), "clicks")
    starts = scratch.write(client_starts(table), "starts")
    share = (starts.agg(F.sum("n")).first()[0] or 0) // slices + 1

    segments = clients.groupBy(F.col("client_id").cast("long").alias("client")).agg(F.min("segment").alias("segment"))
    cohort = [_floor_div(F.col(f"start_{k}"), DAY * cohort_days) for k in (0, 1)]
    known = starts.hint("merge").join(segments, "client", "left").select(
        "client", "start_0", "start_1", F.coalesce("segment", F.lit("")).alias("segment"), cohort[0].alias("cohort_0"), cohort[1].alias("cohort_1"), F.expr(f"n div {share} + 1").alias("slices"),
    )
    known = known.withColumn("slice", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int")))).drop("slices")

    hot = F.broadcast(starts.filter(F.col("n") >= share).select("client", F.expr(f"n div {share} + 1").alias("slices")))
    slice_of = F.coalesce(F.col("deal") % F.col("slices"), F.lit(0)).cast("int")
    sliced = table.join(hot, "client", "left").select("client", "at", "early", "cents", slice_of.alias("slice"))
    # The slice is no column of the next grouping, so that one shuffles by its own keys:
    # a hot client's rows are summed where they are and then spread by period.
    both = sliced.hint("merge").join(known, ["client", "slice"])

    def state(k: int) -> Column:
        begin = F.col(f"start_{k}")
        seen = F.col("at") >= begin
        row = F.struct(F.lit(k).alias("state"), F.col(f"cohort_{k}").alias("cohort"), _floor_div(F.col("at") - begin, DAY * period_days).alias("period"))
        return F.when((seen & F.col("early")) if k == 0 else seen, row)

    moved = F.coalesce(F.col("cohort_0") != F.col("cohort_1"), F.lit(False)).cast("long")
    rows = both.select("client", "segment", "cents", moved.alias("moved"), F.inline(F.array_compact(F.array(state(0), state(1)))))
    # Segment, cohort and moved are the client's; as keys they need no buffer of strings.
    by_client = rows.groupBy("state", "client", "period", "segment", "cohort", "moved").agg(F.sum("cents").alias("cents"))
    return by_client.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(F.crc32(F.col("client").cast("string").cast("binary"))).alias("users_crc32"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents"),
    )


def _floor_div(a: Column, b: int) -> Column:
    """Whole division downwards, exact for long integers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


#: 2024-02-15 00:00 in microseconds.
CUTOFF = 1_707_955_200_000_000


def op12_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % 3 == 0, h % 100 * F.lit(DAY)).otherwise(0)
    return cohort_retention(clicks, spark.read.parquet(f"{sf_dir}/clients.parquet"), cutoff=CUTOFF, delay=late)


def _crc32_sql(number: str) -> str:
    """crc32 of a decimal number's text, by half bytes."""
    table = []
    for half in range(16):
        for _ in range(4):
            half = half >> 1 ^ 0xEDB88320 * (half & 1)
        table.append(half)
    find = f"{table}::BIGINT[]"
    step = lambda c, b: f"xor(({find})[1 + (xor({c}, {b}) & 15)], ({c}) >> 4)"
    first = step("c", "b")
    return f"xor(list_reduce(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: {step(first, '(b >> 4)')}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


ORACLE = f"""
WITH d AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT *, {_crc32_sql("click_id")} AS h FROM d),
a AS (SELECT client_id, ts, kind, CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents,
             arrived_at + CASE WHEN h % 3 = 0 THEN to_days(CAST(h % 100 AS INTEGER)) ELSE to_days(0) END AS arrives
      FROM h),
k AS (SELECT a.*, s.state FROM a, (VALUES (0), (1)) AS s(state)
      WHERE s.state = 1 OR a.arrives < TIMESTAMP '2024-02-15 00:00:00'),
b AS (SELECT state, client_id, min(ts) AS start, CAST(datediff('day', DATE '1970-01-01', CAST(min(ts) AS DATE)) AS BIGINT) AS cohort
      FROM k WHERE kind = 'signup' GROUP BY ALL),
m AS (SELECT client_id, CAST(count(DISTINCT cohort) > 1 AS BIGINT) AS moved FROM b GROUP BY ALL),
c AS (SELECT k.state, k.client_id, b.cohort, m.moved, k.cents,
             CAST(floor((epoch_us(k.ts) - epoch_us(b.start)) // 86400000000) AS BIGINT) AS period
      FROM k JOIN b ON k.state = b.state AND k.client_id = b.client_id JOIN m ON m.client_id = b.client_id
      WHERE k.ts >= b.start),
u AS (SELECT state, client_id, cohort, period, moved, sum(cents) AS cents FROM c GROUP BY ALL),
g AS (SELECT client_id, min(segment) AS segment FROM clients GROUP BY ALL)
SELECT u.state, coalesce(g.segment, '') AS segment, u.cohort, u.period, count(*) AS users,
       CAST(sum({_crc32_sql("u.client_id")}) AS BIGINT) AS users_crc32,
       CAST(sum(u.moved) AS BIGINT) AS moved, CAST(sum(u.cents) AS BIGINT) AS cents
FROM u LEFT JOIN g ON g.client_id = u.client_id
GROUP BY ALL
"""
