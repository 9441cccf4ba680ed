"""Groups of a key, read one after another from sorted rows.

A grouped Arrow function costs milliseconds a group, whatever the group holds; here a task
reads its sorted rows as a stream of batches, each of which holds many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of a batch that a task returns.
ROWS = 10_000


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Schema, object, dict[str, list]]]:
    """Each run of one key with the values of all columns, however batches cut it."""
    own, held = None, None
    for batch in batches:
        columns, at = batch.to_pydict(), 0
        for value, run in groupby(columns[key]):
            end = at + sum(1 for _ in run)
            if held is not None and value != own:
                yield batch.schema, own, held
                held = None
            own, held = value, held or {n: [] for n in columns}
            for n in columns:
                held[n] += columns[n][at:end]
            at = end
        schema = batch.schema
    if held is not None:
        yield schema, own, held


def by_key(rows: DataFrame, key: str, step: Callable[[dict[str, list]], list[tuple]], returned: Sequence[str]) -> DataFrame:
    """The key and what step makes of each of its groups: values of the columns returned.
    One group is held at a time, beside a batch."""
    names = [key, *returned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(n).type) for i, n in enumerate(names)], names=names)

        for schema, own, columns in groups(batches, key):  # noqa: B007
            out += [(own, *row) for row in step(columns)]
            if len(out) >= ROWS:
                yield batch()
                out = []
        if out:
            yield batch()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, StructType([rows.schema[n] for n in names]))
