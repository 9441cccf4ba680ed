"""Stata files (.dta, releases 117 to 119) as tables, read by ranges of rows.

Such a file says in its map where each part begins, and its records all have one width,
so a partition reads its rows from their place on, and nothing before them. Texts that a
file shares between records (strL) are not read and are null.

Dates come as dates (%td), months as the first day of the month (%tm), date-times as
timestamps without a zone (%tc); missing values of all kinds are null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ByteType, DateType, DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType, TimestampNTZType

from .store import opened

# The codes of the number types, and the largest value of each that is none
# of its missing ones.
NUMBERS = {65526: ("f8", 8.988465674311579e307), 65527: ("f4", 1.7014117331926443e38), 65528: ("i4", 2147483620), 65529: ("i2", 32740), 65530: ("i1", 100)}
STRL = 32768
PLAIN = {"f8": DoubleType(), "f4": FloatType(), "i4": IntegerType(), "i2": ShortType(), "i1": ByteType()}
#: Bytes of records a partition.
RANGE_BYTES = 64 << 20


class Layout:
    """What the head of a file says: names, types and formats of its variables, number of
    records, and where they begin."""

    def __init__(self, file):
        head = bytes(file.read(4096))
        if not head.startswith(b"<stata_dta><header><release>"):
            raise ValueError("not a Stata file of release 117 or later")
        self.release = int(_between(head, b"<release>", b"</release>"))
        self.order = "<" if _between(head, b"<byteorder>", b"</byteorder>") == b"LSF" else ">"
        wide = self.release >= 118
        count = _between(head, b"<K>", b"</K>")
        k = struct.unpack(self.order + ("I" if self.release >= 119 else "H"), count)[0]
        self.rows = struct.unpack(self.order + ("Q" if wide else "I"), _at(head, b"<N>", 8 if wide else 4))[0]
        places = struct.unpack(f"{self.order}14Q", _at(head, b"<map>", 112))
        part = lambda i, tag, size: self._read(file, places[i] + len(tag), size)
        self.types = struct.unpack(f"{self.order}{k}H", part(2, "<variable_types>", 2 * k))
        name, form = (129, 57) if wide else (33, 49)
        self.names = _texts(part(3, "<varnames>", name * k), name)
        self.formats = _texts(part(5, "<formats>", form * k), form)
        self.begin = places[9] + len("<data>")
        fields = [(f"f{i}", self.order + NUMBERS[t][0] if t in NUMBERS else f"S{8 if t == STRL else t}") for i, t in enumerate(self.types)]
        self.record = np.dtype(fields)

    @staticmethod
    def _read(file, at: int, size: int) -> bytes:
        file.seek(at)
        return bytes(file.read(size))

    def schema(self) -> StructType:
        return StructType([StructField(n, self._type(t, f)) for n, t, f in zip(self.names, self.types, self.formats)])

    @staticmethod
    def _type(code: int, form: str):
        if code not in NUMBERS:
            return StringType()
        day = form.lstrip("%-0123456789")
        return DateType() if day.startswith(("td", "d", "tm")) else TimestampNTZType() if day.startswith("tc") else PLAIN[NUMBERS[code][0]]

    def column(self, i: int, records: np.ndarray) -> pa.Array:
        code, raw = self.types[i], records[f"f{i}"]
        if code == STRL:
            return pa.nulls(len(raw), pa.string())
        if code not in NUMBERS:
            return pa.array([x.decode("utf-8" if self.release >= 118 else "latin-1", "replace") for x in raw.tolist()], pa.string())
        kind, top = NUMBERS[code]
        values = raw.astype(kind)  # in this machine's order
        missing = ~(values <= top)
        form = self.formats[i].lstrip("%-0123456789")
        if form.startswith("tm"):
            months = np.where(missing, 0, values).astype(np.int64)
            return pa.array([None if m else date(1960 + v // 12, v % 12 + 1, 1) for v, m in zip(months.tolist(), missing)], pa.date32())
        if form.startswith(("td", "d")):
            days = np.where(missing, 0, values).astype(np.int64)
            return pa.array([None if m else date(1960, 1, 1) + timedelta(days=v) for v, m in zip(days.tolist(), missing)], pa.date32())
        if form.startswith("tc"):
            ms = np.where(missing, 0, values).astype(np.int64)
            return pa.array([None if m else datetime(1960, 1, 1) + timedelta(milliseconds=v) for v, m in zip(ms.tolist(), missing)], pa.timestamp("us"))
        return pa.array(values, mask=missing)


def _between(head: bytes, begin: bytes, end: bytes) -> bytes:
    return head[head.index(begin) + len(begin) : head.index(end)]


def _at(head: bytes, tag: bytes, size: int) -> bytes:
    begin = head.index(tag) + len(tag)
    return head[begin : begin + size]


def _texts(raw: bytes, size: int) -> list[str]:
    return [raw[i : i + size].partition(b"\0")[0].decode("utf-8", "replace") for i in range(0, len(raw), size)]


class _Rows(InputPartition):
    def __init__(self, first: int, number: int):
        self.first, self.number = first, number


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        with opened(self.path) as file:
            layout = Layout(file)
        each = max(1, self.range_bytes // max(layout.record.itemsize, 1))
        return [_Rows(i, min(each, layout.rows - i)) for i in range(0, layout.rows, each)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as file:
            layout = Layout(file)
            size = layout.record.itemsize
            for first in range(partition.first, partition.first + partition.number, 8192):
                n = min(8192, partition.first + partition.number - first)
                records = np.frombuffer(layout._read(file, layout.begin + first * size, n * size), layout.record)
                yield pa.RecordBatch.from_arrays([layout.column(i, records) for i in range(len(layout.names))], layout.names)


class StataSource(DataSource):
    """spark.read.format("stata").load(path). Option range_bytes: bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as file:
            return Layout(file).schema()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_stata(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of a Stata file, read by as many tasks as its bytes need."""
    spark.dataSource.register(StataSource)
    return spark.read.format("stata").option("range_bytes", range_bytes).load(path)
