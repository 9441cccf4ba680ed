"""A keyed log of what a table already holds, so that a batch looks only where its own
keys can be.

Beside the table's files lie ``_keys``, the keys in folders by a hash, and ``_commits``, a
small file for each finished batch with its number of keys in its name (Spark's readers
leave both out). A batch reads the folders of its own hashes. When there are more keys
than ``ROWS`` a folder, the log is written anew with four times the folders, which happens
after ever longer times; so the cost of a batch does not grow with the table.

A batch writes its rows to a folder of its own number, and its mark last: one that is
run again after a failure writes over what it had left, and one whose mark is there does
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Keys a folder in the mean, folders of a new log, and folders that a batch names.
ROWS, FOLDERS, NAMED = 100_000, 16, 5_000


class KeyLog:
    """The log of one table; rows are told apart by one key column. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, rows: int = ROWS):
        self.spark, self.path, self.key, self.rows = spark, path.rstrip("/"), key, rows

    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        path, store = self._hadoop(name)
        return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []

    def commits(self) -> dict[int, int]:
        """The finished batches and their numbers of keys."""
        return {int(a): int(b) for a, b in (n.split("-") for n in self._listed("_commits") if not n.startswith((".", "_")))}

    def folders(self) -> int:
        """How many folders the log has: the largest number whose folders are whole."""
        whole = [int(n.partition("=")[2]) for n in self._listed("_keys") if n.startswith("of=") and "_whole" in self._listed(f"_keys/{n}")]
        return max(whole, default=0)

    def _folder_of(self, number: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(number)).cast("int")

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/_keys/of={number}").parquet(f"{self.path}/_keys/of={number}/folder=*")

    def _touch(self, name: str) -> None:
        path, store = self._hadoop(name)
        store.create(path, True).close()

    def _any(self, number: int) -> bool:
        return any(n.startswith("folder=") for n in self._listed(f"_keys/of={number}"))

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose keys no other batch has committed; null keys are never seen."""
        number = self.folders()
        if not number or not self._any(number):
            return rows
        own = self._folder_of(number)
        named = [r[0] for r in rows.select(own.alias("f")).distinct().limit(NAMED + 1).collect()]
        log = self._read(number)
        log = log.filter(F.col("folder").isin(named)) if len(named) <= NAMED else log
        done = list(self.commits())
        seen = log.filter(F.col("batch").isin(done) & (F.col("batch") != batch)).select(self.key)
        return rows.join(seen, self.key, "left_anti")

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Write the rows whose keys are new, one row a key; the number written. batch:
        the batch's number, the next one by default."""
        done = self.commits()
        batch = max(done, default=-1) + 1 if batch is None else batch
        if batch in done:
            return 0
        number = self.folders()
        if not number:
            number = FOLDERS
            self._touch(f"_keys/of={number}/_whole")
        new = stored(self.unseen(rows, batch).dropDuplicates([self.key]), needed=True)
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        keys = new.filter(F.col(self.key).isNotNull()).select(self.key, self._folder_of(number).alias("folder"), F.lit(batch).alias("batch"))
        # What a failed run left in the log has the same keys, which are read once.
        keys.repartition("folder").write.mode("append").partitionBy("folder").parquet(f"{self.path}/_keys/of={number}")
        count = new.count()
        self._touch(f"_commits/{batch:012d}-{count}")
        self._grow(number, sum(done.values()) + count)
        return count

    def _grow(self, number: int, total: int) -> None:
        if total <= number * self.rows:
            return
        larger = number * 4
        path, store = self._hadoop(f"_keys/of={larger}")
        store.delete(path, True)  # what an earlier try left
        done = list(self.commits())
        keys = self._read(number).filter(F.col("batch").isin(done)).select(self.key, self._folder_of(larger).alias("folder"), "batch").distinct()
        keys.repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/_keys/of={larger}")
        self._touch(f"_keys/of={larger}/_whole")
        path, store = self._hadoop(f"_keys/of={number}")
        store.delete(path, True)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the finished batches, with the number of their batch."""
    done = list(KeyLog(spark, path, "").commits())
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch").isin(done))
