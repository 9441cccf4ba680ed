"""The SparkSession this engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution splits skewed joins and merges small partitions at run time. Tables
#: that were stored between steps are deleted when nothing refers to them any more.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session made elsewhere by bytes too: rows of whole
    texts and pages make batches bounded by rows alone as large as the rows are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, SETTINGS[name])


def stored(table: DataFrame, needed: bool = False) -> DataFrame:
    """The table, written once to the checkpoint folder that all executors share, where
    several steps read it. Without such a folder it is computed for each of them; where
    they need the very same rows and partitions, a session that is not local is refused,
    and a local one keeps them."""
    spark = table.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return table.checkpoint()
    if needed and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return table.persist() if needed else table


def session(app: str = "quillstone", **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword arguments add to them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
