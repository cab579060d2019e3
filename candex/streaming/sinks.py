"""Streaming inputs and drains.

Streams are drained to Parquet in the shared folder, never to driver memory. Rows of a key must arrive in order
across micro-batches; within one they are sorted. ``files_per_batch`` bounds a micro-batch and with it the rows
of one key that a task holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from candex.plans import limits
from candex.plans.ordered import first_rows


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A named Parquet input as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if _status(spark, path).isDirectory():
        return stream_folder(spark, path, schema, files_per_batch)
    return stream_folder(spark, folder, schema, files_per_batch, f"{name}.parquet")


def _status(spark: SparkSession, path: str):
    """What the path's own file system says about it, None if there is nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(place) if system.exists(place) else None


def _written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows a drain wrote; an empty table if there was no micro-batch."""
    if _status(spark, path) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stream_folder(spark: SparkSession, folder: str, schema, files_per_batch: int = 64, glob: str = "*.parquet"):
    """A folder of Parquet files as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .parquet(folder)
    )


def drain_append(sdf: DataFrame, label: str) -> DataFrame:
    """Runs an append-mode stream over what is there now and gives the rows it wrote."""
    spark = sdf.sparkSession
    path = limits.scratch_path(spark, label)
    query = (
        sdf.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _written(spark, f"{path}/rows", sdf.schema)


def runs(batches: int, fan: int) -> list[tuple[int, int]]:
    """Level and number of the runs that hold the first ``batches`` micro-batches, newest first.

    Run ``(l, i)`` holds ``fan ** l`` micro-batches from ``i * fan ** l`` on. There are at most ``fan - 1`` runs a level.
    """
    out, level = [], 0
    while batches:
        batches, rest = divmod(batches, fan)
        out += [(level, batches * fan + i) for i in reversed(range(rest))]
        level += 1
    return out


def _versions(spark: SparkSession, path: str, schema: StructType, held: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """The last row of each key in some runs, with the number of its micro-batch."""
    rows = spark.read.schema(schema).parquet(*[f"{path}/rows/level={level}/run={i}" for level, i in held])
    return rows if len(held) == 1 else first_rows(rows, keys, [F.col("_batch").desc()])


def upsert_stream(sdf: DataFrame, keys: list[str], path: str, fan: int = 8) -> DataFrame:
    """Runs an update-mode aggregation over what is there now into the keyed table at ``path`` and gives that table.

    A micro-batch is written as a run of its own. Every ``fan`` runs of a level are merged into one run of the next, with one row
    a key, so a row is written once a level and a read after n micro-batches meets at most ``(fan - 1) * log(n)`` runs
    however long the stream has been going. Run names follow from the number of the micro-batch, and nothing is deleted:
    a retry writes the same runs over. A micro-batch counts when its mark is there, which is made last. The table goes on
    where it was when the same stream is started again with the same ``path`` and ``fan``.
    """
    spark = sdf.sparkSession
    schema = StructType([*sdf.schema.fields, StructField("_batch", LongType())])

    def put(rows: DataFrame, level: int, i: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/level={level}/run={i}")

    def write(batch: DataFrame, number: int) -> None:
        put(batch.withColumn("_batch", F.lit(number).cast("long")), 0, number)
        level, n = 0, number + 1
        while n % fan == 0:
            merged = _versions(batch.sparkSession, path, schema, [(level, i) for i in range(n - fan, n)], keys)
            level, n = level + 1, n // fan
            put(merged, level, n - 1)
        _mark(spark, f"{path}/marks/{number + 1}")

    query = (
        sdf.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return keyed_table(spark, path, sdf.schema, keys, fan)


def _mark(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


def keyed_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], fan: int = 8) -> DataFrame:
    """The rows of a table that ``upsert_stream`` keeps, one a key, as of its last marked micro-batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [int(s.getPath().getName()) for s in system.listStatus(place)] if system.exists(place) else []
    if not marks:
        return spark.createDataFrame([], schema)
    numbered = StructType([*schema.fields, StructField("_batch", LongType())])
    return _versions(spark, path, numbered, runs(max(marks), fan), keys).drop("_batch")


def drain_update(sdf: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Runs an update-mode aggregation over what is there now and gives the last row of each key."""
    return upsert_stream(sdf, keys, limits.scratch_path(sdf.sparkSession, label))
