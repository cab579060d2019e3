"""Reading named tables, listing files, writing chosen payloads, access reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candex.functions.names import has_ext
from candex.functions.numbers import _c


def load_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A named Parquet input; only the columns and row groups a query needs are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def inventory_files(spark: SparkSession, folder: str, exts=None, glob: str = "*") -> DataFrame:
    """``path, name, length`` of the files below a folder, without reading their content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    )
    return files if exts is None else files.where(has_ext("name", exts))


def write_selection(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", spread: int = 8) -> str:
    """Writes the chosen payloads, one folder per kind, in at most ``spread`` files for each kind.

    An existing folder is an error unless ``mode`` says otherwise. Raise ``spread`` with the size of the largest kind.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(partitions, F.col(kind), salt).write.mode(mode).partitionBy(kind).parquet(path)
    return path


def access_report(df: DataFrame, keys: list[str], length, view: str | None = None) -> DataFrame:
    """Reads and bytes per input, and the view that served it when there is one."""
    more = [] if view is None else [F.max(view).alias("view")]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(_c(length)), F.lit(0)).alias("bytes"), *more
    )


def union_views(views: dict[str, DataFrame]) -> DataFrame:
    """Several views of the same input as one table with a ``view`` column."""
    return reduce(DataFrame.unionByName, [d.withColumn("view", F.lit(v)) for v, d in views.items()])
