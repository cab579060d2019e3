"""Size checks and the shared scratch folder.

Every limit is a session setting, so a cluster can raise or lower it without code changes:

``spark.candex.groupRows``      rows of one group that a single window task may sort (default 5 000 000)
``spark.candex.foldRows``       rows of one group that may be collected into one array (default 20 000)
``spark.candex.checkBytes``     inputs read from fewer bytes than this skip the hot-group check (default 128 MiB)
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "groupRows": 5_000_000,
    "foldRows": 20_000,
    "checkBytes": 128 * 1024 * 1024,
}

_UNITS = {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50, "EiB": 2**60}
_LEAF = re.compile(r"(?:Relation|LogicalRDD|LocalRelation|Range|InMemoryRelation).*sizeInBytes=([0-9.E+]+) (\w+)")


def limit(spark: SparkSession, name: str) -> int:
    """The session's value of a limit."""
    return int(spark.conf.get(f"spark.candex.{name}", str(DEFAULTS[name])))


def leaf_bytes(df: DataFrame) -> float:
    """Bytes of the tables ``df`` reads, from the optimizer's own statistics; no job is run."""
    text = df.sparkSession.sql("EXPLAIN COST SELECT * FROM {df}", df=df).first()[0]
    logical = text.split("== Physical Plan ==")[0]
    found = _LEAF.findall(logical)
    if not found:
        return float("inf")
    return sum(float(size) * _UNITS.get(unit, 2**60) for size, unit in found)


def small_input(df: DataFrame) -> bool:
    """Whether ``df`` comes from so little data that no group of it can be too large for a task."""
    return leaf_bytes(df) <= limit(df.sparkSession, "checkBytes")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or set on the context; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one written table in the shared folder."""
    return f"{shared_folder(spark)}/candex-{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and survive the loss of executors.

    A written table also tells the optimizer its true size, so later joins with a small one broadcast it.
    """
    path = scratch_path(df.sparkSession, "pin")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
