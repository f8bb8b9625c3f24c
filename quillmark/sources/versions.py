"""Tables and models that are replaced as a whole and can be read at any time.

Each version has a folder of its own, and a small pointer that is written last names the one that counts. So a table may replace the
one it is read from, and after a write that was cut off the old version is still there. Old versions stay until the folder's owner
removes them. A folder without pointers is read as it is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "place long, version string"


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).json(f"{path}/pointers")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def current(spark: SparkSession, path: str) -> str:
    """Folder of the version that counts; ``path`` itself if it has no versions."""
    pointers = _pointers(spark, path)
    row = pointers.orderBy(F.desc("place"), "version").first() if pointers is not None else None
    return f"{path}/versions/{row['version']}" if row else path


def new_version(path: str) -> tuple[str, str]:
    """(name, folder) of a version to be written; it doesn't count before `publish`."""
    name = uuid.uuid4().hex
    return name, f"{path}/versions/{name}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """From now on ``version``, which must be complete, is the one that counts."""
    pointers = _pointers(spark, path)
    last = pointers.agg(F.max("place")).first()[0] if pointers is not None else None
    row = spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("place"), F.lit(version).alias("version"))
    row.coalesce(1).write.mode("append").json(f"{path}/pointers")  # a file appears whole or not at all


def replace_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as the new version of a Parquet table; ``df`` may be read from the old one."""
    version, folder = new_version(path)
    df.write.partitionBy(*partition_by).parquet(folder)
    publish(df.sparkSession, path, version)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last complete write."""
    return spark.read.parquet(current(spark, path))
