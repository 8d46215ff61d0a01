"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # folders of this process's tables, those that were deleted left out


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The table stays until its folder is deleted, by temporary() or by discard_before(); results may still be read from it.
    group_rows: most rows of a row group, for rows so large that a hundred of them, after which Parquet's writer looks at
    sizes for the first time, don't fit a task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    limit = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.options(**limit).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        _made.remove(path)


def discard_before(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which the table of that name stored last before it is deleted: for rounds that replace one another."""
    old = next((p for p in reversed(_made) if p.rpartition("/")[2].rpartition("-")[0] == name), None)
    out = stored(df, name)
    if old:
        _delete(df.sparkSession, [old])
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are stored inside, but for those stored last under the names that the block puts in the list."""
    kept: list[str] = []
    known = len(_made)
    try:
        yield kept
    finally:
        inside = _made[known:]
        last = {p.rpartition("/")[2].rpartition("-")[0]: p for p in inside}
        _delete(spark, [p for p in inside if p not in {last.get(name) for name in kept}])
