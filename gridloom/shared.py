"""Tables in the folder that driver and executors share: where long plans cut their lineage and lost executors lose nothing."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MARK = "gridloom-"
_HERE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; a new local one only where Spark runs in one process."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix=_MARK)
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _made() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_HERE, "stack"):
        _HERE.stack = []
    return _HERE.stack


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back; whoever ends the session deletes what is left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{_MARK}{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    if _made():
        _made()[-1].append((spark, path))
    df.write.parquet(path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """The name of a new place in the shared folder, for files that are no table; deleted when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{_MARK}{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def _folders(df: DataFrame) -> set[str]:
    """Names of the tables of materialize() that df reads."""
    parts = (f.rpartition("/")[0] for f in df.inputFiles())
    return {p for p in parts if p.rpartition("/")[2].startswith(_MARK)}


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in tables:
        for path in _folders(df):
            _delete(df.sparkSession, path)


def tidy(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function that builds a DataFrame, whose tables are deleted unless the result still reads them."""

    @functools.wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        _made().append([])
        kept: set[str] = set()
        try:
            out = build(*args, **kwargs)
            kept = {p.rpartition("/")[2] for p in _folders(out)}
        finally:
            for spark, path in _made().pop():
                if path.rpartition("/")[2] not in kept:
                    _delete(spark, path)
                elif _made():
                    _made()[-1].append((spark, path))
        return out

    return run
