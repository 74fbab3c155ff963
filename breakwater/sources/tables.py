"""Tables between the stages of a large plan, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths of the tables that were written and not removed since.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and driver and tasks are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="breakwater-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return "file://" + _LOCAL["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and reread: its lineage is cut, and a lost executor costs one stage."""
    path = f"{shared_dir(df.sparkSession)}/breakwater/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


@contextmanager
def scans(spark: SparkSession, least: int) -> Iterator[None]:
    """What is run inside reads a table in at least so many tasks, as far as its files can be split."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(max(least, int(before or spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more; other tables stay."""
    path = getattr(df, "_staged_at", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all tables staged inside it; results must have been read or written by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            _WRITTEN.remove(path)
            _remove(spark, path)
