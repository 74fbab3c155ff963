"""What the training-data operators share: tables in the cluster's shared folder and
connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder stands in, but only if driver and tasks are one
    process (a local master); elsewhere executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="breakwater-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return "file://" + _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/breakwater/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder; returns it reread (its lineage is cut) and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_and_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can have any name."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """Components of ``edges(a long, b long)`` as ``(node, root)``, root the smallest node.

    Alternates the large-star and small-star steps on a distributed edge table until the
    table no longer changes; every round is written to the shared folder, so a lost
    executor costs at most that round. A node with very many neighbours is aggregated
    before the shuffle and joined back with an equi-join that AQE can split. Nodes without
    an edge are not returned; loops are ignored. Also returns the path of the last table.
    """
    spark = edges.sparkSession
    now, path = write_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def mark(df: DataFrame) -> tuple:
        got = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(got)

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    seen = mark(now)
    for _ in range(max_rounds if seen[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = smallest(turned)
        small = turned.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_at = write_table(small, "links")
        drop_table(spark, path)
        now, path, before = new, new_at, seen
        seen = mark(now)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), path
