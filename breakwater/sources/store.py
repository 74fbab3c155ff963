"""A store of series from which one series is read without scanning the others.

The table is cut into buckets by id and sorted in each, so a filter on the id reads one bucket,
and row groups of it whose range of ids holds the one asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.sources import series

#: Buckets of a store; a bucket of 100 to 500 MB reads fast.
BUCKETS = 64


def write_store(table: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Writes ``id, seq, period, value`` as the table ``name``, over an older one; at ``path`` if given."""
    # One task a bucket, so that a bucket is one file.
    rows = series.validate(table).select("id", "seq", "period", "value").repartition(buckets, "id")
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "id").sortBy("id", "seq")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_one(spark: SparkSession, name: str, ident: int | str) -> DataFrame:
    """The rows of one series; none if the store lacks it."""
    kind = spark.table(name).schema["id"].dataType
    return spark.table(name).where(F.col("id") == F.lit(ident).cast(kind))


def score_one(spark: SparkSession, name: str, ident: int | str, bundle) -> DataFrame:
    """``id, score`` of one series by a trained bundle."""
    from breakwater.plans import engine

    return engine.infer(read_one(spark, name, ident), bundle)
