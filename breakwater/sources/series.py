"""Series views over long tables, their segments and scopes.

A series table is ``id, seq, value, period``: period 0 before and 1 after the split. ``pos``
counts outward from the boundary, 1 next to it, so a window of w points on either side is
``pos <= w``. Missing and NaN values are dropped first, before windows are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Windows around the boundary; ``full`` has all points.
SCOPES = {"w50": 50, "w100": 100, "w250": 250, "full": 1 << 30}


@dataclass(frozen=True)
class View:
    """A series view of a table: expressions of the id, the value, the total order and the split."""

    table: str
    id: str
    value: str
    order: tuple[str, ...]
    #: Boolean expression of a point after the split; none: the midpoint of each series.
    post: str | None = None


#: Prices are scaled by a prime near 1000, so that no statistic of them stands on a rounding tie.
SUPPLIERS = View("lineitem", "l_suppkey", "l_extendedprice / 977", ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"))
USERS = View("events", "user_id", "value", ("ts", "event_id"), "ts >= TIMESTAMP '2024-01-16 00:00:00'")
TYPES = View("events", "event_type", "value", ("ts", "event_id"), "ts >= TIMESTAMP '2024-01-16 00:00:00'")
VIEWS = {"suppliers": SUPPLIERS, "users": USERS, "types": TYPES}


def validate(df: DataFrame, id_col: str = "id", period_col: str = "period", value_col: str = "value") -> DataFrame:
    """The table itself; fails if a required column is missing or a period is neither 0 nor 1."""
    missing = {id_col, period_col, value_col} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if df.where(F.col(period_col).isNull() | ~F.col(period_col).isin(0, 1)).limit(1).count():
        raise ValueError(f"{period_col} has values other than 0 and 1")
    return df


#: Points that a task takes, so that its memory does not grow with the table.
POINTS = 150_000


def by_id(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n``, dealt by id over tasks of at most about ``POINTS`` (a series stays whole)."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // POINTS)), "id")


def scans(segs: DataFrame) -> int:
    """In how many tasks the table behind ``segs`` is read, so that what a task holds while it deals its rows does not grow with the table."""
    return -(-getattr(segs, "_points", 0) // (4 * POINTS))


def with_positions(series: DataFrame) -> DataFrame:
    """``id, seq, period, pos, value`` of a table ``id, seq, period, value``."""
    clean = series.where("value is not null and not isnan(value) and period in (0, 1)")
    near = Window.partitionBy("id", "period").orderBy(F.when(F.col("period") == 0, -F.col("seq")).otherwise(F.col("seq")))
    return clean.select("id", "seq", "period", F.row_number().over(near).cast("bigint").alias("pos"), "value")


def segments(spark: SparkSession, sf_dir: str, view: View = SUPPLIERS) -> DataFrame:
    """``id, seq, period, pos, value`` of a view. One shuffle, by id, to as many tasks as its rows call for."""
    order = Window.partitionBy("id").orderBy(*[F.col(f"o{k}") for k in range(len(view.order))])
    raw = spark.read.parquet(f"{sf_dir}/{view.table}.parquet")
    raw = raw.select(F.expr(view.id).alias("id"), F.expr(f"cast({view.value} as double)").alias("value"), *[F.expr(o).alias(f"o{k}") for k, o in enumerate(view.order)], F.expr(view.post or "false").alias("after"))
    n = raw.count()
    raw = by_id(raw.where("id is not null and value is not null and not isnan(value)"), n)
    seq = F.row_number().over(order).cast("bigint")
    whole = Window.partitionBy("id")
    numbered = raw.select("id", "value", "after", seq.alias("seq"))
    before = F.count("*").over(whole) if view.post is None else F.sum(F.when(F.col("after"), 0).otherwise(1)).over(whole)
    split = numbered.withColumn("n0", F.floor(before / 2) if view.post is None else before)
    pos = F.when(F.col("seq") <= F.col("n0"), F.col("n0") - F.col("seq") + 1).otherwise(F.col("seq") - F.col("n0"))
    made = split.select("id", "seq", F.when(F.col("seq") <= F.col("n0"), 0).otherwise(1).alias("period"), pos.cast("bigint").alias("pos"), "value")
    made._points = n
    return made


def together(table: DataFrame) -> DataFrame:
    """``id, seq, period, value`` of a table of series or of segments, each series in one task and its rows one after the other. Segments are so already; Spark leaves out their sort."""
    rows = table
    if not hasattr(table, "_points"):
        rows = table.where("value is not null and not isnan(value) and period in (0, 1)")
        n = rows.count()
        rows = by_id(rows, n)
        rows._points = n
    made = rows.select("id", "seq", F.col("period").cast("int").alias("period"), F.col("value").cast("double").alias("value")).sortWithinPartitions("id")
    made._points = rows._points
    return made


def scoped(segs: DataFrame, scopes: dict[str, int] | None = None) -> DataFrame:
    """Segments once for each scope: ``id, scope, seq, period, pos, value``; a short segment keeps all points."""
    pairs = F.array(*[F.struct(F.lit(k).alias("scope"), F.lit(w).alias("w")) for k, w in (scopes or SCOPES).items()])
    made = segs.select("*", F.explode(pairs).alias("x")).where("pos <= x.w").select("id", F.col("x.scope").alias("scope"), "seq", "period", "pos", "value")
    made._unscoped = (segs, dict(scopes or SCOPES))
    return made


def unscoped(x: DataFrame) -> tuple[DataFrame, dict[str, int] | None]:
    """The segments that ``x`` was scoped from and its scopes; ``x`` itself and none where that is not known."""
    return getattr(x, "_unscoped", (x, None))


def segments_sql(view: View = SUPPLIERS) -> str:
    """The same segments in DuckDB's SQL."""
    before = "count(*) OVER (PARTITION BY id) // 2" if view.post is None else "sum(CASE WHEN after THEN 0 ELSE 1 END) OVER (PARTITION BY id)"
    order = ", ".join(view.order)
    return f"""SELECT id, seq, CASE WHEN seq <= n0 THEN 0 ELSE 1 END AS period, CAST(CASE WHEN seq <= n0 THEN n0 - seq + 1 ELSE seq - n0 END AS BIGINT) AS pos, value
FROM (SELECT id, value, seq, {before} AS n0 FROM (SELECT {view.id} AS id, CAST({view.value} AS DOUBLE) AS value, {view.post or 'false'} AS after, row_number() OVER (PARTITION BY {view.id} ORDER BY {order}) AS seq FROM {view.table}
WHERE {view.id} IS NOT NULL AND {view.value} IS NOT NULL AND NOT isnan({view.value})))"""


def scoped_sql(view: View = SUPPLIERS) -> str:
    values = ", ".join(f"('{k}', {w})" for k, w in SCOPES.items())
    return f"SELECT id, scope, seq, period, pos, value FROM ({segments_sql(view)}) CROSS JOIN (VALUES {values}) AS x(scope, w) WHERE pos <= w"


#: Columns of a series file, as they are read from text; other columns are strings.
SCHEMA = {"id": "long", "seq": "long", "period": "int", "value": "double"}
#: What to do with lines of a text file that do not fit the schema.
BAD = ("fail", "drop", "keep")


def read_series(spark: SparkSession, path: str, schema: str | None = None, bad: str = "fail", check: bool = False, **options) -> DataFrame:
    """A table by its extension: Parquet, ORC or JSON, else CSV with a header.

    Text is read by ``schema`` (of series if the header has those columns), never by guessing from
    the data. Lines that do not fit it fail the reading, are dropped, or kept as null columns with the
    line in ``_corrupt_record``. With ``check`` the table must be one of series.
    """
    if bad not in BAD:
        raise ValueError(f"bad is one of {BAD}")
    kind = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if kind in ("parquet", "orc"):
        found = getattr(reader, kind)(path)
    else:
        if schema is None:
            head = reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
            schema = ", ".join(f"`{c}` {SCHEMA.get(c, t)}" for c, t in head.dtypes)
        if bad != "fail":
            schema += ", _corrupt_record string"
        reader = reader.schema(schema).option("mode", "FAILFAST" if bad == "fail" else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        found = reader.json(path) if kind == "json" else reader.option("header", True).option("enforceSchema", False).csv(path)
        if bad == "drop":
            # The reader must fill all columns to know which lines are bad.
            whole = F.struct(*[F.col(c) for c in found.columns])
            found = found.select(whole.alias("r")).where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")
    return validate(found) if check else found


def load_split(spark: SparkSession, data_dir: str, split: str = "train") -> tuple[DataFrame, DataFrame | None]:
    """Series and labels of a split, the series checked: ``X_<split>.parquet`` (test: the reduced one if that is missing) and ``y_<split>``.

    The label column ``structural_breakpoint`` becomes the integer ``y``; labels are optional for test.
    """
    def found(name: str) -> str | None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{name}.parquet")
        return at.toString() if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None

    names = [split] if split == "train" else [split, f"{split}.reduced"]
    x = next((p for n in names if (p := found(f"X_{n}"))), None)
    if x is None:
        raise FileNotFoundError(f"{data_dir}/X_{split}.parquet")
    y = next((p for n in names if (p := found(f"y_{n}"))), None)
    if y is None and split == "train":
        raise FileNotFoundError(f"{data_dir}/y_{split}.parquet")
    labels = spark.read.parquet(y) if y else None
    if labels is not None and "structural_breakpoint" in labels.columns:
        labels = labels.select("id", F.col("structural_breakpoint").cast("int").alias("y"))
    return validate(spark.read.parquet(x)), labels


def save_predictions(scores: DataFrame, path: str) -> None:
    """Writes ``id, prediction`` as CSV with a header."""
    scores.select("id", F.col("score").alias("prediction")).write.mode("overwrite").option("header", True).csv(path)


def first_ids(table: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` smallest ids, such as for a trial run."""
    return table.join(F.broadcast(table.select("id").distinct().orderBy("id").limit(n)), "id", "left_semi")
