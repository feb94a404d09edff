"""Session helpers: local sessions for tests/bench, checkpoint folder, lineage cuts and
distributed dense ids."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types of columns that Parquet holds unchanged.
HELD = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlake") -> SparkSession:
    """A local session for tests and the bench (the cluster passes its own session)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SPENDLAKE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder in that setting; we only pick our own when it is
    unset (local tests), never overriding what the cluster configured.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) sessions: the server's configured folder is used
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="spendlake-ckpt-")  # local mode (tests) only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into the shared scratch folder and read back: computed once, and later
    passes read only the columns they need.  Types and repeated names that Parquet does not hold are checkpointed."""
    if _unheld(df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        return cut_lineage(df)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unheld(kind) -> bool:
    if isinstance(kind, T.StructType):
        return not kind.fields or any(_unheld(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _unheld(kind.elementType)
    if isinstance(kind, T.MapType):
        return _unheld(kind.keyType) or _unheld(kind.valueType)
    return not isinstance(kind, HELD)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for written intermediate tables, placed under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/spendlake-{name}-{uuid.uuid4().hex[:12]}"


def assign_dense_ids(df: DataFrame, order_cols: list, start: Column | int, id_col: str = "id") -> DataFrame:
    """Dense ids ``start + 1 .. start + n`` in ``order_cols`` order, without a
    single-partition window.

    A range-partitioned sort places rows in order across partitions; each row then
    takes ``offset(partition) + position``, where the per-partition offsets come from
    a small aggregate (one row per partition).  The sorted rows are written so
    both passes see the same partitioning; the aggregate reads their marks alone.
    """
    sorted_df = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    tagged = written(sorted_df.withColumn("_mid", F.monotonically_increasing_id()), "ids")
    part = F.shiftright(F.col("_mid"), 33)
    offsets = (
        tagged.groupBy(part.alias("_pid"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_pid", F.coalesce(F.col("_off"), F.lit(0)).alias("_off"))
    )
    start_col = start if isinstance(start, Column) else F.lit(int(start))
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    out = tagged.join(F.broadcast(offsets), part == F.col("_pid")).withColumn(
        id_col, (start_col + F.col("_off") + within + F.lit(1)).cast("bigint")
    )
    return out.drop("_mid", "_pid", "_off")
