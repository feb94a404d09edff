"""Sources and sinks: message archives, incremental scans, checkpoints, ledger writes,
CSV export (SRC-2..6, SNK-1..4).

Writes are atomic at the folder level: a job writes a fresh folder under the target and
the caller publishes it (or dynamic partition overwrite replaces only the touched
partitions), so a failed or retried job never leaves a half-written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_SCHEMA = T.StructType([
    T.StructField("email_uid", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("processed_at", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("ledger_ids", T.ArrayType(T.LongType())),
    T.StructField("reference_ids", T.MapType(T.StringType(), T.StringType())),
])


# ---------------------------------------------------------------------------
# SRC-4 / SRC-5 / JN-8
# ---------------------------------------------------------------------------

def messages_in_range(messages: DataFrame, from_date: str, to_date: str, col: str = "received_at") -> DataFrame:
    """SRC-4: messages whose local date lies in [from_date, to_date], both inclusive."""
    d = F.try_to_date(F.substring(F.col(col), 1, 10), "yyyy-MM-dd")  # malformed stamps drop out
    return messages.where((d >= F.lit(from_date).cast("date")) & (d < F.date_add(F.lit(to_date).cast("date"), 1)))


def unprocessed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """SRC-5 / JN-8: drop messages whose Message-ID was already processed.

    Rows without an id are never skipped (NULL never matches in the anti join)."""
    done = processed.select(F.nullif(F.col("message_id"), F.lit("")).alias("_mid")).where(F.col("_mid").isNotNull())
    keyed = messages.withColumn("_mid", F.nullif(F.col("message_id"), F.lit("")))
    return keyed.join(done, "_mid", "left_anti").drop("_mid")


# ---------------------------------------------------------------------------
# SRC-6: tolerant checkpoint scan
# ---------------------------------------------------------------------------

def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: JSON-lines checkpoint; corrupt lines are dropped, a missing folder reads as empty."""
    from pyspark.errors import AnalysisException

    schema = T.StructType(CHECKPOINT_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    try:
        df = (
            spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
        return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHECKPOINT_SCHEMA)


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------

def export_csv(tables: dict[str, DataFrame], out_dir: str) -> list[str]:
    """SNK-1: header CSV per table (soft-deleted rows included); empty tables are skipped.

    NULL and '' both print as an empty field."""
    written = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        target = f"{out_dir.rstrip('/')}/{name}"
        (df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "")
         .csv(target))
        written.append(target)
    return written


def write_ledger(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-2: ledger rows partitioned by month_key (month predicates prune partitions).

    ``mode='overwrite'`` with dynamic partition overwrite replaces only the months the
    batch touches (used by the mutation writers)."""
    out = df if "month_key" in df.columns else df.withColumn("month_key", F.substring("transaction_date", 1, 7))
    w = out.write.mode(mode).partitionBy("month_key")
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """SNK-3: one JSON line per processed candidate, appended per run."""
    cols = [f.name for f in CHECKPOINT_SCHEMA.fields]
    out = rows.withColumn("processed_at", F.col("processed_at").cast("string")).select(*cols)
    out.write.mode("append").json(path)


def write_run_output(candidates: DataFrame, summary: DataFrame, path: str, run_id: str) -> None:
    """SNK-4: the last run's candidates and summary, replacing that run's partition only."""
    for name, df in (("candidates", candidates), ("summary", summary)):
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path.rstrip('/')}/{name}"))


# ---------------------------------------------------------------------------
# Publishing mutation results (MUT-* -> SNK-2) and the audit log sink (MUT-7)
# ---------------------------------------------------------------------------

def publish_ledger(new_state: DataFrame, path: str, changed_ids: DataFrame) -> list:
    """Write a mutation's new state back to a month-partitioned ledger, replacing only the
    months that hold changed rows now or held them before (dynamic partition overwrite);
    a month that has no row left is deleted.  A row without a month is in the NULL partition.

    Returns the touched month keys."""
    from pyspark.errors import AnalysisException

    spark = new_state.sparkSession
    state = new_state if "month_key" in new_state.columns else new_state.withColumn(
        "month_key", F.substring("transaction_date", 1, 7))
    ids = changed_ids.select("id").distinct()
    months = state.join(ids, "id", "left_semi").select("month_key")
    try:
        before = spark.read.schema("id bigint, month_key string").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        months = months.unionByName(before.join(ids, "id", "left_semi").select("month_key"))
    touched = [r.month_key for r in months.distinct().collect()]  # bounded by the number of months
    if not touched:
        return touched
    named = [m for m in touched if m is not None]
    at = F.col("month_key").isin(named) if named else F.lit(False)
    rows = state.where(at | F.col("month_key").isNull() if None in touched else at)
    left = {r.month_key for r in rows.select("month_key").distinct().collect()}
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_key").parquet(path))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for month in touched:
        if month not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if month is None else month
            fs.delete(fs_path(f"{path.rstrip('/')}/month_key={name}"), True)
    return touched


def append_audit(audit_rows: DataFrame, path: str) -> None:
    """MUT-7 sink: append audit rows with ids above every id issued so far (ids are never
    reused), in (created_on, action, row_id) order."""
    from pyspark.errors import AnalysisException

    from spendlake.session import assign_dense_ids

    spark = audit_rows.sparkSession
    try:
        high = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    except AnalysisException as missing:  # the first entries
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        high = 0
    order = ["created_on", "action", "table_name", "row_id", "old_values", "new_values"]
    with_ids = assign_dense_ids(audit_rows, order, high)
    with_ids.select("id", *[c for c in audit_rows.columns]).write.mode("append").parquet(path)


def publish_mutation(new_state: DataFrame, audit_rows: DataFrame, changed_ids: DataFrame, ledger_path: str,
                     audit_path: str) -> list:
    """Publish one mutation: the new state and its audit rows are first materialised
    (reliable checkpoints: they are usually derived from the very files about to be
    replaced), then the audit rows are appended and the touched months replaced.

    Without a transactional table format the two writes are not atomic together; the
    audit goes first, so a change is never published without its audit rows."""
    from spendlake.session import cut_lineage

    state = cut_lineage(new_state)
    audit = cut_lineage(audit_rows)
    changed = cut_lineage(changed_ids.select("id").distinct())
    append_audit(audit, audit_path)
    return publish_ledger(state, ledger_path, changed)
