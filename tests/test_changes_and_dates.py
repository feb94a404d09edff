"""Probe inputs with hand-written results: repeated changes, corrections, mail dates, read-only SQL, ids."""

import pytest
from pyspark.sql import functions as F

from spendlake.functions.timeutil import mail_date_to_iso
from spendlake.operators.mutations import recategorise
from spendlake.operators.sql import ReadOnlyViolation, query_read
from spendlake.plans.runs import apply_corrections
from spendlake.streaming.ingest import dedup_message_ids

LEDGER = ("id bigint, amount double, category string, description string, transaction_date string, "
          "deleted_at timestamp_ntz, inserted_on timestamp_ntz, updated_on timestamp_ntz")


@pytest.fixture()
def ledger(spark):
    return spark.createDataFrame(
        [(i, 10.0 * i, "Food", f"shop {i}", "2026-03-0%d" % i, None, None, None) for i in (1, 2, 3)], LEDGER)


def test_mail_dates(spark):
    cases = {
        "Mon, 23 Mar 2026 22:00:00 GMT": "2026-03-23T22:00:00+00:00",
        "Mon, 23 Mar 2026 9:05:00 +0000": "2026-03-23T09:05:00+00:00",
        "Monday, 23 Mar 26 22:00:00 +0530": "2026-03-23T22:00:00+05:30",
        "23 Mar 99 22:00 EST": "1999-03-23T22:00:00-05:00",
        "Mon, 31 Feb 2026 22:00:00 GMT": "bad",
        "23 Mar 2026 22:00:00 QQQ": "bad",
        "": "bad",
        None: "bad",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", mail_date_to_iso("d", "bad").alias("iso"))
    assert {r.d: r.iso for r in rows.collect()} == cases


def test_two_changes_of_one_id_keep_one_row(spark, ledger):
    changes = spark.createDataFrame([(1, "Bills"), (1, "Travel")], "id bigint, new_category string")
    state, audit, _ = recategorise(ledger, changes, "2026-03-23 22:00:00")
    assert [(r.id, r.category) for r in state.orderBy("id").collect()] == [(1, "Travel"), (2, "Food"), (3, "Food")]
    assert audit.count() == 1


def test_corrections_of_deleted_rows_are_rejects(spark, ledger):
    state = ledger.withColumn("deleted_at", F.when(F.col("id") == 2, F.lit("2026-03-20 10:00:00").cast("timestamp_ntz")))
    numbered = spark.range(1, 4).select(
        F.col("id").alias("number"), F.col("id").alias("seq"),
        F.struct(F.create_map(F.lit("upi"), F.lit("1")).alias("reference_ids")).alias("transaction"))
    appended = ledger.select(F.col("id").alias("seq"), "id", "description")
    corrections = [(2, "delete", None), (2, "recategorise", "Bills"), (2, "amount", "5"), (2, "confirm", None),
                   (1, "delete", None), (1, "amount", "7"), (1, "recategorise", "Bills"), (3, "merge", "2"), (3, "amount", "9")]
    new, audit, rejects = apply_corrections(state, numbered, appended, spark.createDataFrame(
        corrections, "number bigint, action string, value string"), "2026-03-23 22:00:00")
    assert sorted((r.number, r.action) for r in rejects.collect()) == [
        (1, "amount"), (1, "recategorise"), (2, "amount"), (2, "delete"), (2, "recategorise"), (3, "merge")]
    assert [(r.id, r.amount, r.deleted_at is None) for r in new.orderBy("id").collect()] == [
        (1, 10.0, False), (2, 20.0, False), (3, 9.0, True)]
    assert sorted((r.action, r.row_id) for r in audit.collect()) == [("SOFT_DELETE", 1), ("UPDATE", 3)]


def test_views_of_the_session_stay_as_they_are(spark, ledger):
    spark.range(7).createOrReplaceTempView("expenses")
    try:
        got = query_read(spark, "SELECT sum(amount) AS s FROM expenses; ", {"expenses": ledger})
        assert spark.table("expenses").count() == 7 and got.first().s == 60.0
        own = "WITH expenses AS (SELECT * FROM expenses WHERE id > 1), x AS (SELECT id FROM expenses) SELECT * FROM x ORDER BY id DESC -- end"
        assert [r.id for r in query_read(spark, own, {"expenses": ledger}).collect()] == [3, 2]
        assert "Project" in query_read(spark, "EXPLAIN FORMATTED SELECT id FROM expenses", {"expenses": ledger}).first()[0]
        assert query_read(spark, "SELECT count(*) AS n FROM expenses").first().n == 7
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("spendlake_")]
    finally:
        spark.catalog.dropTempView("expenses")


def test_corrections_amounts_audit_and_rejects(spark, ledger):
    numbered = spark.range(1, 4).select(
        F.col("id").alias("number"), F.col("id").alias("seq"),
        F.struct(F.create_map(F.lit("upi"), F.lit("1")).alias("reference_ids")).alias("transaction"))
    appended = ledger.select(F.col("id").alias("seq"), "id", "description")
    corrections = spark.createDataFrame([
        (1, "amount", "55.5"), (1, "amount", "44"), (2, "amount", "x"), (9, "delete", None), (3, "rename", "y"),
        (3, "merge", "8"), (2, "confirm", None)], "number bigint, action string, value string")
    state, audit, rejects = apply_corrections(ledger, numbered, appended, corrections, "2026-03-23 22:00:00")
    assert [(r.id, r.amount) for r in state.orderBy("id").collect()] == [(1, 55.5), (2, 20.0), (3, 30.0)]
    (entry,) = audit.collect()
    assert (entry.action, entry.row_id) == ("UPDATE", 1)
    assert '"amount":10.0' in entry.old_values and '"amount":55.5' in entry.new_values
    assert sorted((r.number, r.action) for r in rejects.collect()) == [
        (2, "amount"), (3, "merge"), (3, "rename"), (9, "delete")]


def test_read_only_sql_judges_nodes_not_words(spark, ledger):
    views = {"expenses_probe": ledger}
    for text in ("SELECT id AS Command FROM expenses_probe WHERE description <> 'Drop Command'",
                 "SELECT * FROM expenses_probe WHERE description NOT LIKE '%Execute order%'"):
        assert query_read(spark, text, views).count() == 3
    for text in ("WITH x AS (SELECT 1) INSERT INTO expenses_probe SELECT * FROM expenses_probe",
                 "EXPLAIN DROP TABLE expenses_probe", "SET a=b"):
        with pytest.raises(ReadOnlyViolation):
            query_read(spark, text, views)
    assert not spark.catalog.tableExists("expenses_probe")


def test_messages_without_an_id_all_stay(spark, tmp_path):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4), ("", 5), ("", 6)]
    df = spark.createDataFrame(rows, "message_id string, n int").withColumn(
        "received_ts", F.lit("2026-03-01 10:00:00").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = dedup_message_ids(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    kept = [r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(kept) == 5 and {3, 4, 5, 6} < set(kept)
