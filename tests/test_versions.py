"""Versioned tables: ledger and audit change together, conflicts, observed counts, vacuum."""

import pytest
from pyspark.sql import functions as F

from spendlake.operators.mutations import EXPENSE_COLS, bulk_edit, purge_deleted, recategorise, soft_delete
from spendlake.session import scratch_path
from spendlake.sources import versions as V

NOW = "2026-03-23 22:00:00"


@pytest.fixture()
def store(spark):
    st = V.VersionedTables(spark, scratch_path(spark, "versions"))
    rows = spark.createDataFrame([(i, 10.0 * i, "Food", f"shop {i}", d, None, None, None) for i, d in
                                  [(1, "2026-01-05"), (2, "2026-01-06"), (3, "2026-02-05"), (4, None)]], V.EXPENSES)
    empty = spark.createDataFrame([], V.AUDIT).drop("id")
    V.publish_change(st, rows, empty, rows.select("id"))
    return st


def ledger(store, at=None):
    return sorted((r.id, r.amount, r.category, r.deleted_at is None) for r in V.read_expenses(store, at=at).collect())


def audit(store):
    return [(r.id, r.action, r.row_id) for r in store.read("audit", V.AUDIT).orderBy("id").collect()]


def test_changes_rewrite_touched_months_only_and_keep_old_versions(spark, store):
    before = store.version()
    state = V.read_expenses(store)
    new, log, _ = recategorise(state, spark.createDataFrame([(3, "Bills")], "id bigint, new_category string"), NOW)
    after = V.publish_change(store, new, log, spark.createDataFrame([(3,)], "id bigint"))
    assert ledger(store)[2] == (3, 30.0, "Bills", True) and ledger(store, before)[2] == (3, 30.0, "Food", True)
    old, now = before.tables["expenses"], after.tables["expenses"]
    assert [m for m in now if now[m] != old.get(m)] == ["2026-02"] and set(now) == {"2026-01", "2026-02", "none"}
    new, log, _ = soft_delete(V.read_expenses(store), spark.createDataFrame([(3,), (4,)], "id bigint"), NOW)
    V.publish_change(store, new, log, spark.createDataFrame([(3,), (4,)], "id bigint"))
    new, log, _ = purge_deleted(V.read_expenses(store), NOW)
    last = V.publish_change(store, new, log, spark.createDataFrame([(3,), (4,)], "id bigint"))
    assert [r[0] for r in ledger(store)] == [1, 2] and set(last.tables["expenses"]) == {"2026-01"}
    assert [(i, a) for i, a, _ in audit(store)] == [(1, "UPDATE"), (2, "SOFT_DELETE"), (3, "SOFT_DELETE"), (4, "PURGE"),
                                                     (5, "PURGE_ROW"), (6, "PURGE_ROW")]
    assert V.read_expenses(store, ["2026-01"]).count() == 2


def test_failure_between_the_two_writes_leaves_the_old_version(spark, store, monkeypatch):
    state, log_before = ledger(store), audit(store)
    new, log, _ = soft_delete(V.read_expenses(store), spark.createDataFrame([(1,)], "id bigint"), NOW)

    def fails(*args):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(V, "audited", fails)
        with pytest.raises(OSError):
            V.publish_change(store, new, log, spark.createDataFrame([(1,)], "id bigint"))
    assert ledger(store) == state and audit(store) == log_before and store.numbers() == [0]
    V.publish_change(store, new, log, spark.createDataFrame([(1,)], "id bigint"))
    assert ledger(store)[0][3] is False and len(audit(store)) == 1


def test_second_writer_of_a_version_gets_a_conflict(spark, store):
    base = store.version()
    new, log, _ = soft_delete(V.read_expenses(store), spark.createDataFrame([(1,)], "id bigint"), NOW)
    V.publish_change(store, new, log, spark.createDataFrame([(1,)], "id bigint"), base)
    with pytest.raises(V.CommitConflict):
        V.publish_change(store, new, log, spark.createDataFrame([(1,)], "id bigint"), base)
    assert store.numbers() == [0, 1] and len(audit(store)) == 1


@pytest.mark.parametrize("delete", [False, True])
def test_bulk_edit_counts_are_observed_in_the_write(spark, store, delete):
    where, sets = "amount >= 20", {"category": "'Big'"}
    expected, entry, _ = bulk_edit(V.read_expenses(store), where, sets, NOW, delete)
    expected = sorted(tuple(r) for r in expected.select("id", "category").collect())
    version = V.publish_bulk_edit(store, where, sets, NOW, delete)
    assert version.info["rows_affected"] == 3
    assert sorted(tuple(r) for r in V.read_expenses(store).select("id", "category").collect()) == expected
    (row,) = store.read("audit", V.AUDIT).collect()
    assert row.new_values == entry.first().new_values
    V.publish_bulk_edit(store, "true", None, NOW, True)
    assert V.read_expenses(store).count() == 0 and V.read_expenses(store).columns == list(EXPENSE_COLS)


def test_vacuum_keeps_what_is_listed(spark, store):
    for k in range(3):
        V.publish_bulk_edit(store, "id = 1", {"amount": f"{k}"}, NOW)
    stray, _ = store.write("expenses", V.read_expenses(store))
    rows = ledger(store)
    assert store.vacuum(keep=2) >= 2 and not store.holds(stray)
    assert ledger(store) == rows and store.numbers() == [2, 3]
    assert store.read("audit", V.AUDIT).agg(F.max("id")).first()[0] == 3


def test_a_month_is_one_file_and_audit_rows_are_derived_once(spark):
    st = V.VersionedTables(spark, scratch_path(spark, "versions"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return str(i)

    rows = spark.range(0, 160, 1, 8).select("id", *[
        F.lit("2026-01-05").cast(t).alias(n) if n == "transaction_date" else F.lit(None).cast(t).alias(n)
        for n, t in (x.split() for x in V.EXPENSES.split(", ")) if n != "id"])
    log = rows.select(F.lit("INSERT").alias("action"), F.lit("expenses").alias("table_name"), F.col("id").alias("row_id"),
                      F.lit(None).cast("string").alias("old_values"), text("id").alias("new_values"), F.lit("t").alias("source"),
                      F.lit(NOW).cast("timestamp_ntz").alias("created_on"))
    V.publish_change(st, rows, log, rows.select("id"))
    assert V.read_expenses(st).select(F.input_file_name()).distinct().count() == 1
    assert sorted((r.id, int(r.new_values)) for r in st.read("audit", V.AUDIT).collect()) == [(i + 1, i) for i in range(160)]
    assert seen.value == 160
