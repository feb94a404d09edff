"""Ledger behaviour (summaries, budget fallback, mutations, suggestions, SQL guard)."""

import pytest
from pyspark.sql import functions as F

from spendlake.operators import reports
from spendlake.operators.mutations import (
    append_expenses, bulk_edit, purge_deleted, recategorise, soft_delete, upsert_budgets,
)
from spendlake.operators.sql import ReadOnlyViolation, query_read
from spendlake.operators.suggest import suggest_categories

AS_OF = "2026-03-23"
EXP_SCHEMA = ("id bigint, amount double, category string, description string, transaction_date string, "
              "deleted_at timestamp_ntz, inserted_on timestamp_ntz, updated_on timestamp_ntz")
BUD_SCHEMA = "id bigint, month_key string, category string, budget_limit double, inserted_on timestamp_ntz, updated_on timestamp_ntz"


def expenses(spark, rows):
    df = spark.createDataFrame([(i + 1, a, c, d, t, None, None, None) for i, (a, c, d, t) in enumerate(rows)], EXP_SCHEMA)
    return df.withColumn("txn_date", F.to_date("transaction_date")).withColumn("month_key", F.substring("transaction_date", 1, 7))


def budgets(spark, rows):
    return spark.createDataFrame([(i + 1, m, c, b, None, None) for i, (m, c, b) in enumerate(rows)], BUD_SCHEMA)


@pytest.fixture
def seeded(spark):
    ex = expenses(spark, [(300.0, "Food", "Lunch", AS_OF), (500.0, "Junk", "Pizza", AS_OF), (100.0, "Transport", "Bus", AS_OF)])
    bu = budgets(spark, [("default", None, 50000.0)])
    return ex, bu


def test_monthly_summary(spark, seeded):
    ex, bu = seeded
    head, cats = reports.period_summary(ex, bu, "monthly", None, AS_OF)
    h = head.first()
    assert h.monthly_spent == 900.0 and h.budget == 50000.0 and h.savings == 49100.0
    assert h.percentage == 1.8
    assert [r.category for r in cats.collect()] == ["Junk", "Food", "Transport"]


def test_daily_vs_monthly(spark):
    ex = expenses(spark, [(300.0, "Food", "Lunch", AS_OF), (500.0, "Junk", "Pizza", AS_OF),
                          (100.0, "Transport", "Bus", AS_OF), (200.0, "Food", "Tea", "2026-03-22")])
    bu = budgets(spark, [("default", None, 50000.0)])
    h = reports.period_summary(ex, bu, "daily", None, AS_OF)[0].first()
    assert h.period_spent == 900.0 and h.monthly_spent == 1100.0
    w = reports.period_summary(ex, bu, "weekly", None, AS_OF)[0].first()
    assert w.period_spent == 900.0  # 2026-03-23 is a Monday; the 22nd is the week before


def test_soft_delete_excluded(spark, seeded):
    ex, bu = seeded
    new, audit, rej = soft_delete(ex, spark.createDataFrame([(2,), (99,)], "id bigint"), "2026-03-23 10:00:00")
    new = new.withColumn("txn_date", F.to_date("transaction_date")).withColumn("month_key", F.substring("transaction_date", 1, 7))
    h, cats = reports.period_summary(new, bu, "monthly", None, AS_OF)
    assert h.first().monthly_spent == 400.0
    assert "Junk" not in [r.category for r in cats.collect()]
    assert [r.id for r in rej.collect()] == [99]
    a = audit.first()
    assert a.action == "SOFT_DELETE" and a.row_id == 2 and '"description":"Pizza"' in a.old_values


def test_budget_fallback_chain(spark):
    month = AS_OF[:7]
    ex = expenses(spark, [(150.0, "Junk", "Chips", AS_OF), (10.0, "Food", "Tea", AS_OF)])
    bu = budgets(spark, [("default", None, 50000.0), ("default", "Junk", 3000.0), (month, None, 70000.0), (month, "Junk", 5000.0)])
    rep = {(r.level, r.category): r for r in reports.summary_report(ex, bu).collect()}
    assert rep[("month", None)].budget == 70000.0
    assert rep[("category", "Junk")].budget == 5000.0
    food = rep[("category", "Food")]
    assert food.budget is None and food.remaining is None and food.overspent is None
    bu2 = budgets(spark, [("default", None, 50000.0), ("default", "Junk", 100.0)])
    junk = {r.category: r for r in reports.summary_report(ex, bu2).collect()}["Junk"]
    assert junk.overspent is True and junk.remaining == -50.0


def test_budget_upsert_null_safe_last_wins(spark):
    bu = budgets(spark, [("default", None, 50000.0)])
    ch = spark.createDataFrame([("default", None, 60000.0, 1), ("default", None, 65000.0, 2), ("default", "Junk", 3000.0, 1)],
                               "month_key string, category string, budget_limit double, seq int")
    new, audit, _ = upsert_budgets(bu, ch, "2026-03-23 10:00:00")
    rows = {(r.month_key, r.category): r for r in new.collect()}
    assert len(rows) == 2 and rows[("default", None)].budget_limit == 65000.0 and rows[("default", None)].id == 1
    assert rows[("default", "Junk")].id == 2
    acts = audit.collect()
    assert len(acts) == 2 and any(a.old_values is None for a in acts)


def test_bulk_append_defaults_and_rejects(spark, seeded):
    ex, _ = seeded
    good = spark.createDataFrame([(0, "12.5", None, None, None), (1, "3", "Food", "Tea", "2026-03-01")],
                                 "pos int, amount string, category string, description string, date string")
    new, audit, rej = append_expenses(ex.drop("txn_date", "month_key"), good, "2026-03-23 10:00:00", ["pos"])
    added = new.where("id > 3").orderBy("id").collect()
    assert [r.id for r in added] == [4, 5]
    assert added[0].category == "Uncategorised" and added[0].description == "" and added[0].transaction_date == "2026-03-23"
    entries = sorted((a.action, a.row_id, a.new_values) for a in audit.collect())
    assert entries == [("BULK_INSERT", None, '{"count":2}'), ("BULK_INSERT_ROW", 4, None), ("BULK_INSERT_ROW", 5, None)]
    bad = spark.createDataFrame([(0, "not_a_number", None, None, None)], good.schema)
    new2, _, rej2 = append_expenses(ex.drop("txn_date", "month_key"), bad, "2026-03-23 10:00:00", ["pos"])
    assert rej2.count() == 1 and new2.count() == 3


def test_purge_recategorise_bulk_edit(spark, seeded):
    ex, _ = seeded
    base = ex.drop("txn_date", "month_key")
    deleted, _, _ = soft_delete(base, spark.createDataFrame([(1,)], "id bigint"), "2026-03-23 10:00:00")
    purged, paudit, _ = purge_deleted(deleted, "2026-03-23 11:00:00")
    assert purged.count() == 2
    assert sorted((a.action, a.row_id, a.old_values) for a in paudit.collect()) == [
        ("PURGE", None, '{"count":1}'), ("PURGE_ROW", 1, None)]
    rec, raudit, rrej = recategorise(deleted, spark.createDataFrame([(2, "Treats"), (1, "X")], "id bigint, new_category string"),
                                    "2026-03-23 11:00:00")
    assert {r.id: r.category for r in rec.collect()}[2] == "Treats"
    assert [r.id for r in rrej.collect()] == [1]
    edited, eaudit, _ = bulk_edit(base, "category = 'Food'", {"amount": "amount + 1"}, "2026-03-23 11:00:00")
    assert {r.id: r.amount for r in edited.collect()}[1] == 301.0
    assert '"rows_affected":1' in eaudit.first().new_values


def test_suggest_category(spark):
    ex = expenses(spark, [(1.0, "Junk", "Burger", AS_OF)] * 3 + [(1.0, "Food", "Burger", AS_OF), (2.0, "Junk", "Pizza", AS_OF)])
    terms = spark.createDataFrame([("Burger",), ("pizza",), ("unknownterm",), ("za",)], "term string")
    got = {r.term: r for r in suggest_categories(ex, terms).collect()}
    assert got["burger"].suggested == "Junk" and got["burger"].confidence == 3 and got["burger"].total_matches == 4
    assert got["burger"].gated_category == "Junk"
    assert got["pizza"].suggested == "Junk" and got["pizza"].gated_category == "Uncategorised"
    assert got["unknownterm"].suggested is None and got["unknownterm"].confidence == 0
    assert got["za"].total_matches == 1


def test_read_only_guard(spark, seeded):
    ex, _ = seeded
    assert query_read(spark, "SELECT count(*) AS n FROM expenses", {"expenses": ex}).first().n == 3
    with pytest.raises(ReadOnlyViolation):
        query_read(spark, "DELETE FROM expenses", {"expenses": ex})
    with pytest.raises(ReadOnlyViolation):
        query_read(spark, "WITH x AS (SELECT 1) INSERT INTO expenses SELECT * FROM expenses", {"expenses": ex})


def test_suggest_like_wildcards(spark):
    ex = expenses(spark, [(1.0, "Junk", "Burger King", AS_OF), (1.0, "Food", "Burrito bowl", AS_OF), (1.0, "Food", "Bread", AS_OF)])
    terms = spark.createDataFrame([("bur%",), ("b_rger",), ("b%",)], "term string")
    plain = {r.term: r.total_matches for r in suggest_categories(ex, terms).collect()}
    assert plain == {"bur%": 0, "b_rger": 0, "b%": 0}
    like = {r.term: r.total_matches for r in suggest_categories(ex, terms, like_wildcards=True).collect()}
    assert like == {"bur%": 2, "b_rger": 1, "b%": 3}


def test_dense_ids_distributed_and_ordered(spark):
    from spendlake.session import assign_dense_ids

    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = assign_dense_ids(df, ["k"], 100).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(101, 5101))  # dense, above the high-water mark, unused
    assert all(r.id == 101 + r.k for r in out)  # in key order


def test_audit_rows_equal_changes(spark, seeded):
    ex, _ = seeded
    base = ex.drop("txn_date", "month_key")
    ids = spark.createDataFrame([(1,), (3,), (3,), (42,)], "id bigint")
    new, audit, rej = soft_delete(base, ids, "2026-03-23 10:00:00")
    changed = new.where("deleted_at IS NOT NULL").count()
    assert audit.count() == changed == 2 and rej.count() == 1
    assert new.count() == base.count()


def test_null_category_budget_flag(spark):
    ex = expenses(spark, [(10.0, None, "x", AS_OF)])
    bu = budgets(spark, [("default", None, 50000.0)])
    intent = {r.level: r for r in reports.summary_report(ex, bu).collect()}
    assert intent["category"].budget is None
    compat = {r.level: r for r in reports.summary_report(ex, bu, null_category_is_overall=True).collect()}
    assert compat["category"].budget == 50000.0


def test_suggest_with_precomputed_gram_stats(spark):
    from spendlake.operators.suggest import gram_stats

    ex = expenses(spark, [(1.0, "Junk", "Burger", AS_OF)] * 3 + [(1.0, "Food", "Burger", AS_OF), (2.0, "Junk", "Pizza", AS_OF)])
    terms = spark.createDataFrame([("Burger",), ("pizza",), ("unknownterm",), ("za",)], "term string")
    a = sorted(tuple(r) for r in suggest_categories(ex, terms).collect())
    b = sorted(tuple(r) for r in suggest_categories(ex, terms, stats=gram_stats(ex)).collect())
    assert a == b


def test_read_only_guard_explain_and_commands(spark, seeded):
    ex, _ = seeded
    plan = query_read(spark, "EXPLAIN SELECT category FROM expenses", {"expenses": ex}).first()[0]
    assert "Scan" in plan or "LocalTableScan" in plan or "Project" in plan
    for bad in ("SET spark.sql.shuffle.partitions=3", "CREATE TABLE t AS SELECT 1", "EXPLAIN DROP TABLE expenses"):
        with pytest.raises(ReadOnlyViolation):
            query_read(spark, bad, {"expenses": ex})
    assert spark.conf.get("spark.sql.shuffle.partitions") != "3"


def test_single_add_audits_full_row(spark, seeded):
    ex, _ = seeded
    one = spark.createDataFrame([(0, "42.5", "Food", "Tea", None)],
                                "pos int, amount string, category string, description string, date string")
    new, audit, _ = append_expenses(ex.drop("txn_date", "month_key"), one, "2026-03-23 10:00:00", ["pos"], bulk=False)
    a = audit.first()
    assert a.action == "INSERT" and a.row_id == 4
    assert '"amount":42.5' in a.new_values and '"transaction_date":"2026-03-23"' in a.new_values
    assert '"deleted_at":null' in a.new_values and '"inserted_on":"2026-03-23 10:00:00"' in a.new_values


def test_zero_budget_alert_has_no_division_error(spark):
    ex = expenses(spark, [(10.0, "Junk", "x", AS_OF)])
    bu = budgets(spark, [("default", None, 50000.0), ("default", "Junk", 0.0)])
    alerts = {r.alert: r for r in reports.budget_alerts(reports.summary_report(ex, bu)).collect()}
    assert alerts["category_overspent"].percentage is None
    head = reports.period_summary(ex, budgets(spark, [("default", None, 0.0)]), "monthly", None, AS_OF)[0].first()
    assert head.savings is None and head.percentage == 0.0
