"""One entry per group or set, whatever its size; no bound on search rounds or wildcard terms."""

from pyspark.sql import functions as F

from spendlake.operators.mutations import append_expenses
from spendlake.operators.suggest import rollup_by_category, rollup_items, term_matches


def test_rollup_of_a_large_group_is_one_entry(spark):
    items = spark.range(1500).select(F.lit(1).alias("batch"), F.lit("Food").alias("category"), F.lit(2.0).alias("amount"),
                                     F.lit("tea").alias("description"))
    assert [tuple(r) for r in rollup_by_category(items).collect()] == [(1, "Food", 3000.0, 1500)]
    assert rollup_items(items).count() == 1500


def test_one_audit_entry_for_a_large_set(spark):
    state = spark.createDataFrame([], "id bigint, amount double, category string, description string, transaction_date string, "
                                      "deleted_at timestamp_ntz, inserted_on timestamp_ntz, updated_on timestamp_ntz")
    rows = spark.range(20_001).select("id", F.lit("1").alias("amount"), *[
        F.lit(None).cast("string").alias(c) for c in ("category", "description", "date")])
    _, audit, _ = append_expenses(state, rows, "2026-03-23 10:00:00", ["id"])
    counts = {r.action: r["count"] for r in audit.groupBy("action").count().collect()}
    assert counts == {"BULK_INSERT": 1, "BULK_INSERT_ROW": 20_001}
    assert audit.where("action = 'BULK_INSERT'").first().new_values == '{"count":20001}'


def test_wildcard_terms_match_like(spark):
    texts = ["tea", "te", "t", "", "a t b", "xt1y", "green tea"]
    ex = spark.createDataFrame([(i, "c", t, None) for i, t in enumerate(texts)],
                               "id bigint, category string, description string, deleted_at timestamp_ntz")
    terms = ["%", "__", "t_", "t%b", "tea_", "_tea", "e%t_a"]
    got = {(r.term, r.id) for r in term_matches(
        ex, spark.createDataFrame([(t,) for t in terms], "term string"), like_wildcards=True).collect()}
    want = {(t, r.id) for t in terms for r in ex.where(F.col("description").like(f"%{t}%")).collect()}
    assert got == want


def test_a_payload_is_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def amount(i):
        seen.add(1)
        return str(i)

    state = spark.createDataFrame([], "id bigint, amount double, category string, description string, transaction_date string, "
                                      "deleted_at timestamp_ntz, inserted_on timestamp_ntz, updated_on timestamp_ntz")
    rows = spark.range(0, 300, 1, 3).select("id", amount("id").alias("amount"), *[F.lit(None).alias(c) for c in ("category", "description", "date")])
    new, _, rejects = append_expenses(state, rows, "2026-03-23 10:00:00", ["id"])
    assert [(r.id, r.amount) for r in new.orderBy("id").collect()] == [(i + 1, float(i)) for i in range(300)]
    assert seen.value == 300
    assert rejects.count() == 0
