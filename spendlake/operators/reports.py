"""Aggregations over the ledger: period totals, category breakdown, the full summary
report, running month stats, category list and budget alerts (AGG-1..5, AGG-11, SRT-1).

Shape of every plan: scan (pruned by month where a month is given) -> partial hash
aggregate per task -> one shuffle on the (month, category) key -> final aggregate ->
broadcast joins to the small budgets table.  Group counts are months x categories, so
everything after the first aggregate is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.config import MONTHLY_ALERT_PCT
from spendlake.operators.budgets import overall_budget_for, resolve_budgets, resolve_overall_budget
from spendlake.operators.filters import (
    active,
    budget_projection,
    resolve_month,
    savings_projection,
    week_bounds,
)


# ---------------------------------------------------------------------------
# AGG-3: full summary report for all months in one job
# ---------------------------------------------------------------------------

def month_category_spend(expenses: DataFrame) -> DataFrame:
    """Spend per (month, category) over active rows."""
    return active(expenses).groupBy("month_key", "category").agg(F.sum("amount").alias("spent"))


def summary_report(expenses: DataFrame, budgets: DataFrame, null_category_is_overall: bool = False) -> DataFrame:
    """One row per month (level='month', category NULL) and per (month, category)
    (level='category'), with resolved budgets and derived columns.

    Month rows: spent, budget (overall), savings, percentage.
    Category rows: spent, budget (category), remaining, overspent, and ``rank`` by
    spend descending within the month (ties by category).
    """
    mc = month_category_spend(expenses)
    cat = resolve_budgets(mc, budgets, null_category_is_overall=null_category_is_overall)
    cat = budget_projection(cat).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("month_key").orderBy(F.desc("spent"), F.asc_nulls_first("category"))),
    )
    mon = mc.groupBy("month_key").agg(F.sum("spent").alias("spent"))
    mon = savings_projection(resolve_overall_budget(mon, budgets))
    cat_rows = cat.select(
        "month_key",
        F.lit("category").alias("level"),
        "category",
        F.round("spent", 2).alias("spent"),
        F.col("budget"),
        F.round("remaining", 2).alias("remaining"),
        F.col("overspent"),
        F.lit(None).cast("double").alias("savings"),
        F.lit(None).cast("double").alias("percentage"),
        F.col("rank").cast("int").alias("rank"),
    )
    mon_rows = mon.select(
        "month_key",
        F.lit("month").alias("level"),
        F.lit(None).cast("string").alias("category"),
        F.round("spent", 2).alias("spent"),
        F.col("budget"),
        F.lit(None).cast("double").alias("remaining"),
        F.lit(None).cast("boolean").alias("overspent"),
        F.round("savings", 2).alias("savings"),
        F.col("percentage"),
        F.lit(None).cast("int").alias("rank"),
    )
    return mon_rows.unionByName(cat_rows)


# ---------------------------------------------------------------------------
# AGG-1 / AGG-2: the period summary for one as-of date
# ---------------------------------------------------------------------------

def period_summary(expenses: DataFrame, budgets: DataFrame, period: str, month_arg: str | None,
                   as_of: str) -> tuple[DataFrame, DataFrame]:
    """AGG-1 + AGG-2 for one as-of date (the surveyed ``summarize``).

    Returns (one-row header, category breakdown).  One scan computes the month,
    day and week totals with conditional sums; the scan is pruned to the months that
    the month and the as-of week touch.
    """
    month = resolve_month(month_arg, as_of)
    day = month_arg if (month_arg and len(month_arg) == 10) else as_of[:10]
    wstart, wend = week_bounds(as_of)
    months = sorted({month, wstart[:7], wend[:7], day[:7]})
    rows = active(expenses).where(F.col("month_key").isin(months))
    in_month = F.col("month_key") == month
    in_day = F.col("txn_date") == F.lit(day).cast("date")
    in_week = F.col("txn_date").between(F.lit(wstart).cast("date"), F.lit(wend).cast("date"))
    totals = rows.agg(
        F.coalesce(F.sum(F.when(in_month, F.col("amount"))), F.lit(0.0)).alias("monthly_spent"),
        F.coalesce(F.sum(F.when(in_day, F.col("amount"))), F.lit(0.0)).alias("daily_spent"),
        F.coalesce(F.sum(F.when(in_week, F.col("amount"))), F.lit(0.0)).alias("weekly_spent"),
    )
    period_col = {"daily": "daily_spent", "weekly": "weekly_spent"}.get(period, "monthly_spent")
    header = totals.withColumn("month_key", F.lit(month)).withColumn(
        "budget", F.lit(overall_budget_for(budgets, month)).cast("double"))
    header = savings_projection(header, spent="monthly_spent").select(
        F.lit(period).alias("period"),
        F.round(F.col(period_col), 2).alias("period_spent"),
        F.col("month_key").alias("month"),
        F.round("monthly_spent", 2).alias("monthly_spent"),
        "budget",
        F.round("savings", 2).alias("savings"),
        "percentage",
    )
    cats = rows.where(in_month).groupBy("month_key", "category").agg(F.sum("amount").alias("spent"))
    cats = budget_projection(resolve_budgets(cats, budgets)).orderBy(F.desc("spent"), F.asc_nulls_first("category"))
    # Money sums are reported in cents: a distributed sum's last bits depend on the order.
    cats = cats.withColumn("spent", F.round("spent", 2)).withColumn("remaining", F.round("remaining", 2))
    return header, cats.drop("month_key")


def period_totals(expenses: DataFrame) -> DataFrame:
    """AGG-1 for every day of the ledger: daily, ISO-week and month totals of that day.

    Daily totals are aggregated first (one row per day), so the week/month windows
    run over a table of #days rows.
    """
    daily = active(expenses).groupBy("txn_date").agg(F.sum("amount").alias("daily_spent"))
    daily = daily.withColumn("week_start", F.to_date(F.date_trunc("week", F.col("txn_date")))).withColumn(
        "month_key", F.date_format("txn_date", "yyyy-MM")
    )
    return daily.select(
        "txn_date",
        F.round("daily_spent", 2).alias("daily_spent"),
        "week_start",
        F.round(F.sum("daily_spent").over(Window.partitionBy("week_start")), 2).alias("weekly_spent"),
        "month_key",
        F.round(F.sum("daily_spent").over(Window.partitionBy("month_key")), 2).alias("monthly_spent"),
    )


def category_breakdown(expenses: DataFrame) -> DataFrame:
    """AGG-2 + SRT-1 for all months: spend per (month, category), rank by spend desc."""
    mc = month_category_spend(expenses)
    w = Window.partitionBy("month_key").orderBy(F.desc("spent"), F.asc_nulls_first("category"))
    return mc.select(
        "month_key", "category", F.round("spent", 2).alias("spent"), F.row_number().over(w).alias("rank")
    )


# ---------------------------------------------------------------------------
# AGG-4, AGG-5, AGG-11
# ---------------------------------------------------------------------------

def monthly_stats(expenses: DataFrame, budgets: DataFrame, months: DataFrame) -> DataFrame:
    """AGG-4: spent, limit (0 when none) and percentage for the months in ``months``."""
    m = months.select("month_key").distinct()
    spend = active(expenses).join(m, "month_key", "left_semi").groupBy("month_key").agg(
        F.sum("amount").alias("spent")
    )
    out = m.join(spend, "month_key", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    out = resolve_overall_budget(out, budgets, out_col="limit").withColumn("limit", F.coalesce("limit", F.lit(0.0)))
    return out.select(
        "month_key",
        F.round("spent", 2).alias("spent"),
        "limit",
        F.when(F.col("limit") > 0, F.round(F.col("spent") / F.col("limit") * 100, 2)).otherwise(F.lit(0.0)).alias(
            "percentage"
        ),
    )


def list_categories(expenses: DataFrame) -> DataFrame:
    """AGG-5: distinct categories of active rows, sorted."""
    return active(expenses).select("category").distinct().orderBy(F.asc_nulls_first("category"))


def budget_alerts(report: DataFrame, threshold_pct: float = MONTHLY_ALERT_PCT) -> DataFrame:
    """AGG-11: overall usage at or above the threshold, and overspent categories."""
    monthly = report.where((F.col("level") == "month") & (F.col("percentage") >= threshold_pct)).select(
        "month_key", F.lit("monthly_threshold").alias("alert"), "category", "spent", "budget", "percentage"
    )
    cats = report.where((F.col("level") == "category") & F.col("overspent")).select(
        "month_key",
        F.lit("category_overspent").alias("alert"),
        "category",
        "spent",
        "budget",
        # A zero budget with any spend is overspent; its percentage is undefined (NULL).
        F.when(F.col("budget") != 0, F.round(F.col("spent") / F.col("budget") * 100, 2)).alias("percentage"),
    )
    return monthly.unionByName(cats)
