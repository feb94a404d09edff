"""JN-1: budget resolution with fallback (month-specific -> 'default' -> NULL).

One join for every (month, category) group at once instead of one lookup per group; the
planner chooses how to join (no hints: a budgets table of any size is fine).
``category`` NULL means the overall budget; the key is compared null-safe.  A
category never falls back to the overall budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_budgets(
    groups: DataFrame,
    budgets: DataFrame,
    month_col: str = "month_key",
    category_col: str = "category",
    out_col: str = "budget",
    null_category_is_overall: bool = False,
) -> DataFrame:
    """Attach the resolved budget limit to each (month, category) row of ``groups``.

    ``null_category_is_overall=False`` (default): a NULL category inside a category
    breakdown gets no category budget.  Set True to judge it against the overall budget.
    """
    b = budgets.select(
        F.col("month_key").alias("_bm"), F.col("category").alias("_bc"), F.col("budget_limit").alias("_bl")
    )
    month_b = b.select(F.col("_bm").alias("_mm"), F.col("_bc").alias("_mc"), F.col("_bl").alias("_mb"))
    dflt_b = b.where(F.col("_bm") == "default").select(F.col("_bc").alias("_dc"), F.col("_bl").alias("_db"))
    cat = F.col(category_col)
    if null_category_is_overall:
        k_month, k_dflt = cat.eqNullSafe(F.col("_mc")), cat.eqNullSafe(F.col("_dc"))
    else:
        k_month, k_dflt = cat == F.col("_mc"), cat == F.col("_dc")
    out = groups.join(month_b, (F.col(month_col) == F.col("_mm")) & k_month, "left").join(dflt_b, k_dflt, "left")
    resolved = F.coalesce(F.col("_mb"), F.col("_db"))
    return out.withColumn(out_col, resolved).drop("_mm", "_mc", "_mb", "_dc", "_db")


def resolve_overall_budget(months: DataFrame, budgets: DataFrame, month_col: str = "month_key",
                           out_col: str = "budget") -> DataFrame:
    """Overall (category NULL) budget per month: the month's row, else the 'default' row.

    The month lookup is a hash join; the default overall limit is a single value of the
    budgets table, read once and applied with ``coalesce``."""
    overall = budgets.where(F.col("category").isNull())
    month_b = overall.where(F.col("month_key") != "default").select(
        F.col("month_key").alias("_mm"), F.col("budget_limit").alias("_mb"))
    row = overall.where(F.col("month_key") == "default").select("budget_limit").first()
    default = F.lit(row[0] if row else None).cast("double")
    out = months.join(month_b, F.col(month_col) == F.col("_mm"), "left")
    return out.withColumn(out_col, F.coalesce(F.col("_mb"), default)).drop("_mm", "_mb")


def overall_budget_for(budgets: DataFrame, month: str) -> float | None:
    """The overall limit of one month (month row, else 'default'); reads at most two rows
    of the budgets table."""
    rows = (budgets
            .where(F.col("category").isNull() & F.col("month_key").isin(month, "default"))
            .select("month_key", "budget_limit").collect())
    by = {r.month_key: r.budget_limit for r in rows}
    return by.get(month, by.get("default"))
