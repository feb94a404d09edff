"""Predicates and projections over ledger and message rows (FLT-*, PRJ-*)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.config import DEFAULT_CATEGORY


def active(expenses: DataFrame) -> DataFrame:
    """SRC-1: active rows are those not soft-deleted."""
    return expenses.where(F.col("deleted_at").isNull())


def resolve_month(month_arg: str | None, as_of: str) -> str:
    """FLT-4: 7 chars -> that month; 10 chars -> its month; anything else -> as_of's month."""
    if month_arg and len(month_arg) == 7:
        return month_arg
    if month_arg and len(month_arg) == 10:
        return month_arg[:7]
    return as_of[:7]


def resolve_month_col(arg: Column, as_of: Column) -> Column:
    """FLT-4 as a column expression."""
    return (
        F.when(F.length(arg) == 7, arg)
        .when(F.length(arg) == 10, F.substring(arg, 1, 7))
        .otherwise(F.substring(F.date_format(as_of, "yyyy-MM-dd"), 1, 7))
    )


def month_pred(month: str) -> Column:
    """FLT-1: month predicate on the partition column (pruned when the table is partitioned)."""
    return F.col("month_key") == F.lit(month)


def day_pred(month_arg: str | None, as_of: str) -> Column:
    """FLT-2: a 10-character argument selects that day, otherwise as_of."""
    day = month_arg if (month_arg and len(month_arg) == 10) else as_of
    return F.col("txn_date") == F.lit(day).cast("date")


def week_bounds(as_of: str) -> tuple[str, str]:
    d = _dt.date.fromisoformat(as_of[:10])
    start = d - _dt.timedelta(days=d.weekday())
    return str(start), str(start + _dt.timedelta(days=6))


def week_pred(as_of: str) -> Column:
    """FLT-3: Monday..Sunday of as_of (the month argument is ignored, as surveyed)."""
    start, end = week_bounds(as_of)
    return F.col("txn_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def sender_match(sender_col: Column, allowed: tuple) -> Column:
    """FLT-5: case-insensitive substring containment against the allow-list."""
    s = F.lower(F.coalesce(sender_col, F.lit("")))
    arr = F.array(*[F.lit(a.lower()) for a in allowed])
    return F.exists(arr, lambda a: s.contains(a))


def split_by_sender(messages: DataFrame, allowed: tuple) -> tuple[DataFrame, DataFrame]:
    """FLT-5: (matching, non-matching) by sender allow-list."""
    m = sender_match(F.col("sender_email"), allowed)
    return messages.where(m), messages.where(~m)


def insertable(candidates: DataFrame) -> DataFrame:
    """FLT-6: status new, a transaction present and a non-zero amount."""
    return candidates.where(
        (F.col("dedup_status") == "new")
        & F.col("transaction").isNotNull()
        & (F.coalesce(F.col("transaction.amount"), F.lit(0.0)) != 0)
    )


def ledger_lookback(ledger: DataFrame, since_date: Column | str) -> DataFrame:
    """FLT-7: active ledger rows with transaction date on/after ``since_date``."""
    since = F.lit(since_date).cast("date") if isinstance(since_date, str) else since_date
    # try_: a malformed date text (user payloads) is excluded instead of failing the job.
    return active(ledger).where(F.try_to_date(F.substring(F.col("transaction_date"), 1, 10), "yyyy-MM-dd") >= since)


def checkpoint_keep(as_of_ts: str, days: int) -> Column:
    """FLT-8: whether a checkpoint row was processed within ``days`` of as_of; unparseable stamps count as oldest."""
    stamp = F.col("processed_at").cast("string").try_cast("timestamp_ntz")
    cutoff = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.coalesce(stamp >= cutoff, F.lit(False))


def prune_checkpoint(processed: DataFrame, as_of_ts: str, days: int) -> tuple[DataFrame, DataFrame]:
    """FLT-8: (kept, removed) rows of a checkpoint."""
    keep = checkpoint_keep(as_of_ts, days)
    return processed.where(keep), processed.where(~keep)


def ledger_payload(candidates: DataFrame, as_of: str, category_col: str = "category") -> DataFrame:
    """PRJ-1: ledger payload from parsed candidates.

    description: 'merchant - desc' when both are non-empty, else whichever is; date
    defaults to as_of; category from ``category_col`` or the default.
    """
    merchant = F.coalesce(F.col("transaction.merchant"), F.lit(""))
    desc = F.coalesce(F.col("transaction.description"), F.lit(""))
    both = (merchant != "") & (desc != "")
    description = F.when(both, F.trim(F.concat(merchant, F.lit(" - "), desc))).otherwise(
        F.when(merchant != "", merchant).otherwise(desc)
    )
    cat = F.col(category_col) if category_col in candidates.columns else F.lit(DEFAULT_CATEGORY)
    return candidates.select(
        "*",
        F.col("transaction.amount").alias("amount"),
        F.coalesce(cat, F.lit(DEFAULT_CATEGORY)).alias("payload_category"),
        description.alias("payload_description"),
        F.coalesce(F.col("transaction.transaction_date"), F.lit(as_of)).alias("payload_date"),
    )


def budget_projection(df: DataFrame, spent: str = "spent", budget: str = "budget") -> DataFrame:
    """PRJ-2: remaining and overspent; both NULL when there is no budget."""
    return df.withColumn("remaining", F.col(budget) - F.col(spent)).withColumn(
        "overspent", F.col(spent) > F.col(budget)
    )


def savings_projection(df: DataFrame, spent: str = "spent", budget: str = "budget") -> DataFrame:
    """PRJ-3: savings NULL when the budget is NULL or 0; percentage 0 without a positive budget.

    Percentages are rounded HALF_UP to 2 places."""
    b = F.col(budget)
    return df.withColumn(
        "savings", F.when(b.isNotNull() & (b != 0), b - F.col(spent))
    ).withColumn(
        "percentage", F.when(b > 0, F.round(F.col(spent) / b * 100, 2)).otherwise(F.lit(0.0))
    )
