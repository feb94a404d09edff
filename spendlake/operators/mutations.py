"""Audited set-based changes to the ledger (MUT-1..MUT-7, WIN-2).

Every operator takes the current table state and a change batch (DataFrames) and
returns ``(new_state, audit, rejects)``; nothing is updated in place.  Writers then
publish the new state (``sources.sinks``): rewrite the touched month partitions, or
append to a change log folded by ``latest_state``.

Audit rows: action, table_name, row_id, old_values, new_values (JSON text), source,
created_on.  Row snapshots keep NULL fields and render timestamps as
'yyyy-MM-dd HH:mm:ss' text, the way the surveyed ledger stores them.  Set-level
entries (BULK_INSERT, PURGE) hold the count of the set, with one more entry per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.config import DEFAULT_CATEGORY, SOURCE_DEFAULT
from spendlake.session import assign_dense_ids, written

EXPENSE_COLS = ("id", "amount", "category", "description", "transaction_date", "deleted_at", "inserted_on", "updated_on")
BUDGET_COLS = ("id", "month_key", "category", "budget_limit", "inserted_on", "updated_on")


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def snapshot(cols=EXPENSE_COLS, prefix: str = "") -> Column:
    """JSON of a row (NULLs kept, timestamps as text)."""
    parts = []
    for c in cols:
        col = F.col(f"{prefix}{c}")
        if c in ("deleted_at", "inserted_on", "updated_on"):
            col = ts_text(col)
        parts.append(col.alias(c))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def audit_frame(df: DataFrame, action: str, table: str, row_id: Column, old: Column | None, new: Column | None,
                as_of_ts: str, source: str = SOURCE_DEFAULT) -> DataFrame:
    """MUT-7: audit rows for the rows of ``df``."""
    return df.select(
        F.lit(action).alias("action"),
        F.lit(table).alias("table_name"),
        row_id.cast("bigint").alias("row_id"),
        (old if old is not None else F.lit(None).cast("string")).alias("old_values"),
        (new if new is not None else F.lit(None).cast("string")).alias("new_values"),
        F.lit(source).alias("source"),
        F.lit(as_of_ts).cast("timestamp_ntz").alias("created_on"),
    )


def set_audit(ids: DataFrame, action: str, table: str, field: str, as_of_ts: str,
              source: str = SOURCE_DEFAULT) -> DataFrame:
    """Audit of a set operation: one entry {"count": n} for the whole set (none for an empty
    one) and one ``<action>_ROW`` entry per id.  Both carry the operation's source and
    time; no list of ids is built, so the set may have any size."""
    whole = ids.agg(F.count(F.lit(1)).alias("count")).where("count > 0")
    payload = F.to_json(F.struct("count"))
    head = audit_frame(whole, action, table, F.lit(None), payload if field == "old" else None,
                       payload if field == "new" else None, as_of_ts, source)
    return head.unionByName(audit_frame(ids, f"{action}_ROW", table, F.col("id"), None, None, as_of_ts, source))


# ---------------------------------------------------------------------------
# MUT-1 append (+ SRC-2 payload parsing)
# ---------------------------------------------------------------------------

PAYLOAD_SCHEMA = "ARRAY<STRUCT<amount: STRING, category: STRING, description: STRING, date: STRING>>"


def parse_bulk_payload(json_col: Column) -> Column:
    """SRC-2: a JSON array of {amount, category?, description?, date?} (amount kept as text)."""
    return F.from_json(json_col, PAYLOAD_SCHEMA)


def prepare_appends(payload: DataFrame, as_of_ts: str, order_cols: list, high_water: Column | int,
                    carry: tuple = ()) -> DataFrame:
    """New ledger rows for a validated payload: defaults applied, dense ids above
    ``high_water`` in ``order_cols`` order; ``carry`` columns ride along (e.g. the
    message key for the id back-join)."""
    rows = payload.select(
        *order_cols,
        *[c for c in carry if c not in order_cols],
        F.col("amount").cast("string").try_cast("double").alias("amount"),
        F.coalesce(F.col("category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("date"), F.lit(as_of_ts[:10])).alias("transaction_date"),
    )
    ordered = list(order_cols) + ["amount", "category", "description", "transaction_date"]
    with_ids = assign_dense_ids(rows, ordered, high_water)
    stamp = F.lit(as_of_ts).cast("timestamp_ntz")
    return with_ids.select(
        "id", "amount", "category", "description", "transaction_date",
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"), stamp.alias("inserted_on"), stamp.alias("updated_on"),
        *[c for c in carry],
    )


def append_expenses(state: DataFrame, payload: DataFrame, as_of_ts: str, order_cols: list,
                    high_water: Column | int | None = None, bulk: bool = True,
                    source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-1: append payload rows (amount text, category?, description?, date?).

    Defaults: category 'Uncategorised' (also for an explicit NULL), description '',
    date = as_of.  A bad amount anywhere rejects the whole batch (validation pass).
    New ids = high-water mark + 1.. in ``order_cols`` order (AUTOINCREMENT never reuses
    ids; the default high-water mark is max(id) of the state)."""
    bad = F.col("amount").cast("string").try_cast("double").isNull()
    rejects = payload.where(bad)
    # written once: the validation, the sampling of the id order and its sort all read it
    fields = ["amount", "category", "description", "date"]
    payload = written(payload.select(*[c for c in order_cols if c not in fields],
                                     *[F.col(c).cast("string").alias(c) for c in fields]), "payload")
    if not payload.where(bad).isEmpty():
        empty = state.limit(0)
        return state, audit_frame(empty, "BULK_INSERT", "expenses", F.lit(None), None, None, as_of_ts, source).limit(0), rejects
    if high_water is None:
        high_water = state.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new_rows = prepare_appends(payload, as_of_ts, order_cols, high_water)
    new_state = state.select(*EXPENSE_COLS).unionByName(new_rows)
    if bulk:
        audit = set_audit(new_rows.select("id"), "BULK_INSERT", "expenses", "new", as_of_ts, source)
    else:
        audit = audit_frame(new_rows, "INSERT", "expenses", F.col("id"), None, snapshot(), as_of_ts, source)
    return new_state, audit, rejects


# ---------------------------------------------------------------------------
# MUT-2 soft delete, MUT-3 purge, MUT-5 recategorise, MUT-6 bulk edit
# ---------------------------------------------------------------------------

def soft_delete(state: DataFrame, ids: DataFrame, as_of_ts: str,
                source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-2: set deleted_at = as_of on active rows whose id is requested; a missing or
    already-deleted id is rejected; audit SOFT_DELETE with the full old row."""
    req = ids.select(F.col("id").alias("_rid")).distinct()
    j = state.join(req, state.id == req._rid, "left")
    hit = F.col("_rid").isNotNull() & F.col("deleted_at").isNull()
    stamp = F.lit(as_of_ts).cast("timestamp_ntz")
    new_state = j.select(
        *[c for c in EXPENSE_COLS if c not in ("deleted_at", "updated_on")],
        F.when(hit, stamp).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(hit, stamp).otherwise(F.col("updated_on")).alias("updated_on"),
    ).select(*EXPENSE_COLS)
    touched = j.where(hit)
    audit = audit_frame(touched, "SOFT_DELETE", "expenses", F.col("id"), snapshot(), None, as_of_ts, source)
    active_ids = state.where(F.col("deleted_at").isNull()).select(F.col("id").alias("_rid"))
    rejects = req.join(active_ids, "_rid", "left_anti").select(F.col("_rid").alias("id"))
    return new_state, audit, rejects


def purge_deleted(state: DataFrame, as_of_ts: str, source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-3: drop soft-deleted rows; audit PURGE {count} and one PURGE_ROW per id (none when nothing to purge)."""
    gone = state.where(F.col("deleted_at").isNotNull())
    audit = set_audit(gone.select("id"), "PURGE", "expenses", "old", as_of_ts, source)
    return state.where(F.col("deleted_at").isNull()), audit, state.limit(0)


def recategorise(state: DataFrame, changes: DataFrame, as_of_ts: str,
                 source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-5: (id, new_category) on active rows; missing/deleted ids rejected; audit
    UPDATE with old and new rows.  Several changes for one id: the last by ``seq`` wins,
    without that column the greatest category."""
    last = F.max_by("new_category", "seq") if "seq" in changes.columns else F.max("new_category")
    ch = changes.groupBy("id").agg(last.alias("new_category"))
    ch = ch.select(F.col("id").alias("_cid"), "new_category")
    j = state.join(ch, state.id == ch._cid, "left")
    hit = F.col("_cid").isNotNull() & F.col("deleted_at").isNull()
    stamp = F.lit(as_of_ts).cast("timestamp_ntz")
    new_cols = {
        "category": F.when(hit, F.col("new_category")).otherwise(F.col("category")),
        "updated_on": F.when(hit, stamp).otherwise(F.col("updated_on")),
    }
    new_state = j.select(*[new_cols.get(c, F.col(c)).alias(c) for c in EXPENSE_COLS])
    touched = j.where(hit).select(
        *[F.col(c).alias(f"o_{c}") for c in EXPENSE_COLS],
        *[new_cols.get(c, F.col(c)).alias(f"n_{c}") for c in EXPENSE_COLS],
    )
    audit = audit_frame(touched, "UPDATE", "expenses", F.col("o_id"), snapshot(prefix="o_"), snapshot(prefix="n_"),
                        as_of_ts, source)
    active_ids = state.where(F.col("deleted_at").isNull()).select(F.col("id").alias("_cid"))
    rejects = ch.join(active_ids, "_cid", "left_anti").select(F.col("_cid").alias("id"), "new_category")
    return new_state, audit, rejects


def bulk_edit_rows(state: DataFrame, where: str, assignments: dict | None, as_of_ts: str,
                   delete: bool = False) -> tuple[DataFrame, str]:
    """The edited rows (of a delete: the rows as they are) with ``_hit``: whether the predicate holds for the
    row before the edit; and the statement text."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    if delete:
        return state.select(*EXPENSE_COLS, hit.alias("_hit")), f"DELETE FROM expenses WHERE {where}"
    assignments = assignments or {}
    new = {"updated_on": F.lit(as_of_ts).cast("timestamp_ntz"), **{c: F.expr(e) for c, e in assignments.items()}}
    rows = state.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in EXPENSE_COLS],
                        hit.alias("_hit"))
    sets = ", ".join(f"{k} = {v}" for k, v in assignments.items())
    return rows, f"UPDATE expenses SET {sets} WHERE {where}"


def bulk_edit_audit(counted: DataFrame, text: str, as_of_ts: str, source: str = SOURCE_DEFAULT) -> DataFrame:
    """The QUERY_WRITE audit row of a statement for a one-row frame with ``rows_affected``."""
    return audit_frame(
        counted, "QUERY_WRITE", "raw_sql", F.lit(None),
        None, F.to_json(F.struct(F.lit(text).alias("sql"), F.col("rows_affected"))), as_of_ts, source,
    )


def bulk_edit(state: DataFrame, where: str, assignments: dict | None, as_of_ts: str, delete: bool = False,
              source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-6: audited bulk edit: SQL predicate plus column assignments (SQL expressions),
    or a predicate delete.  One QUERY_WRITE audit row with the statement text and the
    number of rows affected, an aggregate over the state (``versions.publish_bulk_edit``
    observes it in the write instead)."""
    rows, text = bulk_edit_rows(state, where, assignments, as_of_ts, delete)
    affected = rows.agg(F.count_if("_hit").alias("rows_affected"))
    new_state = rows.where(~F.col("_hit")) if delete else rows
    return new_state.drop("_hit"), bulk_edit_audit(affected, text, as_of_ts, source), state.limit(0)


# ---------------------------------------------------------------------------
# MUT-4 budget upsert
# ---------------------------------------------------------------------------

def upsert_budgets(budgets: DataFrame, changes: DataFrame, as_of_ts: str,
                   source: str = SOURCE_DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-4: (month_key, category, budget_limit[, seq]) upserted on the null-safe key
    (month_key, category); the last change per key wins.  New keys get ids above the
    current maximum; audit UPSERT with old (NULL when new) and new rows."""
    ch = changes
    if "seq" not in ch.columns:
        ch = ch.withColumn("seq", F.lit(0))
    last = ch.groupBy("month_key", "category").agg(F.max_by("budget_limit", "seq").alias("_new"))
    last = last.select(F.col("month_key").alias("_m"), F.col("category").alias("_c"), "_new")
    j = budgets.join(
        last, (budgets.month_key == last._m) & budgets.category.eqNullSafe(last._c), "full_outer"
    )
    stamp = F.lit(as_of_ts).cast("timestamp_ntz")
    existing = j.where(F.col("id").isNotNull())
    created = j.where(F.col("id").isNull())
    high = budgets.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = assign_dense_ids(
        created.select(F.col("_m").alias("month_key"), F.col("_c").alias("category"), "_new"),
        ["month_key", "category"], high,
    ).select(
        "id", "month_key", "category", F.col("_new").alias("budget_limit"), stamp.alias("inserted_on"),
        stamp.alias("updated_on"),
    )
    changed = F.col("_new").isNotNull()
    kept = existing.select(
        "id", "month_key", "category",
        F.when(changed, F.col("_new")).otherwise(F.col("budget_limit")).alias("budget_limit"),
        "inserted_on",
        F.when(changed, stamp).otherwise(F.col("updated_on")).alias("updated_on"),
    )
    new_state = kept.unionByName(created)
    touched_old = existing.where(changed)
    a_old = audit_frame(
        touched_old, "UPSERT", "budgets", F.col("id"),
        snapshot(BUDGET_COLS),
        F.to_json(F.struct(F.col("id"), F.col("month_key"), F.col("category"), F.col("_new").alias("budget_limit"),
                           ts_text(F.col("inserted_on")).alias("inserted_on"), ts_text(stamp).alias("updated_on")),
                  {"ignoreNullFields": "false"}),
        as_of_ts, source,
    )
    a_new = audit_frame(created, "UPSERT", "budgets", F.col("id"), None, snapshot(BUDGET_COLS), as_of_ts, source)
    return new_state, a_old.unionByName(a_new), budgets.limit(0)


# ---------------------------------------------------------------------------
# WIN-2: latest state per id from a change log; MUT-7 history
# ---------------------------------------------------------------------------

def latest_state(changelog: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """WIN-2: the last version of each row (by ``seq``); rows whose last op is a purge vanish.

    ``max_by`` aggregates per key with map-side partial aggregation (no full sort)."""
    cols = [c for c in changelog.columns if c not in (key, seq, "op")]
    last = changelog.groupBy(key).agg(F.max_by(F.struct(*cols, F.coalesce(F.col("op"), F.lit("upsert")).alias("op")
                                                        if "op" in changelog.columns else F.lit("upsert").alias("op")),
                                               F.col(seq)).alias("_r"))
    return last.where(F.col("_r.op") != "purge").select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def audit_history(audit: DataFrame, row_id: int, table: str = "expenses") -> DataFrame:
    """MUT-7: the audit entries of one row, oldest first."""
    return audit.where((F.col("row_id") == row_id) & (F.col("table_name") == table)).orderBy("id")
