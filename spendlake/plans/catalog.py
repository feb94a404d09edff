"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or views Spark derives from them) in full.
Column names equal those of the matching SQL in ``spendlake.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendlake.operators import reports
from spendlake.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def ledger(spark: SparkSession, sf_dir: str):
    return tables.expenses_from_orders(spark, sf_dir), tables.budgets_from_orders(spark, sf_dir)


# ---------------------------------------------------------------------------
# Reports (AGG-1..5, AGG-11, JN-1, PRJ-2/3, SRT-1)
# ---------------------------------------------------------------------------

@register("monthly_budget_report")
def monthly_budget_report(spark, sf_dir):
    """AGG-3 + JN-1 + PRJ-2/3 + SRT-1: every month and (month, category) against budgets."""
    ex, bu = ledger(spark, sf_dir)
    return reports.summary_report(ex, bu)


@register("period_totals")
def period_totals(spark, sf_dir):
    """AGG-1 + FLT-2/3: daily, ISO-week and month spend for every day of the ledger."""
    ex, _ = ledger(spark, sf_dir)
    return reports.period_totals(ex)


@register("category_breakdown")
def category_breakdown(spark, sf_dir):
    """AGG-2 + SRT-1: spend per (month, category) ranked by spend."""
    ex, _ = ledger(spark, sf_dir)
    return reports.category_breakdown(ex)


@register("list_categories")
def list_categories(spark, sf_dir):
    """AGG-5: distinct active categories."""
    ex, _ = ledger(spark, sf_dir)
    return reports.list_categories(ex)


@register("budget_alerts")
def budget_alerts(spark, sf_dir):
    """AGG-11: months at/above 80 % of the overall budget and overspent categories."""
    ex, bu = ledger(spark, sf_dir)
    return reports.budget_alerts(reports.summary_report(ex, bu))


@register("resolved_budgets")
def resolved_budgets(spark, sf_dir):
    """JN-1: resolved overall and category budgets for every (month, category) in the ledger."""
    from pyspark.sql import functions as F

    from spendlake.operators.budgets import resolve_budgets, resolve_overall_budget

    ex, bu = ledger(spark, sf_dir)
    groups = ex.select("month_key", "category").distinct()
    cat = resolve_budgets(groups, bu, out_col="category_budget")
    over = resolve_overall_budget(ex.select("month_key").distinct(), bu, out_col="overall_budget")
    return cat.join(over, "month_key").select("month_key", "category", "category_budget", "overall_budget").where(
        F.col("month_key").isNotNull()
    )


# ---------------------------------------------------------------------------
# Message extraction (SC-1..6, JN-11, AGG-7, SNK-5, FLT-5)
# ---------------------------------------------------------------------------

def parsed_messages(spark, sf_dir):
    from spendlake.operators.extract import extract_transactions

    return extract_transactions(tables.all_messages(spark, sf_dir, tables.dealt), as_of=tables.EVENTS_AS_OF)


@register("message_extraction")
def message_extraction(spark, sf_dir):
    """SC-6 (+ SC-1..5, JN-11): every message parsed; flat transaction fields."""
    from spendlake.operators.extract import flatten_transaction

    return flatten_transaction(parsed_messages(spark, sf_dir))


@register("parser_stats")
def parser_stats(spark, sf_dir):
    """AGG-7: totals, hits, misses and hit rate of a parse run."""
    from spendlake.operators.extract import parser_stats as stats

    return stats(parsed_messages(spark, sf_dir))[0]


@register("pattern_breakdown")
def pattern_breakdown(spark, sf_dir):
    """AGG-7 + SRT-4: per-pattern counts, descending."""
    from spendlake.operators.extract import parser_stats as stats

    return stats(parsed_messages(spark, sf_dir))[1]


@register("review_queue")
def review_queue(spark, sf_dir):
    """SNK-5: unmatched messages with their whole bodies."""
    from pyspark.sql import functions as F

    from spendlake.operators.extract import review_queue as rq

    return rq(parsed_messages(spark, sf_dir)).select(
        "email_uid", "subject", "confidence", F.length("body_for_review").alias("review_chars"),
        F.sha2(F.col("body_for_review"), 256).alias("review_sha")
    )


@register("sender_split")
def sender_split(spark, sf_dir):
    """FLT-5 + JN-11: allow-list containment and pattern family per message."""
    from spendlake.config import DEFAULT_ALLOWED_SENDERS
    from spendlake.operators.extract import sender_family
    from spendlake.operators.filters import sender_match

    from pyspark.sql import functions as F

    m = tables.all_messages(spark, sf_dir)
    return m.select(
        "seq", "sender_email",
        sender_match(F.col("sender_email"), DEFAULT_ALLOWED_SENDERS).alias("allowed"),
        sender_family(F.col("sender_email")).alias("family"),
    )


# ---------------------------------------------------------------------------
# Dedup over the events timeline (JN-2..JN-7, AGG-9, FLT-7)
# ---------------------------------------------------------------------------

# Fixed values of the registered dedup runs: reprocess mode (90-day reference horizon,
# ledger look-back from the batch start minus the hard cutoff).
DEDUP_AS_OF_TS = "2024-01-31 00:00:00"
DEDUP_REF_DAYS = 90


def dedup_inputs(spark, sf_dir):
    from spendlake.config import DedupSettings
    from spendlake.operators.dedup import known_references
    from spendlake.operators.filters import ledger_lookback
    from spendlake.plans.runs import reprocess_since
    from spendlake.session import cut_lineage

    # The derived inputs feed several dedup stages; each is written once.
    batch = cut_lineage(tables.batch_from_events(spark, sf_dir))
    since = reprocess_since(batch, DEDUP_AS_OF_TS[:10], DedupSettings())
    ledger_rows = cut_lineage(ledger_lookback(tables.ledger_from_events(spark, sf_dir), since))
    known = cut_lineage(known_references(tables.checkpoint_from_events(spark, sf_dir), DEDUP_AS_OF_TS, DEDUP_REF_DAYS))
    return batch, ledger_rows, known


@register("soft_match_pairs")
def soft_match_pairs(spark, sf_dir):
    """JN-4 + SC-7/8/9: band join of all event transactions with each other; score, status and reasons per pair."""
    from pyspark.sql import functions as F

    from spendlake.config import DedupSettings
    from spendlake.operators.dedup import soft_match_pairs as smp

    everything = tables.event_transactions(spark, sf_dir).withColumnRenamed("ts", "txn_ts")
    return smp(everything, None, DedupSettings()).select(
        "c_key", "e_key", F.round("gap_minutes", 4).alias("gap_minutes"), "score", "status",
        F.array_join("reasons", ",").alias("reasons"),
    )


@register("ledger_first_match")
def ledger_first_match(spark, sf_dir):
    """JN-5 + FLT-7 + SRT-2: first ledger row (newest first) matching each batch row."""
    from spendlake.config import DedupSettings
    from spendlake.operators.dedup import first_ledger_match

    batch, ledger_rows, _ = dedup_inputs(spark, sf_dir)
    return first_ledger_match(batch, ledger_rows, DedupSettings())


@register("known_references")
def known_references_q(spark, sf_dir):
    """JN-3: lower-cased reference -> last processed message within the horizon."""
    from pyspark.sql import functions as F

    _, _, known = dedup_inputs(spark, sf_dir)
    return known.select("ref", F.col("record.message_id").alias("message_id"))


@register("hard_matches")
def hard_matches_q(spark, sf_dir):
    """JN-2: batch rows whose reference equals a known one (type ignored, case-folded)."""
    from spendlake.operators.dedup import hard_matches

    batch, _, known = dedup_inputs(spark, sf_dir)
    return hard_matches(batch, known)


@register("batch_leaders")
def batch_leaders_q(spark, sf_dir):
    """JN-6: leader election over the match graph of all event transactions."""
    from spendlake.config import DedupSettings
    from spendlake.operators.dedup import batch_leaders

    everything = tables.event_transactions(spark, sf_dir).withColumnRenamed("ts", "txn_ts")
    return batch_leaders(everything, DedupSettings()).select("seq", "role", "leader_seq")


@register("dedup_statuses")
def dedup_statuses(spark, sf_dir):
    """JN-7: hard -> ledger -> batch with precedence; one status per batch row."""
    from spendlake.config import DedupSettings
    from spendlake.operators.dedup import deduplicate

    batch, ledger_rows, known = dedup_inputs(spark, sf_dir)
    return deduplicate(batch, ledger_rows, known, DedupSettings())


@register("dedup_status_counts")
def dedup_status_counts(spark, sf_dir):
    """AGG-9: counts per dedup status."""
    from spendlake.operators.dedup import status_counts

    return status_counts(dedup_statuses(spark, sf_dir))


# ---------------------------------------------------------------------------
# Suggestions (JN-9, AGG-6, SC-16) and roll-up (AGG-10)
# ---------------------------------------------------------------------------

def part_terms(spark, sf_dir):
    """Search terms: every word of every part name, and every whole part name."""
    from pyspark.sql import functions as F

    part = tables.read_table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("term"))
    return words.unionByName(part.select(F.col("p_name").alias("term")))


@register("category_suggestions")
def category_suggestions(spark, sf_dir):
    """JN-9 + AGG-6 + SRT-3 + SC-16: suggestion per term over all active descriptions."""
    from spendlake.operators.suggest import suggest_categories

    ex, _ = ledger(spark, sf_dir)
    return suggest_categories(ex, part_terms(spark, sf_dir))


def order_items(spark, sf_dir):
    from pyspark.sql import functions as F

    li = tables.read_table(spark, sf_dir, "lineitem")
    part = tables.read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey, "left").select(
        F.col("l_orderkey").alias("batch"),
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").alias("amount"),
        F.col("p_name").alias("description"),
    )


@register("category_rollup")
def category_rollup(spark, sf_dir):
    """AGG-10: order lines rolled up, one entry per (order, return flag)."""
    from spendlake.operators.suggest import rollup_by_category

    return rollup_by_category(order_items(spark, sf_dir))


@register("category_rollup_items")
def category_rollup_items(spark, sf_dir):
    """AGG-10: the order lines behind the roll-up entries."""
    from spendlake.operators.suggest import rollup_items

    return rollup_items(order_items(spark, sf_dir))


# ---------------------------------------------------------------------------
# Mutations (MUT-1..7, WIN-2, SRC-2, SNK-2)
# ---------------------------------------------------------------------------

# The instant of the registered mutation runs and their change rules.
MUT_AS_OF = "2001-09-01 00:00:00"
BULK_EDIT_WHERE = "category = 'BUILDING' AND transaction_date >= '1998-01-01'"
# Money arithmetic in DECIMAL: exact, then HALF_UP to cents.
BULK_EDIT_SET = {"amount": "CAST(round(CAST(amount AS DECIMAL(18, 2)) * CAST(1.18 AS DECIMAL(4, 2)), 2) AS DOUBLE)"}


def ledger_state(spark, sf_dir):
    from spendlake.operators.mutations import EXPENSE_COLS

    return tables.expenses_from_orders(spark, sf_dir).select(*EXPENSE_COLS)


def bulk_payload(spark, sf_dir):
    """SRC-2: each order's lines as one JSON payload text, parsed back with the payload schema."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import parse_bulk_payload

    li = tables.read_table(spark, sf_dir, "lineitem")
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_extendedprice").alias("x"), F.col("l_returnflag").alias("f"), F.col("l_shipdate").alias("d"),
    )
    per_order = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    item = lambda l: F.struct(
        l["x"].cast("string").alias("amount"),
        F.when(l["f"] == "R", F.lit("Returns")).when(l["f"] == "A", F.lit("Adjustments")).alias("category"),
        F.concat(F.lit("part "), l["p"].cast("string")).alias("description"),
        F.date_format(l["d"], "yyyy-MM-dd").alias("date"),
    )
    texts = per_order.select("l_orderkey", F.to_json(F.transform("lines", item)).alias("payload"))
    return texts.select("l_orderkey", F.posexplode(parse_bulk_payload(F.col("payload"))).alias("pos", "item")).select(
        "l_orderkey", "pos", "item.*"
    )


@register("append_expenses")
def append_expenses_q(spark, sf_dir):
    """MUT-1 + SRC-2 + SNK-2: bulk payloads appended with dense new ids and defaults."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import append_expenses

    state = ledger_state(spark, sf_dir)
    new_state, _, _ = append_expenses(state, bulk_payload(spark, sf_dir), MUT_AS_OF, ["l_orderkey", "pos"])
    hw = state.agg(F.max("id")).first()[0]
    return new_state.where(F.col("id") > hw).select("id", "amount", "category", "description", "transaction_date")


@register("bulk_insert_audit")
def bulk_insert_audit(spark, sf_dir):
    """MUT-7 (BULK_INSERT): one entry for the set and one per id."""
    from spendlake.operators.mutations import append_expenses

    state = ledger_state(spark, sf_dir)
    _, audit, _ = append_expenses(state, bulk_payload(spark, sf_dir), MUT_AS_OF, ["l_orderkey", "pos"])
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


def delete_requests(spark, sf_dir):
    from pyspark.sql import functions as F

    o = tables.read_table(spark, sf_dir, "orders")
    hit = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("id"))
    missing = o.where(F.col("o_orderpriority") == "2-HIGH").select((F.col("o_orderkey") + 1_000_000_000).alias("id"))
    return hit.unionByName(missing)


@register("soft_delete")
def soft_delete_q(spark, sf_dir):
    """MUT-2: urgent orders soft-deleted; full new state (deleted_at / updated_on as text)."""
    from spendlake.operators.mutations import soft_delete, ts_text

    from pyspark.sql import functions as F

    new_state, _, _ = soft_delete(ledger_state(spark, sf_dir), delete_requests(spark, sf_dir), MUT_AS_OF)
    return new_state.select("id", ts_text(F.col("deleted_at")).alias("deleted_at"),
                            ts_text(F.col("updated_on")).alias("updated_on"))


@register("soft_delete_audit")
def soft_delete_audit(spark, sf_dir):
    """MUT-2 + MUT-7 + SC-15: SOFT_DELETE audit rows with the full old row as JSON."""
    from spendlake.operators.mutations import soft_delete

    _, audit, _ = soft_delete(ledger_state(spark, sf_dir), delete_requests(spark, sf_dir), MUT_AS_OF)
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


@register("soft_delete_rejects")
def soft_delete_rejects(spark, sf_dir):
    """MUT-2 rejects: requested ids that are missing or already deleted."""
    from spendlake.operators.mutations import soft_delete

    _, _, rejects = soft_delete(ledger_state(spark, sf_dir), delete_requests(spark, sf_dir), MUT_AS_OF)
    return rejects


@register("purge_audit")
def purge_audit(spark, sf_dir):
    """MUT-3: purge soft-deleted rows; PURGE audit (the count, then one entry per id)."""
    from spendlake.operators.mutations import purge_deleted

    _, audit, _ = purge_deleted(ledger_state(spark, sf_dir), MUT_AS_OF)
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


def recategorise_changes(spark, sf_dir):
    from pyspark.sql import functions as F

    o = tables.read_table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderpriority") == "5-LOW").select(
        F.col("o_orderkey").alias("id"), F.lit("DEFERRED").alias("new_category")
    )


@register("recategorise")
def recategorise_q(spark, sf_dir):
    """MUT-5: low-priority orders moved to 'DEFERRED' (deleted rows rejected); new state."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import recategorise, ts_text

    new_state, _, _ = recategorise(ledger_state(spark, sf_dir), recategorise_changes(spark, sf_dir), MUT_AS_OF)
    return new_state.select("id", "category", ts_text(F.col("updated_on")).alias("updated_on"))


@register("recategorise_audit")
def recategorise_audit(spark, sf_dir):
    """MUT-5 + MUT-7: UPDATE audit rows with old and new rows as JSON."""
    from spendlake.operators.mutations import recategorise

    _, audit, _ = recategorise(ledger_state(spark, sf_dir), recategorise_changes(spark, sf_dir), MUT_AS_OF)
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


@register("bulk_edit")
def bulk_edit_q(spark, sf_dir):
    """MUT-6: predicate + assignment over the whole ledger; new amounts."""
    from spendlake.operators.mutations import bulk_edit

    new_state, _, _ = bulk_edit(ledger_state(spark, sf_dir), BULK_EDIT_WHERE, BULK_EDIT_SET, MUT_AS_OF)
    return new_state.select("id", "amount", "category", "transaction_date")


@register("bulk_edit_audit")
def bulk_edit_audit(spark, sf_dir):
    """MUT-6 + MUT-7: one QUERY_WRITE audit row with the statement and rows affected."""
    from spendlake.operators.mutations import bulk_edit

    _, audit, _ = bulk_edit(ledger_state(spark, sf_dir), BULK_EDIT_WHERE, BULK_EDIT_SET, MUT_AS_OF)
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


def budget_changes(spark, sf_dir):
    """Budget changes derived from spend: each (month, category) of 1998 at 110 % of its
    spend, plus two successive overall defaults (the later one must win)."""
    from pyspark.sql import functions as F

    ex = tables.expenses_from_orders(spark, sf_dir)
    spend = ex.where(F.col("month_key").startswith("1998")).groupBy("month_key", "category").agg(
        F.round(F.sum("amount") * 1.1, 0).alias("budget_limit")
    ).withColumn("seq", F.lit(1))
    extra = spark.createDataFrame(
        [("default", None, 31000000.0, 1), ("default", None, 32000000.0, 2)],
        "month_key string, category string, budget_limit double, seq int",
    )
    return spend.unionByName(extra)


@register("budget_upsert")
def budget_upsert(spark, sf_dir):
    """MUT-4: null-safe upsert of derived budget changes; the new budgets table."""
    from spendlake.operators.mutations import upsert_budgets

    new_state, _, _ = upsert_budgets(tables.budgets_from_orders(spark, sf_dir), budget_changes(spark, sf_dir),
                                     MUT_AS_OF)
    return new_state.select("id", "month_key", "category", "budget_limit")


@register("budget_upsert_audit")
def budget_upsert_audit(spark, sf_dir):
    """MUT-4 + MUT-7: UPSERT audit rows (old NULL for new keys)."""
    from spendlake.operators.mutations import upsert_budgets

    _, audit, _ = upsert_budgets(tables.budgets_from_orders(spark, sf_dir), budget_changes(spark, sf_dir), MUT_AS_OF)
    return audit.select("action", "table_name", "row_id", "old_values", "new_values", "source")


@register("ledger_latest_state")
def ledger_latest_state(spark, sf_dir):
    """WIN-2: latest row per id from a change log (base rows, recategorisations, deletes)."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import latest_state, soft_delete, recategorise, ts_text

    base = ledger_state(spark, sf_dir)
    recat, _, _ = recategorise(base, recategorise_changes(spark, sf_dir), MUT_AS_OF)
    deleted, _, _ = soft_delete(recat, delete_requests(spark, sf_dir), MUT_AS_OF)
    log = (
        base.withColumn("seq", F.lit(0)).withColumn("op", F.lit("upsert"))
        .unionByName(recat.join(recategorise_changes(spark, sf_dir).select("id"), "id", "left_semi")
                     .withColumn("seq", F.lit(1)).withColumn("op", F.lit("upsert")))
        .unionByName(deleted.join(delete_requests(spark, sf_dir), "id", "left_semi")
                     .withColumn("seq", F.lit(2)).withColumn("op", F.lit("upsert")))
    )
    return latest_state(log).select("id", "category", ts_text(F.col("deleted_at")).alias("deleted_at"))


# ---------------------------------------------------------------------------
# Text helpers (SC-10..13), read-only SQL (FLT-9)
# ---------------------------------------------------------------------------

@register("html_to_text")
def html_to_text_q(spark, sf_dir):
    """SC-10: every page's HTML to text (script/style/comments dropped, entities decoded)."""
    from pyspark.sql import functions as F

    from spendlake.functions.text import html_to_text

    pages = tables.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@register("address_extraction")
def address_extraction(spark, sf_dir):
    """SC-12: addresses from 'Name <addr>' headers built from customers, and from document text."""
    from pyspark.sql import functions as F

    from spendlake.functions.text import extract_address

    cust = tables.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        F.concat(F.col("c_name"), F.lit(" <"), F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com>"))
        .alias("header"),
    )
    docs = tables.read_table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("key"), F.col("text").alias("header")
    )
    both = cust.unionByName(docs)
    addr = extract_address(F.col("header"))
    return both.select("key", F.sha2(addr, 256).alias("address_sha"), F.length(addr).alias("address_len"),
                       addr.alias("address"))


@register("mail_date_parse")
def mail_date_parse(spark, sf_dir):
    """SC-13: mail Date headers (rendered from events in +0530) back to ISO text."""
    from pyspark.sql import functions as F

    from spendlake.functions.timeutil import mail_date_to_iso

    ev = tables.read_table(spark, sf_dir, "events")
    hdr = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 330 MINUTES"),
                                 "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0530"))
    return ev.select("event_id", mail_date_to_iso(hdr, "2024-01-31T00:00:00").alias("received_at"))


# Fixed value: the analyst statement run through the read-only guard.
READ_ONLY_SQL = (
    "SELECT category, month_key, count(*) AS n, round(sum(amount), 2) AS total "
    "FROM expenses WHERE deleted_at IS NULL GROUP BY category, month_key"
)


@register("read_only_sql")
def read_only_sql(spark, sf_dir):
    """FLT-9: a SELECT run through the read-only guard over the ledger view."""
    from spendlake.operators.sql import query_read

    ex, bu = ledger(spark, sf_dir)
    return query_read(spark, READ_ONLY_SQL, {"expenses": ex, "budgets": bu})


# ---------------------------------------------------------------------------
# Ingestion runs (REV-1..4, WIN-1, AGG-8, SRC-4/5, JN-8, JN-10, FLT-6/8, PRJ-1, SNK-3, MUT-8)
# ---------------------------------------------------------------------------

RUN_AS_OF = "2024-01-31 22:00:00"


def run_inputs(spark, sf_dir):
    """Messages of the whole archive, the events ledger part, and its checkpoint."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import EXPENSE_COLS

    msgs = tables.all_messages(spark, sf_dir, tables.dealt)
    led = tables.ledger_from_events(spark, sf_dir).select(*EXPENSE_COLS)
    cp = tables.checkpoint_from_events(spark, sf_dir).withColumn(
        "processed_at", F.col("processed_at").cast("timestamp_ntz"))
    return msgs, led, cp


def ingest_run(spark, sf_dir, reprocess: bool = False):
    from spendlake.plans.runs import run_batch

    msgs, led, cp = run_inputs(spark, sf_dir)
    return run_batch(msgs, led, cp.drop("seq"), RUN_AS_OF, reprocess=reprocess)


@register("run_summary")
def run_summary_q(spark, sf_dir):
    """REV-3 + AGG-8: a nightly run over the archive; its summary counts."""
    return ingest_run(spark, sf_dir).summary


@register("reprocess_summary")
def reprocess_summary_q(spark, sf_dir):
    """REV-4: reprocess mode (no processed check, 90-day references); summary counts."""
    return ingest_run(spark, sf_dir, reprocess=True).summary


@register("review_table")
def review_table_q(spark, sf_dir):
    """REV-1 + WIN-1: the review table of the run, sections in order."""
    from spendlake.plans.runs import review_table

    return review_table(ingest_run(spark, sf_dir).candidates)


@register("review_headline")
def review_headline_q(spark, sf_dir):
    """REV-2: headline counts per section (zero counts suppressed)."""
    from spendlake.plans.runs import review_headline

    return review_headline(ingest_run(spark, sf_dir).summary)


@register("run_appended")
def run_appended_q(spark, sf_dir):
    """FLT-6 + PRJ-1 + SC-16 + MUT-1 + JN-10: ledger rows appended by the run."""
    return ingest_run(spark, sf_dir).appended.select(
        "id", "email_uid", "amount", "category", "description", "transaction_date")


@register("run_checkpoint")
def run_checkpoint_q(spark, sf_dir):
    """SNK-3 + JN-10: checkpoint rows of the run (status, ledger ids, references)."""
    from pyspark.sql import functions as F

    cp = ingest_run(spark, sf_dir).checkpoint_rows
    return cp.select("email_uid", "message_id", "result", F.array_join(F.col("ledger_ids").cast("array<string>"), ",")
                     .alias("ledger_ids"), F.to_json("reference_ids").alias("reference_ids"))


@register("checkpoint_prune")
def checkpoint_prune_q(spark, sf_dir):
    """FLT-8: checkpoint rows kept at 20 days' retention (unparseable stamps pruned)."""
    from pyspark.sql import functions as F

    from spendlake.operators.filters import prune_checkpoint

    cp = tables.checkpoint_from_events(spark, sf_dir)
    kept, _ = prune_checkpoint(cp, RUN_AS_OF, 20)
    return kept.select("email_uid", "message_id", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))


@register("incremental_messages")
def incremental_messages_q(spark, sf_dir):
    """SRC-5 + JN-8: archive messages whose Message-ID is not in the checkpoint."""
    from spendlake.sources.io import unprocessed

    msgs, _, cp = run_inputs(spark, sf_dir)
    return unprocessed(msgs, cp).select("seq", "email_uid", "message_id")


@register("date_range_messages")
def date_range_messages_q(spark, sf_dir):
    """SRC-4: messages received 2024-01-10 .. 2024-01-12 (both inclusive, sender's local date)."""
    from spendlake.sources.io import messages_in_range

    msgs, _, _ = run_inputs(spark, sf_dir)
    return messages_in_range(msgs, "2024-01-10", "2024-01-12").select("seq", "email_uid", "received_at")


# ---------------------------------------------------------------------------
# Streaming (ST-2, ST-5) driven to completion with availableNow
# ---------------------------------------------------------------------------

def events_stream(spark, sf_dir):
    from spendlake.streaming.ingest import file_stream

    schema = tables.read_table(spark, sf_dir, "events").schema
    return file_stream(spark, sf_dir, schema, glob="events.parquet")


@register("streaming_daily_spend")
def streaming_daily_spend(spark, sf_dir):
    """ST-5: running daily spend per event type from an events stream (complete mode)."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import run_to_table, running_spend

    ev = events_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), F.col("event_type").alias("category"))
    out = run_to_table(running_spend(ev, "daily"), scratch_path(spark, "st5-out"), scratch_path(spark, "st5-ckpt"))
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "category",
                      F.round("spent", 2).alias("spent"), "n")


@register("streaming_message_dedup")
def streaming_message_dedup(spark, sf_dir):
    """ST-2: re-delivered messages (ledger and batch parts overlap on one day) dropped by
    Message-ID within a 60-day watermark."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import dedup_message_ids, run_to_table

    ev = events_stream(spark, sf_dir).select(F.col("event_id"), F.col("ts").cast("timestamp").alias("received_ts"))
    split_a = ev.where(F.col("received_ts") < F.lit(tables.LEDGER_END).cast("timestamp"))
    split_b = ev.where(F.col("received_ts") >= F.lit(tables.BATCH_START).cast("timestamp"))
    msgs = split_a.unionByName(split_b).withColumn(
        "message_id", F.concat(F.lit("<evt-"), F.col("event_id").cast("string"), F.lit("@mail.example>")))
    out = run_to_table(dedup_message_ids(msgs), scratch_path(spark, "st2-out"), scratch_path(spark, "st2-ckpt"),
                       mode="append")
    return out.select("message_id")


# ---------------------------------------------------------------------------
# Remaining operators: AGG-4, period summary for one date, MUT-8, SC-11, ST-4
# ---------------------------------------------------------------------------

# The as-of date of the single-date summaries.
SUMMARY_AS_OF = "1998-06-17"


@register("monthly_stats")
def monthly_stats_q(spark, sf_dir):
    """AGG-4: running month stats (spent, limit 0 when none, percentage) for the months
    touched by a bulk payload (every month that lines shipped in)."""
    from pyspark.sql import functions as F

    ex, bu = ledger(spark, sf_dir)
    months = tables.read_table(spark, sf_dir, "lineitem").select(
        F.date_format(F.col("l_shipdate").cast("timestamp_ntz"), "yyyy-MM").alias("month_key"))
    return reports.monthly_stats(ex, bu, months)


@register("period_summary_daily")
def period_summary_daily(spark, sf_dir):
    """AGG-1 + FLT-1..4 + PRJ-3: the daily summary header for one as-of date."""
    ex, bu = ledger(spark, sf_dir)
    return reports.period_summary(ex, bu, "daily", None, SUMMARY_AS_OF)[0]


@register("period_summary_weekly")
def period_summary_weekly(spark, sf_dir):
    """AGG-1 + FLT-3: weekly summary header (Monday..Sunday of the as-of date)."""
    ex, bu = ledger(spark, sf_dir)
    return reports.period_summary(ex, bu, "weekly", "1998-02", SUMMARY_AS_OF)[0]


@register("period_summary_categories")
def period_summary_categories(spark, sf_dir):
    """AGG-2 + PRJ-2 + SRT-1: the category breakdown of the as-of month."""
    ex, bu = ledger(spark, sf_dir)
    return reports.period_summary(ex, bu, "monthly", "1998-06-17", SUMMARY_AS_OF)[1].select(
        "category", "spent", "budget", "remaining", "overspent")


@register("review_corrections")
def review_corrections_q(spark, sf_dir):
    """MUT-8: corrections keyed by run number (delete, amount, recategorise, merge,
    confirm) applied to the run's ledger; the changed rows."""
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import EXPENSE_COLS, ts_text
    from spendlake.plans.runs import apply_corrections

    run = ingest_run(spark, sf_dir)
    # Derived correction batch: one correction per transaction, actions rotating by number.
    nums = run.candidates.select("number").where(F.col("transaction").isNotNull())
    kind = F.col("number") % 5
    corr = nums.select(
        "number",
        F.when(kind == 0, "delete").when(kind == 1, "amount").when(kind == 2, "recategorise")
        .when(kind == 3, "merge").otherwise("confirm").alias("action"),
        F.when(kind == 1, F.lit("99.5")).when(kind == 2, F.lit("Reviewed"))
        .when(kind == 3, (F.col("number") + 1).cast("string")).alias("value"),
    )
    new_state, _, _ = apply_corrections(run.new_ledger, run.candidates, run.appended, corr, RUN_AS_OF)
    base = run.new_ledger.select(*[F.col(c).alias(f"b_{c}") for c in EXPENSE_COLS])
    changed = new_state.join(base, new_state.id == base.b_id).where(
        ~F.col("amount").eqNullSafe(F.col("b_amount")) | ~F.col("category").eqNullSafe(F.col("b_category"))
        | ~F.col("deleted_at").eqNullSafe(F.col("b_deleted_at")))
    return changed.select("id", "amount", "category", ts_text(F.col("deleted_at")).alias("deleted_at"))


@register("header_decode")
def header_decode_q(spark, sf_dir):
    """SC-11: RFC 2047 encoded words (whole conversation texts, whitespace folded) decoded back."""
    from pyspark.sql import functions as F

    from spendlake.functions.text import decode_header_words

    conv = tables.read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("subject"))
    b64 = F.regexp_replace(F.base64(F.encode("subject", "UTF-8")), r"\s", "")  # base64 output may be chunked
    enc = conv.select("conv_id", "turn", F.concat(F.lit("=?utf-8?b?"), b64, F.lit("?=")).alias("encoded"))
    return enc.select("conv_id", "turn", decode_header_words(F.col("encoded")).alias("subject"))


@register("streaming_interval_join")
def streaming_interval_join(spark, sf_dir):
    """ST-4: watermarked stream-stream interval join of batch events against earlier ones
    (amount buckets + time range), pairs within tolerance."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import interval_pairs_stream, run_to_table

    ev = events_stream(spark, sf_dir)
    side = ev.select(F.col("event_id").alias("seq"), (F.round(F.col("value") * 100).cast("bigint") * 25 / 100.0)
                     .alias("amount"), F.col("event_type").alias("merchant"), F.col("ts").cast("timestamp").alias("ts"))
    pairs = interval_pairs_stream(side, side)
    out = run_to_table(pairs, scratch_path(spark, "st4-out"), scratch_path(spark, "st4-ckpt"), mode="append")
    return out.select("n_seq", "r_seq", F.round("gap_minutes", 4).alias("gap_minutes"))


@register("streaming_weekly_spend")
def streaming_weekly_spend(spark, sf_dir):
    """ST-5: running weekly spend (Monday-based windows) per event type from a stream."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import run_to_table, running_spend

    ev = events_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), F.col("event_type").alias("category"))
    out = run_to_table(running_spend(ev, "weekly"), scratch_path(spark, "st5w-out"), scratch_path(spark, "st5w-ckpt"))
    return out.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("week_start"), "category",
                      F.round("spent", 2).alias("spent"), "n")


@register("streaming_monthly_spend")
def streaming_monthly_spend(spark, sf_dir):
    """ST-5: running monthly spend per market segment from an orders stream (active orders)."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import file_stream, run_to_table, running_spend

    schema = tables.read_table(spark, sf_dir, "orders").schema
    orders = file_stream(spark, sf_dir, schema, glob="orders.parquet").where(F.col("o_orderstatus") != "F")
    s = orders.select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"),
                      F.col("o_custkey").alias("category"))
    out = run_to_table(running_spend(s, "monthly", key_col="category", watermark="40 days"),
                       scratch_path(spark, "st5m-out"), scratch_path(spark, "st5m-ckpt"))
    return out.select("month_key", F.col("category").alias("custkey"), F.round("spent", 2).alias("spent"), "n")


# ---------------------------------------------------------------------------
# Streams that arrive in several pieces (ST-1, ST-3..ST-5)
# ---------------------------------------------------------------------------

def arrive(spark, rows, time_col, path, stream, pieces=3, beat_days=400):
    """Let ``rows`` arrive in pieces of time order, then two heartbeats (rows with a later time and nulls else, which move
    the watermark), and run ``stream`` (a function that drives a query over ``path``) after each."""
    from pyspark.sql import functions as F

    us = F.unix_micros(time_col)
    cut = rows.agg(F.percentile_approx(us, [i / pieces for i in range(1, pieces)]).alias("q"), F.max(time_col).alias("last")).first()
    if cut.last is None:
        return stream()
    edges = [None, *sorted(set(cut.q)), None]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = rows if a is None else rows.where(us > a)
        (part if b is None else part.where(us <= b)).write.parquet(f"{path}/piece-{k}")
        out = stream()
    for k in (1, 2):
        later = F.lit(cut.last).cast("timestamp") + F.expr(f"INTERVAL {k * beat_days} DAYS")
        beat = [later.alias(c) if c == time_col else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
        spark.range(1).select(*beat).write.parquet(f"{path}/beat-{k}")
        out = stream()
    return out


def arriving_events(spark, sf_dir):
    from pyspark.sql import functions as F

    return tables.event_transactions(spark, sf_dir).select(
        "seq", "amount", "merchant", "direction", F.col("ts").cast("timestamp").alias("ts"), "reference_ids")


@register("streaming_ingest")
def streaming_ingest(spark, sf_dir):
    """ST-1: the nightly run as a stream with a commit log: an epoch without payments, an epoch with the whole archive, both
    replayed; the new ledger rows with their audit entries as read back from the committed version."""
    from pyspark.sql import functions as F

    from spendlake.config import DEFAULT_ALLOWED_SENDERS
    from spendlake.operators.filters import sender_match
    from spendlake.session import scratch_path
    from spendlake.sources.versions import AUDIT, VersionedTables, read_expenses
    from spendlake.streaming.ingest import PROCESSED, ingest_epoch, ingest_stream

    msgs, led, cp = run_inputs(spark, sf_dir)
    source, root, progress = (scratch_path(spark, x) for x in ("st1-in", "st1", "st1-ckpt"))
    store = VersionedTables(spark, root)
    names = [f"`{x.split()[0].strip('`')}`" for x in PROCESSED.split(", ")]
    seeds = {"expenses": store.write("expenses", led)[0], "processed": store.write("processed", cp.select(*names))[0]}
    store.commit(store.version(), {t: {"": [f]} for t, f in seeds.items()})
    high = led.agg(F.max("id")).first()[0] or 0
    allowed = F.coalesce(sender_match(F.col("sender_email"), DEFAULT_ALLOWED_SENDERS), F.lit(False))
    for k, part in enumerate((msgs.where(~allowed), msgs.where(allowed))):
        part.write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(part.schema).parquet(f"{source}/*")
        ingest_stream(stream, root, progress, RUN_AS_OF).awaitTermination()
        ingest_epoch(store, spark.read.schema(part.schema).parquet(f"{source}/{k}"), k, RUN_AS_OF)  # a replay
    audit = store.read("audit", AUDIT).where("action = 'BULK_INSERT_ROW'").select(F.col("row_id").alias("id"), "action")
    return read_expenses(store).where(F.col("id") > high).join(audit, "id", "left").select(
        "id", "amount", "category", "description", "transaction_date", "action")


@register("streaming_reference_dedup")
def streaming_reference_dedup(spark, sf_dir):
    """ST-3: every event's reference in a stream of several pieces, and whether it was seen in the seven days before."""
    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import file_stream, reference_stream, run_to_table

    rows = arriving_events(spark, sf_dir).select("seq", "ts", "reference_ids")
    source, out, progress = (scratch_path(spark, x) for x in ("st3-in", "st3-out", "st3-ckpt"))
    stream = lambda: run_to_table(
        reference_stream(file_stream(spark, f"{source}/*", rows.schema)), out, progress, "append")
    return arrive(spark, rows, "ts", source, stream).select("seq", "ref", "seen_before")


@register("streaming_first_match")
def streaming_first_match(spark, sf_dir):
    """ST-4: batch events joined with ledger events as two streams of several pieces: first match with score
    and status per batch event, nulls where there is none."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import file_stream, run_to_table, soft_match_stream

    rows = arriving_events(spark, sf_dir).drop("reference_ids")
    source, out, progress = (scratch_path(spark, x) for x in ("st4f-in", "st4f-out", "st4f-ckpt"))
    split = lambda day: F.lit(day).cast("timestamp")

    def stream():
        new, old = (file_stream(spark, f"{source}/*", rows.schema) for _ in range(2))
        new = new.where(F.col("ts") >= split(tables.BATCH_START))
        old = old.where((F.col("ts") < split(tables.LEDGER_END)) | F.col("seq").isNull()).withColumnRenamed("seq", "id")
        return run_to_table(soft_match_stream(new, old.withColumn("direction", F.lit("debit")), salts=2), out, progress, "append")

    return arrive(spark, rows, "ts", source, stream).where("seq is not null")


def _closed_spend(spark, sf_dir, period):
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.streaming.ingest import closed_spend, file_stream, run_to_table

    rows = tables.read_table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"))
    source, out, progress = (scratch_path(spark, x) for x in ("st5c-in", "st5c-out", "st5c-ckpt"))
    stream = lambda: run_to_table(
        closed_spend(file_stream(spark, f"{source}/*", rows.schema), period), out, progress, "append")
    return arrive(spark, rows, "ts", source, stream).where("key is not null").select(
        F.date_format("start", "yyyy-MM-dd").alias("start"), F.col("key").alias("category"), F.round("spent", 2).alias("spent"), "n")


@register("streaming_closed_weeks")
def streaming_closed_weeks(spark, sf_dir):
    """ST-5 in append mode: spend per priority of each closed week, rolled up from closed days."""
    return _closed_spend(spark, sf_dir, "weekly")


@register("streaming_closed_months")
def streaming_closed_months(spark, sf_dir):
    """ST-5 in append mode: spend per priority of each closed month, rolled up from closed days."""
    return _closed_spend(spark, sf_dir, "monthly")


# ---------------------------------------------------------------------------
# Tables written and read back (SRC-6, SNK-1, SNK-2, SNK-4, MUT-7, REV-4)
# ---------------------------------------------------------------------------

@register("csv_export")
def csv_export(spark, sf_dir):
    """SNK-1: the ledger (deleted rows included) and the budgets exported as CSV and read back."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.sources.io import export_csv

    state = ledger_state(spark, sf_dir).select("id", "amount", "category", "description", "transaction_date")
    _, bu = ledger(spark, sf_dir)
    budgets = bu.select("month_key", "category", "budget_limit")
    path = scratch_path(spark, "csv")
    export_csv({"expenses": state, "budgets": budgets, "nothing": state.limit(0)}, path)
    back = lambda df, name: spark.read.schema(df.schema).option("header", True).csv(f"{path}/{name}")
    expenses = back(state, "expenses").select(
        F.lit("expenses").alias("kind"), F.col("id").cast("string").alias("key"), "category", F.col("amount").alias("value"))
    return expenses.unionByName(back(budgets, "budgets").select(
        F.lit("budgets").alias("kind"), F.coalesce("month_key", F.lit("")).alias("key"), "category",
        F.col("budget_limit").cast("double").alias("value")))


@register("checkpoint_scan")
def checkpoint_scan(spark, sf_dir):
    """SRC-6 + SNK-3: the checkpoint appended as JSON lines in two runs, with torn lines between them, read back."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.sources.io import append_checkpoint, read_checkpoint

    cp = tables.checkpoint_from_events(spark, sf_dir).select(
        "email_uid", "message_id", F.lit("events").alias("from"), F.lit("Alert").alias("subject"), "processed_at",
        F.lit("new").alias("result"), F.array(F.col("seq")).alias("ledger_ids"), "reference_ids")
    path = scratch_path(spark, "checkpoint")
    half = F.pmod(F.xxhash64("message_id"), F.lit(2)) == 0
    append_checkpoint(cp.where(half), path)
    torn = cp.select(F.concat(F.lit('{"email_uid": "torn-'), F.col("email_uid"), F.lit('", "message')).alias("value"))
    torn.write.mode("append").text(path)
    append_checkpoint(cp.where(~half), path)
    return read_checkpoint(spark, path).select(
        "email_uid", "message_id", F.substring("processed_at", 1, 19).alias("processed_at"), F.col("ledger_ids")[0].alias("ledger_id"))


@register("run_output")
def run_output(spark, sf_dir):
    """SNK-4: the candidates and the summary of two runs written, the first run written again, and read back."""
    from pyspark.sql import functions as F

    from spendlake.session import scratch_path
    from spendlake.sources.io import write_run_output

    run, path = ingest_run(spark, sf_dir), scratch_path(spark, "runs")
    cands = run.candidates.select("number", "seq", "dedup_status")
    for name, rows in (("a", cands.limit(0)), ("b", cands), ("a", cands)):
        write_run_output(rows, run.summary, path, name)
    back = spark.read.parquet(f"{path}/candidates").groupBy("run_id", "dedup_status").agg(F.count(F.lit(1)).alias("n"))
    total = spark.read.parquet(f"{path}/summary").select(F.col("run_id"), F.lit("total").alias("dedup_status"),
                                                         F.col("total_emails_processed").alias("n"))
    return back.unionByName(total)


@register("published_changes")
def published_changes(spark, sf_dir):
    """MUT-1 + MUT-2 + MUT-5 + MUT-6 + SNK-2: the ledger published as versions: urgent orders deleted, low ones recategorised, a
    bulk edit; the newest version as read back, with the audit entries of each row counted."""
    from pyspark.sql import functions as F

    return _published(spark, sf_dir)[0].select("id", "amount", "category", F.col("deleted_at").isNotNull().alias("deleted"), "changes")


@register("audit_histories")
def audit_histories(spark, sf_dir):
    """MUT-7: the audit entries of every changed row, oldest first, from the published audit table."""
    from pyspark.sql import functions as F

    _, audit = _published(spark, sf_dir)
    steps = F.array_sort(F.collect_list(F.struct("id", "action")))  # as many as changes of one row
    return audit.where("row_id is not null").groupBy("row_id").agg(steps.alias("s")).select(
        "row_id", F.array_join(F.transform("s", lambda x: x["action"]), ",").alias("actions"))


def _published(spark, sf_dir):
    from pyspark.sql import functions as F

    from spendlake.operators.mutations import EXPENSE_COLS, audit_frame, recategorise, snapshot, soft_delete
    from spendlake.session import scratch_path, written
    from spendlake.sources import versions

    store = versions.VersionedTables(spark, scratch_path(spark, "published"))
    orders = tables.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    state = written(ledger_state(spark, sf_dir).select(*EXPENSE_COLS), "ledger")  # derived once, read by each step of the publication
    first = audit_frame(state, "INSERT", "expenses", F.col("id"), None, snapshot(), MUT_AS_OF)
    versions.publish_change(store, state, first, state.select("id"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("id")
    low = orders.where("o_orderpriority = '5-LOW'").select("id", F.lit("DEFERRED").alias("new_category"))
    for change, ids in ((soft_delete, urgent), (recategorise, low)):
        new, audit, _ = change(versions.read_expenses(store), ids, MUT_AS_OF)
        versions.publish_change(store, new, audit, ids.select("id"))
    versions.publish_bulk_edit(store, PUBLISHED_WHERE, {"amount": "amount + 1"}, MUT_AS_OF)
    audit = store.read("audit", versions.AUDIT)
    changes = audit.groupBy(F.col("row_id").alias("id")).agg(F.count(F.lit(1)).alias("changes"))
    return versions.read_expenses(store).join(changes, "id", "left"), audit


PUBLISHED_WHERE = "category = 'DEFERRED' AND amount >= 100000"


@register("reprocess_range_summary")
def reprocess_range_summary(spark, sf_dir):
    """REV-4 with a date range: the messages of three days reprocessed, whether processed or not; summary counts."""
    from spendlake.plans.runs import run_batch

    msgs, led, cp = run_inputs(spark, sf_dir)
    return run_batch(msgs, led, cp.drop("seq"), RUN_AS_OF, reprocess=True, dates=REPROCESS_DAYS).summary


REPROCESS_DAYS = ("2024-01-16", "2024-01-18")
