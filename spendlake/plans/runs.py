"""An ingestion run as one Spark job graph (REV-1..4, WIN-1, AGG-8, JN-8, JN-10, FLT-5..8,
PRJ-1, SNK-3, MUT-8).

run_batch: sender filter -> already-processed anti join -> pattern extraction ->
parser stats -> known references -> dedup (hard, ledger, batch) -> category
suggestion + confidence gate -> ledger append with dense ids -> id back-join ->
checkpoint rows -> checkpoint pruning -> run summary / review table.

Persist points (reliable checkpoints): the parse result, and the dedup statuses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.config import (
    STATUS_AUTO,
    STATUS_DEFINITE,
    STATUS_NEW,
    STATUS_PROBABLE,
    DedupSettings,
    Settings,
)
from spendlake.functions.timeutil import parse_time
from spendlake.operators.dedup import deduplicate, known_references
from spendlake.operators.extract import extract_transactions, parser_stats
from spendlake.operators.filters import insertable, ledger_lookback, ledger_payload, prune_checkpoint, split_by_sender
from spendlake.operators.mutations import EXPENSE_COLS, set_audit, prepare_appends
from spendlake.operators.suggest import gate_category, suggest_categories
from spendlake.session import assign_dense_ids, cut_lineage
from spendlake.sources.io import messages_in_range, unprocessed

@dataclass
class RunResult:
    candidates: DataFrame
    parse_totals: DataFrame
    pattern_breakdown: DataFrame
    appended: DataFrame
    new_ledger: DataFrame
    audit: DataFrame
    checkpoint_rows: DataFrame
    checkpoint_all: DataFrame
    checkpoint_kept: DataFrame
    checkpoint_pruned: DataFrame
    summary: DataFrame


def candidate_inputs(parsed: DataFrame) -> DataFrame:
    """Dedup inputs from parse results (transaction dates carry no time of day)."""
    t = F.col("transaction")
    return parsed.select(
        "seq",
        t.isNotNull().alias("has_txn"),
        t["amount"].alias("amount"),
        t["merchant"].alias("merchant"),
        t["direction"].alias("direction"),
        parse_time(t["transaction_date"]).alias("txn_ts"),
        F.coalesce(t["reference_ids"], F.create_map().cast("map<string,string>")).alias("reference_ids"),
    )


def reprocess_since(cands: DataFrame, as_of: str, s: DedupSettings) -> Column:
    """Ledger look-back of a reprocessed batch: its first date less the hard cutoff."""
    first = cands.agg(F.min(F.to_date("txn_ts"))).first()[0]
    return F.date_sub(F.lit(str(first or as_of)).cast("date"), int(-(-s.max_date_gap_hours // 24)))


def run_batch(
    messages: DataFrame,
    ledger: DataFrame,
    processed: DataFrame,
    as_of_ts: str,
    settings: Settings = Settings(),
    reprocess: bool = False,
    dates: tuple[str, str] | None = None,
) -> RunResult:
    """REV-3 (``reprocess=False``) / REV-4 (``reprocess=True``: no processed check,
    90-day reference horizon, ledger look-back from the batch's first date, checkpoint
    rows only for inserted messages).

    ``dates``: only messages received on these days (first and last, both included), whether processed or not.

    ``messages``: seq, email_uid, message_id, from, sender_email, subject, body, received_at.
    ``ledger``: expenses columns (id, amount, category, description, transaction_date, deleted_at, ...).
    ``processed``: checkpoint rows (email_uid, message_id, processed_at, reference_ids, seq?)."""
    s = settings
    as_of = as_of_ts[:10]
    if dates is not None:
        messages = messages_in_range(messages, *dates)
    allowed, _ = split_by_sender(messages, s.allowed_senders)
    todo = allowed if reprocess else unprocessed(allowed, processed)
    parsed = cut_lineage(extract_transactions(todo, as_of=as_of, word_boundary=s.merchant_word_boundary))
    totals, breakdown = parser_stats(parsed)

    proc = processed if "seq" in processed.columns else processed.withColumn("seq", F.lit(0).cast("bigint"))
    known = known_references(proc, as_of_ts, s.reprocess_known_ref_days if reprocess else s.dedup.known_ref_days)
    cands = candidate_inputs(parsed)
    if reprocess:
        since = reprocess_since(cands, as_of, s.dedup)
    else:
        since = F.date_sub(F.lit(as_of).cast("date"), s.dedup.ledger_lookback_days)
    led = ledger_lookback(ledger, since).withColumn("txn_ts", parse_time(F.col("transaction_date")))
    statuses = cut_lineage(deduplicate(cands, led, known, s.dedup))
    cand = parsed.join(statuses, "seq", "left")

    # Category: suggestion from past entries keyed by the merchant, gated by confidence.
    ins = insertable(cand).withColumn("_term", F.lower(F.col("transaction.merchant")))
    sugg = suggest_categories(ledger, ins.select(F.col("_term").alias("term")), default_category=s.default_category,
                              min_confidence=s.auto_category_min_confidence)
    ins = ins.join(sugg.select(F.col("term").alias("_term"), F.col("suggested").alias("_sugg"),
                               F.col("confidence").alias("_sconf")), "_term", "left").withColumn(
        "category", gate_category(F.col("_sugg"), F.coalesce("_sconf", F.lit(0)), s.default_category,
                                  s.auto_category_min_confidence)
    )
    payload = ledger_payload(ins, as_of).select(
        "seq", "email_uid",
        F.col("amount").cast("string").alias("amount"),
        F.col("payload_category").alias("category"),
        F.col("payload_description").alias("description"),
        F.col("payload_date").alias("date"),
    )
    high = ledger.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    appended = cut_lineage(prepare_appends(payload, as_of_ts, ["seq"], high, carry=("seq", "email_uid")))
    new_ledger = ledger.select(*EXPENSE_COLS).unionByName(appended.select(*EXPENSE_COLS))
    audit = set_audit(appended.select("id"), "BULK_INSERT", "expenses", "new", as_of_ts)

    # JN-10: message -> ledger ids.
    ids = appended.groupBy("email_uid").agg(F.sort_array(F.collect_list("id")).alias("ledger_ids"))
    cp_src = cand if not reprocess else cand.join(appended.select("seq"), "seq", "left_semi")
    checkpoint_rows = cp_src.join(ids, "email_uid", "left").select(
        "email_uid", "message_id", "from", "subject",
        F.lit(as_of_ts).cast("timestamp_ntz").alias("processed_at"),
        F.col("dedup_status").alias("result"),
        F.coalesce("ledger_ids", F.array().cast("array<bigint>")).alias("ledger_ids"),
        F.coalesce(F.col("transaction.reference_ids"), F.create_map().cast("map<string,string>")).alias("reference_ids"),
    )
    all_cp = processed.select(*[c for c in checkpoint_rows.columns]).unionByName(checkpoint_rows)
    kept, pruned = prune_checkpoint(all_cp, as_of_ts, s.prune_after_days)
    summary = run_summary(cand, appended)
    numbered = assign_dense_ids(cand, ["seq"], 0, id_col="number")
    return RunResult(numbered, totals, breakdown, appended, new_ledger, audit, checkpoint_rows, all_cp, kept, pruned, summary)


def run_summary(cand: DataFrame, appended: DataFrame) -> DataFrame:
    """AGG-8: totals of a run; 'inserted' counts messages whose rows were appended."""
    ins = cand.join(appended.select("seq").distinct().withColumn("_ins", F.lit(True)), "seq", "left")
    st = F.col("dedup_status")
    return ins.agg(
        F.count(F.lit(1)).alias("total_emails_processed"),
        F.count_if(F.coalesce(F.col("_ins"), F.lit(False))).alias("inserted"),
        F.count_if(st.isin(STATUS_DEFINITE, STATUS_AUTO)).alias("duplicates_skipped"),
        F.count_if(st == STATUS_PROBABLE).alias("probable_duplicates_flagged"),
        F.count_if(F.col("parse_method") == "llm_needed").alias("llm_parsing_needed"),
    )


def review_table(numbered: DataFrame) -> DataFrame:
    """REV-1 + WIN-1: one line per candidate in sections new / needs_review / duplicate /
    manual, ordered by section then run number; rows with no transaction that are not
    manual are skipped."""
    st = F.col("dedup_status")
    manual = F.col("parse_method") == "llm_needed"
    has_txn = F.col("transaction").isNotNull()
    section = (
        F.when(manual, F.lit("manual"))
        .when(has_txn & (st == STATUS_NEW), F.lit("new"))
        .when(has_txn & (st == STATUS_PROBABLE), F.lit("needs_review"))
        .when(has_txn & st.isin(STATUS_AUTO, STATUS_DEFINITE), F.lit("duplicate"))
    )
    rank = F.when(section == "new", 1).when(section == "needs_review", 2).when(section == "duplicate", 3).otherwise(4)
    return numbered.select(
        "number",
        section.alias("section"),
        rank.alias("section_rank"),
        F.col("transaction.amount").alias("amount"),
        F.col("transaction.merchant").alias("merchant"),
        F.col("transaction.transaction_date").alias("transaction_date"),
        F.coalesce("merged_with_ledger_id", "probable_match_ledger_id").alias("matched_ledger_id"),
        F.when(manual, F.coalesce("subject", F.lit("?"))).alias("subject"),
    ).where(F.col("section").isNotNull()).orderBy("section_rank", "number")


def review_headline(summary: DataFrame) -> DataFrame:
    """REV-2: headline counts (processed always; other sections only when non-zero)."""
    long = summary.select(F.expr(
        "stack(5, 'processed', total_emails_processed, 'new', inserted, 'duplicates', duplicates_skipped, "
        "'flagged', probable_duplicates_flagged, 'manual', llm_parsing_needed) AS (line, n)"
    ))
    return long.where((F.col("line") == "processed") | (F.col("n") > 0))


# ---------------------------------------------------------------------------
# MUT-8: review corrections keyed by run number
# ---------------------------------------------------------------------------

def apply_corrections(ledger: DataFrame, numbered: DataFrame, appended: DataFrame, corrections: DataFrame,
                      as_of_ts: str):
    """MUT-8: corrections (number, action, value) -> ledger changes.

    actions: delete / not_a_transaction (soft delete), amount (new amount), recategorise
    (new category), merge (value = other number; keep the row with more reference ids,
    then the longer description; soft-delete the other), confirm (no-op).
    Several amounts for one number: the greatest is taken.  Returns (new_ledger, audit,
    rejects); rejects are the corrections with an unknown number or action, an amount that
    is no number, a merge with an unknown number, and those of rows that are missing or already deleted when their step
    comes (deletes and merges, then categories, then amounts)."""
    from spendlake.operators.mutations import audit_frame, recategorise, snapshot, soft_delete

    ids = numbered.select("number", "seq", F.size(F.coalesce(F.col("transaction.reference_ids"),
                                                             F.create_map())).alias("n_refs")).join(
        appended.select("seq", "id", "description"), "seq")
    c = corrections.join(ids, "number")
    deletes = c.where(F.col("action").isin("delete", "not_a_transaction")).select("id")
    other = ids.select(F.col("number").alias("o_number"), F.col("id").alias("o_id"), F.col("n_refs").alias("o_refs"),
                       F.col("description").alias("o_desc"))
    merges = c.where(F.col("action") == "merge").join(other, F.col("value").try_cast("bigint") == F.col("o_number"))
    keep_self = (F.col("n_refs") > F.col("o_refs")) | (
        (F.col("n_refs") == F.col("o_refs")) & (F.length("description") >= F.length("o_desc")))
    merge_drop = merges.select(F.when(keep_self, F.col("o_id")).otherwise(F.col("id")).alias("id"))
    state, a1, gone = soft_delete(ledger.select(*EXPENSE_COLS), deletes.unionByName(merge_drop), as_of_ts)
    recat = c.where(F.col("action") == "recategorise").select("id", F.col("value").alias("new_category"))
    state, a2, unchanged = recategorise(state, recat, as_of_ts)
    amounts = c.where(F.col("action") == "amount").groupBy(F.col("id").alias("_aid")).agg(
        F.max(F.col("value").try_cast("double")).alias("_amt")).where("_amt is not null")
    j = state.join(amounts, state.id == amounts._aid, "left")
    hit = F.col("_aid").isNotNull() & F.col("deleted_at").isNull()
    stamp = F.lit(as_of_ts).cast("timestamp_ntz")
    new_cols = {
        "amount": F.when(hit, F.col("_amt")).otherwise(F.col("amount")),
        "updated_on": F.when(hit, stamp).otherwise(F.col("updated_on")),
    }
    changed = j.where(hit).select(
        *[F.col(x).alias(f"o_{x}") for x in EXPENSE_COLS],
        *[new_cols.get(x, F.col(x)).alias(f"n_{x}") for x in EXPENSE_COLS],
    )
    a3 = audit_frame(changed, "UPDATE", "expenses", F.col("o_id"), snapshot(prefix="o_"), snapshot(prefix="n_"), as_of_ts)
    inactive = amounts.join(state.where("deleted_at is null").select(F.col("id").alias("_aid")), "_aid", "left_anti")
    state = j.select(*[new_cols.get(x, F.col(x)).alias(x) for x in EXPENSE_COLS])
    known = ids.select(F.col("number").alias("_known")).distinct()
    others = known.select(F.col("_known").cast("bigint").alias("_other"))
    checked = corrections.join(known, F.col("number") == F.col("_known"), "left").join(
        others, (F.col("action") == "merge") & (F.col("value").try_cast("bigint") == F.col("_other")), "left")
    fine = F.col("_known").isNotNull() & (
        F.col("action").isin("delete", "not_a_transaction", "recategorise", "confirm")
        | ((F.col("action") == "amount") & F.col("value").try_cast("double").isNotNull())
        | ((F.col("action") == "merge") & F.col("_other").isNotNull()))
    asked = ["number", "action", "value"]
    rejects = checked.where(~F.coalesce(fine, F.lit(False))).select(*asked)
    # what named a row that its step found missing or deleted
    steps = (
        (c.where(F.col("action").isin("delete", "not_a_transaction")), gone.select("id")),
        (merges.select(*asked, F.when(keep_self, F.col("o_id")).otherwise(F.col("id")).alias("id")), gone.select("id")),
        (c.where(F.col("action") == "recategorise"), unchanged.select("id")),
        (c.where((F.col("action") == "amount") & F.col("value").try_cast("double").isNotNull()), inactive.select(F.col("_aid").alias("id"))),
    )
    for given, missed in steps:
        rejects = rejects.unionByName(given.join(missed.distinct(), "id", "left_semi").select(*asked))
    return state, a1.unionByName(a2).unionByName(a3), rejects
