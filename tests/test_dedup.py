"""Dedup: soft score table (F7), hard match, precedence, and the batch rule against a
sequential fold of the surveyed loop on random batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from spendlake.config import DedupSettings
from spendlake.operators.dedup import batch_statuses, deduplicate, hard_matches, known_references, soft_match_pairs

S = DedupSettings()
T0 = dt.datetime(2026, 3, 20, 12, 0, 0)
CAND = "seq bigint, has_txn boolean, amount double, merchant string, direction string, txn_ts timestamp_ntz, reference_ids map<string,string>"
LEDG = "id bigint, amount double, description string, merchant string, direction string, txn_ts timestamp_ntz"


def pair_status(spark, a, b):
    """Status of candidate a against existing b: (amount, merchant, minutes, direction_a, direction_b)."""
    c = spark.createDataFrame([(1, True, a[0], a[1], a[3], None if a[2] is None else T0, {})], CAND)
    t = None if b[2] is None else T0 + dt.timedelta(minutes=b[2])
    e = spark.createDataFrame([(7, b[0], b[1], b[1], b[3], t)], LEDG)
    rows = soft_match_pairs(c, e, S).collect()
    return rows[0].status if rows else None


def test_soft_score_table(spark):
    assert pair_status(spark, (80.0, "swiggy", 0, "debit"), (80.0, "Swiggy", 0, "debit")) == "auto_merged"
    assert pair_status(spark, (80.0, "swiggy", 0, "debit"), (80.0, "swiggy", 5, "debit")) == "auto_merged"
    for minutes in (5 * 60, 25 * 60, 49 * 60, 3 * 24 * 60):
        assert pair_status(spark, (80.0, "swiggy", 0, "debit"), (80.0, "swiggy", minutes, "debit")) is None
    assert pair_status(spark, (500.0, "amazon", 0, "debit"), (500.0, "flipkart", 0, "debit")) == "probable_duplicate"
    assert pair_status(spark, (450.0, "swiggy", 0, "debit"), (800.0, "swiggy", 0, "debit")) is None
    assert pair_status(spark, (80.0, "swiggy", 0, "debit"), (80.0, "swiggy", 0, "credit")) == "auto_merged"
    assert pair_status(spark, (80.0, "swiggy", None, "debit"), (80.0, "swiggy", None, "debit")) is None
    assert pair_status(spark, (80.0, "swiggy", 0, "debit"), (80.0, "swiggy", 90, "debit")) == "probable_duplicate"


def test_hard_match_case_insensitive(spark):
    cp = spark.createDataFrame([("u1", "<m1>", "2026-03-20 10:00:00", {"order_id": "swg-123"}, 1)],
                               "email_uid string, message_id string, processed_at string, reference_ids map<string,string>, seq bigint")
    known = known_references(cp, "2026-03-23 00:00:00", 7)
    c = spark.createDataFrame([(5, True, 1.0, "x", "debit", T0, {"ref_no": "SWG-123"}),
                               (6, True, 1.0, "x", "debit", T0, {"ref_no": ""})], CAND)
    assert [r.seq for r in hard_matches(c, known).collect()] == [5]
    old = known_references(cp, "2026-04-30 00:00:00", 7)
    assert hard_matches(c, old).count() == 0


def test_precedence_and_batch(spark):
    cp = spark.createDataFrame([], "email_uid string, message_id string, processed_at string, reference_ids map<string,string>, seq bigint")
    known = known_references(cp, "2026-03-23 00:00:00", 7)
    ledger = spark.createDataFrame([], LEDG)
    c = spark.createDataFrame([
        (1, True, 120.0, "swiggy", "debit", T0, {"order_id": "A1"}),
        (2, True, 120.0, "swiggy", "debit", T0 + dt.timedelta(minutes=3), {}),
        (3, False, None, None, None, None, {}),
    ], CAND)
    got = {r.seq: r.dedup_status for r in deduplicate(c, ledger, known, S).collect()}
    assert got == {1: "new", 2: "auto_merged", 3: "new"}


def sequential(rows):
    """The surveyed loop (batch stage only) in plain Python."""
    def score(a, b):
        s = 0.0
        gap = abs((a["ts"] - b["ts"]).total_seconds()) / 60
        if gap / 60 > S.max_date_gap_hours:
            return None
        s += 1.5 if gap <= S.time_window_minutes else (-2 if gap / 60 > 24 else (-1 if gap / 60 > 2 else 0))
        s += 2 if abs(a["amount"] - b["amount"]) <= S.amount_tolerance else 0
        ma, mb = a["merchant"].lower().strip(), b["merchant"].lower().strip()
        s += 1 if ma and mb and (ma in mb or mb in ma) else 0
        s += 0.5
        return s >= 3.5

    status, seen = {}, []
    for r in rows:
        hit = next((p for p in seen if score(r, p)), None)
        if hit is None:
            status[r["seq"]] = "new"
            seen.append(r)
        elif r["nrefs"] > hit["nrefs"]:
            status[hit["seq"]] = "auto_merged"
            status[r["seq"]] = "new"
        else:
            status[r["seq"]] = "auto_merged"
    return status


def test_batch_rule_matches_sequential_fold(spark):
    rnd = random.Random(7)
    for trial in range(4):
        rows = []
        for i in range(60):
            rows.append({
                "seq": i, "amount": float(rnd.choice([10, 10.5, 11, 50, 51])), "merchant": rnd.choice(["ab", "abc", "x", "xy"]),
                "ts": T0 + dt.timedelta(minutes=rnd.randrange(0, 300)), "nrefs": rnd.randrange(0, 3),
            })
        df = spark.createDataFrame(
            [(r["seq"], True, r["amount"], r["merchant"], "debit", r["ts"], {f"k{j}": f"v{r['seq']}_{j}" for j in range(r["nrefs"])})
             for r in rows], CAND)
        got = {r.seq: r.batch_status for r in batch_statuses(df, S).collect()}
        assert got == sequential(rows), f"trial {trial}"


def test_hot_group_of_copies_matches_sequential(spark):
    """A third of the batch is one re-delivered transaction (same amount, merchant, minute)."""
    rnd = random.Random(11)
    rows = []
    for i in range(90):
        if i % 3 == 0:
            rows.append({"seq": i, "amount": 99.0, "merchant": "hot", "ts": T0, "nrefs": rnd.randrange(0, 3)})
        else:
            rows.append({"seq": i, "amount": float(rnd.choice([10, 10.5, 99, 99.5, 40])), "merchant": rnd.choice(["hot", "ho", "x"]),
                         "ts": T0 + dt.timedelta(minutes=rnd.randrange(0, 200)), "nrefs": rnd.randrange(0, 3)})
    df = spark.createDataFrame(
        [(r["seq"], True, r["amount"], r["merchant"], "debit", r["ts"], {f"k{j}": f"v{r['seq']}_{j}" for j in range(r["nrefs"])})
         for r in rows], CAND)
    got = {r.seq: r.batch_status for r in batch_statuses(df, S).collect()}
    assert got == sequential(rows)
    ledger = spark.createDataFrame([(500 + k, 99.0, "hot", "hot", "debit", T0) for k in range(5)]
                                   + [(600, 99.0, "hot", "hot", "debit", T0 + dt.timedelta(minutes=20))], LEDG)
    from spendlake.operators.dedup import first_ledger_match
    fm = {r.seq: (r.ledger_id, r.ledger_status) for r in first_ledger_match(df, ledger, S).collect()}
    assert fm[0] == (600, "auto_merged")  # newest first: the 20-minute-later row wins
    assert all(fm[i] == (600, "auto_merged") for i in range(0, 90, 3))


def _batch(spark, rows):
    return spark.createDataFrame(
        [(seq, True, amt, m, "debit", T0 + dt.timedelta(minutes=mins), {f"k{j}": f"v{seq}{j}" for j in range(nref)})
         for seq, amt, m, mins, nref in rows], CAND)


def test_batch_options_flag_and_single_survivor(spark):
    from dataclasses import replace

    rows = [(1, 50.0, "shop", 0, 0), (2, 50.0, "other", 5, 0), (3, 50.0, "shop", 6, 1), (4, 50.0, "shop", 7, 1)]
    df = _batch(spark, rows)
    merge = {r.seq: r.batch_status for r in batch_statuses(df, S).collect()}
    assert merge == {1: "auto_merged", 2: "auto_merged", 3: "new", 4: "new"}  # two richer followers both stay new
    flag = {r.seq: r.batch_status for r in batch_statuses(df, replace(S, batch_probable="flag")).collect()}
    assert flag[2] == "probable_duplicate" and flag[3] == "new"
    single = {r.seq: r.batch_status for r in batch_statuses(df, replace(S, single_survivor=True)).collect()}
    assert single == {1: "auto_merged", 2: "auto_merged", 3: "new", 4: "auto_merged"}


def test_hard_within_batch_option(spark):
    from dataclasses import replace

    cp = spark.createDataFrame([], "email_uid string, message_id string, processed_at string, reference_ids map<string,string>, seq bigint")
    known = known_references(cp, "2026-03-23 00:00:00", 7)
    ledger = spark.createDataFrame([], LEDG)
    c = spark.createDataFrame([(1, True, 10.0, "a", "debit", T0, {"utr": "R9"}),
                               (2, True, 900.0, "b", "debit", T0 + dt.timedelta(days=3), {"order_id": "r9"})], CAND)
    assert {r.seq: r.dedup_status for r in deduplicate(c, ledger, known, S).collect()} == {1: "new", 2: "new"}
    got = {r.seq: r.dedup_status for r in deduplicate(c, ledger, known, replace(S, hard_within_batch=True)).collect()}
    assert got == {1: "new", 2: "definite_duplicate"}


def test_long_chain_many_rounds(spark):
    """Same charge every 25 minutes: every node matches the ones within 2 h, so the
    election needs many rounds; the result must still equal the sequential fold."""
    rows = [{"seq": i, "amount": 30.0, "merchant": "metro", "ts": T0 + dt.timedelta(minutes=25 * i), "nrefs": (i * 7) % 3}
            for i in range(45)]
    df = spark.createDataFrame(
        [(r["seq"], True, r["amount"], r["merchant"], "debit", r["ts"], {f"k{j}": f"v{r['seq']}_{j}" for j in range(r["nrefs"])})
         for r in rows], CAND)
    got = {r.seq: r.batch_status for r in batch_statuses(df, S).collect()}
    assert got == sequential(rows)
