"""Ranged leader election, the sorted sweep over the ledger and the salted band join against plain loops."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spendlake.config import DedupSettings
from spendlake.operators import dedup

S = DedupSettings()
T0 = dt.datetime(2026, 3, 20, 12, 0, 0)
CAND = "seq bigint, amount double, merchant string, direction string, txn_ts timestamp_ntz, reference_ids map<string,string>"
LEDG = "id bigint, amount double, description string, merchant string, direction string, txn_ts timestamp_ntz"


def score(a, b, s=S):
    """(status, reasons) of two rows (key, amount, merchant, direction, time) after the scoring table."""
    points, why = 0.0, []
    if a[4] and b[4]:
        gap = abs((a[4] - b[4]).total_seconds()) / 60
        if gap / 60 > s.max_date_gap_hours:
            return None, why
        if gap <= s.time_window_minutes:
            points, why = 1.5, ["time_within_window"]
        elif gap / 60 > 24:
            points, why = -2.0, ["gap_over_24h"]
        elif gap / 60 > 2:
            points, why = -1.0, ["gap_over_2h"]
    else:
        points, why = -1.0, ["time_unknown"]
    if abs(a[1] - b[1]) <= s.amount_tolerance:
        points, why = points + 2, [*why, "amount"]
    x, y = (a[2] or "").lower().strip(), (b[2] or "").lower().strip()
    if x and y and (x in y or y in x):
        points, why = points + 1, [*why, "merchant"]
    if (a[3] or "debit") == (b[3] or "debit"):
        points, why = points + 0.5, [*why, "direction"]
    return ("auto_merged" if points >= 4.5 else "probable_duplicate" if points >= 3.5 else None), why


def rows_of(rng, n, minutes=400, copies=True):
    rows = []
    for i in range(n):
        if copies and rows and rng.random() < 0.2:
            rows.append((i, *rng.choice(rows)[1:]))
        else:
            when = None if rng.random() < 0.05 else T0 + dt.timedelta(minutes=rng.randrange(-minutes, minutes), microseconds=rng.choice([0, 0, 1]))
            rows.append((i, rng.choice([10.0, 10.5, 11.0, 11.5, 12.0, 40.0]), rng.choice(["ab", " ABC", "x", "", None, "xy"]),
                         rng.choice(["debit", "credit", None]), when))
    return rows


def cands(spark, rows):
    return spark.createDataFrame([(*r, {}) for r in rows], CAND)


def ledger(spark, rows):
    return spark.createDataFrame([(k, a, m or "", m, d, t) for k, a, m, d, t in rows], LEDG)


def fold(rows):
    leaders, out = [], {}
    for r in rows:
        hit = next((x for x in leaders if score(r, x)[0]), None)
        out[r[0]] = hit[0] if hit else r[0]
        if not hit:
            leaders.append(r)
    return out


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_election_by_ranges_equals_the_fold(spark, range_rows):
    rows = rows_of(random.Random(range_rows), 90)
    got = {r.seq: r.leader_seq for r in dedup.batch_leaders(cands(spark, rows), S, range_rows).collect()}
    assert got == fold(rows)


def test_chain_of_fifty_thousand_links(spark):
    """Every row matches the ones up to two hours before and after: 25 minutes apart, same merchant."""
    n = 50_000
    chain = spark.range(n).select(
        F.col("id").alias("seq"), F.lit(30.0).alias("amount"), F.lit("metro").alias("merchant"), F.lit("debit").alias("direction"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 25 * id)").alias("txn_ts"))
    got = dedup.batch_leaders(chain, S, range_rows=20_000)
    # a leader covers the four rows after it (100 minutes); the next one leads again
    assert got.where(F.col("leader_seq") != F.col("seq") - F.col("seq") % 5).count() == 0
    assert got.count() == n


def test_a_third_of_all_rows_in_one_bucket(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 99.0).otherwise(F.col("id") * 5.0).alias("amount"),
        F.concat(F.lit("m"), F.col("id") % 50).alias("merchant"), F.lit("debit").alias("direction"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, (id % 3) * 86400 + id * 0.01)").alias("txn_ts"))
    got = dedup.batch_leaders(rows, S, range_rows=25_000)
    assert got.where("role = 'leader'").count() == 40_000 + 1
    assert got.where("role = 'follower' and leader_seq = 0").count() == n // 3 - 1


@pytest.mark.parametrize("settings", [S, replace(S, time_window_minutes=150.0), replace(S, amount_tolerance=0.0), replace(S, max_date_gap_hours=1.0)])
def test_ledger_sweep_equals_the_loop(spark, settings):
    rng = random.Random(3)
    batch, book = rows_of(rng, 60), [(1000 + r[0], *r[1:]) for r in rows_of(rng, 120)]
    newest = sorted((r for r in book if r[4]), key=lambda r: (-(r[4] - T0).total_seconds(), r[0]))
    expected = {}
    for r in batch:
        hit = next(((b[0], score(r, b, settings)[0]) for b in newest if r[4] and score(r, b, settings)[0]), None)
        if hit:
            expected[r[0]] = hit
    got = dedup.first_ledger_match(cands(spark, batch), ledger(spark, book), settings).collect()
    assert {r.seq: (r.ledger_id, r.ledger_status) for r in got} == expected and expected


def test_ledger_sweep_over_a_hot_bucket(spark):
    """40 000 x 40 000 rows of one amount within two hours."""
    def side(key, shift):
        return spark.range(40_000).select(
            F.col("id").alias(key), F.lit(5.0).alias("amount"), F.concat(F.lit("m"), F.col("id") % 7).alias("merchant"),
            F.col("id").cast("string").alias("description"), F.lit("debit").alias("direction"),
            F.expr(f"timestamp_ntz'2020-01-01 01:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 0.1 + {shift})").alias("txn_ts"))

    got = dedup.first_ledger_match(side("seq", 0), side("id", 0.05), S)
    # 30 minutes are 18 000 rows; beyond them the newest row of the same merchant (one in seven) comes first
    far = "39999 - pmod(39999 - seq, 7)"
    assert got.where(f"ledger_id <> if({far} > seq + 17999, {far}, least(seq + 17999, 39999))").count() == 0
    assert got.count() == 40_000


@pytest.mark.parametrize("salt_rows", [3, 50_000])
def test_pairs_and_reasons_equal_the_loop(spark, salt_rows, monkeypatch):
    monkeypatch.setattr(dedup.salted, "__defaults__", (salt_rows,))
    rng = random.Random(9)
    batch, book = rows_of(rng, 50), [(1000 + r[0], *r[1:]) for r in rows_of(rng, 60)]
    pairs = lambda df: sorted((r.c_key, r.e_key, r.status, tuple(r.reasons)) for r in df.collect())
    loop = lambda p: sorted((a[0], b[0], st, tuple(why)) for a, b in p if a[4] and b[4] for st, why in [score(a, b)] if st)
    assert pairs(dedup.soft_match_pairs(cands(spark, batch), ledger(spark, book), S)) == loop((a, b) for a in batch for b in book)
    assert pairs(dedup.soft_match_pairs(cands(spark, batch), None, S)) == loop((a, b) for a in batch for b in batch if a[0] < b[0])


def test_hot_bucket_is_dealt_out(spark):
    big = spark.range(30_000).select((F.col("id") % 3 * F.col("id")).alias("k"), "id")
    small = spark.range(30_000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    left, right = dedup.salted(big, small, ["k"], rows=500)
    sizes = [r["count"] for r in left.groupBy("k", "_salt").count().collect()]
    assert max(sizes) < 700
    assert left.join(right, ["k", "_salt"]).count() == big.join(small, "k").count()


def test_blocks_of_a_long_batch_are_elected_in_few_rounds(spark, monkeypatch):
    """40 blocks in any order of times: a handful of rounds, and the leaders of the one-block pass."""
    rows = spark.range(8_000).select(
        F.col("id").alias("seq"), (F.hash("id") % 20 * 0.5 + 30).alias("amount"), F.concat(F.lit("m"), F.hash("id") % 3).alias("merchant"),
        F.lit("debit").alias("direction"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, pmod(xxhash64(id), 60000))").alias("txn_ts"))
    rounds, elected = [], dedup._elected
    monkeypatch.setattr(dedup, "_elected", lambda *a: rounds.append(1) or elected(*a))
    got = sorted(map(tuple, dedup.batch_leaders(rows, S, range_rows=200).collect()))
    assert 1 < len(rounds) <= 8
    assert got == sorted(map(tuple, dedup.batch_leaders(rows, S).collect()))
