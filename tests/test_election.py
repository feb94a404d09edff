"""The leader election cut by time and amount, against the plain loop and by the rows it passes."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_dedup_scale import S, score

from spendlake.operators import dedup

CAND = "seq bigint, amount double, merchant string, direction string, txn_ts timestamp_ntz"


def batch(spark, n, minutes):
    """Rows in any order of times and amounts, few merchants."""
    return spark.range(n).select(
        F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(4000)) * 0.25).alias("amount"),
        F.concat(F.lit("m"), F.pmod(F.hash("id"), F.lit(4))).alias("merchant"), F.lit("debit").alias("direction"),
        F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(xxhash64(id + 7), {minutes * 60}))").alias("txn_ts"))


@pytest.mark.parametrize("minutes", [300, 30_000])
def test_rows_are_passed_little_more_than_once(spark, monkeypatch, minutes):
    """Rows of five hours are many blocks, and only those next to the cuts are passed again."""
    n, passed, blocks, elected = 8_000, [], [], dedup._elected
    monkeypatch.setattr(dedup, "_elected", lambda rows, s, b: (passed.append(rows.count()), blocks.append(b), elected(rows, s, b))[-1])
    got = sorted(map(tuple, dedup.batch_leaders(batch(spark, n, minutes), S, range_rows=700).collect()))
    assert blocks[0] >= 8
    assert sum(passed) < 2 * n
    assert got == sorted(map(tuple, dedup.batch_leaders(batch(spark, n, minutes), S, range_rows=n).collect()))


def fold(rows, s):
    """(leader, status) by the loop over the batch in order; rows of one key in the order given."""
    leaders, out = [], []
    for r in rows:
        hit = next(((x[0], how) for x in leaders for how in [r[4] and x[4] and score(r, x, s)[0]] if how), None)
        out.append((r[0], *(hit or (r[0], None))))
        if not hit:
            leaders.append(r)
    return sorted(out, key=str)


@pytest.mark.parametrize("settings,ordered,merchants", [
    (S, False, 5), (S, True, 5), (S, False, 400), (replace(S, amount_tolerance=0.0), True, 5),
    (replace(S, time_window_minutes=150.0), False, 5), (replace(S, max_date_gap_hours=1.0), False, 5)])
@pytest.mark.parametrize("range_rows", [200, 100_000])
def test_dense_rows_equal_the_loop(spark, settings, ordered, merchants, range_rows):
    rng = random.Random(5)
    values = [(round(rng.expovariate(0.2), 1), f"m{rng.randrange(merchants)}", rng.choice(["debit", "credit"]),
               None if rng.random() < 0.02 else dt.datetime(2026, 3, 1) + dt.timedelta(seconds=rng.randrange(90_000))) for _ in range(1500)]
    values += rng.sample(values, 100)
    if ordered:
        values.sort(key=lambda v: str(v[3]))
    rows = [(i // 2 if i < 40 else i, *v) for i, v in enumerate(values)]  # some keys twice
    got = dedup.batch_leaders(spark.createDataFrame(rows, CAND).coalesce(1), settings, range_rows)
    assert sorted(((r.seq, r.leader_seq, r.pair_status) for r in got.collect()), key=str) == fold(rows, settings)


def test_rows_without_key_or_finite_amount_lead(spark):
    t = dt.datetime(2026, 3, 1)
    rows = [(None, 5.0, "a", "debit", t), (None, 5.0, "a", "debit", t), (1, 5.0, "a", "debit", t), (2, float("nan"), "a", "debit", t),
            (3, float("nan"), "a", "debit", t), (4, float("inf"), "a", "debit", t), (5, 5.5, "a", "debit", t)]
    got = dedup.batch_leaders(spark.createDataFrame(rows, CAND), S).collect()
    assert {(r.seq, r.leader_seq) for r in got} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1)} and len(got) == 7
