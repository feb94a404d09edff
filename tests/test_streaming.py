"""Streaming operators: running spend equals batch, message-id dedup, stream-static
reference join, exactly-once ingest per epoch; ledger month partitions prune."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from spendlake.config import DedupSettings
from spendlake.operators.dedup import first_ledger_match
from spendlake.session import scratch_path
from spendlake.sources.versions import AUDIT, VersionedTables, read_expenses
from spendlake.streaming.ingest import (
    closed_spend,
    hard_match_stream,
    ingest_epoch,
    ingest_stream,
    interval_pairs_stream,
    reference_stream,
    run_to_table,
    running_spend,
    soft_match_stream,
)

SF = "/root/testdata/sf0.001"


def _events_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def test_weekly_running_spend_matches_batch(spark):
    ev = _events_stream(spark).select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"),
                                      F.col("event_type").alias("category"))
    out = run_to_table(running_spend(ev, "weekly"), scratch_path(spark, "t-w"), scratch_path(spark, "t-wc"))
    got = {(str(r.window.start.date()), r.category): round(r.spent, 6) for r in out.collect()}
    b = spark.read.parquet(f"{SF}/events.parquet").select(
        F.date_trunc("week", F.col("ts")).cast("date").alias("wk"), "event_type", "value")
    want = {(str(r.wk), r.event_type): round(r.s, 6) for r in b.groupBy("wk", "event_type").agg(F.sum("value").alias("s")).collect()}
    assert got == want  # weekly windows start on Monday


def test_stream_static_reference_join(spark):
    known = spark.createDataFrame([("u1k2",)], "ref string")
    ev = _events_stream(spark).select("event_id", F.create_map(F.lit("ref_no"), F.concat(
        F.lit("U"), F.col("user_id").cast("string"), F.lit("K"), F.get_json_object("props", "$.k"))).alias("reference_ids"))
    out = run_to_table(hard_match_stream(ev, known), scratch_path(spark, "t-h"), scratch_path(spark, "t-hc"), mode="append")
    b = spark.read.parquet(f"{SF}/events.parquet").where(
        (F.col("user_id") == 1) & (F.get_json_object("props", "$.k") == "2")).count()
    assert out.count() == b


MESSAGES = ("seq bigint, email_uid string, message_id string, `from` string, sender_email string, subject string, body string, "
            "received_at string")


def _message(seq, uid, mid, body, sender="alerts@hdfcbank.net"):
    return (seq, uid, mid, f"Bank <{sender}>", sender, "Transaction Alert", body, "2026-03-15T18:30:00+05:30")


SWIGGY = "Rs.120.00 has been debited from your account to SWIGGY on 15-03-2026. Ref No: AB12."
UBER = "Rs.75.00 has been debited from your account to UBER on 16-03-2026. Ref No: CD34."


def _ingest(spark, paths, as_of="2026-03-17 22:00:00"):
    src, root, ckpt = paths
    q = ingest_stream(spark.readStream.schema(MESSAGES).parquet(f"{src}/*"), root, ckpt, as_of)
    assert q.awaitTermination(300) is not False
    return VersionedTables(spark, root)


def _audit(store):
    return sorted((r.id, r.action, r.row_id) for r in store.read("audit", AUDIT).collect())


def test_ingest_epochs_without_payments_replays_and_outputs(spark):
    paths = [scratch_path(spark, x) for x in ("t-src", "t-root", "t-ckpt")]
    arrive = lambda k, rows: spark.createDataFrame(rows, MESSAGES).write.parquet(f"{paths[0]}/{k}")
    arrive(0, [_message(1, "u0", "<m0>", "Lunch on Friday?", "friend@example.com")])
    store = _ingest(spark, paths)  # the first epoch has no payment
    assert read_expenses(store).count() == 0 and _audit(store) == []
    arrive(1, [_message(1, "u1", "<m1>", SWIGGY), _message(2, "u2", "<m2>", SWIGGY), _message(3, "u3", "<m3>", "no amount here")])
    store = _ingest(spark, paths)
    assert [(r.id, r.amount) for r in read_expenses(store).collect()] == [(1, 120.0)]  # <m2> is a duplicate within the batch
    assert _audit(store) == [(1, "BULK_INSERT", None), (2, "BULK_INSERT_ROW", 1)]
    version = store.version()
    assert (version.info["epoch"], version.info["appended"], version.info["messages"]) == (1, 1, 3)
    assert store.read("summary", "inserted bigint, total_emails_processed bigint").collect()[0][:] == (1, 3)
    replay = ingest_epoch(store, spark.read.schema(MESSAGES).parquet(f"{paths[0]}/1"), 1, "2026-03-17 22:00:00")
    assert replay == version == store.version()
    _ingest(spark, paths)  # nothing new
    assert store.version() == version
    arrive(2, [_message(1, "u1", "<m1>", SWIGGY), _message(4, "u4", "<m4>", UBER)])  # <m1> comes again
    store = _ingest(spark, paths)
    assert sorted((r.id, r.amount) for r in read_expenses(store).collect()) == [(1, 120.0), (2, 75.0)]
    arrive(3, [_message(5, "u5", "<m5>", "hello", "friend@example.com")])
    store = _ingest(spark, paths, as_of="2026-06-30 22:00:00")  # the checkpoint rows are over 60 days old
    assert store.version().info["pruned"] == 4 and store.read("processed", "message_id string").count() == 0
    assert len(_audit(store)) == 4 and read_expenses(store).count() == 2


def test_an_epoch_that_fails_before_its_commit_runs_again(spark, monkeypatch):
    root = scratch_path(spark, "t-root")
    store, batch = VersionedTables(spark, root), spark.createDataFrame([_message(1, "u1", "<m1>", SWIGGY)], MESSAGES)
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        try:
            ingest_epoch(store, batch, 0, "2026-03-17 22:00:00")
        except OSError:
            pass
    assert store.numbers() == [] and read_expenses(store).count() == 0
    ingest_epoch(store, batch, 0, "2026-03-17 22:00:00")
    assert read_expenses(store).count() == 1 and len(_audit(store)) == 2


def _pieces(spark, schema, pieces, make, name):
    """Run a stream after each piece of rows; the rows told by each run."""
    src, out, ckpt = (scratch_path(spark, f"t-{name}-{x}") for x in ("in", "out", "ckpt"))
    told, before = [], set()
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{k}")
        df = make(spark.readStream.schema(schema).parquet(f"{src}/*"))
        now = {tuple(r) for r in run_to_table(df, out, ckpt, "append").collect()}
        told.append(now - before)
        before = now
    return told


def _day(d, h=0):
    return dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d, hours=h)


def test_references_are_known_for_seven_days(spark):
    ref = lambda *v: {f"k{i}": x for i, x in enumerate(v)}
    pieces = [[(1, _day(0), ref("AB1")), (2, _day(0, 1), ref("ab1", "Z9")), (3, _day(0), ref(""))],
              [(4, _day(6), ref("Ab1"))], [(5, _day(13, 1), ref("AB1")), (6, _day(13), ref("Z9")), (7, _day(13, 2), ref("ab1"))],
              [(8, _day(30), ref("ab1", "z9"))]]
    told = _pieces(spark, "seq bigint, ts timestamp, reference_ids map<string,string>", pieces,
                   lambda s: reference_stream(s).select("seq", "ref", "seen_before"), "refs")
    assert told == [{(1, "ab1", False), (2, "ab1", True), (2, "z9", False)}, {(4, "ab1", True)},
                    {(5, "ab1", False), (6, "z9", False), (7, "ab1", True)}, {(8, "ab1", False), (8, "z9", False)}]


def test_first_match_over_two_pieces_equals_the_batch_operator(spark):
    rng = random.Random(2)
    row = lambda i, late: (i, rng.choice([10.0, 10.5, 12.0]), rng.choice(["ab", "abc", "x"]), "debit",
                           _day(late, rng.randrange(3)) + dt.timedelta(minutes=rng.randrange(60)), rng.random() < 0.4)
    rows = [row(i, i // 30) for i in range(60)]
    schema = "seq bigint, amount double, merchant string, direction string, ts timestamp, new boolean"
    beats = [[(None, None, None, None, _day(40 * k), None)] for k in (1, 2)]
    make = lambda s: soft_match_stream(
        s.where("new or new is null"), s.where("not new or new is null").withColumnRenamed("seq", "id"), salts=3)
    told = _pieces(spark, schema, [rows[:30], rows[30:], *beats], make, "first")
    got = {r[0]: r[1:] for t in told for r in t if r[0] is not None}
    c = spark.createDataFrame([(*r[:4], r[4].replace(tzinfo=None)) for r in rows if r[5]],
                              "seq bigint, amount double, merchant string, direction string, txn_ts timestamp_ntz")
    e = spark.createDataFrame([(r[0], r[1], r[2], r[2], r[3], r[4].replace(tzinfo=None)) for r in rows if not r[5]],
                              "id bigint, amount double, description string, merchant string, direction string, txn_ts timestamp_ntz")
    want = {r.seq: (r.ledger_id, r.ledger_status) for r in first_ledger_match(c, e, DedupSettings()).collect()}
    assert {k: (v[0], v[2]) for k, v in got.items() if v[0] is not None} == want and want
    assert set(got) == {r[0] for r in rows if r[5]} and all(v == (None, None, None) for k, v in got.items() if k not in want)
    assert not told[0]  # nothing is told before the watermark has passed it


def test_closed_windows_come_once_and_in_full(spark):
    pay = lambda d, x, k="a": (_day(d), float(x), k)
    pieces = [[pay(0, 1), pay(0, 2), pay(1, 4)], [pay(1, 8), pay(20, 16), pay(30, 32, "b")], [pay(31, 64), pay(70, 1)], [pay(130, 1)]]
    schema = "ts timestamp, amount double, category string"
    sums = lambda told: [{(str(r[0])[5:], r[1], r[2], r[3]) for r in t} for t in told]
    days = sums(_pieces(spark, schema, pieces, lambda s: closed_spend(s, "daily"), "days"))
    assert days[0] == set() and days[1] == {("03-01", "a", 3.0, 2), ("03-02", "a", 12.0, 2), ("03-21", "a", 16.0, 1)}
    assert days[2] == {("03-31", "b", 32.0, 1), ("04-01", "a", 64.0, 1)}
    months = sums(_pieces(spark, schema, pieces, lambda s: closed_spend(s, "monthly"), "months"))
    assert set().union(*months) == {("03-01", "a", 31.0, 5), ("03-01", "b", 32.0, 1), ("04-01", "a", 64.0, 1), ("05-01", "a", 1.0, 1)}
    weeks = set().union(*sums(_pieces(spark, schema, pieces, lambda s: closed_spend(s, "weekly"), "weeks")))
    assert weeks == {("02-23", "a", 3.0, 2), ("03-02", "a", 12.0, 2), ("03-16", "a", 16.0, 1), ("03-30", "b", 32.0, 1),
                     ("03-30", "a", 64.0, 1), ("05-04", "a", 1.0, 1)}


def test_month_partition_pruning(spark):
    from spendlake.sources.io import write_ledger

    path = os.path.join(tempfile.mkdtemp(prefix="spendlake-led-"), "expenses")
    df = spark.createDataFrame([(1, 10.0, "2026-03-01"), (2, 20.0, "2026-04-01")], "id bigint, amount double, transaction_date string")
    write_ledger(df, path)
    q = spark.read.parquet(path).where(F.col("month_key") == "2026-03")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and q.count() == 1


def test_many_references_share_few_states(spark):
    """4 000 references in two pieces, told apart like a plain loop does, with at most ``buckets`` state rows."""
    rng = random.Random(5)
    rows = [(i, _day(0, i % 200) + dt.timedelta(seconds=rng.randrange(3600)), {"r": f"Ref{rng.randrange(4000)}"}) for i in range(6000)]
    rows.sort(key=lambda r: r[1])
    want, last = set(), {}
    for seq, ts, refs in sorted(rows, key=lambda r: (r[1], r[0])):
        ref = refs["r"].lower()
        want.add((seq, ref, ref in last and ts - last[ref] <= dt.timedelta(days=7)))
        last[ref] = ts
    src, ckpt = (scratch_path(spark, f"t-many-{x}") for x in ("in", "ckpt"))
    schema, got = "seq bigint, ts timestamp, reference_ids map<string,string>", set()
    for k, piece in enumerate((rows[:3500], rows[3500:])):
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(f"{src}/{k}")
        told = reference_stream(spark.readStream.schema(schema).parquet(f"{src}/*"), buckets=16)
        q = told.writeStream.foreachBatch(lambda b, e: got.update((r.seq, r.ref, r.seen_before) for r in b.collect())).option(
            "checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
    assert got == want


def test_rows_of_one_amount_meet_only_near_in_time(spark):
    """30 000 rows of one amount, 90 minutes apart: a row has one earlier row within two hours."""
    import time

    n = 30_000
    src, out, ckpt = (scratch_path(spark, f"t-one-{x}") for x in ("in", "out", "ckpt"))
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.lit(30.0).alias("amount"), F.lit("metro").alias("merchant"),
        F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 90 * id)").alias("ts"))
    rows.write.parquet(src)
    began = time.time()
    side = spark.readStream.schema(rows.schema).parquet(src)
    got = run_to_table(interval_pairs_stream(side, side), out, ckpt, "append")
    assert got.count() == n - 1 and got.where("n_seq <> r_seq + 1 or gap_minutes <> 90").count() == 0
    assert time.time() - began < 90
