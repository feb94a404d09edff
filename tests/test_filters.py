"""Edge semantics of filters and scans (FLT-4, FLT-5, FLT-8, SRC-4, SRC-5)."""

from pyspark.sql import functions as F

from spendlake.operators.filters import prune_checkpoint, resolve_month, split_by_sender
from spendlake.sources.io import messages_in_range, unprocessed


def test_month_argument_resolution():
    assert resolve_month("2026-02", "2026-03-23") == "2026-02"
    assert resolve_month("2026-02-14", "2026-03-23") == "2026-02"
    assert resolve_month(None, "2026-03-23") == "2026-03"
    assert resolve_month("bad", "2026-03-23") == "2026-03"
    assert resolve_month("1234567", "2026-03-23") == "1234567"  # only the length is checked, as surveyed


def test_sender_allow_list_is_substring_containment(spark):
    df = spark.createDataFrame([("ALERTS@HDFCBANK.NET",), ("x.alerts@hdfcbank.net.example",), ("news@other.org",), (None,)],
                               "sender_email string")
    m, n = split_by_sender(df, ("alerts@hdfcbank.net",))
    assert m.count() == 2 and n.count() == 2  # a missing sender counts as '' and does not match


def test_prune_treats_bad_stamps_as_oldest(spark):
    cp = spark.createDataFrame([("a", "2026-01-01T10:00:00"), ("b", "2026-03-20T10:00:00"), ("c", "not a date"), ("d", None)],
                               "message_id string, processed_at string")
    kept, removed = prune_checkpoint(cp, "2026-03-23 00:00:00", 60)
    assert sorted(r.message_id for r in kept.collect()) == ["b"]
    assert kept.count() + removed.count() == cp.count()


def test_unprocessed_keeps_rows_without_id(spark):
    msgs = spark.createDataFrame([("<a>",), ("",), (None,), ("<b>",)], "message_id string")
    done = spark.createDataFrame([("<a>",), ("",)], "message_id string")
    got = sorted((r.message_id or "-") for r in unprocessed(msgs, done).collect())
    assert got == ["-", "-", "<b>"]


def test_date_range_is_inclusive_in_sender_offset(spark):
    msgs = spark.createDataFrame([("2026-03-10T23:30:00+05:30",), ("2026-03-12T00:10:00+05:30",), ("2026-03-13T00:00:00+05:30",)],
                                 "received_at string")
    assert messages_in_range(msgs, "2026-03-10", "2026-03-12").count() == 2
