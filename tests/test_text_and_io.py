"""HTML to text, addresses, mail dates, ledger publishing, checkpoint scan, export."""

import html
import os
import random
import tempfile
from html.entities import html5

from pyspark.sql import functions as F

from spendlake.functions.text import decode_entities, decode_header_words, extract_address, html_to_text
from spendlake.functions.timeutil import mail_date_to_iso
from spendlake.sources.io import export_csv, publish_mutation, read_checkpoint, write_ledger


def test_html_cases(spark):
    cases = ["<html><head><script>var x='<p>';</script><style>p{}</style></head><body><p>Hello</p><div>World &amp; co</div></body></html>",
             "", "plain text stays", "<b>bold</b>text<br/>next<li>item</li>",
             "&amp;lt; x", "a &lt b", "&ampTo", "&amp;amp;", "x &apos y &apos; z", "&copy2024 &middot; <!-- c --> end"]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = [r[0] for r in df.select(html_to_text("h")).collect()]
    assert got == ["Hello World & co", "", "plain text stays", "boldtext nextitem", "&lt; x", "a < b", "&To", "&amp;", "x &apos y ' z",
                   "©2024 · end"]


def test_html_quotes_entities_and_open_elements(spark):
    cases = {
        "<p title='a>b'>caf&eacute; &#8377;500 &mdash; ok</p>x<script>var a=1;": "café ₹500 — ok x",
        "<p class=it's>one</p>two <b data-x=\"1>0\">x</b>": "one two x",
        "a<style>p{</style>b<!-- <p> -->c<script>'</p>'</script >d": "abcd",
        "<!-- never closed <p>x": "", "<br/>a<br>b<p/>c": "ab c", "2 < 3 > 1": "2 < 3 > 1", "<script src='a'/>shown": "shown",
        "&notit; &notin; &#x80; &#0; &#xD800; &#1114112; &bogus; & &# &#x; &;": "¬it; ∉ € \ufffd \ufffd \ufffd &bogus; & &# &#x; &;",
    }
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", html_to_text("h")).collect()} == cases


def test_references_equal_the_standard_library(spark):
    rng = random.Random(1)
    names = list(html5)
    piece = lambda: rng.choice(["&" + rng.choice(names), f"&#{rng.randrange(300)};", f"&#{rng.choice([65534, 131071, 8364, 10**12])}",
                                f"&#x{rng.randrange(70000):x}", "&", " ", "x", ";", "&#", "amp", "é"])
    texts = ["".join(piece() for _ in range(12)) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_entities("t")).collect()
    assert [r[0] for r in rows if r[1] != html.unescape(r[0])] == []


def test_header_words_with_bad_bytes_stay_as_written(spark):
    cases = {"=?utf-8?q?caf=FF?=": "=?utf-8?q?caf=FF?=", "=?windows-1252?q?=93hi=94_=80?=": "“hi” €",
             "=?utf-8?b?//8=?= and =?utf-8?q?=E2=82=AC?=": "=?utf-8?b?//8=?= and €", "=?us-ascii?q?a=E9?=": "=?us-ascii?q?a=E9?="}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", decode_header_words("h")).collect()} == cases


def test_addresses_and_dates(spark):
    df = spark.createDataFrame([("HDFC Bank <alerts@hdfcbank.net>",), ("alerts@hdfcbank.net",), ('"Name, X" <a@b.com>',), (" plain ",)], "h string")
    assert [r[0] for r in df.select(extract_address("h")).collect()] == ["alerts@hdfcbank.net", "alerts@hdfcbank.net", "a@b.com", "plain"]
    d = spark.createDataFrame([("Mon, 23 Mar 2026 22:00:00 +0530",), ("",), ("garbage",)], "d string")
    assert [r[0] for r in d.select(mail_date_to_iso("d", "2026-03-24T00:00:00")).collect()] == [
        "2026-03-23T22:00:00+05:30", "2026-03-24T00:00:00", "2026-03-24T00:00:00"]


def test_header_words(spark):
    cases = {
        "=?utf-8?b?VHJhbnNhY3Rpb24gQWxlcnQ=?=": "Transaction Alert",
        "=?UTF-8?Q?Caf=C3=A9_bill?= a=b": "Café bill a=b",
        "=?utf-8?q?one?=  =?iso-8859-1?q?=E9t?= end": "oneét end",
        "plain": "plain", "": "", None: "", "=?x-unknown?q?a?=": "=?x-unknown?q?a?=",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", decode_header_words("h")).collect()} == cases


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "id bigint, amount double, transaction_date string")


def test_publish_lands_purges_and_date_moves(spark):
    path, audit = tempfile.mkdtemp(prefix="spendlake-l-") + "/l", tempfile.mkdtemp(prefix="spendlake-a-") + "/a"
    log = spark.createDataFrame([("PURGE", "expenses", 1, None, None, "cli", "2026-03-01")],
                                "action string, table_name string, row_id bigint, old_values string, new_values string, source string, created_on string")
    write_ledger(_ledger(spark, [(1, 1.0, "2026-01-05"), (2, 2.0, "2026-02-05"), (3, 3.0, "2026-03-05")]), path)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "transaction_date").collect())
    state = spark.read.parquet(path).where("id <> 1")
    publish_mutation(state, log, spark.createDataFrame([(1,)], "id bigint"), path, audit)
    assert read() == [(2, "2026-02-05"), (3, "2026-03-05")]
    moved = spark.read.parquet(path).drop("month_key").withColumn(
        "transaction_date", F.when(F.col("id") == 2, "2026-03-09").otherwise(F.col("transaction_date")))
    publish_mutation(moved, log, spark.createDataFrame([(2,)], "id bigint"), path, audit)
    assert read() == [(2, "2026-03-09"), (3, "2026-03-05")]
    assert sorted(r.id for r in spark.read.parquet(audit).collect()) == [1, 2]


def test_checkpoint_scan_tolerant_and_export(spark):
    d = tempfile.mkdtemp(prefix="spendlake-cp-")
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write('{"email_uid": "1", "message_id": "<a>", "processed_at": "2026-03-01T10:00:00", "reference_ids": {"ref_no": "X"}}\n')
        f.write("{not json\n")
    cp = read_checkpoint(spark, d)
    assert [r.message_id for r in cp.collect()] == ["<a>"]
    assert read_checkpoint(spark, os.path.join(d, "missing")).count() == 0
    out = tempfile.mkdtemp(prefix="spendlake-csv-")
    df = spark.createDataFrame([(1, None, "")], "id int, a string, b string")
    written = export_csv({"expenses": df, "budgets": df.limit(0)}, out)
    assert len(written) == 1
    text = "".join(open(os.path.join(written[0], f)).read() for f in os.listdir(written[0]) if f.endswith(".csv"))
    lines = text.splitlines()
    assert set(lines) == {"id,a,b", "1,,"} and lines.count("1,,") == 1  # one header per part file


def test_run_output_replaces_only_its_run(spark):
    from spendlake.sources.io import write_run_output

    out = tempfile.mkdtemp(prefix="spendlake-run-")
    c1 = spark.createDataFrame([(1, "new")], "seq bigint, dedup_status string")
    s1 = spark.createDataFrame([(1, 1)], "total_emails_processed bigint, inserted bigint")
    write_run_output(c1, s1, out, "r1")
    write_run_output(c1.union(c1), s1, out, "r2")
    write_run_output(c1, s1, out, "r2")  # re-run of r2 replaces r2 only
    got = spark.read.parquet(os.path.join(out, "candidates")).groupBy("run_id").count().collect()
    assert sorted((r.run_id, r["count"]) for r in got) == [("r1", 1), ("r2", 1)]


def test_publish_touches_only_changed_months_and_audit_ids_grow(spark):
    from spendlake.operators.mutations import soft_delete
    from spendlake.sources.io import append_audit, publish_mutation, write_ledger

    base = tempfile.mkdtemp(prefix="spendlake-pub-")
    path = os.path.join(base, "expenses")
    rows = [(1, 10.0, "Food", "a", "2026-01-05"), (2, 20.0, "Food", "b", "2026-02-05"), (3, 30.0, "Fun", "c", "2026-02-09")]
    df = spark.createDataFrame(rows, "id bigint, amount double, category string, description string, transaction_date string") \
        .withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("inserted_on", F.lit(None).cast("timestamp_ntz")).withColumn("updated_on", F.lit(None).cast("timestamp_ntz"))
    write_ledger(df, path)
    jan_files = sorted(os.listdir(os.path.join(path, "month_key=2026-01")))
    state = spark.read.parquet(path).drop("month_key")
    new_state, audit, _ = soft_delete(state, spark.createDataFrame([(3,)], "id bigint"), "2026-03-01 00:00:00")
    apath = os.path.join(base, "audit")
    touched = publish_mutation(new_state, audit, spark.createDataFrame([(3,)], "id bigint"), path, apath)
    assert touched == ["2026-02"]
    assert sorted(os.listdir(os.path.join(path, "month_key=2026-01"))) == jan_files  # January untouched
    back = {r.id: r.deleted_at for r in spark.read.parquet(path).collect()}
    assert back[3] is not None and back[1] is None and back[2] is None and len(back) == 3
    append_audit(spark.read.parquet(apath).drop("id"), apath)
    assert sorted(r.id for r in spark.read.parquet(apath).collect()) == [1, 2]  # ids never reused
