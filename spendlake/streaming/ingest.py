"""Structured Streaming forms of the incremental jobs (ST-1..ST-5).

The nightly run becomes a stream over an arriving message folder with
``trigger(availableNow=True)``: each trigger processes what arrived since the last
one, and the checkpoint location together with a commit log makes the ingest exactly-once (a retried
batch is replayed from the offsets log; the sink commits per epoch).

Event-time columns must be TIMESTAMP (not TIMESTAMP_NTZ) for watermarks; the
helpers cast with the session time zone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlake.config import DedupSettings, Settings
from spendlake.operators.dedup import MICROS_PER_MIN, score_columns
from spendlake.operators.filters import checkpoint_keep
from spendlake.sources.versions import Version, VersionedTables, audited, read_expenses


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream (new files are picked up once, tracked in the checkpoint)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


# ---------------------------------------------------------------------------
# ST-1: exactly-once ingest via foreachBatch and a commit log
# ---------------------------------------------------------------------------

PROCESSED = ("email_uid string, message_id string, `from` string, subject string, processed_at timestamp_ntz, "
             "result string, ledger_ids array<bigint>, reference_ids map<string,string>")


def ingest_epoch(store: VersionedTables, batch: DataFrame, epoch: int, as_of_ts: str, settings: Settings = Settings()) -> Version:
    """One epoch of the ingest: the batch job (REV-3) on the messages of a micro-batch against what earlier
    epochs committed.  New ledger rows, audit rows, the pruned checkpoint, the run's candidates and
    its summary become current with one commit, or none does; an epoch that is already
    committed is left alone.  How many checkpoint rows were pruned is observed in the write."""
    from spendlake.plans.runs import run_batch

    base = store.version()
    if base.info.get("epoch", -1) >= epoch:
        return base
    processed = store.read("processed", PROCESSED, at=base)
    res = run_batch(batch, read_expenses(store, at=base), processed, as_of_ts, settings)
    tables = base.tables
    rows, seen = store.write("expenses", res.appended.drop("seq", "email_uid"))
    if seen["rows"]:
        tables = Version(base.number, tables).appended("expenses", rows)
    audit, high = audited(store, base, res.audit)
    tables = Version(base.number, tables).appended("audit", audit)
    keep = checkpoint_keep(as_of_ts, settings.prune_after_days)
    kept, checked = store.write("processed", res.checkpoint_all, keep=keep, pruned=~keep)
    candidates, counted = store.write("candidates", res.candidates)
    summary, _ = store.write("summary", res.summary)
    for table, folder in (("processed", kept), ("candidates", candidates), ("summary", summary)):
        tables = Version(base.number, tables).replaced(table, {"": [folder]})
    return store.commit(base, tables, {
        "epoch": epoch, "as_of": as_of_ts, "audit_high": high, "appended": seen["rows"], "messages": counted["rows"],
        "pruned": checked["pruned"]})


def ingest_stream(messages: DataFrame, root: str, checkpoint_path: str, as_of_ts: str,
                  settings: Settings = Settings()) -> StreamingQuery:
    """ST-1: ``ingest_epoch`` on every micro-batch of new messages.

    The stream's checkpoint keeps the offsets, the commit log under ``root`` what each epoch made: an epoch that failed
    before its commit runs again on the same messages, one that failed after it is skipped."""
    store = VersionedTables(messages.sparkSession, root)
    return (messages.writeStream.foreachBatch(lambda batch, epoch: ingest_epoch(store, batch, epoch, as_of_ts, settings) and None)
            .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())


# ---------------------------------------------------------------------------
# ST-2: message-id dedup with retention
# ---------------------------------------------------------------------------

def dedup_message_ids(messages: DataFrame, time_col: str = "received_ts", retention: str = "60 days") -> DataFrame:
    """ST-2: drop repeated Message-IDs seen within the retention (state evicted after it).
    Messages without an id are never taken for repeats of each other."""
    timed = messages.withWatermark(time_col, retention)
    has_id = F.coalesce(F.col("message_id"), F.lit("")) != ""
    return timed.where(has_id).dropDuplicatesWithinWatermark(["message_id"]).unionByName(timed.where(~has_id))


# ---------------------------------------------------------------------------
# ST-3: reference-id dedup against the static checkpoint (stream-static join)
# ---------------------------------------------------------------------------

def hard_match_stream(cands: DataFrame, known: DataFrame) -> DataFrame:
    """ST-3: stream rows whose lower-cased reference value is known (static side).

    The static side is re-read per micro-batch, so references recorded by earlier
    batches are seen by later ones."""
    vals = cands.select("*", F.explode(F.map_values("reference_ids")).alias("_v")).where(
        F.col("_v").isNotNull() & (F.col("_v") != ""))
    return vals.join(known.select(F.col("ref").alias("_ref")), F.lower(F.col("_v")) == F.col("_ref"), "left_semi").drop("_v")


SEEN = "seq bigint, ref string, ts timestamp, seen_before boolean"


def reference_stream(cands: DataFrame, days: int = DedupSettings.known_ref_days, late: str = "1 hour",
                     buckets: int = 1024) -> DataFrame:
    """ST-3: every reference value of the stream (seq, ts, reference_ids), with whether it was seen within ``days``
    before, in this stream; without any table.

    References are hashed into ``buckets`` state keys (fixed for a checkpoint), and all rows of a bucket are told apart in
    one vectorised step, so the cost is per row, not per reference.  The state of a bucket holds, for each of its
    references, the last time it was seen; references older than ``days`` go whenever the bucket is visited, by new
    rows or by its event-time timer (at most about one visit a day), so the state holds the references of the
    last days only.  The rows of one reference in one micro-batch are ordered by (ts, seq) before they are told
    apart; rows later than ``late`` are judged by what is still known."""
    span, day = days * 86_400_000_000, 86_400_000
    vals = cands.withWatermark("ts", late).select("seq", "ts", F.explode(F.map_values("reference_ids")).alias("v")).where(
        F.col("v").isNotNull() & (F.col("v") != "")).select("seq", "ts", F.lower("v").alias("ref")).withColumn(
        "bucket", F.pmod(F.xxhash64("ref"), F.lit(buckets)).cast("int"))

    def tell(key, frames, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        never = np.iinfo(np.int64).min
        seen = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else None
        names = seen["ref"].to_pandas().to_numpy(object) if seen else np.empty(0, object)
        last = seen["last"].to_numpy() if seen else np.empty(0, np.int64)
        told = None
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            codes, names = pd.factorize(np.concatenate([names, rows["ref"].to_numpy(object)]))
            known_before, codes = len(last), codes[len(last):]
            last = np.concatenate([last, np.full(len(names) - known_before, never)])
            at = rows["ts"].astype("datetime64[us]").to_numpy().astype(np.int64)
            at[at == never] = np.iinfo(np.int64).max  # rows without a time come last and count for nothing
            order = np.lexsort((rows["seq"].to_numpy(), at, codes))
            codes, at = codes[order], at[order]
            timed = at != np.iinfo(np.int64).max
            before = np.concatenate([[never], at[:-1]])
            first = np.concatenate([[True], codes[1:] != codes[:-1]])
            before[first] = last[codes[first]]
            known = timed & (before != never) & (at - np.maximum(before, at - span - 1) <= span)
            np.maximum.at(last, codes[timed], at[timed])
            told = pd.DataFrame({"seq": rows["seq"].to_numpy()[order], "ref": names[codes],
                                 "ts": rows["ts"].to_numpy()[order], "seen_before": known})
        end = (last + span) // 1000 + 1
        keep = (last != never) & (end > state.getCurrentWatermarkMs())
        if keep.any():
            kept, sink = pa.table({"ref": pa.array(names[keep], pa.string()), "last": last[keep]}), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_table(kept)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(min(end[keep].max(), end[keep].min() + day)))
        elif state.exists:
            state.remove()
        if told is not None:
            yield told

    return vals.groupBy("bucket").applyInPandasWithState(tell, SEEN, "seen binary", "append", "EventTimeTimeout")


# ---------------------------------------------------------------------------
# ST-4: soft match as a stream-stream interval join
# ---------------------------------------------------------------------------

def _cells(width_min: float, a_width: float | None, us: str, amount: str) -> tuple[list[Column], list[Column]]:
    """Join cells of an interval join: (columns of the side dealt over times, columns of the side dealt over amounts).

    A row within ``width_min`` minutes and one amount width of another has an equal (time cell, amount cell) with it
    exactly once: times are cut into cells of twice the interval, of which a row reaches two, amounts into cells
    of four widths, of which a row reaches one or two (reaching half a width further than asked, past any rounding).
    Without a width the amounts themselves are equal."""
    reach = int(width_min * MICROS_PER_MIN)
    t_cell, a_cell = 2 * reach, None if a_width is None else 4 * a_width
    lo, hi = (F.floor((F.col(us) + d) / t_cell) for d in (-reach, reach))
    times = [F.explode(F.sequence(lo, hi)).alias("_tb")]
    if a_cell is None:
        return [F.col(amount).alias("_ab"), *times], [F.col(amount).alias("_eb"), F.floor(F.col(us) / t_cell).alias("_et")]
    near = [F.floor((F.col(amount) + d * a_width) / a_cell) for d in (-1.5, 1.5)]
    return ([F.floor(F.col(amount) / a_cell).alias("_ab"), *times],
            [F.explode(F.array_distinct(F.array(*near))).alias("_eb"), F.floor(F.col(us) / t_cell).alias("_et")])


def soft_match_stream(new: DataFrame, recent: DataFrame, s: DedupSettings = DedupSettings(),
                      watermark: str | None = None, salts: int = 1) -> DataFrame:
    """ST-4: per candidate of ``new`` the first row of ``recent`` in newest-first order (ties by id) that soft-matches it,
    with score and status; a candidate without a match comes out with nulls when the watermark has passed.

    A left outer interval join (equal time and amount cell, times within two hours or the window, and the exact score in
    the join condition), then one chained aggregation per candidate, which also unites its two time cells.  Both
    sides are watermarked, so join and aggregation state are evicted.  ``salts`` deals the candidates of a
    frequent amount over that many tasks and repeats the recent rows as often.

    ``new``: seq, amount, merchant, [direction], ts (TIMESTAMP).  ``recent``: id and the same."""
    width_min = max(float(s.time_window_minutes), 120.0)
    wm = watermark or f"{int(max(s.max_date_gap_hours, width_min / 60))} hours"
    a_width = float(s.amount_tolerance) * (1 + 1e-9) if s.amount_tolerance > 0 else None

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        direction = F.coalesce(F.col("direction"), F.lit("debit")) if "direction" in df.columns else F.lit("debit")
        return df.withWatermark("ts", wm).select(
            F.col(key).alias(f"{p}key"), F.coalesce("amount", F.lit(0.0)).cast("double").alias(f"{p}amount"),
            F.lower(F.trim(F.coalesce("merchant", F.lit("")))).alias(f"{p}merchant"), direction.alias(f"{p}direction"),
            F.unix_micros("ts").alias(f"{p}us"), F.col("ts").alias(f"{p}ts"))

    times, amounts = _cells(width_min, a_width, "c_us", "c_amount")[0], _cells(width_min, a_width, "e_us", "e_amount")[1]
    n = side(new, "seq", "c_").select("*", *times).withColumn("_salt", F.pmod(F.xxhash64("c_key"), F.lit(salts)).cast("int"))
    r = side(recent, "id", "e_").select("*", *amounts)
    r = r.withColumn("_esalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    span = F.expr(f"INTERVAL {int(width_min)} MINUTES")
    _, score, status = score_columns(s)
    j = n.join(r, (n._ab == r._eb) & (n._tb == r._et) & (n._salt == r._esalt) & (F.col("e_ts") >= F.col("c_ts") - span)
               & (F.col("e_ts") <= F.col("c_ts") + span) & status.isNotNull(), "left_outer")
    hit = F.when(F.col("e_key").isNotNull(), F.struct(
        F.col("e_us"), (-F.col("e_key")).alias("id"), score.alias("score"), status.alias("status")))
    best = j.groupBy(F.window("c_ts", "1 hour"), "c_key").agg(F.max(hit).alias("_b"))
    return best.select(F.col("c_key").alias("seq"), (-F.col("_b.id")).alias("ledger_id"), F.col("_b.score").alias("score"),
                       F.col("_b.status").alias("ledger_status"))


def interval_pairs_stream(new: DataFrame, recent: DataFrame, s: DedupSettings = DedupSettings(),
                          watermark: str | None = None) -> DataFrame:
    """Pairs of a stream-stream interval join: pairs (new, recent) on equal cells of time and amount, event times
    within max(window, 2 h); both sides watermarked so join state is evicted.  A row is compared with the rows of its
    cells only, not with all of its amount.

    Input columns: seq, amount, merchant, ts (TIMESTAMP).  Output: new.seq, recent.seq
    and the time gap; ``soft_match_stream`` scores them."""
    width_min = max(float(s.time_window_minutes), 120.0)
    wm = watermark or f"{int(max(s.max_date_gap_hours, width_min / 60))} hours"
    a_width = float(s.amount_tolerance) * (1 + 1e-9) if s.amount_tolerance > 0 else 1e-9
    sides = [df.withWatermark("ts", wm).select(
        F.col("seq").alias(f"{p}_seq"), F.col("amount").alias(f"{p}_amount"), F.col("merchant").alias(f"{p}_merchant"),
        F.col("ts").alias(f"{p}_ts"), F.unix_micros("ts").alias(f"{p}_us")) for df, p in ((new, "n"), (recent, "r"))]
    n = sides[0].select("*", *_cells(width_min, a_width, "n_us", "n_amount")[0]).drop("n_us")
    r = sides[1].select("*", *_cells(width_min, a_width, "r_us", "r_amount")[1]).drop("r_us")
    lo = F.col("r_ts") >= F.col("n_ts") - F.expr(f"INTERVAL {int(width_min)} MINUTES")
    hi = F.col("r_ts") <= F.col("n_ts") + F.expr(f"INTERVAL {int(width_min)} MINUTES")
    j = n.join(r, (n._ab == r._eb) & (n._tb == r._et) & lo & hi & (F.col("r_seq") < F.col("n_seq"))
               & (F.abs(F.col("n_amount") - F.col("r_amount")) <= s.amount_tolerance))
    gap = F.abs(F.unix_micros("n_ts") - F.unix_micros("r_ts")) / F.lit(float(MICROS_PER_MIN))
    return j.select("n_seq", "r_seq", "n_amount", "r_amount", "n_merchant", "r_merchant", gap.alias("gap_minutes"))


# ---------------------------------------------------------------------------
# ST-5: running daily / weekly / monthly spend
# ---------------------------------------------------------------------------

def running_spend(stream: DataFrame, period: str = "daily", time_col: str = "ts", amount_col: str = "amount",
                  key_col: str = "category", watermark: str = "2 days") -> DataFrame:
    """ST-5: windowed spend per key.  Weekly windows start on Monday (the epoch is a
    Thursday, hence the 4-day offset); monthly uses the month key."""
    s = stream.withWatermark(time_col, watermark)
    if period == "monthly":
        grp = [F.date_format(F.col(time_col), "yyyy-MM").alias("month_key"), F.col(key_col)]
    elif period == "weekly":
        grp = [F.window(F.col(time_col), "7 days", startTime="4 days"), F.col(key_col)]
    else:
        grp = [F.window(F.col(time_col), "1 day"), F.col(key_col)]
    return s.groupBy(*grp).agg(F.sum(amount_col).alias("spent"), F.count(F.lit(1)).alias("n"))


def closed_spend(stream: DataFrame, period: str = "daily", time_col: str = "ts", amount_col: str = "amount",
                 key_col: str = "category", watermark: str = "2 days") -> DataFrame:
    """ST-5 in append mode: spend per key of each day, week (from Monday) or month that the watermark has closed.

    Days are summed first; weeks and months are a second aggregation chained to the closed days (``window_time``), so
    state holds open days and one row per open week or month, and the watermark evicts both.  Months differ in
    length: a month is a session that lasts from its first day seen to its end."""
    days = stream.withWatermark(time_col, watermark).groupBy(F.window(F.col(time_col), "1 day"), F.col(key_col).alias("key")).agg(
        F.sum(amount_col).alias("spent"), F.count(F.lit(1)).alias("n"))
    if period == "daily":
        return days.select(F.to_date("window.start").alias("start"), "key", "spent", "n")
    total = [F.sum("spent").alias("spent"), F.sum("n").alias("n")]
    at = days.select(F.window_time("window").alias("at"), F.to_date("window.start").alias("day"), "key", "spent", "n")
    if period == "weekly":
        return at.groupBy(F.window("at", "7 days", startTime="4 days"), "key").agg(*total).select(
            F.to_date("window.start").alias("start"), "key", "spent", "n")
    left = F.concat(F.datediff(F.last_day("day"), F.col("day")) + 1, F.lit(" days"))
    return at.groupBy(F.session_window("at", left), F.trunc("day", "month").alias("start"), "key").agg(*total).select(
        "start", "key", "spent", "n")


def run_to_table(df: DataFrame, out_path: str, checkpoint_path: str, mode: str = "complete") -> DataFrame:
    """Drive a streaming aggregate to completion (availableNow) and return its result.

    complete: each epoch's full result replaces the output folder.  append: each epoch
    writes its own partition (a replayed epoch replaces only its own rows)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out_path)
        else:
            batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    spark = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(out_path).select(*df.columns)
    except AnalysisException as missing:  # no batch has written anything
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)
