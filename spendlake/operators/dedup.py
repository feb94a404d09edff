"""Two-stage duplicate detection (JN-2..JN-7, AGG-9).

Stage 1 (hard): any reference value of a candidate, lower-cased, equals a known
reference value (type ignored) -> definite_duplicate.
Stage 2a (ledger): first ledger row, newest first, whose soft score reaches the
probable threshold -> auto_merged / probable_duplicate with the ledger id.
Stage 2b (batch): greedy leader election in batch order over the soft-match graph, by blocks of
time and amount that are elected at once; rows that hang on other blocks go to another round.

Soft score (constant weights): time +1.5 within the window, -2 beyond 24 h, -1
beyond 2 h, -1 when a time is unknown, reject beyond the cutoff; amount +2 within
tolerance; merchant +1 on mutual containment; direction +0.5.  >= 4.5 auto, >= 3.5
probable.  Hence a match needs both times, the amount within tolerance and
dt <= max(window, 2 h): the band join blocks on (time bucket, amount bucket),
explodes one side over the 3 neighbouring time buckets and the other over the 3
neighbouring amount buckets (each pair meets exactly once), then applies the exact
score.  Inside the window an amount match alone is enough, beyond it all of amount, merchant and
direction must match.  Buckets with more than ``SALT_ROWS`` rows are dealt over several tasks
by a salt.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from spendlake.config import (
    PENALTY_GAP_24H,
    PENALTY_GAP_2H,
    SCORE_AMOUNT,
    SCORE_DIRECTION,
    SCORE_MERCHANT,
    SCORE_TIME,
    STATUS_AUTO,
    STATUS_DEFINITE,
    STATUS_NEW,
    STATUS_PROBABLE,
    THRESHOLD_AUTO,
    THRESHOLD_PROBABLE,
    DedupSettings,
)
from spendlake.functions.text import fuzzy_name_match
from spendlake.operators import election
from spendlake.session import cut_lineage, written

MICROS_PER_MIN = 60_000_000
SALT_ROWS = 50_000  # rows of one bucket in one task of a band join
RANGE_ROWS = 200_000  # rows of one block of the leader election
MOST_BLOCKS = 1024  # more rows make larger blocks


# ---------------------------------------------------------------------------
# JN-3 / JN-2: known references and the hard match
# ---------------------------------------------------------------------------

def known_references(checkpoint: DataFrame, as_of_ts: str, days: int) -> DataFrame:
    """JN-3: {lower(value) -> last processed record} over rows processed within ``days``.

    Unparseable stamps count as oldest (excluded).  Last row wins by (processed_at, seq)."""
    stamp = F.col("processed_at").cast("string").try_cast("timestamp_ntz")
    cutoff = F.lit(as_of_ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = checkpoint.where(stamp >= cutoff)
    refs = recent.select(
        "message_id", "email_uid", stamp.alias("_ts"), F.col("seq"),
        F.explode(F.map_values("reference_ids")).alias("_v"),
    ).where(F.col("_v").isNotNull() & (F.col("_v") != ""))
    return refs.groupBy(F.lower("_v").alias("ref")).agg(
        F.max_by(F.struct("message_id", "email_uid"), F.struct("_ts", "seq")).alias("record")
    )


def hard_matches(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """JN-2: candidates (seq) with any non-empty reference value, lower-cased, among the
    known references; plus the matched message id (first reference type in map order)."""
    vals = candidates.select("seq", F.posexplode(F.map_values("reference_ids")).alias("_pos", "_v")).where(
        F.col("_v").isNotNull() & (F.col("_v") != "")
    )
    hit = vals.join(known, F.lower(F.col("_v")) == F.col("ref"))
    return hit.groupBy("seq").agg(F.min_by(F.col("record.message_id"), F.col("_pos")).alias("matched_message_id"))


# ---------------------------------------------------------------------------
# JN-4: soft-match band join
# ---------------------------------------------------------------------------

def _norm_side(df: DataFrame, key: str, merchant: Column, s: DedupSettings, prefix: str) -> DataFrame:
    ts = F.col("txn_ts")
    return df.select(
        F.col(key).alias(f"{prefix}key"),
        F.coalesce(F.col("amount"), F.lit(0.0)).cast("double").alias(f"{prefix}amount"),
        merchant.alias(f"{prefix}merchant"),
        F.coalesce(F.col("direction"), F.lit("debit")).alias(f"{prefix}direction") if "direction" in df.columns
        else F.lit("debit").alias(f"{prefix}direction"),
        ts.alias(f"{prefix}ts"),
        F.unix_micros(ts.cast("timestamp")).alias(f"{prefix}us"),
    )


def _buckets(s: DedupSettings):
    width_min = max(float(s.time_window_minutes), 120.0)
    t_width = int(width_min * MICROS_PER_MIN)
    a_width = float(s.amount_tolerance) * (1 + 1e-9) if s.amount_tolerance > 0 else None
    return t_width, a_width


def score_columns(s: DedupSettings, c: str = "c_", e: str = "e_") -> tuple[Column, Column, Column]:
    """(gap minutes, score, status) for aligned candidate/existing columns.

    Status NULL = no match (includes the hard cutoff)."""
    both = F.col(f"{c}ts").isNotNull() & F.col(f"{e}ts").isNotNull()
    gap = F.abs(F.col(f"{c}us") - F.col(f"{e}us")) / F.lit(float(MICROS_PER_MIN))
    hours = gap / 60.0
    t_score = (
        F.when(~both, F.lit(PENALTY_GAP_2H))
        .when(gap <= s.time_window_minutes, F.lit(SCORE_TIME))
        .when(hours > 24, F.lit(PENALTY_GAP_24H))
        .when(hours > 2, F.lit(PENALTY_GAP_2H))
        .otherwise(F.lit(0.0))
    )
    amount_ok = F.abs(F.col(f"{c}amount") - F.col(f"{e}amount")) <= s.amount_tolerance
    merch_ok = fuzzy_name_match(F.col(f"{c}merchant"), F.col(f"{e}merchant"))
    dir_ok = F.col(f"{c}direction") == F.col(f"{e}direction")
    score = (
        t_score
        + F.when(amount_ok, F.lit(SCORE_AMOUNT)).otherwise(0.0)
        + F.when(merch_ok, F.lit(SCORE_MERCHANT)).otherwise(0.0)
        + F.when(dir_ok, F.lit(SCORE_DIRECTION)).otherwise(0.0)
    )
    rejected = both & (hours > s.max_date_gap_hours)
    status = (
        F.when(rejected, F.lit(None).cast("string"))
        .when(score >= THRESHOLD_AUTO, F.lit(STATUS_AUTO))
        .when(score >= THRESHOLD_PROBABLE, F.lit(STATUS_PROBABLE))
    )
    return gap, F.when(~rejected, score), status


def score_reasons(s: DedupSettings, c: str = "c_", e: str = "e_") -> Column:
    """The parts of the score that apply, in the order time, amount, merchant, direction."""
    both = F.col(f"{c}ts").isNotNull() & F.col(f"{e}ts").isNotNull()
    minutes = F.abs(F.col(f"{c}us") - F.col(f"{e}us")) / F.lit(float(MICROS_PER_MIN))
    time = (
        F.when(~both, F.lit("time_unknown"))
        .when(minutes <= s.time_window_minutes, F.lit("time_within_window"))
        .when(minutes / 60.0 > 24, F.lit("gap_over_24h"))
        .when(minutes / 60.0 > 2, F.lit("gap_over_2h"))
    )
    amount = F.when(F.abs(F.col(f"{c}amount") - F.col(f"{e}amount")) <= s.amount_tolerance, F.lit("amount"))
    merchant = F.when(fuzzy_name_match(F.col(f"{c}merchant"), F.col(f"{e}merchant")), F.lit("merchant"))
    direction = F.when(F.col(f"{c}direction") == F.col(f"{e}direction"), F.lit("direction"))
    return F.array_compact(F.array(time, amount, merchant, direction))


def salted(big: DataFrame, small: DataFrame, keys: list, rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: keys with more than ``rows`` rows in ``big`` are dealt
    over ceil(n / rows) salts, and their rows in ``small`` are repeated once per salt.

    The list of such keys has at most (rows of big) / ``rows`` entries; it is broadcast."""
    n = F.count(F.lit(1))
    hot = F.broadcast(big.groupBy(*keys).agg(F.ceil(n / F.lit(rows)).cast("int").alias("_salts")).where("_salts > 1"))
    dealt = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*big.columns), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    ).drop("_salts")
    repeated = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return dealt, repeated


def band_pairs(cands: DataFrame, existing: DataFrame, s: DedupSettings, self_join: bool = False) -> DataFrame:
    """JN-4: all (candidate, existing) pairs whose soft score reaches 'probable'.

    ``cands``: key, amount, merchant, direction, txn_ts.  ``existing``: same columns
    (key named the same).  With ``self_join`` the pairs are (earlier, later) by key.
    Output: c_key, e_key, c_ts, e_ts, gap_minutes, score, status, reasons."""
    t_width, a_width = _buckets(s)
    c = cands.where(F.col("c_ts").isNotNull())
    e = existing.where(F.col("e_ts").isNotNull())
    c_tb = F.floor(F.col("c_us") / t_width)
    e_tb = F.floor(F.col("e_us") / t_width)
    if a_width is None:
        c = c.withColumn("_ab", F.col("c_amount")).withColumn("_tb", F.explode(F.array(c_tb - 1, c_tb, c_tb + 1)))
        e = e.withColumn("_ab", F.col("e_amount")).withColumn("_tb", e_tb)
    else:
        c = c.withColumn("_ab", F.floor(F.col("c_amount") / a_width)).withColumn(
            "_tb", F.explode(F.array(c_tb - 1, c_tb, c_tb + 1))
        )
        e_ab = F.floor(F.col("e_amount") / a_width)
        e = e.withColumn("_tb", e_tb).withColumn("_ab", F.explode(F.array(e_ab - 1, e_ab, e_ab + 1)))
    c, e = salted(c, e, ["_tb", "_ab"])
    pairs = c.join(e, ["_tb", "_ab", "_salt"])
    if self_join:
        pairs = pairs.where(F.col("c_key") < F.col("e_key"))
    gap, score, status = score_columns(s)
    return (
        pairs.select("*", gap.alias("gap_minutes"), score.alias("score"), status.alias("status"))
        .where(F.col("status").isNotNull())
        .select("c_key", "e_key", "c_ts", "e_ts", "gap_minutes", "score", "status", score_reasons(s).alias("reasons"))
    )


def candidate_side(cands: DataFrame, prefix: str = "c_") -> DataFrame:
    """Normalise a candidate batch (seq, amount, merchant, direction, txn_ts)."""
    m = F.lower(F.trim(F.coalesce(F.col("merchant"), F.lit(""))))
    return _norm_side(cands, "seq", m, DedupSettings(), prefix)


def ledger_side(ledger: DataFrame, prefix: str = "e_") -> DataFrame:
    """Normalise ledger rows (id, amount, description, [merchant], txn_ts); the merchant
    falls back to the description when missing or empty."""
    merch = F.col("merchant") if "merchant" in ledger.columns else F.lit(None).cast("string")
    m = F.lower(F.trim(F.coalesce(F.when(F.coalesce(merch, F.lit("")) != "", merch), F.col("description"), F.lit(""))))
    return _norm_side(ledger, "id", m, DedupSettings(), prefix)


def soft_match_pairs(cands: DataFrame, existing: DataFrame | None, s: DedupSettings) -> DataFrame:
    """JN-4 over raw inputs: candidate batch against ledger rows, or (``existing`` None)
    the batch against itself (earlier, later).  The output has one row per pair, so it is as long as
    the copies in it demand; a bucket that holds many rows is dealt over tasks."""
    c = candidate_side(cands)
    if existing is None:
        return band_pairs(c, candidate_side(cands, "e_"), s, self_join=True)
    return band_pairs(c, ledger_side(existing), s)


# ---------------------------------------------------------------------------
# JN-5: first ledger match per candidate (newest first, ties by id)
# ---------------------------------------------------------------------------

def first_ledger_match(cands: DataFrame, ledger: DataFrame, s: DedupSettings) -> DataFrame:
    """JN-5: per candidate, the first ledger row in newest-first order (ties by id) that
    scores at least 'probable'.

    A sorted sweep instead of a list of pairs.  The ledger times that can match a candidate lie in
    three zones: within the window, where an amount match is enough, and up to two hours
    after or before it, where merchant and direction must match as well.  A candidate is
    joined with the distinct ledger amounts (distinct amounts, merchants and directions) of a time bucket
    only.  Then ledger rows and zone ends are sorted together per ledger value and
    bucket, and the newest row before each zone end is the last one seen, in memory that does not grow with the
    bucket.  Copies (same time and values) are swept once (the first of
    identical ledger rows is the one with the smallest id) and get their match by a many-to-one join."""
    side = candidate_side(cands).where("c_ts is not null")
    value = ["amount", "merchant", "direction"]
    looks = ["c_us", *[f"c_{v}" for v in value]]
    c = side.groupBy(*looks).agg(F.first("c_ts").alias("c_ts"))
    e = ledger_side(ledger).where("e_ts is not null").groupBy("e_us", "e_ts", *[f"e_{v}" for v in value]).agg(
        F.min("e_key").alias("e_key"))
    limit = int(s.max_date_gap_hours * 60 * MICROS_PER_MIN)
    near = min(int(s.time_window_minutes * MICROS_PER_MIN), limit)
    far = min(120 * MICROS_PER_MIN, limit)
    t_width = max(near, far, 1)
    zone = lambda lo, hi, full: F.struct(
        (F.col("c_us") + lo).alias("lo"), (F.col("c_us") + hi).alias("hi"), F.lit(full).alias("full"))
    zones = [zone(-near, near, False)]
    if far > near:
        zones += [zone(near + 1, far, True), zone(-far, -near - 1, True)]

    def valued(df: DataFrame, prefix: str, full: Column) -> DataFrame:
        # merchant and direction count in the outer zones only
        return df.select("*", F.col(f"{prefix}amount").alias("amount"),
                         F.when(full, F.col(f"{prefix}merchant")).otherwise(F.lit("")).alias("merchant"),
                         F.when(full, F.col(f"{prefix}direction")).otherwise(F.lit("")).alias("direction"))

    asks = c.withColumn("z", F.explode(F.array(*zones))).select("*", "z.*").drop("z").withColumn(
        "tb", F.explode(F.sequence(F.floor(F.col("lo") / t_width), F.floor(F.col("hi") / t_width))))
    asks = valued(asks, "c_", F.col("full"))
    rows = e.withColumn("tb", F.floor(F.col("e_us") / t_width)).withColumn(
        "full", F.explode(F.array(*[F.lit(f) for f in ([False, True] if far > near else [False])])))
    rows = valued(rows, "e_", F.col("full"))
    names = ["tb", "full", *value]
    asked = _asked_values(asks, rows.select(*names).distinct(), s).select(
        "tb", "full", *[F.col(f"e_{v}_m").alias(v) for v in value], F.col("hi").alias("at"), "lo", "c_ts", *looks)
    told = rows.select(*names, F.col("e_us").alias("at"),
                       F.struct("e_key", "e_us", "e_ts", *[f"e_{v}" for v in value]).alias("row"))
    both = told.unionByName(asked, allowMissingColumns=True)
    # rows before zone ends of the same time; of rows of one time the smallest id last
    sweep = Window.partitionBy(*names).orderBy("at", F.col("c_us").isNotNull(), F.col("row.e_key").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("row", F.last("row", ignorenulls=True).over(sweep)).where(
        F.col("c_us").isNotNull() & (F.col("row.e_us") >= F.col("lo"))).select("c_ts", *looks, "row.*")
    _, _, status = score_columns(s)
    newest = F.struct(F.col("e_us"), (-F.col("e_key")).alias("id"), status.alias("status"))
    best = found.groupBy(*looks).agg(F.max(newest).alias("_b"))
    return side.join(best, looks).select(
        F.col("c_key").alias("seq"), (-F.col("_b.id")).alias("ledger_id"), F.col("_b.status").alias("ledger_status"))


def _asked_values(asks: DataFrame, values: DataFrame, s: DedupSettings) -> DataFrame:
    """The asks with each matching ledger value of their bucket (``e_<name>_m``)."""
    _, a_width = _buckets(s)
    bucket = F.col("amount") if a_width is None else F.floor(F.col("amount") / a_width)
    right = values.select("tb", "full", F.col("direction"), F.col("amount").alias("e_amount_m"),
                          F.col("merchant").alias("e_merchant_m"), F.col("direction").alias("e_direction_m"), bucket.alias("ab"))
    if a_width is not None:
        right = right.withColumn("ab", F.explode(F.array(F.col("ab") - 1, F.col("ab"), F.col("ab") + 1)))
    left, right = salted(asks.withColumn("ab", bucket), right, ["tb", "full", "direction", "ab"])
    return left.join(right, ["tb", "full", "direction", "ab", "_salt"]).where(
        (F.abs(F.col("amount") - F.col("e_amount_m")) <= s.amount_tolerance)
        & (~F.col("full") | fuzzy_name_match(F.col("merchant"), F.col("e_merchant_m"))))


# ---------------------------------------------------------------------------
# JN-6: within-batch leader election (lexicographically-first maximal independent set)
# ---------------------------------------------------------------------------

def _elected(rows: DataFrame, s: DedupSettings, blocks: int) -> DataFrame:
    """The rows of each block (no guests, no leaders shown to it) with state, leader_seq and pair_status, by one pass per block in
    (``c_key``, ``rid``) order (``election.Block``).  Rows without a key, a time or a finite amount match nothing and lead."""
    t_width, a_width = _buckets(s)

    def elect(batches):
        block = election.Block(s, t_width, a_width)
        for batch in batches:
            yield _passed(block, batch)

    # a block is a partition
    dealt = rows.repartitionById(blocks, "block") if blocks > 1 else rows.repartition(1)
    return dealt.sortWithinPartitions("c_key", "rid").mapInArrow(elect, StructType(
        [*[StructField(n, rows.schema[n].dataType) for n in _ROW], StructField("state", IntegerType()), *_TOLD]))


_ROW = ("c_key", "rid", "c_us", "c_amount", "c_merchant", "c_direction")
_TOLD = (StructField("leader_seq", LongType()), StructField("pair_status", StringType()))  # of rows that wait, not in the first round


def _passed(block: election.Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch of one block, as settled so far."""
    kind, alone = batch.column("kind").to_numpy(), _alone(batch)
    state = np.full(len(batch), election.SETTLED, np.int32)
    follows, best, sure = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
    at = np.flatnonzero(~alone)
    if len(at):
        some = batch.take(pa.array(at)) if alone.any() else batch
        column = lambda name: some.column(name).to_numpy(zero_copy_only=False)
        told, told_sure = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        if "leader_seq" in batch.schema.names:
            told = some.column("leader_seq").fill_null(0).to_numpy(zero_copy_only=False)
            told_sure = pc.equal(some.column("pair_status"), STATUS_AUTO).fill_null(False).to_numpy(zero_copy_only=False)
        state[at], best[at], follows[at], sure[at] = block.pass_(
            kind[at], column("shown"), column("c_us"), column("c_amount"), block.numbers(some.column("c_merchant")),
            block.numbers(some.column("c_direction")), column("c_key").astype(np.int64), told, told_sure)
    how = pc.if_else(pa.array(follows), pc.if_else(pa.array(sure), STATUS_AUTO, STATUS_PROBABLE), pa.scalar(None, pa.string()))
    out = {"c_key": batch.column("c_key")}
    open_ = pa.array(state != election.SETTLED)
    for n in _ROW[1:]:  # no more needed of settled rows
        out[n] = pc.if_else(open_, batch.column(n), pa.scalar(None, batch.column(n).type))
    out |= {"state": pa.array(state), "leader_seq": pa.array(best, pa.int64(), mask=~follows), "pair_status": how}
    out = pa.RecordBatch.from_arrays([*out.values()], [*out])
    mine = (kind == election.HOME) | (kind == election.PENDING)
    return out if mine.all() else out.filter(pa.array(mine))


def _alone(batch: pa.RecordBatch) -> np.ndarray:
    """Rows that match nothing."""
    known = pc.and_(batch.column("c_key").is_valid(), batch.column("c_us").is_valid())
    return ~(pc.and_(known, pc.is_finite(batch.column("c_amount"))).to_numpy(zero_copy_only=False))


def _dealt(rows: DataFrame, s: DedupSettings, tree, boxes: list) -> DataFrame:
    """The rows with their block, and once more, as guests, for each other block that rows they can match may be in."""
    t_width, a_width = _buckets(s)
    a_width = a_width or 0.0
    names = [n for n in rows.columns if n != "state"]
    schema = StructType([*[rows.schema[n] for n in names], StructField("block", IntegerType()), StructField("kind", IntegerType()),
                         StructField("shown", BooleanType())])
    ends = np.array(boxes, float)

    def deal(batches):
        for batch in batches:
            alone = _alone(batch)
            state = batch.column("state").to_numpy() if "state" in batch.schema.names else np.full(len(batch), election.UNSURE, np.int32)
            batch = batch.select(names)
            us = batch.column("c_us").fill_null(0).to_numpy()
            amount = np.where(alone, 0.0, batch.column("c_amount").to_numpy(zero_copy_only=False))
            home = np.where(alone, batch.column("rid").to_numpy() % len(boxes), election.block_of(tree, us, amount)).astype(np.int32)
            kind = np.choose(state, [election.HOME, election.PENDING, election.LEADER]).astype(np.int32)
            times, amounts = ends[home, 0], ends[home, 1]
            near = np.minimum(us - times[:, 0], times[:, 1] - us) <= t_width + MICROS_PER_MIN
            near |= np.minimum(amount - amounts[:, 0], amounts[:, 1] - amount) <= 2 * a_width
            near = np.flatnonzero(near & ~alone & (state != election.WAITING))
            at, to, known = [], [], [home[near]]
            for t in (-t_width, t_width):
                for a in (-a_width, a_width):
                    there = election.block_of(tree, us[near] + t, amount[near] + a)
                    new = np.logical_and.reduce([there != k for k in known])
                    at.append(near[new])
                    to.append(there[new])
                    known.append(there)
            at, to, shown = np.concatenate(at), np.concatenate(to), np.zeros(len(batch), bool)
            shown[at] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(kind), pa.array(shown)], names=schema.names)
            if len(at):
                kind = np.where(kind[at] == election.HOME, election.GUEST, kind[at]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(at)).columns, pa.array(to), pa.array(kind), pa.array(shown[at])], names=schema.names)

    return rows.mapInArrow(deal, schema)


def _cuts(rows: DataFrame, s: DedupSettings, n: int, block_rows: int):
    """A tree of cuts by time and amount into blocks of about ``block_rows`` of the ``n`` rows, and their ends, from a sample."""
    pieces = min(-(-n // block_rows), MOST_BLOCKS)
    if pieces <= 1:
        return 0, [[(-np.inf, np.inf)] * 2]
    t_width, a_width = _buckets(s)
    points = rows.where("c_us is not null and abs(c_amount) < double('infinity')").select("c_us", "c_amount")
    if n > 400 * pieces:
        points = points.sample(False, 400 * pieces / n, 17)
    points = points.toArrow()
    return election.cut_tree(points["c_us"].to_numpy(), points["c_amount"].to_numpy(), len(points) / pieces, t_width, a_width or 0.0)


def batch_leaders(cands: DataFrame, s: DedupSettings, range_rows: int = RANGE_ROWS) -> DataFrame:
    """JN-6: leaders = greedy independent set in ``seq`` order over the match graph;
    each follower joins its earliest matching leader.

    The batch is cut by time and amount into blocks of about ``range_rows`` rows, all elected at once.  A row matches only rows
    up to two hours (or the window) and the tolerance away; those of other blocks are guests.  A block settles the rows that are led
    or lead whatever becomes of the guests; the rest, next to the cuts mostly, go to another round with cuts of
    its own, where they are fewest, until none is left.  The first unsettled row is settled in every round, so the
    result is the sequential one.  Long chains of matches keep many rows unsettled: from the third round on blocks are twice as
    large each time, so the number of rounds grows with the logarithm of the blocks.  Rows of few hours and few amounts are one block, one task: linear in time, with the leaders in memory.  ``cands`` is read three times: its count, a sample and all.
    Output: seq, role ('leader' | 'follower'), leader_seq, pair_status (status of the
    follower's match with its leader; NULL for leaders)."""
    left = candidate_side(cands).withColumn("rid", F.monotonically_increasing_id()).select(*_ROW)
    n, settled, open_ = left.count(), [], True
    while open_:
        tree, boxes = _cuts(left, s, n, range_rows << max(len(settled) - 1, 0))  # twice as many from the third round on
        done = written(_elected(_dealt(left, s, tree, boxes), s, len(boxes)), "elected")
        settled.append(done.where(F.col("state") >= election.SHOWN))
        left = done.where(F.col("state") < election.SETTLED)
        counts = {r.state: r["count"] for r in left.groupBy("state").count().collect()}
        n, open_ = sum(counts.values()), counts.keys() - {election.SHOWN}
    out = reduce(DataFrame.unionByName, settled)
    follows = F.col("leader_seq").isNotNull()
    return out.select(F.col("c_key").alias("seq"), F.when(follows, F.lit("follower")).otherwise(F.lit("leader")).alias("role"),
                      F.coalesce("leader_seq", "c_key").alias("leader_seq"), "pair_status")


def batch_statuses(cands: DataFrame, s: DedupSettings) -> DataFrame:
    """Statuses from the leader election and the reference-count rule: a follower with
    more reference ids than its leader stays new (and the leader becomes auto_merged);
    otherwise the follower is auto_merged.  ``single_survivor`` keeps only the richest,
    earliest row of a group new."""
    cands = written(cands, "batch")
    roles = batch_leaders(cands, s)
    nref = cands.select("seq", F.size(F.coalesce(F.col("reference_ids"), F.create_map())).alias("n_refs"))
    r = roles.join(nref, "seq").join(
        nref.select(F.col("seq").alias("leader_seq"), F.col("n_refs").alias("leader_refs")), "leader_seq"
    )
    if s.single_survivor:
        best = r.groupBy("leader_seq").agg(F.max_by("seq", F.struct("n_refs", -F.col("seq"))).alias("_keep"))
        r = r.join(best, "leader_seq")
        return r.select(
            "seq", "role", "leader_seq",
            F.when(F.col("seq") == F.col("_keep"), F.lit(STATUS_NEW)).otherwise(F.lit(STATUS_AUTO)).alias("batch_status"),
        )
    richer = r.where((F.col("role") == "follower") & (F.col("n_refs") > F.col("leader_refs")))
    swapped = richer.select(F.col("leader_seq").alias("seq")).distinct().withColumn("_swapped", F.lit(True))
    out = r.join(swapped, "seq", "left")
    merged = F.lit(STATUS_AUTO)
    if s.batch_probable == "flag":
        merged = F.when(F.col("pair_status") == STATUS_PROBABLE, F.lit(STATUS_PROBABLE)).otherwise(F.lit(STATUS_AUTO))
    follower_status = F.when(F.col("n_refs") > F.col("leader_refs"), F.lit(STATUS_NEW)).otherwise(merged)
    leader_status = F.when(F.col("_swapped"), F.lit(STATUS_AUTO)).otherwise(F.lit(STATUS_NEW))
    return out.select(
        "seq", "role", "leader_seq",
        F.when(F.col("role") == "leader", leader_status).otherwise(follower_status).alias("batch_status"),
    )


# ---------------------------------------------------------------------------
# JN-7: the full dedup with stage precedence; AGG-9
# ---------------------------------------------------------------------------

def deduplicate(
    cands: DataFrame,
    ledger: DataFrame,
    known: DataFrame,
    s: DedupSettings,
) -> DataFrame:
    """JN-7: no transaction -> new; hard -> definite_duplicate; ledger -> auto_merged /
    probable_duplicate (+ ledger id); batch -> new / auto_merged; else new.

    ``cands``: seq, has_txn, amount, merchant, direction, txn_ts, reference_ids.
    Output: seq, dedup_status, merged_with_ledger_id, probable_match_ledger_id,
    batch_leader_seq, matched_message_id."""
    with_txn = cands.where(F.col("has_txn"))
    no_txn = cands.where(~F.col("has_txn")).select("seq")
    hard = hard_matches(with_txn, known)
    if s.hard_within_batch:
        hard = hard.unionByName(_hard_within_batch(with_txn)).groupBy("seq").agg(
            F.min("matched_message_id").alias("matched_message_id")
        )
    hard = cut_lineage(hard)
    rest = with_txn.join(hard, "seq", "left_anti")
    lm = cut_lineage(first_ledger_match(rest, ledger, s))
    rest2 = rest.join(lm, "seq", "left_anti")
    bs = batch_statuses(rest2, s)
    out = (
        no_txn.select("seq", F.lit(STATUS_NEW).alias("dedup_status"))
        .unionByName(hard.select("seq", F.lit(STATUS_DEFINITE).alias("dedup_status")), allowMissingColumns=True)
        .unionByName(
            lm.select(
                "seq",
                F.col("ledger_status").alias("dedup_status"),
                F.when(F.col("ledger_status") == STATUS_AUTO, F.col("ledger_id")).alias("merged_with_ledger_id"),
                F.when(F.col("ledger_status") == STATUS_PROBABLE, F.col("ledger_id")).alias("probable_match_ledger_id"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            bs.select(
                "seq", F.col("batch_status").alias("dedup_status"),
                F.when(F.col("role") == "follower", F.col("leader_seq")).alias("batch_leader_seq"),
            ),
            allowMissingColumns=True,
        )
    )
    # Rows of the batch stage that had no match at all are leaders without followers.
    out = out.join(hard.select("seq", "matched_message_id"), "seq", "left")
    return out.select(
        "seq", "dedup_status",
        F.col("merged_with_ledger_id").cast("bigint").alias("merged_with_ledger_id"),
        F.col("probable_match_ledger_id").cast("bigint").alias("probable_match_ledger_id"),
        F.col("batch_leader_seq").cast("bigint").alias("batch_leader_seq"),
        "matched_message_id",
    )


def _hard_within_batch(with_txn: DataFrame) -> DataFrame:
    """Optional: a later candidate sharing a reference value with an earlier one."""
    vals = with_txn.select("seq", F.explode(F.map_values("reference_ids")).alias("_v")).where(
        F.col("_v").isNotNull() & (F.col("_v") != "")
    ).select("seq", F.lower("_v").alias("ref"))
    first = vals.groupBy("ref").agg(F.min("seq").alias("_first"))
    return (
        vals.join(first, "ref").where(F.col("seq") > F.col("_first"))
        .groupBy("seq").agg(F.min(F.concat(F.lit("batch:"), F.col("_first").cast("string"))).alias("matched_message_id"))
    )


def status_counts(dedup: DataFrame) -> DataFrame:
    """AGG-9: count per dedup status (all four statuses present, zero when absent)."""
    statuses = dedup.sparkSession.createDataFrame(
        [(x,) for x in (STATUS_NEW, STATUS_AUTO, STATUS_PROBABLE, STATUS_DEFINITE)], "dedup_status string"
    )
    counts = dedup.groupBy("dedup_status").agg(F.count(F.lit(1)).alias("n"))
    return statuses.join(counts, "dedup_status", "left").select(
        "dedup_status", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")
    )
