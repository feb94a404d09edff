"""DuckDB SQL for each registered query (same column names as the Spark side)."""

from __future__ import annotations

from spendlake.plans.oracle_views import LEDGER_CTES

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


_MC = """
mc AS (SELECT month_key, category, sum(amount) AS spent FROM active_expenses GROUP BY month_key, category),
cat AS (
  SELECT mc.month_key, mc.category, mc.spent, coalesce(bm.budget_limit, bd.budget_limit) AS budget
  FROM mc
  LEFT JOIN budgets bm ON bm.month_key = mc.month_key AND bm.category = mc.category
  LEFT JOIN budgets bd ON bd.month_key = 'default' AND bd.category = mc.category
),
mon AS (SELECT month_key, sum(spent) AS spent FROM mc GROUP BY month_key),
mon_b AS (
  SELECT mon.month_key, mon.spent, coalesce(bm.budget_limit, bd.budget_limit) AS budget
  FROM mon
  LEFT JOIN budgets bm ON bm.month_key = mon.month_key AND bm.category IS NULL
  LEFT JOIN budgets bd ON bd.month_key = 'default' AND bd.category IS NULL
),
report AS (
  SELECT month_key, 'month' AS level, CAST(NULL AS VARCHAR) AS category, round(spent, 2) AS spent, budget,
         CAST(NULL AS DOUBLE) AS remaining, CAST(NULL AS BOOLEAN) AS overspent,
         round(CASE WHEN budget IS NOT NULL AND budget <> 0 THEN budget - spent END, 2) AS savings,
         CASE WHEN budget > 0 THEN round(spent / budget * 100, 2) ELSE 0.0 END AS percentage,
         CAST(NULL AS INTEGER) AS rank
  FROM mon_b
  UNION ALL
  SELECT month_key, 'category', category, round(spent, 2), budget, round(budget - spent, 2), spent > budget,
         CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
         CAST(row_number() OVER (PARTITION BY month_key ORDER BY spent DESC, category NULLS FIRST) AS INTEGER)
  FROM cat
)"""

sql("monthly_budget_report", f"WITH {LEDGER_CTES}, {_MC} SELECT * FROM report")

sql("period_totals", f"""
WITH {LEDGER_CTES},
daily AS (SELECT txn_date, sum(amount) AS daily_spent FROM active_expenses GROUP BY txn_date),
d2 AS (SELECT txn_date, daily_spent, CAST(date_trunc('week', txn_date) AS DATE) AS week_start,
              strftime(txn_date, '%Y-%m') AS month_key FROM daily)
SELECT txn_date, round(daily_spent, 2) AS daily_spent, week_start,
       round(sum(daily_spent) OVER (PARTITION BY week_start), 2) AS weekly_spent,
       month_key, round(sum(daily_spent) OVER (PARTITION BY month_key), 2) AS monthly_spent
FROM d2
""")

sql("category_breakdown", f"""
WITH {LEDGER_CTES},
mc AS (SELECT month_key, category, sum(amount) AS spent FROM active_expenses GROUP BY month_key, category)
SELECT month_key, category, round(spent, 2) AS spent,
       CAST(row_number() OVER (PARTITION BY month_key ORDER BY spent DESC, category NULLS FIRST) AS INTEGER) AS rank
FROM mc
""")

sql("list_categories", f"WITH {LEDGER_CTES} SELECT DISTINCT category FROM active_expenses ORDER BY category")

sql("budget_alerts", f"""
WITH {LEDGER_CTES}, {_MC}
SELECT month_key, 'monthly_threshold' AS alert, category, spent, budget, percentage
FROM report WHERE level = 'month' AND percentage >= 80.0
UNION ALL
SELECT month_key, 'category_overspent', category, spent, budget,
       CASE WHEN budget <> 0 THEN round(spent / budget * 100, 2) END
FROM report WHERE level = 'category' AND overspent
""")

sql("resolved_budgets", f"""
WITH {LEDGER_CTES},
g AS (SELECT DISTINCT month_key, category FROM expenses),
m AS (SELECT DISTINCT month_key FROM expenses)
SELECT g.month_key, g.category,
       coalesce(bm.budget_limit, bd.budget_limit) AS category_budget,
       coalesce(om.budget_limit, od.budget_limit) AS overall_budget
FROM g
LEFT JOIN budgets bm ON bm.month_key = g.month_key AND bm.category = g.category
LEFT JOIN budgets bd ON bd.month_key = 'default' AND bd.category = g.category
JOIN m ON m.month_key = g.month_key
LEFT JOIN budgets om ON om.month_key = m.month_key AND om.category IS NULL
LEFT JOIN budgets od ON od.month_key = 'default' AND od.category IS NULL
WHERE g.month_key IS NOT NULL
""")


# ---------------------------------------------------------------------------
# Message extraction, generated from the pattern registry
# ---------------------------------------------------------------------------

# Cues and finders written out for DuckDB; the registry of the library is not read here.
_RX = {
    "debit": r"(?is)(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d{1,2})?)(?:\s+\w+){0,3}?\s+(?:debited|withdrawn|deducted|charged|spent)\b",
    "upi_debit": r"(?is)(\d[\d,]*(?:\.\d{1,2})?)(?:\s+\w+){0,3}?\s+debited\b",
    "order": r"(?is)\b(?:total|amount|paid|order\s+(?:of|for|worth))\b[^\n\d]{0,20}(\d[\d,]*(?:\.\d{1,2})?)",
    "ride": r"(?is)\b(?:total|fare|amount|charged|paid)\b[^\n\d]{0,20}(\d[\d,]*(?:\.\d{1,2})?)",
    "sent": r"(?is)(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d{1,2})?)(?:\s+\w+){0,3}?\s+(?:paid|sent|debited)\b",
    "sent_first": r"(?is)\b(?:paid|sent)\s+(?:rs\.?|inr|₹)\s*(\d[\d,]*(?:\.\d{1,2})?)",
    "payee": r"(?is)\b(?:to|at|towards)\s+(?:your\s[^\n]*?\b(?:to|at|towards)\s+)?(\S[^\n]*?)"
             r"\s*(?:\b(?:on|via|using|dated|ref|avl)\b|[.,;]\s|[.,;]?\z|\n)",
    "day": r"(?is)\b(\d{2}[-/]\d{2}[-/](?:\d{4}|\d{2}))\b",
    "ref_no": r"(?is)\bref(?:erence)?\b\.?\s*(?:(?:no|number|id)\b\.?)?\s*[:#-]?\s*([\w-]*\d[\w-]*)",
    "upi_ref": r"(?is)\bupi\b[^\n\d]{0,12}(\d{6,})",
    "upi_id": r"(?is)\b(?:vpa|upi(?:\s+id)?)\b\s*:?\s*([\w.-]+@\w+)",
    "utr": r"(?is)\butr\b\s*(?:(?:no|number)\b\.?)?\s*[:#-]?\s*([\w-]*\d[\w-]*)",
    "txn_id": r"(?is)\b(?:transaction|order)\s+id\b\s*[:#]?\s*([\w-]*\d[\w-]*)",
    "order_id": r"(?is)\border\s*(?:(?:id|no|number)\b\.?\s*[:#]?|#|:)\s*([\w-]*\d[\w-]*)",
    "trip_id": r"(?is)\btrip\s*(?:id\b)?\s*[:#]?\s*([\w-]*\d[\w-]*)",
    "booking_id": r"(?is)\bbooking\s*(?:id\b)?\s*[:#]?\s*([\w-]*\d[\w-]*)",
}
# (family, name, cue, required field, fields besides the days), in the order of trial.
_TRIALS = (
    ("hdfcbank", "HDFC debit alert", "debit", "merchant", ("merchant", "ref_no", "upi_ref")),
    ("hdfcbank", "HDFC UPI debit", "upi_debit", "upi_id", ("upi_id", "ref_no")),
    ("sbi", "SBI debit alert", "debit", "merchant", ("merchant", "ref_no")),
    ("icicibank", "ICICI debit alert", "debit", "merchant", ("merchant", "ref_no")),
    ("axisbank", "Axis debit alert", "debit", "merchant", ("merchant", "ref_no", "utr")),
    ("equitas", "Equitas debit alert", "debit", "merchant", ("merchant", "ref_no")),
    ("swiggy", "Swiggy order confirmation", "order", None, ("order_id",)),
    ("zomato", "Zomato order confirmation", "order", None, ("order_id",)),
    ("amazon", "Amazon order confirmation", "order", None, ("order_id",)),
    ("flipkart", "Flipkart order confirmation", "order", None, ("order_id",)),
    ("uber", "Uber trip receipt", "ride", None, ("trip_id",)),
    ("ola", "Ola ride receipt", "ride", None, ("booking_id",)),
    ("phonepe", "PhonePe transaction", "sent", "merchant", ("merchant", "txn_id")),
    ("phonepe", "PhonePe transaction", "sent_first", "merchant", ("merchant", "txn_id")),
    ("paytm", "Paytm transaction", "sent", "merchant", ("merchant", "txn_id")),
    ("paytm", "Paytm transaction", "sent_first", "merchant", ("merchant", "txn_id")),
    (None, "Generic debit pattern", "debit", None, ("merchant", "ref_no", "utr")),
)


def _extraction_sql(source: str = "messages", with_messages: bool = True) -> str:
    from spendlake.config import DEFAULT_ALLOWED_SENDERS
    from spendlake.functions.parsing import BRAND_BY_SENDER, MERCHANT_NOISE, REF_TYPES
    from spendlake.plans.oracle_views import MESSAGES_CTE
    from spendlake.sources.tables import EVENTS_AS_OF

    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    families = list(dict.fromkeys(t[0] for t in _TRIALS if t[0]))
    fam = "CASE " + " ".join(
        f"WHEN contains(lower(coalesce(sender_email, '')), {lit(k)}) THEN {lit(k)}" for k in families
    ) + " ELSE CAST(NULL AS VARCHAR) END"
    allowed = " OR ".join(f"contains(lower(coalesce(sender_email, '')), {lit(a.lower())})" for a in DEFAULT_ALLOWED_SENDERS)

    def read(field, cue):
        if field == "amount":
            return f"regexp_extract(_text, {lit(_RX[cue])}, 1)"
        rest = f"regexp_extract(_text, {lit(_RX[cue])}, 0)"
        rest = f"substr(_text, strpos(_text, {rest}) + length({rest}))"
        where, rx = {"merchant": (rest, "payee"), "date": (rest, "day"), "date2": ("_text", "day")}.get(field, ("_text", field))
        return f"regexp_extract({where}, {lit(_RX[rx])}, 1)"

    hits = []
    for i, (family, _, cue, need, _) in enumerate(_TRIALS):
        applies = f"family = {lit(family)}" if family else "TRUE"
        amt = f"coalesce(TRY_CAST(replace({read('amount', cue)}, ',', '') AS DOUBLE), 0.0)"
        needed = f" AND {read(need, cue)} <> ''" if need else ""
        hits.append(f"({applies} AND {amt} > 0{needed}) AS h{i}")
    win = "CASE " + " ".join(f"WHEN h{i} THEN {i}" for i in range(len(_TRIALS))) + " END"

    def pick(field):
        arms = []
        for i, (_, _, cue, need, fields) in enumerate(_TRIALS):
            known = field == "amount" or field in fields or (field in ("date", "date2") and cue not in ("order", "ride"))
            if known:
                arms.append(f"WHEN {i} THEN {read(field, cue)}")
            elif field == "ref_no" and "txn_id" in fields:
                arms.append(f"WHEN {i} THEN {read('txn_id', cue)}")
        return "(CASE _w " + " ".join(arms) + " END)"

    names = "CASE _w " + " ".join(f"WHEN {i} THEN {lit(t[1])}" for i, t in enumerate(_TRIALS)) + " END"
    brand = "CASE " + " ".join(
        f"WHEN contains(lower(coalesce(sender_email, '')), {lit(k)}) THEN {lit(v)}" for k, v in BRAND_BY_SENDER
    ) + " END"
    ref_cols = ", ".join(f"trim(coalesce({pick(t)}, '')) AS r_{t}" for t in REF_TYPES)
    desc_parts = ", ".join(f"CASE WHEN r_{t} <> '' THEN '[{t}: ' || r_{t} || ']' END" for t in REF_TYPES)
    date_re = r"^(\d{2})([-/])(\d{2})([-/])(\d{4}|\d{2})$"
    as_of = f"DATE '{EVENTS_AS_OF}'"
    head = f"WITH {MESSAGES_CTE}," if with_messages else ""
    return f"""
{head}
m1 AS (
  SELECT *, coalesce(subject, '') || chr(10) || coalesce(body, '') AS _text, {fam} AS family,
         ({allowed}) AS allowed
  FROM {source}
),
m2 AS (SELECT *, {", ".join(hits)} FROM m1),
m3 AS (SELECT *, {win} AS _w FROM m2),
m4 AS (
  SELECT *, {pick('amount')} AS r_amount, trim(coalesce({pick('merchant')}, '')) AS r_merchant,
         {pick('date')} AS r_date1, {pick('date2')} AS r_date2, {ref_cols}
  FROM m3
),
m5 AS (
  SELECT *,
    trim(regexp_replace(r_merchant, {lit(MERCHANT_NOISE)}, ''), ' .') AS cleaned,
    trim(CASE WHEN coalesce(r_date1, '') <> '' THEN r_date1 ELSE r_date2 END) AS raw_date
  FROM m4
),
m6 AS (
  SELECT *,
    CASE WHEN cleaned <> '' THEN cleaned
         ELSE coalesce({brand}, CASE WHEN subject IS NOT NULL AND subject <> '' THEN subject ELSE 'Unknown' END)
    END AS merchant,
    regexp_extract(raw_date, '{date_re}', 1) AS dd, regexp_extract(raw_date, '{date_re}', 2) AS s1,
    regexp_extract(raw_date, '{date_re}', 3) AS mm, regexp_extract(raw_date, '{date_re}', 4) AS s2,
    regexp_extract(raw_date, '{date_re}', 5) AS yy
  FROM m5
),
m7 AS (
  SELECT *,
    CASE WHEN raw_date IS NULL OR raw_date = '' THEN
           coalesce(CASE WHEN regexp_matches(received_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')
                         THEN CAST(try_strptime(substr(received_at, 1, 10), '%Y-%m-%d') AS DATE) END, {as_of})
         ELSE coalesce(CASE WHEN length(dd) = 2 AND s1 = s2 THEN CAST(try_strptime(
                lpad(CAST(CASE WHEN length(yy) = 4 THEN CAST(yy AS INTEGER)
                               WHEN CAST(yy AS INTEGER) >= 69 THEN CAST(yy AS INTEGER) + 1900
                               ELSE CAST(yy AS INTEGER) + 2000 END AS VARCHAR), 4, '0') || '-' || mm || '-' || dd,
                '%Y-%m-%d') AS DATE) END, {as_of})
    END AS txn_date
  FROM m6
),
parsed AS (
  SELECT seq, email_uid, message_id, "from", sender_email, subject, body, received_at, family, allowed,
    CASE WHEN _w IS NOT NULL THEN 'regex' ELSE 'llm_needed' END AS parse_method,
    CASE WHEN _w IS NOT NULL AND family IS NOT NULL THEN 0.9 WHEN _w IS NOT NULL THEN 0.7 ELSE 0.0 END AS confidence,
    {names} AS pattern_name,
    CASE WHEN _w IS NOT NULL THEN coalesce(TRY_CAST(replace(r_amount, ',', '') AS DOUBLE), 0.0) END AS amount,
    CASE WHEN _w IS NOT NULL THEN merchant END AS merchant,
    CASE WHEN _w IS NOT NULL THEN 'debit' END AS direction,
    CASE WHEN _w IS NOT NULL THEN strftime(txn_date, '%Y-%m-%d') END AS transaction_date,
    CASE WHEN _w IS NOT NULL THEN concat_ws(' ', merchant, {desc_parts}) END AS description,
    {", ".join(f"CASE WHEN _w IS NOT NULL THEN NULLIF(r_{t}, '') END AS {t}" for t in REF_TYPES)},
    CASE WHEN _w IS NULL THEN coalesce(body, '') END AS body_for_review
  FROM m7
)"""


PARSED_CTE = _extraction_sql()

sql("message_extraction", f"""
{PARSED_CTE}
SELECT seq, email_uid, family, parse_method, CAST(confidence AS DOUBLE) AS confidence, pattern_name, amount, merchant,
       direction, transaction_date, description, ref_no, upi_ref, upi_id, utr, order_id, trip_id, booking_id
FROM parsed
""")

sql("parser_stats", f"""
{PARSED_CTE}
SELECT count(*) AS total_parsed, CAST(count_if(parse_method = 'regex') AS BIGINT) AS regex_hits,
       CAST(count_if(parse_method = 'llm_needed') AS BIGINT) AS llm_needed,
       CASE WHEN count(*) > 0 THEN round(count_if(parse_method = 'regex') / count(*) * 100, 1) ELSE 0.0 END AS hit_rate_pct
FROM parsed
""")

sql("pattern_breakdown", f"""
{PARSED_CTE}
SELECT coalesce(pattern_name, 'llm_fallback') AS pattern, count(*) AS count
FROM parsed GROUP BY 1 ORDER BY count DESC, pattern
""")

sql("review_queue", f"""
{PARSED_CTE}
SELECT email_uid, subject, CAST(confidence AS DOUBLE) AS confidence, CAST(length(body_for_review) AS INTEGER) AS review_chars,
       sha256(body_for_review) AS review_sha
FROM parsed WHERE parse_method = 'llm_needed'
""")

sql("sender_split", f"""
{PARSED_CTE}
SELECT seq, sender_email, allowed, family FROM parsed
""")


# ---------------------------------------------------------------------------
# Dedup (band join written as a plain theta join; first match by window)
# ---------------------------------------------------------------------------

def _dedup_sql():
    from spendlake.config import DedupSettings
    from spendlake.plans.catalog import DEDUP_AS_OF_TS, DEDUP_REF_DAYS
    from spendlake.plans.oracle_views import EVENT_TXN_CTE

    s = DedupSettings()
    width = max(s.time_window_minutes, 120.0) * 60_000_000

    def score(c, e):
        gap = f"(abs({c}.us - {e}.us) / 60000000.0)"
        t = (f"(CASE WHEN {gap} <= {s.time_window_minutes} THEN 1.5 WHEN {gap} / 60.0 > 24 THEN -2.0 "
             f"WHEN {gap} / 60.0 > 2 THEN -1.0 ELSE 0.0 END)")
        merch = (f"({c}.m <> '' AND {e}.m <> '' AND (contains({c}.m, {e}.m) OR contains({e}.m, {c}.m)))")
        sc = (f"({t} + CASE WHEN abs({c}.amount - {e}.amount) <= {s.amount_tolerance} THEN 2.0 ELSE 0.0 END"
              f" + CASE WHEN {merch} THEN 1.0 ELSE 0.0 END + CASE WHEN {c}.d = {e}.d THEN 0.5 ELSE 0.0 END)")
        status = (f"CASE WHEN {gap} / 60.0 > {s.max_date_gap_hours} THEN NULL WHEN {sc} >= 4.5 THEN 'auto_merged' "
                  f"WHEN {sc} >= 3.5 THEN 'probable_duplicate' END")
        return gap, sc, status

    band = f"abs(c.amount - e.amount) <= {s.amount_tolerance} AND abs(c.us - e.us) <= {width}"
    gap, sc, status = score("c", "e")
    reasons = (f"concat_ws(',', CASE WHEN {gap} <= {s.time_window_minutes} THEN 'time_within_window' WHEN {gap} / 60.0 > 24 THEN 'gap_over_24h' "
               f"WHEN {gap} / 60.0 > 2 THEN 'gap_over_2h' END, CASE WHEN abs(c.amount - e.amount) <= {s.amount_tolerance} THEN 'amount' END, "
               "CASE WHEN c.m <> '' AND e.m <> '' AND (contains(c.m, e.m) OR contains(e.m, c.m)) THEN 'merchant' END, "
               "CASE WHEN c.d = e.d THEN 'direction' END)")
    ctes = f"""
WITH {EVENT_TXN_CTE},
b AS (SELECT seq, amount, lower(trim(coalesce(merchant, ''))) AS m, coalesce(direction, 'debit') AS d,
             txn_ts AS ts, epoch_us(txn_ts) AS us, ref FROM batch_ev),
a AS (SELECT seq, amount, lower(trim(coalesce(merchant, ''))) AS m, coalesce(direction, 'debit') AS d,
             ts, epoch_us(ts) AS us, ref FROM txn),
l AS (SELECT id, amount, lower(trim(coalesce(description, ''))) AS m, 'debit' AS d, txn_ts AS ts,
             epoch_us(txn_ts) AS us FROM ledger_ev 
      WHERE CAST(txn_ts AS DATE) >= (SELECT min(CAST(txn_ts AS DATE)) FROM batch_ev) - INTERVAL 2 DAY),
self_pairs AS (
  SELECT c.seq AS c_key, e.seq AS e_key, {gap} AS gap_minutes, {sc} AS score, {status} AS status, {reasons} AS reasons
  FROM a c JOIN a e ON c.seq < e.seq AND {band}
),
ledger_pairs AS (
  SELECT c.seq AS c_key, e.id AS e_key, e.ts AS e_ts, {sc} AS score, {status} AS status
  FROM b c JOIN l e ON {band}
),
first_match AS (
  SELECT c_key AS seq, e_key AS ledger_id, score, status AS ledger_status FROM (
    SELECT *, row_number() OVER (PARTITION BY c_key ORDER BY e_ts DESC, e_key) AS rn
    FROM ledger_pairs WHERE status IS NOT NULL) WHERE rn = 1
),
known AS (
  SELECT ref, message_id FROM (
    SELECT lower(ref) AS ref, message_id,
           row_number() OVER (PARTITION BY lower(ref) ORDER BY processed_at DESC, seq DESC) AS rn
    FROM checkpoint_ev
    WHERE processed_at >= TIMESTAMP '{DEDUP_AS_OF_TS}' - INTERVAL {DEDUP_REF_DAYS} DAY AND ref <> '')
  WHERE rn = 1
),
hard AS (SELECT b.seq, known.message_id AS matched_message_id FROM b JOIN known ON lower(b.ref) = known.ref)"""
    return ctes


DEDUP_CTES = _dedup_sql()

sql("soft_match_pairs", f"""{DEDUP_CTES}
SELECT c_key, e_key, round(gap_minutes, 4) AS gap_minutes, CAST(score AS DOUBLE) AS score, status, reasons
FROM self_pairs WHERE status IS NOT NULL""")

sql("ledger_first_match", f"{DEDUP_CTES} SELECT seq, ledger_id, ledger_status FROM first_match")

sql("known_references", f"{DEDUP_CTES} SELECT ref, message_id FROM known")

sql("hard_matches", f"{DEDUP_CTES} SELECT seq, matched_message_id FROM hard")


def _batch_sql(pairs_from: str) -> str:
    """Sequential greedy walk (recursive CTE) over the nodes that have edges."""
    return f"""
edges AS (SELECT c_key AS src, e_key AS dst FROM {pairs_from} WHERE status IS NOT NULL),
gnodes AS (
  SELECT seq, row_number() OVER (ORDER BY seq) AS rn,
         coalesce((SELECT list(src) FROM edges WHERE dst = x.seq), []::BIGINT[]) AS srcs
  FROM (SELECT src AS seq FROM edges UNION SELECT dst FROM edges) x
),
walk(rn, seq, is_leader, leaders) AS (
  SELECT 0, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), []::BIGINT[]
  UNION ALL
  SELECT n.rn, n.seq, NOT list_has_any(n.srcs, w.leaders),
         CASE WHEN list_has_any(n.srcs, w.leaders) THEN w.leaders ELSE list_append(w.leaders, n.seq) END
  FROM walk w JOIN gnodes n ON n.rn = w.rn + 1
),
glead AS (SELECT seq FROM walk WHERE is_leader),
roles AS (
  SELECT seq, 'leader' AS role, seq AS leader_seq FROM bnodes WHERE seq NOT IN (SELECT seq FROM gnodes)
  UNION ALL SELECT seq, 'leader', seq FROM glead
  UNION ALL
  SELECT e.dst, 'follower', min(e.src) FROM edges e
  WHERE e.src IN (SELECT seq FROM glead) AND e.dst NOT IN (SELECT seq FROM glead) GROUP BY e.dst
)"""


sql("batch_leaders", f"""{DEDUP_CTES.replace('WITH ', 'WITH RECURSIVE ', 1)},
bnodes AS (SELECT seq FROM a),
{_batch_sql('self_pairs')}
SELECT seq, role, leader_seq FROM roles""")


def _full_dedup_sql() -> str:
    from spendlake.config import DedupSettings
    s = DedupSettings()
    width = max(s.time_window_minutes, 120.0) * 60_000_000
    gap = "(abs(c.us - e.us) / 60000000.0)"
    t = (f"(CASE WHEN {gap} <= {s.time_window_minutes} THEN 1.5 WHEN {gap} / 60.0 > 24 THEN -2.0 "
         f"WHEN {gap} / 60.0 > 2 THEN -1.0 ELSE 0.0 END)")
    merch = "(c.m <> '' AND e.m <> '' AND (contains(c.m, e.m) OR contains(e.m, c.m)))"
    sc = (f"({t} + CASE WHEN abs(c.amount - e.amount) <= {s.amount_tolerance} THEN 2.0 ELSE 0.0 END"
          f" + CASE WHEN {merch} THEN 1.0 ELSE 0.0 END + CASE WHEN c.d = e.d THEN 0.5 ELSE 0.0 END)")
    status = (f"CASE WHEN {gap} / 60.0 > {s.max_date_gap_hours} THEN NULL WHEN {sc} >= 4.5 THEN 'auto_merged' "
              f"WHEN {sc} >= 3.5 THEN 'probable_duplicate' END")
    band = f"abs(c.amount - e.amount) <= {s.amount_tolerance} AND abs(c.us - e.us) <= {width}"
    return f"""{DEDUP_CTES.replace('WITH ', 'WITH RECURSIVE ', 1)},
r1 AS (SELECT * FROM b WHERE seq NOT IN (SELECT seq FROM hard)),
lp AS (SELECT c.seq AS c_key, e.id AS e_key, e.ts AS e_ts, {status} AS status FROM r1 c JOIN l e ON {band}),
fm AS (SELECT c_key AS seq, e_key AS ledger_id, status AS ledger_status FROM (
         SELECT *, row_number() OVER (PARTITION BY c_key ORDER BY e_ts DESC, e_key) AS rn
         FROM lp WHERE status IS NOT NULL) WHERE rn = 1),
r2 AS (SELECT * FROM r1 WHERE seq NOT IN (SELECT seq FROM fm)),
bnodes AS (SELECT seq FROM r2),
sp AS (SELECT c.seq AS c_key, e.seq AS e_key, {status} AS status FROM r2 c JOIN r2 e ON c.seq < e.seq AND {band}),
{_batch_sql('sp')},
nref AS (SELECT seq, CASE WHEN ref <> '' THEN 1 ELSE 0 END AS n_refs FROM b),
rr AS (
  SELECT r.seq, r.role, r.leader_seq, n1.n_refs, n2.n_refs AS leader_refs
  FROM roles r JOIN nref n1 ON n1.seq = r.seq JOIN nref n2 ON n2.seq = r.leader_seq
),
swapped AS (SELECT DISTINCT leader_seq AS seq FROM rr WHERE role = 'follower' AND n_refs > leader_refs),
statuses AS (
  SELECT seq, 'definite_duplicate' AS dedup_status, CAST(NULL AS BIGINT) AS merged_with_ledger_id,
         CAST(NULL AS BIGINT) AS probable_match_ledger_id, CAST(NULL AS BIGINT) AS batch_leader_seq,
         matched_message_id FROM hard
  UNION ALL
  SELECT seq, ledger_status, CASE WHEN ledger_status = 'auto_merged' THEN ledger_id END,
         CASE WHEN ledger_status = 'probable_duplicate' THEN ledger_id END, NULL, NULL FROM fm
  UNION ALL
  SELECT seq,
         CASE WHEN role = 'leader' THEN CASE WHEN seq IN (SELECT seq FROM swapped) THEN 'auto_merged' ELSE 'new' END
              WHEN n_refs > leader_refs THEN 'new' ELSE 'auto_merged' END,
         NULL, NULL, CASE WHEN role = 'follower' THEN leader_seq END, NULL
  FROM rr
)"""


FULL_DEDUP = _full_dedup_sql()
sql("dedup_statuses", f"{FULL_DEDUP} SELECT * FROM statuses")
sql("dedup_status_counts", f"""{FULL_DEDUP}
SELECT s.dedup_status, CAST(count(x.seq) AS BIGINT) AS n
FROM (VALUES ('new'), ('auto_merged'), ('probable_duplicate'), ('definite_duplicate')) s(dedup_status)
LEFT JOIN statuses x ON x.dedup_status = s.dedup_status GROUP BY s.dedup_status""")


# ---------------------------------------------------------------------------
# Suggestions and roll-up
# ---------------------------------------------------------------------------

_TERMS = """
terms AS (
  SELECT DISTINCT lower(term) AS term FROM (
    SELECT unnest(string_split(p_name, ' ')) AS term FROM part
    UNION ALL SELECT p_name FROM part) WHERE term IS NOT NULL
)"""

sql("category_suggestions", f"""
WITH {LEDGER_CTES}, {_TERMS},
m AS (
  SELECT t.term, e.category, count(*) AS cnt
  FROM terms t JOIN active_expenses e
    ON e.description IS NOT NULL AND contains(lower(e.description), t.term)
  GROUP BY t.term, e.category
),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cnt DESC, category NULLS FIRST) AS rn FROM m),
pt AS (
  SELECT term, max(CASE WHEN rn = 1 THEN category END) AS suggested, max(CASE WHEN rn = 1 THEN cnt END) AS confidence,
         sum(cnt) AS total_matches,
         string_agg(coalesce(category, '') || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY coalesce(category, '') || ':' || CAST(cnt AS VARCHAR)) AS histogram
  FROM r GROUP BY term
)
SELECT t.term, pt.suggested, CAST(coalesce(pt.confidence, 0) AS BIGINT) AS confidence,
       CAST(coalesce(pt.total_matches, 0) AS BIGINT) AS total_matches, pt.histogram,
       CASE WHEN pt.suggested IS NOT NULL AND coalesce(pt.confidence, 0) >= 3 THEN pt.suggested ELSE 'Uncategorised' END AS gated_category
FROM terms t LEFT JOIN pt ON pt.term = t.term
""")

sql("category_rollup", """
SELECT l_orderkey AS batch, l_returnflag AS category, round(sum(l_extendedprice), 2) AS amount, count(*) AS items
FROM lineitem GROUP BY ALL
""")

sql("category_rollup_items", """
SELECT l_orderkey AS batch, l_returnflag AS category, coalesce(p_name, '') AS description, l_extendedprice AS amount
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")


# ---------------------------------------------------------------------------
# Mutations
# ---------------------------------------------------------------------------

def _mutation_sql():
    from spendlake.plans.catalog import BULK_EDIT_WHERE, MUT_AS_OF

    stamp = f"TIMESTAMP '{MUT_AS_OF}'"

    def ts(c):
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

    def snap(p=""):
        return (f"CAST(to_json(struct_pack(id := {p}id, amount := {p}amount, category := {p}category, "
                f"description := {p}description, transaction_date := {p}transaction_date, "
                f"deleted_at := {ts(p + 'deleted_at')}, inserted_on := {ts(p + 'inserted_on')}, "
                f"updated_on := {ts(p + 'updated_on')})) AS VARCHAR)")

    base = f"WITH {LEDGER_CTES}"
    payload = f"""{base},
lines AS (
  SELECT l_orderkey,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_returnflag, l_shipdate) - 1 AS INTEGER) AS pos,
         CAST(l_extendedprice AS DOUBLE) AS amount,
         coalesce(CASE WHEN l_returnflag = 'R' THEN 'Returns' WHEN l_returnflag = 'A' THEN 'Adjustments' END,
                  'Uncategorised') AS category,
         'part ' || CAST(l_partkey AS VARCHAR) AS description,
         strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d') AS transaction_date
  FROM lineitem
),
appended AS (
  SELECT (SELECT max(id) FROM expenses) + row_number() OVER (ORDER BY l_orderkey, pos) AS id,
         amount, category, description, transaction_date
  FROM lines
)"""
    sql("append_expenses", f"{payload} SELECT id, amount, category, description, transaction_date FROM appended")
    def set_audit(action, rows, old):
        count = "CAST(to_json(struct_pack(count := n)) AS VARCHAR)"
        null = "CAST(NULL AS VARCHAR)"
        return f"""
SELECT '{action}' AS action, 'expenses' AS table_name, CAST(NULL AS BIGINT) AS row_id,
       {count if old else null} AS old_values, {null if old else count} AS new_values, 'cli' AS source
FROM (SELECT count(*) AS n FROM {rows}) WHERE n > 0
UNION ALL
SELECT '{action}_ROW', 'expenses', id, {null}, {null}, 'cli' FROM {rows}"""

    sql("bulk_insert_audit", payload + set_audit("BULK_INSERT", "appended", False))

    req = f"""{base},
req AS (
  SELECT DISTINCT o_orderkey AS rid FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderpriority = '2-HIGH'
),
sd AS (
  SELECT e.*, (r.rid IS NOT NULL AND e.deleted_at IS NULL) AS hit
  FROM expenses e LEFT JOIN req r ON r.rid = e.id
)"""
    sql("soft_delete", f"""{req}
SELECT id, {ts(f"CASE WHEN hit THEN {stamp} ELSE deleted_at END")} AS deleted_at,
       {ts(f"CASE WHEN hit THEN {stamp} ELSE updated_on END")} AS updated_on FROM sd""")
    sql("soft_delete_audit", f"""{req}
SELECT 'SOFT_DELETE' AS action, 'expenses' AS table_name, id AS row_id, {snap()} AS old_values,
       CAST(NULL AS VARCHAR) AS new_values, 'cli' AS source FROM sd WHERE hit""")
    sql("soft_delete_rejects", f"""{req}
SELECT rid AS id FROM req WHERE rid NOT IN (SELECT id FROM expenses WHERE deleted_at IS NULL)""")
    sql("purge_audit", f"{base}, gone AS (SELECT id FROM expenses WHERE deleted_at IS NOT NULL)"
        + set_audit("PURGE", "gone", True))

    rc = f"""{base},
ch AS (SELECT o_orderkey AS cid, 'DEFERRED' AS new_category FROM orders WHERE o_orderpriority = '5-LOW'),
rc AS (
  SELECT e.*, (c.cid IS NOT NULL AND e.deleted_at IS NULL) AS hit, c.new_category
  FROM expenses e LEFT JOIN ch c ON c.cid = e.id
)"""
    sql("recategorise", f"""{rc}
SELECT id, CASE WHEN hit THEN new_category ELSE category END AS category,
       {ts(f"CASE WHEN hit THEN {stamp} ELSE updated_on END")} AS updated_on FROM rc""")
    sql("recategorise_audit", f"""{rc},
t AS (SELECT *, new_category AS n_category, {stamp} AS n_updated_on FROM rc WHERE hit)
SELECT 'UPDATE' AS action, 'expenses' AS table_name, id AS row_id, {snap()} AS old_values,
       CAST(to_json(struct_pack(id := id, amount := amount, category := n_category, description := description,
               transaction_date := transaction_date, deleted_at := {ts('deleted_at')},
               inserted_on := {ts('inserted_on')}, updated_on := {ts('n_updated_on')})) AS VARCHAR) AS new_values,
       'cli' AS source FROM t""")

    where = BULK_EDIT_WHERE
    sql("bulk_edit", f"""{base}
SELECT id, CASE WHEN coalesce({where}, FALSE)
                THEN CAST(round(CAST(amount AS DECIMAL(18, 2)) * CAST(1.18 AS DECIMAL(4, 2)), 2) AS DOUBLE)
                ELSE amount END AS amount,
       category, transaction_date FROM expenses""")
    from spendlake.plans.catalog import BULK_EDIT_SET
    text = "UPDATE expenses SET amount = " + BULK_EDIT_SET["amount"] + " WHERE " + where
    sql("bulk_edit_audit", f"""{base}
SELECT 'QUERY_WRITE' AS action, 'raw_sql' AS table_name, CAST(NULL AS BIGINT) AS row_id,
       CAST(NULL AS VARCHAR) AS old_values,
       CAST(to_json(struct_pack(sql := {q_(text)}, rows_affected := count_if(coalesce({where}, FALSE)))) AS VARCHAR)
         AS new_values,
       'cli' AS source FROM expenses""")

    sql("budget_upsert", f"""{base},
spend AS (
  SELECT month_key, category, round(sum(amount) * 1.1, 0) AS budget_limit, 1 AS seq
  FROM expenses WHERE month_key LIKE '1998%' GROUP BY month_key, category
  UNION ALL SELECT 'default', CAST(NULL AS VARCHAR), CAST(31000000.0 AS DOUBLE), 1
  UNION ALL SELECT 'default', CAST(NULL AS VARCHAR), CAST(32000000.0 AS DOUBLE), 2
),
last AS (SELECT month_key AS m, category AS c, arg_max(budget_limit, seq) AS nv FROM spend GROUP BY 1, 2),
j AS (SELECT b.*, l.m, l.c, l.nv FROM budgets b FULL OUTER JOIN last l
      ON b.month_key = l.m AND b.category IS NOT DISTINCT FROM l.c),
hw AS (SELECT max(id) AS h FROM budgets)
SELECT id, month_key, category, CASE WHEN nv IS NOT NULL THEN nv ELSE budget_limit END AS budget_limit
FROM j WHERE id IS NOT NULL
UNION ALL
SELECT (SELECT h FROM hw) + row_number() OVER (ORDER BY m, c NULLS FIRST), m, c, nv FROM j WHERE id IS NULL""")

    sql("ledger_latest_state", f"""{base},
req AS (SELECT DISTINCT o_orderkey AS rid FROM orders WHERE o_orderpriority = '1-URGENT'),
ch AS (SELECT o_orderkey AS cid FROM orders WHERE o_orderpriority = '5-LOW'),
rc AS (SELECT e.id, CASE WHEN c.cid IS NOT NULL AND e.deleted_at IS NULL THEN 'DEFERRED' ELSE e.category END AS category,
              e.deleted_at FROM expenses e LEFT JOIN ch c ON c.cid = e.id)
SELECT id, category,
       {ts(f"CASE WHEN id IN (SELECT rid FROM req) AND deleted_at IS NULL THEN {stamp} ELSE deleted_at END")} AS deleted_at
FROM rc""")


def q_(s):
    return "'" + s.replace("'", "''") + "'"


_mutation_sql()


# ---------------------------------------------------------------------------
# Text helpers and read-only SQL
# ---------------------------------------------------------------------------

def _html_sql() -> str:
    """Text of ``html`` by steps of its own: one replacement per kind of markup, references piece by piece."""
    from html.entities import html5

    block = "p|div|br|tr|li|h[1-4]"
    x = "coalesce(html, '')"
    for pat, rep in (
        (r"(?s)<!--.*?(-->|\z)", ""),
        (r"(?is)<script(\s[^>]*)?>.*?(</script\s*>|\z)", ""),
        (r"(?is)<style(\s[^>]*)?>.*?(</style\s*>|\z)", ""),
        (rf"(?i)</({block})\b[^>]*>", " "),
        (rf"(?i)<({block})(\s[^>]*)?/>", " "),
        (r"""<[/A-Za-z]([^>=]|=\s*("[^"]*"|'[^']*')?)*>""", ""),
        (r"<[!?][^>]*>", ""),
    ):
        x = f"regexp_replace({x}, {q_(pat)}, {q_(rep)}, 'g')"
    names = ", ".join(f"{q_(k)}: {q_(v)}" for k, v in html5.items() if not any(c in v for c in "\n\t"))
    legacy = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
    token, old = "regexp_extract(p, '^[^ <&#;]{1,32};?')", f"regexp_extract(p, '^({legacy})')"
    return f"""
WITH names AS (SELECT MAP {{{names}}} AS m),
pieces AS (SELECT page_id, string_split({x}, '&') AS ps FROM pages),
decoded AS (SELECT page_id, ps[1] || coalesce(array_to_string([CASE
    WHEN regexp_matches(p, '^#[0-9]') THEN chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(p, '^#[0-9]+;?', '')
    WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]') THEN chr(CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS INTEGER))
         || regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', '')
    WHEN m[{token}] IS NOT NULL THEN m[{token}] || substr(p, length({token}) + 1)
    WHEN {old} <> '' THEN m[{old}] || substr(p, length({old}) + 1)
    ELSE '&' || p END FOR p IN ps[2:]], ''), '') AS t FROM pieces, names)
SELECT page_id, trim(regexp_replace(t, {q_(r'[\s\x{00A0}]+')}, ' ', 'g')) AS text FROM decoded"""


def _text_sql():
    from spendlake.plans.catalog import READ_ONLY_SQL

    sql("html_to_text", _html_sql())

    addr = ("CASE WHEN trim(regexp_extract(h, '<([^>]+)>', 1)) <> '' THEN trim(regexp_extract(h, '<([^>]+)>', 1)) "
            "WHEN regexp_extract(h, '[\\w.+-]+@[\\w.-]+', 0) <> '' THEN regexp_extract(h, '[\\w.+-]+@[\\w.-]+', 0) "
            "ELSE trim(h) END")
    sql("address_extraction", f"""
WITH hs AS (
  SELECT c_custkey AS key, c_name || ' <' || lower(replace(c_name, '#', '.')) || '@example.com>' AS h FROM customer
  UNION ALL SELECT -doc_id - 1, coalesce(text, '') FROM documents
), a AS (SELECT key, {addr} AS addr FROM hs)
SELECT key, sha256(addr) AS address_sha, CAST(length(addr) AS INTEGER) AS address_len,
       addr AS address FROM a""")

    sql("mail_date_parse", """
SELECT event_id, strftime(CAST(ts AS TIMESTAMP) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS received_at
FROM events""")

    sql("read_only_sql", f"WITH {LEDGER_CTES} " + READ_ONLY_SQL.replace("FROM expenses", "FROM expenses"))


_text_sql()


# ---------------------------------------------------------------------------
# Run helpers with plain SQL equivalents
# ---------------------------------------------------------------------------

def _run_sql():
    from spendlake.plans.catalog import RUN_AS_OF
    from spendlake.plans.oracle_views import EVENT_TXN_CTE, MESSAGES_CTE

    sql("checkpoint_prune", f"""WITH {EVENT_TXN_CTE.strip()}
SELECT email_uid, message_id, strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at FROM checkpoint_ev
WHERE processed_at >= TIMESTAMP '{RUN_AS_OF}' - INTERVAL 20 DAY""")
    both = MESSAGES_CTE + "," + EVENT_TXN_CTE.replace("ev AS (", "ev2 AS (", 1).replace("FROM ev\n", "FROM ev2\n")
    sql("incremental_messages", f"""WITH {both}
SELECT seq, email_uid, message_id FROM messages
WHERE nullif(message_id, '') IS NULL OR nullif(message_id, '') NOT IN (SELECT message_id FROM checkpoint_ev)""")
    sql("date_range_messages", f"""WITH {MESSAGES_CTE}
SELECT seq, email_uid, received_at FROM messages
WHERE CAST(substr(received_at, 1, 10) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")


_run_sql()

sql("streaming_daily_spend", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS category, round(sum(value), 2) AS spent,
       count(*) AS n
FROM events GROUP BY 1, 2""")

sql("streaming_message_dedup", """
SELECT DISTINCT '<evt-' || CAST(event_id AS VARCHAR) || '@mail.example>' AS message_id FROM events""")


def _rest_sql():
    from spendlake.plans.catalog import SUMMARY_AS_OF

    sql("monthly_stats", f"""WITH {LEDGER_CTES},
m AS (SELECT DISTINCT strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m') AS month_key FROM lineitem),
s AS (SELECT month_key, sum(amount) AS spent FROM active_expenses GROUP BY month_key),
j AS (SELECT m.month_key, coalesce(s.spent, 0.0) AS spent,
             coalesce(bm.budget_limit, bd.budget_limit, 0.0) AS lim
      FROM m LEFT JOIN s ON s.month_key = m.month_key
      LEFT JOIN budgets bm ON bm.month_key = m.month_key AND bm.category IS NULL
      LEFT JOIN budgets bd ON bd.month_key = 'default' AND bd.category IS NULL)
SELECT month_key, round(spent, 2) AS spent, lim AS "limit",
       CASE WHEN lim > 0 THEN round(spent / lim * 100, 2) ELSE 0.0 END AS percentage FROM j""")

    import datetime as _dt
    d = _dt.date.fromisoformat(SUMMARY_AS_OF)
    ws = d - _dt.timedelta(days=d.weekday())
    we = ws + _dt.timedelta(days=6)

    def header(period, month):
        per = {"daily": "daily", "weekly": "weekly"}.get(period, "monthly")
        return f"""WITH {LEDGER_CTES},
t AS (SELECT
  coalesce(sum(CASE WHEN month_key = '{month}' THEN amount END), 0.0) AS monthly,
  coalesce(sum(CASE WHEN txn_date = DATE '{SUMMARY_AS_OF}' THEN amount END), 0.0) AS daily,
  coalesce(sum(CASE WHEN txn_date BETWEEN DATE '{ws}' AND DATE '{we}' THEN amount END), 0.0) AS weekly
  FROM active_expenses),
b AS (SELECT coalesce((SELECT budget_limit FROM budgets WHERE month_key = '{month}' AND category IS NULL),
                      (SELECT budget_limit FROM budgets WHERE month_key = 'default' AND category IS NULL)) AS budget)
SELECT '{period}' AS period, round({per}, 2) AS period_spent, '{month}' AS month, round(monthly, 2) AS monthly_spent,
       budget, round(CASE WHEN budget IS NOT NULL AND budget <> 0 THEN budget - monthly END, 2) AS savings,
       CASE WHEN budget > 0 THEN round(monthly / budget * 100, 2) ELSE 0.0 END AS percentage
FROM t, b"""

    sql("period_summary_daily", header("daily", SUMMARY_AS_OF[:7]))
    sql("period_summary_weekly", header("weekly", "1998-02"))
    sql("period_summary_categories", f"""WITH {LEDGER_CTES},
c AS (SELECT category, sum(amount) AS spent FROM active_expenses WHERE month_key = '1998-06' GROUP BY category),
r AS (SELECT c.*, coalesce(bm.budget_limit, bd.budget_limit) AS budget FROM c
      LEFT JOIN budgets bm ON bm.month_key = '1998-06' AND bm.category = c.category
      LEFT JOIN budgets bd ON bd.month_key = 'default' AND bd.category = c.category)
SELECT category, round(spent, 2) AS spent, budget, round(budget - spent, 2) AS remaining, spent > budget AS overspent
FROM r""")

    sql("header_decode", """
SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS subject FROM conversations""")

    sql("streaming_interval_join", """
WITH s AS (SELECT event_id AS seq, CAST(round(value * 100) AS BIGINT) * 25 / 100.0 AS amount,
                  epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events)
SELECT n.seq AS n_seq, r.seq AS r_seq, round(abs(n.us - r.us) / 60000000.0, 4) AS gap_minutes
FROM s n JOIN s r ON r.seq < n.seq AND abs(n.amount - r.amount) <= 1.0 AND abs(n.us - r.us) <= CAST(7200000000 AS BIGINT)""")


_rest_sql()


# ---------------------------------------------------------------------------
# Ingestion run summary (process mode), composed from the generators above
# ---------------------------------------------------------------------------

def _run_summary_sql(reprocess: bool = False, dates: tuple | None = None) -> str:
    from spendlake.config import DEFAULT_ALLOWED_SENDERS, DedupSettings, Settings
    from spendlake.functions.parsing import REF_TYPES
    from spendlake.plans.catalog import RUN_AS_OF
    from spendlake.plans.oracle_views import EVENT_TXN_CTE, MESSAGES_CTE

    s, st = DedupSettings(), Settings()
    allowed = " OR ".join(f"contains(lower(coalesce(sender_email, '')), {q_(a.lower())})" for a in DEFAULT_ALLOWED_SENDERS)
    ev2 = EVENT_TXN_CTE.replace("ev AS (", "ev2 AS (", 1).replace("FROM ev\n", "FROM ev2\n")
    width = max(s.time_window_minutes, 120.0) * 60_000_000
    gap = "(abs(c.us - e.us) / 60000000.0)"
    t = (f"(CASE WHEN c.ts IS NULL OR e.ts IS NULL THEN -1.0 WHEN {gap} <= {s.time_window_minutes} THEN 1.5 "
         f"WHEN {gap} / 60.0 > 24 THEN -2.0 WHEN {gap} / 60.0 > 2 THEN -1.0 ELSE 0.0 END)")
    merch = "(c.m <> '' AND e.m <> '' AND (contains(c.m, e.m) OR contains(e.m, c.m)))"
    sc = (f"({t} + CASE WHEN abs(c.amount - e.amount) <= {s.amount_tolerance} THEN 2.0 ELSE 0.0 END"
          f" + CASE WHEN {merch} THEN 1.0 ELSE 0.0 END + CASE WHEN c.d = e.d THEN 0.5 ELSE 0.0 END)")
    status = (f"CASE WHEN {gap} / 60.0 > {s.max_date_gap_hours} THEN NULL WHEN {sc} >= 4.5 THEN 'auto_merged' "
              f"WHEN {sc} >= 3.5 THEN 'probable_duplicate' END")
    band = (f"c.ts IS NOT NULL AND e.ts IS NOT NULL AND abs(c.amount - e.amount) <= {s.amount_tolerance} "
            f"AND abs(c.us - e.us) <= CAST({int(width)} AS BIGINT)")
    refs_lower = " UNION ALL ".join(f"SELECT seq, lower({r}) AS v FROM cand WHERE coalesce({r}, '') <> ''" for r in REF_TYPES)
    nrefs = " + ".join(f"CASE WHEN coalesce({r}, '') <> '' THEN 1 ELSE 0 END" for r in REF_TYPES)
    as_of_date = RUN_AS_OF[:10]
    if reprocess:
        days = -(-int(s.max_date_gap_hours) // 24)
        since = f"(SELECT min(CAST(ts AS DATE)) FROM cand) - INTERVAL {days} DAY"
    else:
        since = f"DATE '{as_of_date}' - INTERVAL {s.ledger_lookback_days} DAY"
    return f"""WITH RECURSIVE {MESSAGES_CTE}, {ev2},
todo AS (
  SELECT * FROM messages
  WHERE ({allowed})
    {"" if reprocess else "AND (nullif(message_id, '') IS NULL OR nullif(message_id, '') NOT IN (SELECT message_id FROM checkpoint_ev))"}
    {f"AND CAST(substr(received_at, 1, 10) AS DATE) BETWEEN DATE '{dates[0]}' AND DATE '{dates[1]}'" if dates else ""}
),
{_extraction_sql('todo', with_messages=False)},
cand AS (
  SELECT seq, parse_method, (parse_method = 'regex') AS has_txn, amount,
         lower(trim(coalesce(merchant, ''))) AS m, coalesce(direction, 'debit') AS d,
         CAST(transaction_date AS TIMESTAMP) AS ts, epoch_us(CAST(transaction_date AS TIMESTAMP)) AS us,
         {", ".join(REF_TYPES)}, ({nrefs}) AS n_refs
  FROM parsed
),
known AS (
  SELECT DISTINCT lower(ref) AS ref FROM checkpoint_ev
  WHERE processed_at >= TIMESTAMP '{RUN_AS_OF}' - INTERVAL {st.reprocess_known_ref_days if reprocess else s.known_ref_days} DAY
    AND ref <> ''
),
hard AS (SELECT DISTINCT x.seq FROM ({refs_lower}) x JOIN known k ON k.ref = x.v
         WHERE x.seq IN (SELECT seq FROM cand WHERE has_txn)),
l AS (
  SELECT id, amount, lower(trim(coalesce(description, ''))) AS m, 'debit' AS d,
         CAST(strftime(txn_ts, '%Y-%m-%d') AS TIMESTAMP) AS ts,
         epoch_us(CAST(strftime(txn_ts, '%Y-%m-%d') AS TIMESTAMP)) AS us
  FROM ledger_ev WHERE CAST(txn_ts AS DATE) >= {since}
),
r1 AS (SELECT * FROM cand WHERE has_txn AND seq NOT IN (SELECT seq FROM hard)),
lp AS (SELECT c.seq AS c_key, e.id AS e_key, e.ts AS e_ts, {status} AS status FROM r1 c JOIN l e ON {band}),
fm AS (SELECT c_key AS seq, status AS ledger_status, e_key AS ledger_id FROM (
         SELECT *, row_number() OVER (PARTITION BY c_key ORDER BY e_ts DESC, e_key) AS rn
         FROM lp WHERE status IS NOT NULL) WHERE rn = 1),
r2 AS (SELECT * FROM r1 WHERE seq NOT IN (SELECT seq FROM fm)),
bnodes AS (SELECT seq FROM r2),
sp AS (SELECT c.seq AS c_key, e.seq AS e_key, {status} AS status FROM r2 c JOIN r2 e ON c.seq < e.seq AND {band}),
{_batch_sql('sp')},
rr AS (
  SELECT r.seq, r.role, n1.n_refs, n2.n_refs AS leader_refs, r.leader_seq
  FROM roles r JOIN cand n1 ON n1.seq = r.seq JOIN cand n2 ON n2.seq = r.leader_seq
),
swapped AS (SELECT DISTINCT leader_seq AS seq FROM rr WHERE role = 'follower' AND n_refs > leader_refs),
statuses AS (
  SELECT seq, 'new' AS st FROM cand WHERE NOT has_txn
  UNION ALL SELECT seq, 'definite_duplicate' FROM hard
  UNION ALL SELECT seq, ledger_status FROM fm
  UNION ALL SELECT seq, CASE WHEN role = 'leader' THEN CASE WHEN seq IN (SELECT seq FROM swapped) THEN 'auto_merged' ELSE 'new' END
                             WHEN n_refs > leader_refs THEN 'new' ELSE 'auto_merged' END FROM rr
),
summary AS (
  SELECT count(*) AS total_emails_processed,
         CAST(count_if(s.st = 'new' AND c.has_txn AND coalesce(c.amount, 0) <> 0) AS BIGINT) AS inserted,
         CAST(count_if(s.st IN ('definite_duplicate', 'auto_merged')) AS BIGINT) AS duplicates_skipped,
         CAST(count_if(s.st = 'probable_duplicate') AS BIGINT) AS probable_duplicates_flagged,
         CAST(count_if(c.parse_method = 'llm_needed') AS BIGINT) AS llm_parsing_needed
  FROM cand c JOIN statuses s ON s.seq = c.seq
)"""


RUN_SUMMARY = _run_summary_sql()
sql("run_summary", f"{RUN_SUMMARY} SELECT * FROM summary")
sql("review_headline", f"""{RUN_SUMMARY}
SELECT line, n FROM (
  SELECT 'processed' AS line, total_emails_processed AS n FROM summary
  UNION ALL SELECT 'new', inserted FROM summary
  UNION ALL SELECT 'duplicates', duplicates_skipped FROM summary
  UNION ALL SELECT 'flagged', probable_duplicates_flagged FROM summary
  UNION ALL SELECT 'manual', llm_parsing_needed FROM summary)
WHERE line = 'processed' OR n > 0""")

sql("reprocess_summary", f"{_run_summary_sql(reprocess=True)} SELECT * FROM summary")

sql("review_table", f"""{RUN_SUMMARY},
numbered AS (SELECT p.*, row_number() OVER (ORDER BY p.seq) AS number, s.st FROM parsed p JOIN statuses s ON s.seq = p.seq),
sec AS (
  SELECT *, CASE WHEN parse_method = 'llm_needed' THEN 'manual'
                 WHEN parse_method = 'regex' AND st = 'new' THEN 'new'
                 WHEN parse_method = 'regex' AND st = 'probable_duplicate' THEN 'needs_review'
                 WHEN parse_method = 'regex' AND st IN ('auto_merged', 'definite_duplicate') THEN 'duplicate' END AS section
  FROM numbered
)
SELECT number, section,
       CASE section WHEN 'new' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'duplicate' THEN 3 ELSE 4 END AS section_rank,
       amount, merchant, transaction_date,
       (SELECT ledger_id FROM fm WHERE fm.seq = sec.seq) AS matched_ledger_id,
       CASE WHEN section = 'manual' THEN coalesce(subject, '?') END AS subject
FROM sec WHERE section IS NOT NULL""")


def _java_double(x: str) -> str:
    """SQL text rendering a DOUBLE the way Java's Double.toString does, for values that
    are integral (as budget limits are) or below 1e7."""
    digits = f"rtrim(CAST(CAST({x} AS BIGINT) AS VARCHAR), '0')"
    exp = f"(length(CAST(CAST({x} AS BIGINT) AS VARCHAR)) - 1)"
    sci = (f"substr({digits}, 1, 1) || '.' || CASE WHEN length({digits}) > 1 THEN substr({digits}, 2) ELSE '0' END"
           f" || 'E' || CAST({exp} AS VARCHAR)")
    return f"(CASE WHEN abs({x}) >= 10000000 THEN {sci} ELSE CAST({x} AS VARCHAR) END)"


def _budget_audit_sql():
    from spendlake.plans.catalog import MUT_AS_OF

    def snap(id_, m, c, lim, ins, upd):
        return ("'{\"id\":' || CAST(" + id_ + " AS VARCHAR) || ',\"month_key\":' || to_json(" + m + ")"
                " || ',\"category\":' || coalesce(to_json(" + c + "), 'null')"
                " || ',\"budget_limit\":' || " + _java_double(lim) +
                " || ',\"inserted_on\":' || to_json(strftime(" + ins + ", '%Y-%m-%d %H:%M:%S'))"
                " || ',\"updated_on\":' || to_json(strftime(" + upd + ", '%Y-%m-%d %H:%M:%S')) || '}'")

    stamp = f"TIMESTAMP '{MUT_AS_OF}'"
    base = ORACLE["budget_upsert"]
    head, tail = base.split("SELECT id, month_key, category, CASE WHEN nv", 1)
    return f"""{head.rstrip().rstrip(',')}
SELECT 'UPSERT' AS action, 'budgets' AS table_name, id AS row_id,
       {snap('id', 'month_key', 'category', 'budget_limit', 'inserted_on', 'updated_on')} AS old_values,
       {snap('id', 'month_key', 'category', 'nv', 'inserted_on', stamp)} AS new_values, 'cli' AS source
FROM j WHERE id IS NOT NULL AND nv IS NOT NULL
UNION ALL
SELECT 'UPSERT', 'budgets', (SELECT h FROM hw) + row_number() OVER (ORDER BY m, c NULLS FIRST),
       NULL, {snap('(SELECT h FROM hw) + row_number() OVER (ORDER BY m, c NULLS FIRST)', 'm', 'c', 'nv', stamp, stamp)},
       'cli'
FROM j WHERE id IS NULL"""


sql("budget_upsert_audit", _budget_audit_sql())


def _run_outputs_sql():
    from spendlake.functions.parsing import REF_TYPES
    from spendlake.plans.catalog import RUN_AS_OF

    appended = f"""{RUN_SUMMARY},
ins AS (
  SELECT p.* FROM parsed p JOIN statuses s ON s.seq = p.seq
  WHERE s.st = 'new' AND p.parse_method = 'regex' AND coalesce(p.amount, 0) <> 0
),
terms AS (SELECT DISTINCT lower(merchant) AS term FROM ins WHERE merchant IS NOT NULL),
led_cat AS (SELECT id, description, upper(substr(description, 1, 1)) || lower(substr(description, 2)) AS category
            FROM ledger_ev),
sm AS (SELECT t.term, e.category, count(*) AS cnt FROM terms t JOIN led_cat e
       ON e.description IS NOT NULL AND contains(lower(e.description), t.term) GROUP BY t.term, e.category),
best AS (SELECT term, category, cnt FROM (
           SELECT *, row_number() OVER (PARTITION BY term ORDER BY cnt DESC, category) AS rn FROM sm) WHERE rn = 1),
appended AS (
  SELECT (SELECT max(id) FROM ledger_ev) + row_number() OVER (ORDER BY i.seq) AS id, i.seq, i.email_uid, i.amount,
         CASE WHEN b.category IS NOT NULL AND b.cnt >= 3 THEN b.category ELSE 'Uncategorised' END AS category,
         CASE WHEN coalesce(i.merchant, '') <> '' AND coalesce(i.description, '') <> ''
              THEN trim(i.merchant || ' - ' || i.description)
              WHEN coalesce(i.merchant, '') <> '' THEN i.merchant ELSE coalesce(i.description, '') END AS description,
         coalesce(i.transaction_date, '{RUN_AS_OF[:10]}') AS transaction_date
  FROM ins i LEFT JOIN best b ON b.term = lower(i.merchant)
)"""
    sql("run_appended", f"{appended} SELECT id, email_uid, amount, category, description, transaction_date FROM appended")
    refs_json = ("'{' || concat_ws(',', " + ", ".join(
        f"CASE WHEN coalesce({r}, '') <> '' THEN '\"{r}\":' || to_json({r}) END" for r in REF_TYPES) + ") || '}'")
    sql("run_checkpoint", f"""{appended}
SELECT p.email_uid, p.message_id, s.st AS result,
       coalesce((SELECT string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id) FROM appended a WHERE a.email_uid = p.email_uid), '')
         AS ledger_ids,
       {refs_json} AS reference_ids
FROM parsed p JOIN statuses s ON s.seq = p.seq""")


_run_outputs_sql()


def _corrections_sql():
    from spendlake.plans.catalog import RUN_AS_OF

    base = ORACLE["run_appended"].rsplit("SELECT id, email_uid, amount, category, description, transaction_date FROM appended", 1)[0]
    stamp = f"'{RUN_AS_OF}'"
    return f"""{base},
numbered AS (SELECT p.seq, p.parse_method, row_number() OVER (ORDER BY p.seq) AS number FROM parsed p),
ids AS (SELECT n.number, n.seq, c.n_refs, a.id, a.description FROM numbered n JOIN cand c ON c.seq = n.seq
        JOIN appended a ON a.seq = n.seq),
corr AS (SELECT number, number % 5 AS kind FROM numbered WHERE parse_method = 'regex'),
c AS (SELECT corr.kind, ids.* FROM corr JOIN ids ON ids.number = corr.number),
drops AS (
  SELECT id FROM c WHERE kind = 0
  UNION
  SELECT CASE WHEN c.n_refs > o.n_refs OR (c.n_refs = o.n_refs AND length(c.description) >= length(o.description))
              THEN o.id ELSE c.id END
  FROM c JOIN ids o ON o.number = c.number + 1 WHERE c.kind = 3
),
led AS (SELECT id, amount, upper(substr(description, 1, 1)) || lower(substr(description, 2)) AS category
        FROM ledger_ev UNION ALL SELECT id, amount, category FROM appended),
newstate AS (
  SELECT l.id,
         CASE WHEN l.id IN (SELECT id FROM c WHERE kind = 1) AND l.id NOT IN (SELECT id FROM drops) THEN 99.5 ELSE l.amount END AS amount,
         CASE WHEN l.id IN (SELECT id FROM c WHERE kind = 2) AND l.id NOT IN (SELECT id FROM drops) THEN 'Reviewed' ELSE l.category END AS category,
         CASE WHEN l.id IN (SELECT id FROM drops) THEN {stamp} END AS deleted_at,
         l.amount AS b_amount, l.category AS b_category
  FROM led l
)
SELECT id, amount, category, deleted_at FROM newstate
WHERE amount IS DISTINCT FROM b_amount OR category IS DISTINCT FROM b_category OR deleted_at IS NOT NULL"""


sql("review_corrections", _corrections_sql())

sql("streaming_weekly_spend", """
SELECT strftime(CAST(date_trunc('week', CAST(ts AS TIMESTAMP)) AS DATE), '%Y-%m-%d') AS week_start,
       event_type AS category, round(sum(value), 2) AS spent, count(*) AS n
FROM events GROUP BY 1, 2""")

sql("streaming_monthly_spend", """
SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month_key, o_custkey AS custkey,
       round(sum(o_totalprice), 2) AS spent, count(*) AS n
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2""")


# ---------------------------------------------------------------------------
# Streams that arrive in several pieces
# ---------------------------------------------------------------------------

def _arriving_sql():
    base = ORACLE["run_appended"].rsplit("SELECT id, email_uid, amount, category, description, transaction_date FROM appended", 1)[0]
    sql("streaming_ingest", f"""{base}
SELECT id, amount, category, description, transaction_date, 'BULK_INSERT_ROW' AS action FROM appended""")
    sql("streaming_reference_dedup", f"""{DEDUP_CTES}
SELECT seq, lower(ref) AS ref,
       coalesce(ts - lag(ts) OVER (PARTITION BY lower(ref) ORDER BY ts, seq) <= INTERVAL 7 DAY, false) AS seen_before
FROM a WHERE coalesce(ref, '') <> ''""")
    sql("streaming_first_match", f"""{DEDUP_CTES}
SELECT b.seq, ledger_id, CAST(score AS DOUBLE) AS score, ledger_status FROM b LEFT JOIN first_match f ON f.seq = b.seq""")
    for name, unit in (("streaming_closed_weeks", "week"), ("streaming_closed_months", "month")):
        sql(name, f"""
SELECT strftime(date_trunc('{unit}', CAST(o_orderdate AS TIMESTAMP)), '%Y-%m-%d') AS start, o_orderpriority AS category,
       round(sum(o_totalprice), 2) AS spent, count(*) AS n
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2""")


_arriving_sql()


# ---------------------------------------------------------------------------
# Tables written and read back
# ---------------------------------------------------------------------------

def _written_sql():
    from spendlake.plans.catalog import REPROCESS_DAYS
    from spendlake.plans.oracle_views import EVENT_TXN_CTE

    base = f"WITH {LEDGER_CTES}"
    sql("csv_export", f"""{base}
SELECT 'expenses' AS kind, CAST(id AS VARCHAR) AS key, category, amount AS value FROM expenses
UNION ALL SELECT 'budgets', coalesce(month_key, ''), category, CAST(budget_limit AS DOUBLE) FROM budgets""")
    sql("checkpoint_scan", f"""WITH {EVENT_TXN_CTE.strip()}
SELECT email_uid, message_id, strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at, seq AS ledger_id FROM checkpoint_ev""")
    sql("run_output", f"""{RUN_SUMMARY},
n AS (SELECT st AS dedup_status, count(*) AS n FROM statuses GROUP BY st),
t AS (SELECT 'total' AS dedup_status, total_emails_processed AS n FROM summary)
SELECT r AS run_id, x.dedup_status, CAST(x.n AS BIGINT) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM t) x, (VALUES ('a'), ('b')) v(r)""")
    sql("reprocess_range_summary", f"{_run_summary_sql(True, REPROCESS_DAYS)} SELECT * FROM summary")
    changed = f"""{base},
req AS (SELECT DISTINCT o_orderkey AS rid FROM orders WHERE o_orderpriority = '1-URGENT'),
ch AS (SELECT DISTINCT o_orderkey AS cid FROM orders WHERE o_orderpriority = '5-LOW'),
c AS (SELECT id, amount, category, deleted_at IS NOT NULL AS was_deleted, deleted_at IS NULL AND id IN (SELECT rid FROM req) AS drops,
             deleted_at IS NULL AND id IN (SELECT cid FROM ch) AS moves FROM expenses)"""
    sql("published_changes", f"""{changed}
SELECT id, CASE WHEN moves AND amount >= 100000 THEN amount + 1 ELSE amount END AS amount,
       CASE WHEN moves THEN 'DEFERRED' ELSE category END AS category, was_deleted OR drops AS deleted,
       CAST(1 + CAST(drops AS INT) + CAST(moves AS INT) AS BIGINT) AS changes FROM c""")
    sql("audit_histories", f"""{changed}
SELECT id AS row_id, 'INSERT' || CASE WHEN drops THEN ',SOFT_DELETE' ELSE '' END || CASE WHEN moves THEN ',UPDATE' ELSE '' END AS actions
FROM c""")


_written_sql()
