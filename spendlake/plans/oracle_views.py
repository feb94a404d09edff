"""SQL text of the derived views, for the DuckDB cross-check (``oracle_sql``).

Generated from the same fixed values as ``spendlake.sources.tables`` so both sides
always describe the same data.
"""

from __future__ import annotations

from spendlake.config import DEFAULT_CATEGORY
from spendlake.sources.tables import (
    DEFAULT_BUDGET_ROWS,
    BATCH_START,
    LEDGER_END,
    FAMILY_SENDERS,
    MONTH_BUDGET_RULES,
)


def q(s: str | None) -> str:
    if s is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(v for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


EXPENSES_CTE = f"""
ex_desc AS (
  SELECT l_orderkey, min(p_name) AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
expenses AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         CAST(o_totalprice AS DOUBLE) AS amount,
         coalesce(c_mktsegment, {q(DEFAULT_CATEGORY)}) AS category,
         ex_desc.description AS description,
         strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS transaction_date,
         CAST(o_orderdate AS DATE) AS txn_date,
         strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month_key,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS deleted_at,
         CAST(o_orderdate AS TIMESTAMP) AS inserted_on,
         CAST(o_orderdate AS TIMESTAMP) AS updated_on
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN ex_desc ON o_orderkey = ex_desc.l_orderkey
),
active_expenses AS (SELECT * FROM expenses WHERE deleted_at IS NULL)"""


def _budget_rows_sql() -> str:
    dflt = _values(
        [(q(m), q(c), f"CAST({lim!r} AS DOUBLE)") for m, c, lim in DEFAULT_BUDGET_ROWS],
        ["month_key", "category", "budget_limit"],
    )
    rules = _values(
        [(q(mm), q(c), f"CAST({lim!r} AS DOUBLE)") for mm, c, lim in MONTH_BUDGET_RULES],
        ["mm", "category", "budget_limit"],
    )
    return f"""
budget_rows AS (
  SELECT month_key, category, budget_limit FROM {dflt}
  UNION ALL
  SELECT m.month_key, r.category, r.budget_limit
  FROM (SELECT DISTINCT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month_key FROM orders) m
  JOIN {rules.replace(' AS t(', ' AS r(')} ON substr(m.month_key, 6, 2) = r.mm
),
budgets AS (
  SELECT CAST(row_number() OVER (ORDER BY month_key, category NULLS FIRST) AS BIGINT) AS id,
         month_key, category, budget_limit,
         TIMESTAMP '1995-01-01 00:00:00' AS inserted_on, TIMESTAMP '1995-01-01 00:00:00' AS updated_on
  FROM budget_rows
)"""


BUDGETS_CTE = _budget_rows_sql()

LEDGER_CTES = EXPENSES_CTE + "," + BUDGETS_CTE


def amount_text_sql(cents: str) -> str:
    rupees = f"CAST(floor({cents} / 100) AS BIGINT)"
    return (
        f"(CASE WHEN {rupees} >= 1000 THEN CAST({rupees} // 1000 AS VARCHAR) || ',' || "
        f"lpad(CAST({rupees} % 1000 AS VARCHAR), 3, '0') ELSE CAST({rupees} AS VARCHAR) END"
        f" || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"
    )


EVENT_FIELDS_CTE = """
ev AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS BIGINT) AS user_id,
         event_type, value,
         CAST(event_id % 14 AS INTEGER) AS family,
         CAST(round(value * 100) AS BIGINT) * 25 AS cents,
         'U' || CAST(user_id AS VARCHAR) || 'K' || coalesce(json_extract_string(props, '$.k'), '0') AS ref,
         upper(event_type) AS merch,
         lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS acct,
         strftime(CAST(ts AS TIMESTAMP), '%d-%m-%Y') AS d1,
         strftime(CAST(ts AS TIMESTAMP), '%d/%m/%y') AS d2
  FROM events
)"""


def _family_case(kind: str) -> str:
    a = "amt"
    bodies = {
        1: ("SBI Debit Alert", f"'Dear Customer, Rs.' || {a} || ' debited from your account XX' || acct || ' towards ' || merch || ' on Dt.' || d2 || '. Avl Bal Rs.30,000.'"),
        2: ("ICICI Bank Alert", f"'INR ' || {a} || ' was debited from Acct XX' || acct || ' to ' || merch || ' on ' || d1 || '. Ref No. ' || ref || '. Call us for disputes.'"),
        3: ("Axis Bank Debit", f"'INR ' || {a} || ' was debited from A/c no. XX' || acct || ' at ' || merch || ' on ' || d2 || '. UTR: ' || ref || chr(10) || 'Regards, Axis Bank'"),
        4: ("Equitas Debit Alert", f"'Rs ' || {a} || ' has been debited from your account to ' || merch || ' dated ' || d1 || '. Ref: ' || ref || '.'"),
        5: ("Your Swiggy order is confirmed!", f"'Hi! Your order has been placed. Order total: ₹' || {a} || '. Order ID: SWG-' || ref || '. Delivery in 30 mins.'"),
        6: ("Order Confirmed - Zomato", f"'Your order is confirmed! Total amount: Rs.' || {a} || '. Order #ZMT' || ref || '. Enjoy your meal!'"),
        7: ("Your Amazon.in order", f"'Thank you for shopping with us. Grand Total: Rs.' || {a} || chr(10) || 'Order ID: 408-' || ref || chr(10) || 'Arriving soon.'"),
        8: ("Flipkart order placed", f"'Amount: ₹' || {a} || '. Order no. FK' || ref || ' will ship soon.'"),
        9: ("Your trip with Uber", f"'Total ₹' || {a} || chr(10) || 'Trip ID: UB-' || ref || chr(10) || 'Thanks for riding.'"),
        10: ("Ola ride receipt", f"'Fare: Rs ' || {a} || '. Booking ID: CRN' || ref || '. Ride again soon.'"),
        11: ("PhonePe payment", f"'₹' || {a} || ' paid to ' || merch || ' via UPI. Transaction ID: T' || ref || '.'"),
        12: ("Paytm payment", f"'Rs.' || {a} || ' sent to ' || merch || ' on ' || d1 || '. Order ID: PTM' || ref || '.'"),
        13: ("Card alert", f"'INR ' || {a} || ' was charged at ' || merch || ' on ' || d1 || ' using card XX' || acct || '. Ref No: ' || ref || '.'"),
    }
    debit0 = (f"'Dear Customer, Rs.' || {a} || ' has been debited from your account **XXXX' || acct || ' to ' || merch"
              f" || ' on ' || d1 || '. Avl Bal: Rs.45,000.00. Ref No: ' || ref || '.'")
    upi0 = (f"'Dear Customer, Rs.' || {a} || ' has been debited from your A/c XXXX' || acct || ' by VPA ' || lower(merch)"
            f" || '@upi on ' || d1 || '. Ref No: ' || ref || '.'")
    parts = []
    for fam in range(len(FAMILY_SENDERS)):
        if kind == "subject":
            v = ("(CASE WHEN user_id % 2 = 0 THEN 'Transaction Alert' ELSE 'UPI Transaction Alert' END)"
                 if fam == 0 else q(bodies[fam][0]))
        elif kind == "body":
            v = f"(CASE WHEN user_id % 2 = 0 THEN {debit0} ELSE {upi0} END)" if fam == 0 else bodies[fam][1]
        elif kind == "name":
            v = q(FAMILY_SENDERS[fam][0])
        else:
            v = q(FAMILY_SENDERS[fam][1])
        parts.append(f"WHEN {fam} THEN {v}")
    return "CASE family " + " ".join(parts) + " END"


MESSAGES_CTE = EVENT_FIELDS_CTE + f""",
ev_txt AS (SELECT *, {amount_text_sql('cents')} AS amt FROM ev),
messages AS (
  SELECT event_id AS seq,
         'e' || CAST(event_id AS VARCHAR) AS email_uid,
         '<evt-' || CAST(event_id AS VARCHAR) || '@mail.example>' AS message_id,
         ({_family_case('name')}) || ' <' || ({_family_case('addr')}) || '>' AS "from",
         {_family_case('addr')} AS sender_email,
         {_family_case('subject')} AS subject,
         {_family_case('body')} AS body,
         strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS received_at
  FROM ev_txt
  UNION ALL
  SELECT CAST(1000000000 + doc_id AS BIGINT), 'd' || CAST(doc_id AS VARCHAR),
         '<doc-' || CAST(doc_id AS VARCHAR) || '@digest.example>',
         'Weekly Digest <newsletter@digest.example.org>', 'newsletter@digest.example.org',
         'Digest ' || source, text, '2024-01-31T09:00:00+00:00'
  FROM documents
  UNION ALL
  SELECT CAST(2000000000 + conv_id * 1000 + turn AS BIGINT),
         'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR),
         '<conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '@chat.example>',
         'Chat Export <chat@assistant.example.net>', 'chat@assistant.example.net',
         'Conversation ' || CAST(conv_id AS VARCHAR) || ' ' || role, text, '2024-01-31T10:00:00+00:00'
  FROM conversations
)"""


EVENT_TXN_CTE = EVENT_FIELDS_CTE + f""",
txn AS (
  SELECT event_id AS seq, CAST(cents AS DOUBLE) / 100.0 AS amount, event_type AS merchant, 'debit' AS direction, ts,
         ref, user_id
  FROM ev
),
ledger_ev AS (
  SELECT seq AS id, amount, merchant AS description, ts AS txn_ts FROM txn
  WHERE ts < TIMESTAMP '{LEDGER_END}'
),
batch_ev AS (
  SELECT seq, amount, merchant, direction, ts AS txn_ts, ref FROM txn
  WHERE ts >= TIMESTAMP '{BATCH_START}'
),
checkpoint_ev AS (
  SELECT 'e' || CAST(seq AS VARCHAR) AS email_uid, '<evt-' || CAST(seq AS VARCHAR) || '@mail.example>' AS message_id,
         ts AS processed_at, ref, seq
  FROM txn WHERE ts < TIMESTAMP '{LEDGER_END}'
)"""
