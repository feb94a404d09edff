"""Driver tables and the ledger/message views derived from them.

Every view is a lazy DataFrame over the parquet tables, so predicates and column
pruning reach the scans.  The same derivations are written as SQL in
``spendlake.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.config import DEFAULT_CATEGORY

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Ledger: expenses and budgets
# ---------------------------------------------------------------------------

def order_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``min(p_name)`` over each order's lines: partial aggregate per task, one shuffle by order."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.min("p_name").alias("description"))
    )


def expenses_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger view: one expense per order (id = o_orderkey, category = market segment).

    Orders in status 'F' are soft-deleted 30 days after their date.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    desc = order_descriptions(spark, sf_dir)
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        desc, orders.o_orderkey == desc.l_orderkey, "left"
    )
    odate = F.col("o_orderdate").cast("timestamp_ntz")
    return joined.select(
        F.col("o_orderkey").cast("bigint").alias("id"),
        F.col("o_totalprice").cast("double").alias("amount"),
        F.coalesce(F.col("c_mktsegment"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.col("description"),
        F.date_format(odate, "yyyy-MM-dd").alias("transaction_date"),
        F.to_date(odate).alias("txn_date"),
        F.date_format(odate, "yyyy-MM").alias("month_key"),
        F.when(F.col("o_orderstatus") == "F", odate + F.expr("INTERVAL 30 DAYS")).alias("deleted_at"),
        odate.alias("inserted_on"),
        odate.alias("updated_on"),
    )


# Budget rows of the test ledger (limits in currency units).
DEFAULT_BUDGET_ROWS = (
    ("default", None, 30000000.0),
    ("default", "AUTOMOBILE", 5000000.0),
    ("default", "BUILDING", 6000000.0),
    ("default", "FURNITURE", 5500000.0),
    ("default", "HOUSEHOLD", 4000000.0),
)
# Month overrides, applied to every month of the data whose month number matches.
MONTH_BUDGET_RULES = (
    ("12", None, 40000000.0),
    ("12", "HOUSEHOLD", 8000000.0),
    ("06", "AUTOMOBILE", 2000000.0),
)


def budgets_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets view: fixed defaults plus month overrides for the months present in orders.

    Size is bounded by (#months + 1) x (#rules), so the dense id window is cheap.
    """
    months = (
        read_table(spark, sf_dir, "orders")
        .select(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("month_key"))
        .distinct()
    )
    rules = spark.createDataFrame(list(MONTH_BUDGET_RULES), "mm string, category string, budget_limit double")
    overrides = months.join(F.broadcast(rules), F.substring("month_key", 6, 2) == F.col("mm")).select(
        "month_key", "category", "budget_limit"
    )
    defaults = spark.createDataFrame(list(DEFAULT_BUDGET_ROWS), "month_key string, category string, budget_limit double")
    rows = defaults.unionByName(overrides)
    from pyspark.sql import Window

    w = Window.orderBy("month_key", F.col("category").asc_nulls_first())
    stamp = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    from spendlake.session import cut_lineage

    # Written once (a reliable checkpoint of a few hundred rows): the size check, the
    # default lookup and the joins then read it instead of re-deriving the months.
    return cut_lineage(rows.select(
        F.row_number().over(w).cast("bigint").alias("id"),
        "month_key",
        "category",
        "budget_limit",
        stamp.alias("inserted_on"),
        stamp.alias("updated_on"),
    ))


# ---------------------------------------------------------------------------
# Messages rendered from events (plus non-transaction mail from documents/conversations)
# ---------------------------------------------------------------------------

# Sender address per family index (family = event_id mod 14).
FAMILY_SENDERS = (
    ("HDFC Bank", "alerts@hdfcbank.net"),
    ("SBI", "donotreply@sbi.co.in"),
    ("ICICI Bank", "transaction@icicibank.com"),
    ("Axis Bank", "alerts@axisbank.com"),
    ("Equitas", "noreply@equitasbank.com"),
    ("Swiggy", "noreply@swiggy.in"),
    ("Zomato", "noreply@zomato.com"),
    ("Amazon", "auto-confirm@amazon.in"),
    ("Flipkart", "noreply@flipkart.com"),
    ("Uber", "noreply@uber.com"),
    ("Ola", "noreply@olacabs.com"),
    ("PhonePe", "noreply@phonepe.com"),
    ("Paytm", "no-reply@paytm.com"),
    ("Scapia Card", "scapiacards@federalbank.co.in"),
)
DOCUMENT_SENDER = ("Weekly Digest", "newsletter@digest.example.org")
CONVERSATION_SENDER = ("Chat Export", "chat@assistant.example.net")


def amount_text(cents: Column) -> Column:
    """Integer cents -> '12,345.60' (thousands grouped once; values stay below a million)."""
    rupees = F.floor(cents / 100).cast("bigint")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.when(
        rupees >= 1000,
        F.concat((rupees / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((rupees % 1000).cast("string"), 3, "0")),
    ).otherwise(rupees.cast("string"))
    return F.concat(grouped, F.lit("."), frac)


def _event_fields(ev: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k")
    return ev.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        ts.alias("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("event_type"),
        F.col("value"),
        (F.col("event_id") % 14).cast("int").alias("family"),
        (F.round(F.col("value") * 100).cast("bigint") * 25).alias("cents"),
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("K"), F.coalesce(k, F.lit("0"))).alias("ref"),
        F.upper(F.col("event_type")).alias("merch"),
        F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0").alias("acct"),
        F.date_format(ts, "dd-MM-yyyy").alias("d1"),
        F.date_format(ts, "dd/MM/yy").alias("d2"),
    )


def _render(fam: int, a: Column) -> tuple[Column, Column]:
    """(subject, body) for a family; ``a`` is the amount text."""
    c = F.col
    L = F.lit
    if fam == 0:
        debit = F.concat(
            L("Dear Customer, Rs."), a, L(" has been debited from your account **XXXX"), c("acct"),
            L(" to "), c("merch"), L(" on "), c("d1"), L(". Avl Bal: Rs.45,000.00. Ref No: "), c("ref"), L("."),
        )
        upi = F.concat(
            L("Dear Customer, Rs."), a, L(" has been debited from your A/c XXXX"), c("acct"),
            L(" by VPA "), F.lower(c("merch")), L("@upi on "), c("d1"), L(". Ref No: "), c("ref"), L("."),
        )
        return (
            F.when(c("user_id") % 2 == 0, L("Transaction Alert")).otherwise(L("UPI Transaction Alert")),
            F.when(c("user_id") % 2 == 0, debit).otherwise(upi),
        )
    bodies = {
        1: ("SBI Debit Alert", [L("Dear Customer, Rs."), a, L(" debited from your account XX"), c("acct"),
                                L(" towards "), c("merch"), L(" on Dt."), c("d2"), L(". Avl Bal Rs.30,000.")]),
        2: ("ICICI Bank Alert", [L("INR "), a, L(" was debited from Acct XX"), c("acct"), L(" to "), c("merch"),
                                 L(" on "), c("d1"), L(". Ref No. "), c("ref"), L(". Call us for disputes.")]),
        3: ("Axis Bank Debit", [L("INR "), a, L(" was debited from A/c no. XX"), c("acct"), L(" at "), c("merch"),
                                L(" on "), c("d2"), L(". UTR: "), c("ref"), L("\nRegards, Axis Bank")]),
        4: ("Equitas Debit Alert", [L("Rs "), a, L(" has been debited from your account to "), c("merch"),
                                    L(" dated "), c("d1"), L(". Ref: "), c("ref"), L(".")]),
        5: ("Your Swiggy order is confirmed!", [L("Hi! Your order has been placed. Order total: ₹"), a,
                                                L(". Order ID: SWG-"), c("ref"), L(". Delivery in 30 mins.")]),
        6: ("Order Confirmed - Zomato", [L("Your order is confirmed! Total amount: Rs."), a, L(". Order #ZMT"),
                                         c("ref"), L(". Enjoy your meal!")]),
        7: ("Your Amazon.in order", [L("Thank you for shopping with us. Grand Total: Rs."), a,
                                     L("\nOrder ID: 408-"), c("ref"), L("\nArriving soon.")]),
        8: ("Flipkart order placed", [L("Amount: ₹"), a, L(". Order no. FK"), c("ref"), L(" will ship soon.")]),
        9: ("Your trip with Uber", [L("Total ₹"), a, L("\nTrip ID: UB-"), c("ref"), L("\nThanks for riding.")]),
        10: ("Ola ride receipt", [L("Fare: Rs "), a, L(". Booking ID: CRN"), c("ref"), L(". Ride again soon.")]),
        11: ("PhonePe payment", [L("₹"), a, L(" paid to "), c("merch"), L(" via UPI. Transaction ID: T"),
                                 c("ref"), L(".")]),
        12: ("Paytm payment", [L("Rs."), a, L(" sent to "), c("merch"), L(" on "), c("d1"), L(". Order ID: PTM"),
                               c("ref"), L(".")]),
        13: ("Card alert", [L("INR "), a, L(" was charged at "), c("merch"), L(" on "), c("d1"),
                            L(" using card XX"), c("acct"), L(". Ref No: "), c("ref"), L(".")]),
    }
    subj, parts = bodies[fam]
    return L(subj), F.concat(*parts)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out, so that all tasks get a part of a table of few row groups; by a random key (seeded), past
    which a filter on the result is not pushed into the input.  The number is given, as adaptive execution would else
    put narrow rows into few tasks again, whatever is computed from them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.rand(17))


def event_messages(spark: SparkSession, sf_dir: str, deal=lambda df: df) -> DataFrame:
    """One transaction message per event, in the sender family ``event_id mod 14``."""
    ev = _event_fields(deal(read_table(spark, sf_dir, "events")))
    ev = ev.withColumn("amt", amount_text(F.col("cents")))
    a = F.col("amt")
    subject = body = name = addr = None
    for fam in range(len(FAMILY_SENDERS)):
        s, b = _render(fam, a)
        cond = F.col("family") == fam
        subject = F.when(cond, s) if subject is None else subject.when(cond, s)
        body = F.when(cond, b) if body is None else body.when(cond, b)
        n, ad = FAMILY_SENDERS[fam]
        name = F.when(cond, F.lit(n)) if name is None else name.when(cond, F.lit(n))
        addr = F.when(cond, F.lit(ad)) if addr is None else addr.when(cond, F.lit(ad))
    received = F.concat(
        F.date_format(F.col("ts") + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")
    )
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("email_uid"),
        F.concat(F.lit("<evt-"), F.col("event_id").cast("string"), F.lit("@mail.example>")).alias("message_id"),
        F.concat(name, F.lit(" <"), addr, F.lit(">")).alias("from"),
        addr.alias("sender_email"),
        subject.alias("subject"),
        body.alias("body"),
        received.alias("received_at"),
    )


def document_messages(spark: SparkSession, sf_dir: str, deal=lambda df: df) -> DataFrame:
    """Whole documents as newsletter mail (non-transaction rows for the parser)."""
    name, addr = DOCUMENT_SENDER
    d = deal(read_table(spark, sf_dir, "documents"))
    return d.select(
        (F.lit(1_000_000_000) + F.col("doc_id")).cast("bigint").alias("seq"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("email_uid"),
        F.concat(F.lit("<doc-"), F.col("doc_id").cast("string"), F.lit("@digest.example>")).alias("message_id"),
        F.lit(f"{name} <{addr}>").alias("from"),
        F.lit(addr).alias("sender_email"),
        F.concat(F.lit("Digest "), F.col("source")).alias("subject"),
        F.col("text").alias("body"),
        F.lit("2024-01-31T09:00:00+00:00").alias("received_at"),
    )


def conversation_messages(spark: SparkSession, sf_dir: str, deal=lambda df: df) -> DataFrame:
    name, addr = CONVERSATION_SENDER
    c = deal(read_table(spark, sf_dir, "conversations"))
    return c.select(
        (F.lit(2_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("seq"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("email_uid"),
        F.concat(F.lit("<conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                 F.lit("@chat.example>")).alias("message_id"),
        F.lit(f"{name} <{addr}>").alias("from"),
        F.lit(addr).alias("sender_email"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit(" "), F.col("role")).alias("subject"),
        F.col("text").alias("body"),
        F.lit("2024-01-31T10:00:00+00:00").alias("received_at"),
    )


def all_messages(spark: SparkSession, sf_dir: str, deal=lambda df: df) -> DataFrame:
    """All messages; ``deal=dealt`` moves the table rows, before they grow into messages."""
    return (
        event_messages(spark, sf_dir, deal)
        .unionByName(document_messages(spark, sf_dir, deal))
        .unionByName(conversation_messages(spark, sf_dir, deal))
    )


# ---------------------------------------------------------------------------
# Dedup inputs from events: ledger part, batch part, processed checkpoint
# ---------------------------------------------------------------------------

# The events timeline split.  The ledger holds events before LEDGER_END,
# the batch holds events from BATCH_START on; the overlap day is re-delivered mail.
LEDGER_END = "2024-01-17 00:00:00"
BATCH_START = "2024-01-16 00:00:00"
EVENTS_AS_OF = "2024-01-31"


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat transaction rows: seq, amount, merchant, direction, ts, ref values."""
    ev = _event_fields(read_table(spark, sf_dir, "events"))
    return ev.select(
        F.col("event_id").alias("seq"),
        (F.col("cents") / 100.0).alias("amount"),
        F.col("event_type").alias("merchant"),
        F.lit("debit").alias("direction"),
        F.col("ts"),
        F.create_map(F.lit("ref_no"), F.col("ref")).alias("reference_ids"),
        F.col("user_id"),
    )


def ledger_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before the split, as ledger rows (description carries the merchant)."""
    t = event_transactions(spark, sf_dir)
    return t.where(F.col("ts") < F.lit(LEDGER_END).cast("timestamp_ntz")).select(
        F.col("seq").alias("id"),
        "amount",
        F.initcap("merchant").alias("category"),
        F.col("merchant").alias("description"),
        F.col("ts").alias("txn_ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("transaction_date"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        F.col("ts").alias("inserted_on"),
        F.col("ts").alias("updated_on"),
    )


def batch_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the split on, as a batch of parsed candidates."""
    t = event_transactions(spark, sf_dir)
    return t.where(F.col("ts") >= F.lit(BATCH_START).cast("timestamp_ntz")).select(
        "seq", F.lit(True).alias("has_txn"), "amount", "merchant", "direction", F.col("ts").alias("txn_ts"),
        "reference_ids",
    )


def checkpoint_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed-message checkpoint rows for the ledger part (reference ids lower-cased)."""
    t = event_transactions(spark, sf_dir)
    return t.where(F.col("ts") < F.lit(LEDGER_END).cast("timestamp_ntz")).select(
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("email_uid"),
        F.concat(F.lit("<evt-"), F.col("seq").cast("string"), F.lit("@mail.example>")).alias("message_id"),
        F.lit(None).cast("string").alias("from"),
        F.lit("").alias("subject"),
        F.col("ts").alias("processed_at"),
        F.lit("new").alias("result"),
        F.array(F.col("seq")).alias("ledger_ids"),
        F.col("reference_ids"),
        F.col("seq"),
    )
