"""Tunables that are part of the semantics (defaults follow the surveyed behaviour)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the surveyed defaults.
DEFAULT_CATEGORY = "Uncategorised"
SOURCE_DEFAULT = "cli"
AUTO_CATEGORY_MIN_CONFIDENCE = 3
MONTHLY_ALERT_PCT = 80.0

# Score weights and thresholds of the soft match.
SCORE_AMOUNT = 2.0
SCORE_MERCHANT = 1.0
SCORE_DIRECTION = 0.5
SCORE_TIME = 1.5
PENALTY_GAP_2H = -1.0
PENALTY_GAP_24H = -2.0
THRESHOLD_AUTO = 4.5
THRESHOLD_PROBABLE = 3.5

# Dedup statuses.
STATUS_NEW = "new"
STATUS_AUTO = "auto_merged"
STATUS_PROBABLE = "probable_duplicate"
STATUS_DEFINITE = "definite_duplicate"

# The default sender allow-list (substring match, case-insensitive).
DEFAULT_ALLOWED_SENDERS = (
    "alerts@hdfcbank.net",
    "transaction@icicibank.com",
    "transaction.alert@icicibank.com",
    "alerts@axisbank.com",
    "alerts@axis.bank.in",
    "donotreply@sbi.co.in",
    "noreply@equitasbank.com",
    "esfb-alerts@equitas.bank.in",
    "noreply@swiggy.in",
    "no-reply@swiggy.in",
    "scapiacards@federalbank.co.in",
    "onlinesbicard@sbicard.com",
    "noreply@zomato.com",
    "auto-confirm@amazon.in",
    "noreply@flipkart.com",
    "noreply@uber.com",
    "no-reply@amazonpay.in",
    "noreply@olacabs.com",
    "no-reply@paytm.com",
    "noreply@phonepe.com",
    "alerts@hdfcbank.bank.in",
    "credit_cards@icicibank.com",
    "credit_cards@icici.bank.in",
)


@dataclass(frozen=True)
class DedupSettings:
    time_window_minutes: float = 30.0
    amount_tolerance: float = 1.0
    max_date_gap_hours: float = 48.0
    ledger_lookback_days: int = 7
    known_ref_days: int = 7
    # 'merge' keeps the surveyed behaviour (a probable pair inside a batch is merged);
    # 'flag' marks the later row probable_duplicate instead.
    batch_probable: str = "merge"
    # Only the richest, earliest row of a batch group stays new (documented intent).
    single_survivor: bool = False
    # Two candidates of the same batch sharing a reference id: second is definite.
    hard_within_batch: bool = False


@dataclass(frozen=True)
class Settings:
    allowed_senders: tuple = DEFAULT_ALLOWED_SENDERS
    dedup: DedupSettings = field(default_factory=DedupSettings)
    prune_after_days: int = 60
    reprocess_known_ref_days: int = 90
    default_category: str = DEFAULT_CATEGORY
    auto_category_min_confidence: int = AUTO_CATEGORY_MIN_CONFIDENCE
    # When True, merchant cleanup only cuts at a word boundary ("Global Mart" stays whole).
    merchant_word_boundary: bool = False
