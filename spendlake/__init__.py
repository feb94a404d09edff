"""spendlake — a Spark-native spending ledger and transaction-message analytics library.

The library turns archives of transaction messages into a clean ledger and answers
budget questions over it, using only DataFrames, Spark SQL and Structured Streaming.

Sub-packages
------------
sources    table scans and sinks (ledger, payloads, messages, checkpoints)
functions  Column-expression helpers (amounts, dates, references, merchants, text)
operators  set operators (filters, budgets, reports, suggestions, mutations, extraction, dedup)
plans      composed jobs (summary report, ingestion run, review tables)
streaming  Structured Streaming versions of the incremental jobs
"""

from spendlake.config import DedupSettings, Settings  # noqa: F401

__version__ = "0.1.0"
