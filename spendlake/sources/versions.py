"""Versioned tables: fresh folders, and one commit file that makes them current (MUT-1, SNK-2, ST-1).

A writer puts rows into folders that nobody reads yet and then commits a version: a small JSON file that lists,
per table and part, the folders that hold its rows.  Readers take the folders of the newest version with a
declared schema, so tables change together or not at all: a failure before the commit, an empty
folder or a leftover of a lost task is never seen.  Commit files are made under another name and renamed without
overwriting, so of two writers that started from the same version one gets ``CommitConflict``.

Row counts of a write are observed while it runs (``DataFrame.observe``), not counted again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendlake.operators.mutations import EXPENSE_COLS, bulk_edit_audit, bulk_edit_rows

EXPENSES = ("id bigint, amount double, category string, description string, transaction_date string, "
            "deleted_at timestamp_ntz, inserted_on timestamp_ntz, updated_on timestamp_ntz")
AUDIT = ("id bigint, action string, table_name string, row_id bigint, old_values string, new_values string, "
         "source string, created_on timestamp_ntz")


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Version:
    number: int = -1
    tables: dict = field(default_factory=dict)  # table -> part -> folders
    info: dict = field(default_factory=dict)

    def replaced(self, table: str, parts: dict) -> dict:
        """The tables with ``parts`` of one table set; a part without folders is dropped."""
        now = {**self.tables.get(table, {}), **parts}
        return {**self.tables, table: {k: v for k, v in now.items() if v}}

    def appended(self, table: str, folder: str) -> dict:
        return self.replaced(table, {"": [*self.tables.get(table, {}).get("", []), folder]})


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one with this number."""
        known = self.numbers()
        if not known:
            return Version()
        stream = self._fs.open(self._path(f"{self.root}/versions/{known[-1] if number is None else number:020d}.json"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, table: str, schema: str, parts: list | None = None, at: Version | None = None) -> DataFrame:
        """Rows of a table (of some of its parts); a table without folders is empty."""
        held = (at or self.version()).tables.get(table, {})
        folders = [f for part, fs in sorted(held.items()) if parts is None or part in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame, keep: Column | None = None, drop: tuple = (), by: str | None = None,
              **counts: Column) -> tuple[str, dict]:
        """Write rows into a folder of their own (in parts by a column); returns it and what was seen in passing:
        ``rows`` and how many meet each of the ``counts``.  Only rows that meet ``keep`` are written, without the
        columns in ``drop``; all are counted."""
        folder, seen = f"{self.root}/{table}/{uuid.uuid4().hex}", Observation()
        if by:  # rows of a part together: as many files as parts or full tasks, not one of each task for each part
            df = df.hint("rebalance", by)
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])
        writer = (df if keep is None else df.where(keep)).drop(*drop).write
        (writer.partitionBy(by) if by else writer).parquet(folder)
        return folder, seen.get

    def holds(self, folder: str) -> bool:
        return self._fs.exists(self._path(folder))

    def commit(self, base: Version, tables: dict, info: dict | None = None) -> Version:
        """Make ``tables`` the version after ``base``."""
        new = Version(base.number + 1, tables, {**base.info, **(info or {})})
        target = self._path(f"{self.root}/versions/{new.number:020d}.json")
        made = self._path(f"{self.root}/versions/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(made, False)
        out.write(json.dumps({"number": new.number, "tables": new.tables, "info": new.info}).encode())
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(made), self._fs.makeQualified(target), plain)
        except Exception as failed:
            self._fs.delete(made, False)
            if self._fs.exists(target):
                raise CommitConflict(f"version {new.number} was committed by another writer") from failed
            raise
        return new

    def vacuum(self, keep: int = 10) -> int:
        """Delete folders that none of the last ``keep`` versions lists (while nobody writes); returns how many."""
        numbers = self.numbers()
        listed = {f.rstrip("/") for n in numbers[-keep:] for parts in self.version(n).tables.values() for fs in parts.values() for f in fs}
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)):
            if table.getPath().getName() == "versions":
                continue
            for folder in self._fs.listStatus(table.getPath()):
                name = f"{self.root}/{table.getPath().getName()}/{folder.getPath().getName()}"
                if not any(f == name or f.startswith(f"{name}/") for f in listed):
                    gone += bool(self._fs.delete(folder.getPath(), True))
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n:020d}.json"), False)
        return gone


# ---------------------------------------------------------------------------
# Audited changes of a month-partitioned ledger
# ---------------------------------------------------------------------------

def month_of(df: DataFrame) -> Column:
    return F.coalesce(F.substring("transaction_date", 1, 7), F.lit("none"))


def read_expenses(store: VersionedTables, months: list | None = None, at: Version | None = None) -> DataFrame:
    return store.read("expenses", EXPENSES, months, at)


def publish_change(store: VersionedTables, new_state: DataFrame, audit_rows: DataFrame, changed_ids: DataFrame,
                   base: Version | None = None, info: dict | None = None) -> Version:
    """Publish a mutation of the expenses of ``base`` (default: the newest version): the months that hold
    changed rows now or held them before are written anew, the audit rows get ids
    above all ids so far, and one commit makes both current."""
    base = base or store.version()
    touched, parts = _rewritten(store, base, new_state, changed_ids)
    tables = base.replaced("expenses", parts)
    audit = audited(store, base, audit_rows)
    tables = Version(base.number, tables).appended("audit", audit[0])
    return store.commit(base, tables, {"months": touched, "audit_high": audit[1], **(info or {})})


def _rewritten(store: VersionedTables, base: Version, state: DataFrame, changed_ids: DataFrame) -> tuple[list, dict]:
    ids = changed_ids.select("id").distinct()
    month = lambda df: df.join(ids, "id", "left_semi").select(month_of(df).alias("month"))
    touched = sorted(r.month for r in month(state).unionByName(month(read_expenses(store, at=base))).distinct().collect())
    if not touched:
        return [], {}
    rows = state.select(*EXPENSE_COLS).withColumn("month", month_of(state)).where(F.col("month").isin(touched))
    folder, _ = store.write("expenses", rows, by="month")
    parts = {m: f"{folder}/month={m}" for m in touched}  # as many as months
    return touched, {m: [f] if store.holds(f) else [] for m, f in parts.items()}


def audited(store: VersionedTables, base: Version, rows: DataFrame) -> tuple[str, int]:
    """Write audit rows with ids above all of ``base``; returns their folder and the highest id."""
    from spendlake.session import assign_dense_ids, written

    high = int(base.info.get("audit_high", 0))
    order = ["created_on", "action", "table_name", "row_id", "old_values", "new_values"]
    rows = rows.withColumn("created_on", F.col("created_on").cast("timestamp_ntz"))
    rows = written(rows, "audit-rows")  # derived once, for the sampling of the order and the sort
    names = [x.split()[0] for x in AUDIT.split(", ")]
    folder, seen = store.write("audit", assign_dense_ids(rows, order, high).select(*names))
    return folder, high + seen["rows"]


def publish_bulk_edit(store: VersionedTables, where: str, assignments: dict | None, as_of_ts: str,
                      delete: bool = False) -> Version:
    """MUT-6 published: the edit is written once, and the number of rows it affects is observed in that
    write; the audit row is made from it."""
    base = store.version()
    state = read_expenses(store, at=base)
    rows, text = bulk_edit_rows(state, where, assignments, as_of_ts, delete)
    folder, seen = store.write("expenses", rows.withColumn("month", month_of(rows)), keep=~F.col("_hit") if delete else None,
                               drop=("_hit",), by="month", rows_affected=F.col("_hit"))
    months = [s.getPath().getName()[6:] for s in store._fs.listStatus(store._path(folder)) if s.isDirectory()]
    parts = {m: [] for m in base.tables.get("expenses", {})} | {m: [f"{folder}/month={m}"] for m in months}
    counted = store.spark.range(1).select(F.lit(seen["rows_affected"]).alias("rows_affected"))
    audit = audited(store, base, bulk_edit_audit(counted, text, as_of_ts))
    tables = Version(base.number, base.replaced("expenses", parts)).appended("audit", audit[0])
    return store.commit(base, tables, {"audit_high": audit[1], "rows_affected": seen["rows_affected"]})
