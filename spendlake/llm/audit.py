"""Interaction audit of document filters (operator 11).

Every filter is a letter with a failure condition on the row; one more letter stands for "this text
is that of a smaller doc_id", found by an existential self-join: documents are left-semi joined
with the first document of each text on hash, exact text and smaller doc_id.  The ids that fail any
filter are united, the bits of one id are put together, and documents are counted per part and
combination of failures.  All orders of the filters are read from those counts (at most 2^letters
per part): a filter removes the combinations that hold its letter and no letter applied before it.

Scale.  Texts are shuffled twice: once pre-aggregated to one row per text, once as the left side of the
semi join.  A text with many copies is dealt over several tasks: the copies of the hot texts (of
which at most ``hot_parts`` can exist, so their list is small) get a salt, and their single right-hand row is
repeated once per salt.  Everything else moves narrow rows that are pre-aggregated.

Defined cases: a null text is empty, a null part is the empty string.  A null doc_id has no labels,
is smaller than no id and has no smaller one.  Rows repeated with one id are counted each, and are
no duplicates of one another.  An id labelled twice counts as good (toxic) if any label says so.  An empty
table gives no rows.  Conditions may use any column; columns that none uses are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, words_of


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: short, repetitive, loud, with symbols."""
    words = words_of(text)
    letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * F.size(words),
        "C": F.lit(100).cast("bigint") * letters > F.lit(10).cast("bigint") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def later_copies(docs: DataFrame, hot_parts: int = 4096) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) whose text is also that of a smaller doc_id, with
    ``hash``; copies of one text are dealt over tasks of about 1 / ``hot_parts`` of all copies."""
    rows = docs.withColumn("hash", _hash(F.col("text")))
    first = materialise(
        rows.where("doc_id is not null").groupBy("hash", "text").agg(
            F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("copies"))
        .where("first_id < last_id").drop("last_id"), "first-documents")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    share = max(1000, total // hot_parts)
    salts = F.ceil(F.col("copies") / F.lit(share)).cast("bigint")
    hot = first.where(F.col("copies") > share).groupBy("hash").agg(F.max(salts).alias("salts"))  # hot_parts rows at most
    left = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "hash", "left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod("row", "salts")).otherwise(F.lit(0))).alias("l")
    # equal hashes share one number of salts, also those of different texts
    right = first.join(F.broadcast(hot), "hash", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1))).alias("r")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.text") == F.col("r.text"))
    return left.join(right, same & (F.col("r.first_id") < F.col("l.doc_id")), "left_semi").drop("row", "salt", "salts")


def failure_counts(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: Column,
                   duplicate: str = "E") -> DataFrame:
    """part, failures (bit i for the i-th letter in order) and the counts n, good and toxic."""
    letters = sorted([*conditions, duplicate])
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    base = docs.withColumns({"text": F.coalesce("text", F.lit(""))})
    own = sum((F.when(c, F.lit(bit[x])).otherwise(F.lit(0)) for x, c in sorted(conditions.items())), F.lit(0))
    ids = ["doc_id", "part", "hash"]
    # one entry per row with the failures that the row shows by itself, and one per copy
    failing = base.select(F.col("doc_id"), part.alias("part"), _hash(F.col("text")).alias("hash"),
                          own.alias("failures"), F.lit(1).alias("row"))
    copies = later_copies(base.select("doc_id", part.alias("part"), "text")).select(
        *ids, F.lit(bit[duplicate]).alias("failures"), F.lit(0).alias("row"))
    combined = materialise(
        failing.unionByName(copies).groupBy(*ids).agg(F.bit_or("failures").alias("failures"), F.sum("row").alias("n")),
        "failures")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = combined.where("doc_id is not null").join(marks, "doc_id", "left")
    unknown = combined.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(unknown).groupBy("part", "failures").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def order_report(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step, from the counts per combination of failures."""
    bit = {letter: 1 << i for i, letter in enumerate(sorted(letters))}
    orders = ["".join(p) for p in permutations(sorted(letters))]
    plan = json.dumps([
        {"filter_order": order, "step": step + 1, "own": bit[letter], "before": sum(bit[x] for x in order[:step])}
        for order in orders for step, letter in enumerate(order)])
    steps = F.from_json(F.lit(plan), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = counts.withColumn("at", F.explode(steps)).select("*", "at.*")
    fails = F.col("failures").bitwiseAND(F.col("own")) != 0
    gone = F.col("failures").bitwiseAND(F.col("before")) != 0
    count = lambda of, when: F.sum(F.when(when, of).otherwise(F.lit(0))).cast("bigint")
    # a document that fails k filters is removed by each of them in 1 / k of the orders
    turns = F.expr(f"n * ({len(orders)} div bit_count(failures))")
    return rows.groupBy("part", "filter_order", "step").agg(
        count(F.col("n"), ~fails & ~gone).alias("kept"),
        count(F.col("n"), fails & ~gone).alias("removed"),
        count(F.col("n"), fails & gone).alias("redundant"),
        count(F.col("n"), F.col("failures") == F.col("own")).alias("unique_fails"),
        count(F.col("good"), fails & ~gone).alias("good_lost"),
        count(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
        count(turns, fails).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report for the five filters A to E, by language."""
    conditions = text_conditions(F.col("text"))
    counts = failure_counts(docs, labels, conditions, F.coalesce("lang", F.lit("")))
    return order_report(counts, "".join(conditions) + "E")
