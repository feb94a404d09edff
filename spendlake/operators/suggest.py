"""Category suggestion (JN-9, AGG-6, SC-16) and same-category roll-up (AGG-10).

JN-9 is a contains-join of many terms against all active descriptions
(``lower(description) LIKE '%term%'``), built as an inverted index.  The descriptions become a
dictionary of (lower(description), category, number of rows) entries with ids; the grams (k = 3)
of an entry are posted as (gram, entry id), only if some term holds the gram.  Each term is
keyed by its *rarest* gram, its postings give the entries to look at, and the exact ``contains`` is checked on those.
The text of an entry is read there alone: it never travels with a gram.  Terms shorter than k are their own single gram, so
the same equi-join is exact for them; the empty term matches every description.
AGG-6 adds up the entries' row numbers, so rows are counted before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.config import AUTO_CATEGORY_MIN_CONFIDENCE, DEFAULT_CATEGORY
from spendlake.operators.filters import active
from spendlake.session import cut_lineage

GRAM = 3


def _grams(s: Column, k: int) -> Column:
    n = F.length(s) - k + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, k)))).otherwise(
        F.array().cast("array<string>")
    )


def gram_stats(expenses: DataFrame, gram: int = GRAM) -> DataFrame:
    """Frequency of every description gram over active rows (partial aggregation).

    Suggestion calls recompute the frequencies they need; a caller with a slowly
    changing ledger can write this table once and pass it as ``stats``."""
    act = active(expenses).select(F.lower("description").alias("ldesc")).where(F.col("ldesc").isNotNull())
    return act.select(F.explode(_grams(F.col("ldesc"), gram)).alias("g")).groupBy("g").agg(
        F.count(F.lit(1)).alias("cnt"))


def dictionary(expenses: DataFrame) -> DataFrame:
    """entry, ldesc, category and n (active rows) per distinct lower-cased description and category."""
    counted = active(expenses).select(F.lower("description").alias("ldesc"), "category").where("ldesc is not null").groupBy(
        "ldesc", "category").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.select(F.monotonically_increasing_id().alias("entry"), "ldesc", "category", "n"))


def entry_matches(entries: DataFrame, terms: DataFrame, term_col: str = "term", gram: int = GRAM,
                  like_wildcards: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """JN-9 on a dictionary: (term, entry) for every entry whose description contains lower(term).

    ``like_wildcards=True`` reproduces the surveyed LIKE behaviour for terms holding
    '%' or '_' (they act as wildcards there): such terms are keyed by the rarest gram of
    their longest literal segment and checked with ``LIKE '%term%'``."""
    wild = F.col("term").rlike("[%_]") if like_wildcards else F.lit(False)
    literals = F.when(wild, F.split("term", "[%_]")).otherwise(F.array("term"))
    longest = F.array_max(F.transform(literals, lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]
    t = cut_lineage(terms.select(F.lower(F.col(term_col)).alias("term")).where("term is not null").distinct().select(
        "term", wild.alias("wild"), longest.alias("literal")))
    size = F.length("literal")
    kinds = t.agg(F.collect_set(F.when(size < gram, F.struct(size.alias("size"), "wild"))).alias("k")).first().k  # 2 * gram at most
    texts = entries.select("entry", "ldesc")
    # the rarest gram of each literal of a gram or more, among the grams that stand in any of them
    tg = t.where(size >= gram).select("term", "wild", F.explode(_grams(F.col("literal"), gram)).alias("g"))
    wanted = tg.select("g").distinct()
    postings = texts.select("entry", F.explode(_grams(F.col("ldesc"), gram)).alias("g")).join(wanted, "g", "left_semi")
    freq = stats.select("g", "cnt") if stats is not None else postings.groupBy("g").agg(F.count(F.lit(1)).alias("cnt"))
    key = tg.join(freq, "g").groupBy("term", "wild").agg(F.min_by("g", F.struct("cnt", "g")).alias("g"), F.count(F.lit(1)).alias("found"))
    # a term with a gram that stands nowhere matches nothing
    key = key.join(tg.groupBy("term").agg(F.count(F.lit(1)).alias("all")), "term").where(F.col("found") == F.col("all"))
    pairs = postings.join(key.select("term", "wild", "g"), "g").select("term", "wild", "entry")
    for k, is_wild in sorted((r.size, r.wild) for r in kinds):
        some = t.where((size == k) & (F.col("wild") == F.lit(is_wild)))
        if k:
            grams = texts.select("entry", F.explode(_grams(F.col("ldesc"), k)).alias("literal"))
            pairs = pairs.unionByName(grams.join(some, "literal").select("term", "wild", "entry"))
        else:  # the empty term, and terms of wildcards only, ask for a least number of characters: every length meets them by equality
            some = some.select("term", "wild", F.length(F.regexp_replace("term", "%", "")).alias("least"))
            least = texts.select("entry", F.explode(F.sequence(F.lit(0), F.length("ldesc"))).alias("least"))
            pairs = pairs.unionByName(least.join(some, "least").select("term", "wild", "entry"))
    holds = F.when(F.col("wild"), F.expr("ldesc LIKE concat('%', term, '%')")).otherwise(F.col("ldesc").contains(F.col("term")))
    return pairs.join(texts, "entry").where(holds).select("term", "entry")


def term_matches(expenses: DataFrame, terms: DataFrame, term_col: str = "term", gram: int = GRAM,
                 like_wildcards: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """JN-9: (term, id, category) for every active row whose lower(description) contains
    lower(term).  ``term`` in the output is the lower-cased term; see ``entry_matches``."""
    entries = dictionary(expenses)
    hits = entry_matches(entries, terms, term_col, gram, like_wildcards, stats).join(entries.drop("n"), "entry")
    rows = active(expenses).select("id", F.col("category").alias("_category"), F.lower("description").alias("_ldesc"))
    same = (F.col("_ldesc") == F.col("ldesc")) & F.col("_category").eqNullSafe(F.col("category"))
    return hits.join(rows, same).select("term", "id", "category")


def suggest_categories(expenses: DataFrame, terms: DataFrame, term_col: str = "term",
                       default_category: str = DEFAULT_CATEGORY,
                       min_confidence: int = AUTO_CATEGORY_MIN_CONFIDENCE,
                       like_wildcards: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """AGG-6 + SRT-3 + SC-16 for every distinct lower-cased term.

    suggested = most frequent category (ties by category), confidence = its count,
    total_matches = all matches, histogram = 'category:count' sorted by category;
    no match -> NULL / 0 / 0.  ``gated_category`` applies the confidence gate."""
    t = terms.select(F.lower(F.col(term_col)).alias("term")).where(F.col("term").isNotNull()).distinct()
    entries = dictionary(expenses)
    counts = entry_matches(entries, terms, term_col, like_wildcards=like_wildcards, stats=stats).join(
        entries.select("entry", "category", "n"), "entry").groupBy("term", "category").agg(F.sum("n").alias("cnt"))
    best = F.min(F.struct((-F.col("cnt")).alias("order"), "category"))  # the most frequent, then the first category (NULL first)
    per_term = counts.groupBy("term").agg(
        best["category"].alias("suggested"),
        F.max("cnt").alias("confidence"),
        F.sum("cnt").alias("total_matches"),
        F.array_join(F.sort_array(F.collect_list(F.concat(F.coalesce("category", F.lit("")), F.lit(":"),
                                                          F.col("cnt").cast("string")))), ",").alias("histogram"),
    )
    out = t.join(per_term, "term", "left")
    conf = F.coalesce(F.col("confidence"), F.lit(0)).cast("bigint")
    return out.select(
        "term",
        "suggested",
        conf.alias("confidence"),
        F.coalesce(F.col("total_matches"), F.lit(0)).cast("bigint").alias("total_matches"),
        "histogram",
        gate_category(F.col("suggested"), conf, default_category, min_confidence).alias("gated_category"),
    )


def gate_category(suggested: Column, confidence: Column, default_category: str = DEFAULT_CATEGORY,
                  min_confidence: int = AUTO_CATEGORY_MIN_CONFIDENCE) -> Column:
    """SC-16: the suggestion when its confidence reaches the threshold, else the default."""
    return F.when(suggested.isNotNull() & (confidence >= min_confidence), suggested).otherwise(F.lit(default_category))


def rollup_by_category(items: DataFrame, batch_col: str = "batch") -> DataFrame:
    """AGG-10: one entry per (batch, category) with the total amount and the number of items,
    whatever the group's size; ``rollup_items`` has the items behind the entries."""
    return items.groupBy(batch_col, "category").agg(
        F.round(F.sum("amount"), 2).alias("amount"), F.count(F.lit(1)).alias("items"))


def rollup_items(items: DataFrame, batch_col: str = "batch") -> DataFrame:
    """AGG-10: one row per item of a roll-up entry (key: batch and category; no list is built)."""
    return items.select(batch_col, "category", F.coalesce("description", F.lit("")).alias("description"), "amount")
