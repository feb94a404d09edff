"""Quality rules with thresholds taken from the corpus (operator 9).

Fixed base rules reject texts that are too short or mostly repetition.  Every other cutoff is
adaptive: a mergeable quantile sketch (``percentile_approx``, merged map-side, so one hot
source costs one sketch per task) gives the quartiles of each measure per language and
source, and a document is rejected when it lies beyond its group's outer fence
``Q3 + fence * max(Q3 - Q1, least spread)``.  A group of few documents, or one whose quartiles lie far apart because
much of it is junk, is judged by the quartiles of its language or of the corpus.  Built-in functions only.

Defined cases: a null or empty text has no words and fails the base rules; null languages
and sources form groups of their own; repeated rows are judged alike; an empty table gives an
empty result; other columns of the input are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """``least_spread``: smallest quartile distance assumed for a measure, so that a group
    whose documents are nearly all alike does not reject harmless differences; ``min_group`` and
    ``wide``: fewer documents, or quartiles further apart than so many times those of the parent, and a group is judged
    by its parent's quartiles."""

    min_words: int = 50
    max_repeat_percent: int = 50
    fence: float = 3.0
    accuracy: int = 1000
    min_group: int = 100
    wide: float = 4.0
    least_spread: tuple = (("symbols", 0.05), ("dup_lines", 0.1), ("repeats", 0.1), ("word_length", 0.75))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__q``: struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Repeated 3-word windows are found by a 64-bit hash within one text: a text without one stops
    at the distinct count, others sort (hash, position) and compare neighbours."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = list(docs.columns)
    step = docs.select("*", words_of(F.col(text)).alias("__w"))
    triples = F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    none = F.array().cast("array<bigint>")
    step = step.select("*", F.when(F.size("__w") >= 3, triples).otherwise(none).alias("__h"))
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    no_pairs = F.array().cast("array<struct<h:bigint,p:int>>")
    step = step.select("*", F.when(repeated, pairs).otherwise(no_pairs).alias("__s"))
    twice = F.filter(
        "__s",
        lambda x, i: (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = step.select("*", lines.alias("__l"))
    measures = F.struct(
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.size("__l").cast("bigint").alias("n_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )
    return step.select(*[F.col(f"`{c}`") for c in kept], measures.alias("__q"))


def _ratios(q: str) -> dict[str, Column]:
    words = F.nullif(F.col(f"{q}.n_words"), F.lit(0))
    return {
        "symbols": F.col(f"{q}.n_symbols") / words,
        "dup_lines": F.col(f"{q}.n_dup_lines") / F.nullif(F.col(f"{q}.n_lines"), F.lit(0)),
        "repeats": F.col(f"{q}.n_repeat_words") / words,
        "word_length": F.col(f"{q}.word_chars") / words,
    }


def base_failed(q: str, rules: QualityRules) -> Column:
    n = F.col(f"{q}.n_words")
    return (n < rules.min_words) | (F.col(f"{q}.n_repeat_words") * 100 > n * rules.max_repeat_percent)


def thresholds(measured: DataFrame, rules: QualityRules, lang: str = "lang", source: str = "source") -> DataFrame:
    """Fences per language and source: __lang, __source and one struct (low, high) per measure.

    Only texts that pass the base rules describe what is usual in a group.  Sketches are made per language and source, per
    language and for the corpus; a group that is small, or whose quartiles lie much further apart than those of
    its parent, takes its parent's quartiles."""
    ratios = _ratios("__q")
    usual = measured.where(~base_failed("__q", rules)).select(
        F.col(lang).alias("__lang"), F.col(source).alias("__source"), *[c.alias(f"__{k}") for k, c in ratios.items()])
    sketches = [F.percentile_approx(f"__{k}", F.array(F.lit(0.25), F.lit(0.75)), F.lit(rules.accuracy)).alias(f"__{k}") for k in ratios]
    levels = materialise(usual.rollup("__lang", "__source").agg(
        F.grouping_id().cast("int").alias("__level"), F.count(F.lit(1)).alias("__n"), *sketches), "sketches")
    top = levels.where("__level = 3").first()  # one row; none if there are no usual texts
    if top is None:
        top = {f"__{k}": None for k in ratios}
    corpus = {k: F.lit(top[f"__{k}"]).cast("array<double>") for k in ratios}
    languages = levels.where("__level = 1").select(F.col("__lang").alias("__language"), *[
        _trusted(F.col(f"__{k}"), corpus[k], least, rules).alias(f"parent_{k}") for k, least in rules.least_spread])
    groups = levels.where("__level = 0").join(languages, F.col("__lang").eqNullSafe(F.col("__language")))
    out = []
    for k, least in rules.least_spread:
        quartiles = _trusted(F.col(f"__{k}"), F.col(f"parent_{k}"), least, rules)
        spread = F.greatest(quartiles[1] - quartiles[0], F.lit(float(least))) * rules.fence
        out.append(F.struct((quartiles[0] - spread).alias("low"), (quartiles[1] + spread).alias("high")).alias(f"__{k}"))
    return groups.select("__lang", "__source", *out)


def _trusted(mine: Column, theirs: Column, least: float, rules: QualityRules) -> Column:
    """Quartiles of a group, or of its parent if the group is small or wide."""
    usual = F.greatest(theirs[1] - theirs[0], F.lit(float(least)))
    return F.when((F.col("__n") >= rules.min_group) & (mine[1] - mine[0] <= rules.wide * usual), mine).otherwise(theirs)


def judge(measured: DataFrame, fences: DataFrame, rules: QualityRules, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the fences and add __base_failed, __kept."""
    ratios = _ratios("__q")
    m, t = measured.alias("m"), fences.alias("t")
    on = F.col(f"m.{lang}").eqNullSafe(F.col("t.__lang")) & F.col(f"m.{source}").eqNullSafe(F.col("t.__source"))
    joined = m.join(t, on, "left")
    inside = F.lit(True)
    for k, c in ratios.items():
        within = c <= F.col(f"t.__{k}.high")
        if k == "word_length":
            within = within & (c >= F.col(f"t.__{k}.low"))
        inside = inside & F.coalesce(within, F.lit(True))
    failed = base_failed("__q", rules)
    return joined.select("m.*", failed.alias("__base_failed"), (~failed & inside).alias("__kept"))


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed and kept.

    The measures are written once (narrow rows), then sketched and judged."""
    measured = materialise(with_measures(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    fences = materialise(thresholds(measured, rules), "fences")
    judged = judge(measured, fences, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"__q.{n}").alias(n) for n in names],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"),
    )


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their columns (packed meanwhile, so they may have any names).  Documents and
    measures are written once: a filter on measures that are not written would be pushed into them and evaluate them many times."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    measured = materialise(with_measures(packed.select("row", "row.text", "row.lang", "row.source")).drop("text"), "quality")
    judged = judge(measured, materialise(thresholds(measured, rules), "fences"), rules)
    return judged.where("__kept").select("row.*")
