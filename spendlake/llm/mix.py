"""Mixing sources to target weights by Pareto order sampling (operator 2).

Targets: sources in code point order (null last) get weights from a repeating list and share
``share`` times all words; a target stops at ``cap`` times its source's words and the excess goes
to the other sources by weight.

Sampling: a document expects ``target * weight / sum(weight * size)`` copies of itself.  The
whole part is allocated as certain copies; the fraction p is its inclusion probability for one
more copy.  Documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken in that order while their words fit what is left of
the source's target; what then remains is filled in two more walks down the same ranking with
documents that are small enough.  The sample has a fixed size in words, and u is a seeded hash
of the row, so reruns agree.

Scale: only (source, size, rank) rows take part.  The place in the ranking where the words are
used up is found from two histograms of the rank (pre-aggregated per task), so no source is
ever sorted in one task; only the rows of one histogram cell are.  The decision per source is
a handful of cutoffs, joined to the documents.

Defined cases: null or empty texts have size 0, target and source as their source, and taken 0
(copies count, words do not); null sources are one source, last in the order; repeated rows
are numbered and have ranks of their own, so they are taken one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.session import assign_dense_ids

from .common import materialise, n_words_of

RANK_BITS = 52
CELL_BITS = 12


@dataclass(frozen=True)
class MixSettings:
    weights: tuple = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    seed: int = 20
    walks: int = 3


def source_targets(sizes: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    per = materialise(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "sources")
    numbered = assign_dense_ids(per, [F.col("source").isNull(), F.col("source")], 0, "__no")
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    weight = F.get(weights, ((F.col("__no") - 1) % len(settings.weights)).cast("int"))
    table = numbered.select(
        "source", "source_size", weight.alias("__w"), (F.col("source_size") * settings.cap).alias("__cap"))
    table = materialise(table, "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # Raise the level (words per weight) until the capped sources stay the same: one small
    # aggregate per round, and every round caps at least one more source.
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("__w") * level >= F.col("__cap")
        n, words, weight_left = table.agg(
            F.sum(at_cap.cast("int")), F.sum(F.when(at_cap, F.col("__cap"))), F.sum(F.when(~at_cap, F.col("__w")))
        ).first()
        if n is None or n == capped or not weight_left:
            break
        capped, level = n, (settings.share * total - (words or 0.0)) / weight_left
    return table.select(
        "source", "source_size", F.least(F.col("__w") * F.lit(float(level)), F.col("__cap")).alias("target"))


def _rank(p: Column, u: Column) -> Column:
    """Pareto order as a whole number of RANK_BITS bits: random odds over inclusion odds, mapped
    to (0, 1) by x / (1 + x), which keeps the order."""
    inner = u * (1 - p)
    x = inner / (inner + (1 - u) * p)
    return F.floor(x * float(2**RANK_BITS)).cast("bigint")


def _cutoff(rows: DataFrame, room: str) -> DataFrame:
    """Per source the largest rank c so that rows with rank <= c use at most ``room`` words:
    source, __c (-1: none), __used.  ``rows``: source, size, rank and ``room`` (per source)."""
    by = Window.partitionBy("source")
    upto = lambda order: by.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    top = RANK_BITS - CELL_BITS
    # cell sums, then cells within the cell where the words are used up
    cells = rows.groupBy("source", F.shiftright("rank", top).alias("__a")).agg(
        F.sum("size").alias("__s"), F.first(room).alias("__room"))
    cells = cells.withColumn("__upto", F.sum("__s").over(upto("__a")))
    full = cells.groupBy("source", "__room").agg(
        F.min(F.when(F.col("__upto") > F.col("__room"), F.col("__a"))).alias("__a"),
        F.coalesce(F.max(F.when(F.col("__upto") <= F.col("__room"), F.col("__upto"))), F.lit(0)).alias("__before"))
    inner = rows.alias("r").join(
        full.where("__a is not null").alias("f"),
        F.col("r.source").eqNullSafe(F.col("f.source")) & (F.shiftright(F.col("r.rank"), top) == F.col("f.__a")),
    ).select("r.source", "r.size", "r.rank", "f.__room", "f.__before", "f.__a")
    low = top - CELL_BITS
    fine = inner.groupBy("source", "__room", "__before", "__a", F.shiftright("rank", low).alias("__b")).agg(
        F.sum("size").alias("__s"))
    fine = fine.withColumn("__upto", F.col("__before") + F.sum("__s").over(upto("__b")))
    fine = fine.groupBy("source", "__room", "__a", "__before").agg(
        F.min(F.when(F.col("__upto") > F.col("__room"), F.col("__b"))).alias("__b"),
        F.max(F.when(F.col("__upto") <= F.col("__room"), F.col("__upto"))).alias("__more"))
    fine = fine.select("source", "__room", "__b", F.coalesce("__more", "__before").alias("__before"))
    last = rows.alias("r").join(
        fine.alias("f"),
        F.col("r.source").eqNullSafe(F.col("f.source")) & (F.shiftright(F.col("r.rank"), low) == F.col("f.__b")),
    ).select("r.source", "r.size", "r.rank", "f.__room", "f.__before", "f.__b")
    last = last.withColumn("__upto", F.col("__before") + F.sum("size").over(upto("rank")))
    fits = F.col("__upto") <= F.col("__room")
    found = last.groupBy("source", "__before", "__b").agg(
        F.max(F.when(fits, F.col("rank"))).alias("__c"), F.max(F.when(fits, F.col("__upto"))).alias("__used"))
    found = found.select(
        "source",
        # nothing of the last cell fits: everything below that cell does
        F.coalesce("__c", F.shiftleft(F.col("__b"), low) - 1).alias("__c"),
        F.coalesce("__used", "__before").alias("__used"))
    whole = full.where("__a is null").select(
        "source", F.lit(2**RANK_BITS).cast("bigint").alias("__c"), F.col("__before").alias("__used"))
    return materialise(found.unionByName(whole), "cutoffs")


def numbered(docs: DataFrame) -> DataFrame:
    """docs plus __nth: 0, 1, ... among the rows of equal source, doc_id and text.

    Only rows of which there are several are written and numbered, along a range-partitioned sort, so a row that holds a third of
    the table is dealt over many tasks."""
    key = ["source", "doc_id", "th"]
    hashed = docs.withColumn("th", F.xxhash64("text"))
    several = materialise(hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "several")
    if several.isEmpty():
        return docs.withColumn("__nth", F.lit(0).cast("bigint"))

    def same(a: str, b: str) -> Column:
        on = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return on("source") & on("doc_id") & on("th")

    names = [F.col(f"d.`{c}`") for c in docs.columns]
    d, k = hashed.alias("d"), several.alias("k")
    single = d.join(k, same("d", "k"), "left_anti").select(*names, F.lit(0).cast("bigint").alias("__nth"))
    copies = materialise(d.join(k, same("d", "k"), "left_semi").withColumn("__copy", F.monotonically_increasing_id()), "copies")
    places = assign_dense_ids(copies.select("__copy", *key), [*key, "__copy"], 0, "__place")
    first = places.groupBy(*key).agg(F.min("__place").alias("__first"))
    nth = places.alias("p").join(first.alias("f"), same("p", "f")).select("__copy", (F.col("__place") - F.col("__first")).alias("__nth"))
    return single.unionByName(copies.alias("d").join(nth, "__copy").select(*names, "__nth"))


def sized(docs: DataFrame, settings: MixSettings = MixSettings(), weight: str | None = None) -> DataFrame:
    """docs plus __size, __u (uniform in (0, 1), another for each of several equal rows) and __weight."""
    one = F.xxhash64(F.lit(settings.seed), "doc_id", "text")
    u = F.shiftrightunsigned(F.when(F.col("__nth") == 0, one).otherwise(F.xxhash64(F.lit(settings.seed), "doc_id", "text", "__nth")), 11)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return numbered(docs).select(
        *[F.col(f"`{c}`") for c in docs.columns], n_words_of(F.col("text")).alias("__size"),
        ((u + 0.5) / float(2**53)).alias("__u"), F.greatest(w, F.lit(0.0)).alias("__weight"))


def _expected(settings: MixSettings) -> Column:
    """Expected copies of a row; needs __weight, __mass (sum of weight * size) and target."""
    e = F.coalesce(F.col("target") * F.col("__weight") / F.nullif(F.col("__mass"), F.lit(0.0)), F.lit(0.0))
    return F.least(e, F.lit(float(settings.cap)))


def plan_mix(rows: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Per source: source_size, target, __mass and the cutoffs __cuts (array of struct(room, cut)).

    ``rows``: narrow table (source, size, __u, __weight)."""
    targets = source_targets(rows.select("source", "size"), settings)
    mass = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("__weight")).alias("__mass"))
    plan = materialise(
        targets.alias("t").join(mass.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")))
        .select("t.*", "m.__mass"), "targets")
    narrow = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*", "p.target", "p.__mass")
    narrow = narrow.withColumn("__e", _expected(settings))
    narrow = narrow.withColumn("__sure", F.floor("__e")).withColumn("__p", F.col("__e") - F.col("__sure"))
    narrow = narrow.withColumn("rank", F.when(F.col("__p") > 0, _rank(F.col("__p"), F.col("__u"))))
    narrow = materialise(narrow.select("source", "size", "rank", "__sure", "target"), "ranked")
    rooms = narrow.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("__sure"))).alias("__room"))
    rooms = materialise(rooms, "rooms")
    cuts = rooms.select("source", "__room", F.array().cast("array<struct<room:double,cut:bigint>>").alias("__cuts"))
    for _ in range(settings.walks):
        left = narrow.where("rank is not null and size > 0").alias("n").join(
            cuts.alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")))
        last = F.coalesce(F.try_element_at(F.col("c.__cuts"), F.lit(-1))["cut"], F.lit(-1))
        left = left.where((F.col("n.rank") > last) & (F.col("n.size") <= F.col("c.__room"))).select(
            "n.source", "n.size", "n.rank", "c.__room")
        found = _cutoff(left, "__room")
        step = cuts.alias("c").join(found.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")), "left")
        cut = F.struct(F.col("c.__room").alias("room"), F.col("f.__c").alias("cut"))
        cuts = materialise(step.select(
            "c.source", (F.col("c.__room") - F.coalesce("f.__used", F.lit(0))).alias("__room"),
            F.when(F.col("f.__c").isNull(), F.col("c.__cuts")).otherwise(F.concat("c.__cuts", F.array(cut)))
            .alias("__cuts")), "cuts")
    return materialise(
        plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")))
        .select("p.*", "c.__cuts"), "plan")


def mix_copies(docs: DataFrame, settings: MixSettings = MixSettings(), weight: str | None = None) -> DataFrame:
    """The documents with __size, source_size, target and __copies (whole copies in the mix)."""
    kept = [c for c in docs.columns]
    tagged = sized(docs, settings, weight)
    narrow = tagged.select("source", F.col("__size").alias("size"), "__u", "__weight")
    return _apply(tagged, plan_mix(materialise(narrow, "sizes"), settings), settings, kept)


def _apply(tagged: DataFrame, plan: DataFrame, settings: MixSettings, kept: list) -> DataFrame:
    plan = plan.select(
        F.col("source").alias("__source"), "source_size", "target", "__mass", "__cuts")
    d, p = tagged.alias("d"), plan.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.__source"))).select(
        *[F.col(f"d.`{c}`") for c in kept], "d.__size", "d.__u", "d.__weight",
        F.col("p.source_size").alias("__source_size"), F.col("p.target").alias("target"), "p.__mass", "p.__cuts")
    return joined.withColumn("__e", _expected(settings)).withColumn("__p", F.col("__e") - F.floor("__e")).withColumn(
        "__rank", F.when(F.col("__p") > 0, _rank(F.col("__p"), F.col("__u")))
    ).withColumn(
        "__extra",
        F.coalesce(F.exists("__cuts", lambda c: (F.col("__rank") <= c["cut"]) & (F.col("__size") <= c["room"])), F.lit(False))
        & (F.col("__size") > 0),
    ).withColumn("__copies", (F.floor("__e") + F.col("__extra").cast("int")).cast("int"))


def mix_report(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in the mix), copies."""
    docs = docs.select("doc_id", "text", "source")
    tagged = materialise(sized(docs, settings).drop("text"), "sizes")
    plan = plan_mix(tagged.select("source", F.col("__size").alias("size"), "__u", "__weight"), settings)
    out = _apply(tagged, plan, settings, ["doc_id"])
    return out.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), "target",
        (F.col("__size") * F.col("__copies")).cast("bigint").alias("taken"), F.col("__copies").alias("copies"))


def mix_documents(docs: DataFrame, settings: MixSettings = MixSettings(), weight: str | None = None) -> DataFrame:
    """The mixed corpus: each document once per copy, with the input's columns."""
    out = mix_copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "source", *([weight] if weight else [])),
                     settings, weight)
    return out.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")
