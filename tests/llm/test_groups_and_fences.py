"""Operator 8 with families and strangers, operator 9's verdicts against plainly computed quartiles."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import neardup, quality
from spendlake.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_family(rng, n, words=220, changes=24, first=0):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(changes)):
            t[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(t)))
    return rows


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if find(a) != find(b) and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cell", [16, 1024])
def test_families_with_strangers_equal_brute_force(spark, cell):
    """Copies that differ more and more: some follow no leader of their family and are found by the buckets alone."""
    rng = random.Random(cell)
    rows = near_family(rng, 120, changes=14) + near_family(rng, 60, changes=8, first=1000) + near_family(rng, 30, changes=40, first=2000)
    rows += [(3000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30, 300])))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_groups(docs, neardup.NearDupSettings(cell_nodes=cell, votes=9)).collect()}
    assert got == components(rows)


def test_merges_grow_with_families_not_with_pairs(spark):
    """One family of 1500 near copies with strangers in it: the buckets tell few merges, all pairs of which are one group."""
    rows = near_family(random.Random(7), 1500, words=300, changes=26)
    s = neardup.NearDupSettings()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    described = materialise(neardup.described(docs, s), "t-described")
    nodes = materialise(described.select(F.monotonically_increasing_id().alias("v"), "n_shingles", "sig", "keys"), "t-nodes")
    keys = nodes.select("v", F.explode("keys").alias("key"))
    families = neardup._families(keys, s)
    strangers = 1500 - families.count()
    cells = neardup._bucket_cells(keys, families, s)
    dealt = cells.join(nodes.select("v", "n_shingles", "sig"), "v").collect()
    merges = 0
    for _, group in collections.defaultdict(list, _by_cell(dealt)).items():
        sig = np.frombuffer(b"".join(r.sig for r in group), np.uint8).reshape(len(group), s.symbols)
        col = lambda n: np.array([r[n] for r in group])
        found = neardup.merges_of(col("root"), col("major"), col("n_shingles"), sig, group[0].kind == 1, s)
        assert len(found) < len(set(col("root")))
        merges += len(found)
    assert strangers > 0 and merges <= 36 * (strangers + 2)
    merged = neardup._merged_families(keys, nodes, families, s)
    assert merged.select("v").distinct().count() == merged.count() >= families.count()


def _by_cell(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.key, r.kind, r.i, r.j].append(r)
    return out


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80, one link each: measured recall of the index."""
    rng = random.Random(11)
    rows, pairs = [], 0
    for i in range(400):
        w = [f"a{rng.randrange(10**7)}" for _ in range(300)]
        t = list(w)
        for k in rng.sample(range(20), rng.choice([7, 8])):  # 7 or 8 changed words, 5 shingles each
            t[15 * k + 4] = f"b{rng.randrange(10**7)}"
        n = len(shingles(" ".join(w)) & shingles(" ".join(t)))
        share = n / (2 * 296 - n)
        if 0.75 <= share <= 0.80:
            pairs += 1
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = neardup.near_duplicate_groups(docs).where("component_id <> doc_id").count()
    print(f"recall at 0.75-0.80: {linked} of {pairs}")
    assert pairs > 100 and linked == pairs


def test_stages_keep_columns_of_any_name(spark):
    names = ["__h", "__q", "__id", "__th", "row", "id", "h", "number", "__kept", "__lang", "key", "node"]
    rows = [(i, f"{' '.join(f'word{k}' for k in range(80))} {i // 2}", "en", "a", i) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for stage in (quality.quality_filter, neardup.drop_near_duplicates):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names) and out.count() == (8 if stage is quality.quality_filter else 1)
    assert neardup.drop_near_duplicates(docs.unionByName(docs)).count() == 1


def plain_measures(text):
    lines = [x for x in (text or "").split("\n") if x.split()]
    w = (text or "").encode().split()
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    ratios = {"symbols": sum(c in "#*$%&|<>" for c in text or "") / n if n else None,
              "dup_lines": (len(lines) - len(set(lines))) / len(lines) if lines else None,
              "repeats": len(covered) / n if n else None,
              "word_length": sum(len(x.decode()) for x in w) / n if n else None}
    return ratios, n < 50 or 100 * len(covered) > 50 * n


def quartiles(values):
    v = sorted(values)
    at = lambda p: v[max(0, math.ceil(p * len(v)) - 1)]
    return at(0.25), at(0.75)


def plain_verdicts(rows, rules):
    measured = [(i, lang, source, *plain_measures(t)) for i, t, lang, source, _ in rows]
    usual = [m for m in measured if not m[4]]
    least = dict(rules.least_spread)
    out = collections.Counter()
    for i, lang, source, ratios, base in measured:
        kept = not base
        for k, x in ratios.items():
            pick = lambda cond: [m[3][k] for m in usual if cond(m)]
            mine, parent, top = pick(lambda m: m[1:3] == (lang, source)), pick(lambda m: m[1] == lang), pick(lambda m: True)
            if not mine:
                continue  # a group without usual texts has no fences

            def trusted(values, q):
                a, b = quartiles(values)
                return (a, b) if len(values) >= rules.min_group and b - a <= rules.wide * max(q[1] - q[0], least[k]) else q

            a, b = trusted(mine, trusted(parent, quartiles(top)))
            spread = rules.fence * max(b - a, least[k])
            kept &= x is None or x <= b + spread and (k != "word_length" or x >= a - spread)
        out[i, base, kept] += 1
    return out


def fence_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        source = rng.choice(["a", "a", "a", "b", "b", "tiny" if i < 60 else "a", None, "junk"])
        words = [rng.choice(["ab", "cde", "fghi", "Ärger", "xyzzy"]) + str(rng.randrange(60)) for _ in range(rng.choice([20, 60, 90, 200]))]
        if (source == "junk" and rng.random() < 0.4) or rng.random() < 0.03:
            words = ["#" + w for w in words]
        if rng.random() < 0.05:
            words = ["longword" * 4 + w for w in words]
        text = "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)
        if rng.random() < 0.1:
            text += "\nsame line here" * rng.randrange(2, 9)
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source, 0))
    return rows + [(None, None, None, None, 0), (9000, "", "en", "a", 0), rows[3], rows[3]]


@pytest.mark.parametrize("rules", [quality.QualityRules(min_group=20), quality.QualityRules()])
def test_verdicts_equal_plain_quartiles(spark, rules):
    rows = fence_rows(5)
    got = quality.quality_verdicts(spark.createDataFrame(rows, DOCS).repartition(5), rules).collect()
    assert collections.Counter((r.doc_id, r.base_failed, r.kept) for r in got) == plain_verdicts(rows, rules)


def test_a_source_of_much_junk_loses_it(spark):
    rng = random.Random(8)
    say = lambda mark: " ".join(mark + f"word{rng.randrange(500)}" for _ in range(120))
    rows = [(i, say("#" if i % 5 < 2 else ""), "en", "junk", 0) for i in range(300)] + [(1000 + i, say(""), "en", "clean", 0) for i in range(900)]
    kept = {r.doc_id for r in quality.quality_filter(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {r[0] for r in rows if "#" not in r[1]}
