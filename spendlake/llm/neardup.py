"""Near duplicates: multi-index Hamming join of MinHash signatures (operator 8).

A document's set is its distinct 5-word shingles.  Documents with Jaccard similarity of at least
``percent`` are linked, and the connected components of links are the groups.

Index.  A signature has ``symbols`` minimum hashes, kept with 8 bits each for distances.  The first
``chunks * chunk`` of them, in full width, are split into chunks; by the pigeonhole principle two
signatures that differ in at most ``2 * chunks - 1`` of these symbols differ in at most one symbol of
some chunk, so every chunk is indexed once for each symbol left out.  Two documents with
similarity 0.75 share no key with probability 0.156 ** 12 = 2e-10.  So coverage is by probability: pairs
within ``distance`` of all ``symbols`` that differ in more of the chunked symbols may share no key.

Links.  Equal sets are one node.  The smallest node of a key's bucket leads it, each node follows
the leader that it shares most keys with, and the trees of followers are families.  Families that share a
bucket are merged if any of their nodes there are under the signature distance (which a linked pair
exceeds with probability below 1e-8): the nodes of a bucket are compared in cells of bounded size, and a
cell tells only which families it merges, so it has fewer merges than families.  The most frequent family of a
bucket is compared with the others only, not with itself.  Inside a merged
family (cut into cells of bounded size) the full sets are compared through postings, skipping
nodes that are already connected, and only a spanning forest of links leaves the task.  So no pair is
listed, neither inside a group of copies nor between its members and others, and no cap drops one.

Defined cases: null and empty texts have an empty set, are their own group and are kept; texts of
fewer than five words are one shingle; equal documents are linked by their equal sets; a group's id is
its smallest non-null doc_id; rows with a null id are kept only if their group has no id at
all; rows with equal ids are kept or removed together; the filter instead leaves exactly one row of a
group, also of repeated rows and of groups without an id; an empty table gives an empty result;
other columns are not read (or, in the filter, returned unchanged).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHashes, all_window_hashes, connected_components, document_chunks, map_arrow, materialise,
                     odd_multipliers, scramble, sorted_groups, window_hashes)


@dataclass(frozen=True)
class NearDupSettings:
    """``distance``: signature symbols in which nodes of families that are merged may differ;
    ``votes``: shared keys from which a node follows a leader; ``cell_nodes`` and ``cell_shingles``
    bound one comparison cell.  The last three never change the result."""

    words: int = 5
    percent: int = 75
    symbols: int = 128
    chunk: int = 3
    chunks: int = 12
    distance: int = 62
    votes: int = 6
    cell_nodes: int = 1024
    cell_shingles: int = 1_000_000


def shingle_sets(texts, s: NearDupSettings, hashes: WordHashes | None = None):
    """(index, sorted distinct shingle hashes) of each text, in order."""
    for index, counts, h in document_chunks(texts, 200_000, lower=True, hashes=hashes):
        runs = all_window_hashes(h, s.words, 5) if len(h) >= s.words else np.empty(0, np.uint64)
        start = 0
        for i, n in zip(index.tolist(), counts.tolist()):
            if n >= s.words:
                found = np.unique(runs[start : start + n - s.words + 1])
            elif n:
                found = window_hashes(h, np.array([start]), n, 6 + n)
            else:
                found = np.empty(0, np.uint64)
            yield i, found
            start += n


def signatures(sets: list[np.ndarray], s: NearDupSettings) -> np.ndarray:
    """Minimum hashes, one row per (non-empty) set and ``symbols`` columns of 32 bits."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    x = (joined >> np.uint64(32)).astype(np.uint32)
    y = joined.astype(np.uint32)
    mult = odd_multipliers(2 * s.symbols, 9).astype(np.uint32)
    out = np.empty((len(sets), s.symbols), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(s.symbols):
            out[:, j] = np.minimum.reduceat(x * mult[2 * j] + y * mult[2 * j + 1], starts)
    return out


def index_keys(sig: np.ndarray, s: NearDupSettings) -> np.ndarray:
    """A key for every chunk and symbol left out of it."""
    keys = []
    m = odd_multipliers(s.chunk, 11)
    wide = sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c in range(s.chunks):
            for out in range(s.chunk):
                key = np.full(len(sig), 1 + c * s.chunk + out, np.uint64)
                for j in range(s.chunk):
                    if j != out:
                        key = scramble(key * m[j] + wide[:, c * s.chunk + j])
                keys.append(key)
    return np.stack(keys, 1)


def described(docs: DataFrame, s: NearDupSettings) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, digest (of the set, null if empty), sig, keys."""

    def make():
        hashes = WordHashes()

        def describe(texts):
            import xxhash

            n = len(texts)
            size, digest, sig, keys = [0] * n, [None] * n, [None] * n, [None] * n
            held: list[tuple[int, np.ndarray]] = []

            def flush():
                if not held:
                    return
                full = signatures([x for _, x in held], s)
                low = full.astype(np.uint8)
                for (i, _), a, b in zip(held, low, index_keys(full, s).view(np.int64)):
                    sig[i], keys[i] = a.tobytes(), b
                held.clear()

            total = 0
            for i, found in shingle_sets(texts, s, hashes):
                size[i] = len(found)
                if len(found):
                    digest[i] = xxhash.xxh3_128_digest(found.tobytes())
                    held.append((i, found))
                    total += len(found)
                    if total > 200_000:
                        flush()
                        total = 0
            flush()
            return size, digest, sig, keys

        return describe

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    fields = [("n_shingles", "bigint"), ("digest", "binary"), ("sig", "binary"), ("keys", "array<bigint>")]
    return map_arrow(rows, ["doc_id", "th"], ["text"], fields, make)


def _families(keys: DataFrame, s: NearDupSettings) -> DataFrame:
    """v, root for nodes in a tree of followers; keys: (key, v)."""
    leaders = keys.groupBy("key").agg(F.min("v").alias("leader"), F.max("v").alias("top")).where("leader <> top")
    votes = (
        keys.join(leaders.select("key", "leader"), "key").where("v <> leader")
        .groupBy("v", "leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.votes)
    )
    up = votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("leader")).alias("back"))).alias("x")).select(
        "v", (-F.col("x.back")).alias("up"))
    up = materialise(up, "followers")
    while True:  # a leader is smaller than its followers: a forest; its depth halves per round
        nxt = up.select(F.col("v").alias("up"), F.col("up").alias("over"))
        jumped = materialise(up.join(nxt, "up", "left").select(
            "v", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "followers")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    roots = up.select(F.col("up").alias("v"), F.col("up").alias("root")).distinct()
    return materialise(up.select("v", F.col("up").alias("root")).unionByName(roots), "families")


def _cells(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Rows dealt to cells (group, i, j): ``sizes`` has the number of parts per group; rows of part p
    go to all cells (p, j) and (i, p), so any two rows of a group meet in one cell."""
    dealt = rows.join(sizes, group).withColumn("__p", F.pmod(F.hash("v"), F.col("parts").cast("int")))
    other = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    return dealt.select("*", other.alias("__o")).withColumn("i", F.least("__p", "__o")).withColumn(
        "j", F.greatest("__p", "__o")).drop("__p", "__o", "parts")


def spanning_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all nodes of one cell that are linked directly or over others."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    nodes = [nodes[i] for i in order]
    sets = [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(column, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(column))])
    holders = row[by]  # nodes per shingle, at ends[c] .. ends[c + 1]
    starts = np.cumsum(size) - size
    waiting = np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            u = queue.pop()
            mine = column[starts[u] : starts[u] + size[u]]
            lengths = ends[mine + 1] - ends[mine]
            shared_columns = mine[lengths > 1]
            if not len(shared_columns):
                continue
            lengths = lengths[lengths > 1]
            at = np.repeat(ends[shared_columns] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            hit = waiting & (100 * shared >= percent * (size + size[u] - shared)) & (shared > 0)
            for v in np.flatnonzero(hit).tolist():
                waiting[v] = False
                links.append((nodes[u], nodes[v]))
                queue.append(v)
    return links


def _family_links(families: DataFrame, sets: DataFrame, s: NearDupSettings) -> DataFrame:
    """a, b: links inside families."""
    rows = families.join(sets, "v")
    sizes = families.join(sets.select("v", "n_shingles"), "v").groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / s.cell_nodes), F.ceil(F.sum("n_shingles") / s.cell_shingles)).alias("parts"))
    cells = _cells(rows, "root", sizes).select("root", "i", "j", "v", "shingles")
    dealt = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches):
        for t in sorted_groups(batches, 3):
            found = dict(zip(t.column("v").to_pylist(), t.column("shingles").to_pylist()))
            yield _pairs(spanning_links(list(found), [np.frombuffer(x, np.uint64) for x in found.values()], s.percent))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _bucket_cells(keys: DataFrame, families: DataFrame, s: NearDupSettings) -> DataFrame:
    """key, kind, i, j, v, root, major: the nodes of each bucket with several families, dealt to cells.

    Cells of kind 0 hold nodes outside the bucket's most frequent family, any two of which meet; cells of kind 1 hold a part of that
    family (``major``) and a part of the others.  So a bucket of one large family and a few strangers costs one row per member."""
    with_root = keys.join(families, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root"))
    mixed = with_root.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = materialise(with_root.join(mixed, "key", "left_semi"), "mixed")
    per_family = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = lambda n: F.ceil(n / F.lit(s.cell_nodes)).cast("int")
    sizes = per_family.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).select(
        "key", F.col("top.root").alias("top"), parts(F.col("top.n")).alias("major_parts"), parts(F.col("n") - F.col("top.n")).alias("parts"))
    rows = rows.join(sizes, "key").withColumn("major", F.col("root") == F.col("top")).withColumn(
        "p", F.pmod(F.hash("v"), F.when(F.col("major"), F.col("major_parts")).otherwise(F.col("parts"))))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    p = F.col("p")
    crossed = F.when(F.col("major"), F.transform(upto("parts"), lambda o: cell(1, p, o))).otherwise(
        F.transform(upto("major_parts"), lambda o: cell(1, o, p)))
    others = F.when(F.col("major"), F.array().cast("array<struct<kind:int,i:int,j:int>>")).otherwise(
        F.transform(upto("parts"), lambda o: cell(0, F.least(p, o), F.greatest(p, o))))
    return rows.withColumn("cell", F.explode(F.concat(crossed, others))).select("key", "cell.*", "v", "root", "major")


def merges_of(root: np.ndarray, major: np.ndarray, n: np.ndarray, sig: np.ndarray, crossed: bool,
              s: NearDupSettings) -> list[tuple[int, int]]:
    """Pairs of families with nodes under the signature distance in one cell, as a forest: families
    that are connected by earlier pairs are not compared again."""
    order = np.argsort(n, kind="stable")
    root, major, n, sig = root[order], major[order], n[order], sig[order]
    top = np.searchsorted(n, n * 100 // s.percent, side="right")  # larger sets cannot be similar enough
    names, group = np.unique(root, return_inverse=True)  # group: the merged family of each node so far
    merges = []
    for x in range(len(n) - 1):
        others = np.arange(x + 1, top[x])
        others = others[group[others] != group[x]]
        if crossed:  # nodes of the same side meet elsewhere
            others = others[major[others] != major[x]]
        near = others[(sig[others] != sig[x]).sum(1) <= s.distance]
        for y in near.tolist():
            if group[y] != group[x]:
                merges.append((int(root[x]), int(root[y])))
                group[group == group[y]] = group[x]
    return merges


def _merged_families(keys: DataFrame, nodes: DataFrame, families: DataFrame, s: NearDupSettings) -> DataFrame:
    """v, root: the families with those merged that have nodes under the signature distance in a bucket."""
    cells = _bucket_cells(keys, families, s)
    full = cells.join(nodes.select("v", "n_shingles", "sig"), "v").select("key", "kind", "i", "j", "root", "major", "n_shingles", "sig")
    dealt = full.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")

    def run(batches):
        found = set()
        for t in sorted_groups(batches, 4):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, s.symbols)
            root = t.column("root").to_numpy()
            found.update((min(m), max(m)) for m in merges_of(
                root, t.column("major").to_numpy(), t.column("n_shingles").to_numpy(), sig, t.column("kind")[0].as_py() == 1, s))
            if len(found) > 10_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    merges = dealt.mapInArrow(run, "a bigint, b bigint").distinct()
    merged = materialise(connected_components(merges).select(F.col("v").alias("root"), F.col("root").alias("to")), "merged")
    return materialise(
        families.join(merged, "root", "left").select("v", F.coalesce("to", "root").alias("root")).unionByName(
            merged.select(F.col("root").alias("v"), F.col("to").alias("root")).join(families, "v", "left_anti")), "families")


def _pairs(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])


def _full_sets(docs: DataFrame, nodes: DataFrame, s: NearDupSettings) -> DataFrame:
    """v, n_shingles, shingles (sorted 64-bit hashes) for the given nodes, from one row of each."""
    def make():
        hashes = WordHashes()

        def sets(texts):
            return ([found.tobytes() for _, found in shingle_sets(texts, s, hashes)],)

        return sets

    d = docs.select(F.col("doc_id").alias("__id"), "text", F.xxhash64("text").alias("__th"))
    joined = d.join(nodes.select("v", "n_shingles", "doc_id", "th"),
                    F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("th")))
    rows = map_arrow(joined.select("v", "n_shingles", "text"), ["v", "n_shingles"], ["text"], [("shingles", "binary")], make)
    # rows with equal id and text give the same set
    return rows.groupBy("v").agg(F.first("n_shingles").alias("n_shingles"), F.first("shingles").alias("shingles"))


def near_duplicate_groups(docs: DataFrame, s: NearDupSettings = NearDupSettings()) -> DataFrame:
    """Per document: doc_id, th (hash of its text), n_shingles, component_id, kept."""
    return _grouped(docs.select("doc_id", "text"), s).drop("digest", "node")


def _grouped(docs: DataFrame, s: NearDupSettings) -> DataFrame:
    """near_duplicate_groups with digest (of the set; null without words) and node (of the group; null without words)."""
    rows = materialise(described(docs, s), "described")
    one = rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("one"),
        F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = materialise(one.select(
        F.monotonically_increasing_id().alias("v"), "digest", "one.doc_id", "one.th", "n_shingles", "sig", "keys"), "nodes")
    keys = nodes.select("v", F.explode("keys").alias("key"))
    families = _families(keys, s)
    families = _merged_families(keys, nodes, families, s)
    sets = materialise(_full_sets(docs, nodes.join(families.select("v"), "v", "left_semi"), s), "sets")
    parts = connected_components(_family_links(families, sets, s))
    labelled = nodes.select("v", "digest", "doc_id").join(parts, "v", "left").withColumn("root", F.coalesce("root", "v"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    groups = materialise(labelled.join(smallest, "root").select("digest", F.col("root").alias("node"), "component_id"), "groups")
    out = rows.select("doc_id", "th", "n_shingles", "digest").join(groups, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), "digest", "node").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, s: NearDupSettings = NearDupSettings()) -> DataFrame:
    """The documents that stay, with their columns: one row per group.

    A group's row is the first by doc_id (nulls last) and text hash.  Rows equal in both are told apart by a
    number that is written with the few rows of which there are several; texts without words stay."""
    grouped = materialise(_grouped(docs.select("doc_id", "text"), s).where("node is not null").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "node"), "grouped")
    rank = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__th")
    first = grouped.groupBy("node").agg(F.min(rank).alias("one"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # the rows of a group of several: all go but, of the first, one
    several = grouped.join(first, "node").groupBy("__id", "__th").agg(
        F.max(rank == F.col("one")).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    gone = materialise(several.where("not __first or __rows > 1"), "removed")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of theirs meets one of ours
    d = packed.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__th"))
    kept = d.join(gone, same, "left_anti").select("row.*")
    repeated = gone.where("__first").select("__id", "__th")
    if repeated.isEmpty():
        return kept
    copies = materialise(d.join(repeated, same).withColumn("number", F.monotonically_increasing_id()), "copies")
    chosen = copies.groupBy("__id", "__th").agg(F.min("number").alias("number")).select("number")
    return kept.unionByName(copies.join(chosen, "number", "left_semi").select("row.*"))
