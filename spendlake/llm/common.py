"""Helpers shared by the operators: word rules, row keys, intermediate tables."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spendlake.session import scratch_path

# White space that separates words (space, tab, LF, VT, FF, CR); all other characters are word characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
# Bytes from which on a word is hashed by itself.
LONG_WORD = 64


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words_of(col: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE_RUN), "")


def n_words_of(col: Column) -> Column:
    return F.size(words_of(col)).cast("bigint")


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write an intermediate table into the shared scratch folder (or to ``path``) and read it back.

    This cuts lineage in a way that survives lost executors, and the planner knows the
    table's size afterwards (a small one is broadcast under the usual threshold)."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_arrow(df: DataFrame, keep: list, inputs: list, fields: list, make) -> DataFrame:
    """One output row per row: the ``keep`` columns unchanged, then ``fields`` ((name, DDL type)).

    ``make()`` is called once per task and returns a function from the ``inputs`` columns
    (Arrow arrays) to the lists of the new fields.  An input that is kept travels once."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema, *StructType.fromDDL(", ".join(f"`{name}` {ddl}" for name, ddl in fields))])
    types = [_arrow_type(ddl) for _, ddl in fields]
    names = [*keep, *[name for name, _ in fields]]
    sent = [c for c in inputs if c not in keep]
    picked = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(sent)])
    n = len(keep)
    places = [keep.index(c) if c in keep else n + sent.index(c) for c in inputs]

    def run(batches):
        fn = make()
        for b in batches:
            made = fn(*[b.column(i) for i in places])
            new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], *new], names=names)

    return picked.mapInArrow(run, schema)


def _arrow_type(ddl: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
              "binary": pa.binary(), "boolean": pa.bool_()}
    if ddl in simple:
        return simple[ddl]
    if ddl.startswith("array<"):
        return pa.list_(_arrow_type(ddl[6:-1]))
    if ddl.startswith("struct<"):
        parts = [x.split(":", 1) for x in ddl[7:-1].split(",")]
        return pa.struct([(name, _arrow_type(kind)) for name, kind in parts])
    raise ValueError(f"no Arrow type for {ddl}")


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads close values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` values from each start on."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(odd_multipliers(size, seed)):
            out += h[starts + j] * c
    return scramble(out)


def all_window_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(odd_multipliers(size, seed)):
            out += h[j : j + n] * c
    return scramble(out)


def text_chunks(values, limit: int):
    """Byte strings joined to chunks of about ``limit`` bytes: yields (index of the first one, their sizes,
    their bytes as an array).  None has no bytes."""
    first, part, size = 0, [], 0
    for value in values:
        part.append(value or b"")
        size += len(part[-1])
        if size >= limit:
            yield first, np.array([len(x) for x in part]), np.frombuffer(b"".join(part), np.uint8)
            first, part, size = first + len(part), [], 0
    if part:
        yield first, np.array([len(x) for x in part]), np.frombuffer(b"".join(part), np.uint8)


def word_hashes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word counts, 64-bit hashes of all words) of texts that stand one after the other in ``data`` (UTF-8
    bytes, ``sizes`` of each text).  Words are hashed eight bytes at a time, many at once; the few long
    ones by xxhash."""
    import xxhash

    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not len(data):
        return np.zeros(len(sizes), np.int64), np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    inside = (data != 32) & (data - np.uint8(9) > 4)  # bytes below 9 wrap around
    borders = bounds[(bounds > 0) & (bounds < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    low = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    m = odd_multipliers(2, 5)
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), 1 << 16):
            s, n = starts[at : at + (1 << 16)], lengths[at : at + (1 << 16)]
            h = scramble((eight[s] & low[np.minimum(n, 8)]) + n.astype(np.uint64) * m[0])
            done, more = 8, np.flatnonzero((n > 8) & (n <= LONG_WORD))
            while len(more):
                rest = eight[s[more] + done] & low[np.minimum(n[more] - done, 8)]
                h[more] = scramble((h[more] ^ rest) * m[1])
                done += 8
                more = more[n[more] > done]
            for i in np.flatnonzero(n > LONG_WORD).tolist():
                h[i] = xxhash.xxh64_intdigest(padded[s[i] : s[i] + n[i]])
            out[at : at + (1 << 16)] = h
    return np.diff(np.searchsorted(starts, bounds)), out


def document_chunks(texts, words_at_once: int, lower: bool = False, hashes: WordHashes | None = None):
    """Word hashes of many texts, joined to arrays of about ``words_at_once`` words: yields
    (indices of the texts, their word counts, hashes).  Null texts have no words."""
    hashes = WordHashes() if hashes is None else hashes
    index, counts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        raw = text.as_py() if hasattr(text, "as_py") else text
        data = (raw or "").encode()
        words = (data.lower() if lower else data).split()  # bytes.lower and bytes.split know ASCII only
        index.append(i)
        counts.append(len(words))
        parts.append(hashes.of(words))
        size += len(words)
        if size >= words_at_once:
            yield np.array(index), np.array(counts), np.concatenate(parts)
            index, counts, parts, size = [], [], [], 0
    if index:
        yield np.array(index), np.array(counts), np.concatenate(parts)


def sorted_groups(batches, n_keys: int):
    """Groups of rows with equal first ``n_keys`` columns from Arrow batches that are sorted by them:
    yields one RecordBatch-like Table per group.  At most one group and one batch are held."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
        start = 0
        for i, key in enumerate(keys):
            if last is not None and key != last:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(rest)
                rest, start = [], i
            last = key
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """v, root (the smallest node reachable) for the nodes of ``links`` (a, b: bigint), by alternating
    large-star and small-star steps until the edges form stars.  Each step is a minimum per node
    (partially aggregated) and a join; edges are written between rounds."""
    edges = materialise(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("w > u and w <> m").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("w")), F.struct(F.col("w").alias("u"), F.col("m").alias("w")))
        ).alias("e")).select("e.*").where("u <> w").distinct()
        edges = materialise(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return edges.select(F.col("u").alias("v"), F.col("w").alias("root")).unionByName(
        edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
