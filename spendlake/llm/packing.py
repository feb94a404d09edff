"""Token ids packed into fixed-length rows (operator 6).

Documents are tokenised with a byte-level BPE vocabulary (a rank file whose path is a parameter),
an end mark is appended, texts longer than a row are split without loss, and the pieces are
packed best-fit-decreasing: longest first, each into the open row with the least room that is
enough.  That row is found in a max segment tree over the possible amounts of room (leaf r: is
there a row with r tokens free), in log(row length) steps.

A task packs its documents in groups of at most ``group_tokens`` tokens, so memory is bounded and
nothing is shuffled; each group can leave its last rows partly empty.

Output: one row per packed row, with the id matrix row, cumulative segment lengths (cu_seqlens)
and positions that restart at 0 with each segment; ``write_binary`` makes .npy files of them.
Segments name their document and the offset in it, so documents can be put together again.

Defined cases: a null text has no tokens and no segment; an empty text is the end mark alone;
repeated rows are packed once each; an empty table gives no rows; null ids stay null; other
columns are not read.
"""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before the merges of the rank file.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class PackSettings:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    end_id: int = 50256  # free in the rank file
    row_tokens: int = 2048
    group_tokens: int = 4_000_000
    cached_words: int = 300_000  # without effect since texts are encoded whole; kept for callers that name it


class Tokenizer:
    """Token ids as uint16, by one call for each text: most distinct words of a corpus occur once, so
    remembering the ids of words costs more than it saves."""

    def __init__(self, settings: PackSettings):
        import tiktoken

        with open(settings.vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(max(ranks.values()), settings.end_id) >= 2**16:
            raise ValueError("ids do not fit two bytes")
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(array("H", self.encode(text)), np.uint16)


class Rooms:
    """Open rows by free tokens, with a max segment tree over the amounts that occur."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [-1] * (2 * self.size)  # largest free amount below a node with an open row
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, there: bool) -> None:
        tree, i = self.tree, self.size + room
        tree[i] = room if there else -1
        i //= 2
        while i:
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2

    def add(self, row: int, room: int) -> None:
        if not self.rows[room]:
            self._set(room, True)
        self.rows[room].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room >= need, and that room."""
        tree, i = self.tree, self.size + need
        if tree[i] < 0:
            while i > 1 and (i & 1 or tree[i ^ 1] < 0):  # up to the first right neighbour with a row
                i //= 2
            if i <= 1:
                return None
            i ^= 1
            while i < self.size:  # down to its smallest amount
                i = 2 * i if tree[2 * i] >= 0 else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, False)
        return row, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row; lengths are at most ``capacity``."""
    rooms, rows = Rooms(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = rooms.take(n)
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(k)
        if room > n:
            rooms.add(row, room - n)
    return rows


def pack_group(docs: list[tuple[int | None, np.ndarray]], capacity: int) -> list[dict]:
    """Rows for (id, token ids) pairs: segments as (id, offset in the document, ids)."""
    pieces = [(d, at, ids[at : at + capacity]) for d, ids in docs for at in range(0, len(ids), capacity)]
    if not pieces:
        return []
    out = []
    for members in best_fit_decreasing(np.array([len(p[2]) for p in pieces]), capacity):
        segments = [pieces[k] for k in members]
        lengths = np.array([len(s[2]) for s in segments], np.int32)
        out.append({
            "doc_ids": [s[0] for s in segments],
            "offsets": [s[1] for s in segments],
            "n_tokens": int(lengths.sum()),
            "ids": np.concatenate([s[2] for s in segments]),
            "cu_seqlens": np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)]),
            "positions": np.concatenate([np.arange(n, dtype=np.uint16) for n in lengths]),
        })
    return out


SCHEMA = ("pack_id string, doc_ids array<bigint>, offsets array<bigint>, n_tokens bigint, "
          "input_ids binary, cu_seqlens array<int>, position_ids binary")


def pack_documents(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """Packed rows: pack_id (partition-group-row), doc_ids and offsets (tokens) of the segments,
    n_tokens, input_ids and position_ids (little-endian uint16, padded to the row length with the
    end mark and 0), cu_seqlens."""
    capacity = settings.row_tokens

    def rows_of(group: list, name: str) -> pa.RecordBatch:
        rows = pack_group(group, capacity)
        pad = [(0, capacity - r["n_tokens"]) for r in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([f"{name}-{k}" for k in range(len(rows))], pa.string()),
            pa.array([r["doc_ids"] for r in rows], pa.list_(pa.int64())),
            pa.array([r["offsets"] for r in rows], pa.list_(pa.int64())),
            pa.array([r["n_tokens"] for r in rows], pa.int64()),
            pa.array([np.pad(r["ids"], p, constant_values=settings.end_id).astype("<u2").tobytes()
                      for r, p in zip(rows, pad)], pa.binary()),
            pa.array([r["cu_seqlens"] for r in rows], pa.list_(pa.int32())),
            pa.array([np.pad(r["positions"], p).astype("<u2").tobytes() for r, p in zip(rows, pad)], pa.binary()),
        ], names=["pack_id", "doc_ids", "offsets", "n_tokens", "input_ids", "cu_seqlens", "position_ids"])

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tokenizer, end = Tokenizer(settings), np.array([settings.end_id], np.uint16)
        group, size, number = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                ids = np.concatenate([tokenizer.ids(text.as_py()), end])
                group.append((doc_id, ids))
                size += len(ids)
                if size >= settings.group_tokens:
                    yield rows_of(group, f"{task}-{number}")
                    group, size, number = [], 0, number + 1
        if group:
            yield rows_of(group, f"{task}-{number}")

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(pack, SCHEMA)


def write_binary(packed: DataFrame, path: str, row_tokens: int = PackSettings.row_tokens) -> None:
    """Write packed rows as Parquet files whose rows are the matrices of one task: ``input_ids`` and
    ``position_ids`` (row-major little-endian uint16, n_rows x row_tokens), ``cu_seqlens`` (all
    segment ends of all rows, from 0) and n_rows.  Files are committed by Spark, so a lost
    executor leaves no partial file."""

    def matrices(batches):
        for b in batches:
            lengths = [np.diff(x) for x in b.column(b.schema.get_field_index("cu_seqlens")).to_pylist()]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
            column = lambda n: b"".join(b.column(b.schema.get_field_index(n)).to_pylist())
            yield pa.RecordBatch.from_arrays([
                pa.array([b.num_rows], pa.int64()), pa.array([row_tokens], pa.int64()),
                pa.array([column("input_ids")], pa.binary()), pa.array([column("position_ids")], pa.binary()),
                pa.array([ends], pa.list_(pa.int64())),
            ], names=["n_rows", "row_tokens", "input_ids", "position_ids", "cu_seqlens"])

    schema = "n_rows bigint, row_tokens bigint, input_ids binary, position_ids binary, cu_seqlens array<bigint>"
    packed.mapInArrow(matrices, schema).write.parquet(path)
