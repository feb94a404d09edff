"""Deterministic sharded WARC archives (operator 12): writer and reader.

Writing.  (1) Each capture gets digests and its compressed ``response`` record, one gzip member a record,
in one pass over the pages.  (2) Of captures with equal payloads (SHA-256 and length) of at least
``min_revisit_bytes`` the one with the largest id stays a response; the others become ``revisit`` records,
which refer to it and hold headers only.  (3) Records are range-sorted by url, id and digest.  (4) Their compressed
sizes are summed along that order, and a record belongs to file ``floor(start / file_bytes)``, so files roll by compressed size and no
task has to wait for another.  (5) A task writes whole files: under a temporary name of its own, as one
``warcinfo`` record and the members in order.  (6) Spark commits one manifest entry per file that was written by
a task that succeeded; only those are moved to their final names, and the manifest is written last.

Files depend on the rows and settings alone: record ids, dates and order are derived from the rows,
whatever the partitions.  A lost executor's tasks run again under other temporary names, which no manifest
entry names; moving is repeatable.  Readers open only files that the manifest lists.

Reading.  The manifest keeps the places where a split of about ``split_bytes`` begins; each split is
read as a stream, one record at a time, and payloads are checked against their digests.

Paths are URIs that every executor can open (``pyarrow.fs``); by default a new folder beside the
shared checkpoints.

Scale: records are compressed before they are moved, twice (by payload, by order); a payload that many captures share is
dealt over several tasks by a salt, and its winner is found by a partial maximum.

Defined cases: a null payload is empty; a null or empty url gives a record without a target; a null id
sorts below all others and its record names none (a revisit of it refers to null).  Rows equal in id, url and payload are the same capture
told again: each is written, under the same record id (but for the one response).  Ties of the id between different urls go
to the greater url.  An empty table gives an empty manifest.  Only the three named columns are read, so other columns
may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.session import scratch_path

from .common import discard, materialise

SAFE = "!#$%&'()*+,/:;=?@[]~-._"  # characters that stay as they are in a target URI


@dataclass(frozen=True)
class WarcSettings:
    id_col: str = "page_id"
    url_col: str = "url"
    payload_col: str = "html"
    min_revisit_bytes: int = 1000
    file_bytes: int = 64 << 20
    split_bytes: int = 4 << 20
    date: str = "2024-01-01T00:00:00Z"
    prefix: str = "pages"
    hot_parts: int = 4096


# ---------------------------------------------------------------------------
# Records
# ---------------------------------------------------------------------------

def _fields(pairs: list) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def _member(first: bytes, fields: bytes, block: bytes) -> bytes:
    """One record as a gzip member of its own (no time, no name)."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(first + fields + b"\r\n" + block + b"\r\n\r\n") + gz.flush()


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: int | None, url: str | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((kind, page_id, url, sha1.hex())))}>"


def target_of(url: str | None) -> str | None:
    return quote(url, safe=SAFE) if url else None


def capture_record(page_id: int | None, url: str | None, n_bytes: int, sha1: bytes, date: str, payload: bytes | None,
                   refers: tuple | None = None) -> bytes:
    """A response record, or (``refers``: id and url of the response) a revisit record without the payload."""
    kind = "response" if refers is None else "revisit"
    http = _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)])
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n" + (payload or b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, url, sha1)), ("WARC-Date", date),
        ("WARC-Target-URI", target_of(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Block-Digest", _digest(block)),
    ]
    if refers is not None:
        other_id, other_url = refers
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id("response", other_id, other_url, sha1)),
            ("WARC-Refers-To-Target-URI", target_of(other_url)), ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-ID", other_id),
        ]
    fields += [("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _member(b"WARC/1.1\r\n", _fields(fields), block)


def info_record(name: str, date: str) -> bytes:
    """The warcinfo record that opens a file."""
    block = b"software: spendlake\r\nformat: WARC File Format 1.1\r\n"
    return _member(b"WARC/1.1\r\n", _fields([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", None, name, b"")), ("WARC-Date", date),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]), block)


def read_members(stream, size: int, piece: int = 1 << 20):
    """The decompressed members among the next ``size`` bytes of a stream, one at a time."""
    data, left = b"", size
    while left or data:
        gz, parts = zlib.decompressobj(31), []
        while not gz.eof:
            if not data:
                data = stream.read(min(piece, left)) if left else b""
                if not data:
                    raise ValueError("a record is cut off")
                left -= len(data)
            parts.append(gz.decompress(data))
            data = gz.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict, bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, rest = record.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    n = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a record")
    return fields, rest[:n]


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------

def open_folder(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _captures(pages: DataFrame, s: WarcSettings) -> DataFrame:
    """row, page_id, url, n_bytes, sha1, key and the response record of each page."""

    def make(batches):
        for b in batches:
            ids, urls, out = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for page_id, url, html in zip(ids, urls, b.column(3)):
                payload = (html.as_py() or "").encode()
                sha1 = hashlib.sha1(payload).digest()
                out.append((len(payload), sha1, hashlib.sha256(payload).digest(),
                            capture_record(page_id, url, len(payload), sha1, s.date, payload)))
            n, sha1s, keys, members = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha1s, pa.binary()),
                 pa.array(keys, pa.binary()), pa.array(members, pa.binary())],
                names=["row", "page_id", "url", "n_bytes", "sha1", "key", "member"])

    return pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{s.id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{s.url_col}`").cast("string").alias("url"), F.col(f"`{s.payload_col}`").cast("string").alias("html"),
    ).mapInArrow(make, "row bigint, page_id bigint, url string, n_bytes bigint, sha1 binary, key binary, member binary")


def _typed(captures: DataFrame, s: WarcSettings) -> DataFrame:
    """The captures with ``other`` (id and url of the response) and no member if they are revisits."""
    long = captures.where(F.col("n_bytes") >= s.min_revisit_bytes)
    shared = materialise(
        long.groupBy("key", "n_bytes").agg(
            F.max(F.struct("page_id", "url", "row")).alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1"),
        "warc-shared")
    total = shared.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    share = max(1000, total // s.hot_parts)
    salts: Column = F.ceil(F.col("copies") / F.lit(share)).cast("bigint")
    hot = shared.where(F.col("copies") > share).select("key", "n_bytes", salts.alias("salts"))  # hot_parts rows at most
    # short payloads have no partner; their row numbers spread them
    salt = F.when(F.col("n_bytes") < s.min_revisit_bytes, -1 - F.col("row")).when(
        F.col("salts").isNotNull(), F.pmod("row", "salts")).otherwise(F.lit(0))
    left = captures.join(F.broadcast(hot), ["key", "n_bytes"], "left").withColumn("salt", salt).drop("salts")
    right = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).select(
        "key", "n_bytes", "salt", "winner")
    revisit = F.col("winner.row") != F.col("row")
    return left.join(right, ["key", "n_bytes", "salt"], "left").select(
        "row", "page_id", "url", "n_bytes", "sha1",
        F.when(revisit, F.struct(F.col("winner.page_id").alias("page_id"), F.col("winner.url").alias("url"))).alias("other"),
        F.when(revisit, F.lit(None)).otherwise(F.col("member")).alias("member"))


def _placed(typed: DataFrame, s: WarcSettings, path: str) -> DataFrame:
    """member, file number and start of every record in the order of the archive; written to ``path``."""
    order = [F.col("url"), F.col("page_id"), F.col("sha1"), F.col("other").isNotNull(), F.col("row")]
    ordered = typed.repartitionByRange(*order).sortWithinPartitions(*order)

    def place(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            members, starts = [], []
            columns = [b.column(i).to_pylist() for i in range(6)]
            for page_id, url, n_bytes, sha1, other, member in zip(*columns):
                if member is None:
                    member = capture_record(page_id, url, n_bytes, sha1, s.date, None, (other["page_id"], other["url"]))
                members.append(member)
                starts.append(at)
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(members), pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(map(len, members), pa.int64()), pa.array(members, pa.binary())],
                names=["part", "local", "size", "member"])

    rows = materialise(ordered.select("page_id", "url", "n_bytes", "sha1", "other", "member").mapInArrow(
        place, "part bigint, local bigint, size bigint, member binary"), "warc-sorted", path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("offset") + F.col("local"))
    return placed.select("start", "member", F.expr(f"start div {int(s.file_bytes)}").alias("file"))


def _written(placed: DataFrame, path: str, s: WarcSettings) -> DataFrame:
    """Write the files under temporary names; one manifest entry per file."""

    def write(batches):
        folder, base = open_folder(path)
        folder.create_dir(f"{base}/_temporary", recursive=True)
        number, entry, out = None, None, None

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([entry], schema=ENTRY)

        for b in batches:
            for file, member in zip(b.column(0).to_pylist(), b.column(1)):
                if file != number:
                    if out is not None:
                        yield close()
                    number, name = file, f"{s.prefix}-{file:08d}.warc.gz"
                    temporary, info = f"_temporary/{name}.{uuid.uuid4().hex}", info_record(name, s.date)
                    out = folder.open_output_stream(f"{base}/{temporary}")
                    out.write(info)
                    entry = {"file": name, "temporary": temporary, "bytes": len(info), "records": 0, "splits": [0]}
                data = member.as_py()
                if entry["bytes"] - entry["splits"][-1] >= s.split_bytes:
                    entry["splits"].append(entry["bytes"])
                out.write(data)
                entry["bytes"] += len(data)
                entry["records"] += 1
        if out is not None:
            yield close()

    files = placed.repartition("file").sortWithinPartitions("file", "start")
    return files.select("file", "member").mapInArrow(
        write, "file string, temporary string, bytes bigint, records bigint, splits array<bigint>")


ENTRY = pa.schema([("file", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()),
                   ("splits", pa.list_(pa.int64()))])


def _committed(entries: DataFrame, path: str) -> DataFrame:
    """Move the files of the entries to their final names; may run again."""

    def move(batches):
        from pyarrow import fs

        folder, base = open_folder(path)
        there = lambda name: (i := folder.get_file_info(f"{base}/{name}")).type == fs.FileType.File and i
        for b in batches:
            for e in b.to_pylist():
                if there(e["temporary"]):
                    folder.move(f"{base}/{e['temporary']}", f"{base}/{e['file']}")
                done = there(e["file"])
                if not done or done.size != e["bytes"]:
                    raise OSError(f"{e['file']} is missing or incomplete")
            yield b

    return entries.mapInArrow(move, entries.schema)


def write_archives(pages: DataFrame, path: str | None = None, settings: WarcSettings = WarcSettings()) -> str:
    """Write the archives of a table and return their folder; its ``manifest`` (Parquet: file, bytes,
    records, splits) is written last and lists every file."""
    spark = pages.sparkSession
    path = (path or scratch_path(spark, "warc")).rstrip("/")
    # each table of records is deleted as soon as the next one is written
    made, ordered = scratch_path(spark, "warc-captures"), scratch_path(spark, "warc-sorted")
    captures = materialise(_captures(pages, settings), "warc-captures", made)
    placed = _placed(_typed(captures, settings), settings, ordered)
    discard(spark, made)
    entries = materialise(_written(placed, path, settings), "warc-files")
    discard(spark, ordered)
    # few rows, so they are dealt out by number
    tasks = max(1, min(256, entries.count()))
    _committed(entries.repartition(tasks), path).drop("temporary").write.parquet(f"{path}/manifest")
    return path


RECORD = "target_uri string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
ARROW_RECORD = pa.schema([("target_uri", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                          ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the archives in a folder (see RECORD; the digest as hexadecimal SHA-1),
    with the payload of responses if asked for.  A payload that is not what its header says is an error."""
    path = path.rstrip("/")
    manifest = spark.read.schema("file string, bytes bigint, records bigint, splits array<bigint>").parquet(f"{path}/manifest")
    ends = F.concat(F.slice("splits", F.lit(2), F.size("splits")), F.array("bytes"))
    splits = manifest.select("file", F.explode(F.arrays_zip(F.col("splits").alias("a"), ends.alias("b"))).alias("s")).select(
        "file", "s.a", "s.b")
    tasks = max(1, min(100_000, splits.count()))
    schema = ARROW_RECORD.append(pa.field("payload", pa.binary())) if with_payload else ARROW_RECORD

    def rows_of(stream, size, where):
        for record in read_members(stream, size):
            fields, block = parse_record(record)
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            http, payload = block.split(b"\r\n\r\n", 1)
            stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split()[1])
            if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != stated):
                raise ValueError(f"damaged payload in {where}")
            number = lambda name: int(fields[name]) if name in fields else None
            yield {"target_uri": fields.get("warc-target-uri"), "page_id": number("x-page-id"), "record_type": kind,
                   "payload_bytes": n, "payload_digest": stated, "refers_to": number("x-refers-to-page-id"),
                   "payload": payload if kind == "response" else None}

    def read(batches):
        folder, base = open_folder(path)
        for b in batches:
            for split in b.to_pylist():
                rows, held = [], 0
                with folder.open_input_file(f"{base}/{split['file']}") as stream:
                    stream.seek(split["a"])
                    for row in rows_of(stream, split["b"] - split["a"], split["file"]):
                        rows.append(row)
                        held += row["payload_bytes"] if with_payload else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return splits.repartition(tasks).mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))
