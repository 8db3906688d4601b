"""WARC archives: a writer, and a splittable reader.

The writer makes one gzip member per record, as the WARC standard asks, in one
file per partition and task attempt; the manifest, a written table, names the
files of the attempts that succeeded, so a lost or repeated task leaves nothing
that is read.  Of records with equal payloads of ``MIN_REVISIT`` bytes or more
the one with the smallest id is a response, the others are revisits that refer
to it and carry no payload.

The reader cuts the files into byte ranges.  A task scans its range for gzip
magic, takes a candidate only if the bytes there inflate to a complete WARC
header of any length, and owns the records whose first byte lies inside its
range, also when they end outside.  After a record the next one is expected at
its end, so only the start of a range and damaged places are scanned.  The
manifest has the number of records that begin in every ``RANGE_BYTES`` of a file;
a task that finds another number fails.

Files are opened through ``pyarrow.fs`` by URI: any store that driver and
executors share.

Results for odd input: a null payload is an empty one; a null url leaves the
header out; line ends in a url are percent-encoded; records without an id are
responses; of repeated rows with the smallest id each is a response; an empty
table makes no file and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import binary_values, scratch_path, small_batches, write_table

MIN_REVISIT = 100
#: Bytes of archive that one reading task is given.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a header that are inflated at once.
HEADER_PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENDS = re.compile(r"[\r\n]")

READ_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload binary, "
               "payload_bytes long, payload_digest string, path string, offset long")


def _uri(path: str) -> str:
    return path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(_uri(path))


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed WARC record: an HTTP response, or a revisit of one."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + _ENDS.sub(lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str, payload: Column, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(id, refers_to): a row for every id that revisits another's payload; a
    written table, so that its size is known to whoever joins it."""
    digests = pages.where(F.col(id_col).isNotNull() & (F.length(payload) >= min_revisit)).select(
        F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("most")).where("refers_to < most")
    return write_table(digests.join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct(),
                       "warc-revisits")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record per row under ``folder`` and returns the manifest (path,
    bytes, records, and the records that begin in every ``RANGE_BYTES``).  Record
    ids are ``urn:page:<id>``."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    revisits = plan_records(pages, id_col, payload, min_revisit)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    rows = rows.join(revisits, ["id", "digest"], "left").select(
        F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, size, n = None, 0, 0
        begin: list[int] = []
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = _open(name)
                fs.create_dir(path.rpartition("/")[0])
                out = fs.open_output_stream(path, compression=None)
            ids, urls, digests, refs = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, value in enumerate(batch.column(2)):
                rid = f"urn:page:{ids[i]}" if ids[i] is not None else f"urn:uuid:{uuid.uuid4()}"
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = z.compress(record(rid, urls[i], value.as_py(), digests[i], refs[i] and f"urn:page:{refs[i]}")) + z.flush()
                out.write(data)
                begin += [0] * (size // RANGE_BYTES + 1 - len(begin))
                begin[-1] += 1
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            begin += [0] * ((size - 1) // RANGE_BYTES + 1 - len(begin))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n]), pa.array([begin], pa.list_(pa.int64()))],
                                             names=["path", "bytes", "records", "begin"])

    return write_table(rows.mapInArrow(run, "path string, bytes long, records long, begin array<long>"), "warc-manifest")


class _Source:
    """A file read forward in pieces; ``at(offset)`` may step back a little."""

    def __init__(self, path: str, size: int) -> None:
        fs, name = _open(path)
        self.file, self.size, self.base, self.held = fs.open_input_file(name), size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.base or offset + n > self.base + len(self.held):
            self.file.seek(offset)
            self.base, self.held = offset, self.file.read(min(max(n, READ_BYTES), max(0, self.size - offset)))
        return self.held[offset - self.base:offset - self.base + n]


def _header(data: bytes) -> dict[str, str] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        found[key.strip().lower()] = value.strip()
    return found if found.get("content-length", "").isdigit() and "warc-type" in found else None


def _is_record(source: _Source, at: int) -> bool:
    """Whether the bytes there inflate to a complete WARC header, however long."""
    z, got, piece, spot = zlib.decompressobj(31), bytearray(), b"", at
    try:
        while not z.eof:
            if not piece:
                piece = source.at(spot, min(4096, source.size - spot))
                if not piece:
                    return False
                spot += len(piece)
            seen = max(0, len(got) - 3)
            got += z.decompress(piece, HEADER_PIECE)
            piece = z.unconsumed_tail
            if not b"WARC/".startswith(got[:5]):
                return False
            if got.find(b"\r\n\r\n", seen) >= 0:
                return _header(bytes(got)) is not None
    except zlib.error:
        return False
    return False


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The inflated member and the offset of its end; None if it is damaged."""
    z, parts, spot = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = source.at(spot, min(READ_BYTES // 8, source.size - spot))
            if not piece:
                return None
            parts.append(z.decompress(piece))
            spot += len(piece) - len(z.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), spot


def _records(path: str, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that begin in [start, end)."""
    source, at = _Source(path, size), start
    while at < end:
        if not (source.at(at, 3) == MAGIC and _is_record(source, at)):
            window = source.at(at + 1, min(READ_BYTES, size - at - 1))
            hit = window.find(MAGIC)
            at += 1 + (hit if hit >= 0 else max(1, len(window) - 2) if len(window) > 2 else size)
            continue
        found = _member(source, at)
        header = found and _header(found[0])
        if not header:
            at += 1
            continue
        body = found[0].find(b"\r\n\r\n") + 4
        yield at, header, found[0][body:body + int(header["content-length"])]
        at = found[1]


def _bare(value: str | None) -> str | None:
    return value and value.strip("<>")


def read_warc(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files in ``manifest`` (path, bytes), one row each; of
    a revisit ``payload`` is null, its length and digest are the full payload's.
    If the manifest has ``begin`` and ranges are multiples of ``RANGE_BYTES``, a
    range with another number of records than written is an error."""
    told, rest = divmod(range_bytes, RANGE_BYTES)
    known = "begin" in manifest.columns and not rest
    due = F.expr(f"aggregate(slice(begin, int(start div {RANGE_BYTES}) + 1, {told}), 0L, (a, x) -> a + x)") if known else F.lit(None).cast("long")
    ranges = (manifest.select("*", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start"))
              .select("path", "bytes", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"), due.alias("due")))
    # by number: the rows are small, what they stand for is not
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0]
    dealt = ranges.repartition(max(1, int(tasks or 0)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end, due in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held, n = [], 0, 0
                for at, head, block in _records(path, size, start, end):
                    n += 1
                    cut = block.find(b"\r\n\r\n") + 4
                    http, payload = block[:cut], block[cut:]
                    kind = head["warc-type"]
                    if kind == "revisit":
                        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                        row = (None, int(length[1]) if length else None, (_bare(head.get("warc-payload-digest")) or "").rpartition(":")[2])
                    else:
                        row = (payload, len(payload), hashlib.sha256(payload).hexdigest())
                    rows.append((_bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"),
                                 _bare(head.get("warc-refers-to")), *row, path, at))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if due is not None and n != due:
                    raise ValueError(f"{path}: {n} records begin in bytes {start} to {end}, {due} were written")
                if rows:
                    yield _rows(rows)

    return dealt.mapInArrow(run, READ_SCHEMA)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` to a fresh shared folder and reads the archives back."""
    spark = pages.sparkSession
    manifest = write_warc(pages, scratch_path(spark, "warc"), id_col, url_col, payload_col)
    return read_warc(spark, manifest)
