"""WARC archives through a table of chunked records.

A payload is never handled as one value after it is read.  ``chunk_records`` turns each record into
rows ``(record id, chunk number, at most chunk_bytes of data)`` that carry the SHA-1 and the length of
the payload up to and including the chunk: the last row of a record has the payload's digest.  Chunks
of a record are sorted together and streamed into gzip members of a WARC file; reading streams the
members back into the same kind of rows.  Writer and reader hold one chunk at a time.

Of the records with equal payloads (digest and length) of at least ``least_bytes``, the one with the
largest id is a ``response``; the others are ``revisit`` records that refer to it and carry no
payload.  That choice is a partial aggregation by digest, so a group of copies costs one row for each task,
and its result meets the chunks in a join by record id, which no hot payload can skew.

A file is written under its attempt's name and renamed when complete, so a task that is run again
replaces it by an equal one.

Results for odd inputs: a null payload is an empty one; empty payloads are equal to each other; a null
url becomes ``about:blank`` and control characters in one are percent-encoded; rows that repeat an
id with the same payload are one response and revisits of it, rows that repeat an id with other
payloads are records of their own; a null id is written as such and ranks below all others; an
empty table gives no file.  Only the id, url and payload columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.llm.common import materialize, partitions_for, scratch_path
from textcohort.llm.token_files import file_system

CHUNK_BYTES = 64 << 10
NO_ID = -(2 ** 63)
LEVEL = 1
# Record fields of WARC 1.1 and the profile of a revisit by an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_CHUNK = "record_id long, url string, row_tag long, chunk_no int, data binary, sha1 binary, bytes long, payload_sha1 binary, payload_bytes long"
_CHUNK_NAMES = [field.split()[0] for field in _CHUNK.split(", ")]
_CHUNK_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[field.split()[1]] for field in _CHUNK.split(", ")]
#: The chunk number of the row that carries a record's decision and comes before its chunks.
_DECISION = -1


def chunk_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the payloads (UTF-8 of a text column, or a binary column).

    ``sha1`` and ``bytes`` are those of the payload up to and including the chunk, ``payload_sha1`` and
    ``payload_bytes`` those of the whole.  ``row_tag`` tells rows that repeat an id apart within one
    run.  Without data only each record's last chunk is returned."""
    source = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("record_id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, urls, payloads = batch.column("record_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload")
            rows, held = [], 0
            for i, (record_id, url) in enumerate(zip(ids, urls, strict=True)):
                tag += 1
                view = memoryview(payloads[i].as_buffer())
                running, states = hashlib.sha1(usedforsecurity=False), []
                for at in range(0, max(1, len(view)), chunk_bytes):
                    running.update(view[at:at + chunk_bytes])
                    states.append(running.digest())
                for k, state in enumerate(states):
                    if with_data or k == len(states) - 1:
                        part = bytes(view[k * chunk_bytes:(k + 1) * chunk_bytes]) if with_data else None
                        rows.append((record_id, url if k == 0 else None, tag, k, part, state, min(len(view), (k + 1) * chunk_bytes), states[-1], len(view)))
                        held += len(part or b"")
                    if held >= 4 << 20 or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)

    return source.mapInArrow(run, _CHUNK)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)


def decisions(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(record_id, payload_sha1, payload_bytes, keep)`` for each distinct record: ``keep`` is the id of
    the response that stands for its payload, null for a payload that is too small to share."""
    payload = ["payload_sha1", "payload_bytes"]
    records = digests.select("record_id", *payload).distinct()
    keep = records.filter(F.col("payload_bytes") >= least_bytes).groupBy(*payload).agg(F.max("record_id").alias("keep"))
    # narrow rows; a payload that many records share is split by AQE's skew join
    return records.join(keep, payload, "left")


def _urn(record_id: int, sha1: bytes, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{record_id}:{sha1.hex()}:{copy}')}>"


def _clean_url(url: str | None) -> str:
    if not url:
        return "about:blank"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


class MemberWriter:
    """One gzip member for each record, as the format asks."""

    def __init__(self, out):
        self.out = out
        self.gz = None

    def record(self, head: bytes) -> None:
        self.gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.write(head)

    def write(self, data: bytes) -> None:
        if packed := self.gz.compress(data):
            self.out.write(packed)

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self.out.write(self.gz.flush())


def write_warc(pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, files: int | None = None) -> DataFrame:
    """Write the records to ``out_dir`` (a folder that all executors share; by default one in the
    checkpoint folder) and return the written table of files ``(file, path, n_records)``."""
    spark = pages.sparkSession
    out_dir = (out_dir or scratch_path(spark, "warc")).rstrip("/")
    n = files or partitions_for(spark)
    record = ["record_id", "payload_sha1", "payload_bytes"]
    chosen = decisions(chunk_records(pages, id_col, url_col, payload_col, chunk_bytes, with_data=False), least_bytes)
    chosen = chosen.select(*record, F.lit(-1).cast("long").alias("row_tag"), F.lit(_DECISION).alias("chunk_no"), "keep",
                           F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("data"))
    chunks = chunk_records(pages, id_col, url_col, payload_col, chunk_bytes)
    # one exchange brings a record's decision and chunks together; the sort puts the decision first,
    # then each copy's chunks in order
    merged = (chunks.withColumn("keep", F.lit(None).cast("long")).select(*chosen.columns).unionByName(chosen)
              .repartition(n, *record).sortWithinPartitions(*record, "row_tag", "chunk_no"))
    columns = merged.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{out_dir}/part-{context.partitionId():06d}.warc.gz"
        out, records, keep, copy, left = None, 0, None, 0, 0
        for record_id, sha1, size, _, no, chosen_keep, url, data in (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True)):
            if out is None:
                fs, target = file_system(name)
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                attempt = f"{target}.{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.part"
                out = MemberWriter(fs.open_output_stream(attempt, compression=None))
                out.record(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"),
                                    ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]))
                out.end()
            if no == _DECISION:
                keep, copy = chosen_keep, 0
                continue
            if no == 0:
                response = keep is None or keep == record_id and not copy
                head = _http_head(size)
                fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", _urn(record_id, sha1, copy)), ("WARC-Date", DATE),
                          ("WARC-Target-URI", _clean_url(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("X-Page-ID", str(record_id))]
                if not response:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(keep, sha1, 0)), ("X-Refers-To-Page-ID", str(keep))]
                left = size if response else 0
                fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + left))]
                out.record(_header(fields) + head)
                records, copy = records + 1, copy + 1
                if not left:
                    out.end()
            if left:
                out.write(data)
                left -= len(data)
                if not left:
                    out.end()
        if out is not None:
            out.out.close()
            fs.move(attempt, target)
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int64()), pa.array([name], pa.string()), pa.array([records], pa.int64())], ["file", "path", "n_records"])

    return materialize(merged.mapInArrow(write, "file long, path string, n_records long"), "warc-files")


class MemberReader:
    """Streams the gzip members of a file: bytes of one member at a time, ``step`` bytes read at once."""

    def __init__(self, file, step: int):
        self.file, self.step, self.held, self.gz = file, step, b"", None

    def next_member(self) -> bool:
        self.gz = zlib.decompressobj(31)
        self.held = self.held or self.file.read(self.step)
        self.text = b""
        return bool(self.held)

    def _fill(self, most: int) -> bool:
        """More of the member's bytes, at most ``most``; false at its end."""
        while not self.gz.eof:
            data = self.gz.decompress(self.gz.unconsumed_tail or self.held or self.file.read(self.step), most)
            self.held = self.gz.unused_data if self.gz.eof else b""
            if data:
                self.text += data
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.text:
            if not self._fill(4096):
                raise ValueError("a record ends within its header")
        head, _, self.text = self.text.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        while len(self.text) < n and self._fill(n - len(self.text)):
            pass
        data, self.text = self.text[:n], self.text[n:]
        return data

    def skip(self) -> None:
        self.text = b""
        while self._fill(self.step):
            self.text = b""


def read_warc(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives: ``page_id, record_type, refers_to, payload_bytes, declared_digest,
    chunk_no, data, sha1, bytes, last``.  ``sha1`` and ``bytes`` are of the payload as read so far, so the
    last chunk of a response has the digest of what the file really holds; a revisit has one row,
    without data, with its header's digest and length.  Without data only last chunks are returned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            fs, at = file_system(path)
            rows, held = [], 0
            with fs.open_input_stream(at, compression=None) as file:
                members = MemberReader(file, chunk_bytes)
                while members.next_member():
                    fields = dict(line.split(": ", 1) for line in members.until(b"\r\n\r\n").decode().split("\r\n")[1:])
                    kind = fields["WARC-Type"]
                    if kind in ("response", "revisit"):
                        head = members.until(b"\r\n\r\n")
                        left = int(fields["Content-Length"]) - len(head) - 4
                        size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
                        digest, done, no = hashlib.sha1(usedforsecurity=False), 0, 0
                        page, refers = int(fields["X-Page-ID"]), fields.get("X-Refers-To-Page-ID")
                        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        while True:
                            part = members.take(min(chunk_bytes, left - done))
                            if done + len(part) < left and not part:
                                raise ValueError(f"{path}: the payload of page {page} ends early")
                            digest.update(part)
                            done += len(part)
                            if with_data or done == left:
                                known = base64.b32encode(digest.digest()).decode() if kind == "response" else declared
                                rows.append((page if page != NO_ID else None, kind, refers and int(refers), size, declared, no,
                                             part if with_data and kind == "response" else None, known, done if kind == "response" else size, done == left))
                                held += len(part) * with_data
                            no += 1
                            if held >= 4 << 20 or len(rows) >= 5000:
                                yield _read_rows(rows)
                                rows, held = [], 0
                            if done == left:
                                break
                    members.skip()
            if rows:
                yield _read_rows(rows)

    # one row for each file, dealt out so that a task reads a few files
    spread = files.repartition(partitions_for(files.sparkSession), "file")
    return spread.select("path").mapInArrow(read, _READ)


_READ = ("page_id long, record_type string, refers_to long, payload_bytes long, declared_digest string, chunk_no int, data binary, "
         "sha1 string, bytes long, last boolean")


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    names = [field.split()[0] for field in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
