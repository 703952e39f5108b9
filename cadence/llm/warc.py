"""WARC archives as a chunked record table: one row for each chunk of a payload, written and read as streams."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.shared import fresh_path, joinable, keep, partitions, returning_memory

CHUNK = 1 << 20
#: Payloads below this size are stored again rather than referred to.
LEAST_REVISIT = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, declared_bytes long, declared_digest string, chunk_no int, last boolean, data binary, bytes_so_far long, sha256_so_far string"


def record_chunks(pages: DataFrame, id_col: str, url_col: str, payload: Column, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows to write: of equal payloads of LEAST_REVISIT bytes or more the least id is the response, others revisit it.

    A null payload counts as empty; a row without id is a response; rows that
    repeat the least id are responses as well.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    heads = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail").drop("tail")
    rows = rows.join(joinable(keep(heads, "heads"), 200_000), "digest", "left")  # narrow, so that payloads seldom move for it
    revisit = F.coalesce((F.col("payload_bytes") >= LEAST_REVISIT) & (F.col("id") != F.col("head")), F.lit(False))
    rows = rows.select("id", "target_uri", "digest", "payload_bytes", F.when(revisit, F.col("head")).alias("head"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    pieces = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    rows = rows.withColumn("pieces", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("chunk_no"))
    return rows.select("id", "target_uri", "digest", "payload_bytes", "head", "chunk_no", (F.col("chunk_no") == F.col("pieces") - 1).alias("last"), F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("data"))


def _name(value: object) -> str:
    return f"<urn:record:{quote(str(value), safe='')}>" if value is not None else "<urn:no-record>"


def _named(field: str | None) -> str | None:
    """The id that _name() wrote; names of other makers stay as they are."""
    if field is None or field == "<urn:no-record>":
        return None
    return unquote(field[len("<urn:record:") : -1]) if field.startswith("<urn:record:") and field.endswith(">") else field


def _header(row: dict, date: str) -> bytes:
    kind = "response" if row["head"] is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(row['id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(row['target_uri'] or '', safe='!#$%&()*+,/:;=?@[]~')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(_HTTP) + (row['payload_bytes'] if kind == 'response' else 0)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(row['head'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + _HTTP


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes the chunk rows, one archive for each partition and one gzip member for each record; gives (path, records) of the archives.

    Rows of a record follow each other in their partition. An archive's name
    holds the task's attempt, and only those of attempts that ended well are
    among the rows, so that a lost executor leaves no half archive to readers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        out = path = packer = None
        records = 0
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("id", "target_uri", "digest", "payload_bytes", "head", "chunk_no", "last")}
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                if row["chunk_no"] == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_header(row, date)))
                    records += 1
                out.write(packer.compress(batch.column("data")[i].as_buffer()))
                if row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([records], pa.int64())})

    return chunks.mapInArrow(returning_memory(run), "path string, records long")


class _Members:
    """The bytes of a file of gzip members (or of plain bytes), a bounded piece at a time."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece, self.held, self.unpacker, self.rest, self.plain = stream, piece, b"", None, b"", None

    def more(self) -> bool:
        raw = self.rest or self.stream.read(self.piece)
        self.rest = b""
        if self.plain is None and raw:
            self.plain = raw[:2] != b"\x1f\x8b"
        if not raw:
            return False
        if self.plain:
            self.held += raw
            return True
        self.unpacker = self.unpacker or zlib.decompressobj(31)
        self.held += self.unpacker.decompress(raw, self.piece)
        if self.unpacker.eof:
            self.rest, self.unpacker = self.unpacker.unused_data, None
        else:
            self.rest = self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, which is passed over; empty at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                self.held = b""
                return b""
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        found, self.held = self.held[:n], self.held[n:]
        return found


def _records(stream, chunk: int, with_data: bool) -> Iterator[tuple]:
    source = _Members(stream, chunk)
    while head := source.until(b"\r\n\r\n"):
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        left = int(fields.get("content-length", 0))
        if fields.get("content-type", "").startswith("application/http") and left:
            left -= len(source.until(b"\r\n\r\n")) + 4
        declared = fields.get("x-payload-length")
        digest, total, no = hashlib.sha256(), 0, 0
        while True:
            data = source.take(min(chunk, left))
            left -= len(data)
            digest.update(data)
            total += len(data)
            last = left <= 0 or not data
            yield (
                _named(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), _named(fields.get("warc-refers-to")),
                int(declared) if declared else None, (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                no, last, data if with_data else None, total, digest.hexdigest(),
            )
            no += 1
            if last:
                break
        source.take(4)


def read_archives(archives: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows (CHUNK_SCHEMA) of the archives named in ``path``; archives may be gzipped by record or plain.

    Each row carries the bytes and the digest of its record's payload up to its
    end, so that the row with ``last`` set has those of the whole. No task holds
    more than a few chunks of a record.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha256_so_far", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for row in _records(stream, chunk, with_data):
                        rows.append(row)
                        held += len(row[8] or b"") + 200
                        if held > 8 * CHUNK:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return archives.select("path").mapInArrow(returning_memory(run), CHUNK_SCHEMA)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back, and gives one row for each record.

    page_id, payload_bytes, payload_digest, record_type and refers_to: size and
    digest are those counted while reading for responses, and those of the
    record's header for revisits. Other columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    archives = keep(write_archives(record_chunks(pages, id_col, url_col, F.col(payload_col)), folder), "archives")
    back = read_archives(archives.repartition(partitions(spark), "path"), with_data=False).where("last")
    kind = pages.schema[id_col].dataType
    revisit = F.col("record_type") == "revisit"
    return back.select(
        F.col("record_id").cast(kind).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
