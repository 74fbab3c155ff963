"""WARC archives: one gzip member a record, and a reader that splits archives by byte range.

Executors reach the archives through ``pyarrow.fs`` (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm.common import new_path

#: Bytes of an archive that one reading task owns.
SPLIT = 8 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 0
#: Repeated digests that may be broadcast.
BROADCAST_DIGESTS = 200_000
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20


def _member(page_id, url, payload: bytes, first, digest: str) -> bytes:
    """One record as a gzip member; ``first`` is the page that holds the payload, if another."""
    revisit = first is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> list[tuple[str, int]]:
    """Writes a record for each row ``page_id, url, html``; returns the archives' paths and sizes.

    Of equal payloads of at least ``revisit_bytes`` the row with the smallest page_id is the
    response and others revisit it (rows that repeat that page_id are responses too; a null
    page_id is never the smallest, and payloads that have no other are all responses).
    Each attempt of a task writes an archive of its own and only those of successful
    attempts are returned, so lost executors and repeated tasks do no harm.
    """
    df = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    df = df.withColumn("digest", F.sha1("payload"))
    again = df.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first").cache()
    few = again.count() <= BROADCAST_DIGESTS
    df = df.join(F.broadcast(again) if few else again, "digest", "left")
    revisits = (F.octet_length("payload") >= revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    df = df.select("page_id", "url", "payload", F.when(revisits, F.col("first")).alias("first"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, out, size = TaskContext.get(), None, 0
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            for page_id, url, payload, first, digest in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store, at = fs.FileSystem.from_uri(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                member = _member(page_id, url, payload, first, base64.b32encode(bytes.fromhex(digest)).decode())
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    got = [(r.path, r.size) for r in df.mapInArrow(run, "path string, size long").collect()]
    again.unpersist()
    return got


class Damaged(ValueError):
    """Bytes of an archive where a record should start, or one that starts but can't be decoded."""


def _inflate(read, at: int, whole: bool = True) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if no record starts there.

    Raises :class:`Damaged` if a record's header decodes but not the rest. Without ``whole``
    only the header's first bytes are decoded.
    """
    unpack, got, checked = zlib.decompressobj(31), [], False
    end = at
    while not unpack.eof:
        block = read(end, _BLOCK)
        try:
            if not block:
                raise zlib.error("the archive ends inside a member")
            got.append(unpack.decompress(block))
        except zlib.error as error:
            if checked:
                raise Damaged(f"the record at byte {at} can't be decoded: {error}") from error
            return None
        end += len(block)
        if not checked and sum(map(len, got)) >= 7:
            if not b"".join(got).startswith(b"WARC/1."):
                return None
            checked = True
            if not whole:
                return b"", end
    return (b"".join(got), end - len(unpack.unused_data)) if checked else None


def members(read, start: int, end: int, skip_damaged: bool = False) -> Iterator[bytes]:
    """Records that start in bytes start..end; ``read(at, n)`` gives up to n bytes.

    Looks for gzip magic, takes a candidate only if it decodes to a record's header, and
    from there on follows the members, as each ends where the next begins. An archive starts
    with a record, and after one another or the end must follow, in this range or the
    next; a damaged member thus raises :class:`Damaged` in one of them, or with
    ``skip_damaged`` the search goes on behind it.
    """
    at, due = start, start == 0
    while at < end:
        try:
            found = _inflate(read, at) if read(at, 3) == MAGIC else None
        except Damaged:
            if not skip_damaged:
                raise
            found = None
        if found:
            yield found[0]
            at, due = found[1], True
            continue
        if due and not skip_damaged:
            raise Damaged(f"no record starts at byte {at}")
        due = False
        window = read(at + 1, _BLOCK + 2)
        hit = window.find(MAGIC)
        if hit >= 0:
            at += 1 + hit
        elif len(window) < _BLOCK + 2:
            return
        else:
            at += 1 + _BLOCK
    if due and not skip_damaged and read(at, 1) and _inflate(read, at, whole=False) is None:
        raise Damaged(f"no record starts at byte {at}")


def parse(record: bytes) -> tuple:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name].rpartition(":")[2][:-1]) if name in fields else None
    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), url, None, int(fields["WARC-Payload-Length"]), digest, "revisit", number("WARC-Refers-To")
    payload = block.partition(b"\r\n\r\n")[2]
    if (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} has digest {own}, not {digest}")
    return number("WARC-Record-ID"), url, payload, len(payload), digest, "response", None


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], with_payload: bool = False, split: int = SPLIT, skip_damaged: bool = False) -> DataFrame:
    """Rows of :func:`parse` for each record of the archives (paths and sizes), in byte ranges.

    A record belongs to the range in which it starts, so each is read once whatever the
    ranges. ``payload`` is there ``with_payload`` and null for revisits. A damaged member
    fails the query, or with ``skip_damaged`` is left out.
    """
    ranges = [(path, at, min(at + split, size)) for path, size in archives for at in range(0, size, split)]
    df = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(max(1, len(ranges)))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    held: list = [0, b""]

                    def read(at: int, n: int) -> bytes:
                        off = at - held[0]
                        if not (0 <= off and off + min(n, _BLOCK) <= len(held[1])):
                            file.seek(at)
                            held[0], held[1], off = at, file.read(max(n, 2 * _BLOCK)), 0
                        return held[1][off : off + n]

                    rows, size = [], 0
                    for record in members(lambda at, n: read(at, min(n, 64 << 10) if n == _BLOCK else n), start, stop, skip_damaged):
                        row = parse(record)
                        rows.append(row if with_payload else (*row[:2], None, *row[3:]))
                        size += len(record)
                        if len(rows) >= 2000 or size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    found = df.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return found if with_payload else found.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads them back.

    Null html is an empty payload; null urls and page_ids stay null; long pages are stored
    whole; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_path(spark, "warc")))
