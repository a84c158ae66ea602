"""WARC archives of pages, and a normaliser for archives that were gzipped as a whole.

`archive` writes plain whole-file gzip archives, one stream for each; `normalise` inflates each stream once, writes
every record as a gzip member of its own and a sidecar index of their offsets; `read` fetches records by that index.
Which records become revisits is decided between the two on digests alone, so payloads travel inside archives only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_path, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Payload bytes and records after which an archive is closed.
FILE_BYTES, FILE_RECORDS = 32 << 20, 20_000
LEVEL = 1
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def head(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % length]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    return head(fields, len(http) + len(payload)) + http + payload + b"\r\n\r\n"


def revisit(fields: dict[str, str], block: bytes, refers_to: int) -> bytes:
    """The record that stands for a response whose payload another record holds; the payload's length stays known."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kept = [("WARC-Type", "revisit"), *((k, fields.get(k)) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest")), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    return head(kept, len(http) + 4) + http + b"\r\n\r\n\r\n\r\n"


def inflated(source) -> Iterator[bytes]:  # noqa: ANN001
    """The bytes of a gzip file, member after member, or of a plain one."""
    first = source.read(CHUNK)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = source.read(CHUNK)
        return
    unzip = zlib.decompressobj(31)
    while first or unzip.unconsumed_tail:
        if out := unzip.decompress(first, CHUNK):
            yield out
        if unzip.eof:
            first, unzip = unzip.unused_data or source.read(CHUNK), zlib.decompressobj(31)
        else:
            first = unzip.unconsumed_tail or source.read(CHUNK)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, block, the record's own bytes) of a WARC stream, holding one record at a time."""
    held, more = bytearray(), iter(chunks)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (chunk := next(more, None)) is None:
                if held.strip():
                    raise ValueError("a WARC record is cut off")
                return
            held += chunk
        fields = dict(x.split(": ", 1) for x in held[:end].decode("utf-8").split("\r\n")[1:] if ": " in x)
        whole = end + 4 + int(fields["Content-Length"]) + 4
        while len(held) < whole:
            if (chunk := next(more, None)) is None:
                raise ValueError("a WARC record is cut off")
            held += chunk
        yield fields, bytes(held[end + 4 : whole - 4]), bytes(held[:whole])
        del held[:whole]


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as whole-file gzip archives into folder; (file, record, page_id, payload_bytes, payload_digest) of each record.

    A file takes a new name on each attempt and is listed by the attempt that ended well, so lost executors leave at
    most unlisted files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = zipped = name = None
        rows: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            out.write(zipped.flush())
            out.close()
            return pa.RecordBatch.from_pydict(dict(zip(("file", "record", "page_id", "payload_bytes", "payload_digest"), (pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))))))

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k) for k in range(3))):
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out, zipped = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload, page_id = html.as_py() or b"", page_id.as_py()
                digest = hashlib.sha256(payload).hexdigest()
                out.write(zipped.compress(response(page_id, url.as_py(), payload, digest)))
                rows.append((name, len(rows), page_id, len(payload), digest))
                size += len(payload)
                if size >= FILE_BYTES or len(rows) >= FILE_RECORDS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return written(rows.mapInArrow(run, "file string, record int, page_id long, payload_bytes long, payload_digest string"), "records")


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """index with refers_to: the smallest page_id of the records with an equal payload, null for that record itself,
    for payloads of fewer than `least` bytes and where no record of the payload has a page_id."""
    first = index.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("__digest"), "first")
    joined = index.join(first, F.col("payload_digest") == F.col("__digest"), "left")
    return joined.select(*index.columns, F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite archives of the folder source into target, a gzip member for each record; (file, records, bytes) of each.

    files: (file, revisits), where revisits is an array of structs (record, refers_to) of the records to write as
    revisits. Beside each archive lies <file>.idx with a JSON line (offset, length, type, id) for each record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), (to, top) = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target)
        to.create_dir(top, recursive=True)
        for batch in batches:
            for file, changed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers = {x["record"]: x["refers_to"] for x in changed or []}
                name, at, lines = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as source_file, to.open_output_stream(f"{top}/{name}", compression=None) as out:
                    for k, (fields, block, raw) in enumerate(records(inflated(source_file))):
                        if k in refers:
                            raw = revisit(fields, block, refers[k])
                        zipped = zlib.compressobj(LEVEL, wbits=31)
                        member = zipped.compress(raw) + zipped.flush()
                        out.write(member)
                        lines.append(json.dumps({"offset": at, "length": len(member), "type": "revisit" if k in refers else fields.get("WARC-Type"), "id": fields.get("WARC-Record-ID")}))
                        at += len(member)
                with to.open_output_stream(f"{top}/{name}.idx", compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(lines)], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return written(files.select("file", "revisits").mapInArrow(run, "file string, records long, bytes long"), "archives")


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of the files in folder, each fetched by its place in the sidecar index:
    (page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest). A response's length and digest come
    from its payload, a revisit's from its header, and its payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{file}.idx") as index:
                    places = [json.loads(x) for x in index.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(f"{base}/{file}") as source:
                    for place in places:
                        source.seek(place["offset"])
                        fields, block, _ = next(records(iter([zlib.decompress(source.read(place["length"]), 31)])))
                        payload = block.partition(b"\r\n\r\n")[2]
                        back = fields["WARC-Type"] == "revisit"
                        rows.append((page_of(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), None if back else payload, int(fields["Payload-Length"]) if back else len(payload), fields["WARC-Payload-Digest"].removeprefix("sha256:") if back else hashlib.sha256(payload).hexdigest()))
                        size += len(payload)
                        if size >= CHUNK * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return files.select("file").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def spread(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files in partitions of their own as far as the shuffle partitions go."""
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file"))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive pages, normalise the archives with revisits for repeated payloads, and read them back: a row for each page.

    A null html is an empty payload. All rows that hold the smallest page_id of a payload are responses, rows with a
    null page_id revisit it. Repeated rows stay; a page without a url has no target; other columns are ignored; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    raw, fine = new_path(spark, "warc-whole"), new_path(spark, "warc")
    index = revisits(archive(pages, raw), least)
    change = F.when(F.col("refers_to").isNotNull(), F.struct("record", "refers_to"))
    files = index.groupBy("file").agg(F.collect_list(change).alias("revisits"))  # at most FILE_RECORDS for each file
    return read(spread(spark, normalise(spread(spark, files), raw, fine)), fine)


def page_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archive."""
    return round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
