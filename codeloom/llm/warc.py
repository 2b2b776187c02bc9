"""WARC archives: writer, normaliser of monolithic gzip files, indexed reader.

write() makes archives as many crawlers leave them: one gzip stream around a
whole file of records. normalise() inflates each such file once, as a stream,
compresses every record as a gzip member of its own and writes a sidecar index
(one JSON line of offset, length, type and page for each record). read() takes
records by their index entries, each by inflating that member alone.

Of records whose payloads have the same SHA-256 and at least LEAST bytes, the
one with the smallest page_id is a response and the others are revisits of it;
shorter payloads are always responses.

Files go to a folder that driver and executors share, through pyarrow's file
systems (file, hdfs, s3, gs). A task names its files after its attempt; only the
names that the finished job returns count, so a task that is run again after a
lost executor leaves at most files that nobody reads. A writer holds one record
and starts a new file every FILE_BYTES.

Files cut short are errors: an unfinished gzip stream, or a number of records other
than the one that the writer or the normaliser counted. Ids may be any string.

Defined results: null html is an empty payload; a null url an empty target;
pages that share the smallest page_id and payload are all responses; a record
with a null page_id is a revisit if another page has its payload, and otherwise
a response; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_dir

LEAST, FILE_BYTES, BLOCK, LEVEL, FEW = 100, 128 << 20, 1 << 20, 4, 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("s3n://", "s3://"))


def record(page_id: str | None, url: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has no payload; its header keeps the digest and size of the full one."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if refers_to is None else http
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    urn = lambda page: f"<urn:page:{quote(page or '', safe='')}:{digest[:16]}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {quote(refers_to, safe='')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    for name in ("X-Page-ID", "X-Refers-To-Page"):  # any string, so percent-encoded; absent if null
        if name in fields:
            fields[name] = unquote(fields[name])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def inflate(source):
    """Blocks of bytes of a gzip file, whatever its members; a file that ends within one is an error."""
    z, open_ = zlib.decompressobj(31), False
    while data := source.read(BLOCK):
        while True:
            open_ = open_ or bool(data)
            if out := z.decompress(data, BLOCK):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, open_ = z.unused_data, zlib.decompressobj(31), False
            if not data and len(out) < BLOCK:
                break
    if open_:
        raise ValueError("truncated gzip stream")


def records(blocks):
    """Raw records from inflated blocks; holds one record and one block."""
    buffer = bytearray()
    for block in blocks:
        buffer += block
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(buffer[at:end])
            size = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
            if len(buffer) < end + 8 + size:
                break
            yield bytes(buffer[at : end + 8 + size])
            at = end + 8 + size
        del buffer[:at]
    if buffer:
        raise ValueError("truncated archive")


def _marked(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # ids and digests settle who refers to whom; payloads meet the answer by page, so a common page is no hot key
    small = rows.where(F.col("size") >= LEAST).select("page_id", F.unhex("digest").alias("d"))
    first = small.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = cut(small.join(first, "d").where(~F.col("first").eqNullSafe(F.col("page_id"))).distinct())
    revisits = revisits.select(F.col("page_id").alias("r_page"), F.lower(F.hex("d")).alias("r_digest"), F.col("first").alias("refers_to"))
    if revisits.count() <= FEW:  # 100 bytes each; beyond that the join shuffles by page and digest
        revisits = F.broadcast(revisits)
    out = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    return out.select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "size", "digest", F.col("refers_to").cast("string").alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Monolithic archives below `folder`; (path, n_records) of each."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(f"{root}/raw", recursive=True)
        task, seq, out, n, size, z = TaskContext.get(), 0, None, 0, 0, None
        done: list[tuple[str, int]] = []

        def close():
            out.write(z.flush())
            out.close()
            done.append((path, n))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                page, url, payload, full, digest, refers = row
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        close()
                    path = f"{root}/raw/{task.partitionId():06d}-{task.taskAttemptId()}-{seq}.warc.gz"
                    out, z, n, size, seq = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, seq + 1
                raw = record(page, url, payload, full, digest, refers)
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return cut(_marked(pages, id_col, url_col, html_col).mapInArrow(run, "path string, n_records bigint"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """One gzip member a record, and a sidecar index; (path, index, n_records) of each file."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = file_system(folder)
        fs.create_dir(f"{root}/records", recursive=True)
        attempt, rows = TaskContext.get().taskAttemptId(), []
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"{root}/records/{path.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}"
                at = n = 0
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as idx:
                    for raw in records(inflate(source)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        fields = parse(raw)[0]
                        idx.write((json.dumps([at, len(member), fields["WARC-Type"], fields.get("X-Page-ID")]) + "\n").encode())
                        at, n = at + len(member), n + 1
                if expected is not None and n != expected:
                    raise ValueError(f"{path} holds {n} records, not {expected}")
                rows.append((f"{name}.warc.gz", f"{name}.idx", n))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["path", "index", "n_records"])

    known = F.col("n_records") if "n_records" in archives.columns else F.lit(None).cast("long")
    return cut(archives.select("path", known.alias("n")).mapInArrow(run, "path string, index string, n_records bigint"))


def fetch(path: str, offset: int, length: int, fs=None) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of the record at an index entry."""
    if fs is None:
        fs, path = file_system(path)
    with fs.open_input_file(path) as f:
        return parse(zlib.decompress(f.read_at(length, offset), 31))


def read(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of normalised archives, by their index; digests of payloads are verified."""
    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload

    def run(batches):
        fs, _ = file_system(folder)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

        for b in batches:
            for path, index, expected in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows, held, n = [], 0, 0
                with fs.open_input_file(path) as f, fs.open_input_stream(index, compression=None) as entries:
                    for line in _lines(entries):
                        offset, length, kind, page = json.loads(line)
                        fields, payload = parse(zlib.decompress(f.read_at(length, offset), 31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] != kind or fields.get("X-Page-ID") != page or kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} is damaged at {offset}")
                        n += 1
                        rows.append((page, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, fields.get("X-Refers-To-Page"), payload))
                        held += len(payload) if with_payload else 100
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{index} lists {n} records, not {expected}")
                yield batch(rows)

    return archives.select("path", "index", "n_records").mapInArrow(run, schema)


def _lines(stream):
    rest = b""
    while data := stream.read(BLOCK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", **columns) -> DataFrame:
    """pages through write(), normalise() and read()."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    out = read(normalise(write(pages, folder, id_col, **columns), folder), folder)
    kind = pages.schema[id_col].dataType
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY 1),
r AS (SELECT p.*, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
