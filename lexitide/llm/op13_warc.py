"""WARC archives: writing, normalising monolithic gzip, and reading records by their offsets.

A monolithic archive is one gzip stream over all its records, so that a record can only be reached by inflating all before it. `normalised`
inflates each such file once, front to back, writes every record as a gzip member of its own and gives the sidecar index, offset and length
of each member; the same as a text file beside the archive. `read` then inflates single members. Files pass through in pieces of PIECE bytes, so a
task's memory doesn't depend on the size of a file or, but for `read`, of a record.

`roles` finds equal payloads by SHA-1: the record with the largest page_id is the response, the others become revisits of it without a payload, which keep
the HTTP header of the full payload and its digest. Digests that a thousandth of the rows share are broadcast, the others meet in a shuffle.

Files are named by chance and listed in a table that Spark commits, so the files of a lost or repeated attempt are in no list and no row is read twice. They
lie in a folder that all machines share, by a path that pyarrow's file systems open; pages themselves are read by Spark alone.

Null html is an empty payload. Empty payloads are equal to each other. Repeated rows of the largest page_id are all responses. Null page_ids are below
all others: their records have no Page-Id, and they are responses only where no equal payload has an id. Control characters and spaces of urls are percent-encoded;
a null url has no field. An empty table gives no archive and an empty result. Damaged archives, payloads that don't fit their digest and records without a length raise an
error; with strict=False the whole records before the damage are kept, and what the file has after them is in no index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import join_counted
from lexitide.runtime import Scratch, bound_batches, table

PIECE = 1 << 20
ROLL = 64 << 20  # payload bytes after which a task begins a new archive
RUN = 8 << 20  # bytes of neighbouring members that are read at once
DATE = "2000-01-01T00:00:00Z"

INDEX = "path string, offset long, length long, type string, record_id string, page_id long, uri string, digest string"
READ = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    """The same for a page wherever it is written; by chance where it has no id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id)) if page_id is not None else uuid.uuid4()}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(kind: str, record: str, length: int, fields: list[tuple[str, object]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", DATE), *fields, ("Content-Length", length)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n").encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit where refers_to is given: the HTTP header tells the payload's length either way."""
    uri = url if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("Page-Id", page_id), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-Id", refers_to)]
    block = http if revisit else http + payload
    return _head("revisit" if revisit else "response", record_id(page_id), len(block), fields) + block + b"\r\n\r\n"


class Member:
    """Appends gzip members to a stream and knows where they lie."""

    def __init__(self, out, level: int):
        self.out, self.level, self.at = out, level, 0
        self.begin()

    def begin(self) -> None:
        self.start, self.gz = self.at, zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.gz.compress(data))

    def end(self) -> tuple[int, int]:
        """(offset, length) of the member that ends here."""
        self._put(self.gz.flush())
        found = self.start, self.at - self.start
        self.begin()
        return found

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to of pages (page_id, url, html); refers_to is null for responses.

    Payloads of fewer than least bytes are all responses."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    size = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies"), F.max(F.octet_length("payload")).alias("bytes"))
    again = Scratch(pages.sparkSession, "warc").save(size.where(f"copies > 1 and bytes >= {int(least)}").drop("bytes"), "copies")
    out = join_counted(rows, again, "digest", "copies", rows.count())
    own = F.col("page_id").eqNullSafe(F.col("top"))
    return out.select("page_id", "url", "payload", "digest", F.when(~own, F.col("top")).alias("refers_to"))


def monolithic(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes rows of roles() as archives of one gzip stream each; gives (path, records)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.end()
            out.out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    path = f"{folder}/{name}"
                    out = Member(system.open_output_stream(f"{root}/{name}", compression=None), 1)
                    info = b"software: lexitide\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_head("warcinfo", record_id(None), len(info), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")]) + info + b"\r\n\r\n")
                out.write(page_record(page, url, payload, bytes.fromhex(digest), refers))
                n, size = n + 1, size + len(payload)
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(work, "path string, records long")


def fields_of(head: list[bytes]) -> dict[str, str]:
    """Field names in lower case; lines that begin with white space continue the one before."""
    out, name = {}, ""
    for line in head:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def rewritten(source, out: Member, strict: bool = True) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Copies the records of a gzip stream of any number of members; (offset, length, fields) of each as its own member."""
    stream = gzip.GzipFile(fileobj=source, mode="rb")
    try:
        while line := stream.readline(PIECE):
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            head = [line]
            while (line := stream.readline(PIECE)) not in (b"\r\n", b"\n"):
                if not line:
                    raise EOFError("the archive ends in a header")
                head.append(line)
            fields = fields_of(head[1:])
            left = int(fields["content-length"])
            out.write(b"".join(head) + b"\r\n")
            while left:
                data = stream.read(min(PIECE, left))
                if not data:
                    raise EOFError("the archive ends in a record")
                out.write(data)
                left -= len(data)
            out.write(b"\r\n\r\n")
            yield *out.end(), fields
    except (OSError, EOFError, ValueError, KeyError, zlib.error):
        if strict:
            raise


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def normalised(archives: DataFrame, folder: str, level: int = 6, strict: bool = True) -> DataFrame:
    """Rewrites archives (path) into folder, record by member; gives the sidecar index, see INDEX. A row for each record, in the order of the file.

    The text index beside each archive, path.idx, has offset, length, type, record id, page id, digest and uri, by tabs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for path in b.column("path").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                there, at = opened(path)
                with there.open_input_stream(at, compression=None, buffer_size=PIECE) as source, system.open_output_stream(f"{root}/{name}", compression=None) as target, system.open_output_stream(f"{root}/{name}.idx", compression=None) as side:
                    rows = []
                    for offset, length, f in rewritten(source, Member(target, level), strict):
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        row = (f"{folder}/{name}", offset, length, f.get("warc-type"), f.get("warc-record-id"), _number(f.get("page-id")), f.get("warc-target-uri"), digest)
                        side.write("\t".join("-" if x is None else str(x) for x in (*row[1:6], row[7], row[6])).encode() + b"\n")
                        rows.append(row)
                        if len(rows) == 1000:
                            yield _batch(rows, INDEX)
                            rows = []
                yield _batch(rows, INDEX)

    # one task for each archive, or for a few
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(work, INDEX)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields, HTTP fields and payload of a record's member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, fields_of(http.split(b"\r\n")[1:]), payload


def read(index: DataFrame, payload: bool = False) -> DataFrame:
    """READ of the responses and revisits of an index, by offset; with payload as a last column, null for revisits.

    Bytes and digest of a response are counted anew and held against the record's; a revisit's are those of its header."""

    def row(member: bytes) -> tuple:
        f, http, body = parsed(member)
        said = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "revisit":
            own, body = (int(http["content-length"]), said), None
        else:
            own = len(body), base32(hashlib.sha1(body).digest())
            if own[1] != said:
                raise ValueError(f"the payload of {f['warc-record-id']} has another digest")
        out = (_number(f.get("page-id")), f.get("warc-target-uri"), f["warc-type"], *own, _number(f.get("refers-to-page-id")))
        return (*out, body) if payload else out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for b in batches:
            rows, runs = [], []
            for p, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if runs and runs[-1][0] == p and runs[-1][2] == offset and offset + length - runs[-1][1] <= RUN:
                    runs[-1][2] += length
                    runs[-1][3].append(length)
                else:
                    runs.append([p, offset, offset + length, [length]])
            for p, start, end, lengths in runs:
                if p != path:
                    if file is not None:
                        file.close()
                    system, at = opened(p)
                    path, file = p, system.open_input_file(at)
                file.seek(start)
                data = file.read(end - start)
                at = 0
                for n in lengths:
                    rows.append(row(data[at : at + n]))
                    at += n
                if payload:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    schema = READ + (", payload binary" if payload else "")
    return index.where("type in ('response', 'revisit')").select("path", "offset", "length").mapInArrow(work, schema)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to monolithic archives, these normalised, and the index of the latter, saved. The archives live as long as the session's scratch folder."""
    spark = pages.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "warc")
    raw = scratch.save(monolithic(roles(pages, least), f"{scratch.base}/raw"), "archives")
    index = scratch.save(normalised(raw, f"{scratch.base}/members"), "index")
    scratch.delete("raw")
    return index


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(archived(table(spark, sf_dir, "pages"))).drop("uri")


SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
  g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN g USING (h)"""
