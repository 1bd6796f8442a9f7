"""WARC archives: index first, then coalesced byte-range reads of the selected records.

Writing: payload digests and lengths are computed without moving payloads; of the records with equal
payloads of at least ``least`` bytes the one with the largest page_id is the response and the others are
revisits that carry headers only. Each task then writes one archive of gzip members to shared storage
(through the file system of ``folder``'s scheme) and returns an index row per record: file, offset,
length, url, digest, type. Only the index of finished tasks counts, so the files of a lost or repeated
task are never read. Reading: index rows are sorted by file and offset in even ranges; neighbours are
fetched in one read of bounded size and each member is unpacked and parsed alone.

Defined cases: null html is an empty payload; a null url has no target header; of repeated rows with the
largest page_id each is a response; a null page_id revisits the largest id of its payload, or is a
response if there is none; extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.storage import materialize, scratch_path

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes of archives that one task reads, about (the index is small, so its own size tells nothing), and tasks at most: from
#: 160 GB of archives on a task reads more.
TASK_BYTES, TASKS = 8 << 20, 20_000
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if not name or name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record (plain bytes): a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers by lower-case name, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:/") else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the index (a table)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    first = own.select("page_id", "sha", "size").groupBy("sha", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    repeated = materialize(first.where((F.col("copies") > 1) & (F.col("size") >= least)).select(F.col("sha").alias("rsha"), "response_id"), "payloads")
    joined = own.join(repeated, F.col("sha") == F.col("rsha"), "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    rows = joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha", "size", F.when(revisit, F.col("response_id")).alias("refers_to"))

    def run(batches):
        store, place = _filesystem(folder)
        store.create_dir(place, recursive=True)
        path, offset = f"{place}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(path, compression=None) as out:
            out.write(head := pack(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))
            offset += len(head)
            for batch in batches:
                index = []
                for page_id, url, html, sha, size, refers_to in zip(*(c for c in batch.columns), strict=True):
                    page_id, url, html, refers_to = page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    data = pack(record(page_id, url, None if html is None else html.encode(), size.as_py(), digest, refers_to))
                    out.write(data)
                    index.append((path, offset, len(data), page_id, url, digest, "revisit" if html is None else "response"))
                    offset += len(data)
                if index:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])

    index = materialize(rows.mapInArrow(run, INDEX), "warc-index")
    index.folder = folder
    return index


def ranges(rows: list[tuple[str, int, int]], gap: int = 1 << 16, most: int = 8 << 20):
    """Sorted (file, offset, length) rows coalesced: yields (file, start, end, rows inside)."""
    held: list = []
    for file, offset, length in rows:
        if held and (file != held[0][0] or offset > held[-1][1] + held[-1][2] + gap or offset + length - held[0][1] > most):
            yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held
            held = []
        held.append((file, offset, length))
    if held:
        yield held[0][0], held[0][1], held[-1][1] + held[-1][2], held


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` rows select, read back from the archives (``with_payload``: also the bytes)."""
    names = [x.split(" ")[0] for x in (READ + (", payload binary" if with_payload else "")).split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
    total = index.agg(F.sum("length")).first()[0] or 0
    ordered = index.select("file", "offset", "length").repartitionByRange(min(TASKS, max(1, -(-total // TASK_BYTES))), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        store, _ = _filesystem(folder)
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for file, start, end, held in ranges(wanted):
                with store.open_input_file(file) as source:
                    data = source.read_at(end - start, start)
                out = []
                for _, offset, length in held:
                    fields, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    whole = fields["warc-type"] == "response"
                    if whole and size != len(payload):
                        raise ValueError(f"{file} at {offset}: {len(payload)} of {size} bytes")
                    digest = digest32(payload) if whole else fields["warc-payload-digest"].removeprefix("sha1:")
                    out.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), payload)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, READ + (", payload binary" if with_payload else ""))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives and reads every record back."""
    index = write_archives(pages)
    return read_records(index, index.folder).drop("url")


def oracle() -> str:
    """DuckDB has no base32, so the digest's 160 bits are regrouped by fives (``pages`` in, one row each)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(sha, i, 1)) - 1) * 4 + 1, 4)), '')"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT *, {bits} AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda g: substr('{letters}', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, g * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top OR top IS NULL THEN NULL ELSE top END AS refers_to
FROM b"""
