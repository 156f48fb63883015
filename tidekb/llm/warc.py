"""WARC archives: a writer with one gzip member per record and revisit records, and a sequential reader.

The reader decompresses incrementally, member by member, frames each record by its content length and verifies its
block and payload digests. It holds one record at a time. Archives lie in the shared checkpoint folder; tasks reach
them through pyarrow's file systems, never through a machine's own temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import query, shared_path, stored, table
from tidekb.session import ship_package

#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18


class WarcError(ValueError):
    """The archive breaks the format or a digest doesn't fit."""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder's name; ``file:/x`` and plain paths are files."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(kind: str, page: str, url: str, payload: bytes, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, uncompressed; ``size`` and ``digest`` are those of the full payload, which revisits leave out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)), ("Page-ID", page)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def members(stream) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn; each inner iterator must be read to its end."""
    rest = stream.read(CHUNK)
    while rest:
        inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)

        def pieces(inflate=inflate):
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    rest = stream.read(CHUNK)
                    if not rest:
                        raise WarcError("the archive ends within a member")
                data, rest = rest, b""
                try:
                    piece = inflate.decompress(data, CHUNK)
                    rest = inflate.unconsumed_tail or inflate.unused_data
                except zlib.error as e:
                    raise WarcError(f"broken member: {e}") from e
                if piece:
                    yield piece

        yield pieces()
        rest = rest or stream.read(CHUNK)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; framing and block digest are verified."""
    for pieces in members(stream):
        head = bytearray()
        for piece in pieces:
            head += piece
            if END in head:
                break
        top, sep, begun = bytes(head).partition(END)
        lines = top.split(b"\r\n")
        if not sep or not lines[0].startswith(b"WARC/1."):
            raise WarcError("a member doesn't begin with a record header")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
        length = int(fields["content-length"])
        got = bytearray(begun)
        for piece in pieces:
            got += piece
            if len(got) > length + len(END):
                break
        if bytes(got[length:]) != END:
            raise WarcError("the content length doesn't fit the record")
        block = bytes(got[:length])
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
            raise WarcError("block digest")
        yield fields, block


def http_payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """(length of the full payload, payload as stored); the payload digest of a response is verified."""
    head, _, payload = block.partition(END)
    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    if fields["warc-type"] == "response" and (len(payload) != size or fields["warc-payload-digest"] != f"sha1:{base32(hashlib.sha1(payload).digest())}"):
        raise WarcError("payload digest or length")
    return size, payload


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row and return the stored manifest (path, n_records, n_bytes).

    Of equal payloads (digest and length) of ``least`` bytes or more, the row with the largest key is the response and
    rows with other keys revisit it; rows that repeat a key and a payload are all what that key is. Null html is an
    empty payload, a null url a urn of the page, a null key the smallest. Archives begin anew past ``archive_bytes``. A task
    writes under a name of its own, and only what a finished task lists is in the manifest, so that retries do no harm.
    """
    spark = pages.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    thin = named.select("k", "sha", "size")
    groups = stored(thin.groupBy("sha", "size").agg(F.max("k").alias("stays"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("size") >= least)), "groups").drop("n")
    again = thin.join(groups, ["sha", "size"]).filter(~F.col("k").eqNullSafe(F.col("stays")) & F.col("stays").isNotNull()).select(F.col("k").alias("k2"), F.col("sha").alias("sha2"), F.col("stays").cast("string")).distinct()
    rows = named.join(stored(again, "revisits"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("sha") == F.col("sha2")), "left").select(F.col("k").cast("string").alias("k"), "url", "sha", "size", F.when(F.col("stays").isNull(), F.col("payload")).alias("payload"), "stays")
    folder = shared_path(spark, "warc")

    def write(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        out, path, done = None, "", []
        for b in batches:
            for k, u, sha, size, payload, stays in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out, n, written = f"{top}/{name}", fs.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                page = "" if k is None else k
                data = record("response" if stays is None else "revisit", page, u if u is not None else f"urn:page:{page}", payload or b"", size, base32(bytes.fromhex(sha)), stays, date)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                data = squeeze.compress(data) + squeeze.flush()
                out.write(data)
                n, written = n + 1, written + len(data)
                if written >= archive_bytes:
                    out.close()
                    done.append((path, n, written))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, written))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[-1]}" for p, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([w for _, _, w in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return stored(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in ``path``: page (text, null if empty), url, type, payload length and digest, page referred to, payload.

    Each archive is read by one task from front to end. A broken archive raises WarcError. Payloads of revisits are null.
    """
    spark = manifest.sparkSession
    ship_package(spark)
    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, block in records(stream):
                        size, payload = http_payload(fields, block)
                        revisit = fields["warc-type"] == "revisit"
                        rows.append((fields["page-id"] or None, fields["warc-target-uri"], fields["warc-type"], size, fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("refers-to-page-id"), None if revisit or not with_payload else payload))
                        held += 500 + len(payload) * with_payload
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS stays FROM p),
h AS (SELECT *, sha1(body) AS hex FROM g),
b AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda j: CASE WHEN ('0x' || substr(hex, (5 * i + j) // 4 + 1, 1))::INT & (8 >> ((5 * i + j) % 4)::INT) > 0 THEN 16 >> j::INT ELSE 0 END))) AS five FROM h)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> stays THEN stays END AS refers_to FROM b
"""


@query("op7_warc", SQL)
def op7_warc(spark, sf):
    back = read_archives(write_archives(table(spark, sf, "pages")), with_payload=False)
    return back.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
