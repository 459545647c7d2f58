"""WARC 1.1 archives: gzip-per-record writing by tasks, and a sequential, verifying reader.

Archives lie in a shared folder. A task writes its own file under a name no
other attempt uses and reports it in the manifest that Spark commits, so a task
that is lost and run again leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelane.llm.common import fresh_path, tuned

#: Bytes of a file before the task goes on with another one.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def hex_sha1(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def one_line(value: str) -> str:
    """A header value: control characters percent-encoded, so that no value ends its line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def records(stream, chunk: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-per-record file, in order.

    Reads the stream once and inflates it step by step; holds one record. A
    truncated member, a block shorter or longer than Content-Length and a wrong
    block digest are errors.
    """
    rest = b""
    while True:
        z, plain = zlib.decompressobj(31), bytearray()
        if not rest and not (rest := stream.read(chunk)):
            return
        while not z.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            plain += z.decompress(rest)
            rest = z.unused_data
        head, sep, body = bytes(plain).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not sep or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        length = int(headers["content-length"])
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise ValueError(f"{headers['warc-record-id']}: the block has not its Content-Length")
        block = body[:length]
        if (digest := headers.get("warc-block-digest")) and digest != base32_sha1(hashlib.sha1(block).hexdigest()):
            raise ValueError(f"{headers['warc-record-id']}: wrong block digest")
        yield headers, block


def plan_records(df: DataFrame, id_col: str, payload: str, min_bytes: int) -> DataFrame:
    """Adds payload (binary), payload_bytes, payload_digest and refers_to (null for responses).

    Only ids and digests are grouped, with partial aggregation; of equal
    payloads the largest id answers. Payloads move once, by their id. A page is
    an id with a payload: rows that repeat an id with other payloads are pages
    of their own, and rows that repeat the answering id and payload all answer.
    """
    rows = df.withColumn("payload", F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    keys = rows.where(F.col("payload_bytes") >= min_bytes).select(id_col, "payload_digest", "payload_bytes")
    groups = keys.groupBy("payload_digest", "payload_bytes").agg(F.max(id_col).alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    page = [id_col, "payload_digest", "payload_bytes"]
    revisits = keys.distinct().join(groups, page[1:]).where(F.col(id_col) != F.col("refers_to")).select(*page, "refers_to")
    return rows.join(revisits, page, "left")


def write_warc(df: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Writes a record per row into directory; returns the manifest (path, n_records, n_bytes), committed.

    Equal payloads of at least min_bytes bytes become one response (largest id)
    and revisits to it. Records are named by id and payload digest. Null payloads
    are empty, null urls get an urn, a null id is its own record without
    revisits; repeated ids as in plan_records. Other columns are not read.
    """
    spark = tuned(df.sparkSession)
    df = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = plan_records(df, "page_id", "html", min_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    base = directory if "://" in directory else f"file://{directory}"

    def write(batches):
        files, at = fs.FileSystem.from_uri(base)
        files.create_dir(at, recursive=True)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page, url, payload, length, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                uri = one_line(url) if url else f"urn:page:{page}"
                block = payload if refers is None else b""
                headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}:{digest}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
                headers += [("WARC-Payload-Digest", base32_sha1(digest)), ("WARC-Block-Digest", base32_sha1(hashlib.sha1(block).hexdigest())), ("X-Payload-Length", str(length)), ("Content-Type", "text/html")]
                if refers is not None:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>")]
                data = member(headers, block)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    manifest = f"{directory}-manifest"
    rows.mapInArrow(write, "path string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.schema("path string, n_records long, n_bytes long").parquet(manifest)


def read_warc(paths: DataFrame, filesystem_uri: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives named in column `path`, one task to a share of the files.

    Payload digests of responses are verified; revisits carry the digest and
    length of what they refer to. with_payload=False leaves payload null.
    """
    base = filesystem_uri if "://" in filesystem_uri else f"file://{filesystem_uri}"
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(batches):
        files, _ = fs.FileSystem.from_uri(base)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    for h, block in records(stream):
                        digest, length = hex_sha1(h["warc-payload-digest"]), int(h.get("x-payload-length", len(block)))
                        if h["warc-type"] == "response" and (length != len(block) or digest != hashlib.sha1(block).hexdigest()):
                            raise ValueError(f"{h['warc-record-id']}: wrong payload digest")
                        rows.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h.get("warc-refers-to"), length, digest, block if with_payload and h["warc-type"] == "response" else None))
                        held += len(block) * with_payload + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=schema)

    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
    spread = paths.select("path").repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(read, RECORD_SCHEMA)


def warc_round_trip(df: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes all rows as archives and describes each page from what is read back."""
    spark: SparkSession = df.sparkSession
    directory = fresh_path(spark, "warc")
    manifest = write_warc(df, directory, id_col)
    read = read_warc(manifest, directory, with_payload=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):[0-9a-f]{40}>$", 1).try_cast("long")
    return read.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
