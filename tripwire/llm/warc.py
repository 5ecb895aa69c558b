"""WARC archives and the monolithic gzip normaliser (operator 9).

``write_archives`` writes one archive per partition as a single gzip stream, as
many crawlers do; such a file cannot be read from the middle.  ``normalise``
inflates each stream once, rewrites every record as a gzip member of its own
and writes a sidecar index (a JSON line per record: offset, length, type, ids).
``read_archives`` reads single members at the offsets of the sidecar.

Files go to the folder that all executors share (any file system that
``pyarrow.fs`` opens).  A task writes under a name of its own attempt, and only
the attempts that Spark committed are in the manifest tables, so lost executors
and repeated attempts leave at most unused files.  An archive is copied block by
block; the writer and the reader hold one record at a time.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes the one with
the largest page id is the response and the others are revisits of it.

Defined results: null html is an empty payload; a null page id counts as the
smallest and stays null; of repeated rows with the largest id all are
responses; a null url writes no target header; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table

LEAST_BYTES = 1000
BLOCK = 1 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and drops the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = rows.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest") \
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1 and keeper is not null").select(F.col("digest").alias("same"), "keeper")
    old = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")))
    return rows.join(kept, F.col("digest") == F.col("same"), "left") \
        .select("page_id", "url", "payload", "digest", F.when(old, F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, records) of one monolithic gzip archive per partition."""

    def write(batches):
        out = pack = path = None
        n = 0
        for pdf in batches:
            for pid, url, payload, digest, ref in zip(pdf["page_id"], pdf["url"], pdf["payload"],
                                                      pdf["digest"], pdf["refers_to"]):
                if out is None:
                    ctx = TaskContext.get()
                    path = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
                    fs, inner = _fs(path)
                    fs.create_dir(posixpath.dirname(inner), recursive=True)
                    out, pack = fs.open_output_stream(inner, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(pack.compress(_record(pid, url, payload, digest, ref)))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    # ids as text, since pandas would turn a nullable long into a float
    return rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}) \
        .mapInPandas(write, "path string, records long")


class _Inflated:
    """The plain bytes of a gzip file of one or many members, block by block."""

    def __init__(self, stream):
        self.stream, self.data, self.unpack, self.ended = stream, bytearray(), zlib.decompressobj(31), False
        self.rest = b""

    def fill(self) -> bool:
        while not self.ended:
            raw = self.rest or self.stream.read(BLOCK)
            self.rest = b""
            if not raw:
                self.ended = True
                if not self.unpack.eof:
                    raise ValueError("the gzip stream ends within a member")
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(raw, BLOCK)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if self.unpack.eof and not self.rest:
                self.rest = b""
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self.fill():
                if self.data.strip():
                    raise ValueError("the archive ends within a header")
                return None
        got = bytes(self.data[:at + len(mark)])
        del self.data[:at + len(mark)]
        return got

    def take(self, n: int):
        while n:
            if not self.data and not self.fill():
                raise ValueError("the archive ends within a record")
            part = bytes(self.data[:n])
            del self.data[:n]
            n -= len(part)
            yield part


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, index, records) of archives with a member per record."""

    def rewrite(batches):
        for pdf in batches:
            for path in pdf["path"]:
                name = f"{folder}/{posixpath.basename(path).removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}"
                fs, inner = _fs(path)
                to, target = _fs(f"{name}.warc.gz")
                to.create_dir(posixpath.dirname(target), recursive=True)
                n = offset = 0
                with fs.open_input_stream(inner, compression=None) as raw, \
                        to.open_output_stream(target, compression=None) as out, \
                        to.open_output_stream(f"{target}.idx", compression=None) as index:
                    plain = _Inflated(raw)
                    while (head := plain.until(b"\r\n\r\n")) is not None:
                        head = head.lstrip(b"\r\n")
                        h = _headers(head)
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        size = out.write(pack.compress(head)) or 0
                        for part in plain.take(int(h["content-length"]) + 4):
                            size += out.write(pack.compress(part)) or 0
                        out.write(pack.flush())
                        end = out.tell()
                        index.write((json.dumps({"offset": offset, "length": end - offset, "type": h["warc-type"],
                                                 "id": h["warc-record-id"], "uri": h.get("warc-target-uri"),
                                                 "digest": h.get("warc-payload-digest")}) + "\n").encode())
                        offset, n = end, n + 1
                yield pd.DataFrame({"path": [f"{name}.warc.gz"], "index": [f"{name}.warc.gz.idx"], "records": [n]})

    return manifest.mapInPandas(rewrite, "path string, index string, records long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record, each read as a single member at its offset.

    The digest of a response is computed from its payload and held against the
    header; a revisit has no payload, its size is in the HTTP header it keeps.
    """

    def read(batches):
        for pdf in batches:
            for path, index in zip(pdf["path"], pdf["index"]):
                fs, inner = _fs(path)
                rows = []
                with fs.open_input_stream(_fs(index)[1], compression=None) as f:
                    lines = _Lines(f)
                    with fs.open_input_file(inner) as archive:
                        for line in lines:
                            at = json.loads(line)
                            archive.seek(at["offset"])
                            record = gzip.decompress(archive.read(at["length"]))
                            head, _, block = record.partition(b"\r\n\r\n")
                            h = _headers(head)
                            http, _, payload = block[:int(h["content-length"])].partition(b"\r\n\r\n")
                            digest = h["warc-payload-digest"].removeprefix("sha1:")
                            size = int(_headers(http)["content-length"])
                            if h["warc-type"] == "response" and (
                                    len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"{path}: the payload at {at['offset']} is damaged")
                            rows.append((_page(h["warc-record-id"]), size, digest, h["warc-type"],
                                         _page(h.get("warc-refers-to"))))
                            if len(rows) == 5000:
                                yield _frame(rows)
                                rows = []
                yield _frame(rows)

    return manifest.mapInPandas(read, READ)


def _frame(rows: list) -> pd.DataFrame:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = ["Int64" if x.endswith(" long") else "object" for x in READ.split(", ")]
    return pd.DataFrame({x.split()[0]: pd.array(c, k) if k == "Int64" else list(c)
                         for x, c, k in zip(READ.split(", "), columns, kinds)})


class _Lines:
    """The lines of a byte stream, block by block."""

    def __init__(self, stream):
        self.stream = stream

    def __iter__(self):
        rest = b""
        while raw := self.stream.read(BLOCK):
            *lines, rest = (rest + raw).split(b"\n")
            yield from lines
        if rest:
            yield rest


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, normalise these and read the records back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    written = materialize(write_archives(with_digest(pages), f"{folder}/whole"), "warc-written")
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    made = materialize(normalise(written.repartition(n, "path"), f"{folder}/members"), "warc-members")
    return read_archives(made.repartition(n, "path"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest AS d, max(page_id) AS keeper FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON payload_digest = d
"""
