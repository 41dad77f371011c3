"""WARC archives: writing with revisit records, and a reader that salvages what damage leaves.

An archive is a file of WARC/1.1 records, each either plain or one gzip member. Spark's text
writer puts the bytes into the shared store (no local files) and ends each file with a line separator, so that
has to be part of the format: of a plain archive it is the CRLF CRLF after the last record, of a compressed one the zero byte
that ends every member of less than 16 MB (the top byte of its size); a longer last member is followed by an empty one.
So the files are gzip files by the standard.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quern.llm.blocks import new_dir, stash

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 1000
#: An archive file ends with the record that takes it over so many bytes.
FILE_BYTES = 32 << 20
#: Bytes that a gzip member may hold; a longer one is quarantined, as a few bytes may stand for terabytes.
MEMBER_BYTES = 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER, _END, _CHUNK = b"\x1f\x8b\x08", b"\r\n\r\n", 1 << 16


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): which record is a revisit of which.

    Of equal payloads (by SHA-1) of at least MIN_REVISIT bytes the largest page_id is the response. Null
    html is an empty payload. A null page_id is never a target while another id has the payload.
    Rows that repeat the largest page_id are all responses. A payload that a third of all pages
    share is one row of the aggregate; the join back can be split by key.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    seen = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    targets = (
        seen.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy(F.sha1("payload").alias("payload_digest"))
        .agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return rows.join(targets, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to")
    )


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record without the CRLF CRLF that ends it."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(records: DataFrame, path: str, gz: bool = True, file_bytes: int = FILE_BYTES, suffix: str | None = None) -> None:
    """Write (page_id, url, payload, payload_digest, refers_to) as archives of about file_bytes below path.

    Files have the names of Spark's text writer; with a suffix (`.warc.gz`) the driver renames them one by one when all are written.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cell() -> pa.RecordBatch:
            if gz and held[-1][-1]:
                held.append(_member(b""))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[: -1 if gz else -len(_END)]], pa.binary())], names=["value"])

        for batch in batches:
            for r in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                raw = record_bytes(*(x.as_py() for x in r)) + _END
                held.append(_member(raw) if gz else raw)
                size += len(held[-1])
                if size >= file_bytes:
                    yield cell()
                    held, size = [], 0
        if held:
            yield cell()

    cells = records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(encode, "value binary")
    lines = cells.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" if gz else "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)
    if suffix is not None:
        spark = records.sparkSession
        jvm, folder = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(folder):
            if (old := status.getPath()).getName().startswith("part-"):
                system.rename(old, jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + suffix))


class _Ends:
    """Where headers end: the next CRLF CRLF after a place; each stretch of the data is searched once, as long as places ascend."""

    def __init__(self, data: bytes):
        self.data, self.asked, self.found = data, 0, -1

    def after(self, at: int) -> int:
        if not (self.asked <= at <= self.found or (self.found < 0 and self.asked and at >= self.asked)):
            self.asked, self.found = max(at, 1), self.data.find(_END, at)
        return self.found


def _header(data: bytes, at: int, ends: _Ends) -> tuple[dict[str, str], int] | None:
    """The fields of a record that begins here, and where its block begins. Lines that begin with white space go on with the field before."""
    m = _VERSION.match(data, at)
    end = ends.after(m.end() - 2) if m else -1
    if end < 0:
        return None
    fields: dict[str, str] = {}
    name = None
    for line in data[m.end() : end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:
            fields[name] = f"{fields[name]} {line.strip().decode('utf-8', 'replace')}"
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        name = key.strip().lower().decode("latin-1")
        fields[name] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) else None


#: Algorithms whose digests are compared; others are taken as they stand.
_ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def _digest_hex(named: str) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of `algorithm:value` in hex or base32; None if the form is not known."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in _ALGORITHMS:
        return None
    size, value = hashlib.new(algorithm).digest_size, value.strip()
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * size}}}", value):
        return algorithm, value.lower()
    value = value.rstrip("=").upper()
    if len(value) == -(-8 * size // 5) and re.fullmatch("[A-Z2-7]+", value):
        return algorithm, base64.b32decode(value + "=" * (-len(value) % 8)).hex()
    return None


def _checked(fields: dict[str, str], block: bytes) -> bool:
    """Whether the block has the digest that its record names: that of the block, or if there is none, that of the payload. Chunked payloads are not checked, as archives differ in what they hash."""
    want = _digest_hex(fields.get("warc-block-digest", ""))
    if want:
        return want[1] == hashlib.new(want[0], block).hexdigest()
    want = _digest_hex(fields.get("warc-payload-digest", ""))
    if want and fields.get("warc-type") != "revisit" and b"transfer-encoding" not in block.partition(_END)[0].lower():
        return want[1] == hashlib.new(want[0], payload_of(block)).hexdigest()
    return True


def payload_of(block: bytes) -> bytes:
    """The block of a response after its HTTP header, or all of it if it has none."""
    return block.partition(_END)[2] if block.startswith(b"HTTP/") else block


def _plain(data: bytes, at: int, ends: _Ends) -> tuple[dict[str, str], bytes, int] | None:
    """A sound plain record at this offset, and where it ends."""
    found = _header(data, at, ends)
    if not found:
        return None
    fields, start = found
    end = start + int(fields["content-length"])
    if data[end : end + 4] != _END or not _checked(fields, block := data[start:end]):
        return None
    return fields, block, end + 4


def _gzip(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int] | None:
    """The sound records of a gzip member at this offset (an empty member has none), and where it ends with zero bytes after it."""
    z, pos, parts, size = zlib.decompressobj(31), at, [], 0
    view = memoryview(data)
    try:
        while not z.eof:
            chunk = view[pos : pos + _CHUNK]
            if not len(chunk):
                return None
            parts.append(z.decompress(chunk, MEMBER_BYTES + 1 - size))
            size += len(parts[-1])
            pos += len(chunk)
            if size > MEMBER_BYTES or z.unconsumed_tail:
                return None
    except zlib.error:
        return None
    end, raw = pos - len(z.unused_data), b"".join(parts)
    records, place, ends = [], 0, _Ends(raw)
    while place < len(raw):
        got = _plain(raw, place, ends)
        if not got:
            return None
        records.append(got[:2])
        place = got[2]
    while end < len(data) and data[end] == 0:
        end += 1
    return records, end


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """(`record`, offset, length, fields, block) and (`gap`, offset, length, {}, b'') of an archive.

    A record whose length, end or digest is wrong isn't trusted. The reader then looks for the
    next gzip member that opens and holds sound records, or the next version line that begins a
    sound record, and goes on there; the bytes between are a quarantined gap. Records of one gzip member have its
    offset and length. Zero bytes and empty members between records are padding. An empty archive has nothing.
    Members are read in small pieces and ends of headers searched once, so the time grows with the size of the archive.
    """
    at, gap, size, ends = 0, None, len(data), _Ends(data)
    places = {b: -2 for b in (_MEMBER, b"WARC/1.")}
    while at < size:
        if gap is None and data[at] == 0:
            at += 1
            continue
        got: tuple[list, int] | None = None
        if data.startswith(_MEMBER, at):
            got = _gzip(data, at)
        elif data.startswith(b"WARC/1.", at) and (one := _plain(data, at, ends)):
            got = [one[:2]], one[2]
        if got:
            if gap is not None:
                yield "gap", gap, at - gap, {}, b""
                gap = None
            for fields, block in got[0]:
                yield "record", at, got[1] - at, fields, block
            at = got[1]
            continue
        if gap is None:
            gap = at
        for mark, place in places.items():
            if place != -1 and place <= at:
                places[mark] = data.find(mark, at + 1)
        at = min((p for p in places.values() if p > at), default=size)
    if gap is not None:
        yield "gap", gap, size - gap, {}, b""


READ = S.StructType(
    [
        S.StructField("path", S.StringType()),
        S.StructField("kind", S.StringType()),
        S.StructField("offset", S.LongType()),
        S.StructField("length", S.LongType()),
        S.StructField("record_type", S.StringType()),
        S.StructField("record_id", S.StringType()),
        S.StructField("target_uri", S.StringType()),
        S.StructField("refers_to", S.StringType()),
        S.StructField("payload_digest", S.StringType()),
        S.StructField("payload_bytes", S.LongType()),
        S.StructField("payload", S.BinaryType()),
    ]
)


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below path, one task for each group of files.

    Rows of kind `gap` have path, offset and length only. payload_digest (SHA-1) and payload_bytes are measured on the payload; of a revisit
    the digest is the one it states and size and payload are null: see resolve_revisits(). A file must fit a binary cell (2 GB).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in READ.fields]
        )
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for kind, at, length, fields, block in salvage(data.as_buffer().to_pybytes()):
                    revisit = fields.get("warc-type") == "revisit"
                    body = None if kind == "gap" or revisit else payload_of(block)
                    stated = _digest_hex(fields.get("warc-payload-digest", ""))
                    digest = hashlib.sha1(body).hexdigest() if body is not None else stated[1] if stated and stated[0] == "sha1" else None
                    size = len(body) if body is not None else None
                    rows.append((name, kind, at, length, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, body if payloads else None))
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, READ)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """read_archives() with size and digest of each revisit taken from the record that it refers to, in whichever archive.

    A revisit whose record is missing, or has another digest than it states, keeps a null size. Of records that share an id one with the
    digest counts. Records that many revisits refer to are one row of a table that is written first, so the join can be split.
    """
    light = stash(found.drop("payload"), "records")
    revisits = light.filter("record_type = 'revisit'")
    asked = revisits.select(F.col("refers_to").alias("record_id"), "payload_digest").distinct()
    targets = light.filter("kind = 'record' AND record_type <> 'revisit'").join(asked, ["record_id", "payload_digest"], "left_semi")
    told = stash(targets.groupBy("record_id", "payload_digest").agg(F.max("payload_bytes").alias("full_bytes")).withColumnRenamed("record_id", "refers_to"), "targets")
    full = revisits.join(told, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("full_bytes")).select(*light.columns)
    return light.filter("record_type IS NULL OR record_type <> 'revisit'").unionByName(full)


def log_gaps(found: DataFrame, path: str) -> None:
    """Append (path, offset, length) of every quarantined gap to the table at path."""
    found.filter("kind = 'gap'").select("path", "offset", "length").write.mode("append").parquet(path)


def _id(urn) -> F.Column:
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '<urn:page:(-?[0-9]*)>', 1), '') AS BIGINT)")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives in the shared folder, and report what the reader finds there; gaps go to a table beside the archives."""
    path = new_dir(spark, "warc")
    write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = resolve_revisits(read_archives(spark, path, payloads=False))
    log_gaps(found, new_dir(spark, "warc-gaps"))
    return found.filter("kind = 'record'").select(
        _id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _id("refers_to").alias("refers_to")
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
