"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames. A bundle ends with a
seek table: a skippable frame (magic 0x184D2A5E) of one entry a frame
(compressed and decompressed size) and a footer (number of frames, descriptor,
magic 0x8F92EAB1), as the public seekable format has it; other decoders skip
it. The index maps each record identifier to its bundle, frame and offset in
the decompressed frame, so one record is read by decompressing one frame.

Payloads that repeat are stored once: of equal payloads of at least
``REVISIT_BYTES`` the one with the smallest page_id is a response record and
the others are revisit records that refer to it.

Record identifiers are the page's and its digest's, and where several rows have
both, a number more each, so an identifier has one offset. A revisit names the
record that it refers to if there is one such record, and its page in any case.

Defined cases: a null payload counts as empty; rows that repeat the smallest
page_id of a payload are all responses; a null page_id never becomes the
response of others unless no row of that payload has an id; a null URL leaves
the header out and control characters in a URL are percent-encoded; other
columns are ignored; an empty table makes no bundle.

Bundles are written by executor tasks through pyarrow's file systems into the
shared folder, under names that no other attempt uses. The index is a table
that Spark commits, so after a lost executor it names only bundles of attempts
that succeeded.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, partitions, written
from vicinal.session import new_path, table

REVISIT_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
WARC_DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "record_id string, page_id bigint, record_type string, bundle string, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"
RECORD_SCHEMA = "bundle string, frame int, record_at bigint, record_id string, page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"


def open_fs(path: str):
    """The pyarrow file system of a path or URI, and the path in it; the names that Hadoop has for object stores are taken as well."""
    from pyarrow import fs

    if re.match(r"\w+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None, digest: str, number: int | None = None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest[:32]}" + ("" if number is None else f":{number}")


def record_bytes(page_id, url, payload: bytes, length: int, digest: str, kind: str, refers_to, number: int | None = None, named: bool = True) -> bytes:
    """One WARC/1.1 record. The payload of a revisit is not stored; its length and digest are. named: whether one record alone has the id that it refers to."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest, number)}>", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        payload = b""
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>"] if named else []
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at offset {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        yield at, stop + 4 - at, head, data[end + 4 : stop]
        at = stop + 4


class BundleWriter:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        import zstandard

        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes, self.sizes, self.at = frame_bytes, [], 0
        self.pending, self.held, self.waiting = [], 0, []

    def add(self, entry: tuple, data: bytes) -> list[tuple]:
        """Index rows of the frame that this record completes, if it does."""
        self.waiting.append((entry, self.held, len(data)))
        self.pending.append(data)
        self.held += len(data)
        return self.flush() if self.held >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        packed = self.zstd.compress(b"".join(self.pending))
        self.out.write(packed)
        frame, rows = len(self.sizes), []
        for entry, at, n in self.waiting:
            rows.append((*entry, self.name, frame, self.at, len(packed), at, n))
        self.sizes.append((len(packed), self.held))
        self.at += len(packed)
        self.pending, self.held, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        return rows


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed size) of each frame, from the bundle's last bytes."""
    frames, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if descriptor & 0x80 else 8
    raw, at, out = file.read_at(width * frames, size - 9 - width * frames), 0, []
    for i in range(frames):
        packed, full = struct.unpack_from("<II", raw, width * i)
        out.append((at, packed, full))
        at += packed
    return out


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each page.

    Only digests that repeat are joined, so the other side of the join has one
    row a repeated payload; the join may split a payload that many pages share.
    """
    rows = pages.select("page_id", "url", _payload().alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    again = (
        rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and _first is not null")
    )
    out = rows.join(again, rows["payload_digest"] == again["_digest"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each page into bundles below ``folder``; returns the index as a written table."""
    rows = revisits(pages)
    same = ["page_id", "payload_digest"]
    again = pages.select("page_id", F.sha2(_payload(), 256).alias("payload_digest")).groupBy(*same).count().filter("count > 1")
    again = written(again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")), "again")
    number, named = F.lit(None).cast("bigint"), F.lit(True)
    if not again.isEmpty():
        rows = rows.join(broadcast_if_small(again), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
        number = F.when(F.col("_digest").isNotNull(), F.monotonically_increasing_id())
        # A page that is repeated has several records; what refers to it names the page, and none of them.
        referred = broadcast_if_small(again.select(F.col("_page").alias("_to"), F.col("_digest").alias("_to_digest")))
        rows = rows.join(referred, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_to_digest")), "left")
        named = F.col("_to").isNull()
    rows = rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", number.alias("number"), named.alias("named"))
    names = INDEX_SCHEMA.replace(" string", "").replace(" bigint", "").replace(" int", "").split(", ")
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            found = []
            for page, url, payload, length, digest, kind, to, number, named in zip(*[batch.column(i) for i in range(9)], strict=True):
                bundle = bundle or BundleWriter(folder, frame_bytes)
                page, digest, kind, number = page.as_py(), digest.as_py(), kind.as_py(), number.as_py()
                data = record_bytes(page, url.as_py(), payload.as_py(), length.as_py(), digest, kind, to.as_py(), number, named.as_py())
                found += bundle.add((record_id(page, digest, number), page, kind), data)
                if bundle.at >= bundle_bytes:
                    found += bundle.close()
                    bundle = None
            if found:
                yield rows_out(found)
        if bundle and (found := bundle.close()):
            yield rows_out(found)

    return written(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def frames_of(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """bundle, frame, frame_at, frame_bytes of every frame, from the seek tables of the indexed bundles."""
    schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_fs(f"{folder}/{name}")
                with fs.open_input_file(path) as file:
                    found = seek_table(file, file.size())
                cols = [[name] * len(found), range(len(found)), [x[0] for x in found], [x[1] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return index.select("bundle").distinct().mapInArrow(read, "bundle string, frame int, frame_at bigint, frame_bytes bigint")


def read_frames(frames: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given frames (bundle, frame, frame_at, frame_bytes), one row each."""
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = re.sub(r" (string|bigint|int|binary)\b", "", RECORD_SCHEMA).split(", ")
    schema = pa.schema(list(zip(names, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, frame, at, size in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                fs, path = open_fs(f"{folder}/{bundle}")
                with fs.open_input_file(path) as file:
                    data = unzip.decompress(file.read_at(size, at))
                rows = []
                for offset, _, head, payload in parse_records(data):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"{bundle}, frame {frame}, offset {offset}: the payload does not match its digest")
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                    rows.append((bundle, frame, offset, head["warc-record-id"][1:-1], page and int(page), kind, to and int(to), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, payload if payloads else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    # A frame is a few hundred KB to read but a few bytes here, so it is dealt out by name.
    dealt = frames.select("bundle", "frame", "frame_at", "frame_bytes").repartition(partitions(frames.sparkSession), "bundle", "frame")
    return dealt.mapInArrow(read, RECORD_SCHEMA)


def read_bundles(spark: SparkSession, index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the indexed bundles."""
    return read_frames(frames_of(spark, index, folder), folder, payloads)


def fetch(spark: SparkSession, index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``; reads only the frames that hold them."""
    entries = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    frames = entries.select("bundle", "frame", "frame_at", "frame_bytes").distinct()
    found = read_frames(frames, folder)
    return found.join(entries.select("bundle", "frame", "record_at"), ["bundle", "frame", "record_at"], "left_semi")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC bundles and read them back."""
    folder = new_path(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(spark, index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"
    )


QUERIES = {"op1_warc_bundles": op1_warc_bundles}
ORACLE_SQL = {
    "op1_warc_bundles": """
    WITH p AS (
        SELECT page_id, url, coalesce(html, '') AS html FROM pages
    ), d AS (
        SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
    ), f AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
        'urn:page:' || page_id || ':' || left(payload_digest, 32) AS record_id, url
    FROM f
    """
}
