"""Web archives: a writer of compressed records and a reader that splits files at any byte.

Every record is a gzip member of its own. Spark's text writer puts the members down as raw bytes (through its commit
protocol, in any store it can reach); as it ends each row with a separator, the separator is an empty member,
which decoders skip. The reader gives Spark's text source the gzip magic as line separator, so each task scans a byte
range for magic numbers and reads on past its end to finish what starts inside. A candidate counts as a record only if its
header inflates to a WARC version line; magic numbers inside compressed data are put back. A candidate of which too few bytes are
there to tell, as when a magic number follows inside its own first bytes, takes the pieces after it before it is judged. A piece
that a false start cut off at a range's border goes, with the rest of its record, through a small step by file.

Defined results: a null html is an empty payload; a null url leaves out the target; a null page_id is written and read as
null and takes no part in finding equal payloads (it is a response); of equal payloads all rows with the smallest page_id
are responses; an empty table gives no records; extra columns play no part; a payload of any length is one record and is held whole by
the task that reads it; a damaged or cut-off record raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import new_table_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 0
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> Column:
    digits = F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def with_first(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): the smallest page_id with an equal payload, null for that page itself."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    keyed = plain.withColumn("_sha", F.sha2("payload", 256))
    first = keyed.where((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("_sha")
    first = first.agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).where("_first != _last").select("_sha", "_first")
    return keyed.join(first, "_sha", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to")
    )


def write(pages: DataFrame, path: str, level: int = 6) -> None:
    """Archive files of all rows of ``pages`` (page_id, url, html) in folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = whole.slice(start, 256).to_pylist()
                made = [record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["refers_to"] is not None, level) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    members = with_first(pages).mapInArrow(run, T.StructType([T.StructField("value", T.BinaryType())]))
    bytes_as_text = members.select(F.col("value").cast("string").alias("value"))
    bytes_as_text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
#: Of a scanned range: a record, or a piece that belongs to a record of another range.
SCANNED = T.StructType(
    [
        *RECORD.fields,
        T.StructField("file", T.StringType()),
        T.StructField("range_start", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("raw", T.BinaryType()),
    ]
)


def _starts_record(data: bytes) -> bool | None:
    """Whether a candidate member's header inflates to the start of a record, or it is an empty member; None if more bytes must tell."""
    unpacker = zlib.decompressobj(31)
    try:
        head = unpacker.decompress(data, len(VERSION))
    except zlib.error:
        return False
    if head == VERSION or (head == b"" and unpacker.eof):
        return True
    return None if VERSION.startswith(head) and not unpacker.eof else False


def _inflated(data: bytes) -> tuple[bytes | None, bytes]:
    """The content of the member at the front of ``data``, None if it is cut off, and what follows it."""
    unpacker = zlib.decompressobj(31)
    content = unpacker.decompress(data)
    return (content, unpacker.unused_data) if unpacker.eof else (None, b"")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def parse(content: bytes) -> tuple:
    """The columns of RECORD of one record's content."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http).get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        payload = None
    elif len(payload) != size or (digest and payload_digest(payload) != digest):
        raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
    return fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), payload, size, digest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that start in each range; ``piece`` 0 before its first record, 1 its last record if that is cut off."""
    out: list[tuple] = []
    at: tuple[str, int] | None = None
    pending: list[bytes] = []
    stray: list[bytes] = []
    undecided: list[bytes] = []

    def flush() -> bool:
        """Turn what is pending into a record; False if it is cut off."""
        if not pending:
            return True
        content, rest = _inflated(b"".join(pending))
        if content is None:
            return False
        if rest:
            raise ValueError("bytes that belong to no record follow a record")
        pending.clear()
        if content:
            out.append((*parse(content), None, None, None, None))
        return True

    def take(piece: bytes) -> None:
        """One more piece. While a candidate is undecided, all pieces after it would lie inside its first bytes."""
        undecided.append(piece)
        starts = _starts_record(b"".join(undecided))
        if starts:
            if not flush():
                raise ValueError(f"a record of {at[0]} is cut off")
            pending.extend(undecided)
            undecided.clear()
        elif starts is False:
            (pending or stray).append(undecided[0])
            again = undecided[1:]
            undecided.clear()
            for other in again:
                take(other)

    def end() -> None:
        # a member that is whole can only be followed by a start, and one that isn't only by its rest
        if not pending:
            stray.extend(undecided)
        else:
            flush()
            pending.extend(undecided)
        undecided.clear()
        if stray:
            out.append((*[None] * 7, *at, 0, b"".join(stray)))
        if pending:
            out.append((*[None] * 7, *at, 1, b"".join(pending)))
        pending.clear()
        stray.clear()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(SCANNED.names, r)) for r in out], _arrow_schema())
        out.clear()
        return made

    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            rows = whole.slice(first, 256)
            for raw, file, start in zip(*[rows.column(c).to_pylist() for c in ("raw", "file", "range_start")]):
                if (file, start) != at:
                    if at is not None:
                        end()
                    at = (file, start)
                    if start == 0:  # what stands before a file's first magic number
                        if raw:
                            raise ValueError(f"{file} doesn't start with a gzip member")
                        continue
                take(MAGIC + raw)
            yield batch()
    if at is not None:
        end()
        yield batch()


def _arrow_schema() -> pa.Schema:
    kinds = {T.StringType: pa.string(), T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in SCANNED.fields])


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """Records of one file whose parts were found in different ranges."""
    found, pending = [], b""
    for raw in pieces.sort_values(["range_start", "piece"])["raw"]:
        pending += raw
        while pending:
            content, rest = _inflated(pending)
            if content is None:
                break
            if content:
                found.append(parse(content))
            pending = rest
    if pending:
        raise ValueError(f"a record of {pieces['file'].iloc[0]} is cut off")
    return pd.DataFrame(found, columns=RECORD.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files in folder ``path``, as RECORD; payload is null for revisits."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    ranged = lines.select(
        F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range_start"),
    )
    scanned = ranged.mapInArrow(_scan, SCANNED)
    whole = scanned.where("raw is null").select(*RECORD.names)
    cut = scanned.where("raw is not null").select("file", "range_start", "piece", "raw")
    return whole.union(cut.groupBy("file").applyInPandas(_joined, RECORD))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to")
    )
