import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import Row

from waymark.llm import warc


def expected(pages):
    first = {}
    for page, html in pages:
        payload = (html or "").encode()
        first[payload] = min(page, first.get(payload, page))
    out = {}
    for page, html in pages:
        payload = (html or "").encode()
        again = first[payload] != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out[page] = (len(payload), digest, "revisit" if again else "response", first[payload] if again else None)
    return out


def test_query(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = warc.op10_warc(spark, sf).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected(pages)


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("part", ["200", "3000", "64m"])
def test_splits_at_any_byte(spark, tmp_path, level, part):
    """Stored payloads full of magic numbers, read in ranges far smaller than a record."""
    rng = random.Random(5)
    pages = []
    for i in range(20):
        html = "".join(rng.choice(["\x1f\x08", "a", "WARC/1.1\r\n", "é", "\r\n\r\n"]) for _ in range(rng.randrange(900)))
        pages.append((i, html if i % 7 else "same"))
    docs = spark.createDataFrame([Row(page_id=i, url=None if i % 3 else f"http://a/{i}\r\nx", html=h) for i, h in pages], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write(docs.coalesce(2), path, level)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = warc.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == len(pages)
    want = expected(pages)
    for r in rows:
        page = int(r.record_id[len("<urn:x-page:") : -1])
        size, digest, kind, _ = want[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (size, digest, kind)
        assert r.payload is None if kind == "revisit" else bytes(r.payload) == pages[page][1].encode()


def test_false_starts_across_ranges(spark, tmp_path):
    """Whole members inside stored payloads: valid gzip headers that are no records of the archive."""
    inner = gzip.compress(b"no record") + warc.MAGIC + b"\x00" * 7
    members = []
    for i in range(30):
        payload = (inner + bytes([i])) * (i * 7 % 40)
        members.append((i, payload, warc.record(i, None, payload, None, False, level=0)))
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.warc.gz.txt").write_bytes(b"".join(m for _, _, m in members))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for part in ("97", "1000", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = warc.read(spark, f"file://{folder}").collect()
            assert {r.record_id: bytes(r.payload) for r in rows} == {f"<urn:x-page:{i}>": p for i, p, _ in members}
            assert len(rows) == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (folder / "b.txt").write_bytes(members[5][2][:-9])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, f"file://{folder}").collect()


def with_extra(member: bytes, extra: bytes) -> bytes:
    """The same member with an extra field in its gzip header."""
    return member[:3] + b"\x04" + member[4:10] + len(extra).to_bytes(2, "little") + extra + member[10:]


def test_magic_numbers_in_a_record_s_own_first_bytes(spark, tmp_path):
    """They come before a byte can be inflated, so the start must wait for the pieces after it; at every split."""
    members = [(0, b"first", warc.record(0, None, b"first", None, False))]
    for i, extra in enumerate([warc.MAGIC, warc.MAGIC * 3, b"ab" + warc.MAGIC + b"\x00" * 9, warc.MAGIC + warc.EMPTY_MEMBER[3:9]], 1):
        payload = f"payload {i} ".encode() * (i * 30)
        members.append((i, payload, with_extra(warc.record(i, None, payload, None, False), extra)))
    data = b"".join(m for _, _, m in members)
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.warc.gz.txt").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for part in [*range(40, 140, 3), 333, len(data) - 1, 1 << 20]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
            rows = warc.read(spark, f"file://{folder}").collect()
            assert sorted((r.record_id, bytes(r.payload)) for r in rows) == [(f"<urn:x-page:{i}>", p) for i, p, _ in members]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hard_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "x" * 3_000_000), (3, "u", "x" * 3_000_000), (None, "u", "x" * 3_000_000), (4, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, payload string")
    warc.write(pages, f"file://{tmp_path}/x")
    got = warc.read(spark, f"file://{tmp_path}/x").select(warc._page("record_id").alias("p"), "record_type", warc._page("refers_to").alias("r")).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(
        [(1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "response", None), (None, "response", None), (4, "revisit", 3)], key=key
    )
    warc.write(pages.limit(0), f"file://{tmp_path}/y")
    assert warc.read(spark, f"file://{tmp_path}/y").count() == 0
