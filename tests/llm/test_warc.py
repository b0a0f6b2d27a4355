import gzip
import hashlib
import io
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haggle.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abc <>\r\né漢") for _ in range(n))
    same, other, small = body(500), body(150), "x" * 99
    rows = [(i, f"http://h{i}.net/p", body(rng.randint(0, 400))) for i in range(30)]
    rows += [(90, "http://a/", same), (40, "http://b/", same), (70, None, same), (40, "http://b/", same), (None, "http://n/", same),
             (50, "http://c/\r\nX: y", other), (51, "", other), (60, "http://s/", small), (61, "http://s/", small),
             (80, "http://e/", ""), (81, "http://e/", None), (82, "http://l/", body(700) * 5000),
             (None, "http://u/", "only without an id " * 9), (None, "http://v/", "only without an id " * 9),
             (83, "http://w/", "WARC/1.1\r\nContent-Length: 7\r\n\r\n" * 9), (84, "http://100/", "y" * 100), (85, "http://100/", "y" * 100)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of every row, by loops."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 100 and ids and (i is None or i > min(ids))
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    df = spark.createDataFrame(pages(), SCHEMA).withColumns({c: F.lit("x") for c in ("id", "digest", "size", "key", "first", "payload")})
    W.write_archives(df.repartition(3), f"{path}/raw", records_per_archive=7)
    W.normalise(spark, f"{path}/raw", path)
    return path


def test_records_against_brute_force(spark, archive):
    got = W.read_records(spark, archive).collect()
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=key) == sorted(brute(pages()), key=key)
    stored = {(r.page_id, r.payload_digest): bytes(r.payload) for r in got if r.record_type == "response"}
    for i, _, html in pages():
        data = (html or "").encode()
        assert stored.get((i, hashlib.sha256(data).hexdigest()), data) == data
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    urls = {r.page_id: r.url for r in got}
    assert urls[50] == "http://c/%0D%0AX: y" and urls[51] == "" and urls[70] is None


def test_raw_archives_are_single_streams_and_normalised_ones_are_not(spark, archive):
    raw = spark.read.format("binaryFile").load(f"{archive}/raw").collect()
    assert len(raw) > 3
    for r in raw:
        stream = zlib.decompressobj(31)
        stream.decompress(bytes(r.content))
        assert stream.eof and not stream.unused_data
    total = 0
    for r in spark.read.format("binaryFile").load(f"{archive}/archive").collect():
        data = bytes(r.content)
        spans = list(W.members(data))
        total += len(spans)
        records = [zlib.decompress(data[a: a + n], 31) for a, n in spans]
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records)
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(records)  # any reader takes the file as it is
    assert total == len(pages())


def test_index_leads_to_every_record(spark, archive):
    files = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{archive}/archive").collect()}
    index = W.read_index(spark, archive).collect()
    assert len(index) == len(pages())
    for r in index:
        record = zlib.decompress(files[r.file][r.offset: r.offset + r.length], 31)
        assert W._described(record) == (r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes)


def test_lookup_gives_the_same_records(spark, archive):
    wanted = [40, 82, 61, 12345]
    whole = W.read_records(spark, archive).where(F.col("page_id").isin(wanted)).collect()
    assert sorted(W.lookup(spark, archive, wanted).collect(), key=key) == sorted(whole, key=key) and len(whole) == 4
    assert W.lookup(spark, archive, [99999]).count() == 0


def test_payloads_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(W, "HEAVY_SHARE", 12)  # some payloads are heavy, some light
    W.write_archives(spark.createDataFrame(pages(), SCHEMA), f"{tmp_path}/raw")
    W.normalise(spark, f"{tmp_path}/raw", str(tmp_path))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_records(spark, str(tmp_path)).collect()]
    assert sorted(have, key=key) == sorted(brute(pages()), key=key)


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/raw")
    W.normalise(spark, f"{tmp_path}/raw", str(tmp_path))
    assert W.read_records(spark, str(tmp_path)).count() == 0 and W.read_index(spark, str(tmp_path)).count() == 0


def test_bytes_that_are_no_utf8(spark, tmp_path):
    df = spark.sql("select 1L as page_id, cast(x'68ff74' as string) as url, cast(x'3cfe00ff3e' as string) as html")
    W.write_archives(df, f"{tmp_path}/raw")
    W.normalise(spark, f"{tmp_path}/raw", str(tmp_path))
    row, = W.read_records(spark, str(tmp_path)).collect()
    assert bytes(row.payload) == b"\x3c\xfe\x00\xff\x3e" and row.payload_digest == hashlib.sha256(row.payload).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 3), st.integers(1, 400))
def test_any_cut_of_a_stream(payloads, members, step):
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(p) + p + b"\r\n\r\n" for p in payloads]
    whole = b"".join(records)
    cut = [len(whole) * i // members for i in range(members + 1)]
    data = b"".join(gzip.compress(whole[a:b]) for a, b in zip(cut, cut[1:]))
    keep = W.STEP
    try:
        W.STEP = step
        assert list(W.split_records(W.inflate(data))) == records
    finally:
        W.STEP = keep


def test_damage_is_reported():
    record = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    with pytest.raises(ValueError):
        list(W.inflate(gzip.compress(record * 50)[:-9]))
    with pytest.raises(ValueError):
        list(W.split_records(iter([record + record[:-3]])))
    with pytest.raises(ValueError):
        list(W.split_records(iter([b"HTTP/1.1 200\r\n\r\n"])))
    with pytest.raises(ValueError):
        list(W.members(gzip.compress(record)))
