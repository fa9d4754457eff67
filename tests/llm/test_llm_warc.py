import hashlib
import io

import pytest

from tablekit.llm import warc
from tablekit.llm.store import new_path


def pages(spark):
    big, small = "x" * 200, "y" * 99
    rows = [(5, "u5", big), (2, "u\r\n2", big), (9, None, big), (3, "u3", small), (4, "u4", small), (7, "u7", None), (8, "u8", ""), (2, "again", big), (None, "n", big), (11, "long", "é" * 300_000), (12, "z", "é" * 300_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string"), rows


def test_round_trip_and_revisits(spark):
    df, rows = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archive(df.repartition(3), path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "" for i, _, h in rows if f"<urn:page:{i}>" == r.record_id), None) or (rows[8][2] if r.record_id == "<urn:page:null>" else "")
        assert r.payload_length == len(html.encode()) and r.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert (bytes(r.payload) if r.warc_type == "response" else None) == (html.encode() if r.warc_type == "response" else r.payload)
    kinds = sorted((r.record_id, r.warc_type, r.refers_to) for r in got)
    revisit = {(a, c) for a, b, c in kinds if b == "revisit"}
    assert revisit == {("<urn:page:5>", "<urn:page:2>"), ("<urn:page:9>", "<urn:page:2>"), ("<urn:page:null>", "<urn:page:2>"), ("<urn:page:12>", "<urn:page:11>")}
    assert sum(b == "response" and a == "<urn:page:2>" for a, b, _ in kinds) == 2
    assert any(r.target_uri == "u%0D%0A2" for r in got)


def test_push_down_and_payload_skipping(spark):
    df, _ = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archive(df, path)
    only = warc.read_archive(spark, path, payload=False).where("warc_type = 'revisit' and payload_length > 1000")
    assert [r.record_id for r in only.collect()] == ["<urn:page:12>"]
    assert all(r.payload is None for r in warc.read_archive(spark, path, payload=False).collect())
    reader = warc.WarcReader(None, {"path": path})
    from pyspark.sql.datasource import EqualTo, IsNull

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), IsNull(("payload",))]))
    assert len(left) == 1 and reader.tests == [("warc_type", "=", "revisit")]


def test_unwanted_payloads_are_not_read():
    row = lambda i, n: dict(warc_type="response", record_id=f"<{i}>", target_uri="u", refers_to=None, payload_digest="d", payload_length=None, payload=hashlib.sha256(bytes([i])).digest() * n)
    data = b"".join(warc.member(warc.record(row(i, 20_000 if i % 2 else 3), "d"), 1) for i in range(6))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    f = Counting(data)
    assert sum(1 for _ in warc.records(f, 0, len(data), lambda r: False, True)) == 0
    assert f.taken <= 6 * warc.HEAD


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    row = lambda i: dict(warc_type="response", record_id=f"<{i}>", target_uri="u", refers_to=None, payload_digest="d", payload_length=None, payload=(b"<p>page %d</p>" % i) * 3000)
    data = b"".join(warc.member(warc.record(row(i), "d"), 5) for i in range(3))
    inflated = []
    plain = warc.zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.z = plain(bits)

        def decompress(self, *a):
            inflated.append(len(out := self.z.decompress(*a)))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert list(warc.records(io.BytesIO(data), 0, len(data), lambda r: False, True)) == []
    assert sum(inflated) <= 3 * 2 * warc.STEP
    got = list(warc.records(io.BytesIO(data), 0, len(data), lambda r: r["record_id"] != "<1>", True))
    assert [r["payload"] for r in got] == [row(0)["payload"], row(2)["payload"]]


def test_archives_without_lengths(tmp_path, spark):
    import gzip

    row = dict(warc_type="response", record_id="<a>", target_uri="u", refers_to=None, payload_digest="d", payload_length=None, payload=b"hello" * 9000)
    (tmp_path / "other.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(dict(row, record_id=f"<{i}>"), "d")) for i in range(3)))
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert [r.record_id for r in got] == ["<0>", "<1>", "<2>"] and all(bytes(r.payload) == b"hello" * 9000 for r in got)


def test_empty_table(spark):
    path = new_path(spark, "warc-test")
    warc.write_archive(pages(spark)[0].limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_broken_archive_raises():
    data = warc.member(warc.record(dict(warc_type="response", record_id="a", target_uri="u", refers_to=None, payload_digest="d", payload_length=None, payload=hashlib.sha256(b"1").digest() * 9000), "d"), 0)
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:5000]), 0, 5000, lambda r: True, True))
