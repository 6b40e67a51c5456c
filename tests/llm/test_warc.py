import base64
import glob
import gzip
import hashlib
import zlib

from tangoflow.llm import warc as W

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/4", None), (5, "u", ""),
         (6, "http://a\r\nX-Bad: 1", "x" * 200_000), (0, "http://a/0", "same"), (7, "u", "a\r\n\r\nb"), (7, "u", "a\r\n\r\nb")]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, first int")


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    got = W.archive(pages_of(spark, PAGES)).collect()
    assert len(got) == len(PAGES) and all(r.verified and r.error is None for r in got)
    payload = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        p = payload[int(r.id)]
        first = min(i for i, q in payload.items() if q == p)
        assert (r.payload_bytes, r.payload_digest) == (len(p), b32(p))
        assert r.record_type == ("response" if int(r.id) == first else "revisit")
        assert r.refers_to == (None if int(r.id) == first else str(first))


def test_files_are_one_gzip_member_per_record(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_warc(W.records(pages_of(spark, PAGES), min_revisit=5).coalesce(1), path)
    (file,) = glob.glob(path + "/part-*")
    data, n = open(file, "rb").read(), 0
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(PAGES)
    while data:
        z = zlib.decompressobj(31)
        z.decompress(data)
        data, n = z.unused_data, n + 1
    assert n == len(PAGES)
    kinds = {r.id: r.record_type for r in W.read_warc(spark, path).collect()}
    assert kinds["5"] == "response" and kinds["2"] == "response"  # under five bytes: no revisits
    body = {r.id: r.payload for r in W.read_warc(spark, path).collect()}
    assert body["6"] == b"x" * 200_000 and body["4"] == b""


def record(payload=b"hello", digest=None):
    return W.member(1, "u", payload, len(payload), digest or b32(payload), None)


def test_damage_is_reported():
    good = record()
    assert [r["verified"] for r in W.parse(good + record(b"two"))] == [True, True]
    assert [r["verified"] for r in W.parse(record(digest="A" * 32))] == [False]
    cut = list(W.parse(good + record(b"two")[:-12]))
    assert cut[0]["verified"] and cut[1]["error"]
    torn = bytearray(good)
    torn[20] ^= 255
    assert list(W.parse(bytes(torn)))[0]["error"]
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc\r\n\r\n")
    long = gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")
    assert "shorter" in list(W.parse(short))[0]["error"] and "longer" in list(W.parse(long))[0]["error"]
    assert "not a WARC" in list(W.parse(gzip.compress(b"x\r\n\r\n")))[0]["error"]


def test_foreign_records_and_empty_members():
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    got = list(W.parse(W.EMPTY_MEMBER + gzip.compress(plain) + W.EMPTY_MEMBER))
    assert len(got) == 1 and got[0]["id"] == "urn:uuid:1" and got[0]["error"] is None


def test_member_ends_in_zero_beyond_16_mib():
    m = W.member(1, "u", bytes(17 << 20), 17 << 20, b32(bytes(17 << 20)), None)
    assert m[-1] == 0
    (r,) = W.parse(m[:-1] + b"\0")
    assert r["verified"] and r["payload_bytes"] == 17 << 20


def test_empty_table(spark):
    assert W.archive(pages_of(spark, PAGES).where("false")).count() == 0


def test_null_ids_and_foreign_file_names(spark, tmp_path):
    got = W.archive(pages_of(spark, [(None, "u", "same"), (4, "v", "same"), (None, "w", "other")])).collect()
    assert sorted((r.id or "", r.record_type, r.refers_to) for r in got) == [
        ("", "response", None), ("", "revisit", "4"), ("4", "response", None)]
    (tmp_path / "crawl-0001.warc.gz").write_bytes(record() + record(b"two"))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    assert W.read_warc(spark, str(tmp_path), names="*.warc.gz").count() == 2
    assert {r.error is None for r in W.read_warc(spark, str(tmp_path)).collect()} == {True, False}
