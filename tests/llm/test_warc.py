"""Archives: exact round trips, framing, damage, and the choice of revisits."""

import collections
import gzip
import hashlib
import zlib

import pytest

from limpid.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, h long, last long, salt int, refers_to string"
LONG = "<p>été " * 300


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2, 3, "y") for i, u, h in rows], SCHEMA)


def brute(rows, least=warc.LEAST_REVISIT):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        kept = last.get(h or "")
        old = len(raw) >= least and kept is not None and (i is None or i < kept)
        out[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", kept if old else None)] += 1
    return out


ROWS = [
    (1, "http://a.example/ x\r\nInjected: yes", LONG), (2, None, LONG), (5, "http://b.example/", LONG), (3, "u", LONG + "!"),
    (None, "n", LONG), (None, "n", "alone " * 400), (4, "", None), (6, "e", ""), (7, "short", "same"), (8, "short", "same"),
    (9, "twice", "ab" * 900), (9, "twice", "ab" * 900), (-3, "minus", "ab" * 900), (10, "ends", "x\r\n\r\nWARC/1.1\r\n\r\n" * 80),
]


@pytest.mark.parametrize("keys", [warc.BROADCAST_KEYS, 0])
def test_pages_come_back(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", keys)
    pages(spark, ROWS).write.parquet(f"{tmp_path}/pages.parquet")
    got = collections.Counter(tuple(r) for r in warc.op12_warc(spark, str(tmp_path)).collect())
    assert got == brute(ROWS)


def test_payloads_and_heads_come_back(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS).repartition(3), f"{tmp_path}/a")
    back = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert len(back) == len(ROWS) and not [r for r in back if r["error"]]
    texts = collections.Counter(r["payload"].decode() for r in back if r["record_type"] == "response")
    assert texts == collections.Counter((h or "") for (i, _, h), n in [(x, 1) for x in ROWS] if not (h == LONG and i != 5) and i != -3)
    first = next(r for r in back if r["record_id"] == "<urn:page:1>")
    assert first["target_uri"] == "http://a.example/%20x%0D%0AInjected:%20yes" and first["refers_to"] == "<urn:page:5>"
    assert first["payload"] is None and first["payload_bytes"] == len(LONG.encode())


def test_files_are_nothing_but_gzip_members(spark, tmp_path):
    """Any gzip reader inflates an archive whole, a record over 16 MB included."""
    rows = [(1, "u", "z" * (17 << 20)), (2, "v", "after"), (3, "w", None)]
    warc.write_archives(pages(spark, rows).coalesce(1), f"{tmp_path}/a")
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 3 and whole.endswith(b"\r\n\r\n")
    back = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert sorted((r["record_id"][10:-1], r["payload_bytes"]) for r in back) == [("1", 17 << 20), ("2", 5), ("3", 0)]


def test_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op12_warc(spark, str(tmp_path)).collect() == []


def record(payload=b"hello", **changed):
    head = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "Content-Type": "text/plain"}
    return warc.member(head | changed, payload)


def test_a_damaged_member_costs_only_itself():
    good = [record(bytes([65 + i]) * 3000) for i in range(3)]
    broken = bytearray(good[1])
    broken[40:60] = bytes(20)
    found = list(warc.records(good[0] + bytes(broken) + good[2]))
    assert [r.payload and r.payload[:1] for r in found if not r.error] == [b"A", b"C"]
    assert [r.offset for r in found if r.error] == [len(good[0])]


@pytest.mark.parametrize(
    "archive, reason",
    [
        (record()[:-9], "ends inside"),
        (record(**{"WARC-Payload-Digest": "sha1:AAAA"}), "payload digest"),
        (record(**{"WARC-Block-Digest": "sha1:AAAA"}), "block digest"),
        (gzip.compress(b"no head at all"), "no record head"),
        (gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), "Content-Length"),
        (gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"), "shorter"),
        (gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n"), "two line ends"),
        (record(b"no blank line", **{"Content-Type": "application/http"}), "HTTP head"),
    ],
)
def test_what_is_wrong_is_said(archive, reason):
    (only,) = warc.records(archive)
    assert reason in only.error and only.payload is None


def test_reading_stops_or_lists(spark, tmp_path):
    (tmp_path / "one.warc.gz").write_bytes(record() + record()[:-9])
    listed = warc.read_archives(spark, str(tmp_path), on_error="row").collect()
    assert [r["payload"] for r in listed if not r["error"]] == [b"hello"] and sum(bool(r["error"]) for r in listed) == 1
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_inflating_is_bounded_by_slices():
    """A member that inflates a thousandfold is hashed without being held."""
    m = warc._Member(memoryview(zlib.compress(b"\0" * (40 << 20), 9, 31)), 0)
    most = 0
    for part in m.take(40 << 20):
        most = max(most, len(part) + len(m.held))
    assert most <= warc.SLICE
