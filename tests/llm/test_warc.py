"""Archives: exact round trips, reassembly out of order, and broken segment sets."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as A

SCHEMA = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(1)
    long = "".join(rng.choice("abc é\r\n<>") for _ in range(90_000))
    return [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (8, "u", "same"), (8, "u", "same"), (None, "u", "same"), (None, "u", "alone")]


def b32(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        size = len((h or "").encode())
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids else None
        revisit = size >= least and i != first
        out.append((i, size, b32(h), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 300, "file_bytes": 4000}, {"least_bytes": 5}])
def test_round_trip(spark, options):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    got = A.read_archives(A.write_archives(df, **options)).collect()
    assert not [r.error for r in got if r.error]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages(), options.get("least_bytes", 0))
    texts = {(i, h or "") for i, _, h in pages()}
    assert all((r.page_id, r.payload.decode()) in texts for r in got if r.record_type == "response")


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame(pages(), SCHEMA).withColumns({c: F.lit("x") for c in ("sha", "first", "payload", "revisit", "origin")})
    assert A.read_archives(A.write_archives(df)).count() == len(pages())
    assert A.read_archives(A.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_reassembly_checks():
    block = b"HTTP/1.1 200 OK\r\n\r\nabcdefgh"
    cut = [(k + 1, len(block) if k == 2 else None, {"x": "1"} if k == 0 else {}, block[k * 9 : (k + 1) * 9]) for k in range(3)]
    assert A.reassembled([cut[2], cut[0], cut[1]]) == ({"x": "1"}, block, None)
    assert A.reassembled([cut[0], cut[2]])[2] == A.reassembled([*cut, cut[1]])[2] == "segments are missing or repeated"
    assert A.reassembled(cut[:2])[2] == "the last segment is missing"
    assert A.reassembled([*cut[:2], (3, 99, {}, cut[2][3])])[2] == "total length differs"


def test_chunked_framing():
    for payload in (b"", b"x", bytes(range(256)) * 50):
        assert A.unchunked(A.chunked(payload, 7)) == payload
    assert A.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\n"):
        with pytest.raises(ValueError):
            A.unchunked(broken)


def test_revisits_name_records_that_exist_and_ids_differ(spark, tmp_path):
    rows = pages() + [(1, None, "same"), (9, "u", "x" * 50_000), (9, "u", "x" * 50_000), (9, "v", "x" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    archives = A.write_archives(df, str(tmp_path), segment_bytes=2000)
    ids, refers, origins = [], set(), set()
    for path in (r.path for r in archives.collect()):
        with open(path, "rb") as f:
            for h, _ in A.parse_records(f):
                ids.append(h["warc-record-id"])
                refers |= {h["warc-refers-to"]} if "warc-refers-to" in h else set()
                origins |= {h["warc-segment-origin-id"]} if "warc-segment-origin-id" in h else set()
    assert len(ids) == len(set(ids)) and refers and origins and refers | origins <= set(ids)
    got = A.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    first = {r.record_id: r.page_id for r in got if r.record_type == "response"}
    assert all(r.refers_to in first.values() for r in got if r.record_type == "revisit")


def test_a_revisit_of_an_archive_left_out(spark, tmp_path):
    archives = A.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), str(tmp_path), file_bytes=1)
    kinds = {r.path: [h["warc-type"] for h, _ in A.parse_records(open(r.path, "rb"))] for r in archives.collect()}
    only = [(p,) for p, k in kinds.items() if "revisit" in k]
    got = A.read_archives(spark.createDataFrame(only, "path string")).collect()
    assert got and all(r.refers_to is None and r.error is None for r in got if r.record_type == "revisit")


def test_a_hot_payload_is_not_shuffled_to_one_task(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = A.first_of_payload(df, 0)
    got = A.read_archives(A.write_archives(df)).collect()
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)


class Counted:
    """A file that tells how much of it is asked for at a time."""

    def __init__(self, data):
        import io

        self.f, self.most = io.BytesIO(data), 0

    def read(self, n=-1):
        self.most = max(self.most, n if n >= 0 else 1 << 60)
        return self.f.read(n)


def test_many_members_are_parsed_in_linear_time():
    import time
    import zlib

    rng = random.Random(4)

    def member(k):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        block = rng.randbytes(2000)
        return z.compress(A.record("response", f"urn:x:{k}", [], block)) + z.flush()

    small = b"".join(member(k) for k in range(2000))
    took = []
    for times in (1, 16):  # 4 MB and 64 MB
        f = Counted(small * times)
        began = time.process_time()
        assert sum(1 for _ in A.parse_records(f)) == 2000 * times
        took.append(time.process_time() - began)
        assert f.most <= A.PIECE
    assert took[1] < 40 * took[0]


def test_plain_files_one_member_of_many_records_and_cut_off_files():
    import io
    import zlib

    records = [A.record("response", f"urn:x:{k}", [("X-Page-ID", str(k))], b"b" * k * 40_000) for k in range(5)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    for data in (b"".join(records), z.compress(b"".join(records)) + z.flush()):
        assert [len(b) for _, b in A.parse_records(io.BytesIO(data))] == [k * 40_000 for k in range(5)]
    headers, block = list(A.parse_records(io.BytesIO(b"".join(records)[:-50_000])))[-1]
    assert block is None and A.decoded(headers, block)[-1] == "record is cut off"
    assert list(A.parse_records(io.BytesIO(b""))) == []
