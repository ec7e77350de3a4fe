"""Archives that other tools write, against the records that went in; even tiles of the exact search."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from taxospark.llm import topk, warc


def record(i, payload, kind="response", newline=b"\r\n\r\n"):
    body = payload if kind == "warcinfo" else b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + newline


def records(seed, sizes=(0, 1, 10, 300_000, 70_000, 5, 65_536)):
    rng = random.Random(seed)
    return [(i, rng.randbytes(n) + b"\r\n\r\n" * (i % 2)) for i, n in enumerate(sizes)]


def archives(folder, rows):
    made = [record(i, p) for i, p in rows]
    info = record("info", b"software: none\r\n\r\n", "warcinfo")
    whole = info + b"".join(made)
    (folder / "plain.warc").write_bytes(whole)
    (folder / "one.warc.gz").write_bytes(gzip.compress(whole))
    (folder / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, [info, *made])))
    (folder / "torn.warc.gz").write_bytes(b"".join(gzip.compress(whole[k : k + 50_000]) for k in range(0, len(whole), 50_000)))
    (folder / "last.warc").write_bytes(whole.rstrip(b"\r\n") if not whole.endswith(b"\r\n" * 4) else whole)


@pytest.mark.parametrize("payload", [True, False])
def test_records_however_they_are_dealt_to_members(spark, tmp_path, payload):
    rows = records(1)
    archives(tmp_path, rows)
    got = warc.read_warc(spark, str(tmp_path), payload).collect()
    for name in ("plain.warc", "one.warc.gz", "each.warc.gz", "torn.warc.gz", "last.warc"):
        own = [r for r in got if r["file"].endswith(name)]
        assert len(own) == len(rows) + 1, name
        assert {(r["record_id"], r["payload_bytes"], bytes(r["payload"]) if payload else r["payload"]) for r in own if r["record_type"] == "response"} == {(f"urn:page:{i}", len(p), p if payload else None) for i, p in rows}, name
    one = warc.read_warc(spark, str(tmp_path / "one.warc.gz"), payload).where(F.col("target_uri") == "http://h/4").collect()
    assert [r["record_id"] for r in one] == ["urn:page:4"]


def test_no_silence(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"x" * 50)[:-30])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(1, b"x" * 5000))[:-40])
    (tmp_path / "c.warc").write_bytes(b"no archive at all\r\n\r\n")
    (tmp_path / "d.txt").write_bytes(record(1, b"x"))
    for name in ("a.warc", "b.warc.gz", "c.warc", "d.txt"):
        with pytest.raises(Exception):
            warc.read_warc(spark, str(tmp_path / name)).collect()
    (tmp_path / "only").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "only")).count() == 0
    (tmp_path / "only" / "e.gz").write_bytes(b"")
    with pytest.raises(Exception):
        warc.read_warc(spark, str(tmp_path / "only")).collect()


def test_tiles_are_even(spark, monkeypatch):
    """64 partitions of one block each, four tiles: the blocks of a tile are near the bound."""
    monkeypatch.setattr(topk, "TILE_BLOCKS", 16)
    rows = spark.range(64, numPartitions=64).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), F.lit(1).alias("v"), F.lit(2).alias("bt"))
    got = topk.top_k(rows, rows.where("vec_id % 16 = 0"), 3).collect()
    for q in (0, 16, 32, 48):
        want = sorted(((-(256 * q * 256 * c + 65536), c) for c in range(64) if c != q))[:3]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(c, -s) for s, c in want]
    ids = spark.createDataFrame([(int(i).to_bytes(8, "little"),) for i in range(512)], "ids binary")
    seen = [r["count"] for r in ids.groupBy(F.pmod(F.xxhash64("ids"), F.lit(4).cast("long"))).count().collect()]
    assert len(seen) == 4 and max(seen) < 2 * 512 / 4
