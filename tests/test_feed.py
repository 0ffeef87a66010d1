import json

import pytest

from tessera.sources import feed


def shard(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(b"\n".join(lines))


def record(i):
    return json.dumps({"url": f"u{i}", "text": "t" * (i % 50)}).encode()


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_meet_every_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(feed, "CHUNK", 13)
    lines = [record(i) for i in range(1, 40)] + [b"", b"", b"last"]
    for name, data in (("a", lines), ("b", lines + [b""]), ("c", [b""]), ("d", [b"x"])):
        shard(tmp_path / "feed", name, data)
        size = len(b"\n".join(data))
        got = [x for r in feed._ranges([(name, size)], split) for x in feed._lines(str(tmp_path / "feed"), r)]
        want, at = [], 0
        for line in data:
            want.append((at, line))
            at += len(line) + 1
        assert [x for x in got if x[1]] == [x for x in want if x[1]]


def test_bad_lines_have_a_reason():
    said = [b"{", b"[1]", b"7", b'{"text": "a"}', b'{"url": 3, "text": "a"}', b'{"url": "u", "text": ""}', b'{"url": "u", "text": "a", "more": 1}', "\xff".encode("latin-1")]
    assert [feed._parse(x)[2] for x in said] == ["not JSON", "not an object", "not an object", "no url", "no url", "no text", None, "not JSON"]


def test_stream_starts_again_behind_its_offset(spark, tmp_path):
    path, good, bad, state = (str(tmp_path / x) for x in ("feed", "good", "bad", "state"))
    run = lambda: feed.ingest_stream(feed.stream_feed(spark, path, 100), good, bad, state).awaitTermination()
    shard(tmp_path / "feed", "s1", [record(i) for i in range(1, 11)] + [b"broken"])
    shard(tmp_path / "feed", "_s0", [record(99)])  # not whole yet
    run()
    run()  # nothing new
    count = lambda p: spark.read.parquet(p).count()
    assert (count(good), count(bad)) == (10, 1)
    shard(tmp_path / "feed", "s2", [record(i) for i in range(11, 16)] + [b"{}"])
    run()
    urls = sorted(r["url"] for r in spark.read.parquet(good).collect())
    assert urls == sorted(f"u{i}" for i in range(1, 16)) and count(bad) == 2
    assert {r["raw"] for r in spark.read.parquet(bad).collect()} == {"broken", "{}"}


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "u", "t", None, None), ("s", 9, None, None, "not JSON", "x")], feed.SCHEMA)
    for _ in range(2):
        feed.write_apart(rows, str(tmp_path / "good"), str(tmp_path / "bad"), 3)
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_empty_feed(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    assert feed.read_feed(spark, str(tmp_path / "feed")).count() == 0
