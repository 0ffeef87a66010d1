import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch
from tessera.plans import catalog, connectors
from tessera.sources import tables
from tessera.streaming import jobs


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image":"a","text":"红"}\n\n{"image":"b","text":"x"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "image string, text string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"image":"a","_key":"k"}\n{"image":"b"}\n{"image":\n')
    assert tables.read_cache(spark, str(tmp_path / "b.jsonl"), "image string, _key string").count() == 1
    tables.write_jsonl(spark.range(2), str(tmp_path / "out"))
    tables.write_jsonl(spark.range(1), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_pairs_blobs_and_replace(spark, tmp_path):
    (tmp_path / "p.csv").write_text('url,caption,more\nu1,"a, b",1\n')
    assert tables.read_pairs(spark, str(tmp_path / "p.csv")).collect()[0]["text"] == "a, b"
    blobs = spark.createDataFrame([("1", b"x"), ("1", b"x"), ("2", b"y")], "sha1 string, content binary")
    assert tables.write_new_blobs(blobs, str(tmp_path / "blobs")) == 2 and tables.write_new_blobs(blobs, str(tmp_path / "blobs")) == 0
    for n in (3, 5):
        tables.replace_table(spark.range(n), str(tmp_path / "t"))
        assert tables.read_table(spark, str(tmp_path / "t")).count() == n
    got = tables.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), lambda u: b"1" if u == "ok" else 1 / 0)
    assert sorted((r["url"], r["content"] is None) for r in got.collect()) == [("bad", True), ("ok", False)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "B.JPG").write_bytes(b"x")
    (tmp_path / "img" / "a.txt").write_bytes(b"x")
    assert [r["name"] for r in tables.list_images(spark, str(tmp_path / "img")).collect()] == ["B.JPG"]
    tables.curve_report(spark.createDataFrame([("loss", 1, 2.0), ("loss", 2, 1.0)], "series string, step int, value double"), str(tmp_path / "r.html"))
    assert "polyline" in (tmp_path / "r.html").read_text()


def drain(df, mode="append", name="out"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_online_packing_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate(([5, 4, 3], [9, 1])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"shard": "a", "seq": 3 * k + i, "tokens": t}) for i, t in enumerate(part)))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the stream takes files by age
    stream = spark.readStream.schema("shard string, seq long, tokens long").option("maxFilesPerTrigger", 1).json(str(src))
    got = drain(jobs.online_pack(stream, "shard", "seq", "tokens", 9), "append", "packed")
    assert sorted((r["seq"], r["bin_id"]) for r in got) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_dedup_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text("\n".join(json.dumps({"c": c, "ts": f"2024-01-01T00:{m:02d}:00Z", "v": 1.0}) for c, m in (("x", 1), ("x", 2), ("y", 14))))
    (src / "1.json").write_text(json.dumps({"c": "z", "ts": "2024-01-01T09:00:00Z", "v": 2.0}))
    stream = spark.readStream.schema("c string, ts timestamp, v double").option("maxFilesPerTrigger", 1).json(str(src))
    assert len(drain(jobs.dedup_stream(stream, "c"), "append", "dedup")) == 3
    got = drain(jobs.metric_windows(stream, "ts", "v"), "append", "windows")
    assert sorted(r["n"] for r in got) == [1, 2]


def test_incremental_inference(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text("\n".join(json.dumps({"image": i}) for i in ("a", "b", "a")))
    schema = "image string"
    args = (batch.TASKS["caption"], batch.BACKENDS["echo"](), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    jobs.incremental_inference(spark.readStream.schema(schema).json(str(src)), *args).awaitTermination(120)
    (src / "1.json").write_text("\n".join(json.dumps({"image": i}) for i in ("a", "c")))
    jobs.incremental_inference(spark.readStream.schema(schema).json(str(src)), *args).awaitTermination(120)
    assert sorted(r["image"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "ok")).filter(F.col("_task") == "caption").count() == 3


def test_writers_at_once_lose_no_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: (tables.replace_table(spark.range(n), path, keep=20), n), range(1, 13)))
    assert sorted(v for v, _ in got) == list(range(1, 13))
    for v, n in got:
        assert tables.read_table(spark, path, v).count() == n


def test_commit_only_after_the_expected_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.replace_table(spark.range(1), path, expected=0) == 1
    with pytest.raises(tables.Conflict):
        tables.replace_table(spark.range(2), path, expected=0)
    assert tables.replace_table(spark.range(3), path, expected=1) == 2
    assert tables.replace_table(spark.range(4), path, keep=1) == 3
    assert tables.read_table(spark, path).count() == 4
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path, 2)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_packing_in_order_of_arrival(spark, tmp_path, monkeypatch):
    """The files' ages are against their order, and one source has a document now and then."""
    docs = [(i, "rare" if i % 5000 == 1 else f"s{i % 3}", 4 * (37 * i % 900)) for i in range(20_000)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def write(df, path, append=False, known=tables.write_jsonl):
        known(df, path, append)
        if not append:
            files = sorted((p for p in os.scandir(path.removeprefix("file:")) if p.name.startswith("part-")), key=lambda p: p.name)
            for k, f in enumerate(files):
                os.utime(f.path, (1_700_000_000 - k, 1_700_000_000 - k))

    monkeypatch.setattr(connectors.tables, "write_jsonl", write)
    want, bins = set(), {}
    for i, source, chars in docs:
        tokens = max(1, chars // 4)
        mine = bins.setdefault(source, [[]])
        if mine[-1] and sum(t for _, t in mine[-1]) + tokens > 4000:
            mine.append([])
        mine[-1].append((i, tokens))
    for source, mine in bins.items():
        want |= {(source, k, len(b), sum(t for _, t in b), ",".join(str(i) for i, _ in b)) for k, b in enumerate(mine)}
    got = [tuple(r) for r in catalog.QUERIES["stream_packing_in_order"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
