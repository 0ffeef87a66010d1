"""Queries of the readers, writers and streams: each goes through files in the shared folder and reads them back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import batch, ingest, regions
from tessera.plans.catalog import query, table
from tessera.session import shared_dir
from tessera.sources import feed, tables
from tessera.streaming import jobs, ordered


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


_SAID = "conv_id long, turn int, role string, text string"


@query("SELECT conv_id, turn, role, sha1(text) AS sha1 FROM conversations WHERE text IS NOT NULL")
def jsonl_round_trip(spark, sf):
    path = _folder(spark)
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_jsonl(c.filter("conv_id % 2 = 0"), path)
    tables.write_jsonl(c.filter("conv_id % 2 <> 0"), path, append=True)
    return tables.read_jsonl(spark, path, _SAID).select("conv_id", "turn", "role", F.sha1(F.col("text").cast("binary")).alias("sha1"))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def tolerant_cache(spark, sf):
    """One line in five is cut off, one in seven has no key."""
    path = _folder(spark)
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise(', "_key": "k"'))
    table(spark, sf, "events").select(F.concat(whole, F.when(F.col("event_id") % 5 == 0, "").otherwise("}")).alias("value")).write.text(path)
    return tables.read_cache(spark, path, "event_id long, _key string").select("event_id")


@query("SELECT CAST(page_id AS VARCHAR) AS url, url AS text, kind FROM pages, (VALUES ('csv'), ('parquet')) t(kind)")
def pairs_round_trip(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("u"), F.col("url").alias("c"), F.lit("more").alias("m"))
    parts = []
    for kind in ("csv", "parquet"):
        path = f"{_folder(spark)}.{kind}"
        if kind == "csv":
            pages.write.option("header", True).option("escape", '"').csv(path)
        else:
            pages.write.parquet(path)
        parts.append(tables.read_pairs(spark, path, "u", "c").withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


@query("SELECT r_name || '.jpg' AS name, CAST(length(r_name) AS BIGINT) AS length FROM region")
def image_folder(spark, sf):
    """One file a region, and one that is no image."""
    path = _folder(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [r["r_name"] for r in table(spark, sf, "region").collect()] + ["note"]:  # five rows
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.{'txt' if name == 'note' else 'jpg'}"))
        out.write(bytearray(name.encode()))
        out.close()
    return tables.list_images(spark, path).select("name", "length")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE sha1('body of ' || page_id) END AS sha1 FROM pages")
def fetched(spark, sf):
    def get(url: str) -> bytes | None:
        n = int(url.rpartition("/")[2])
        return None if n % 6 == 0 else b"body of %d" % n if n % 3 else 1 // 0

    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("url"))
    return tables.fetch(pages, get).select("page_id", F.sha1("content").alias("sha1"))


@query(
    """SELECT page_id, sha1(repeat(CAST(page_id % 40 AS VARCHAR) || '.', 2000)) AS sha1 FROM pages WHERE page_id % 40 >= 10 AND page_id % 40 % 3 <> 0 AND (page_id % 40) * 8 >= 64
    QUALIFY row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) = 1"""
)
def whole_ingest(spark, sf):
    """Fetch, size rule, decoding, side rule, dedup; what is fetched depends on the id modulo 40, so most are copies."""

    def get(url: str) -> bytes:
        return (url + ".").encode() * 2000

    def decode(data: bytes) -> tuple[int, int, bytes] | None:
        n = int(data.split(b".", 1)[0])
        return None if n % 3 == 0 else (n * 8, 4000, data[:10])

    rows = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 40).cast("string").alias("url"), F.lit("a caption of the page").alias("caption"))
    return ingest.ingest(rows, "caption", "page_id", get, decode).select("page_id", "sha1")


@query("SELECT doc_id, lang FROM documents")
def split_sink(spark, sf):
    path = _folder(spark)
    tables.write_split(table(spark, sf, "documents").select("doc_id", "lang", F.col("lang").alias("split")), path)
    return spark.read.schema("doc_id long, lang string, split string").json(path).filter("lang = split").select("doc_id", "lang")


@query("SELECT sha1, count(*) AS n FROM (SELECT DISTINCT sha1(event_type || '|' || (user_id % 50)) AS sha1 FROM events) GROUP BY sha1")
def new_blobs(spark, sf):
    """Two runs over overlapping halves: each content is stored once."""
    path = _folder(spark)
    e = table(spark, sf, "events").select(F.concat_ws("|", "event_type", (F.col("user_id") % 50).cast("string")).cast("binary").alias("content"), "event_id").withColumn("sha1", F.sha1("content"))
    tables.write_new_blobs(e.filter("event_id % 3 > 0").select("sha1", "content"), path)
    tables.write_new_blobs(e.filter("event_id % 3 < 2").select("sha1", "content"), path)
    return spark.read.parquet(path).groupBy("sha1").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def replaced_table(spark, sf):
    path = _folder(spark)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    for part in (n.filter("n_nationkey < 3"), n):
        tables.replace_table(part, path)
    return tables.read_table(spark, path)


@query("SELECT CAST(v AS INTEGER) AS version, n_nationkey FROM nation, range(3, 6) t(v) WHERE n_nationkey < v * 5")
def table_versions(spark, sf):
    """Five commits, of which the newest three stay and are read by number."""
    path = _folder(spark)
    nation = table(spark, sf, "nation").select("n_nationkey")
    for v in range(1, 6):
        tables.replace_table(nation.filter(F.col("n_nationkey") < v * 5), path, keep=3, expected=v - 1)
    parts = [tables.read_table(spark, path, v).withColumn("version", F.lit(v)) for v in (3, 4, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey AS region, 'part ' || p_partkey AS expr, CAST(floor(0.25 * p_size) AS INTEGER) AS x1, CAST(floor(0.5 * 480) AS INTEGER) AS y1 FROM part ORDER BY p_partkey LIMIT 20")
def box_table(spark, sf):
    part = table(spark, sf, "part")
    region = F.struct(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("expr"), F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.lit(0.5).alias("conf"), F.array(F.lit("other")).alias("hard"))
    train = part.select(F.col("p_partkey").alias("image"), F.array(region).alias("regions"))
    sizes = part.select(F.col("p_partkey").alias("image"), F.col("p_size").alias("width"), F.lit(480).alias("height"))
    got = regions.box_report(train, sizes)
    return got.select(F.col("image").alias("region"), "expr", F.get("box", F.lit(0)).alias("x1"), F.get("box", F.lit(1)).alias("y1"))


def _drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files there are now, as a table."""
    spark = df.sparkSession
    path = _folder(spark)
    run = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _arrivals(spark, sf, name: str, schema: str, rows: DataFrame) -> DataFrame:
    path = _folder(spark)
    tables.write_jsonl(rows, path)
    return tables.stream_jsonl(spark, path, schema)


@query("SELECT DISTINCT sha1(event_type || user_id) AS sha1 FROM events")
def stream_dedup(spark, sf):
    rows = table(spark, sf, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("content"))
    return _drain(jobs.dedup_stream(_arrivals(spark, sf, "events", "content string", rows), "content").select("sha1"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, n_chars // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    b AS (SELECT source, r, doc_id, tokens, 0::BIGINT AS bin_id, tokens AS fill FROM d WHERE r = 1
      UNION ALL
      SELECT d.source, d.r, d.doc_id, d.tokens, CASE WHEN b.fill + d.tokens > 4000 THEN b.bin_id + 1 ELSE b.bin_id END,
             CASE WHEN b.fill + d.tokens > 4000 THEN d.tokens ELSE b.fill + d.tokens END
      FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1) SELECT doc_id, bin_id FROM b"""
)
def stream_packing(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens")).coalesce(1)
    stream = _arrivals(spark, sf, "documents", "source string, doc_id long, tokens long", rows)
    return _drain(jobs.online_pack(stream, "source", "doc_id", "tokens", 4000)).select("doc_id", "bin_id")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, n_chars // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    b AS (SELECT source, r, doc_id, tokens, 0::BIGINT AS bin_id, tokens AS fill FROM d WHERE r = 1
      UNION ALL
      SELECT d.source, d.r, d.doc_id, d.tokens, CASE WHEN b.fill + d.tokens > 4000 THEN b.bin_id + 1 ELSE b.bin_id END,
             CASE WHEN b.fill + d.tokens > 4000 THEN d.tokens ELSE b.fill + d.tokens END
      FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1)
    SELECT source, bin_id, count(*) AS n_items, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items FROM b GROUP BY 1, 2"""
)
def stream_packing_in_order(spark, sf):
    """A second a document; each comes up to 300 places late or early, in many files and micro-batches. The last file is a
    heartbeat. No bin is closed by a pause, however long a source has none: the stream may be idle as long as all its documents take."""
    path = _folder(spark)
    docs = table(spark, sf, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens"), F.timestamp_seconds(F.col("doc_id") + 86_400).alias("at"))
    arrival = F.floor((F.col("doc_id") + F.pmod(F.xxhash64("doc_id"), F.lit(300))) / 250)
    tables.write_jsonl(docs.repartitionByRange(8, arrival, F.xxhash64("doc_id", F.lit(1))), path)
    _come_in_order(spark, path)
    first, last = docs.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at"))).first()
    idle = 60 + (0 if last is None else last - first)
    beat = spark.range(1 if last is not None else 0).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tokens"), F.timestamp_seconds(F.lit((last or 0) + 2000 + idle)).alias("at"))
    tables.write_jsonl(beat, path, append=True)
    stream = tables.stream_jsonl(spark, path, "source string, doc_id long, tokens long, at timestamp", files_per_batch=2)
    with ordered.state_store(spark):
        bins = _drain(ordered.pack_in_order(stream, "source", "doc_id", "tokens", "at", 4000, "1000 seconds", idle * 1000))
    return bins.select("source", "bin_id", "n_items", "tokens", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def _come_in_order(spark, path: str) -> None:
    """Files of a folder get ages in the order of their names, a second apart: a stream takes files by age, and tasks that
    write at the same time end in any order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    named = lambda: sorted((f for f in store.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    files = named()
    start = min([int(time.time() * 1000), *(f.getModificationTime() for f in files)]) - 1000 * len(files)
    for k, f in enumerate(files):
        store.setTimes(f.getPath(), start + 1000 * k, -1)
    ages = [f.getModificationTime() for f in named()]
    if any(a >= b for a, b in zip(ages, ages[1:])):
        raise ValueError(f"the store of {path} keeps no modification times: a stream would take its files in any order")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS image FROM events WHERE length('Describe the image in detail. [' || user_id || ']') >= 20")
def stream_inference(spark, sf):
    ok, bad = _folder(spark), _folder(spark)
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image"))
    stream = _arrivals(spark, sf, "events", "image string", rows).select("image")
    jobs.incremental_inference(stream, batch.TASKS["caption"], batch.BACKENDS["echo"](), ok, bad, f"{ok}-state").awaitTermination()
    return spark.read.parquet(ok).select("image")


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1),
    last AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM events)
    SELECT CAST(epoch(w) AS BIGINT) AS window_start, n, mean FROM w, last WHERE w + INTERVAL 1 HOUR <= mark"""
)
def stream_windows(spark, sf):
    """Windows that the watermark has passed are final."""
    rows = table(spark, sf, "events").select("ts", "value")
    stream = _arrivals(spark, sf, "events", "ts timestamp, value double", rows)
    return _drain(jobs.metric_windows(stream, "ts", "value", "1 hour")).select(F.unix_timestamp("window_start").alias("window_start"), "n", F.round("mean", 6).alias("mean"))


def _shard_rows(spark, sf):
    """Lines of a feed: one in seven turns is cut off, one in five has no URL."""
    c = table(spark, sf, "conversations")
    url = F.when(c["turn"] % 5 == 4, F.lit(None)).otherwise(F.concat(F.lit("https://example.org/"), c["conv_id"].cast("string"), F.lit("/"), c["turn"].cast("string")))
    line = F.to_json(F.struct(url.alias("url"), F.concat_ws(" ", "role", c["turn"].cast("string")).alias("text")))
    return c.select("conv_id", F.when((c["conv_id"] + c["turn"]) % 7 == 0, F.substring(line, 1, 10)).otherwise(line).alias("value"))


_FEED = """WITH l AS (SELECT conv_id, turn, (conv_id + turn) % 7 = 0 AS cut, turn % 5 = 4 AS none FROM conversations),
    r AS (SELECT conv_id, turn, CASE WHEN cut THEN 'not JSON' WHEN none THEN 'no url' ELSE 'good' END AS kind FROM l)"""


@query(f"{_FEED} SELECT kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN kind = 'good' THEN conv_id * 100 + turn END), 0) AS BIGINT) AS ids FROM r GROUP BY 1")
def feed_batch(spark, sf):
    """A feed in shards that are read in ranges of 4000 bytes."""
    path = _folder(spark)
    _shard_rows(spark, sf).select("value").repartition(3).write.text(path)
    rows = feed.read_feed(spark, path, 4000)
    place = F.split(F.regexp_replace("url", "https://example.org/", ""), "/")
    ids = F.get(place, F.lit(0)).cast("long") * 100 + F.get(place, F.lit(1)).cast("long")
    return rows.groupBy(F.coalesce("error", F.lit("good")).alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("error").isNull(), ids)), F.lit(0)).alias("ids"))


@query(f"{_FEED} SELECT kind, CAST(conv_id % 2 AS INTEGER) AS run, count(*) AS n FROM r GROUP BY 1, 2")
def feed_stream(spark, sf):
    """Two runs of one stream with a checkpoint: the second begins behind the shards of the first. Good rows are fetched,
    bad ones are in quarantine; the run is told by the batch."""
    path, good, bad, state = (_folder(spark) for _ in range(4))
    rows = _shard_rows(spark, sf)
    fetch = lambda df: tables.fetch(df, lambda url: url.encode())
    for run in (0, 1):
        part = f"{path}-{run}"
        rows.filter(F.col("conv_id") % 2 == run).select("value").repartition(2).write.text(part)
        _add_shards(spark, part, path, f"run{run}")
        feed.ingest_stream(feed.stream_feed(spark, path, 4000), good, bad, state, fetch).awaitTermination()
    whole = spark.read.parquet(good).filter(F.col("content") == F.col("url").cast("binary")).select(F.lit("good").alias("kind"), "batch")
    rows = whole.unionByName(spark.read.parquet(bad).select(F.col("error").alias("kind"), "batch"))
    return rows.groupBy("kind", F.col("batch").cast("int").alias("run")).agg(F.count("*").alias("n"))


def _add_shards(spark, part: str, path: str, name: str) -> None:
    """Moves the files of a folder into the feed under names of their own."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    store = paths(part).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(paths(path))
    for f in store.listStatus(paths(part)):
        if f.getPath().getName().startswith("part-"):
            store.rename(f.getPath(), paths(f"{path}/{name}-{f.getPath().getName()}"))
