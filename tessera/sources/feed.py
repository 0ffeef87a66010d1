"""A feed of image-text records as a Spark data source, for batch and for streams, and a sink that sets bad rows apart.

A feed is a folder of shards in any store that pyarrow knows (``file:``, ``s3:``, ``gs:``, ``hdfs:``): files of one JSON
object a line with a URL and a text. A shard is whole once it is listed, and later shards have later names.

* Partitions are planned on the driver from the listing alone: shards are cut at ``split_bytes``, and a line belongs to the
  range that it begins in, so that ranges meet no line twice and none is lost.
* A stream's offset is the name of the last shard it took. It is kept in the query's checkpoint: after a restart the next
  micro-batch begins behind it, and a batch that was not committed is read again from the same shards.
* A line that is no object, or lacks a URL or a text, stops nothing: its row has ``error`` and the line as ``raw``.
  ``write_apart`` puts such rows into a quarantine table; a micro-batch that runs again replaces its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.session import ship

FORMAT = "caption_feed"
SCHEMA = "shard string, at long, url string, text string, error string, raw string"
SPLIT_BYTES = 32 << 20
CHUNK, ROWS = 1 << 20, 4096


@dataclass
class Range(InputPartition):
    shard: str
    begin: int
    end: int


def _shards(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the shards, in order; names with a leading dot or underscore are not shards yet."""
    store, folder = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _ranges(shards: list[tuple[str, int]], split: int) -> list[Range]:
    return [Range(name, at, min(at + split, size)) for name, size in shards for at in range(0, size, split)]


def _lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line that begins in the range; a chunk and a line are held at once."""
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/{part.shard}") as f:
        at = max(0, part.begin - 1)  # a line begins after a line feed, so the byte before tells
        f.seek(at)
        held, skip = b"", part.begin > 0
        while True:
            chunk = f.read(CHUNK)
            held += chunk
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif at >= part.end:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if not chunk:
                if held and not skip and at < part.end:
                    yield at, held
                return


def _parse(line: bytes) -> tuple[str | None, str | None, str | None]:
    """url, text, error of a line."""
    try:
        record = json.loads(line)
    except ValueError:
        return None, None, "not JSON"
    if not isinstance(record, dict):
        return None, None, "not an object"
    url, text = (record.get(k) if isinstance(record.get(k), str) and record.get(k) else None for k in ("url", "text"))
    return url, text, None if url and text else "no url" if not url else "no text"


def _batches(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("error", pa.string()), ("raw", pa.string())])
    rows: list[tuple] = []
    for at, line in _lines(path, part):
        if line.strip():
            url, text, error = _parse(line)
            rows.append((part.shard, at, url, text, error, line.decode(errors="replace") if error else None))
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


class FeedReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return _ranges(_shards(self.path), self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.shard else iter(())


class FeedStream(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in _shards(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        new = [(name, size) for name, size in _shards(self.path) if start["after"] < name <= end["after"]]
        return _ranges(new, self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.shard else iter(())

    def commit(self, end: dict) -> None:
        """Shards are the feed's own and stay; the query's checkpoint holds the offset."""


class CaptionFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_feed(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(CaptionFeed)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)


def stream_feed(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(CaptionFeed)
    return spark.readStream.format(FORMAT).option("split_bytes", split_bytes).option("path", path).load()


def write_apart(rows: DataFrame, good: str, bad: str, batch: int = 0, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Rows without an error go to the table ``good`` (through ``change``, such as a fetch), the others to ``bad``.

    Both are kept in a folder a batch, which is replaced if the same batch is written again.
    """
    rows = rows.persist()
    fine = rows.filter("error is null").select("shard", "at", "url", "text")
    (fine if change is None else change(fine)).write.mode("overwrite").parquet(f"{good}/batch={batch}")
    rows.filter("error is not null").select("shard", "at", "error", "raw").write.mode("overwrite").parquet(f"{bad}/batch={batch}")
    rows.unpersist()


def ingest_stream(stream: DataFrame, good: str, bad: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that takes all shards there are into the two tables and ends; run again, it takes the new ones."""

    def step(df: DataFrame, batch: int) -> None:
        write_apart(df, good, bad, batch, change)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
