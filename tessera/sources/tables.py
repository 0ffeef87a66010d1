"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
MIN_IMAGE_BYTES = 5 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines are skipped. Strict: a malformed line fails the query. Else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached results: malformed lines (a run that was cut off) and rows without a key are dropped."""
    return read_jsonl(spark, path, schema, strict=False).filter(F.col("_key").isNotNull())


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_pairs(spark: SparkSession, path: str, url: str = "url", text: str = "caption", sep: str = ",") -> DataFrame:
    """url, text from Parquet (by its suffix) or CSV; only the two columns are read."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)
    return df.select(F.col(url).alias("url"), F.col(text).alias("text"))


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """The same records as a stream; bad rows end up in ``_bad`` instead of stopping it."""
    return spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(path)


def list_images(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """path, name, length (and content) of the images in a folder, sorted by name; none at all is an error."""
    df = spark.read.format("binaryFile").load(folder)
    name = F.substring_index("path", "/", -1)
    ok = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*IMAGE_SUFFIXES)
    df = df.withColumn("name", name).filter(ok).select("path", "name", "length", *(["content"] if with_content else []))
    if df.isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    return df.orderBy("name")


def http_get(url: str, timeout: float = 10.0) -> bytes | None:
    """The body of a URL that answers with status 200 within ``timeout`` seconds, else None."""
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as answer:  # noqa: S310 - the caller's own list of URLs
            return answer.read() if answer.status == 200 else None
    except (OSError, ValueError):
        return None


def fetch(df: DataFrame, get: Callable[[str], bytes | None] = http_get, url: str = "url", workers: int = 32) -> DataFrame:
    """Adds ``content`` by a fetcher (URL -> bytes or None); failures and null URLs give null, nothing is raised.

    Each task fetches with ``workers`` threads, at most twenty URLs a thread ahead, so few bodies are held at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def one(u: str | None) -> bytes | None:
            try:
                return None if u is None else get(u)
            except Exception:  # noqa: BLE001 - any failure of one URL is a miss, as a time-out is
                return None

        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                for at in range(0, len(f), 20 * workers):
                    part = f.iloc[at : at + 20 * workers]
                    yield part.assign(content=list(pool.map(one, part[url])))

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "content")
    return df.drop("content").mapInPandas(run, f"{fields}, content binary")


def transcode(df: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes] | None], content: str = "content") -> DataFrame:
    """Rows whose image is valid, with ``width``, ``height`` and ``content`` as ``decode`` keeps it.

    ``decode`` (bytes -> width, height, bytes, or None) is the caller's image library; what it raises counts as
    undecodable. The size in bytes is checked before, on the built-in path, and the sides after it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data in f[content]:
                try:
                    rows.append(decode(data) or (None, None, None))
                except Exception:  # noqa: BLE001 - whatever the library raises, the image cannot be decoded
                    rows.append((None, None, None))
            width, height, kept = zip(*rows) if rows else ((), (), ())
            yield f.assign(width=pd.array(width, dtype="Int32"), height=pd.array(height, dtype="Int32"), **{content: list(kept)})

    rows = df.filter(F.length(content) >= MIN_IMAGE_BYTES).drop("width", "height")
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    got = rows.mapInPandas(run, f"{fields}, width int, height int")
    return got.filter(valid_image(F.lit(MIN_IMAGE_BYTES), F.col("width"), F.col("height")))


def valid_image(n_bytes: Column, width: Column, height: Column, min_bytes: int = MIN_IMAGE_BYTES, min_side: int = 64) -> Column:
    """Large enough in bytes and on its shorter side; null sizes (undecodable) are not valid."""
    return F.coalesce((n_bytes >= min_bytes) & (F.least(width, height) >= min_side) & width.isNotNull() & height.isNotNull(), F.lit(False))


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_new_blobs(blobs: DataFrame, path: str) -> int:
    """Appends (sha1, content) rows whose sha1 is not stored yet; returns how many.

    The rows are worked out once: they are counted while they are written.
    """
    spark = blobs.sparkSession
    new = blobs.dropDuplicates(["sha1"])
    try:
        new = new.join(spark.read.parquet(path).select("sha1"), "sha1", "left_anti")
    except AnalysisException as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    seen = Observation()
    new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


class Conflict(RuntimeError):
    """Another writer has committed a version since the one that was expected."""


def replace_table(df: DataFrame, path: str, keep: int = 2, expected: int | None = None) -> int:
    """Writes ``df`` as a new version of the table in ``path`` and commits it; returns the version's number.

    A commit is a numbered file that is made only if there is none of that number yet, in one step: of two writers one gets
    the number and the other goes on to the next, so no version is lost and readers see whole versions only. With
    ``expected`` the new version must follow that one (0: no version yet), else there is a ``Conflict`` and nothing changes.
    The newest ``keep`` versions stay, for readers that have begun and for ``read_table`` by number.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    while True:
        version = max(_versions(spark, path), default=0) + 1
        if expected is not None and version != expected + 1 or not _create(spark, f"{path}/_commits", version, folder):
            if expected is None:
                continue
            _delete(spark, f"{path}/{folder}")
            raise Conflict(f"version {expected} of {path} is no longer the newest")
        break
    for old in sorted(_versions(spark, path))[:-keep]:
        name = _committed(spark, path, old)
        _delete(spark, f"{path}/_commits/{old:020d}")
        if name:
            _delete(spark, f"{path}/{name}")
    return version


def _store(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    file, store = _store(spark, path)
    store.delete(file, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, store = _store(spark, f"{path}/_commits")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return [int(n) for n in names if n.isdigit()]


def _create(spark: SparkSession, folder: str, version: int, content: str) -> bool:
    """Makes the file of a version with its content at once; False if there is one."""
    target, store = _store(spark, f"{folder}/{version:020d}")
    fresh, _ = _store(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = store.create(fresh, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if store.getUri().getScheme() == "file":  # where a rename would replace what is there
            os.link(fresh.toUri().getPath(), target.toUri().getPath())
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
            jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        store.delete(fresh, False)


def _committed(spark: SparkSession, path: str, version: int) -> str | None:
    """The folder of a version; None if the version is gone."""
    file, store = _store(spark, f"{path}/_commits/{version:020d}")
    if not store.exists(file):
        return None
    data = store.open(file)
    try:
        return bytes(b & 0xFF for b in iter(data.read, -1)).decode()
    finally:
        data.close()


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table that ``replace_table`` writes, the newest if none is named."""
    number = max(_versions(spark, path), default=0) if version is None else version
    name = _committed(spark, path, number)
    if name is None:
        raise FileNotFoundError(f"no version {number} of a table in {path}" if number else f"no table in {path}")
    return spark.read.parquet(f"{path}/{name}")


def curve_report(points: DataFrame, out: str, title: str = "metrics") -> None:
    """One HTML file of polylines from (series, step, value); the curves of one run, so small enough for the driver."""
    rows = points.orderBy("series", "step").toPandas()
    parts = [f"<!doctype html><meta charset=utf-8><title>{title}</title>"]
    for series, f in rows.groupby("series"):
        lo, hi = f["value"].min(), f["value"].max()
        first, last = f["step"].min(), f["step"].max()
        dots = " ".join(f"{600 * (s - first) / max(1, last - first):.1f},{200 - 200 * (v - lo) / ((hi - lo) or 1):.1f}" for s, v in zip(f["step"], f["value"]))
        parts.append(f"<h3>{series}</h3><svg width=620 height=220><polyline fill=none stroke=black points='{dots}'/></svg>")
    Path(out).write_text("\n".join(parts), encoding="utf-8")
