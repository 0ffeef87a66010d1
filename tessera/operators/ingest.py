"""Dedup, order, split, batches and shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import CleanParams, clean_text
from tessera.sources import tables


def exact_dedup(df: DataFrame, content: Column, order: Column, valid: Column | None = None) -> DataFrame:
    """First valid row (by ``order``) of each content, with its ``sha1``.

    Written as a join with the aggregate min(order) per sha1, which is combined before the shuffle, so many copies of
    one content do not meet in one task. ``order`` must tell rows apart.
    """
    rows = df.withColumn("sha1", F.sha1(content)).withColumn("_ord", order)
    if valid is not None:
        rows = rows.filter(valid)
    first = rows.groupBy("sha1").agg(F.min("_ord").alias("_first"))
    out = rows.join(first.withColumnRenamed("sha1", "_sha1"), (F.col("sha1") == F.col("_sha1")) & (F.col("_ord") == F.col("_first")))
    return out.drop("_ord", "_first", "_sha1")


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """A reproducible random order that does not depend on the input's order."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


#: Rows that are ranked to find the last one of the eval part.
FEW_ROWS = 100_000


def _cut_hash(keys: DataFrame, hashed: str, fraction: float) -> str | None:
    """The last of the max(1, floor(n * fraction)) smallest of the n hexadecimal strings ``hashed``; None of an empty table.

    Rows are counted by the next four digits (at most 65536 sums, which is all that reaches the driver), and the part that
    holds the string is stepped into until few rows are left to rank: one pass up to some billions of rows, and another.
    """
    prefix, rank, left = "", None, None
    while left is None or (left > FEW_ROWS and len(prefix) < 40):
        part = keys.filter(F.col(hashed).startswith(prefix)) if prefix else keys
        counts = part.groupBy(F.substring(hashed, len(prefix) + 1, 4).alias("d")).agg(F.count("*").alias("c")).orderBy("d").collect()
        if rank is None:
            n = sum(r["c"] for r in counts)
            if not n:
                return None
            rank = max(1, int(n * fraction))
        for r in counts:
            if rank <= r["c"]:
                break
            rank -= r["c"]
        prefix, left = prefix + r["d"], r["c"]
    return keys.filter(F.col(hashed).startswith(prefix)).orderBy(hashed).limit(rank).agg(F.max(hashed)).first()[0] if len(prefix) < 40 else prefix


def train_eval_split(df: DataFrame, key: str, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Adds ``split``: the max(1, floor(n * fraction)) first rows of the hash order are eval, none of an empty table.

    The last hash of the eval part is found from sums, so no row is moved: the split is a comparison. Null keys are
    hashed as empty ones. Rows that share the last key are all eval.
    """
    hashed = shuffle_key(F.col(key), seed)
    cut = _cut_hash(df.select(hashed.alias("_h")), "_h", fraction)
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(hashed <= cut, "eval").otherwise("train"))


def take_first(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def ingest(
    df: DataFrame,
    text: str,
    order: str,
    get: Callable[[str], bytes | None] | None = None,
    decode: Callable[[bytes], tuple[int, int, bytes] | None] | None = None,
    content: str = "content",
    n: int | None = None,
    params: CleanParams = CleanParams(),
    fraction: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """Clean, fetch, validate, dedup, cap and split: ``df`` with ``sha1``, ``image`` and ``split``.

    Text filters come before anything that is fetched or moved. With ``get`` the column ``url`` is fetched, else
    ``content`` is there already. With ``decode`` (bytes -> width, height, bytes to keep, or None) small and undecodable
    images go and ``content`` is what it keeps. The sha1 and the dedup are of the bytes as they came; of equal ones the
    first valid row by ``order`` stays. ``n`` keeps the first rows by ``order``.
    """
    rows = df.withColumn(text, clean_text(F.col(text), params)).filter(F.col(text).isNotNull())
    if get is not None:
        rows = tables.fetch(rows, get)
    rows = rows.filter(F.length(content) > 0).withColumn("_raw", F.sha1(content))
    if decode is not None:
        rows = tables.transcode(rows, decode, content)
    rows = exact_dedup(rows, F.col("_raw"), F.col(order)).withColumn("sha1", F.col("_raw")).drop("_raw")
    rows = rows.withColumn("image", F.concat("sha1", F.lit(".jpg")))
    if n is not None:
        rows = take_first(rows, order, n)
    return train_eval_split(rows, order, fraction, seed)


def batches(df: DataFrame, order: Column, size: int, drop_last: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``batch`` and ``pos``: consecutive rows in groups of ``size`` within each value of ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("_i", F.row_number().over(w) - 1)
    out = out.withColumns({"batch": F.floor(F.col("_i") / size).cast("long"), "pos": (F.col("_i") % size).cast("int")})
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).filter(F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")
    return out.drop("_i")


def shards(bins: DataFrame, bin_id: str, world: int) -> DataFrame:
    """Interleaved assignment: bin i goes to rank i mod world."""
    return bins.withColumn("rank", (F.col(bin_id) % world).cast("int"))


def newest_checkpoints(names: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` files with the largest step numbers, as numbers; names without a step are left out."""
    from tessera.functions.text import checkpoint_step

    return names.withColumn("step", checkpoint_step(F.col("name"))).filter(F.col("step").isNotNull()).orderBy(F.desc("step"), "name").limit(keep)
