"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: The separators between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: The same as a word pattern.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot from this many rows and this share of all rows on, so that there are at most HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores is dealt over all of them, since the work on texts is in the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(table(spark, sf_dir, "documents"))


def word_array(text: Column) -> Column:
    """The words of a text in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def clean_words(text: Column) -> Column:
    """``word_array`` without the pass over the array: the outer separators go first.

    One empty string stands for a text without words.
    """
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), SPACE)


def word_count(text: Column) -> Column:
    """The number of words as long."""
    return F.size(word_array(text)).cast("long")


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int | None = None) -> DataFrame:
    """big joined with small on ``keys``; ``small`` has each key once, and in ``rows`` its number of rows of ``big``.

    Keys with HOT_ROWS rows and a HOT_SHARE-th of all are at most HOT_SHARE, so they are broadcast and their rows stay
    where they are; the others are joined by a shuffle that no key makes uneven. ``total`` is the number of rows of ``big``
    where that is known.
    """
    total = big.count() if total is None else total
    if total < HOT_ROWS:
        return big.join(small, keys)  # no key can be hot
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(small.filter(F.col(rows) >= least))  # at most HOT_SHARE keys
    cold = big.join(hot.select(*keys), keys, "left_anti").join(small.filter(F.col(rows) < least), keys)
    return big.join(hot, keys).select(*cold.columns).unionByName(cold)
