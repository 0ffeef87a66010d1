"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet in the shared folder and
reads it again as the next stage's ``docs``. All but the last return the columns of ``documents``. An empty table goes through
all stages and gives an empty result; null texts and texts without words are scored like others, are like no other text,
hold no secret and are not taken by the mix; rows with null ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dup, packing, quality, secrets
from tessera.llm.common import table
from tessera.session import durable, release, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages go through tokenizers, fitted models and iterations that SQL cannot express.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the cut go. Empty texts are scored like others, repeated rows stay
    repeated; without labels every document has the score 0.5 and stays."""
    ship(spark)
    described = durable(quality.describe(docs))
    model = quality.fit(described, table(spark, sf_dir, "labels"))
    release(described)
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("score") >= quality.CUT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each class stays.

    Of rows with the same id and text one stays; rows whose text has no words, and rows without an id, all stay.
    """
    ship(spark)
    keep = near_dup.classes(docs).filter(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    rest = docs.select(*COLUMNS).join(keep, F.col("doc_id") == F.col("_gone"), "left_anti")
    return rest.dropDuplicates(["doc_id", "text"]) if _repeats(rest) else rest


def _repeats(docs: DataFrame) -> bool:
    """Whether any id occurs twice."""
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is not null and n > 1").limit(1).count())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span, by rule or by the randomness battery, is replaced by a mark. Every row stays; n_chars is
    that of the new text where a span was found."""
    ship(spark)
    found = secrets.scan(docs, keep=("doc_id", "text", "lang", "source", "n_chars"))
    new = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select("doc_id", new.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each copy the mix takes, in the order of training.

    A document that the mix takes in part is taken whole: its source is over its target by less than one document.
    """
    ship(spark)
    planned = mixing.plan(docs, carry=("text", "lang", "n_chars"))
    rows = mixing.schedule(planned)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, "time", "doc_id").sortWithinPartitions("time", "doc_id", "copy").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the place of every piece of every copy. A repeated row is packed as often as it occurs."""
    ship(spark)
    return packing.op6(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = durable(stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
