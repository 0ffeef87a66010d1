"""Judged pairs -> triplets: first P positives, hardest K negatives, anchors that lack either go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class TripletParams:
    positives: int = 2
    negatives: int = 4
    default_positive: float = 0.95
    default_negative: float = 0.05
    default_conf: float = 0.5


def label_of(label: Column, positive: str = "相关") -> Column:
    return F.when(label == positive, 1).otherwise(0)


def with_defaults(df: DataFrame, p: TripletParams = TripletParams()) -> DataFrame:
    """Missing scores and confidences by label."""
    score = F.coalesce("teacher_score", F.when(F.col("label") == 1, p.default_positive).otherwise(p.default_negative))
    return df.withColumns({"teacher_score": score, "conf": F.coalesce("conf", F.lit(p.default_conf))})


def mine(df: DataFrame, order: list[Column], p: TripletParams = TripletParams()) -> DataFrame:
    """Rows (image, text, label, teacher_score, conf, pos) of anchors that have both kinds, positives first.

    ``order`` is the input order and must tell rows apart. One shuffle by image: both ranks and both counts are windows
    over the same partitioning.
    """
    rows = with_defaults(df, p)
    both = Window.partitionBy("image")
    rows = rows.withColumns({"_pos": F.sum("label").over(both), "_n": F.count("*").over(both)}).filter((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    rank = F.row_number().over(Window.partitionBy("image", "label").orderBy(F.when(F.col("label") == 0, -F.col("teacher_score")), *order))
    rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= F.when(F.col("label") == 1, p.positives).otherwise(p.negatives))
    n_pos = F.least(F.col("_pos"), F.lit(p.positives))
    pos = F.when(F.col("label") == 1, F.col("_rank") - 1).otherwise(n_pos + F.col("_rank") - 1).cast("int")
    return rows.withColumn("pos", pos).drop("_pos", "_n", "_rank")


def nest(rows: DataFrame) -> DataFrame:
    """image, candidates: the nested record, in order."""
    entry = F.struct("pos", "text", "label", "teacher_score", "conf")
    got = rows.groupBy("image").agg(F.array_sort(F.collect_list(entry)).alias("c"))  # at most positives + negatives entries
    return got.select("image", F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["label"].alias("label"), c["teacher_score"].alias("teacher_score"), c["conf"].alias("conf"))).alias("candidates"))


def flatten(triplets: DataFrame) -> DataFrame:
    return triplets.select("image", F.posexplode("candidates").alias("pos", "c")).select("image", "pos", "c.*")


def truncate_to_batch_minimum(rows: DataFrame, batch: str, anchor: str = "image", pos: str = "pos") -> DataFrame:
    """Keeps in each batch as many candidates an anchor as its smallest anchor has."""
    k = F.count("*").over(Window.partitionBy(batch, anchor))
    least = F.min("_k").over(Window.partitionBy(batch))
    return rows.withColumn("_k", k).withColumn("_kmin", least).filter(F.col(pos) < F.col("_kmin")).drop("_k", "_kmin")
