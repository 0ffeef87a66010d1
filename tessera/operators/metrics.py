"""Training logs: curves, running means, repeated steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "step int, loss double, lr double, tau double, bias double, grad_norm double, samples_per_s double, eval map<string,double>, final_eval map<string,double>"


def last_of_step(rows: DataFrame, order: str) -> DataFrame:
    """One row a step: the last by ``order``."""
    w = Window.partitionBy("step").orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def training_curve(log: DataFrame, order: str) -> DataFrame:
    """step and the training fields, one row a step; what the log calls samples_per_s counts micro-batches."""
    rows = last_of_step(log.filter(F.col("loss").isNotNull()), order)
    return rows.select("step", "loss", "lr", "tau", "bias", "grad_norm", F.col("samples_per_s").alias("micro_batches_per_s"))


def evaluation_curve(log: DataFrame) -> DataFrame:
    """step, metric, value of the rows without a loss."""
    got = log.filter(F.col("loss").isNull()).select("step", F.explode(F.coalesce("eval", "final_eval")).alias("metric", "value"))
    return got


def running_mean(rows: DataFrame, value: str, every: int) -> DataFrame:
    """log_step, value: the mean between log points, steps (k-1)*every+1 .. k*every."""
    bucket = (F.ceil(F.col("step") / every) * every).cast("long")
    return rows.groupBy(bucket.alias("log_step")).agg(F.round(F.avg(value), 6).alias("value"))


def mean_of_means(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """The mean over ranks of each rank's mean, which is not the mean of all rows."""
    return rows.groupBy(rank).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("value"))


def padded(counts: DataFrame) -> DataFrame:
    """Adds ``padding``: what each row's ``n`` lacks of the largest."""
    return counts.withColumn("padding", counts.agg(F.max("n")).scalar() - F.col("n"))


def counts_by_rank(rows: DataFrame, rank: str) -> DataFrame:
    """rank, n, padding up to the largest rank."""
    return padded(rows.groupBy(rank).agg(F.count("*").alias("n")))
