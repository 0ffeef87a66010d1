"""Contrastive, triplet and distillation losses as aggregates over long similarity tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, sigmoid, softplus_neg
from tessera.operators import tiles
from tessera.operators.metrics import padded
from tessera.session import durable


def _log_sum_exp(x: Column, bound: float) -> Column:
    """Aggregate: log of the sum of exp(x). ``bound`` is the known most of x (scale times a cosine of 1), so that no pass
    for the maximum is needed; values up to 700 beyond it are right too."""
    return bound + F.log(F.sum(F.exp(x - bound)))


def info_nce(sims: DataFrame, scale: float) -> DataFrame:
    """loss: mean of the cross-entropies along rows and along columns of scale * s, gold on the diagonal; 0 rows if empty.

    One pass: each similarity counts for its row and for its column, summed before the shuffle.
    """
    line = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("line")), F.struct(F.lit(1).alias("side"), F.col("j").alias("line"))))
    rows = sims.select(line.alias("l"), (F.col("s") * scale).alias("x"), (F.col("i") == F.col("j")).alias("gold"))
    per = rows.groupBy("l").agg(_log_sum_exp(F.col("x"), scale).alias("lse"), F.max(F.when(F.col("gold"), F.col("x"))).alias("g"))
    return per.agg(F.avg(F.col("lse") - F.col("g")).alias("loss")).filter("loss is not null")


def pairwise_sigmoid(sims: DataFrame, log_scale: float, bias: float, valid: Column | None = None) -> DataFrame:
    """loss: sum over valid pairs of -log sigmoid(z (exp(log_scale) s + bias)), z = 1 on the diagonal, over the queries.

    Both directions are the same sum over a square table, so their mean is that sum over the number of queries.
    """
    rows = sims if valid is None else sims.filter(valid)
    z = F.when(F.col("i") == F.col("j"), 1.0).otherwise(-1.0)
    per = softplus_neg(z * (F.exp(F.lit(log_scale)) * F.col("s") + bias))
    n = F.count_distinct(F.when(F.col("i") == F.col("j"), F.col("i")))
    return rows.agg((F.sum(per) / F.greatest(n, F.lit(1))).alias("loss")).filter("loss is not null")


def _lines(pairs: DataFrame, keys: DataFrame, value, log: bool) -> DataFrame:
    """Each pair of ``pairs`` (i, u, v, own, ...) with ``totals``: its row's and its column's total over ``keys``."""
    n, m = pairs.count(), keys.count()
    texts = pairs.join(keys, "i", "left_semi")
    states = tiles.line_states(tiles.pack(pairs, "i", "u", n), tiles.pack(texts, "i", "v", m), n, m, value, log)
    both = states.groupBy("line").agg(*[F.max(F.when(F.col("side") == k, F.col("total"))).alias(name) for k, name in ((0, "row"), (1, "col"))])
    return pairs.join(both, F.col("i") == F.col("line"))


def batch_info_nce(pairs: DataFrame, scale: float) -> DataFrame:
    """loss: ``info_nce`` of one batch of any size; ``pairs`` is (i, u, v), and every u meets every v.

    The similarities are never rows: a tile hands on the largest logit and the scaled sum of each of its lines, so the
    result is that of one softmax over the whole line whatever the tiles, the scale and the size. No row if empty.
    """
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], "loss double")
    got = _lines(pairs, pairs.select("i"), lambda s, i, j: s * scale, True)
    return got.agg(F.avg((F.col("row") + F.col("col")) / 2 - scale * dot(F.col("u"), F.col("v"))).alias("loss"))


def batch_sigmoid(pairs: DataFrame, log_scale: float, bias: float, rank: str | None = None, valid: Column | None = None) -> DataFrame:
    """loss (with ``rank``: rank, n, padding, loss): the pairwise sigmoid loss of one batch of any size.

    Every row of a rank meets the keys of all ranks, in both directions; its loss is the sum over its rows divided by their
    number, whatever the numbers of the other ranks. Padding up to the largest rank is only counted, as no padded key is
    ever made. Keys that are not ``valid`` are left out; their rows still ask.
    """
    spark, column = pairs.sparkSession, [] if rank is None else [rank]
    if pairs.isEmpty():
        kinds = "" if rank is None else f"`{rank}` {dict(pairs.dtypes)[rank]}, n long, padding long, "
        return spark.createDataFrame([], f"{kinds}loss double")
    key = F.lit(1.0) if valid is None else F.when(valid, 1.0).otherwise(0.0)
    factor = float(np.exp(log_scale))

    def value(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = factor * s + bias
        gold = i == j
        if gold.any():
            x[gold] = -x[gold]
        rest = np.abs(x)
        np.exp(np.negative(rest, out=rest), out=rest)
        return np.maximum(x, 0, out=x) + np.log1p(rest, out=rest)

    rows = pairs.select("i", "u", "v", *column, key.alias("_key"))
    n = rows.count()
    rows = durable(rows) if n > tiles.BLOCK_ROWS else rows
    # images ask texts and texts ask images: the rows and the columns of one table
    sums = tiles.line_states(tiles.pack(rows, "i", "u", n, F.col("_key")), tiles.pack(rows, "i", "v", n, F.col("_key")), n, n, value, False)
    per = sums.groupBy("line").agg((F.sum("total") / 2).alias("total"))
    if rank is None:
        return per.agg((F.coalesce(F.sum("total"), F.lit(0.0)) / F.lit(n)).alias("loss"))
    ranks = rows.select("i", rank).join(per, F.col("i") == F.col("line"), "left").groupBy(rank).agg(F.count("*").alias("n"), (F.coalesce(F.sum("total"), F.lit(0.0)) / F.count("*")).alias("loss"))
    return padded(ranks).select(rank, "n", "padding", "loss")


def triplet_loss(cands: DataFrame, margin: float = 0.2, anchor: str = "anchor") -> DataFrame:
    """loss: mean over anchors with both kinds of relu(margin + hardest negative - mean positive); 0 without any."""
    pos, neg = F.col("label") == 1, F.col("label") != 1
    per = cands.groupBy(anchor).agg(F.avg(F.when(pos, F.col("s"))).alias("p"), F.max(F.when(neg, F.col("s"))).alias("n"))
    one = F.greatest(margin + F.col("n") - F.col("p"), F.lit(0.0))
    return per.agg(F.coalesce(F.avg(F.when(F.col("p").isNotNull() & F.col("n").isNotNull(), one)), F.lit(0.0)).alias("loss"))


def distillation_loss(cands: DataFrame, alpha: float = 5.0, beta: float = -1.0, weight: Column | None = None) -> DataFrame:
    """loss: weighted mean of (sigmoid(alpha s + beta) - teacher)^2; the weights' sum is at least 1e-6."""
    w = F.lit(1.0) if weight is None else weight
    se = F.pow(sigmoid(alpha * F.col("s") + beta) - F.col("teacher_score"), F.lit(2.0))
    return cands.agg((F.coalesce(F.sum(w * se), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1e-6))).alias("loss"))


def combined_loss(triplet: DataFrame, distill: DataFrame, lambda_triplet: float = 1.0, lambda_distill: float = 0.5) -> DataFrame:
    """l_triplet, l_distill, loss of two one-row tables."""
    rows = triplet.select(F.col("loss").alias("l_triplet"), F.lit(1).alias("_k")).join(distill.select(F.col("loss").alias("l_distill"), F.lit(1).alias("_k")), "_k").drop("_k")
    return rows.withColumn("loss", lambda_triplet * F.col("l_triplet") + lambda_distill * F.col("l_distill"))


def many_way_loss(cands: DataFrame, scale: float, region: str = "region") -> DataFrame:
    """loss: mean over regions of the cross-entropy of scale * s over its candidates, candidate 0 is gold."""
    x = F.col("s") * scale
    per = cands.groupBy(region).agg(_log_sum_exp(x, scale).alias("lse"), F.max(F.when(F.col("pos") == 0, x)).alias("g"))
    return per.agg(F.avg(F.col("lse") - F.col("g")).alias("loss")).filter("loss is not null")


def total_region_loss(l_global: Column, l_region: Column, l_hard: Column, region_weight: float = 0.1, hard_weight: float = 0.5) -> Column:
    return l_global + region_weight * l_region + hard_weight * l_hard
