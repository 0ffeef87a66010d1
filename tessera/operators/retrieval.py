"""Similarity, exact and approximate top-k, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tessera.functions.vectors import dot, l2_normalise
from tessera.operators import tiles
from tessera.session import durable


#: Vectors, and queries, of one part of a cell of the approximate search.
CELL_ROWS = 10_000


def similarities(left: DataFrame, right: DataFrame, batch: str) -> DataFrame:
    """batch, i, j, s of (i, u) and (j, v): the square matrix of every evaluation batch, in long form.

    An equal-key join on the batch; a batch is of a fixed number of ids, so the rows grow with the ids.
    """
    return left.join(right, batch).select(batch, "i", "j", dot(F.col("u"), F.col("v")).alias("s"))


def candidate_similarities(anchors: DataFrame, candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``candidates`` (anchor, pos, text, ...) with ``s``, the cosine of the anchor's and the text's vectors.

    ``anchors`` is (anchor, v), ``texts`` (text, v). Two equal-key joins on columns of vectors, each vector normalised
    once; candidates whose anchor or text has no vector go.
    """
    a = anchors.select("anchor", l2_normalise(F.col("v")).alias("_a"))
    t = texts.select("text", l2_normalise(F.col("v")).alias("_t"))
    return candidates.join(t, "text").join(a, "anchor").withColumn("s", dot(F.col("_a"), F.col("_t"))).drop("_a", "_t")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, normalise: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products, ties by the smaller id; scores are compared at 12 digits.

    Any number of queries: both sides are cut into blocks of near vectors, and only those tiles are worked through that can
    hold one of the k best (see ``tiles``).
    """
    n, m = queries.count(), corpus.count()
    if not n or not m:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return tiles.top_k(tiles.pack(_unit(queries, "query_id", normalise), "query_id", "v", n), tiles.pack(_unit(corpus, "vec_id", normalise), "vec_id", "v", m), n, m, k)


def _unit(df: DataFrame, id: str, normalise: bool = True) -> DataFrame:
    return df.select(id, (l2_normalise(F.col("v")) if normalise else F.col("v")).alias("v"))


def top_k_both_ways(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """side, query_id, vec_id, rank, score: the k best of each row (``i2t``) and of each column (``t2i``) of the table of
    similarities of (i, u) and (j, v), which is never made as a whole; ties by the smaller id."""
    n, m = left.count(), right.count()
    if not n or not m:
        return left.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int, side string")
    a = tiles.pack(_unit(left.withColumnRenamed("u", "v"), "i"), "i", "v", n)
    b = tiles.pack(_unit(right, "j"), "j", "v", m)
    rows = tiles.top_k(a, b, n, m, k).withColumn("side", F.lit("i2t"))
    return rows.unionByName(tiles.top_k(b, a, m, n, k).withColumn("side", F.lit("t2i")))


@F.pandas_udf(DoubleType())
def _score(u: pd.Series, v: pd.Series) -> pd.Series:
    """The inner product of two vectors as the tiles work it out, to 12 digits."""
    return pd.Series([round(float(np.dot(a, b)), tiles.DIGITS) for a, b in zip(u, v)], dtype="float64")


def complete_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """i, u, v of the ids that both sides have."""
    return left.join(right, F.col("i") == F.col("j")).select("i", F.col("u").cast("array<double>").alias("u"), F.col("v").cast("array<double>").alias("v"))


def recall_at_k(left: DataFrame, right: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """metric, value: R@k both ways and hit@5 for (i, u) and (j, v) of any number of pairs; gold is i = j.

    The rank of gold is one plus the number of better ones (ties: smaller index first), so nothing is sorted; tiles whose
    scores all lie below the gold scores of their rows are not worked through. Names use k clipped to n; no rows for an
    empty table. Scores are compared at 12 digits.
    """
    spark = left.sparkSession
    gold = complete_pairs(left, right).withColumn("own", _score("u", "v"))
    n = gold.count()
    if n == 0:
        return spark.createDataFrame([], "metric string, value double")
    gold = durable(gold) if n > tiles.BLOCK_ROWS else gold
    clipped = sorted({min(k, n) for k in ks})
    images, texts = (tiles.pack(gold, "i", c, n, F.col("own")) for c in ("u", "v"))
    ranks = tiles.count_better(images, texts, n, n).withColumn("side", F.when(F.col("side") == 0, "i2t").otherwise("t2i"))
    share = lambda k: F.round(F.avg((F.col("better") < k).cast("double")), 4)
    wide = ranks.groupBy("side").agg(*[share(k).alias(f"r{k}") for k in clipped])
    named = [F.struct(F.concat("side", F.lit(f"_R@{k}")).alias("metric"), F.col(f"r{k}").alias("value")) for k in clipped]
    hit = F.struct(F.lit("hit@5").alias("metric"), F.col("r5" if 5 in clipped else f"r{clipped[0]}").alias("value"))
    rows = F.when(F.col("side") == "i2t", F.array(*named, hit)).otherwise(F.array(*named))
    return wide.select(F.inline(rows))


def train_cells(corpus: DataFrame, n_cells: int, seed: int = 42, sample: int = 100_000, rounds: int = 10) -> np.ndarray:
    """Centres of an inverted-list index, fitted by k-means on at most ``sample`` vectors (a documented bound)."""
    rows = corpus.filter("v is not null").select(l2_normalise(F.col("v")).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col("v"))).limit(sample).collect()
    data = np.array([r["v"] for r in rows], float)
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), min(n_cells, len(data)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(data @ centres.T, axis=1)
        for c in range(len(centres)):
            mine = data[near == c]
            if len(mine):
                m = mine.mean(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def ann_top_k(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """Approximate top-k: every vector is listed in its nearest cell, a query looks into its ``probes`` nearest cells.

    Vectors and queries of a cell are parts of about CELL_ROWS; each pair of parts is multiplied as matrices in a task, which
    hands on the k best of each of its queries.
    """
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def cells(n: int):
        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            s = np.stack(v.to_numpy()).astype(float) @ shared.value.T if len(v) else np.empty((0, 0))
            return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return near

    def listed(df: DataFrame, id: str, n: int) -> DataFrame:
        rows = df.filter("v is not null").select(F.col(id).cast("long").alias(id), l2_normalise(F.col("v")).alias("v"))
        return rows.withColumn("cell", F.explode(cells(n)("v")))

    def parts(df: DataFrame, name: str) -> DataFrame:  # a row a centre
        return F.broadcast(df.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name)))

    q, c = listed(queries, "query_id", probes), listed(corpus, "vec_id", 1)
    sizes = parts(q, "shares").join(parts(c, "parts"), "cell")
    part = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(F.broadcast(sizes), "cell").withColumn("share", part("query_id", "shares")).withColumn("part", every("parts"))
    c = c.join(F.broadcast(sizes), "cell").withColumn("part", part("vec_id", "parts")).withColumn("share", every("shares"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        step = tiles.BLOCK_ROWS
        for lo in range(0, len(x) if len(y) else 0, step):
            ids, u = x["query_id"].to_numpy()[lo : lo + step], np.stack(x["v"].iloc[lo : lo + step].to_numpy()).astype(float)
            score, found = np.full((len(u), k), -np.inf), np.full((len(u), k), np.iinfo(np.int64).max)
            for at in range(0, len(y), step):
                v = np.stack(y["v"].iloc[at : at + step].to_numpy()).astype(float)
                score, found = tiles.keep_best(score, found, score[:, k - 1], u @ v.T, y["vec_id"].to_numpy()[at : at + step], k)
            row, col = np.nonzero(score > -np.inf)
            made.append(pd.DataFrame({"query_id": ids[row], "vec_id": found[row, col], "score": score[row, col]}))
        return pd.concat(made)

    keys = ["cell", "part", "share"]
    got = q.select("query_id", "v", *keys).groupBy(*keys).cogroup(c.select("vec_id", "v", *keys).groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)
