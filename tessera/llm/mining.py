"""Hard negatives by exact search in k-means inverted lists with stored radii.

Vectors are scaled to integers, so scores are exact and ties are real. The index: centroids are fitted by k-means on a
sample of at most SAMPLE rows; every row goes into the list of its nearest centroid, lists of more than LIST_ROWS rows are
cut by a hash, and each list stores its centroid and its own radius, the largest distance of its rows from it.

For a query x and a list with centroid c and radius r every score lies in x.c - |x| r .. x.c + |x| r (Cauchy-Schwarz). A
query visits the lists in descending order of the upper bound, skips those whose interval lies outside its window of scores,
and stops when the bound falls strictly below its k-th score so far (an equal one could still win by a smaller id). The
bounds are widened by more than their rounding errors, so no result depends on the sample or the fit.

The search runs on tiles: stripes of whole lists (about STRIPE_ROWS rows) meet chunks of CHUNK queries, a task each; the k
best of each query in each stripe are merged. All queries of a tile take their next step together, those that visit the
same list by one product of matrices. Nothing is broadcast but the centroids.

Rows with a null label, a null vector or a null or non-finite component take no part. A row without vec_id may be a
positive or a negative (the last of a tie), never an anchor. Rows that repeat each count; other rows are those with another
vec_id than the anchor's; an anchor whose whole row repeats is one. Shorter vectors are filled up with zeros. An empty
table gives no rows. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

#: Rows that centroids are fitted on, lists at most, rows of a list, rows of a stripe, queries of a chunk, queries of a product.
SAMPLE, MAX_CELLS, ROUNDS = 32_768, 512, 8
LIST_ROWS, STRIPE_ROWS, CHUNK, STEP = 1024, 8192, 8192, 1024
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min

QUERY = "anchor_id long, variant long, p int"


def scaled(v: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, as doubles that hold whole numbers; those of 2**52 and more are whole already."""
    return F.transform(v, lambda x: F.when(F.abs(x.cast("double") * factor) < 2.0**52, F.floor(x.cast("double") * factor).cast("double")).otherwise(x.cast("double") * factor))


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, float) for v in vectors]
    wide = max(map(len, rows), default=0)
    return np.stack([np.pad(r, (0, wide - len(r))) if len(r) < wide else r for r in rows]) if rows else np.empty((0, 0))


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] >= dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as 64-bit integers, exact: in doubles where no sum can reach 2**53, else in integers
    (``visit`` has checked that they fit)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def fit_centroids(rows: DataFrame, n: int, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """K-means on at most ``sample`` of the ``n`` rows, chosen by their hash."""
    order = F.xxhash64(F.lit(seed), "vec_id", "v")
    some = rows if n <= 2 * sample else rows.filter(F.pmod(order, F.lit(n)) < 2 * sample)  # about twice as many as are used
    data = _matrix(r["v"] for r in some.select("v").orderBy(order).limit(sample).collect())
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), min(MAX_CELLS, max(1, len(data) // 64)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(data, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, data)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    dims = max(data.shape[1], centres.shape[1])
    data, centres = _wide(data, dims), _wide(centres, dims)
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(data[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(data), 4096)] or [np.empty(0, np.int64)])


def build_lists(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """stripe, cell, part, ids, labels, matrix, dims, centre, radius: the inverted lists, a row each."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_matrix(v), shared.value), dtype="int32")

    dealt = durable(rows.withColumn("cell", cell("v")))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"))  # at most MAX_CELLS rows
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / LIST_ROWS)).cast("int"))

    def store(f: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(f["v"])
        c = _wide(shared.value[[int(f["cell"].iloc[0])]], m.shape[1])
        m = _wide(m, c.shape[1])
        radius = float(np.sqrt(((m - c) ** 2).sum(axis=1).max())) if m.size else 0.0
        ids = f["vec_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        return pd.DataFrame(
            {"cell": [f["cell"].iloc[0]], "part": [f["part"].iloc[0]], "ids": [ids.tobytes()], "labels": [f["label"].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()], "dims": [m.shape[1]], "centre": [c.tobytes()], "radius": [radius]}
        )

    return dealt.select("cell", "part", "vec_id", "label", "v").groupBy("cell", "part").applyInPandas(store, "cell int, part int, ids binary, labels binary, matrix binary, dims int, centre binary, radius double")


class Lists:
    """The lists of one stripe."""

    def __init__(self, f: pd.DataFrame, dims: int):
        f = f.sort_values(["cell", "part"])
        self.ids = [np.frombuffer(b, np.int64) for b in f["ids"]]
        self.labels = [np.frombuffer(b, np.int64) for b in f["labels"]]
        read = lambda b, d: _wide(np.frombuffer(b).reshape(-1, d) if d else np.empty((len(b), 0)), dims)
        self.rows = [read(b, d) if d else np.zeros((len(i), dims)) for b, d, i in zip(f["matrix"], f["dims"], self.ids)]
        self.centres = np.concatenate([read(b, d) if d else np.zeros((1, dims)) for b, d in zip(f["centre"], f["dims"])])
        self.radii = f["radius"].to_numpy(float)


def visit(lists: Lists, x: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows for each query, descending (LEAST where there are fewer), and the products made.

    A row counts if its label is the query's (``same``) or another one, its id is not ``own``, and its score lies in the
    query's window.
    """
    n = len(x)
    best, ids = np.full((n, k), LEAST, np.int64), np.full((n, k), NO_ID, np.int64)
    norms = np.sqrt((x * x).sum(axis=1))
    middle, reach = x @ lists.centres.T, norms[:, None] * lists.radii[None, :]
    slack = 1e-6 + 1e-9 * (norms[:, None] * np.sqrt((lists.centres**2).sum(axis=1))[None, :] + reach)
    upper, lower = middle + reach + slack, middle - reach - slack
    if max(upper.max(), -lower.min()) >= 2.0**63:
        raise OverflowError("a score may be beyond 64 bits")
    upper[(upper < low[:, None]) | (lower > high[:, None])] = -np.inf  # outside of the window
    order = np.argsort(-upper, axis=1, kind="stable")
    going, made = np.arange(n), 0
    for step in range(order.shape[1]):
        at = order[going, step]
        bound = upper[going, at]
        on = (bound > -np.inf) & ~(bound < best[going, k - 1])
        going, at = going[on], at[on]
        if not len(going):
            break
        turn = np.argsort(at, kind="stable")
        for group in np.split(turn, np.flatnonzero(np.diff(at[turn])) + 1):
            which = int(at[group[0]])
            for part in np.split(going[group], range(STEP, len(group), STEP)):
                s = _products(x[part], lists.rows[which])
                made += s.size
                fits = (lists.labels[which][None, :] == labels[part][:, None]) == same
                fits &= (lists.ids[which][None, :] != own[part][:, None]) & (s >= low[part][:, None]) & (s <= high[part][:, None]) & (s >= best[part, k - 1][:, None])
                some = np.flatnonzero(fits.any(axis=0))
                if len(some):
                    s = np.concatenate([best[part], np.where(fits[:, some], s[:, some], LEAST)], axis=1)
                    i = np.concatenate([ids[part], np.where(fits[:, some], lists.ids[which][some][None, :], NO_ID)], axis=1)
                    first = np.lexsort((i, -np.maximum(s, LEAST + 1)), axis=1)[:, :k]
                    best[part], ids[part] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    return best, ids, made


def search(queries: DataFrame, lists: DataFrame, n_queries: int, n_rows: int, k: int, same: bool) -> DataFrame:
    """anchor_id, variant, p, rank, id, score: the k best rows of each query (QUERY, label, v, low, high)."""
    stripes, chunks = max(1, -(-n_rows // STRIPE_ROWS)), max(1, -(-n_queries // CHUNK))
    left = lists.withColumn("stripe", F.pmod(F.xxhash64("cell", "part"), F.lit(stripes)))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.withColumn("chunk", F.pmod(F.xxhash64("anchor_id", "variant", "p"), F.lit(chunks)).cast("int"))
    right = right.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("stripe", F.col("stripe").cast("long"))

    def tile(f: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("anchor_id", "variant", "p", "id", "score")})
        if not len(f) or not len(q):
            return none
        x = _matrix(q["v"])
        dims = max(x.shape[1], int(f["dims"].max()))
        x = _wide(x, dims)
        best, ids, _ = visit(Lists(f, dims), x, *(q[c].to_numpy(np.int64) for c in ("label", "anchor_id", "low", "high")), k, same)
        row, col = np.nonzero(best > LEAST)
        own = q.iloc[row]
        return pd.DataFrame({"anchor_id": own["anchor_id"].to_numpy(), "variant": own["variant"].to_numpy(), "p": own["p"].to_numpy(), "id": ids[row, col], "score": best[row, col]})

    got = left.groupBy("stripe", "chunk").cogroup(right.groupBy("stripe", "chunk")).applyInPandas(tile, f"{QUERY}, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "variant", "p").orderBy(F.desc("score"), "id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is (vec_id, label, v) with whole numbers in v; ``anchors`` tells which rows are anchors. Negatives score from
    ``low`` to ``high`` hundredths of the positive's score.
    """
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    rows = durable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], empty)
    lists = durable(build_lists(rows, fit_centroids(rows, n)))
    asked = rows.filter(anchors & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "label", "v"])
    asked = asked.select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("variant"), F.lit(0).alias("p"), "label", "v")
    every = asked.withColumns({"low": F.lit(int(LEAST) + 2), "high": F.lit(int(NO_ID))})
    found = durable(search(every, lists, asked.count(), n, positives, True).select("anchor_id", "variant", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    near = F.col("positive_score").cast("decimal(20,0)")
    again = asked.drop("p").join(found, ["anchor_id", "variant"]).select(
        "anchor_id", "variant", "p", "label", "v",
        F.ceil(near * low / 100).cast("long").alias("low"), F.floor(near * high / 100).cast("long").alias("high"),
    )
    again = again.filter("low <= high")
    hard = search(again, lists, found.count(), n, negatives, False)
    out = hard.join(found, ["anchor_id", "variant", "p"])
    known = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return out.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(df: DataFrame) -> DataFrame:
    """The hard negatives of every row whose vec_id is divisible by 100; the labels of one row in seven are shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.filter(F.col("label").isNotNull() & finite(F.col("embedding"))).select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("v"))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
