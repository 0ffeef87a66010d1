"""All pairs of two tables of vectors, a tile at a time.

Both sides are packed into blocks of at most BLOCK_ROWS near vectors: a row of Spark each, with the ids, the matrix, the
centre and the radius (the largest distance of a vector from the centre). For vectors a + d and c + e of blocks with centres
a, c and radii r, s the inner product is at most a.c + |a| s + |c| r + r s and at least a.c - |a| s - |c| r - r s
(Cauchy-Schwarz), widened here by more than the rounding errors. ``plan`` tells from the centres and radii alone which
blocks have to meet. Both sides are dealt into stripes of about STRIPE blocks, and ``meet`` brings a stripe of the one and a
stripe of the other together in a task, so a block is moved once for each stripe of the other side, not for each block of it.
Nothing passes through the driver but row counts and the sample that the cells of near vectors are fitted on, and no table is
broadcast but those centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable, release

#: Vectors of a block, blocks of a stripe (of vectors of 64 numbers; fewer of longer ones), descriptions of blocks that one
#: task compares, tasks to aim at while blocks last.
BLOCK_ROWS, STRIPE, GROUP, TASKS = 1024, 64, 1024, 32
#: Blocks from which the k best are first sought in one of them.
SEEDED = 16
#: Cells of near vectors, and the most vectors they are fitted on.
MAX_CELLS, SAMPLE = 256, 20_000
DIGITS = 12
BLOCK = "block long, n int, dims int, ids binary, m binary, need binary, centre binary, radius double, least double"


def fit_cells(df: DataFrame, v: str, n: int, n_cells: int, seed: int = 42, rounds: int = 6) -> np.ndarray:
    """Centres of near vectors by k-means on at most SAMPLE vectors, which their hash picks."""
    order = F.xxhash64(F.lit(seed), F.col(v))
    some = df if n <= 2 * SAMPLE else df.filter(F.pmod(order, F.lit(n)) < 2 * SAMPLE)
    data = np.array([r[0] for r in some.select(v).orderBy(order).limit(SAMPLE).collect()], float)
    centres = data[np.random.default_rng(seed).choice(len(data), min(n_cells, len(data)), replace=False)]
    for _ in range(rounds):
        near = nearest(data, centres)
        sizes = np.bincount(near, minlength=len(centres))[:, None]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(data @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def pack(df: DataFrame, id: str, v: str, n: int, need: Column | None = None) -> DataFrame:
    """The blocks of a table of ``n`` rows; ``need`` is a score of each row, ``least`` the least of a block's.

    Up to BLOCK_ROWS rows are one block; else rows go to the cell of the nearest centre, and cells of more rows are dealt out.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), (F.lit(float("-inf")) if need is None else need).alias("need")).filter("v is not null")  # without a vector nothing is near
    if n > BLOCK_ROWS:
        shared = df.sparkSession.sparkContext.broadcast(fit_cells(rows, "v", n, min(MAX_CELLS, -(-n // BLOCK_ROWS))))  # at most MAX_CELLS vectors

        @F.pandas_udf("long")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(nearest(np.stack(v.to_numpy()), shared.value) if len(v) else [], dtype="int64")

        raw = rows = durable(rows.withColumn("cell", cell("v")))
        sizes = rows.groupBy("cell").agg(F.count("*").alias("k"))  # at most MAX_CELLS rows
        rows = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("k") / BLOCK_ROWS)))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(f["v"].to_numpy()).astype(float)
        need, centre = f["need"].to_numpy(float), m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))
        return pd.DataFrame([(f["block"].iloc[0], len(f), m.shape[1], f["id"].to_numpy(np.int64).tobytes(), m.tobytes(), need.tobytes(), centre.tobytes(), radius, float(need.min()))], columns=[x.split()[0] for x in BLOCK.split(", ")])

    blocks = rows.select("block", "id", "v", "need").groupBy("block").applyInPandas(one, BLOCK)
    if n > BLOCK_ROWS:  # several readers
        blocks = durable(blocks)
        release(raw)
    return blocks


class Side:
    """Blocks that are in a task."""

    def __init__(self, f: pd.DataFrame):
        dims = int(f["dims"].iloc[0])
        self.blocks = f["block"].to_numpy()
        self.centres = np.stack([np.frombuffer(b) for b in f["centre"]])
        self.radii, self.least = f["radius"].to_numpy(float), f["least"].to_numpy(float)
        if "m" in f:
            self.ids = [np.frombuffer(b, np.int64) for b in f["ids"]]
            self.m = [np.frombuffer(b).reshape(-1, dims) for b in f["m"]]
            self.need = [np.frombuffer(b) for b in f["need"]]

    def one(self, j: int) -> Side:
        """Block ``j`` alone."""
        got = copy(self)
        for name, x in vars(self).items():
            setattr(got, name, x[j : j + 1])
        return got


def bounds(a: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of vectors within r of the rows of a and within s of the rows of c, with a margin."""
    na, nc = np.sqrt((a * a).sum(axis=1))[:, None], np.sqrt((c * c).sum(axis=1))[None, :]
    reach = na * s[None, :] + nc * r[:, None] + r[:, None] * s[None, :]
    reach = reach + 1e-9 * (na * nc + reach) + 10.0**-DIGITS
    middle = a @ c.T
    return middle - reach, middle + reach


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under names of their own, as a table may meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


Keep = Callable[[Side, Side], np.ndarray]


def plan(left: DataFrame, right: DataFrame, n_left: int, n_right: int, keep: Keep, best: bool = False) -> DataFrame:
    """lblock, rblock: the blocks that have to meet, where ``keep`` of their descriptions is true.

    ``best``: of these only the one with the largest ``keep`` for each left block. Descriptions are compared in groups of
    about GROUP; the vectors stay where they are.
    """
    if max(n_left, n_right) <= BLOCK_ROWS:  # one block a side
        return left.sparkSession.range(1).select(F.lit(0).cast("long").alias("lblock"), F.lit(0).cast("long").alias("rblock"))
    meta = lambda df, groups: df.select("block", "dims", "centre", "radius", "least", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    gl, gr = (max(1, -(-n // (GROUP * BLOCK_ROWS))) for n in (n_left, n_right))
    a = meta(left, gl).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(gr - 1)))).withColumn("h", F.col("h").cast("long"))
    b = meta(right, gr).withColumnRenamed("g", "h").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(gl - 1)))).withColumn("g", F.col("g").cast("long"))

    def choose(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"lblock": [], "rblock": [], "worth": []})
        p, q = Side(x), Side(y)
        got = keep(p, q)
        if best:
            i, j = np.arange(len(got)), np.argmax(got, axis=1)
        else:
            i, j = np.nonzero(got)
        return pd.DataFrame({"lblock": p.blocks[i], "rblock": q.blocks[j], "worth": got[i, j].astype(float)})

    pairs = a.groupBy("g", "h").cogroup(_apart(b).groupBy("g", "h")).applyInPandas(choose, "lblock long, rblock long, worth double")
    if best:
        pairs = pairs.groupBy("lblock").agg(F.max_by("rblock", "worth").alias("rblock"))
    return pairs.select("lblock", "rblock")


def deal(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> tuple[int, int]:
    """Numbers of stripes of both sides: as few as memory allows, but enough for TASKS tasks, moving as little as possible."""
    if max(n_left, n_right) <= BLOCK_ROWS:
        return 1, 1
    known = (left if n_left >= n_right else right).select("dims").first()
    rows = max(BLOCK_ROWS, STRIPE * BLOCK_ROWS * 64 // max(64, known["dims"] if known else 64))
    a, b, most_a, most_b = (max(1, -(-n // size)) for size in (rows, BLOCK_ROWS) for n in (n_left, n_right))
    while a * b < TASKS and (a < most_a or b < most_b):
        if b < most_b and (a >= most_a or a * n_right >= b * n_left):  # one more on the right moves the left side once more
            b += 1
        else:
            a += 1
    return a, b


def meet(left: DataFrame, right: DataFrame, stripes: tuple[int, int], run: Callable[[Side, Side], Iterator[dict]], schema: str, pairs: DataFrame | None = None) -> DataFrame:
    """What ``run`` gives for each stripe of left blocks and each stripe of right blocks.

    With ``pairs`` (lblock, rblock) only blocks of pairs come, each to the stripes it has a pair in; a task may then hold
    blocks that are no pair.
    """
    stripe = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    if pairs is None:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = left.withColumn("l", stripe("block", stripes[0])).withColumn("r", every(stripes[1]))
        b = right.withColumn("r", stripe("block", stripes[1])).withColumn("l", every(stripes[0]))
    else:
        known = pairs.withColumn("l", stripe("lblock", stripes[0])).withColumn("r", stripe("rblock", stripes[1]))
        a = left.join(known.select(F.col("lblock").alias("block"), "l", "r").distinct(), "block")
        b = right.join(known.select(F.col("rblock").alias("block"), "l", "r").distinct(), "block")
    b = _apart(b)
    tasks = stripes[0] * stripes[1]
    if tasks > 1:  # more partitions than tasks, so that few tasks share one
        a, b = (x.repartition(3 * tasks, "l", "r") for x in (a, b))
    names = [x.split()[0] for x in schema.split(", ")]

    def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame(f, columns=names) for f in run(Side(x), Side(y))] if len(x) and len(y) else []
        return pd.concat(made) if made else pd.DataFrame({c: [] for c in names})

    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInPandas(tile, schema)


def within_reach(a: Side, b: Side) -> np.ndarray:
    """Blocks that may hold a score of at least what some row of the left block needs."""
    return bounds(a.centres, a.radii, b.centres, b.radii)[1] >= a.least[:, None]


def either_within_reach(a: Side, b: Side) -> np.ndarray:
    """The same for some row of either block."""
    most = bounds(a.centres, a.radii, b.centres, b.radii)[1]
    return (most >= a.least[:, None]) | (most >= b.least[None, :])


def _nearest_block(a: Side, b: Side) -> np.ndarray:
    return bounds(a.centres, a.radii, b.centres, b.radii)[1]


def _slack(x: np.ndarray) -> np.ndarray:
    """More than rounding to DIGITS can move a score that lies near x."""
    return 2 * 10.0**-DIGITS + 1e-15 * np.abs(x)


def keep_best(best: np.ndarray, ids: np.ndarray, least: np.ndarray, s: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of ``best`` and of the scores ``s`` with the ids ``other``; ties by the smaller id.

    Scores below ``least`` cannot be among them. Only those that can be are rounded and sorted.
    """
    hit = s >= (least - _slack(least))[:, None]
    if s.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(s):
        least = np.fmax(least, np.partition(s, -k, axis=1)[:, -k])
        hit = s >= (least - _slack(least))[:, None]
    row, col = np.divmod(np.flatnonzero(hit), s.shape[1])  # faster than nonzero where few are
    some, at = np.unique(row, return_inverse=True)
    at = np.concatenate([np.repeat(np.arange(len(some)), k), at])
    score = np.concatenate([best[some].ravel(), np.round(s[row, col], DIGITS)])
    id = np.concatenate([ids[some].ravel(), other[col]])
    order = np.lexsort((id, -score, at))
    first = np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(k)  # every row has k or more
    best[some], ids[some] = score[order][first], id[order][first]
    return best, ids


def _best_of_block(a: Side, b: Side, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of the right blocks for each row of the one left block, -inf where there are fewer.

    The blocks are visited in the order of their bounds; rows whose k-th score, or need, lies above a bound stay out of the
    product, and when none is left the rest is not visited.
    """
    m, need = a.m[0], a.need[0]
    best, ids = np.full((len(m), k), -np.inf), np.full((len(m), k), np.iinfo(np.int64).max)
    upper = bounds(m, np.zeros(len(m)), b.centres, b.radii)[1]
    for j in np.argsort(-upper.max(axis=0), kind="stable"):
        least = np.maximum(best[:, k - 1], need)
        rows = np.flatnonzero(upper[:, j] >= least)
        if len(rows):
            best[rows], ids[rows] = keep_best(best[rows], ids[rows], least[rows], m[rows] @ b.m[j].T, b.ids[j], k)
    return best, ids


def top_k(left: DataFrame, right: DataFrame, n_left: int, n_right: int, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best rows of ``right`` (blocks) for each row of ``left`` (blocks).

    Where there are many blocks, each left block first meets the one block with the largest bound; its k-th scores are
    what other blocks must be able to reach. Only blocks that can reach the least of them meet after that.
    """
    stripes = deal(left, right, n_left, n_right)
    if n_right > SEEDED * BLOCK_ROWS:

        def first(a: Side, b: Side) -> Iterator[dict]:
            near = np.argmax(_nearest_block(a, b), axis=1)
            for i, j in enumerate(near):
                need = _best_of_block(a.one(i), b.one(j), k)[0][:, k - 1]
                yield {"block": a.blocks[i : i + 1], "need": [need.tobytes()], "least": [float(need.min())]}

        seeds = plan(left, right, n_left, n_right, _nearest_block, best=True)
        known = meet(left, right, stripes, first, "block long, need binary, least double", seeds)
        left = durable(left.drop("need", "least").join(known, "block"))

    def run(a: Side, b: Side) -> Iterator[dict]:
        for i in range(len(a.blocks)):
            best, ids = _best_of_block(a.one(i), b, k)
            row, col = np.nonzero(best > -np.inf)
            yield {"query_id": a.ids[i][row], "vec_id": ids[row, col], "score": best[row, col]}

    found = meet(left, right, stripes, run, "query_id long, vec_id long, score double", plan(left, right, n_left, n_right, within_reach))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _better(s: np.ndarray, need: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many scores of each row lie above its need, or equal it with a smaller id; only those near it are rounded."""
    low, high = need - _slack(need), need + _slack(need)
    n, near = (np.count_nonzero(x, axis=1) for x in (s > high[:, None], s >= low[:, None]))
    open = np.flatnonzero(n != near)
    row, col = np.nonzero((s[open] >= low[open, None]) & (s[open] <= high[open, None]))
    row = open[row]
    exact, own = np.round(s[row, col], DIGITS), need[row]
    yes = (other[col] != mine[row]) & ((exact > own) | ((exact == own) & (other[col] < mine[row])))
    return n + np.bincount(row[yes], minlength=len(s))


def count_better(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """side, i, better: how many rows of the other side score above the ``need`` of row i, or equal it with a smaller id than
    i, for the rows of ``left`` (side 0) and of ``right`` (side 1); a score counts for both.

    Blocks that cannot reach the least need of each other do not meet; rows that a block cannot reach stay out of the product.
    """

    def run(a: Side, b: Side) -> Iterator[dict]:
        of_right = [np.zeros(len(x), np.int64) for x in b.ids]
        reach = lambda m, x: bounds(m, np.zeros(len(m)), x.centres, x.radii)[1]
        col_reach = [reach(m, a) for m in b.m]
        for i, (m, need, own) in enumerate(zip(a.m, a.need, a.ids)):
            better, row_reach = np.zeros(len(m), np.int64), reach(m, b)
            for j in range(len(b.blocks)):
                rows, cols = np.flatnonzero(row_reach[:, j] >= need), np.flatnonzero(col_reach[j][:, i] >= b.need[j])
                if len(rows) and len(cols):
                    s = m @ b.m[j].T
                    better += _better(s, need, own, b.ids[j])
                    of_right[j] += _better(s.T, b.need[j], b.ids[j], own)
                elif len(rows):
                    better[rows] += _better(m[rows] @ b.m[j].T, need[rows], own[rows], b.ids[j])
                elif len(cols):
                    of_right[j][cols] += _better(b.m[j][cols] @ m.T, b.need[j][cols], b.ids[j][cols], own)
            yield {"side": np.zeros(len(own), np.int32), "i": own, "better": better}
        for ids, better in zip(b.ids, of_right):
            yield {"side": np.ones(len(ids), np.int32), "i": ids, "better": better}

    found = meet(left, right, deal(left, right, n_left, n_right), run, "side int, i long, better long", plan(left, right, n_left, n_right, either_within_reach))
    return found.groupBy("side", "i").agg(F.sum("better").alias("better"))


State = tuple[np.ndarray, np.ndarray]


def _join_states(a: State, b: State) -> State:
    """The state of two parts of the same lines."""
    top = np.maximum(a[0], b[0])
    return top, np.exp(a[0] - top) * a[1] + np.exp(b[0] - top) * b[1]


def line_states(left: DataFrame, right: DataFrame, n_left: int, n_right: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], log: bool) -> DataFrame:
    """side, line, total: the sum of ``value`` (scores, row ids, column ids) along each row (side 0) and column (side 1).

    ``log``: the values are logarithms, and so is the total. A tile then hands on the largest value of each line and the sum
    of the exponentials below it; such pairs are merged by rescaling to the larger maximum, so that no bound of the values
    is needed and none overflows. Else rows and columns whose ``need`` is 0 are not summed over, but have sums of their own.
    """

    def state(x: np.ndarray, axis: int, need: np.ndarray) -> State:
        if not log:
            if not need.all():
                x = np.compress(need != 0, x, axis=axis)
            s = x.sum(axis=axis)
            return np.zeros(len(s)), s
        top = x.max(axis=axis)
        return top, np.exp(x - np.expand_dims(top, axis)).sum(axis=axis)

    def run(a: Side, b: Side) -> Iterator[dict]:
        none = lambda ids: (np.full(len(ids), -np.inf if log else 0.0), np.zeros(len(ids)))
        cols = [none(ids) for ids in b.ids]
        for m, ids, need in zip(a.m, a.ids, a.need):
            row = none(ids)
            for j in range(len(b.blocks)):
                x = value(m @ b.m[j].T, ids[:, None], b.ids[j][None, :])
                row, cols[j] = _join_states(row, state(x, 1, b.need[j])), _join_states(cols[j], state(x, 0, need))
            yield {"side": np.zeros(len(ids), np.int32), "line": ids, "top": row[0], "s": row[1]}
        for ids, (top, s) in zip(b.ids, cols):
            yield {"side": np.ones(len(ids), np.int32), "line": ids, "top": top, "s": s}

    part = meet(left, right, deal(left, right, n_left, n_right), run, "side int, line long, top double, s double")
    whole = part.withColumn("most", F.max("top").over(Window.partitionBy("side", "line")))  # one state a tile; the sum needs no second shuffle
    total = F.sum(F.col("s") * F.exp(F.col("top") - F.col("most")))
    return whole.groupBy("side", "line").agg((F.max("most") + F.log(total) if log else total).alias("total"))
