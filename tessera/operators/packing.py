"""Bins under a token budget, and the offsets of packed rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ingest import shuffle_key
from tessera.session import durable

#: Rows of a pack group that one task passes through.
PART_ROWS = 1_000_000


def next_fit_ids(tokens: np.ndarray, budget: int) -> np.ndarray:
    """Bin number of each item in order: a bin closes when the next item would exceed the budget and it is not empty.

    Where a bin starts decides where it ends, so the starts are a chain of binary searches in the running sums: one step
    per bin, not per item.
    """
    sums = np.concatenate(([0], np.cumsum(tokens.astype(np.int64))))
    n, start, out, b = len(tokens), 0, np.empty(len(tokens), np.int64), 0
    while start < n:
        end = int(np.searchsorted(sums, sums[start] + budget, "right")) - 1
        end = max(end, start + 1)
        out[start:end] = b
        start, b = end, b + 1
    return out


def next_fit(df: DataFrame, group: str, order: str, tokens: str, budget: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``bin_id`` (from 0 in each group) by next fit in ``order``; ``order`` must tell the rows of a group apart.

    A group is cut into ranges of about ``part_rows`` rows, so that one group is many tasks. What a range does depends on
    the fill of the open bin on entry alone, and two runs agree from their first common bin start on. So each range is
    first mapped: the possible first bin starts are its first rows, up to one budget, and for each of them the number of
    bins that end in the range and the fill on exit are worked out, once a distinct chain. These maps are small; they are
    composed in order per group, and then every range is numbered from its true entry.
    """
    key = F.struct(F.col(group).isNull().alias("n"), F.col(group).alias("g"))
    rows = _ranged(df, [group, order], part_rows).withColumn("_g", key)
    entry = _entries(rows, order, tokens, budget)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    names = [*df.columns]
    got = rows.join(entry, ["_g", "_part"])

    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        fill, first = int(f["_fill"].iloc[0]), int(f["_bin"].iloc[0])
        items = f[tokens].to_numpy().astype(np.int64)
        if fill < 0:  # nothing before this range
            ids = next_fit_ids(items, budget)
        else:
            ids = next_fit_ids(np.concatenate(([fill], items)), budget)[1:]
        return f[names].assign(bin_id=first + ids)

    return got.groupBy("_g", "_part").applyInPandas(number, f"{fields}, bin_id long")


def _ranged(df: DataFrame, by: list[str], part_rows: int) -> DataFrame:
    """Adds ``_part``: the number of the row's range, ascending in the columns ``by``.

    The ranges come from a sample, so they are written once: both readers see the same ones.
    """
    n_parts = -(-df.count() // part_rows)
    if n_parts <= 1:
        return df.withColumn("_part", F.lit(0))
    return durable(df.repartitionByRange(n_parts, *by).withColumn("_part", F.spark_partition_id()))


def _entries(rows: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """_g, _part, _fill (of the open bin on entry, -1 before the first range) and _bin (its number)."""

    def chart(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        items = f[tokens].to_numpy().astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(items)))
        n = len(items)
        # where the first bin that begins in this range may begin: any row until the open bin must be full
        last = min(n, int(np.searchsorted(sums, budget, "right")))
        ends: dict[int, tuple[int, int]] = {}

        def follow(at: int) -> tuple[int, int]:
            """Bins that begin in the range from a bin start at row ``at`` on, and the fill on exit."""
            path = []
            while at < n and at not in ends:
                path.append(at)
                at = max(at + 1, int(np.searchsorted(sums, sums[at] + budget, "right")) - 1)
            bins, fill = ends[at] if at < n else (0, -1)
            for p in reversed(path):
                if fill < 0:
                    fill = int(sums[n] - sums[p])
                bins += 1
                ends[p] = (bins, fill)
            return bins, fill

        starts = [follow(p) for p in range(0, last + 1) if p < n]
        return pd.DataFrame({"_g": [f["_g"].iloc[0]], "_part": [f["_part"].iloc[0]], "_heads": [sums[: last + 1].tolist()], "_bins": [[b for b, _ in starts]], "_fills": [[x for _, x in starts]], "_sum": [int(sums[n])]})

    kind = rows.schema["_g"].dataType.simpleString()
    charts = rows.select("_g", "_part", order, tokens).groupBy("_g", "_part").applyInPandas(chart, f"_g {kind}, _part int, _heads array<long>, _bins array<long>, _fills array<long>, _sum long")
    ordered = charts.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_part", "_heads", "_bins", "_fills", "_sum"))).alias("c"))  # the ranges of a group

    def compose(f: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for g, maps in zip(f["_g"], f["c"]):
            fill, now = -1, 0
            for m in maps:
                out.append((g, m["_part"], fill, now))
                heads, bins, fills = m["_heads"], m["_bins"], m["_fills"]
                if fill < 0:  # the first bin of the group begins with the first row
                    now, fill = bins[0] - 1, fills[0]
                    continue
                # rows that still fit into the open bin; the next one begins a bin
                k = int(np.searchsorted(np.asarray(heads), budget - fill, "right")) - 1 if fill <= budget else 0
                k = max(k, 0)
                if k >= len(bins):
                    fill += int(m["_sum"])
                else:
                    now, fill = now + bins[k], fills[k]
        return pd.DataFrame(out, columns=["_g", "_part", "_fill", "_bin"])

    return ordered.mapInPandas(lambda frames: (compose(f) for f in frames), f"_g {kind}, _part int, _fill long, _bin long")


def first_fit_runs(lengths: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int, int, int, int]]:
    """First fit decreasing of a histogram: entries (length, first rank, items, first bin, items a bin).

    Items of one length are alike, and what they meet is runs of neighbouring bins with the same room. Each bin of a run
    with room takes items until the next one no longer fits, so the items of a length fill the runs in order: the running
    sum of what the runs can take tells how far they get, the last run they reach is split, and what is left opens a run of
    new bins. An item over the budget has its own bin. Runs grow by at most four a length, whatever the counts are.
    """
    first = size = room = np.empty(0, np.int64)
    bins, entries = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        t, c = int(lengths[i]), int(counts[i])
        per = np.where(room >= t, room // t if t > 0 else c, 0)
        ends = np.cumsum(per * size)
        took = min(c, int(ends[-1])) if len(ends) else 0
        if took:
            k = int(np.searchsorted(ends, took))  # the last run that takes any
            for j in np.flatnonzero(per[: k + 1]).tolist():
                start = int(ends[j] - per[j] * size[j])
                entries.append((t, start, min(took, int(ends[j])) - start, int(first[j]), int(per[j])))
            whole, extra = divmod(entries[-1][2], int(per[k]))
            parts = [(whole, room[k] - per[k] * t), (min(extra, 1), room[k] - extra * t), (int(size[k]) - whole - min(extra, 1), room[k])]
            room[:k] -= per[:k] * t
            first, size, room = _split(first, size, room, k, parts)
        if c > took:
            rest = c - took
            each = 1 if t > budget else budget // t if t > 0 else rest
            whole, extra = divmod(rest, each)
            entries.append((t, took, rest, bins, each))
            for n, left in ((whole, budget - each * t), (min(extra, 1), budget - extra * t)):
                if n:
                    first, size, room = np.append(first, bins), np.append(size, n), np.append(room, left)
                    bins += n
    return entries


def _split(first: np.ndarray, size: np.ndarray, room: np.ndarray, k: int, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with run ``k`` cut into ``parts`` (bins, room) from its front on."""
    n, left = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    begin = first[k] + np.concatenate(([0], np.cumsum(n)[:-1]))
    keep = n > 0
    join = lambda x, mid: np.concatenate([x[:k], mid[keep], x[k + 1 :]])
    return join(first, begin), join(size, n), join(room, left)


def first_fit_decreasing(df: DataFrame, group: str, order: str, tokens: str, budget: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``bin_id`` by first fit decreasing within each pack group; items of one length in ``order``.

    No task holds a group: the bins follow from the group's histogram of lengths alone (``first_fit_runs``). An item then
    needs its rank among those of its length, which is counted in ranges of about ``part_rows`` rows and carried over them,
    and looks its bin up in the plan. A plan has at most as many entries as there are lengths and runs of bins.
    """
    key = F.struct(F.col(group).isNull().alias("n"), F.col(group).alias("g"))
    ranged = _ranged(df, [group, tokens, order], part_rows).withColumn("_g", key)
    kind = ranged.schema["_g"].dataType.simpleString()

    def plan(f: pd.DataFrame) -> pd.DataFrame:
        rows = first_fit_runs(f["_t"].to_numpy(np.int64), f["_c"].to_numpy(np.int64), budget)
        return pd.DataFrame(rows, columns=["_t", "_from", "_n", "_first", "_per"]).assign(_g=[f["_g"].iloc[0]] * len(rows))[["_g", "_t", "_from", "_n", "_first", "_per"]]

    sums = ranged.groupBy("_g", F.col(tokens).cast("long").alias("_t"), "_part").agg(F.count("*").alias("_c"))
    lengths = sums.groupBy("_g", "_t").agg(F.sum("_c").alias("_c"))
    entries = lengths.groupBy("_g").applyInPandas(plan, f"_g {kind}, _t long, _from long, _n long, _first long, _per long")
    plans = entries.groupBy("_g", "_t").agg(F.collect_list(F.struct("_from", "_first", "_per")).alias("_plan"))  # the runs that one length meets
    before = F.sum("_c").over(Window.partitionBy("_g", "_t").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    known = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c").join(plans, ["_g", "_t"])

    rank = F.row_number().over(Window.partitionBy("_g", "_t", "_part").orderBy(order)) - 1
    rows = ranged.withColumn("_t", F.col(tokens).cast("long")).withColumn("_r", rank).join(known, ["_g", "_t", "_part"])
    at = F.col("_r") + F.col("_before")
    entry = F.array_max(F.filter("_plan", lambda e: e["_from"] <= at))  # entries begin at different ranks
    out = rows.withColumn("_e", entry).withColumn("bin_id", F.col("_e._first") + F.floor((at - F.col("_e._from")) / F.col("_e._per")).cast("long"))
    return out.select(*df.columns, "bin_id")


def build_bins(df: DataFrame, group: str, order: str, tokens: str, budget: int, strategy: str = "online", seed: int = 42) -> DataFrame:
    """``online``: next fit in order. Anything else: hash-shuffled, then first fit decreasing."""
    if strategy == "online":
        return next_fit(df, group, order, tokens, budget)
    return first_fit_decreasing(df.withColumn("_o", shuffle_key(F.col(order), seed)), group, "_o", tokens, budget).drop("_o")


def fill_rate(bins: DataFrame, tokens: str, budget: int, group: str, bin_id: str = "bin_id") -> DataFrame:
    """n_items, n_bins, total and fill (percent of all bins' budget) per group."""
    per = bins.groupBy(group, bin_id).agg(F.count("*").alias("c"), F.sum(tokens).alias("t"))
    out = per.groupBy(group).agg(F.sum("c").alias("n_items"), F.count("*").alias("n_bins"), F.sum("t").alias("total"))
    return out.withColumn("fill", F.round(F.try_divide(F.col("total") * 100.0, F.col("n_bins") * budget), 4))


def offsets(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Adds ``offset``: the sum of ``size`` over the rows before this one in its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def collate_bins(rows: DataFrame, bin_id: str, order: str, patches: str, height: str, width: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per bin: ``packed`` (all patches one after another), ``grid`` (images in order: height, width, offset, and
    the columns ``keep``) and ``n_patches``. A bin holds at most a token budget, so a row is of bounded size."""
    entry = F.struct(F.col(order).alias("_o"), F.struct(F.col(height).alias("height"), F.col(width).alias("width"), *keep).alias("g"), F.col(patches).alias("p"))
    bins = rows.groupBy(bin_id).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    sizes = F.transform("c", lambda c: F.size(c["p"]))
    at = lambda i: F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0), lambda a, x: a + x)
    grid = F.transform("c", lambda c, i: F.struct(c["g"]["height"].alias("height"), c["g"]["width"].alias("width"), at(i).alias("offset"), *[c["g"][k].alias(k) for k in keep]))
    return bins.withColumn("_s", sizes).select(bin_id, F.flatten(F.transform("c", lambda c: c["p"])).alias("packed"), grid.alias("grid"), at(F.size("_s")).alias("n_patches"))


def token_statistics(samples: DataFrame, cache: DataFrame | None, tokens: Column, image: str = "image") -> DataFrame:
    """``samples`` with ``tokens`` and ``cached``: the cache's numbers (image, tokens) if it has every image, else all anew.

    Whether all are covered is one sum, broadcast as a single row; nothing is counted on the driver.
    """
    if cache is None:
        return samples.withColumns({"tokens": tokens.cast("long"), "cached": F.lit(False)})
    known = cache.groupBy(F.col(image).alias("_image")).agg(F.max("tokens").alias("_cached"))
    rows = samples.join(known, F.col(image) == F.col("_image"), "left").withColumn("_k", F.lit(1))
    whole = rows.agg(F.coalesce(F.bool_and(F.col("_cached").isNotNull()), F.lit(False)).alias("cached"), F.lit(1).alias("_k"))
    rows = rows.join(F.broadcast(whole), "_k")  # one row
    return rows.withColumn("tokens", F.when(F.col("cached"), F.col("_cached")).otherwise(tokens).cast("long")).drop("_k", "_image", "_cached")


def chunks(df: DataFrame, group: str, order: str, size: str, per_chunk: int) -> DataFrame:
    """Adds ``chunk`` (samples in fixed numbers) and ``offset`` within it, aligned with the packed rows."""
    pos = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    out = df.withColumn("chunk", F.floor(pos / per_chunk).cast("long"))
    w = Window.partitionBy(group, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
