"""Region expressions: grounding results, assembly with negatives, flattening, pooling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.geometry import normalise_box
from tessera.functions.text import DEFAULT_PROFILE, ExpressionProfile, attribute_expressions, cap_expressions, valid_expression
from tessera.session import durable, release


def expressions(captions: DataFrame, profile: ExpressionProfile = DEFAULT_PROFILE, generated: Column | None = None, done: DataFrame | None = None) -> DataFrame:
    """captions + ``expressions``: generated ones that are valid, else those found by pattern; too few drop the image.

    Images in ``done`` are left out before anything is extracted.
    """
    if done is not None:
        captions = resume_images(captions, done)
    found = attribute_expressions(F.col("caption"), profile)
    if generated is not None:
        ok = F.filter(generated, lambda e: valid_expression(e, F.col("caption"), profile))
        found = F.when(F.size(ok) > 0, ok).otherwise(found)
    return captions.withColumn("expressions", cap_expressions(found, profile)).filter(F.col("expressions").isNotNull())


def resume_images(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose image has no result in ``done`` yet; rows without an image stay."""
    return rows.join(done.select("image").distinct(), "image", "left_anti")


def resume_expressions(regions: DataFrame, done: DataFrame) -> DataFrame:
    """image, expr of every region without a row in ``done`` (image, expr), each pair once."""
    todo = regions.select("image", F.explode("regions.expr").alias("expr")).distinct()
    return todo.join(done.select("image", "expr").distinct(), ["image", "expr"], "left_anti")


def ground(samples: DataFrame, images: DataFrame, detections: DataFrame, min_conf: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """image, caption, regions (in the order of the expressions), and a report of one row.

    ``samples`` (image, caption, expressions) without an image in ``images`` (name) are skipped; ``detections`` (image,
    cls, det_idx, x1, y1, x2, y2, conf, w, h) name an expression by its position ``cls``. The best box of each stays,
    normalised and with the confidence to four digits; an image without any goes.
    The report: n_images, n_regions, n_missing (no image), n_dropped (no box).
    """
    found, missing = join_images(samples, images)
    best = best_boxes(detections, min_conf=min_conf)
    box = normalise_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("w"), F.col("h"))
    best = best.select("image", "cls", box.alias("bbox"), F.round("conf", 4).alias("conf"))
    flat = found.select("image", "caption", F.posexplode("expressions").alias("cls", "expr")).join(best, ["image", "cls"])
    entry = F.struct("cls", F.struct("expr", "bbox", "conf").alias("r"))
    got = flat.groupBy("image", "caption").agg(F.array_sort(F.collect_list(entry)).alias("c"))  # a box an expression
    got = got.select("image", "caption", F.transform("c", lambda c: c["r"]).alias("regions"))
    nothing = F.lit(0).cast("long")
    empty = found.join(got.select("image"), "image", "left_anti")
    parts = [
        got.select(F.lit(1).cast("long").alias("n_images"), F.size("regions").cast("long").alias("n_regions"), nothing.alias("n_missing"), nothing.alias("n_dropped")),
        missing.select(nothing, nothing, F.lit(1).cast("long"), nothing),
        empty.select(nothing, nothing, nothing, F.lit(1).cast("long")),
    ]
    counts = parts[0].union(parts[1]).union(parts[2])
    return got, counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])


def count_report(rows: DataFrame, item: str, value: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, items (distinct ``item``), per_item (rows an item, to four digits), and least, most and mean of ``value``."""
    parts = [F.count("*").alias("n"), F.count_distinct(item).alias("items")]
    if value is not None:
        parts += [F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")]
    got = rows.groupBy(*by).agg(*parts)
    return got.withColumn("per_item", F.round(F.try_divide(F.col("n"), F.col("items")), 4))


def join_images(rows: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their image by file name, and the rows whose image is missing."""
    name = F.substring_index("image", "/", -1)
    rows = rows.withColumn("_name", name)
    found = images.withColumnRenamed("name", "_name")
    return rows.join(found, "_name").drop("_name"), rows.join(found.select("_name"), "_name", "left_anti").drop("_name")


def best_boxes(detections: DataFrame, key: str = "image", cls: str = "cls", conf: str = "conf", order: str = "det_idx", min_conf: float = 0.1) -> DataFrame:
    """The most confident box of each image and class above the threshold; of equal ones the first."""
    w = Window.partitionBy(key, cls).orderBy(F.desc(conf), order)
    return detections.filter(F.col(conf) > min_conf).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def assemble(regions: DataFrame, negatives: DataFrame, by_position: bool = False) -> DataFrame:
    """image, caption, regions with ``hard`` in each; regions without negatives go, then images without regions.

    ``negatives``: image, (expr or region index ``ri``), hard; of several for one key the last by ``ord`` wins.
    """
    key = "ri" if by_position else "expr"
    last = negatives.groupBy("image", key).agg(F.max_by("hard", "ord").alias("hard")).filter(F.size("hard") > 0)
    flat = regions.select("image", "caption", F.posexplode("regions").alias("ri", "r")).select("image", "caption", "ri", "r.expr", "r.bbox", "r.conf")
    got = flat.join(last, ["image", key])
    entry = F.struct("ri", F.struct("expr", "bbox", "conf", "hard").alias("r"))
    got = got.groupBy("image", "caption").agg(F.array_sort(F.collect_list(entry)).alias("c"))  # a few regions an image
    return got.select("image", "caption", F.transform("c", lambda c: c["r"]).alias("regions"))


def candidates_of_regions(train: DataFrame, max_regions: int = 4) -> DataFrame:
    """image, region, pos, text, n: the positive at position 0, then its negatives; the first regions of each image."""
    r = train.select("image", F.posexplode(F.slice("regions", 1, max_regions)).alias("region", "r"))
    return r.select("image", "region", F.posexplode(F.concat(F.array("r.expr"), "r.hard")).alias("pos", "text"), (1 + F.size("r.hard")).alias("n"))


def explode_candidates(df: DataFrame) -> DataFrame:
    """image, reason_id, reason_text, prior: the flat form the judge reads."""
    return df.select("image", F.inline("candidates"))


def with_reason_texts(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates whose ``reason_text`` is empty get the rule's text from ``library`` (reason_id, rule) where that has it.

    The library has each id once; evidence that a candidate carries stays.
    """
    found = candidates.join(library.select("reason_id", "rule"), "reason_id", "left")
    text = F.when(F.coalesce("reason_text", F.lit("")) == "", F.coalesce("rule", F.lit(""))).otherwise(F.col("reason_text"))
    return found.withColumn("reason_text", text).select(*candidates.columns)


def mean_pool(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, value: the mean of each coordinate over a ragged set of vectors."""
    return tokens.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def summed_area(cells: DataFrame, key: str = "image") -> DataFrame:
    """key, row, col, m, n, s: over all cells up to (row, col), their number, that of those with a value, and the values' sum.

    Two running sums, along the rows and then down the columns, so no task holds more than one of them. Places of the grid
    without a cell are filled in; a grid is as large as one image's patches.
    """
    size = cells.groupBy(key).agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    places = size.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h").cast("long"))).alias("row"), "_w")
    places = places.select(key, "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w").cast("long"))).alias("col"))
    known = cells.groupBy(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    known = known.agg(F.count("*").alias("m"), F.count("value").alias("n"), F.sum(F.col("value").cast("double")).alias("s"))
    whole = places.join(known, [key, "row", "col"], "left")
    for by, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(key, by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        whole = whole.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("m", "n", "s")})
    return whole


def box_pool(cells: DataFrame, boxes: DataFrame, key: str = "image") -> DataFrame:
    """key, box_id, n, value: mean of ``value`` over the cells (row, col) inside each box's range c1..c2, r1..r2.

    Four lookups a box in the table of summed areas, however many cells it covers. A box without a cell has no row.
    """
    edge = cells.groupBy(key).agg((F.max("row") + 1).cast("long").alias("_h"), (F.max("col") + 1).cast("long").alias("_w"))
    long = lambda c: F.col(c).cast("long")
    inside = boxes.join(edge, key).select(
        key, "box_id", F.greatest(long("r1"), F.lit(0)).alias("r1"), F.least(long("r2"), "_h").alias("r2"), F.greatest(long("c1"), F.lit(0)).alias("c1"), F.least(long("c2"), "_w").alias("c2")
    ).filter("r1 < r2 and c1 < c2")
    corner = lambda r, c, sign: F.struct((F.col(r) - 1).alias("row"), (F.col(c) - 1).alias("col"), F.lit(sign).alias("sign"))
    corners = inside.select(key, "box_id", F.inline(F.array(corner("r2", "c2", 1), corner("r1", "c2", -1), corner("r2", "c1", -1), corner("r1", "c1", 1)))).filter("row >= 0 and col >= 0")
    got = corners.join(summed_area(cells, key), [key, "row", "col"])
    got = got.groupBy(key, "box_id").agg(F.sum(F.col("sign") * F.col("m")).alias("n"), F.sum(F.col("sign") * F.col("n")).alias("_n"), F.sum(F.col("sign") * F.col("s")).alias("_s"))
    return got.filter("n > 0").select(key, "box_id", "n", F.try_divide("_s", "_n").alias("value"))


#: Boxes of one image and class that one task goes through.
GROUP_BOXES = 20_000


def greedy_nms(detections: DataFrame, iou: float = 0.5, key: str = "image", cls: str = "cls", group_boxes: int = GROUP_BOXES) -> DataFrame:
    """Detections that no better one that stays, of the same image and class, overlaps by more than ``iou``.

    Better is more confident, then the smaller ``det_idx``. Groups of up to ``group_boxes`` are gone through in a task;
    larger ones, such as a map's, are thinned in rounds (``nms_in_rounds``) with the same result.
    """
    large = detections.groupBy(key, cls).agg(F.count("*").alias("_n")).filter(F.col("_n") > group_boxes).select(F.col(key).alias("_k"), F.col(cls).alias("_c"))
    if large.isEmpty():
        return _nms_by_group(detections, iou, key, cls)
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(cls).eqNullSafe(F.col("_c"))
    small = _nms_by_group(detections.join(large, same, "left_anti"), iou, key, cls)
    return small.unionByName(nms_in_rounds(detections.join(large, same, "left_semi"), iou, key, cls, group_boxes))


def _nms_by_group(detections: DataFrame, iou: float, key: str, cls: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["conf", "det_idx"], ascending=[False, True], kind="stable")
        x1, y1, x2, y2 = f[["x1", "y1", "x2", "y2"]].to_numpy(float).T
        area = (x2 - x1) * (y2 - y1)
        left, kept = np.arange(len(f)), []
        while len(left):  # the best of those left, and away with all that it overlaps
            i, left = left[0], left[1:]
            kept.append(i)
            both = np.maximum(0, np.minimum(x2[i], x2[left]) - np.maximum(x1[i], x1[left])) * np.maximum(0, np.minimum(y2[i], y2[left]) - np.maximum(y1[i], y1[left]))
            left = left[both <= iou * (area[i] + area[left] - both)]
        return f.iloc[kept]

    return detections.groupBy(key, cls).applyInPandas(run, detections.schema)


def nms_in_rounds(detections: DataFrame, iou: float, key: str = "image", cls: str = "cls", group_boxes: int = 0) -> DataFrame:
    """The same for groups of any size, in rounds of local maxima.

    Boxes lie in cells of grids whose cells are twice their size's power of two. Boxes that overlap by more than ``iou``
    differ in width and in height by at most the factor 1 / iou, so each box lies in the cells of its own size and of as
    many larger ones, and any two that overlap so share a cell. In a round a box that is the best of all its cells stays,
    as nothing better can take it away, and what it overlaps goes: a cell has at most one that stays in a round, so the
    rows are the boxes' cells, never pairs of boxes. Each round decides every local maximum, and so at least the best of
    each group. What is left of a group depends on nothing that is decided, so the rounds end when no group has more than
    ``group_boxes`` boxes left, and the rest is gone through group by group.
    """
    if iou <= 0:
        raise ValueError("an overlap of more than nothing may be of any two sizes: iou must be above 0")
    rows = durable(detections.withColumn("_uid", F.monotonically_increasing_id()))
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))  # boxes without an area overlap nothing
    reach = max(0, math.ceil(math.log2(1 / iou)))
    level = lambda a, b: F.floor(F.log2(F.col(b) - F.col(a))).cast("int")
    steps = F.sequence(F.lit(0), F.lit(reach))
    c = rows.filter(~flat).select(F.col(key).alias("_k"), F.col(cls).alias("_c"), "_uid", F.struct((-F.col("conf")).alias("c"), "det_idx", "_uid").alias("_rank"), "x1", "y1", "x2", "y2", level("x1", "x2").alias("_lw"), level("y1", "y2").alias("_lh"))
    c = c.withColumn("_lw", F.explode(F.transform(steps, lambda i: F.col("_lw") + i))).withColumn("_lh", F.explode(F.transform(steps, lambda i: F.col("_lh") + i)))
    cell = lambda x, size: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col(size) + 1)).cast("long")
    for name, lo, hi, size in (("_cx", "x1", "x2", "_lw"), ("_cy", "y1", "y2", "_lh")):
        c = c.withColumn(name, F.explode(F.sequence(cell(lo, size), cell(hi, size))))
    where = ["_k", "_c", "_lw", "_lh", "_cx", "_cy"]
    cells = durable(c.withColumn("_at", F.xxhash64(*where)))  # cells that share a hash only meet more boxes
    kept = [rows.filter(flat).select("_uid")]
    while not cells.groupBy("_k", "_c").agg(F.count_distinct("_uid").alias("_n")).filter(F.col("_n") > group_boxes).isEmpty():
        best = cells.groupBy("_at").agg(F.min("_rank").alias("_best"))
        top = cells.join(best, "_at").groupBy("_uid").agg(F.bool_and(F.col("_rank") == F.col("_best")).alias("_all")).filter("_all").select("_uid")
        stay = durable(top)
        kept.append(stay)
        over = cells.join(stay, "_uid", "left_semi").select("_at", F.col("_k").alias("_sk"), F.col("_c").alias("_sc"), F.col("_uid").alias("_by"), *[F.col(x).alias(f"s_{x}") for x in ("x1", "y1", "x2", "y2")])
        side = lambda a, b: F.greatest(F.lit(0.0), F.least(b, f"s_{b}") - F.greatest(a, f"s_{a}"))
        both = side("x1", "x2") * side("y1", "y2")
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) + (F.col("s_x2") - F.col("s_x1")) * (F.col("s_y2") - F.col("s_y1"))
        alike = F.col("_k").eqNullSafe(F.col("_sk")) & F.col("_c").eqNullSafe(F.col("_sc"))
        gone = cells.join(over, "_at").filter(alike & (F.col("_uid") != F.col("_by")) & (both > iou * (area - both))).select("_uid")
        left = durable(cells.join(stay.unionByName(gone).distinct(), "_uid", "left_anti"))
        release(cells)
        cells = left
    uids = kept[0]
    for k in kept[1:]:
        uids = uids.unionByName(k)
    out = rows.join(uids, "_uid", "left_semi").drop("_uid")
    if group_boxes:
        rest = rows.join(cells.select("_uid").distinct(), "_uid", "left_semi").drop("_uid")
        out = out.unionByName(_nms_by_group(rest, iou, key, cls))
    return out


def box_report(train: DataFrame, sizes: DataFrame, limit: int = 20) -> DataFrame:
    """Pixel coordinates, label and negatives of the first images' regions, for inspection."""
    from tessera.functions.geometry import pixel_box

    first = train.orderBy("image").limit(limit)
    rows = first.select("image", F.posexplode("regions").alias("region", "r")).join(sizes, "image")
    return rows.select("image", "region", "r.expr", pixel_box(F.col("r.bbox"), F.col("width"), F.col("height")).alias("box"), F.array_join("r.hard", " / ").alias("hard"))
