"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets: sources in code-point order (null last) weigh by ``WEIGHTS`` in turn and share all words in proportion, each at
most ``MAX_EPOCHS`` times its own size; what is above goes to the others by weight. That fixed point is the water level
L with sum(min(L * weight, cap)) = total, found from running sums over the sources ordered by cap / weight.

Curriculum: over training time t in 0..1 a source is asked for at the rate target * (1 + slope * (2t - 1)); the slope
goes with its weight (``SLOPES``). The integral is target * (t + slope * (t*t - t)), so the time at which a source's
demand reaches its k-th word is the root of a quadratic. Documents stand in a random but fixed order within their source
(by the MD5 of the id), and the source is read in that order again and again until its integrated demand, the target, is
used up; the last document is taken in part. A document's copy gets the training time of its first word, and the mix is
sorted by time; a copy's position is the number of words before it.

Running sums within a source go through salts (the first hex digits of the same MD5): sums by source and salt, running
over salts, then within a salt. A source with most of the rows is spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import word_count
from tessera.session import durable

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
SALT_DIGITS = 3
TIME_BINS = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also weight, slope, target. One row per source: no window here sees more rows than that."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (turn + 1).cast("int"))
    s = sizes.withColumns({"weight": pick(WEIGHTS), "slope": pick(SLOPES), "_cap": (MAX_EPOCHS * F.col("source_size")).cast("double")})
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_capped": F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_weights": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # the level if all before this source are full; the right one is the highest that does not fill its source
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_weights"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(everything))
    target = F.round(F.least(F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")), F.col("_cap")), 6)
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def plan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, slope, start (words of the source's reading before the document's
    first), ``copies`` (as ``schedule`` says) and the columns ``carry``; one row per input row.

    Null texts and texts without words have size 0 and are never taken. Null sources are a source like others; rows with
    null ids are ordered by their text. Rows that are equal in id, size and source are interchangeable. An empty table
    gives an empty result.
    """
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.col(text)), F.lit("")).cast("binary"))
    rows = df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    ).withColumn("_salt", F.substring("_key", 1, SALT_DIGITS))
    if not carry:
        rows = durable(rows)  # the words are counted once; three numbers and a hash a row
    sums = durable(rows.groupBy("source", "_salt").agg(F.sum("size").alias("_sum")))
    by_source = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before)
    known = starts.join(by_source, starts["source"].eqNullSafe(by_source["source"])).select(
        starts["source"].alias("_source"), starts["_salt"].alias("_s"), "_before", "source_size", "target", "slope"
    )
    ordered = Window.partitionBy("source", "_salt").orderBy("_key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    got = rows.join(known, rows["source"].eqNullSafe(known["_source"]) & (rows["_salt"] == known["_s"]))
    got = got.withColumn("start", F.col("_before") + F.col("_within")).withColumn("copies", _copies())
    return got.select("doc_id", "source", "size", "source_size", "target", "slope", "start", "copies", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def _copies() -> Column:
    """The copies that the mix takes of a planned row: array of (copy, copy_words, time).

    The source is read over and over until its integrated demand, the target, is used up: reading number ``copy`` of a
    document begins at start + copy * source_size, and what of it lies within the demand is taken. The time is the one
    at which the demand reaches that place.
    """
    goal = F.round("target").cast("long")
    at = lambda c: F.col("start") + c * F.col("source_size")
    words = lambda c: F.least(F.greatest(goal - at(c), F.lit(0)), F.col("size"))
    every = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_EPOCHS)),
        lambda c: F.struct(c.alias("copy"), words(c).cast("long").alias("copy_words"), training_time(at(c), F.col("target"), F.col("slope")).alias("time")),
    )
    return F.filter(every, lambda c: c["copy_words"] > 0)


def training_time(position: Column, target: Column, slope: Column) -> Column:
    """The time t at which target * (t + slope * (t*t - t)) reaches ``position``, to 12 digits."""
    share = F.when(target > 0, F.least(position / target, F.lit(1.0)))
    b = 1 - slope
    root = F.when(slope != 0, (F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))
    return F.round(F.when(slope == 0, share).otherwise(root), 12)


def schedule(planned: DataFrame) -> DataFrame:
    """One row per copy that the mix takes: the plan's columns, ``copy`` (from 0), ``copy_words`` and ``time``."""
    return planned.withColumn("_copy", F.explode("copies")).select(*[c for c in planned.columns if c != "copies"], "_copy.copy", "_copy.copy_words", "_copy.time")


def _placed(copies: DataFrame) -> DataFrame:
    """Adds ``position``, the words of the mix before the copy, to rows of ``schedule``.

    The training time is cut into TIME_BINS equal parts, which hold about equal numbers of words as every source's rate
    changes by half at most; sums of the bins are carried over, then within one.
    """
    rows = copies.withColumn("_bin", F.least(F.floor(F.col("time") * TIME_BINS), F.lit(TIME_BINS - 1)).cast("int"))
    sums = rows.groupBy("_bin").agg(F.sum("copy_words").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # TIME_BINS rows
    ordered = Window.partitionBy("_bin").orderBy("time", "doc_id", "source", "start", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("copy_words").over(ordered), F.lit(0)))
    got = rows.join(sums.select("_bin", before.alias("_before")), "_bin").withColumn("position", F.col("_before") + F.col("_within"))
    return got.drop("_bin", "_within", "_before")


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c).asc_nulls_last() for c in by]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def training_order(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, copy, copy_words, time, position (words of the mix before the copy), sorted by position.

    One row per copy that the mix takes; none for a document that it does not take.
    """
    rows = _placed(schedule(durable(plan(df, text, doc_id, source))))
    return _sorted(rows, "position").select("doc_id", "source", "copy", "copy_words", "time", "position")


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (the words of all its scheduled copies),
    ``first_time`` and ``first_position`` of its first copy (null if none), range-sorted by that position, those that are
    not taken last."""
    planned = durable(plan(df, text, doc_id, source))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["copy_words"])
    firsts = _placed(schedule(planned)).filter("copy = 0").select(F.col("source").alias("_source"), F.col("start").alias("_start"), F.col("time").alias("first_time"), F.col("position").alias("first_position"))
    # documents with words have starts of their own within a source, and only those are taken
    rows = planned.withColumn("taken", taken)
    got = rows.join(firsts, rows["source"].eqNullSafe(firsts["_source"]) & (rows["start"] == firsts["_start"]) & (rows["taken"] > 0), "left")
    return _sorted(got, "first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_time", "first_position")


def op8(df: DataFrame) -> DataFrame:
    return mix(df)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) :: BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM s),
w AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE turn WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
             (3 * source_size)::DOUBLE AS cap FROM n),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
l AS (SELECT *, max(CASE WHEN (total - capped) / weights * weight <= cap THEN (total - capped) / weights END) OVER () AS level FROM f),
t AS (SELECT source, source_size, slope, round(least(coalesce(level * weight, cap), cap), 6) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.slope,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
             CAST(round(t.target) AS BIGINT) AS goal
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT p.*, copy, least(greatest(goal - (start + copy * source_size), 0), size) AS copy_words,
             CASE WHEN target > 0 THEN least((start + copy * source_size) / target, 1.0) END AS share
      FROM p, range(4) r(copy)),
c AS (SELECT *, round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 12) + 0.0::DOUBLE AS time
      FROM a WHERE copy_words > 0),
o AS (SELECT *, CAST(coalesce(sum(copy_words) OVER (ORDER BY time, doc_id NULLS FIRST, source NULLS FIRST, start, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM c),
g AS (SELECT source, start, CAST(sum(copy_words) AS BIGINT) AS taken, min(time) AS first_time, min(position) AS first_position FROM o GROUP BY source, start)
SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN coalesce(g.taken, 0) ELSE 0 END AS taken,
       CASE WHEN p.size > 0 THEN g.first_time END AS first_time, CASE WHEN p.size > 0 THEN g.first_position END AS first_position
FROM p LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.start = g.start
"""
