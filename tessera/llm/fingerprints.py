"""Document fingerprints by winnowing. DataFrame functions only.

A text's code points give one Karp-Rabin hash for each run of K of them, h = sum of c * BASE**(place from the right) mod
PRIME, where c is the CRC-32 of the code point's bytes (a shorter text that is not empty: one hash, as if it went on with
zero characters). In every window of W successive hashes
the smallest is chosen, the rightmost of equal ones, and positions are kept. Any passage of K + W - 1 code points that two
texts share makes them share a chosen hash, whatever the script. Hash and position are packed in one long, (hash << 31) |
(2**31 - 1 - position), so that the smallest long of a window is the rightmost of its smallest hashes.

Array functions carry no running state, so the hashes are not updated one after another: a pass over the array puts two
neighbouring hashes of half the length together, h(a + b) = h(a) * BASE**len(b) + h(b), which gives the rolling hash's
values in a pass for each doubling of K. The windows' minima are doubled likewise. A text is worked through in segments
of SEGMENT code points, which bounds what is held at once and keeps it near the processor; segments overlap by what a window needs, so they change nothing.

Nulls: a null text counts as empty; a text without characters has no hashes. Two fingerprints without hashes are alike
(1.0), one without and one with are not (0.0). Equal texts have equal fingerprints, since nothing else is used. Repeated
rows give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

K = 16  # a power of two
W = 64  # a power of four
BASE = 1_000_003
PRIME = (1 << 31) - 1
MASK = (1 << 31) - 1
SEGMENT = 1 << 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _doubled(values: Column, length: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """From values of single places those of runs of ``length``, a power of two: join(left, right, places of each).

    As many as there are places; the last length - 1 of them run over the end and mean nothing.
    """

    def grow(have: Column, size: int) -> Column:
        if size == length:
            return have
        return _let(F.zip_with(have, F.slice(have, F.lit(1 + size), F.size(have)), lambda x, y: join(x, y, size)), lambda h: grow(h, 2 * size))

    return grow(values, 1)


def _whole_runs(values: Column, length: int) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - (length - 1), F.lit(0)))


def rolling_hashes(text: Column, last: Column) -> Column:
    """The Karp-Rabin hashes of all runs of K code points of a text, in order, packed: (hash << 31) | (last - place)."""
    codes = F.transform(F.split(text, ""), lambda c: F.crc32(c.cast("binary")))
    join = lambda x, y, n: (x * pow(BASE, n, PRIME) + y) % PRIME
    half = K // 2
    # the last doubling is a pass with the places at hand, so that it packs at once
    pack = lambda h: F.transform(_whole_runs(h, K), lambda x, i: F.shiftleft(join(x, F.get(h, i + half), half), 31).bitwiseOR(last - i))
    return _let(codes, lambda c: _let(_doubled(c, half, join), pack))


def _windows(packed: Column) -> Column:
    """The smallest of each window of W (of all, if there are fewer), repeated ones once."""
    few = F.when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)

    def grow(have: Column, size: int) -> Column:
        if size == W:
            return F.array_distinct(_whole_runs(have, W))
        # four neighbours at once; beyond the end there are nulls, which ``least`` takes no notice of
        wider = F.transform(have, lambda x, i: F.least(x, *[F.get(have, i + F.lit(k * size)) for k in (1, 2, 3)]))
        return _let(wider, lambda v: grow(v, 4 * size))

    return F.when(F.size(packed) >= W, grow(packed, 1)).otherwise(few)


def chosen(text: Column, offset: Column | int = 0) -> Column:
    """Array of chosen (hash, position), packed, in text order; positions count from ``offset``."""
    first = F.lit(offset).cast("long") if isinstance(offset, int) else offset.cast("long")

    def part(t: Column, at: Column) -> Column:
        return _let(F.lit(MASK) - at, lambda last: _let(rolling_hashes(t, last), _windows))

    def whole(t: Column) -> Column:
        n = F.length(t)
        full = F.when(n < K, F.rpad(t, K, "\0")).otherwise(t)
        last = F.greatest(F.floor((n - (K + W - 1)) / SEGMENT), F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda s: part(F.substring(full, s * SEGMENT + 1, F.lit(SEGMENT + K + W - 2)), first + s * SEGMENT))
        # the choice of one segment's last window may be that of the next one's first
        return F.when(last > 0, F.array_distinct(F.flatten(parts))).otherwise(F.get(parts, F.lit(0)))

    none = F.expr("cast(array() as array<bigint>)")
    return F.when(F.length(text) > 0, _let(text, whole)).otherwise(none)


def _place(p: Column) -> Column:
    return F.lit(MASK) - p.bitwiseAND(F.lit(MASK))


def chosen_within(choices: Column, first: Column) -> Column:
    """Those of a text's choices that windows within its ``first`` code points made.

    They are the choices up to the place that the last such window chose, which is the smallest within it.
    """
    none = F.expr("cast(array() as array<bigint>)")

    def upto(j: Column) -> Column:
        last = F.array_min(F.filter(choices, lambda p: (_place(p) >= j) & (_place(p) < j + W)))
        return F.when(j >= 0, _let(last, lambda m: F.filter(choices, lambda p: _place(p) <= _place(m)))).otherwise(none)

    return _let(first - (K + W - 1), upto)  # a number, not an expression to be worked out for each choice


def chosen_when_joined(before: Column, joined: Column, same: Column, after: Column) -> Column:
    """``chosen`` of a text that is put together of the first ``same`` code points of one and the beginning of another.

    ``before`` and ``after`` are choices of the two texts. Windows within either part choose what they chose there; only
    those across the seam are worked out, some 2 * (K + W) code points whatever the texts' lengths.
    """
    span = K + W - 1
    n = F.length(joined)
    start = F.greatest(same - (span - 1), F.lit(0))
    seam = F.when(n < span, joined).when((same > 0) & (same < n), F.substring(joined, (start + 1).cast("int"), (same + span - 1 - start).cast("int"))).otherwise("")
    rest = F.transform(chosen_within(after, n - same), lambda p: p - same)  # the place counts down in the low bits
    return F.array_union(F.array_union(chosen_within(before, same), chosen(seam, F.when(n < span, 0).otherwise(start))), rest)


def hashes_of(chosen: Column) -> Column:
    """The distinct hashes of packed choices, ascending."""
    return F.sort_array(F.array_distinct(F.transform(chosen, lambda p: F.shiftright(p, 31))))


def positions_of(chosen: Column) -> Column:
    """The positions (code points) of packed choices."""
    return F.transform(chosen, lambda p: F.lit(MASK) - p.bitwiseAND(F.lit(MASK)))


def fingerprint_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct hashes, in one merge-free pass each: |a and b| / (|a| + |b| - |a and b|)."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / F.greatest(total, F.lit(1)))


def next_ids(df: DataFrame, doc_id: str, n_chars: Column) -> DataFrame:
    """doc_id -> next_id (the next larger id present; after the last the first) and the longest n_chars of its rows.

    Ids of any type that has an order are dealt into ranges, written once; the next id is found within a range, and the
    last of a range takes the first of the next range that has any. Only ids are moved, and no task sees them all. Null
    ids have no next.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = df.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(n_chars).alias("_n"))
    ranged = durable(ids.repartitionByRange(parts, "_id").withColumn("_part", F.spark_partition_id()))
    firsts = ranged.groupBy("_part").agg(F.min("_id").alias("_first"))  # at most ``parts`` rows
    edge = Window.orderBy("_part")
    firsts = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(edge), F.min("_first").over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    inside = F.lead("_id").over(Window.partitionBy("_part").orderBy("_id"))
    return ranged.withColumn("_lead", inside).join(F.broadcast(firsts), "_part").select("_id", "_n", F.coalesce("_lead", "_after").alias("_next"))


def edited(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, n_chars, choices, same, edited, edited_choices, next_hashes: each row with its choices, its edited
    text, how many code points that has in common with the text from the start, its choices, and the next document's hashes.

    The choices are made once a row, where it is read, and moved with the text, once and by id: the same exchange serves
    the documents as themselves and as the next ones, which send their heads, the heads' choices and all hashes to the id before. Where rows
    share an id the smallest head stands for the next text; rows with a null id have no next document, so their tail is cut.
    """
    # an id that has its name already is not aliased: the two reads of the exchange must be equal to the last node
    key = F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id")
    every = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = every.filter(F.col("doc_id").isNotNull())  # said here so that both joins read one and the same exchange
    order = next_ids(docs, "doc_id", F.length("text"))
    docs = docs.withColumn("choices", chosen(F.col("text")))
    back = order.select(F.col("_next").alias("_to"), F.col("_id").alias("_from"), F.floor(F.col("_n") / 4).cast("int").alias("_q"))
    sent = docs.join(back.hint("shuffle_hash"), docs["doc_id"] == back["_to"])
    sent = sent.select("_from", F.struct(F.expr("substring(text, 1, _q)").alias("head"), chosen_within(F.col("choices"), F.col("_q")).alias("start"), hashes_of(F.col("choices")).alias("hashes")).alias("_sent"))
    sent = sent.groupBy("_from").agg(F.min("_sent").alias("_sent"))
    got = docs.join(sent, docs["doc_id"] == sent["_from"], "left").drop("_from")
    got = got.unionByName(every.filter(F.col("doc_id").isNull()).withColumn("choices", chosen(F.col("text"))), allowMissingColumns=True)
    got = got.withColumn("n_chars", F.length("text").cast("long")).withColumn("same", (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    new = F.concat(F.expr("substring(text, 1, same)"), F.coalesce(F.expr("substring(_sent.head, 1, int(n_chars) - same)"), F.lit("")))
    none = F.expr("cast(array() as array<bigint>)")
    got = got.withColumn("edited", new)
    both = chosen_when_joined(F.col("choices"), F.col("edited"), F.col("same"), F.coalesce(F.col("_sent.start"), none))
    return got.select("doc_id", "text", "n_chars", "choices", "same", "edited", both.alias("edited_choices"), F.coalesce(F.col("_sent.hashes"), none).alias("next_hashes"))


def op10(df: DataFrame) -> DataFrame:
    e = edited(df).withColumns({"_ha": hashes_of(F.col("choices")), "_hb": hashes_of(F.col("edited_choices"))})
    return e.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string(F.col("_ha")).alias("fingerprint"),
        fingerprint_string(F.col("_hb")).alias("edited_fingerprint"),
        likeness(F.col("_ha"), F.col("_hb")).cast("double").alias("near_edited"),
        likeness(F.col("_ha"), F.col("next_hashes")).cast("double").alias("near_next"),
        F.array_join(positions_of(F.col("choices")), ",").alias("positions"),
    )
