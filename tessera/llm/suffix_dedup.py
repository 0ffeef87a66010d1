"""Removal of repeated byte strings: aligned collections, ordered column by column with their common prefixes.

Removed is each byte inside a string of LENGTH bytes that also starts anywhere else in the corpus.

1. Partition. Each window of LENGTH bytes has an anchor: its GRAM-byte string with the smallest hash (leftmost of
   equals), a function of the window's bytes alone. Equal windows have equal anchors at equal offsets. A run of windows
   with one anchor occurrence is a context: about (LENGTH - GRAM) / 2 window starts and the bytes under them. A
   document sends one row of numbers per context, no bytes.
2. An anchor that occurs once has no repeated window; most rows end here. Of what is left, contexts with equal bytes (128
   bits of hashes) are one. An anchor all of whose contexts are one is repeated as a whole: copies have nothing to be
   ordered by. The contexts of all other anchors go on, one of each with its bytes and the number of its occurrences.
3. Contexts are cut into blocks of BLOCKS[0] window starts; a block is keyed by its core, the bytes that all its windows
   share, so only blocks that agree in the core meet. A core with more than CORE blocks has them cut into shorter ones, whose
   cores are longer, and so on; at one window a block the core is the window. So no task holds more than CORE strings of
   a core, however often a passage occurs.
4. Column-wise construction. The strings of a core are aligned on their anchor, one that occurs several times stands there
   twice. From the right, each round puts one
   symbol before every string: the order of the strings by their suffix from this column on is a stable sort of the last
   order by that symbol (the transform of the column), and the common prefix of neighbours is one more than the least
   common prefix between them in the last order, or zero where the symbols differ. Where a prefix reaches LENGTH the
   window starting at this column is repeated. A string that begins later ends in a symbol of its own. Columns already
   done are dropped: aligned strings match in one column only.
5. Windows that are repeated make intervals per document; their union is cut out in one pass over the bytes.

Instead of external files per column the state of a batch of cores stays in arrays, BATCH strings and one core more: the
partition into cores, in sorted shuffle files, has taken the place of the files. Texts are moved by a hash of their content
and length. Joins on anchors and contexts take the few keys that are very frequent apart (``hot_join``).

Nulls: a null text counts as empty. Equal rows and equal texts count as several occurrences. Texts shorter than LENGTH
bytes keep everything. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hot_join
from tessera.session import durable, release, ship

LENGTH = 200
GRAM = 40
#: Window starts of a block, and what blocks of an overfull core are cut into, step by step.
BLOCKS = (48, 12, 3, 1)
CORE = 1 << 14
BATCH = 4096
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def contexts(data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, anchor position, first window start, windows) arrays of a text's contexts, a part per segment.

    A window's anchor does not depend on the segments. They end some contexts early, so copies at other places may be
    cut in other ways; those count as different contexts, and the column-wise step finds their windows equal.
    """
    out = []
    width = LENGTH - GRAM + 1
    for at in range(0, len(data) - LENGTH + 1, SEGMENT):
        b = np.frombuffer(data, np.uint8, min(SEGMENT + LENGTH - 1, len(data) - at), at)
        n = len(b)
        up, down = _powers(SEGMENT + LENGTH)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        g = len(grams)
        key = (grams & ~np.uint64(0xFFFFF)) | np.arange(g, dtype=np.uint64)
        pad = -g % width
        blocks = np.concatenate([key, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = g - width + 1
        low = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        size = np.diff(np.concatenate((first, [count])))
        where = anchor[first]
        out.append((grams[where].astype(np.int64), where + at, first + at, size))
    return out


def anchor_table(docs: DataFrame) -> DataFrame:
    """key, nb, h (anchor), c (hash of the context's bytes), start, nwin of a table with key, nb, text, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cols: list[list] = [[], [], [], [], [], []]
                part = b.slice(lo, 256)
                for key, nb, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = text.encode()
                    for h, _, first, size in contexts(data):
                        ends = (first + size + (LENGTH - 1)).tolist()
                        c = np.fromiter((digest(data[s:e]) for s, e in zip(first.tolist(), ends)), np.uint64, len(ends)).astype(np.int64)
                        for col, v in zip(cols, (np.full(len(h), key), np.full(len(h), nb), h, c, first, size)):
                            col.append(v)
                if cols[0]:
                    key, nb, h, c, start, size = map(np.concatenate, cols)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nb.astype(np.int32)), pa.array(h), pa.array(c), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16))], names=["key", "nb", "h", "c", "start", "nwin"])

    return docs.filter(F.col("nb") >= LENGTH).select("key", "nb", "text").mapInArrow(run, "key long, nb int, h long, c long, start int, nwin short")


BLOCK_COLUMNS = ("core", "h", "c", "n", "first", "shift", "nwin", "bytes")
BLOCK_SCHEMA = "core long, h long, c long, n long, first int, shift int, nwin int, bytes binary"
BLOCK_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def cut_blocks(data: bytes, high: int, low: int, h: int, size: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(core, first, shift, nwin, bytes) of the blocks of a string whose windows have the shifts ``high`` down to ``low``.

    A shift is how far before the anchor a window begins. Blocks lie on the grid of shifts; ``first`` counts from ``high``.
    """
    from xxhash import xxh3_64_intdigest as digest

    for k in range(low // size, high // size + 1):
        a, z = min(high, (k + 1) * size - 1), max(low, k * size)
        core = data[high - k * size : high - (k + 1) * size + 1 + LENGTH]
        yield digest(core, (h ^ size) & 0xFFFFFFFF) - (1 << 63), high - a, z, a - z + 1, data[high - a : high - z + LENGTH]


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(BLOCK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, BLOCK_TYPES)], names=list(BLOCK_COLUMNS))


def block_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """core, h, c, n, first (window's place in its context), shift (of the last window), nwin, bytes: blocks of contexts.

    ``wanted`` has key, nb and ``spots``, the contexts to cut: (start, nwin, h, c, n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                rows: list[tuple] = []
                part = batch.slice(lo, 16)
                for text, spots in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = text.encode()
                    place = {}
                    for _, pos, first, _ in contexts(data):
                        place.update(zip(first.tolist(), pos.tolist()))
                    for s in spots:
                        start, nwin, h = s["start"], s["nwin"], s["h"]
                        high = place[start] - start  # window start w has the shift anchor - w
                        for core, first, shift, n, piece in cut_blocks(data[start : start + nwin - 1 + LENGTH], high, high - nwin + 1, h, BLOCKS[0]):
                            rows.append((core, h, s["c"], s["n"], first, shift, n, piece))
                yield _block_batch(rows)

    # one row of each text is enough, and joined by its id too, copies of one text are spread over the tasks
    rows = docs.groupBy("key", "nb").agg(F.min("doc_id").alias("_low")).join(wanted, ["key", "nb"])
    rows = rows.select(F.col("key").alias("_key"), F.col("nb").alias("_nb"), "_low", "spots")
    got = docs.join(rows, (F.col("key") == F.col("_key")) & (F.col("nb") == F.col("_nb")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("text", "spots")
    return got.mapInArrow(run, BLOCK_SCHEMA)


def shorter_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """The blocks cut into blocks of ``size`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                for core, first, shift, n, piece in cut_blocks(r["bytes"], r["shift"] + r["nwin"] - 1, r["shift"], r["h"], size):
                    rows.append((core, r["h"], r["c"], r["n"], r["first"] + first, shift, n, piece))
            yield _block_batch(rows)

    return blocks.mapInArrow(run, BLOCK_SCHEMA)


def repeated_columns(strings: list[bytes], shifts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the columns (from its left end) where a window of ``length`` begins that another string has too.

    ``shifts`` tells how far the last window of each string lies from the common origin; strings are aligned by it.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    ends = np.array([length - s for s in shifts])  # one past the last byte, from the origin
    starts = ends - sizes
    left, right = int(starts.min()), int(ends.max())
    grid = np.full((m, right - left), -1, np.int16)
    for i, s in enumerate(strings):
        grid[i, starts[i] - left : ends[i] - left] = np.frombuffer(s, np.uint8)
    found = np.zeros((m, right - left), bool)
    order = np.arange(m)
    prefix = np.zeros(m, np.int64)  # common prefix of each string in ``order`` with the one before it
    for column in range(right - left - 1, -1, -1):
        symbols = grid[order, column].astype(np.int64)
        fresh = symbols < 0
        if fresh.any():  # strings not begun yet, or over, are unlike all others
            symbols = np.where(fresh, 256 + np.arange(m), symbols)
        sort = np.argsort(symbols, kind="stable")
        ranked = symbols[sort]
        same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
        new = np.zeros(m, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            new[at] = 1 + _least_between(prefix, sort[at - 1] + 1, sort[at])
        order, prefix = order[sort], new
        hit = np.flatnonzero(prefix >= length)
        if len(hit):
            found[order[hit], column] = True
            found[order[hit - 1], column] = True
    return [np.flatnonzero(found[i, starts[i] - left : ends[i] - left]) for i in range(m)]


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for many ranges, by a table of minima of power-of-two stretches."""
    span = hi - lo
    top = int(span.max())
    if top == 0:
        return values[lo]
    levels, size = [values], 1
    while 2 * size <= top + 1:
        last = levels[-1]
        levels.append(np.minimum(last[: len(last) - size], last[size:]))
        size *= 2
    which = np.floor(np.log2(span + 1)).astype(np.int64)
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(which):
        here = which == k
        out[here] = np.minimum(levels[k][lo[here]], levels[k][hi[here] - (1 << int(k)) + 1])
    return out


RUN_SCHEMA = "h long, c long, n long, first int, count int"


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """h, c, n, first, count: runs of repeated windows, by their place in the context. No core has more than CORE blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, dict] = {}
        ready: list[dict] = []
        core = None

        def close() -> None:
            """The core is complete: what occurs once and is alone has no like, the rest joins the batch (equal windows have equal cores)."""
            if len(group) > 1 or any(g["n"] > 1 for g in group.values()):
                ready.extend(group.values())
            group.clear()

        def solve() -> pa.RecordBatch:
            rows: list[tuple[int, int, int, int, int]] = []
            if ready:
                copies = [g for g in ready if g["n"] > 1]  # a context that occurs again stands there a second time
                both = ready + copies
                for g, cols in zip(ready, repeated_columns([g["bytes"] for g in both], [g["shift"] for g in both])):
                    if len(cols):
                        cut = np.flatnonzero(np.diff(cols) > 1)
                        for a, z in zip(np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(cols) - 1]))):
                            rows.append((g["h"], g["c"], g["n"], g["first"] + int(cols[a]), int(cols[z] - cols[a]) + 1))
                ready.clear()
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "c", "n", "first", "count"])

        for b in batches:
            for r in b.to_pylist():
                if r["core"] != core:
                    close()
                    core = r["core"]
                    if len(ready) >= BATCH:
                        yield solve()
                group[r["h"], r["c"], r["first"]] = r
        close()
        yield solve()

    # rows of one core come together and in order; a core with one row costs nothing
    return blocks.repartition("core").sortWithinPartitions("core").mapInArrow(run, RUN_SCHEMA)


def repeated_runs(blocks: DataFrame) -> list[DataFrame]:
    """Tables as ``repeated_blocks`` gives them, which together have the runs of all blocks."""
    out = []
    for size in [*BLOCKS[1:], None]:
        counts = blocks.groupBy("core").agg(F.count("*").alias("_rows"))
        full = durable(counts.filter(F.col("_rows") > CORE))
        if full.isEmpty():
            out.append(durable(repeated_blocks(blocks)))
            release(blocks)
            return out
        # an overfull core has CORE rows at least, so that few are; their rows may be many
        out.append(durable(repeated_blocks(blocks.join(full, "core", "left_anti"))))
        many = hot_join(blocks, full, ["core"], "_rows").drop("_rows")
        if size is None:
            # a block is one window and its core is that window: all of them are repeated
            out.append(durable(many.select("h", "c", "n", "first", F.col("nwin").alias("count"))))
            release(blocks)
            return out
        now = durable(shorter_blocks(many, size))
        release(blocks, full)
        blocks = now
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """key, nb, ``cuts``: for each distinct text the starts of repeated windows as (start, count)."""
    anchors = durable(anchor_table(docs))
    often = anchors.groupBy("h").agg(F.count("*").alias("_n"), (F.min("c") != F.max("c")).alias("mixed")).filter("_n > 1")
    known = durable(hot_join(anchors, often, ["h"], "_n").drop("_n"))
    release(anchors)
    counts = durable(known.groupBy("h", "c").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("key", "nb", "start", "nwin")).alias("one")))
    wanted = counts.filter("mixed").select("one.*", "h", "c", "n").groupBy("key", "nb").agg(F.collect_list(F.struct("start", "nwin", "h", "c", "n")).alias("spots"))  # the contexts of one text
    runs = repeated_runs(durable(block_table(docs, wanted)))
    rounds = reduce(DataFrame.unionByName, runs).groupBy("h", "c").agg(F.max("n").alias("n"), F.collect_list(F.struct("first", "count")).alias("runs"))  # of one context's blocks
    # an anchor with one context only: its occurrences are copies of one another, so there is nothing to be ordered
    alike = counts.filter("not mixed").select("h", "c", "n", F.array(F.struct(F.lit(0).alias("first"), F.col("one.nwin").cast("int").alias("count"))).alias("runs"))
    found = durable(rounds.unionByName(alike))
    release(counts, *runs)
    parts = hot_join(known.drop("mixed"), found, ["h", "c"], "n").select("key", "nb", "start", F.explode("runs").alias("r"))
    return parts.groupBy("key", "nb").agg(F.collect_set(F.struct((F.col("start") + F.col("r.first")).cast("int").alias("start"), F.col("r.count").alias("count"))).alias("cuts"))


def removed_runs(cuts: list) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) from the starts of repeated windows."""
    runs: list[tuple[int, int]] = []
    for start, count in sorted((c["start"], c["count"]) for c in cuts):
        end = start + count - 1 + LENGTH
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``text`` (never null), ``key`` and ``nb``: equal for equal texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("text", t).withColumn("key", F.xxhash64("text")).withColumn("nb", F.octet_length("text"))


def strip(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, removed (array of runs (start, end)) and kept (binary), one row per input row."""
    ship(df.sparkSession)
    docs = keyed(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    joined = docs.join(repeats(docs), ["key", "nb"], "left").select("doc_id", "text", "cuts")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for key, text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode()
                runs = removed_runs(cuts or [])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                for r, v in zip(rows, (key, len(data), [{"start": s, "end": e} for s, e in runs], b"".join(kept))):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rows[3], pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def op3(df: DataFrame) -> DataFrame:
    got = strip(df)
    return got.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

