"""Best-fit packing by linear grouping.

Documents are cut into pieces of at most ``capacity`` tokens. Everything after that is a cutting-stock problem on the
histogram of lengths, which has at most ``capacity`` entries however many documents there are:

1. Lengths above ``capacity // part`` are large. Sorted by length they are dealt into groups of equal cardinality, and
   every length counts as the largest of its group, so few sizes are left. (Each of PARTS and GROUPS is tried: with
   many small pieces a low part is best, since they fill what the large ones leave; without them a high one is.)
2. The configuration program over those sizes (how many sequences of each combination) is solved as a linear program by
   column generation, and rounded down.
3. Actual lengths replace the rounded ones, largest first within each group; what the rounding left over joins the rest.
4. Best fit decreasing of all that is left, on the histogram: sequences with the same free space form runs, and each
   length goes to the run with the least free space that is enough.

The result is a plan: for each length, ranges of ranks -> first sequence number and offset. Pieces get a rank within
their length and look their place up in the plan. The plan's size depends on the capacity only: a step takes whole runs
but for one, so it has at most about capacity * capacity / 2 entries, and a few thousand in practice.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tokens import tokenizer_path
from tessera.llm.transducer import byte_alphabet
from tessera.session import durable

CAPACITY = 2048
#: Pieces above capacity / part are large; the plan with the fewest sequences over these parts and group numbers is taken.
PARTS = (2, 3, 4, 6)
GROUPS = (12, 48)
SALTS = 1024
MAX_WORDS = 400_000

# --- token ids -----------------------------------------------------------------------------------------------------

#: Texts of these characters only are split and lower-cased alike by every library; others go to the library whole.
SIMPLE = re.compile("[\\t\\n\\r -~\\u00a1-\\u00ac\\u00ae-\\u00ff\\u2013\\u2014\\u2018-\\u201d\\u2026\\u20ac]*")
LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼-¾"
#: The vocabulary's own splitting pattern, for these characters.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """Pre-token -> its ids as little-endian 32-bit words; bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        import json

        spec = json.load(open(path))
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLITTER:
            raise ValueError("the word cache knows another normaliser and splitter than this vocabulary's")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        # a pre-token that is lower-cased already goes straight to the merges, as the stand-ins of its bytes
        shown = word if word.isascii() else "".join([self.stand_in[b] for b in word.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        got = ids.tobytes()
        if len(word) <= 24:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join([self[w] for w in SPLIT.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def piece_table(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then id 0, cut every ``capacity`` tokens."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path).ids
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = ids(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for r, v in zip(rows, (key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- the plan on the histogram ---------------------------------------------------------------------------------------


def configuration_program(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """The linear program min sum x_c, sum x_c c >= demand over combinations c of ``sizes`` that fit ``capacity``.

    Primal simplex with columns made on demand: the duals price a knapsack over the sizes, solved by depth-first search
    with the value-per-token bound. Returns combinations with a positive number.
    """
    k = len(sizes)
    columns = [tuple(capacity // sizes[i] if j == i else 0 for j in range(k)) for i in range(k)]
    basis = np.array(columns, float).T
    for _ in range(60 * k):
        inv = np.linalg.inv(basis)
        x = inv @ np.array(demand, float)
        y = np.ones(k) @ inv
        best = _knapsack(sizes, y, capacity)
        if best is None:
            break
        d = inv @ np.array(best, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out] = best
        basis[:, out] = best
    x = np.linalg.inv(basis) @ np.array(demand, float)
    return [(c, float(v)) for c, v in zip(columns, x) if v > 1e-9]


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """The combination of the greatest value if that is above 1."""
    order = sorted((i for i in range(len(sizes)) if value[i] > 1e-12), key=lambda i: -value[i] / sizes[i])
    best, found = 1 + 1e-7, None
    pick = [0] * len(sizes)

    def go(at: int, room: int, worth: float) -> None:
        nonlocal best, found
        if worth > best:
            best, found = worth, tuple(pick)
        if at == len(order):
            return
        i = order[at]
        if worth + room * value[i] / sizes[i] <= best:
            return
        for n in range(room // sizes[i], -1, -1):
            pick[i] = n
            go(at + 1, room - n * sizes[i], worth + n * value[i])
        pick[i] = 0

    go(0, capacity, 0.0)
    return found


class Plan:
    """Runs of alike sequences while they fill; entries (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.rank: dict[int, int] = defaultdict(int)
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.free: dict[int, list[list[int]]] = defaultdict(list)  # free space -> runs [first sequence, count]
        self.spaces: list[int] = []

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.entries.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def add_free(self, space: int, first: int, count: int) -> None:
        if space <= 0:
            return
        if not self.free[space]:
            insort(self.spaces, space)
        self.free[space].append([first, count])

    def best_fit(self) -> None:
        from bisect import bisect_left

        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                i = bisect_left(self.spaces, length)
                if i == len(self.spaces):
                    n = self.left[length]
                    per = self.capacity // length
                    whole = n // per
                    for many, count in ((per, whole), (n - whole * per, 1)):
                        if count and many:
                            first = self.open(count)
                            for j in range(many):
                                self.put(length, count, first, j * length)
                            self.add_free(self.capacity - many * length, first, count)
                    continue
                space = self.spaces[i]
                first, count = self.free[space].pop()
                if not self.free[space]:
                    self.spaces.pop(i)
                take = min(count, self.left[length])
                self.put(length, take, first, self.capacity - space)
                self.add_free(space - length, first, take)
                if take < count:
                    self.add_free(space, first + take, count - take)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, count, first sequence, offset) that place every piece once."""
    plans = [linear_grouping(counts, capacity, part, groups) for part in PARTS for groups in GROUPS]
    return min(plans, key=lambda p: p.sequences).entries


def linear_grouping(counts: dict[int, int], capacity: int, part: int, groups: int) -> Plan:
    plan = Plan(counts, capacity)
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if capacity // part < n < capacity and counts[n]]
    total = sum(c for _, c in large)
    if total:
        size = -(-total // groups)
        members: list[dict[int, int]] = []  # by group: length -> number, largest first
        room = 0
        for n, c in large:
            while c:
                if not room:
                    members.append({})
                    room = size
                take = min(c, room)
                members[-1][n] = members[-1].get(n, 0) + take
                c, room = c - take, room - take
        rounded = [max(m) for m in members]
        sizes = sorted(set(rounded), reverse=True)
        index = {s: i for i, s in enumerate(sizes)}
        joint: list[dict[int, int]] = [defaultdict(int) for _ in sizes]
        for s, m in zip(rounded, members):
            for n, c in m.items():
                joint[index[s]][n] += c
        merged = [[[n, c] for n, c in sorted(m.items(), reverse=True)] for m in joint]
        demand = [sum(c for _, c in m) for m in merged]
        for combo, x in configuration_program(sizes, demand, capacity):
            number = int(x + 1e-6)
            slots = [i for i, c in enumerate(combo) for _ in range(c)]
            number = min([number, *(sum(c for _, c in merged[i]) // combo[i] for i in set(slots))])
            while number:
                # one run: as many sequences as all its slots can fill with one actual length each
                picks, want = [], defaultdict(int)
                for i in slots:
                    n = merged[i][0][0]
                    picks.append((i, n))
                    want[i] += 1
                run = min([number, *(max(1, merged[i][0][1] // w) for i, w in want.items())])
                if any(merged[i][0][1] < w * run for i, w in want.items()):  # lengths change within one sequence
                    picks, taken = [], defaultdict(int)
                    for i in slots:
                        k = taken[i]
                        for n, c in merged[i]:
                            if k < c:
                                picks.append((i, n))
                                break
                            k -= c
                        taken[i] += 1
                    run = 1
                first, offset = plan.open(run), 0
                for i, n in picks:
                    plan.put(n, run, first, offset)
                    offset += n
                    for slot in merged[i]:
                        if slot[0] == n:
                            slot[1] -= run
                    while merged[i] and not merged[i][0][1]:
                        merged[i].pop(0)
                    merged[i] = [s for s in merged[i] if s[1]]
                plan.add_free(capacity - offset, first, run)
                number -= run
    plan.best_fit()
    return plan


# --- placing the pieces ------------------------------------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with ``length``, in sequences of ``capacity``.

    Ranks within a length are dealt by salt, so that a length with most of the rows is spread over SALTS groups.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sums = durable(sums)  # at most capacity * SALTS rows
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    entries = sorted(make_plan(counts, capacity))
    lookup = tuple(np.array(v, np.int64) for v in zip(*[((n << 40) + rank, rank, first, offset) for n, rank, _, first, offset in entries]))
    shared = spark.sparkContext.broadcast(lookup)  # bounded by the capacity, see the module's head
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("length", "_salt", before.alias("_before"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(len(names)).to_numpy()
            keys, ranks, first, offset = shared.value or (np.empty(0, np.int64),) * 4
            i = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(first[i] + rank - ranks[i]), pa.array(offset[i])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    Null and empty texts are one piece holding only the closing id. Repeated rows are packed as often as they occur;
    null ids are kept. An empty table gives an empty result. Texts are tokenised once: the pieces, a few numbers each,
    are written as a table before the histogram is taken.
    """
    pieces = durable(piece_table(df, path or tokenizer_path("word_bpe_49k.json"), capacity))
    return place(pieces, capacity)


def op6(df: DataFrame) -> DataFrame:
    return pack(df).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


__all__ = ["make_plan", "op6", "pack", "piece_table", "place"]
