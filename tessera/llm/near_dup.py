"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text is the sequence of its word shingles (SHINGLE words each; a shorter text with words is one shingle of all of
them). Each shingle is labelled with how often it occurred before, so labelled shingles are distinct. A sketch hashes
the labelled shingles, takes the ELL smallest and joins them in text order; a text has SKETCHES of them. Two texts of
similarity 0.8 agree in one sketch with probability of about 0.8 ** ELL, and in none of SKETCHES about once in 10**10.

1. Equal texts are collapsed first; only one of each goes on. A group of copies costs one row from here.
2. Texts that share a sketch form a bucket. First, every member of a bucket is paired with one leader (the member with the
   smallest code under one of LEADERS masks, by the sketch's number), so these candidates grow with the members, not with their
   square; a text meets several leaders. Longer sketches join two sketches, so members of a bucket that only share a common passage
   meet again in small buckets.
3. A candidate pair is dropped if its sketches agree in fewer than AGREE places: a pair of similarity 0.8 is wrongly
   dropped about once in 10**6.
4. The pair's texts are aligned. Labelled shingles that both have are matched one to one; within the band of shifts
   that the similarity allows, the longest increasing run of matches is the alignment. Its similarity is
   matches / (shingles of both - matches), the Jaccard similarity of labelled shingles that keep their order.
   A pair links at THRESHOLD or more.
5. Classes are the connected components, by alternating large-star and small-star steps on the edge table.
6. Buckets whose members are of more than one class stay open (``rest``). Their leader is now the member with the most
   company over all its open buckets, as an original has among its edited copies; that goes on while it links many. At
   last every pair of an open bucket that is not of one class and was not aligned before is a candidate. So each pair
   that shares a sketch and agrees in AGREE places is aligned, or is of one class by other links. Large buckets are
   dealt out by pairs of salted blocks of about BLOCK members. The pairs compared here can grow with the square of an
   open bucket; only those that agree, and whose counts of shingles in BINS bins allow the threshold (a bound that never
   drops a pair wrongly), leave the worker.

Null texts and texts without words are like no other text and form classes of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hot_join
from tessera.session import durable, release, ship

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 24
ELL = 2
AGREE = 5
LEADERS = 4
BLOCK = 1024
BINS = 256

_ODD = np.random.default_rng(20240501).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(20240502).integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_MASKS = np.random.default_rng(20240503).integers(-(1 << 62), 1 << 62, LEADERS).tolist()
_POW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= 500_000:
            self.clear()
        self[w] = got = xxh3_64_intdigest(w)
        return got


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the text's labelled shingles in text order."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([_words[x] for x in words], np.uint64)
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h + w[i : i + n] * _POW[i]
    h = _mix(h + np.uint64(k))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(n, np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = np.where(label > 0, _mix(h + label * np.uint64(0x9E3779B97F4A7C15)), h)
    return h


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES keys of a non-empty shingle array."""
    v = (h[None, :] ^ _XOR[:, None]) * _ODD[:, None]
    v ^= v >> np.uint64(29)
    ell = min(ELL, len(h))
    if ell == 1:
        at = v.argmin(axis=1)[:, None]
    else:
        first = v.argmin(axis=1)
        rows = np.arange(len(v))
        low = v[rows, first]
        v[rows, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = v.argmin(axis=1)
        v[rows, first] = low
        at = np.stack([np.minimum(first, second), np.maximum(first, second)], axis=1)
    picked = h[at]
    key = picked[:, 0].copy()
    for i in range(1, ell):
        key = _mix(key) + picked[:, i]
    return _mix(key + np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Order-keeping Jaccard similarity of two labelled shingle arrays, exact from ``threshold`` on and 0 below it."""
    n, m = len(a), len(b)
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    sa, sb = np.argsort(a), np.argsort(b)
    at = np.searchsorted(b[sb], a[sa])
    hit = at < m
    hit[hit] = b[sb][at[hit]] == a[sa][hit]
    if hit.sum() < need:
        return 0.0
    pos_a, pos_b = sa[hit], sb[at[hit]]
    band = n + m - 2 * need + 1
    near = np.abs(pos_a - pos_b) <= band
    pos_b = pos_b[near][np.argsort(pos_a[near])]
    if len(pos_b) > 1 and (np.diff(pos_b) < 0).any():
        tails: list[int] = []
        for p in pos_b.tolist():
            i = bisect_left(tails, p)
            if i == len(tails):
                tails.append(p)
            else:
                tails[i] = p
        matches = len(tails)
    else:
        matches = len(pos_b)
    return matches / (n + m - matches) if matches >= need else 0.0


def bins(h: np.ndarray) -> bytes:
    """How many shingles fall into each of BINS bins, one byte each, 255 for more."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def may_match(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of rows of bins allow ``threshold``: two texts share at most the smaller count of each bin."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    full = (a == 255).any(axis=1) & (b == 255).any(axis=1)
    return full | (most >= threshold * (na + nb) / (1 + threshold) - 1e-9)


def sketch_table(texts: DataFrame) -> DataFrame:
    """node, code, n (shingles), keys (SKETCHES longs), bins of a table with ``node`` and ``text``.

    The code is 64 bits of the node, for moving; candidates are verified by node. Texts without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, keys, counts = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingles(t)
                if len(h):
                    node.append(k)
                    n.append(len(h))
                    keys.append(sketch(h))
                    counts.append(bins(h))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, SKETCHES, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(n, pa.int32()), lists, pa.array(counts, pa.binary())], names=["node", "n", "keys", "bins"])

    return texts.select("node", "text").mapInArrow(run, "node string, n int, keys array<long>, bins binary").withColumn("code", F.xxhash64("node"))


def candidates(sketches: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of codes to verify."""
    rows = sketches.select("code", F.posexplode("keys").alias("i", "key"))
    deep = sketches.select("code", F.posexplode(F.transform("keys", lambda k, i: F.xxhash64(F.lit(2), k, F.element_at("keys", ((i + 1) % SKETCHES + 1).cast("int"))))).alias("i", "key"))
    mask = F.element_at(F.array(*[F.lit(m) for m in _MASKS]), (F.col("i") % LEADERS + 1).cast("int"))
    rows = rows.unionByName(deep).select("code", F.xxhash64("i", "key").alias("bucket"), mask.alias("mask"))
    # the leader by a partial aggregate of plain numbers; buckets of one are gone before anything is joined
    leaders = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.col("code").bitwiseXOR(F.col("mask"))).alias("low"), F.min("mask").alias("mask")).filter("c > 1")
    leaders = leaders.select("bucket", F.col("low").bitwiseXOR(F.col("mask")).alias("leader"))
    pairs = rows.drop("mask").join(leaders, "bucket").filter(F.col("code") != F.col("leader"))
    return pairs.select(F.least("code", "leader").alias("a"), F.greatest("code", "leader").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (code, comp, at, key) of buckets with more than one class, and ``c``, the members of the bucket."""
    mixed = rows.groupBy("at", "key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return rows.join(mixed.select("at", "key", "c"), ["at", "key"])


def popular_leaders(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of codes of each member and its bucket's leader, the one with the most company."""
    company = rows.groupBy("code").agg(F.sum("c").alias("company"))
    rows = rows.join(company, "code")
    leaders = rows.groupBy("at", "key").agg(F.max(F.struct("company", "code", "comp")).alias("l"))
    pairs = rows.join(leaders, ["at", "key"]).filter(F.col("comp") != F.col("l.comp"))
    return pairs.select(F.least("code", "l.code").alias("a"), F.greatest("code", "l.code").alias("b")).distinct()


def _pairs_of_block(at: int, x: int, y: int, own: np.ndarray, code: np.ndarray, comp: np.ndarray, n: np.ndarray, keys: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs between the members of salt ``x`` and ``y`` whose first common sketch is number ``at``."""
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    ka, kb = keys[left], keys[right]
    agree, before = np.zeros((len(left), len(right)), np.uint8), np.zeros((len(left), len(right)), bool)
    for k in range(SKETCHES):
        same = ka[:, k, None] == kb[None, :, k]
        agree += same
        if k < at:
            before |= same
    na, nb = n[left][:, None], n[right][None, :]
    ok = (agree >= AGREE) & ~before & (comp[left][:, None] != comp[right][None, :])
    ok &= np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    if x == y:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    parts = [(i[k : k + 32768], j[k : k + 32768]) for k in range(0, len(i), 32768)]
    fit = np.concatenate([may_match(counts[p], counts[q], n[p], n[q], threshold) for p, q in parts] or [np.empty(0, bool)])
    a, b = code[i[fit]], code[j[fit]]
    return np.minimum(a, b), np.maximum(a, b)


def all_pairs(rows: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) of codes of different classes that share a bucket of ``rows`` and agree in AGREE places; each once."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    full = rows.join(sketches.select("code", "n", "keys", "bins"), "code").withColumn("own", F.pmod(F.xxhash64("code", "at"), blocks))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    group = [F.col("at").cast("long").alias("at"), "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")]
    full = full.select(*group, "own", "code", "comp", F.col("n").cast("long").alias("n"), "keys", "bins").repartition("at", "key", "x", "y").sortWithinPartitions("at", "key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last: tuple[int, ...] = ()

        def finish() -> tuple[np.ndarray, np.ndarray]:
            return _pairs_of_block(last[0], last[2], last[3], *[np.concatenate(c) for c in zip(*held)], threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            cols.append(batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES))
            cols.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(-1, BINS))
            ids = np.stack(cols[:4], axis=1)
            cuts = (np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                here = tuple(ids[lo].tolist())
                if held and here != last:
                    out.append(finish())
                    held = []
                held.append([c[lo:hi].copy() for c in cols[4:]])
                last = here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in finish()], names=["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def verified(texts: Callable[[DataFrame], DataFrame], sketches: DataFrame, pairs: DataFrame, threshold: float, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes that align with ``threshold`` or more, and all pairs that are now tried.

    ``pairs`` has codes; ``texts`` gives the table node, text for a table of nodes. Pairs in ``tried`` are left out.
    """
    side = lambda x: sketches.select(F.col("code").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.filter((F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9))
    agree = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda e: e))
    p = p.filter((agree >= AGREE)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    p = durable(p if tried is None else p.join(tried, ["a", "b"], "left_anti"))
    after = p if tried is None else tried.unionByName(p)
    if p.isEmpty():
        return p, after
    nodes = p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
    wanted = durable(texts(nodes))
    full = p.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alignment_similarity(shingles(x), shingles(y), threshold) >= threshold - 1e-9 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = durable(full.select("a", "b", "ta", "tb").mapInArrow(run, "a string, b string"))
    release(wanted)
    return out, after


def rest(texts: Callable[[DataFrame], DataFrame], sketches: DataFrame, edges: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """node -> root as ``components`` gives it, once all pairs of all buckets are decided."""
    roots = durable(components(edges))
    placed = sketches.join(roots, "node", "left").select("code", F.xxhash64(F.coalesce("root", "node")).alias("comp"), "keys")
    rows = durable(_mixed(placed.select("code", "comp", F.posexplode("keys").alias("at", "key"))))
    whole = False
    while not whole:
        classes_left = rows.agg(F.count_distinct("comp")).first()[0]
        if not classes_left:
            break
        pairs = popular_leaders(rows)
        edges, tried = verified(texts, sketches, pairs, threshold, tried)
        linked = edges.count()
        if linked * 10 < classes_left:  # leaders find little more: what is still open goes to the whole comparison
            whole = True
        if linked:
            rows, roots = _relinked(rows, sketches, roots, edges)
    if whole:
        edges, tried = verified(texts, sketches, durable(all_pairs(rows, sketches, threshold)), threshold, tried)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges))
    return roots


def _relinked(rows: DataFrame, sketches: DataFrame, roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still open of ``rows``, and the roots, after ``edges`` are added."""
    new = durable(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges)))
    placed = sketches.join(new, "node").select("code", F.xxhash64("root").alias("new"))
    left = durable(_mixed(rows.join(placed, "code", "left").select("code", F.coalesce("new", "comp").alias("comp"), "at", "key")))
    release(rows)
    release(roots)
    return left, new


def components(edges: DataFrame) -> DataFrame:
    """node -> root (the smallest node of its component) for all nodes of an edge table (a, b).

    Large-star links each node's larger neighbours to the smallest of its neighbourhood, small-star its smaller ones;
    the table never grows and is a star per component after a number of rounds logarithmic in its size. Every round is
    a table in the shared folder; the only figures on the driver are a count and a sum of hashes, to see the end.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = hot_join(both, low, ["u"], "c", 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, least, ["u"], "c", 2 * n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = durable(small.filter("u <> v").distinct())
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        release(edges)
        edges, n = new, state["n"]
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), F.col("root"))).distinct()


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (the smallest doc_id of its class), ``class_rows``.

    Rows with equal texts, and with null ids, are rows of the class like others. A row whose text has no words is a
    class of its own; its class_id is its doc_id.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    has = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    node = F.when(has, F.md5(F.col("text").cast("binary")))
    ids = durable(rows.select("doc_id", node.alias("node")))
    firsts = durable(ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_rows")))
    sketches = durable(sketch_table(rows.filter(has).withColumn("node", node)).dropDuplicates(["node"]))
    pairs = durable(candidates(sketches))

    def texts(nodes: DataFrame) -> DataFrame:
        # the row with the node's smallest id has its text; joined by both, so that copies of one text are spread
        wanted = nodes.join(firsts, "node").select(F.col("node").alias("_node"), F.col("low").alias("_low"))
        found = rows.filter(has).withColumn("node", node).join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_low")))
        return found.select("node", "text").dropDuplicates(["node"])

    edges, tried = verified(texts, sketches, pairs, threshold)
    release(pairs)
    roots = rest(texts, sketches, edges, tried, threshold)
    release(sketches)
    placed = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = placed.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n_rows").alias("class_rows"))
    by_root = durable(by_root)
    placed = placed.select("node", "root").join(by_root, "root").select("node", "class_id", "class_rows")
    out = ids.join(placed, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))


def op9(df: DataFrame) -> DataFrame:
    return classes(df)
