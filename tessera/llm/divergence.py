"""Source divergence audit: how far the word counts of each source are from those of its language and of other sources.

Terms are runs of letters (A-Z in lower case) and characters beyond ASCII. Two passes over the texts:

1. Document frequencies are counted exactly; a language keeps the terms of at least MIN_DOCS of its documents.
2. The kept terms, each between two delimiters, go into a pyahocorasick automaton for each language, and the texts, with a
   space for every other character, run through it: each match is one occurrence of a whole term, and neighbouring terms
   share the space between them. The vocabulary is cut into blocks of at most BLOCK_BYTES bytes; a block is what is
   broadcast and held by a worker at once, and every block meets every text of its languages.

Counts per (language, source, term) that are above 0 are the postings. All other cells of a language have the smoothed
share of a count of 0, so that the sum of a pair of sources over all kept terms needs no cell without a posting:

    sum over all terms = sum over the terms of g of f(p, q0) + sum over the terms of h of f(p0, q) + (V - |g| - |h|) f(p0, q0)
                         + sum over the terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

p0 and q0 are the shares of a count of 0. The first two sums go over the histogram of a source's shares, the last over the
terms that both have, in buckets of terms: a task holds the postings of one bucket.

Nulls in text, lang and source are read as ''; repeated rows count as often as they occur; a group without terms and a
language without kept terms have pairs, of value 0 where V is 0; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of terms in one block of the vocabulary, entries that a task counts before it hands them on, postings of a bucket.
BLOCK_BYTES, MAX_ENTRIES, BUCKET_ROWS = 4_000_000, 400_000, 20_000

#: What a byte of UTF-8 text becomes: A-Z their small letters; a-z and all bytes of characters beyond ASCII stay; else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t.translate(FOLD) for t in batch.column(column).to_pylist()]


def _groups(df: DataFrame) -> DataFrame:
    """lang, source and the text as bytes; nulls are ''."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("t"))


def _counted(rows: DataFrame, keys: list[str], counts: Callable[[pa.RecordBatch], Iterator[tuple[tuple, Counter]]]) -> DataFrame:
    """keys, term, n: the sums of what ``counts`` gives for each batch, added up in the task until MAX_ENTRIES are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}

        def out() -> pa.RecordBatch:
            sizes = [len(c) for c in held.values()]
            columns = [pa.array([k[i] for k, n in zip(held, sizes) for _ in range(n)], pa.string()) for i in range(len(keys))]
            terms = pa.array([t for c in held.values() for t in c], pa.binary())
            n = pa.array([n for c in held.values() for n in c.values()], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, terms, n], names=[*keys, "term", "n"])

        for b in batches:
            for key, found in counts(b):
                if key in held:
                    held[key].update(found)
                else:
                    held[key] = found
            if sum(map(len, held.values())) > MAX_ENTRIES:
                yield out()
        yield out()

    kinds = ", ".join(f"{k} string" for k in keys)
    part = rows.mapInArrow(run, f"{kinds}, term binary, n long")
    return part.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term (UTF-8 bytes), n: the terms of at least ``min_docs`` documents of their language."""

    def counts(b: pa.RecordBatch) -> Iterator[tuple[tuple, Counter]]:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), _texts(b, "t")):
            by_lang.setdefault(lang, Counter()).update(set(text.split()))
        for lang, found in by_lang.items():
            yield (lang,), found

    return _counted(rows.select("lang", "t"), ["lang"], counts).filter(F.col("n") >= min_docs)


def _blocks(kept: DataFrame, block_bytes: int) -> Iterator[dict[str, list[bytes]]]:
    """The vocabulary in blocks of about ``block_bytes``; the terms are dealt out by their hash, so each block has its share."""
    size = kept.agg(F.coalesce(F.sum(F.length("term") + 2), F.lit(0)).alias("s")).first()["s"]
    n = -(-size // block_bytes)
    for i in range(n):
        rows = kept.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == i).select("lang", "term").toArrow()
        block: dict[str, list[bytes]] = {}
        for lang, term in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            block.setdefault(lang, []).append(bytes(term))
        yield block


_built: dict[tuple[str, str], object] = {}


def _automaton(block: str, lang: str, terms: list[bytes]):
    """The automaton of a language's terms, kept by the worker while it works on the same block."""
    import ahocorasick

    if any(b != block for b, _ in _built):
        _built.clear()
    if (block, lang) not in _built:
        machine = ahocorasick.Automaton()
        for term in terms:
            machine.add_word(f" {term.decode('latin-1')} ", term)  # one character a byte, for terms and texts alike
        machine.make_automaton()
        _built[block, lang] = machine
    return _built[block, lang]


def occurrences(rows: DataFrame, kept: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, term, n: how often each kept term occurs in each group, where it does."""
    spark = rows.sparkSession
    parts = []
    for block in _blocks(kept, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # at most about block_bytes of terms

        def counts(b: pa.RecordBatch, shared=shared) -> Iterator[tuple[tuple, Counter]]:
            name, vocabularies = shared.value
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), _texts(b, "t")):
                texts.setdefault((lang, source), []).append(text)
            for (lang, source), some in texts.items():
                terms = vocabularies.get(lang)
                if terms:
                    found: Counter = Counter()
                    for text in some:
                        found.update([term for _, term in _automaton(name, lang, terms).iter(f" {text.decode('latin-1')} ")])
                    yield (lang, source), found

        parts.append(_counted(rows, ["lang", "source"], counts))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term binary, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) in exact integers of any size; null without terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    top, low = wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(2 * terms)
    return F.call_function("div", top, F.when(low > 0, low)) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shared_terms(postings: DataFrame, n_postings: int) -> DataFrame:
    """lang, a, b, n, value for sources a < b: the number of terms that both have and the last sum of the module's formula.

    Terms are dealt into buckets of about BUCKET_ROWS postings; a term has at most one posting a source. Within a bucket
    the postings of one source are compared with those of all later sources at once.
    """
    buckets = max(1, -(-n_postings // BUCKET_ROWS))

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        terms, t = np.unique(f["term"].to_numpy(), return_inverse=True)
        names = np.array(sorted(f["source"].unique(), key=lambda s: s.encode()), dtype=object)
        at = {s: i for i, s in enumerate(names)}
        s = f["source"].map(at).to_numpy()
        zero = np.zeros(len(names), np.int64)
        zero[s] = f["p0"].to_numpy()
        p = np.repeat(zero[:, None], len(terms), axis=1)
        has = np.zeros(p.shape, bool)
        p[s, t], has[s, t] = f["p"].to_numpy(), True
        rows: list[tuple] = []
        for i in range(len(names) - 1):
            own = np.flatnonzero(has[i])
            both = has[i + 1 :, own]
            a, b = p[i, own][None, :], p[i + 1 :, own]
            a0, b0 = zero[i], zero[i + 1 :, None]
            more = _distances(a, b) - _distances(a, b0) - _distances(a0, b) + _distances(a0, b0)
            n, value = both.sum(axis=1), np.where(both, more, 0).sum(axis=1)
            rows += [(f["lang"].iloc[0], names[i], names[i + 1 + j], int(n[j]), int(value[j])) for j in np.flatnonzero(n)]
        return pd.DataFrame(rows, columns=["lang", "a", "b", "n", "value"])

    dealt = postings.select("lang", "source", F.hex("term").alias("term"), "p", "p0").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    out = dealt.groupBy("lang", "bucket").applyInPandas(pairs, "lang string, a string, b string, n long, value long")
    return out.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), F.sum("value").alias("both"))


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the ``pair`` rows of every two sources of a language, and the ``top`` terms of
    each group that it uses more than its language does."""
    rows = _groups(df)
    kept = durable(vocabulary(rows, min_docs))
    counts = durable(occurrences(rows, kept))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))  # one row a language
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "total", "own")])
    groups = durable(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))

    postings = counts.join(groups.select("lang", "source", "v", "total", "p0"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    return _pair_part(postings, groups, counts.count()).unionByName(_term_part(postings, counts, whole, top))


def _pair_part(postings: DataFrame, groups: DataFrame, n_postings: int) -> DataFrame:
    shapes = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))  # the histogram of a source's shares
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one = shapes.join(others, (shapes["lang"] == others["lang"]) & (F.col("source") != F.col("item")))
    one = one.groupBy(shapes["lang"], "source", "item").agg(F.sum(F.col("k") * distance(F.col("p"), F.col("q0"))).alias("one"))
    both = _shared_terms(postings, n_postings)
    both = both.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), F.col("n").alias("shared"), "both")

    side = others.join(groups.select("lang", F.col("source").alias("item"), F.col("own").alias("their")), ["lang", "item"])
    every = groups.join(side, "lang").filter(F.col("source") != F.col("item"))  # as many rows as the result has
    every = every.join(one, ["lang", "source", "item"], "left")
    turned = one.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("one").alias("other"))
    every = every.join(turned, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    none = F.lit(0)
    rest = (F.col("v") - F.col("own") - F.col("their")) * F.coalesce(distance(F.col("p0"), F.col("q0")), none)
    value = F.coalesce("one", none) + F.coalesce("other", none) + F.coalesce("both", none) + rest
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    got = every.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return got.withColumn("rank", rank)


def _term_part(postings: DataFrame, counts: DataFrame, whole: DataFrame, top: int) -> DataFrame:
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("c"))
    rows = postings.join(by_lang, ["lang", "term"]).join(whole, "lang")
    rows = rows.withColumn("q", share(F.col("c"), F.col("all"), F.col("v"))).filter(F.col("p") > F.col("q"))
    got = rows.select("lang", "source", F.lit("term").alias("part"), "term", distance(F.col("p"), F.col("q")).alias("value"))
    # bytes are compared without sign, as UTF-8; only the first of each task leave it
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    got = got.withColumn("rank", rank).filter(F.col("rank") <= top)
    return got.select("lang", "source", "part", F.col("term").cast("string").alias("item"), "value", "rank")


def op12(df: DataFrame) -> DataFrame:
    return audit(df)


ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * v.v) AS BIGINT) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, CAST(1 + {SCALE}::HUGEINT * (sum(n) + 2) // (any_value(a.total) + 2 * any_value(v.v)) AS BIGINT) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY 1) a USING (lang) GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
