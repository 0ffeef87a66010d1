"""Quality rules: fixed counts, and robust multivariate outliers by language and source. DataFrame functions only.

Base counts follow the contract: words, their characters, symbols, repeated lines, words in repeated runs of three.

Outliers: each text gets a vector of transformed statistics (FEATURES), in whole units of 1 / UNIT. The shares are taken as
if MIN_WORDS words without fault were added, so that one repeated line does not condemn a short text. For each language
and source the centre and covariance are minimum-covariance-determinant estimates by concentration steps: given a centre
and covariance, keep the h = (n + p + 1) / 2 rows nearest by Mahalanobis distance, take their mean and covariance, and so
on until no determinant falls any more (by SETTLED). Each group has three STARTS (medians with median absolute deviations, the plain mean
with covariance, medians with the floors alone); that with the smallest determinant counts. The covariance of the half is
made consistent for normal data by CONSISTENCY, and FLOORS are added to it: a spread below them is no evidence, and most
texts have no symbols or repeats at all. A row is an outlier if its squared distance is above CUT, the 0.999 quantile.

The estimates of a group are weighted with those of its language by n and PRIOR rows, and those of a language with those
of all rows likewise: small groups have estimates of their own, only less heavy ones, and no size changes the rule.
Rows of one group are never brought together: medians are read from counts by value, the nearest half from counts by
bins of the distance, the moments are sums of whole numbers, all added up before the shuffle and joined back. So a source
with most of the rows is like any other, and the result does not depend on how rows are dealt out.

Rows that failed the base rules are not part of the estimates. Null languages and sources are groups like others, null
texts are empty, equal rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import hot_join, word_array
from tessera.session import durable, release

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
UNIT = 1000
#: Of word_length about the spread among clean texts; of the others that of a text of MIN_WORDS words with one symbol in 20
#: words, one repeated line, and that line's ten words.
FLOORS = (0.03, 0.05, 0.05, 0.12)
STARTS = 3
#: A start is settled once the logarithm of its determinant falls by no more than this. The floors bound it from below, so
#: that every start settles.
SETTLED = 1e-3
PRIOR = 50
#: 0.5 / P(chi-squared of p + 2 <= median of chi-squared of p) for p = 4, and the 0.999 quantile of chi-squared of 4.
CONSISTENCY = 2.112
CUT = 18.467
#: Bins of the squared distance to a power of two.
FINE = 256
#: Estimates of up to this many groups, 30 numbers each, are broadcast; those of more are joined by ``hot_join``.
FEW_GROUPS = 20_000


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": word_array(t), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            # characters that are no separators are those of the words
            "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_runs": F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
        }
    )
    df = df.withColumn("_some", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    df = df.withColumn("_order", F.when(F.col("_some"), F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn(
        "_twice",
        F.filter("_order", lambda x, k: F.get("_order", k + 1)["h"].eqNullSafe(x["h"]) | F.when(k > 0, F.get("_order", k - 1)["h"]).eqNullSafe(x["h"])),
    )
    covered = F.array_distinct(F.flatten(F.transform("_twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col("_some"), F.size(covered)).otherwise(0).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_words", "_lines", "_runs", "_some", "_order", "_twice")


def features() -> list[Column]:
    """The transformed statistics of a row of base counts, in the order of FEATURES, as whole numbers of 1 / UNIT."""
    n = F.col("n_words") + MIN_WORDS
    stats = [F.log((F.col("word_chars") + 2 * MIN_WORDS) / (F.col("n_words") + 20)), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(s * UNIT).cast("long") for s in stats]


def _factor(p: int, cov: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Columns of the lower Cholesky factor l<i><j> of ``cov`` and the floors, one after another: each uses those before it."""
    out = []
    for i in range(p):
        for j in range(i + 1):
            rest = cov[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            floor = (UNIT * FLOORS[i]) ** 2
            out.append((f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + floor) if i == j else rest / F.col(f"l{j}{j}")))
    return out


def _distance(df: DataFrame, p: int) -> DataFrame:
    """Adds d2 = the squared length of L^-1 (x - m), by forward substitution column by column."""
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(p)), F.lit(0.0))).drop(*[f"y{i}" for i in range(p)])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _medians(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """gid, n and the exact lower median of each of ``values`` (whole numbers) by group, from counts by value."""
    each = rows.select("gid", F.posexplode(F.array(*values)).alias("i", "v")).groupBy("gid", "i", "v").agg(F.count("*").alias("c"))
    up = Window.partitionBy("gid", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"cum": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy("gid", "i"))}).filter(2 * F.col("cum") >= F.col("n"))
    return each.groupBy("gid").agg(F.max("n").alias("n"), *[F.min(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])


def _moments(rows: DataFrame, p: int, *keys: str) -> DataFrame:
    """keys -> k rows, m<i>, c<i><j> and the factor l<i><j>, from sums of whole numbers."""
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("k"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs(p)]
    )
    got = got.select(*keys, "k", *[(F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in range(p)], *[(F.col(f"q{i}{j}") / F.col("k") - (F.col(f"s{i}") / F.col("k")) * (F.col(f"s{j}") / F.col("k"))).alias(f"c{i}{j}") for i, j in _pairs(p)])
    return _with_factor(got, p)


def _with_factor(got: DataFrame, p: int) -> DataFrame:
    cov = {(i, j): CONSISTENCY * F.col(f"c{i}{j}") for i, j in _pairs(p)}
    for name, col in _factor(p, cov):
        got = got.withColumn(name, col)
    det = F.lit(0.0)
    for i in range(p):
        det = det + F.log(F.col(f"l{i}{i}"))
    return got.withColumn("det", det)


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the columns of their group; ``n`` of ``groups`` is its number of rows."""
    return rows.join(F.broadcast(groups), keys) if few else hot_join(rows, groups, keys, "n")  # at most FEW_GROUPS rows


def minimum_covariance(rows: DataFrame, p: int) -> DataFrame:
    """gid -> n, m<i>, c<i><j> (of the nearest half) of a table with ``gid`` and whole numbers x0..x<p-1>."""
    mid = durable(_medians(rows, [F.col(f"x{i}") for i in range(p)], [f"a{i}" for i in range(p)]))
    # from here on numbers are counted from the group's medians, so that their products stay small
    few = mid.count() <= FEW_GROUPS
    rows = durable(_beside(rows, mid, ["gid"], few).select("gid", *[(F.col(f"x{i}") - F.col(f"a{i}")).alias(f"x{i}") for i in range(p)]))
    dev = _medians(rows, [F.abs(F.col(f"x{i}")) for i in range(p)], [f"d{i}" for i in range(p)])
    zero = {f"m{i}": F.lit(0.0) for i in range(p)}
    apart = lambda size: {f"c{i}{j}": size(i) if i == j else F.lit(0.0) for i, j in _pairs(p)}
    first = _with_factor(dev.withColumns(zero | apart(lambda i: F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)))), p)
    third = _with_factor(dev.withColumns(zero | apart(lambda i: F.lit(0.0))), p)
    state = ["gid", "start", "n", *[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i, j in _pairs(p)], *[f"l{i}{j}" for i, j in _pairs(p)], "det"]
    now = first.withColumn("start", F.lit(0)).select(*state)
    now = now.unionByName(_moments(rows, p, "gid").withColumns({"start": F.lit(1), "n": F.col("k")}).select(*state)).unionByName(third.withColumn("start", F.lit(2)).select(*state))
    now = durable(now)
    each = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    settled: list[DataFrame] = []
    stepped = False
    while True:  # only the starts that still move are in ``now``; their rows alone are worked through
        far = _distance(_beside(each, now, ["gid", "start"], few), p).withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * FINE).cast("int"))
        counts = far.groupBy("gid", "start", "bin").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        up = Window.partitionBy("gid", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        limit = counts.withColumn("cum", F.sum("c").over(up)).filter(2 * F.col("cum") >= F.least(F.col("n") + p + 1, 2 * F.col("n"))).groupBy("gid", "start").agg(F.min("bin").alias("limit"), F.max("n").alias("n"))
        near = _beside(far.select("gid", "start", "bin", *[f"x{i}" for i in range(p)]), limit, ["gid", "start"], few).filter("bin <= limit")
        before = now.select("gid", "start", F.col("det").alias("before"))
        # after the first step the starts' determinants are those of halves and can be compared
        moves = (F.col("det") < F.col("before") - SETTLED) if stepped else F.lit(True)
        new = durable(_moments(near, p, "gid", "start").join(limit.select("gid", "start", "n"), ["gid", "start"]).select(*state).join(before, ["gid", "start"]).withColumn("moves", moves))
        release(now)
        now, stepped = new.filter("moves").select(*state), True
        settled.append(new)
        if now.isEmpty():
            break
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    # the last state of each start is the one that did not move
    best = every.filter("not moves").groupBy("gid").agg(F.min_by(F.struct(*[c for c in state if c[0] in "mc"]), F.struct("det", "start")).alias("b"))
    out = durable(best.select("gid", "b.*").join(mid, "gid").select("gid", "n", *[(F.col(f"m{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(p)], *[f"c{i}{j}" for i, j in _pairs(p)]))
    release(mid, rows, *settled)
    return out


def _blended(groups: DataFrame, estimates: DataFrame, levels: int, p: int) -> DataFrame:
    """g0 -> centre and factor: each level's estimates weighted with those of the level above by n and PRIOR rows."""
    names = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i, j in _pairs(p)]
    got = groups
    for level in range(levels - 1, -1, -1):
        own = estimates.select(F.col("gid").alias(f"g{level}"), F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in names])
        got = got.join(own, f"g{level}")
        if level == levels - 1:
            got = got.withColumns({c: F.col(f"_{c}") for c in names})
        else:
            w = F.col("_n") / (F.col("_n") + PRIOR)
            got = got.withColumns({c: w * F.col(f"_{c}") + (1 - w) * F.col(c) for c in names})
        got = got.drop("_n", *[f"_{c}" for c in names])
    return _with_factor(got, p).drop("det", *[c for c in names if c[0] == "c"])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the base counts, base_failed, d2 (null for base failures) and kept; one row per input row."""
    p = len(FEATURES)
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = base_counts(src).drop("text")
    # a few numbers a row, written once: the texts are read once although there are several passes over the statistics
    rows = durable(rows.withColumns(dict(zip([f"x{i}" for i in range(p)], features()))))
    fit = rows.filter(~F.col("base_failed"))
    named = [F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull()]
    levels = [F.xxhash64(F.lit(0), *named), F.xxhash64(F.lit(1), *named[:2]), F.xxhash64(F.lit(2))]
    groups = durable(fit.groupBy("lang", "source").agg(F.count("*").alias("n")).select("n", *[g.alias(f"g{i}") for i, g in enumerate(levels)]))
    spread = durable(fit.select(F.explode(F.array(*levels)).alias("gid"), *[f"x{i}" for i in range(p)]))
    estimates = minimum_covariance(spread, p)
    release(spread)
    fitted = durable(_blended(groups, estimates, len(levels), p).drop("g1", "g2"))
    release(groups, estimates)
    judged = _distance(_beside(fit.withColumn("g0", levels[0]), fitted, ["g0"], fitted.count() <= FEW_GROUPS), p)
    judged = judged.unionByName(rows.filter("base_failed"), allowMissingColumns=True)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *counts, "d2", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUT)).alias("kept"))


def op4(df: DataFrame) -> DataFrame:
    return judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
