"""Secret scan: fixed rules and a randomness test battery with false-discovery control. DataFrame functions only.

Rules give spans of three kinds (``assign``, ``access``, ``hex``). The battery adds spans of kind ``random``:

1. Candidates are maximal runs of token characters of ``MIN_RUN`` or more that touch no rule span, and the parts of
   letters and digits of ``MIN_RUN`` or more in a run with separators (paths, slugs). A part counts only where the whole
   run is not found.
2. Each gets the encoding of the smallest alphabet that holds it (hex, base32, base36, base62, base64, base64url, and
   their union for runs with the signs of both).
3. Three tests: chi-squared statistic of uniformity over that alphabet, Wald-Wolfowitz runs of kinds of characters
   (digits, capitals, small letters, signs), lag-1 serial correlation of the digit values. Each has two tails. A candidate must not be rejected as random by
   any of the three (Bonferroni over the three, level ``ALPHA``). And each gives a p-value against the null "written by a
   person": that null repeats letters (coincidence ``PROSE_KAPPA``, so that the statistic is about normal with mean
   k(1+(n-1)kappa)-n), changes between kinds at a rate of at most ``PROSE_CHANGES`` (Chernoff's bound, sharpened), and has
   values that go with their neighbours (correlation ``PROSE_SERIAL`` in strings of several kinds).
4. Three times the smallest of the three p-values, and at most 1, is a p-value whatever depends on what (Bonferroni); that
   one is controlled. The harmonic mean alone is none: it may be too small by a factor of 2.7, and with that factor it is
   the larger of the two unless the three are about equal.
5. Benjamini-Hochberg at rate ``FDR`` within each length class over the candidates of the whole corpus. The p-values
   are counted in bins of 1/20 of a decade and each counts as its bin's upper edge, so the step is a sum over at most
   a few thousand bins, never a sort of all candidates, and errs on the side of fewer discoveries.

Nulls: a null text counts as empty. Rows with null ids and repeated rows give one row each, an empty table an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import durable

#: Fixed rule patterns, in their listed order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the 20+ long matches of AKIA[A-Z0-9]+: a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"  # the 24+ long matches of [0-9a-f]+, likewise
MIN_SECRET = 6
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHA = 1e-3
FDR = 0.01
PROSE_KAPPA = 0.06
PROSE_CHANGES = 0.1
PROSE_SERIAL = 0.25
LENGTH_CLASSES = (28, 40, 64, 128)
BINS_PER_DECADE = 20
FLOOR_P = 1e-290

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
#: name, pattern of the whole run, alphabet in digit order.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+={0,2}$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+={0,2}$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+={0,2}$", UPPER + LOWER + DIGITS + "-_"),
    ("union", "^[A-Za-z0-9+/_-]+={0,2}$", UPPER + LOWER + DIGITS + "+/-_"),
)
PART = r"[A-Za-z0-9]{20,}"


def _running(steps: Column) -> Column:
    """Exclusive running sums of an int array as longs, level by level: sums of blocks of BLOCK, of blocks of those, and
    back down, so that n entries take about n * 2 * BLOCK steps however many there are."""
    block = 16
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    deepest = 6  # 16 ** 6 matches and more cannot stand in a string of 2 ** 31 bytes

    def climb(values: Column, depth: int) -> Column:
        if depth == deepest:
            return F.transform(values, lambda _, i: add(F.slice(values, F.lit(1), i)))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: add(F.slice(values, b * block + 1, F.lit(block))))
        above = _let(sums, lambda v: F.when(F.size(v) > 1, climb(v, depth + 1)).otherwise(F.array(F.lit(0).cast("long"))))
        return _let(above, lambda up: F.transform(values, lambda _, i: F.get(up, F.floor(i / block).cast("int")) + add(F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block))))

    return _let(F.transform(steps, lambda x: x.cast("long")), lambda v: climb(v, 1))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _find(df: DataFrame, text: str, kind: str, pattern: str, value_group: int | None = None) -> DataFrame:
    """Adds ``_sp_<kind>``: array of (start, end, kind, body), leftmost and non-overlapping, code points."""
    col = F.col(text)
    pat = F.lit(pattern)
    hit = F.size(F.col("_m")) > 0
    empty = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_m", F.regexp_extract_all(col, pat, F.lit(0)))
    df = df.withColumn("_gap", F.when(hit, F.split(col, pattern, -1)).otherwise(empty))
    if value_group:
        df = df.withColumn("_val", F.when(hit, F.regexp_extract_all(col, pat, F.lit(value_group))).otherwise(empty))
    df = df.withColumn("_step", F.when(hit, F.zip_with("_gap", "_m", lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))))
    df = df.withColumn("_at", F.when(hit, _running(F.col("_step"))))
    body = F.col("_val") if value_group else F.col("_m")
    spans = F.transform(
        "_m",
        lambda m, i: F.struct(
            (F.get("_at", i) + F.length(F.get("_gap", i))).alias("start"),
            (F.get("_at", i) + F.length(F.get("_gap", i)) + F.length(m)).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.get(body, i).alias("body"),
        ),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:int,body:string>>)")
    df = df.withColumn(f"_sp_{kind}", F.when(hit, spans).otherwise(none))
    if value_group:
        df = df.withColumn(f"_sp_{kind}", F.filter(f"_sp_{kind}", lambda s: F.length(s["body"]) >= MIN_SECRET))
    return df.drop("_m", "_gap", "_val", "_step", "_at")


def _normal_cdf(z: Column) -> Column:
    """The standard normal distribution function; both tails keep their relative size.

    Series in 1/(1+pt) with exp(-z^2/2) outside: absolute error under 1.5e-7, and in the far tail the Mills ratio.
    """
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) * 0.3989422804014327
    tail = F.when(a < 5, density * poly).otherwise(density / (a + 1 / (a + 2 / (a + 3 / a))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _chi2_z(x: Column, df: Column) -> Column:
    """The normal quantile whose lower tail is the chi-squared upper tail at x (cube root of Wilson and Hilferty)."""
    v = 2 / (9 * df)
    return -(F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def battery(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``encoding``, ``p_uniform``, ``p_runs``, ``p_serial`` (against random strings), ``h_uniform``, ``h_runs``, ``h_serial``
    (against written ones) and ``p`` (the last three combined) for a column of strings.

    Strings outside all alphabets, of fewer than two characters, and null ones get nulls. Two-sided tests on constant
    strings give 0.
    """
    core = F.regexp_replace(F.col(body), "=+$", "")
    name, low, size = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for enc, pattern, alphabet in reversed(ENCODINGS):
        is_it = F.col(body).rlike(pattern)
        name = F.when(is_it, F.lit(enc)).otherwise(name)
        low = F.when(is_it, F.lit(alphabet)).otherwise(low)
        size = F.when(is_it, F.lit(float(len(alphabet)))).otherwise(size)
    df = df.withColumns({"encoding": name, "_abc": low, "_k": size, "_core": F.when(name == "hex", F.lower(core)).otherwise(core)})
    df = df.withColumn("_n", F.length("_core").cast("double"))
    df = df.withColumn("_chars", F.split("_core", ""))
    df = df.withColumn("_sq", F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda a, d: a + F.pow((F.length("_core") - F.length(F.replace("_core", d, F.lit("")))).cast("double"), F.lit(2.0))))
    df = df.withColumn("_x2", F.try_divide(F.col("_k") * F.col("_sq"), F.col("_n")) - F.col("_n"))
    df = df.withColumn("_runs", F.length(F.regexp_replace("_core", r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+", "x")).cast("double"))
    # how many characters are of each kind, and so the chance that two random ones in a row differ in kind
    share = lambda pattern: F.pow(F.try_divide(F.length(F.regexp_replace("_abc", pattern, "")).cast("double"), F.col("_k")), F.lit(2.0))
    df = df.withColumn("_alike", share("[^0-9]+") + share("[^A-Z]+") + share("[^a-z]+") + share("[0-9A-Za-z]+"))
    df = df.withColumn("_v", F.transform("_chars", lambda c: F.call_function("instr", F.col("_abc"), c).cast("double")))
    df = df.withColumn("_mean", F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x), F.col("_n")))
    df = df.withColumn("_var", F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))))
    df = df.withColumn(
        "_lag",
        F.aggregate(
            F.zip_with(F.slice("_v", F.lit(1), F.greatest(F.size("_v") - 1, F.lit(0))), F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))), lambda x, y: (x - F.col("_mean")) * (y - F.col("_mean"))),
            F.lit(0.0),
            lambda a, x: a + x,
        ),
    )
    df = df.withColumn("_r", F.try_divide(F.col("_lag"), F.col("_var")))
    n, k = F.col("_n"), F.col("_k")
    steps, changes = n - 1, F.col("_runs") - 1
    # changes of kind along a random string: each with the chance 1 - alike, nearly independent of one another
    mean, var = steps * (1 - F.col("_alike")), steps * (1 - F.col("_alike")) * F.col("_alike")
    z_runs = F.when(F.col("_alike") > 0.999, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(changes - mean, F.sqrt(var)), F.lit(-40.0)))
    z_serial = F.when(F.col("_var") > 0, (F.col("_r") + F.try_divide(F.lit(1.0), n)) * F.sqrt(n)).otherwise(F.lit(40.0))
    expect = k * (1 + (n - 1) * PROSE_KAPPA) - n
    surplus = F.greatest(expect - (k - 1), F.lit(0.0))
    z_prose = (F.col("_x2") - expect) / F.sqrt(2 * (k - 1 + 2 * surplus))
    z_human = F.when(F.col("_runs") > 1, (F.col("_r") - PROSE_SERIAL) * F.sqrt(n)).otherwise(F.lit(0.0))
    # Chernoff's bound of a binomial upper tail: exp(-steps * divergence of the rate seen from the null's)
    rate = F.least(F.greatest(F.try_divide(changes, steps), F.lit(PROSE_CHANGES)), F.lit(1 - 1e-9))
    away = rate * F.log(rate / PROSE_CHANGES) + (1 - rate) * F.log((1 - rate) / (1 - PROSE_CHANGES))
    # the tail is at most its first term times a geometric sum, and Stirling's formula bounds that term
    first = F.sqrt(steps / (2 * math.pi * changes * (steps - changes))) * (changes + 1) * (1 - PROSE_CHANGES) / (changes + 1 - (steps + 1) * PROSE_CHANGES)
    sharper = F.when((changes < steps) & (changes > steps * PROSE_CHANGES), F.least(first, F.lit(1.0))).otherwise(F.lit(1.0))
    known = F.col("encoding").isNotNull() & (n > 1)
    # each z is a column of its own, and the tails one lambda over their array: the expression trees stay small
    df = df.withColumn("_z", F.when(known, F.array(_chi2_z(F.col("_x2"), k - 1), -F.abs(z_runs), -F.abs(z_serial), z_prose, z_human)))
    df = df.withColumn("_p", F.transform("_z", _normal_cdf))
    df = df.withColumns(
        {
            "p_uniform": F.when(known, F.get("_p", F.lit(0))),
            "p_runs": F.when(known, 2 * F.get("_p", F.lit(1))),
            "p_serial": F.when(known, 2 * F.get("_p", F.lit(2))),
            "h_uniform": F.when(known, F.greatest(F.get("_p", F.lit(3)), F.lit(FLOOR_P))),
            "h_runs": F.when(known, F.greatest(sharper * F.exp(-steps * away), F.lit(FLOOR_P))),
            "h_serial": F.when(known, F.greatest(F.get("_p", F.lit(4)), F.lit(FLOOR_P))),
        }
    )
    df = df.withColumn("p", F.when(known, combined(F.col("h_uniform"), F.col("h_runs"), F.col("h_serial"))))
    return df.drop("_z", "_p", "_abc", "_k", "_core", "_n", "_chars", "_sq", "_x2", "_runs", "_alike", "_v", "_mean", "_var", "_lag", "_r")


def combined(*ps: Column) -> Column:
    """One p-value of several that may depend on each other in any way."""
    return F.least(F.lit(1.0), len(ps) * F.least(*ps))


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= cut, 1).otherwise(0) for cut in LENGTH_CLASSES[1:]), F.when(n >= LENGTH_CLASSES[0], 1).otherwise(0))


def _bin(p: Column) -> Column:
    return F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")


def discovery_limits(cands: DataFrame) -> DataFrame:
    """One row per length class: the lowest bin number (largest p) that Benjamini-Hochberg accepts.

    ``cands`` has ``lc`` and ``bin``. The bins are pre-aggregated before the only shuffle, and a class has at most
    290 * BINS_PER_DECADE of them.
    """
    counts = cands.groupBy("lc", "bin").agg(F.count("*").alias("c"))
    up = Window.partitionBy("lc").orderBy(F.col("bin").desc())
    counts = counts.withColumns({"below": F.sum("c").over(up), "m": F.sum("c").over(Window.partitionBy("lc"))})
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return counts.filter(edge <= FDR * F.col("below") / F.col("m")).groupBy("lc").agg(F.min("bin").alias("limit"))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``spans``: array of (start, end, kind) sorted by start, then kind; one row per input row.

    ``kind`` is the index into KINDS. The scanned candidates are written once as a small table, so the whole texts
    are read once although the discovery limits depend on all of them.
    """
    df = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keys = [f"k{i}" for i in range(len(keep))]
    df = _find(df, "_text", "assign", ASSIGN, 2)
    df = _find(df, "_text", "access", ACCESS)
    df = _find(df, "_text", "hex", HEX)
    df = _find(df, "_text", "random", CANDIDATE)
    base = F.concat("_sp_assign", "_sp_access", "_sp_hex")
    df = df.select(*keys, base.alias("base"), F.col("_sp_random").alias("cand"))
    df = df.withColumn("cand", F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    df = durable(df.withColumn("base", F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"]))).withColumn("_row", F.expr("uuid()")))
    cands = df.select("_row", F.explode("cand").alias("c")).select("_row", "c.start", "c.end", "c.kind", "c.body")
    # the parts of letters and digits of runs with separators stand beside the runs
    parts = _find(cands.filter(F.col("body").rlike("[+/_-]")), "body", "random", PART).select("_row", F.col("start").alias("_s"), F.explode("_sp_random").alias("c"))
    parts = parts.select("_row", (F.col("_s") + F.col("c.start")).alias("start"), (F.col("_s") + F.col("c.end")).alias("end"), "c.kind", "c.body")
    cands = battery(cands.unionByName(parts)).select(
        "_row", "start", "end", "kind", (F.least("p_uniform", "p_runs", "p_serial") >= ALPHA / 3).alias("even"), _length_class(F.length("body")).alias("lc"), _bin(F.col("p")).alias("bin")
    )
    cands = durable(cands).filter(F.col("bin").isNotNull())
    limits = discovery_limits(cands)
    found = cands.join(F.broadcast(limits), "lc").filter(F.col("even") & (F.col("bin") >= F.col("limit")))  # one row per length class
    found = found.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))  # what one text holds
    inside = lambda s: F.exists("more", lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))
    found = found.withColumn("more", F.filter("more", lambda s: ~inside(s)))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:int>>)")
    out = df.join(found, "_row", "left").withColumn("_all", F.concat("base", F.coalesce("more", empty)))
    order = F.transform("_all", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    spans = F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], spans.alias("spans"))


def span_string(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``.

    The pieces between spans are cut out one by one and put together once, so the text is not copied for each span.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<at:bigint,to:bigint>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("at"), s["start"].alias("to")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    cut = lambda a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))
    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), F.length(text).cast("long").alias("to"))))
    return F.array_join(F.transform(F.aggregate(spans, start, step, last), lambda g: cut(g["at"], g["to"])), mark)


def op1(df: DataFrame) -> DataFrame:
    """The contract's digest of ``scan`` over documents."""
    got = scan(df)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )
