import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, rules


def test_base_counts(docs, rows):
    got = rules.op4(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = by[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert not by[305]["kept"]


def test_outliers_are_found_and_the_rest_stays(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"word{rng.randrange(10, 100)}" for _ in range(n))
    rows = [(i, prose(80), "en", "hot" if i % 3 else None) for i in range(300)]
    rows.append((999, " ".join("w###%d" % k for k in range(80)), "en", "hot"))
    # junk of middling strength: three in ten words stand in repeated lines of ten, within the base rule
    line = " ".join(f"agai{k}7" for k in range(10))
    rows.append((998, prose(140) + f"\n{line}" * 6, "en", "hot"))
    # a clean text with one repeated line of eight words
    line = " ".join(f"once{k}7" for k in range(8))
    rows.append((997, prose(60) + f"\n{line}\n{line}", "en", "hot"))
    got = {r["doc_id"]: r for r in rules.op4(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[999]["kept"] and not got[998]["kept"] and not got[998]["base_failed"] and got[997]["kept"]
    assert all(r["kept"] for d, r in got.items() if d < 900)


def test_estimates_are_those_of_the_best_half_of_all_halves(spark):
    rng = np.random.default_rng(11)
    groups, rows = {}, []
    for gid in range(4):
        n = 12 + gid
        x = rng.normal(0, 120, (n, 4)) @ rng.normal(0, 0.6, (4, 4)) + 500
        x[: gid + 2] += rng.choice([-1, 1], (gid + 2, 4)) * 4000
        groups[gid] = x.round().astype(int)
        rows += [(gid, *map(int, r)) for r in groups[gid]]
    df = spark.createDataFrame(rows, "gid long, x0 long, x1 long, x2 long, x3 long")
    got = {r["gid"]: r for r in rules.minimum_covariance(df, 4).collect()}
    floor = np.diag([(rules.UNIT * f) ** 2 for f in rules.FLOORS])
    for gid, x in groups.items():
        n = len(x)
        h = (n + 5 + 1) // 2 if (n + 5) % 2 else (n + 5) // 2
        best = min((x[list(c)] for c in combinations(range(n), h)), key=lambda y: np.linalg.det(rules.CONSISTENCY * np.cov(y.T, bias=True) + floor))
        r = got[gid]
        cov = np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        assert r["n"] == n
        want, have = (np.linalg.det(rules.CONSISTENCY * c + floor) for c in (np.cov(best.T, bias=True), cov))
        assert have <= want * 2 and np.abs([r[f"m{i}"] for i in range(4)] - best.mean(axis=0)).max() < 150


def test_how_rows_are_dealt_out_and_other_columns_do_not_matter(spark, docs, monkeypatch):
    want = sorted(map(str, rules.op4(docs).collect()))
    other = docs.repartition(7).withColumn("gid", F.lit("x")).withColumn("d2", F.lit(1)).withColumn("n_words", F.lit(None).cast("string"))
    assert sorted(map(str, rules.op4(other).collect())) == want
    monkeypatch.setattr(rules, "FEW_GROUPS", 0)  # nothing is broadcast but hot groups
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(map(str, rules.op4(docs).collect())) == want


def test_empty(none):
    assert rules.op4(none).count() == 0
