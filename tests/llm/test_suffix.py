import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import common, suffix_dedup


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        runs = []
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + d[at:s], e
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op3(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_against_brute_force(spark, rows):
    check(spark, [t for _, t, *_ in rows])


def test_periodic_shared_and_edge_cases(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = word(230)
    texts = ["ab" * 300, "ab" * 100, "a" * 199, "a" * 200, "a" * 201, shared, "x" + shared + word(100), word(50) + shared[:205], word(77) + shared[20:219] + "q", None, "", shared[:200], word(300)]
    texts += [word(100) + shared[i : i + 210] + word(60) for i in range(0, 20, 3)]
    check(spark, texts)


def test_hot_anchors_and_overfull_cores(spark, monkeypatch):
    """Every branch of hot keys and of shorter and shorter blocks, against brute force."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 40)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, tail = word(170), word(40)
    texts = [word(60) + core + word(60) for _ in range(30)]  # one passage below the length in many surroundings
    texts += [word(rng.randrange(50)) + word(3) + core + tail[: rng.randrange(41)] + word(30) for _ in range(30)]
    texts += [texts[0]] * 5 + [texts[40][10:]] * 3 + [word(20) + core[:150] + tail for _ in range(10)]
    for most in (2, 20, 1000):
        monkeypatch.setattr(suffix_dedup, "CORE", most)
        check(spark, texts)


def test_other_columns_and_string_ids(spark):
    text = "one passage that stands here twice over and over " * 6
    df = spark.createDataFrame([("a", text, 1), ("b", text + "x", 2), (None, text, 3)], "doc_id string, text string, nb int").withColumn("key", F.lit("k")).withColumn("cuts", F.lit(0)).withColumn("h", F.lit(1))
    got = suffix_dedup.op3(df).collect()
    assert len(got) == 3 and all(r["n_removed"] >= 290 for r in got)


def test_empty(none):
    assert suffix_dedup.op3(none).count() == 0


def test_columns():
    got = suffix_dedup.repeated_columns([b"xxabcdef", b"abcdefzz", b"qqqqqqqq"], [0, 0, 0], 4)
    assert [list(c) for c in got] == [[], [], []]
    got = suffix_dedup.repeated_columns([b"xxabcdef", b"zzabcdeg", b"qqqqqqqq"], [0, 0, 0], 4)
    assert [list(c) for c in got] == [[2, 3], [2, 3], []]
