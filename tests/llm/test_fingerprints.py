import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp


def rolling(text):
    """Karp-Rabin hashes, each from the one before."""
    if 0 < len(text) < fp.K:
        text += "\0" * (fp.K - len(text))
    codes = [zlib.crc32(c.encode()) for c in text]
    if not codes:
        return []
    top = pow(fp.BASE, fp.K - 1, fp.PRIME)
    h = 0
    for c in codes[: fp.K]:
        h = (h * fp.BASE + c) % fp.PRIME
    out = [h]
    for old, new in zip(codes, codes[fp.K :]):
        h = ((h - old * top) * fp.BASE + new) % fp.PRIME
        out.append(h)
    return out


def winnow(text):
    """(hash, position) of the rightmost smallest hash of each window."""
    hashes = rolling(text)
    n = len(hashes)
    out = []
    for j in range(max(n - fp.W, 0) + 1 if n else 0):
        w = hashes[j : j + fp.W]
        i = j + max(k for k in range(len(w)) if w[k] == min(w))
        if not out or out[-1] != (hashes[i], i):
            out.append((hashes[i], i))
    return out


def unpacked(choices):
    return [(p >> 31, fp.MASK - (p & fp.MASK)) for p in choices]


def texts():
    rng = random.Random(2)
    said = ["".join(rng.choice("ab é漢🙂\n") for _ in range(n)) for n in (*range(0, 30), 63, 64, 86, 87, 88, 150, 400, 1000)]
    return said + ["a" * 500, "".join(rng.choice("abcdefghij") for _ in range(3000)), None]


@pytest.mark.parametrize("segment", [1 << 16, 100, 7])
def test_choices_match_a_rolling_hash_and_every_window(spark, monkeypatch, segment):
    monkeypatch.setattr(fp, "SEGMENT", segment)
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for r in df.select("text", fp.chosen(F.col("text")).alias("c")).collect():
        assert unpacked(r["c"]) == winnow(r["text"])


def test_choices_of_joined_texts_are_those_of_the_whole(spark):
    rng = random.Random(6)
    rows = []
    for t in texts()[:-1]:
        for same in {0, len(t) // 2, len(t) - len(t) // 4, len(t)}:
            for n in (0, 5, 79, 160, 400):
                other = "".join(rng.choice("xyz é🙂") for _ in range(n))
                q = rng.randrange(n + 1)
                rows.append((t, other, t[:same] + other[:q], same))
    df = spark.createDataFrame(rows, "text string, other string, joined string, same int")
    got = df.withColumn("a", fp.chosen(F.col("text"))).withColumn("b", fp.chosen(F.col("other")))
    got = got.withColumn("c", fp.chosen_when_joined(F.col("a"), F.col("joined"), F.col("same"), F.col("b"))).collect()
    for r in got:
        assert unpacked(r["c"]) == winnow(r["joined"]), (len(r["text"]), r["same"], len(r["joined"]))


def test_edited_texts(spark, docs, rows, none):
    got = fp.op10(docs).collect()
    assert len(got) == len(rows)
    ids = sorted({d for d, *_ in rows if d is not None})
    text = {d: t or "" for d, t, *_ in rows}
    nxt = dict(zip(ids, ids[1:] + ids[:1]))
    by = {}
    for r in got:
        t = text[r["doc_id"]]
        q = len(t) // 4
        e = t[: len(t) - q] + (text[nxt[r["doc_id"]]][:q] if r["doc_id"] is not None else "")
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    big = [r for r in got if r["n_chars"] > 600 and r["doc_id"] < 100]
    assert min(r["near_edited"] for r in big) > 0.25 and max(r["near_next"] for r in big if r["doc_id"] % 9) < 0.5
    assert fp.op10(none).count() == 0


def test_shared_passages_share_a_choice(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("pqrstuvw") for _ in range(fp.K + fp.W - 1))
    df = spark.createDataFrame([(1, "some words " * 9 + passage + " tail" * 20), (2, "x " * 33 + passage)], "doc_id long, text string")
    a, b = (set(r["fingerprint"].split(",")) for r in fp.op10(df).collect())
    assert a & b


def test_texts_without_spaces_and_string_ids(spark):
    rng = random.Random(4)
    rows = [("k%02d" % i, "".join(rng.choice("漢字仮名交文章の例") for _ in range(4000)), "clash", 1) for i in range(6)]
    got = fp.op10(spark.createDataFrame(rows, "doc_id string, text string, choices string, _next int")).collect()
    assert all(0.5 < r["near_edited"] < 0.7 and r["near_next"] < 0.1 for r in got)
    by = {d: t for d, t, *_ in rows}
    for r in got:
        t, n = by[r["doc_id"]], by["k%02d" % ((int(r["doc_id"][1:]) + 1) % 6)]
        assert r["edited_sha256"] == hashlib.sha256((t[:3000] + n[:1000]).encode()).hexdigest()
