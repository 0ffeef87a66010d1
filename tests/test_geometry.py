import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry, vectors


def test_smart_resize(spark):
    cases = {(224, 392): (252, 420, 540), (480, 640): (476, 644, 1564), (1080, 1920): (420, 784, 1680), (64, 64): (336, 336, 576), (10, 3000): (28, 5488, 784)}
    df = spark.createDataFrame(list(cases), "h int, w int")
    for r in df.select("h", "w", geometry.smart_resize(F.col("h"), F.col("w")).alias("s"), geometry.image_tokens(F.col("h"), F.col("w")).alias("t")).collect():
        assert (r["s"]["height"], r["s"]["width"], r["t"]) == cases[r["h"], r["w"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4000), st.integers(1, 4000)), min_size=1, max_size=60))
def test_smart_resize_formula(sizes):
    from pyspark.sql import SparkSession

    f, lo, hi = 28, 100352, 351232
    df = SparkSession.getActiveSession().createDataFrame(sizes, "h int, w int")
    for r in df.select("h", "w", geometry.smart_resize(F.col("h"), F.col("w")).alias("s")).collect():
        h, w = r["h"], r["w"]
        hb, wb = max(f, round(h / f) * f), max(f, round(w / f) * f)
        if hb * wb > hi:
            b = math.sqrt(h * w / hi)
            hb, wb = max(f, math.floor(h / b / f) * f), max(f, math.floor(w / b / f) * f)
        elif hb * wb < lo:
            b = math.sqrt(lo / (h * w))
            hb, wb = math.ceil(h * b / f) * f, math.ceil(w * b / f) * f
        assert (r["s"]["height"], r["s"]["width"]) == (hb, wb)


def test_box_cells_and_patches(spark):
    g = lambda *b: spark.range(1).select(geometry.box_cells(*map(F.lit, b), F.lit(10), F.lit(10)).alias("c")).first()["c"]
    assert (g(0.0, 0.0, 1.0, 1.0)["c1"], g(0.0, 0.0, 1.0, 1.0)["c2"]) == (0, 10)
    assert tuple(g(0.55, 0.2, 0.55, 0.2)) == (5, 6, 2, 3)
    cells = spark.range(8).select(geometry.patch_cell(F.col("id"), F.lit(4)).alias("c")).collect()
    assert [tuple(c["c"]) for c in cells] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def test_vectors_and_schedule(spark):
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(vectors.l2_normalise(F.col("a")), vectors.l2_normalise(F.col("b")), vectors.dot(F.col("a"), F.col("a"))).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], 25.0]
    got = [x[0] for x in spark.createDataFrame([(0,), (199,), (200,), (5000,), (9000,)], "s int").select(vectors.cosine_warmup(F.col("s"), 200, 5000)).collect()]
    assert [round(x, 6) for x in got] == [0.005, 1.0, 1.0, 0.0, 0.0]
