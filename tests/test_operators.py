import math

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import batch, ingest, losses, metrics, negatives, regions, retrieval, triplets


def test_dedup_and_split(spark):
    df = spark.createDataFrame([(0, b"A", True), (1, b"B", True), (2, b"A", True), (3, b"C", False), (4, b"C", False)], "o int, c binary, ok boolean")
    assert sorted(r["o"] for r in ingest.exact_dedup(df, F.col("c"), F.col("o"), F.col("ok")).collect()) == [0, 1]
    for n, want in ((0, 0), (1, 1), (250, 2), (1000, 10)):
        assert ingest.train_eval_split(spark.range(n), "id").filter("split = 'eval'").count() == want
    names = spark.createDataFrame([("ckpt_step20.pt",), ("ckpt_step1000.pt",), ("ckpt_step200.pt",), ("other",)], "name string")
    assert [r["step"] for r in ingest.newest_checkpoints(names, 2).collect()] == [1000, 200]


def test_triplets(spark):
    rows = [("a", "p%d" % i, 1, None, None, i) for i in range(3)] + [("a", "n%d" % i, 0, s, 0.9, 10 + i) for i, s in enumerate([0.1, 0.5, 0.5, 0.7, None, 0.2])]
    rows += [("b", "p", 1, 0.9, 0.9, 0), ("c", "n", 0, 0.9, 0.9, 0)]
    df = spark.createDataFrame(rows, "image string, text string, label int, teacher_score double, conf double, o int")
    got = triplets.nest(triplets.mine(df, [F.col("o")])).collect()
    assert len(got) == 1
    assert [c["text"] for c in got[0]["candidates"]] == ["p0", "p1", "n3", "n1", "n2", "n5"]
    assert got[0]["candidates"][0]["teacher_score"] == 0.95 and got[0]["candidates"][0]["conf"] == 0.5
    flat = triplets.flatten(triplets.nest(triplets.mine(df, [F.col("o")])))
    assert flat.count() == 6


def test_regions_reproduce_the_golden(spark):
    box = [0.0, 0.21663931012153625, 0.5687794089317322, 0.9677038192749023]
    reg = spark.createDataFrame([("img.png", "cap", [("一辆黑色汽车", box, 0.9578), ("无", box, 0.5)]), ("none.png", "cap", [("x", box, 0.5)])], "image string, caption string, regions array<struct<expr:string,bbox:array<double>,conf:double>>")
    neg = spark.createDataFrame([("img.png", "一辆黑色汽车", ["old"], 0), ("img.png", "一辆黑色汽车", ["一辆红色汽车", "一辆金色汽车"], 1)], "image string, expr string, hard array<string>, ord int")
    got = regions.assemble(reg, neg).collect()
    assert len(got) == 1 and [r.asDict() for r in got[0]["regions"]] == [{"expr": "一辆黑色汽车", "bbox": box, "conf": 0.9578, "hard": ["一辆红色汽车", "一辆金色汽车"]}]
    flat = regions.candidates_of_regions(regions.assemble(reg, neg)).orderBy("pos").collect()
    assert [(r["text"], r["n"]) for r in flat] == [("一辆黑色汽车", 3), ("一辆红色汽车", 3), ("一辆金色汽车", 3)]


def test_boxes(spark):
    det = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 1.0, 1.0, 0.5), ("a", 0, 1, 0.0, 0.0, 1.0, 0.9, 0.5), ("a", 0, 2, 2.0, 2.0, 3.0, 3.0, 0.4), ("a", 1, 0, 0.0, 0.0, 1.0, 1.0, 0.05)], "image string, cls int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    assert [r["det_idx"] for r in regions.best_boxes(det).collect()] == [0]
    assert sorted((r["cls"], r["det_idx"]) for r in regions.greedy_nms(det).collect()) == [(0, 0), (0, 2), (1, 0)]
    caps = spark.createDataFrame([("a", "一个红色的球"), ("b", "nothing")], "image string, caption string")
    assert [r["expressions"] for r in regions.expressions(caps).collect()] == [["一个红色的球"]]


def test_negatives(spark):
    df = spark.createDataFrame([("a", "一辆黑色汽车", "1. 一辆红色汽车\n完全不同的一句很长的话\n一辆黑色汽车"), ("b", "一辆黑色汽车", None), ("c", "无", "")], "image string, expr string, raw string")
    got = {r["image"]: r["hard"] for r in negatives.hard_negatives(df).collect()}
    assert got["a"][0] == "一辆红色汽车" and len(got["a"]) == 2 and len(got["b"]) == 2 and "c" not in got
    r = spark.createDataFrame([("一辆黑色汽车", "一辆红色汽车")], "a string, b string").select(negatives.sequence_ratio("a", "b")).first()[0]
    assert round(r, 4) == 0.8333


def test_batch_resume(spark):
    task = batch.TASKS["judge"]
    recs = spark.createDataFrame([("a", "R1", "t"), ("a", "R1", "t"), ("b", "R2", "t")], "image string, reason_id string, reason_text string")
    todo = batch.pending(recs, None, task)
    assert todo.count() == 2
    good = '{"label":"相关","analysis":"long enough text","confidence":1}'
    answered = batch.infer(todo, task, lambda prompts, images: [good if i == "a" else "x" * 900 for i in images])
    ok, bad = batch.split_results(answered, task)
    assert [r["teacher_score"] for r in ok.collect()] == [1.0] and len(bad.first()["raw_output"]) == 500
    assert batch.pending(recs, ok, task).count() == 1 and batch.retry_failures(bad, ok).count() == 1

    def broken(prompts, images):
        raise RuntimeError

    assert batch.split_results(batch.infer(todo, task, broken), task)[1].count() == 2


def sims(spark, m):
    return spark.createDataFrame([(i, j, float(s)) for i, row in enumerate(m) for j, s in enumerate(row)], "i long, j long, s double")


def sides(spark, m):
    """Two sets of vectors whose inner products are the table ``m``."""
    n = len(m)
    left = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "i long, u array<double>")
    return left, spark.createDataFrame([(j, [float(j == k) for k in range(n)]) for j in range(n)], "j long, v array<double>")


def test_recall(spark):
    eye = [[1.0 if i == j else 0.0 for j in range(12)] for i in range(12)]
    got = {r["metric"]: r["value"] for r in retrieval.recall_at_k(*sides(spark, eye)).collect()}
    assert set(got.values()) == {1.0} and "i2t_R@10" in got
    three = {r["metric"]: r["value"] for r in retrieval.recall_at_k(*sides(spark, [[1, 0, 0], [1, 1, 0], [0, 0, 1]])).collect()}
    assert three["i2t_R@1"] == round(2 / 3, 4) and three["hit@5"] == three["i2t_R@1"] and "i2t_R@3" in three
    assert retrieval.recall_at_k(*sides(spark, [])).count() == 0


def test_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[200], x[300] = 2 * x[7], x[123] + 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    q = df.filter("vec_id in (7, 123)").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(q, df, 3).collect()}
    assert got[7, 1] == 7 and got[7, 2] == 200 and got[123, 1] in (123, 300)
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.top_k(df.withColumnRenamed("vec_id", "query_id"), df, 5).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in retrieval.ann_top_k(df.withColumnRenamed("vec_id", "query_id"), df, 5, retrieval.train_cells(df, 8), 6).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert retrieval.top_k(q.limit(0), df, 3).count() == 0


def test_losses(spark):
    assert abs(losses.info_nce(sims(spark, [[0.3]]), 5.0).first()["loss"]) < 1e-12
    m = [[0.9, 0.1], [0.4, 0.7]]
    ce = lambda row, g: math.log(sum(math.exp(5 * x) for x in row)) - 5 * row[g]
    want = (ce(m[0], 0) + ce(m[1], 1) + ce([0.9, 0.4], 0) + ce([0.1, 0.7], 1)) / 4
    assert abs(losses.info_nce(sims(spark, m), 5.0).first()["loss"] - want) < 1e-9
    sig = sum(math.log1p(math.exp(-(1 if i == j else -1) * (math.e * m[i][j] - 1))) for i in range(2) for j in range(2)) / 2
    assert abs(losses.pairwise_sigmoid(sims(spark, m), 1.0, -1.0).first()["loss"] - sig) < 1e-9
    c = spark.createDataFrame([("a", 1, 0.5, 0.9), ("a", 0, 0.6, 0.1), ("a", 0, 0.2, 0.1), ("b", 1, 0.1, 0.5)], "anchor string, label int, s double, teacher_score double")
    assert abs(losses.triplet_loss(c).first()["loss"] - 0.3) < 1e-9 and losses.triplet_loss(c.filter("label = 1")).first()["loss"] == 0
    assert losses.distillation_loss(c, weight=F.lit(0.0)).first()["loss"] == 0
    assert losses.info_nce(sims(spark, []), 1.0).count() == 0


def test_metrics(spark):
    log = spark.createDataFrame([(20, 2.0, None, 1), (20, 1.0, None, 2), (20, None, {"hit@5": 0.1}, 3)], "step int, loss double, final_eval map<string,double>, o int")
    for c in ("lr", "tau", "bias", "grad_norm", "samples_per_s"):
        log = log.withColumn(c, F.lit(None).cast("double"))
    log = log.withColumn("eval", F.lit(None).cast("map<string,double>"))
    assert [r["loss"] for r in metrics.training_curve(log, "o").collect()] == [1.0]
    assert [tuple(r) for r in metrics.evaluation_curve(log).collect()] == [(20, "hit@5", 0.1)]
    assert text.RULES.strategies[0][0][0] == "红色"
