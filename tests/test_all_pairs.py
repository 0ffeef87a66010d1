import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import losses, retrieval, tiles
from tessera.plans import catalog

N = 450


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(N, 64))
    v = u + rng.normal(size=(N, 64)) * 2.5
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v))
    rows = [(2 * i + k, x[i].tolist()) for i in range(N) for k, x in enumerate((u, v))]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    return sf, u, v


def test_recall_reads_every_pair(spark, pairs, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 60)
    sf, u, v = pairs
    s = u @ v.T
    want = {}
    for name, m in (("i2t", s), ("t2i", s.T)):
        rank = 1 + (m > np.diag(m)[:, None]).sum(axis=1)
        want |= {f"{name}_R@{k}": round(float((rank <= k).mean()), 4) for k in (1, 5, 10)}
    want["hit@5"] = want["i2t_R@5"]
    got = {r["metric"]: r["value"] for r in catalog.QUERIES["recall_at_k"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-4) and 0.1 < want["i2t_R@1"] < 0.9


def test_losses_read_every_batch(spark, pairs):
    sf, u, v = pairs
    ce, sig = [], 0.0
    for lo in range(0, N, catalog.EVAL_BATCH):
        s = u[lo : lo + catalog.EVAL_BATCH] @ v[lo : lo + catalog.EVAL_BATCH].T
        for m in (s * 20, s.T * 20):
            ce += (np.log(np.exp(m).sum(axis=1)) - np.diag(m)).tolist()
        z = np.where(np.eye(len(s)) > 0, 1, -1) * (10 * s - 10)
        sig += np.log1p(np.exp(-z)).sum()
    one = lambda name: catalog.QUERIES[name](spark, sf).first()["loss"]
    assert one("info_nce_loss") == pytest.approx(np.mean(ce), abs=2e-6)
    assert one("sigmoid_loss") == pytest.approx(sig / N, abs=2e-6)


def test_top_k_by_tiles(spark, monkeypatch):
    """Many blocks, stripes and seeds; ties over blocks; clustered vectors, so that most tiles are out of reach."""
    for name, value in (("BLOCK_ROWS", 40), ("STRIPE", 2), ("GROUP", 3)):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(9)
    centres = np.eye(12) * 5
    data = np.round(centres[rng.integers(0, 12, 700)] + rng.normal(0, 0.3, (700, 12)), 2)
    data[100:160] = data[100]  # ties
    rows = [(int(i), data[i].tolist()) for i in rng.permutation(700)]
    corpus = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = corpus.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.top_k(queries, corpus, 7, normalise=False).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    s = np.round(data @ data.T, 12)
    for q in range(0, 700, 3):
        want = np.lexsort((np.arange(700), -s[q]))[:7].tolist()
        assert [got[q][k][0] for k in range(1, 8)] == want
        assert [got[q][k][1] for k in range(1, 8)] == pytest.approx(s[q][want].tolist())
    assert len(got) == 234


def test_tiles_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    data = (np.eye(10) * 10)[np.repeat(np.arange(10), 50)] + rng.normal(0, 0.05, (500, 10))
    df = spark.createDataFrame([(i, v.tolist(), float((v * v).sum()) - 1) for i, v in enumerate(data)], "id long, v array<double>, need double")
    blocks = tiles.pack(df, "id", "v", 500, F.col("need"))
    n = blocks.count()
    pairs = tiles.plan(blocks, blocks, 500, 500, tiles.within_reach).collect()
    assert n >= 10 and n <= len(pairs) < n * n / 2


@pytest.mark.parametrize("size", [1, 130])
def test_one_batch_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 30)
    monkeypatch.setattr(tiles, "STRIPE", 2)
    rng = np.random.default_rng(size)
    u, v = rng.normal(size=(size, 8)) * 4, rng.normal(size=(size, 8)) * 4  # logits of thousands: no exponential of them is finite
    rows = spark.createDataFrame([(i, u[i].tolist(), v[i].tolist(), i % 3 // 2) for i in range(size)], "i long, u array<double>, v array<double>, rank int")
    s = u @ v.T
    lse = lambda m: m.max(axis=1) + np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1))
    want = np.mean([lse(50 * s) - 50 * np.diag(s), lse(50 * s.T) - 50 * np.diag(s)])
    assert losses.batch_info_nce(rows, 50.0).first()["loss"] == pytest.approx(want)
    x = np.where(np.eye(size) > 0, 1, -1) * (3 * s + 0.5)
    per = np.maximum(-x, 0) + np.log1p(np.exp(-np.abs(x)))
    assert losses.batch_sigmoid(rows, np.log(3.0), 0.5).first()["loss"] == pytest.approx(per.sum() / size)
    one = (per.sum(axis=1) + per.sum(axis=0)) / 2
    got = {r["rank"]: r for r in losses.batch_sigmoid(rows, np.log(3.0), 0.5, "rank").collect()}
    ranks = np.arange(size) % 3 // 2
    for r in set(ranks.tolist()):
        assert got[r]["loss"] == pytest.approx(one[ranks == r].mean()) and got[r]["n"] == (ranks == r).sum()
    assert min(r["padding"] for r in got.values()) == 0


def test_no_pairs(spark):
    none = spark.createDataFrame([], "i long, u array<double>, v array<double>, rank int")
    assert losses.batch_info_nce(none, 1.0).count() == losses.batch_sigmoid(none, 1.0, 1.0).count() == losses.batch_sigmoid(none, 1.0, 1.0, "rank").count() == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    sf = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4096, 64)) / 8)], "vec_id long, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    return sf


def _moved(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(False)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


@pytest.mark.parametrize("name", ["topk_both_ways", "recall_at_k", "sigmoid_one_batch", "sigmoid_by_rank"])
def test_blocks_move_once_a_stripe(spark, many, monkeypatch, name):
    """64 blocks of 16 KB a side: 64 MB if every block went to every other."""
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 32)
    before = _moved(spark)
    assert catalog.QUERIES[name](spark, many).collect()
    assert _moved(spark) - before < 40e6


def test_approximate_search_by_parts(spark, monkeypatch):
    """All cells probed, so that the result is exact; many parts, ties, and rows without a vector. Pairs are never rows."""
    monkeypatch.setattr(retrieval, "CELL_ROWS", 20)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 16))
    data[200:220] = data[200]
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(400, None)], "vec_id long, v array<double>")
    queries = corpus.filter("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    found = retrieval.ann_top_k(queries, corpus, 5, retrieval.train_cells(corpus, 6), 6)
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    s = np.round(data @ data.T, 12)
    want = {(q, k + 1): int(i) for q in range(0, 400, 4) for k, i in enumerate(np.lexsort((np.arange(400), -s[q]))[:5])}
    assert got == want
