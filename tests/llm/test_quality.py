import zlib

import numpy as np

from tessera.llm import quality


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op5(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert got and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_density_matches_the_textbook():
    rng = np.random.default_rng(1)
    p = len(quality.NAMES)
    a, b = rng.normal(0, 1, (400, p)), rng.normal(0.5, 2, (300, p))
    sums = {c: (float(len(x)), x.sum(0), x.T @ x) for c, x in ((0, a), (1, b))}
    m = quality.fit_from_sums(sums)
    x = rng.normal(0, 1, (5, p))
    z = (x - m.centre) / m.scale
    logs = []
    for mean, inv in zip(m.means, m.inverse_factors):
        cov = np.linalg.inv(inv.T @ inv)
        d = z - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(quality.TEMPER * (logs[1] - logs[0]) + m.log_prior)))
    assert np.allclose(m.score(x), want)


def test_odd_rows(docs, rows, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 0), (305, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op5(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.op5(none, labels).count() == 0 and quality.op5(docs, labels.limit(0)).count() == len(rows)
