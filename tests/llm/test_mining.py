import random

import numpy as np
import pytest

from tessera.llm import mining

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cell int"


def brute(rows):
    """anchor, positive, rank, negative and scores with Python's integers; a row is (vec_id, embedding, label)."""
    good = [(i, [int(np.floor(256 * float(x))) for x in e], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, e, lab in rows if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, va, la in {(i, tuple(v), lab) for i, v, lab in good if i is not None and i % 100 == 0}:
        scores = [(dot(va, v), i, lab) for i, v, lab in good if i != a]
        for p, pid, _ in sorted((s for s in scores if s[2] == la), key=order)[:5]:
            negatives = sorted((s for s in scores if s[2] != la and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(a, pid, r, nid, p, n) for r, (n, nid, _) in enumerate(negatives, 1)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def vectors(n, dims, seed, step=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(0, n * step, step):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in c], rng.randrange(10)))
    return rows


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LIST_ROWS", 20), ("STRIPE_ROWS", 100), ("CHUNK", 7)):
        monkeypatch.setattr(mining, name, value)


def check(spark, rows):
    got = sorted((tuple(r) for r in mining.op11(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_equals_brute_force(spark, small):
    assert check(spark, vectors(700, 16, 1))


def test_ties_repeats_nulls_and_odd_vectors(spark, small):
    rows = vectors(120, 4, 2, 25)
    rows += [(i, rows[8][1], lab) for i, lab in zip(range(10_001, 10_200), [rows[8][2], 3] * 100)]  # one vector, many times
    rows += rows[4:8] * 2  # whole rows again, an anchor among them
    rows += [(20_000, None, 1), (20_100, [0.1, None, 0.2, 0.3], 1), (20_200, [float("nan")] * 4, 1), (20_300, [float("inf")] * 4, 1), (20_400, [0.1] * 4, None)]
    rows += [(None, rows[8][1], rows[8][2]), (None, rows[9][1], 4), (20_500, [0.25], 2), (20_600, [], 2), (20_700, [0.0] * 4, 2), (20_800, [-0.3] * 4, 5)]
    check(spark, rows)


def test_few_rows_and_no_rows(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1)]) == []


def test_large_components_are_exact_and_too_large_ones_fail(spark):
    big = [(i, [float(np.float32(x * 2.0**20)) for x in e], lab) for i, e, lab in vectors(60, 6, 4, 10)]
    assert check(spark, big)
    with pytest.raises(Exception, match="64 bits"):
        mining.op11(table(spark, [(i, [1e30, 1e30], i % 2) for i in range(100, 140)])).collect()


def test_bounds_skip_lists():
    """Tight, distant lists: a query for one of them does not reach the others."""
    import pandas as pd

    rng = np.random.default_rng(0)
    f = []
    for c in range(10):
        centre = np.zeros(10)
        centre[c] = 1000.0
        m = np.floor(centre + rng.normal(0, 3, (50, 10)))
        ids = np.arange(c * 50, c * 50 + 50)
        f.append({"cell": c, "part": 0, "ids": ids.tobytes(), "labels": np.zeros(50, np.int64).tobytes(), "matrix": m.tobytes(), "dims": 10, "centre": centre.tobytes(), "radius": float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))})
    lists = mining.Lists(pd.DataFrame(f), 10)
    x = np.array([lists.rows[4][0]])
    one = lambda v: np.array([v], np.int64)
    best, _, made = mining.visit(lists, x, one(0), one(-1), one(-(2**62)), one(2**62), 5, True)
    want = np.sort(np.concatenate([r @ x[0] for r in lists.rows]))[::-1][:5]
    assert best[0].tolist() == want.tolist() and made == 50
    best, _, made = mining.visit(lists, x, one(0), one(-1), one(0), one(200_000), 5, True)  # a window that list 4 lies outside of
    assert made <= 450
    assert best[0, 0] <= 200_000
