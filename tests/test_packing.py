import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import packing


def loop(tokens, budget):
    out, b, cur, n = [], 0, 0, 0
    for t in tokens:
        if n and cur + t > budget:
            b, cur, n = b + 1, 0, 0
        cur, n = cur + t, n + 1
        out.append(b)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.integers(1, 12))
def test_next_fit_equals_the_loop(tokens, budget):
    assert packing.next_fit_ids(np.array(tokens, np.int64), budget).tolist() == loop(tokens, budget)


def scan(tokens, budget):
    """First fit decreasing, an item at a time."""
    room, out = [], [0] * len(tokens)
    for i in sorted(range(len(tokens)), key=lambda i: -tokens[i]):
        b = next((b for b, r in enumerate(room) if r >= tokens[i]), len(room))
        if b == len(room):
            room.append(budget)
        room[b] -= tokens[i]
        out[i] = b
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=60), st.integers(1, 12))
def test_first_fit_runs_equal_the_scan(tokens, budget):
    lengths, counts = np.unique(np.array(tokens, np.int64), return_counts=True)
    bins = {t: [] for t in lengths.tolist()}
    for t, start, n, first, per in packing.first_fit_runs(lengths, counts, budget):
        assert start == len(bins[t])
        bins[t] += [first + i // per for i in range(n)]
    assert [bins[t].pop(0) for t in tokens] == scan(tokens, budget)


def test_many_items_are_few_entries():
    lengths = np.arange(1, 2001)
    entries = packing.first_fit_runs(lengths, np.full(2000, 10**9), 4000)
    assert sum(e[2] for e in entries) == 2000 * 10**9 and len(entries) < 20_000


def test_first_fit_decreasing_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, int(t), "x") for g, n in (("a", 300), (None, 80), ("c", 2)) for i, t in enumerate(rng.choice([0, 1, 2, 5, 7, 7, 7, 30], n))]
    df = spark.createDataFrame(rows, "g string, o int, t int, _g string").repartition(5).drop("_g")
    got = {(r["g"], r["o"]): r["bin_id"] for r in packing.first_fit_decreasing(df, "g", "o", "t", 12, part_rows=23).collect()}
    assert len(got) == len(rows)
    for g in ("a", None, "c"):
        items = [r[2] for r in rows if r[0] == g]
        assert [got[g, i] for i in range(len(items))] == scan(items, 12)
    assert packing.first_fit_decreasing(df.limit(0), "g", "o", "t", 12).count() == 0


def test_next_fit_over_many_ranges_equals_the_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, int(t)) for g, n in (("a", 400), (None, 90), ("c", 3)) for i, t in enumerate(rng.choice([0, 1, 2, 5, 9, 30], n))]
    df = spark.createDataFrame(rows, "g string, o int, t long").repartition(5)
    got = {(r["g"], r["o"]): r["bin_id"] for r in packing.next_fit(df, "g", "o", "t", 12, part_rows=17).collect()}
    for g in ("a", None, "c"):
        items = [t for h, _, t in rows if h == g]
        assert [got[g, i] for i in range(len(items))] == loop(items, 12)


def test_examples(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 4, 3, 9, 1])] + [(None, 0, 20), (None, 1, 1)], "g string, o int, t long")
    got = {(r["g"], r["o"]): r["bin_id"] for r in packing.next_fit(df, "g", "o", "t", 9).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, (None, 0): 0, (None, 1): 1}
    bins = packing.build_bins(df, "g", "o", "t", 9, strategy="other")
    assert bins.count() == 7
    fill = {r["g"]: (r["n_bins"], r["fill"]) for r in packing.fill_rate(packing.next_fit(df, "g", "o", "t", 9), "t", 9, "g").collect()}
    assert fill["a"] == (4, round(22 / 36 * 100, 4))
    assert packing.next_fit(df.limit(0), "g", "o", "t", 9).count() == 0
