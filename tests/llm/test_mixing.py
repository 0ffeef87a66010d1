from collections import defaultdict

from tessera.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        got = {s: rest * weight[s] / w for s in open_}
        over = [s for s in open_ if got[s] > 3 * sizes[s]]
        if not over:
            return full | got
        full |= {s: 3 * sizes[s] for s in over}


def test_targets_and_taken(docs, rows, none):
    got = mixing.op8(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    source = {d: s for d, _, _, s, _ in rows}
    for d, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-3 and r["source_size"] == size[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(mixing.op8(docs.repartition(5)).collect())
    assert mixing.op8(none).count() == 0


def test_schedule(docs):
    plan = mixing.plan(docs)
    copies = mixing.schedule(plan).collect()
    assert all(-1e-9 <= r["time"] <= 1 + 1e-9 for r in copies)
    by = defaultdict(int)
    for r in copies:
        by[r["doc_id"]] += r["copy_words"]
    for r in plan.collect():
        if r["doc_id"] != 307:
            assert by[r["doc_id"]] == sum(c["copy_words"] for c in r["copies"])
    # a source's demand integrates to its position at each copy's time
    for r in copies[:50]:
        t, a = r["time"], r["slope"]
        assert abs(r["target"] * (t + a * (t * t - t)) - (r["start"] + r["copy"] * r["source_size"])) < 1e-3


def test_training_order(docs, none):
    from tessera.llm.registry import QUERIES

    assert "op8_training_order" in QUERIES
    got = mixing.training_order(docs).collect()
    at = 0
    for r, before in zip(got, [None, *got]):  # every copy begins where the one before it ends, in the order of time
        assert r["position"] == at and r["copy_words"] > 0
        assert before is None or r["time"] >= before["time"]
        at += r["copy_words"]
    words, taken = defaultdict(int), defaultdict(int)
    for r in got:
        words[r["doc_id"]] += r["copy_words"]
    for r in mixing.op8(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    assert dict(words) == {d: n for d, n in taken.items() if n}
    # the document's row has the place of its first copy, and the rows come in that order
    first = {}
    for r in got:
        if r["copy"] == 0 and r["doc_id"] != 307:
            first[r["doc_id"]] = (r["time"], r["position"])
    rows = mixing.op8(docs).collect()
    for r in rows:
        if r["doc_id"] != 307:
            assert (r["first_time"], r["first_position"]) == first.get(r["doc_id"], (None, None))
    at = [r["first_position"] for r in rows]
    seen = [p for p in at if p is not None]
    assert at == sorted(seen) + [None] * (len(at) - len(seen))
    # sources with a falling weight are read early, those with a rising one late
    slope = {r["source"]: r["slope"] for r in mixing.plan(docs).select("source", "slope").distinct().collect()}
    for s in {r["source"] for r in got}:
        of = [(r["time"], r["copy_words"]) for r in got if r["source"] == s]
        early = sum(n for t, n in of if t < 0.5) / sum(n for _, n in of)
        assert len(of) < 20 or (early > 0.5) == (slope[s] < 0) or abs(early - 0.5) < 0.1
    assert mixing.training_order(none).count() == 0
