from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import lit

from tessera.llm import common, near_dup


def brute(rows):
    """Classes by all pairs: shingles with multiplicity that keep their order."""
    n = len(rows)
    words = [(t or "").split() for _, t, *_ in rows]
    sh = []
    for w in words:
        k = min(5, len(w))
        sh.append([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else [])
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def lcs(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
            prev = row
        return prev[-1]

    for i in range(n):
        for j in range(i):
            a, b = sh[i], sh[j]
            if not a or not b:
                continue
            both = sum((Counter(a) & Counter(b)).values())
            if both / (len(a) + len(b) - both) < 0.8:
                continue
            m = len(a) if a == b else lcs(a, b)
            if m / (len(a) + len(b) - m) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_against_all_pairs(docs, rows, none):
    got = defaultdict(list)
    for i, r in enumerate(near_dup.op9(docs).collect()):
        got[r["class_id"] if r["class_id"] is not None else f"none{i}"].append(r["doc_id"])
    # equal rows without words are classes of their own although their ids are equal
    assert sorted(sorted(map(str, g)) for g in got.values()) == brute(rows)
    assert near_dup.op9(none).count() == 0


def test_chain_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):  # neighbours are similar, the ends are not
        w = list(base)
        for j in range(k):
            w[j * 15] = f"x{j}"
        rows.append((k, " ".join(w)))
    got = near_dup.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_alignment_respects_order():
    a = near_dup.shingles(" ".join(f"a{i}" for i in range(100)))
    assert near_dup.alignment_similarity(a, a) == 1.0
    assert near_dup.alignment_similarity(a, np.concatenate([a[50:], a[:50]])) == 0.0
    assert near_dup.alignment_similarity(a, a[:75]) == 0.0 and near_dup.alignment_similarity(a, a[:80]) > 0.8


@pytest.mark.parametrize("hot", [100_000, 10])
def test_components_of_long_paths_and_hubs(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z000", f"z{i:03d}") for i in range(1, 50)]
    got = dict(near_dup.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61)) and all(got[f"z{i:03d}"] == "z000" for i in range(50))


def _family(seed, parent_of, copies, n=200):
    """Texts whose words are all different but for edits, so similarity is that of the sets of shingles."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{i}" for i in range(n)]]
    for k in range(1, copies + 1):
        w = list(texts[parent_of(rng, k)])
        for at in rng.choice(n // 6, rng.integers(3, 5), replace=False):  # each edit changes five shingles of about 196
            w[at * 6] = f"x{k}.{at}"
        texts.append(w)
    return [" ".join(w) for w in texts]


def _classes_by_sets(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    names = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[g] for g in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    like = both / (size[:, None] + size[None, :] - both) >= 0.8 - 1e-6
    root = np.arange(len(texts))
    while True:
        new = np.where(like, root[None, :], len(texts)).min(axis=1)
        if (new == root).all():
            return root.tolist(), like
        root = new


def test_hub_of_copies_that_are_unlike_each_other(spark):
    texts = _family(1, lambda rng, k: 0, 1000)
    want, like = _classes_by_sets(texts)
    assert like[0].all() and np.triu(like[1:, 1:], 1).mean() < 0.2 and set(want) == {0}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_copies_of_copies(spark):
    texts = _family(2, lambda rng, k: int(rng.integers(max(0, k - 30), k)), 300)
    want, _ = _classes_by_sets(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_all_pairs_of_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    texts = _family(3, lambda rng, k: 0, 40)
    s = near_dup.durable(near_dup.sketch_table(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "node string, text string")))
    comp = near_dup.F.when(near_dup.F.col("node").isin("0", "1"), 0).otherwise(near_dup.F.col("node").cast("long"))
    rows = near_dup._mixed(s.select("code", comp.alias("comp"), near_dup.F.posexplode("keys").alias("at", "key")))
    got = list(map(tuple, near_dup.all_pairs(rows, s, 0.8).collect()))
    assert len(got) == len(set(got))
    _, like = _classes_by_sets(texts)
    code = {int(r["node"]): r["code"] for r in s.collect()}
    pair = lambda i, j: (min(code[i], code[j]), max(code[i], code[j]))
    want = {pair(i, j) for i in range(41) for j in range(i) if like[i, j] and (i, j) != (1, 0)}
    assert want <= set(got) and pair(0, 1) not in got and len(want) > 40


def test_bins_never_drop_a_pair():
    words = [f"w{i}" for i in range(400)]
    one = near_dup.shingles(" ".join(words))
    for edits in (0, 3, 8, 20, 60):
        w = list(words)
        for k in range(edits):
            w[k * 6] = f"x{k}"
        other = near_dup.shingles(" ".join(w))
        rows = [np.frombuffer(near_dup.bins(h), np.uint8)[None, :] for h in (one, other)]
        may = near_dup.may_match(*rows, np.array([len(one)]), np.array([len(other)]), 0.8)[0]
        assert may or near_dup.alignment_similarity(one, other) == 0.0
        assert may == (edits < 20)
    same = np.zeros(900, np.uint64)
    full = np.frombuffer(near_dup.bins(same), np.uint8)[None, :]
    assert near_dup.may_match(full, full, np.array([900]), np.array([900]), 0.8)[0]


def _links(texts):
    """All pairs of different texts that align with 0.8 or more: exact candidates by prefixes of rare shingles, each aligned."""
    sh = {t: near_dup.shingles(t) for t in texts if t and t.split()}
    freq = Counter(x for a in sh.values() for x in a.tolist())
    index, pairs = defaultdict(list), set()
    for t, a in sorted(sh.items(), key=lambda x: len(x[1])):
        order = sorted(a.tolist(), key=lambda x: (freq[x], x))
        for x in order[: len(order) - int(np.ceil(0.8 * len(order) - 1e-9)) + 1]:
            pairs |= {(u, t) for u in index[x]}
            index[x].append(t)
    return [(u, t) for u, t in pairs if near_dup.alignment_similarity(sh[u], sh[t]) >= 0.8 - 1e-9]


def test_no_link_of_the_test_tables_is_lost(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ids = defaultdict(list)
    for r in rows.collect():
        ids[r["text"]].append(r["doc_id"])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op9(rows).collect()}
    links = _links(ids)
    assert links and all(got[ids[u][0]] == got[ids[t][0]] for u, t in links)
    assert all(len({got[i] for i in same}) == 1 for t, same in ids.items() if t and t.split())


def test_other_columns_and_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("a", text, 1), ("b", text + " x", 2), ("c", "other", 3)], "doc_id string, text string, node int").withColumns({c: lit(0) for c in ("code", "key", "root", "low")})
    assert {r["doc_id"]: r["class_id"] for r in near_dup.op9(df).collect()} == {"a": "a", "b": "a", "c": "c"}
