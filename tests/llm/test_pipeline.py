import re
from collections import Counter, defaultdict

import corpus_pipeline
from tessera.llm import mixing, near_dup, quality
from tessera.session import durable

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    out = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def redacted(text):
    out, at = "", 0
    for a, z in spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def linked(texts):
    """Classes of texts by all pairs."""
    sh = {t: near_dup.shingles(t) for t in texts if t and t.split()}
    parent = {t: t for t in sh}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    names = list(sh)
    for i, a in enumerate(names):
        for b in names[:i]:
            if near_dup.alignment_similarity(sh[a], sh[b]) >= 0.8 - 1e-9:
                parent[find(a)] = find(b)
    return {t: find(t) for t in sh}


def rows_of(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_stages_by_brute_force(spark, docs, rows, tmp_path):
    """Each stage on what the one before it kept, against plain Python."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(305, 0, 0), (306, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = durable(stage(spark, now, str(tmp_path)))
        assert now.columns == list(corpus_pipeline.COLUMNS)
        kept.append(rows_of(now))
    good, unique, clean, mixed = kept
    model = quality.fit(quality.describe(docs), labels)
    score = {r["text"]: r["score"] for r in quality.score(docs, model).collect()}
    assert good == sorted((r for r in rows if score[r[1]] >= quality.CUT), key=str)
    root = linked({r[1] for r in good})
    low = defaultdict(list)
    for r in good:
        if r[1] in root and r[0] is not None:
            low[root[r[1]]].append(r[0])
    stay = [r for r in dict.fromkeys(good) if r[0] is None or r[1] not in root or r[0] == min(low[root[r[1]]])]
    assert unique == sorted(stay, key=str) and not set(range(201, 208)) & {r[0] for r in unique}
    want = [(d, t if t is None or not spans(t) else redacted(t), lang, s, n if t is None or not spans(t) else len(redacted(t))) for d, t, lang, s, n in unique]
    assert Counter((r[0], r[1] or "", r[2], r[3]) for r in clean) == Counter((r[0], r[1] or "", r[2], r[3]) for r in want)
    taken = Counter()
    for r in mixing.op8(spark.createDataFrame(clean, docs.schema)).collect():
        if r["taken"]:
            taken[r["doc_id"]] += -(-r["taken"] // r["size"])
    assert Counter(r[0] for r in mixed) == taken
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_an_empty_table_and_other_columns(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    other = docs.limit(20).selectExpr("*", "1 as score", "'x' as spans", "2 as size", "3 as node", "4 as time")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, other, str(tmp_path)).count() >= 1
