import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=10, top=10):
    """lang, source, part, item, value, rank by counting everything in Python's integers."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    seen = defaultdict(Counter)
    for lang, _, words in docs:
        seen[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in seen.items()}
    count = defaultdict(Counter)
    for lang, source, words in docs:
        ours = set(kept[lang])
        count[lang, source].update(w for w in words if w in ours)
        count[lang].update(w for w in words if w in ours)

    def share(key, lang):
        total = sum(count[key].values())
        return {t: 1 + 10**9 * (count[key][t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in kept:
        q = share(lang, lang)
        groups = {s: share((lang, s), lang) for s in sorted({s for la, s, _ in docs if la == lang}, key=str.encode)}
        for s, p in groups.items():
            pairs = [(sum(f(p[t], other[t]) for t in p), o) for o, other in groups.items() if o != s]
            terms = [(f(p[t], q[t]), t) for t in p if count[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(docs):
    return [(r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.mark.parametrize("block", [4_000_000, 200])
def test_audit_equals_plain_counting(docs, block, monkeypatch):
    monkeypatch.setattr(divergence.occurrences, "__defaults__", (block,))
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 40)  # many buckets of terms
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=3, top=4).collect())
    assert got == brute(rows_of(docs), 3, 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_delimiters_case_and_letters_beyond_ascii(spark):
    texts = ["Ab,ab\tAB_x", "Über über ÜBER", "a1b2a", "\x00a\x7fb", "日本 語 🙂a", "", None, "ſK K", "a " * 50]
    rows = [(t, lang, s) for t in texts for lang in ("x", None) for s in ("s", "", None)] + [("a b", "y", "only")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n long, term string")
    assert sorted(tuple(r) for r in divergence.audit(df, min_docs=1).collect()) == brute(rows, 1)


def test_groups_without_terms_and_empty_table(spark, none):
    assert divergence.op12(none).collect() == []
    rows = [("word", "en", "a"), ("", "en", "b"), (None, "en", "c"), ("word", "fr", "a")]
    got = divergence.op12(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows) and len(got) == 6 and {r["value"] for r in got} == {0}


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    c, n, v = 10**13, 10**15, 10**7
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (c + 2) // (n + 2 * v)
