import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.tokens import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_everything_once(counts):
    entries = packing.make_plan(dict(counts), 64)
    used, ranks = defaultdict(list), defaultdict(list)
    for n, rank, count, first, offset in entries:
        for j in range(count):
            used[first + j].append((offset, n))
            ranks[n].append(rank + j)
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    plain = packing.Plan(dict(counts), 64)
    plain.best_fit()
    assert len(used) <= plain.sequences


def test_word_cache_equals_the_library():
    words = packing.word_ids(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    parts = ["'s", "t", "re", "S", " ", "\n", "é", "É", "1", "²", "ª", "µ", "ß", "<|endoftext|>", "…", "“", "th", "...", "×", "中", "é", " ", "İ"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert words.ids(s) == np.array(words.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_operator(docs, rows, none):
    words = packing.word_ids(tokenizer_path("word_bpe_49k.json"))
    got = packing.op6(docs).collect()
    want = Counter()
    for d, t, *_ in rows:
        data = words.ids(t or "") + b"\0" * 4
        for k in range(0, len(data), 8192):
            part = data[k : k + 8192]
            want[d, k // 8192, k // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.op6(none).count() == 0
