import random

from tokenizers import Tokenizer

from tessera.llm import tokens, transducer

PATH = tokens.tokenizer_path("byte_bpe_50k.json")


def test_transducer_equals_the_library(monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", 7)
    m, tok = transducer.machine(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = ["'s", "'", "t", "re", "ve", "ll", "l", "v", "d", " ", "  ", "\n", "\t", "é", "1", "23", "!", "...", "the", " ", "　", "中", "🙂", "٣", "<|endoftext|>", "é", "²", "\x1c", "\x85", "straße"]
    for _ in range(2500):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 24)))
        assert m.count(s) == len(tok.encode(s, add_special_tokens=False).ids), s


def test_long_stretches_compose():
    m, tok = transducer.machine(PATH), Tokenizer.from_file(PATH)
    for s in ("ab" * 40000, "x" * 70000, " " * 66000 + "a", "中文" * 20000):
        assert m.count(s) == len(tok.encode(s, add_special_tokens=False).ids)


def test_state_maps_compose_in_any_order(monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", 50)
    monkeypatch.setattr(transducer, "LOOK", 4)  # so that some entries are not foreseen
    m, tok = transducer.machine(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    for _ in range(40):
        s = "".join(rng.choice(["ab", "the", "ing", "中", " ", "12", "é", "'s", "  ", "...", "x" * 30]) for _ in range(rng.randrange(40, 300)))
        parts = [s[i : i + 50] for i in range(0, len(s), 50)]
        begin = m.key(m.begin)
        maps = [transducer.ChunkMap(m, p, m.entries(s[max(0, 50 * i - 4) : 50 * i]) if i else [begin]) for i, p in enumerate(parts)]
        upto = transducer.prefix_scan(maps)
        left = maps[0]
        for i, b in enumerate(maps):
            left = transducer.Composed(left, b) if i else left
            node, n = m.run(m.begin, s[: 50 * (i + 1)])
            assert upto[i](begin) == left(begin) == (m.key(node), n)
        right = maps[-1]
        for a in reversed(maps[:-1]):
            right = transducer.Composed(a, right)
        assert right(begin)[1] == len(tok.encode(s, add_special_tokens=False).ids)


def test_dropped_states_are_freed():
    import gc

    m = transducer.Machine(PATH)
    gc.collect()
    gc.disable()
    try:
        m.count("some words that build a number of states in the machine")
        m.reset()
        assert sum(isinstance(o, transducer.Node) and o.machine is m for o in gc.get_objects()) == len(m.nodes)
    finally:
        gc.enable()


def test_states_are_dropped_and_built_again(monkeypatch):
    m = transducer.Machine(PATH)
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    tok = Tokenizer.from_file(PATH)
    for s in ("hello there general", "some other words", "quite a few more of them"):
        assert m.count(s) == len(tok.encode(s, add_special_tokens=False).ids)


def test_operator(docs, rows, none):
    tok = Tokenizer.from_file(PATH)
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op7(docs).collect())
    want = []
    for d, t, *_ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append(((d is None, d), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokens.op7(none).count() == 0
    other = docs.withColumn("t", docs["text"]).withColumn("k0", docs["lang"]).withColumn("n_tokens", docs["lang"])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens.op7(other).collect()) == sorted((str(None if d[0] else d[1]), n) for d, _, n, _ in want)
