import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.tokens import tokenizer_path
from tessera.session import shared_dir

PATH = tokenizer_path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype("<u4")
        data = token_files.pack(ids, width)
        assert len(data) == -(-n * width // 8)
        assert np.array_equal(token_files.unpack(data, n, width), ids)
    value = sum(int(x) << (width * i) for i, x in enumerate(ids))
    assert data == value.to_bytes(len(data), "little")


def test_width_is_the_least():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_ids_are_the_library_s(monkeypatch):
    codes = token_files.Encoder(PATH)
    odd = ["", "a", "  a  b", "x\n\n  y\t z", "it's we'll 'tis ''s", "<|endoftext|> hi <|endoftext|>", "ü🙂é", "a b", "\n", "   ", "x\n y \n\n", "1234 56", "日本 語", "q" * 500 + " " + "!" * 300]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \n\tab'sé1.é!  rellÑ") for _ in range(rng.randrange(80))) for _ in range(200)]
    monkeypatch.setattr(token_files, "MAX_WORDS", 20)  # generations change all the time
    for _ in range(2):
        for t in odd:
            assert codes.ids(t) == by_library(t).tobytes()


def brute(rows):
    """doc_id, start, n_tokens, ids_crc32 in ascending order, nulls first."""
    out, at = [], 0
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(by_library(t), 0).astype("<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op13_equals_plain_python(docs, rows):
    got = [tuple(r) for r in token_files.op13(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)


def test_empty_table_extra_columns_and_text_ids(spark, none):
    assert token_files.op13(none).collect() == []
    rows = [(f"d{i}", f"text number {i} " * i, i, "x") for i in range(30)] * 2  # every id twice
    got = token_files.op13(spark.createDataFrame(rows, "doc_id string, text string, h int, t string").repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == [tuple(r) for r in brute(rows)]


def test_files_random_access(spark, docs, rows, monkeypatch):
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(docs, path, PATH, end_id=7)
    whole = np.concatenate([np.append(by_library(t or ""), 7) for _, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))])
    n = token_files.manifest(path)["n_ids"]
    assert n == len(whole)
    for a, b in [(0, n), (5, 6), (n // 3, n // 3 + 3000), (n - 1, n + 50), (n, n + 5)]:
        assert np.array_equal(token_files.id_range(path, a, b), whole[a:b])
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    assert [x for r in got for x in r["ids"]] == whole.tolist()


def test_small_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    rng = np.random.default_rng(3)
    import pyarrow as pa

    ids = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 15, 16, 17, 200)]
    with open(tmp_path / "f.ids", "wb") as out:
        file = token_files.FileWriter(out, 16)
        for i, x in enumerate(ids):
            file.add(pa.array([i]), [x.tobytes()])
        assert file.close() == (sum(map(len, ids)), len(ids))
    reader, whole = token_files.FileReader(str(tmp_path / "f.ids")), np.concatenate(ids)
    assert reader.index().column("n_ids").to_pylist() == [len(x) for x in ids]
    for a in range(0, len(whole), 7):
        for b in range(a, len(whole) + 1, 31):
            assert np.array_equal(reader.ids(a, b), whole[a:b])
    (tmp_path / "cut.ids").write_bytes((tmp_path / "f.ids").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_files.FileReader(str(tmp_path / "cut.ids"))
