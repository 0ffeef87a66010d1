"""Token counts by the compiled transducer (see transducer.py) over Arrow batches.

Null texts count as empty. Null ids and repeated rows give one row each, an empty table an empty result. The state of a
worker is bounded whatever the input: states and words are dropped at a limit, and freed at once.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.transducer import machine


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_bytes`` and ``n_tokens``; a null text counts as empty, one row per input row."""
    names = [f"k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # dropped states are undone by hand, so there is nothing to collect; looking for it would walk all states again and again
        gc.disable()
        try:
            count = machine(path).count
            for b in batches:
                texts = b.column(len(names)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(names))] + [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())],
                    names=[*names, "n_bytes", "n_tokens"],
                )
        finally:
            gc.enable()

    kinds = ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in names)
    out = src.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "n_bytes", "n_tokens")


def op7(df: DataFrame, limit: int = 1024) -> DataFrame:
    got = count_tokens(df, tokenizer_path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
