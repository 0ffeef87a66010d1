"""Resumable batch inference: pending work, a pluggable backend, results and failures with a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonx import extract_json, parse_candidates, parse_caption, parse_judgement
from tessera.functions.text import make_key

#: prompts, images -> raw answers, aligned with the input.
Backend = Callable[[list[str], list[str]], list[str]]


@dataclass(frozen=True)
class Task:
    """A registered task: how to build the prompt and how to read the answer."""

    name: str
    build: Callable[[DataFrame], Column]
    parse: Callable[[Column], Column]
    max_tokens: int
    temperature: float
    max_pixels: int
    version: str = "v1"


CAPTION_PROMPT = "Describe the image in detail."
CANDIDATE_PROMPT = "Name the rules that the image breaks and some that it does not, as JSON."
JUDGE_PROMPT = "Rule {reason_id} {reason_text}: does the image break it? Answer as JSON."


def _judge_build(df: DataFrame) -> Column:
    from tessera.functions.text import prompt

    text = F.coalesce(*[F.col(c) for c in ("reason_text", "text") if c in df.columns], F.lit(""))
    rid = F.col("reason_id") if "reason_id" in df.columns else F.lit("")
    return prompt(JUDGE_PROMPT, reason_id=rid, reason_text=text)


TASKS: dict[str, Task] = {
    "caption": Task("caption", lambda df: F.lit(CAPTION_PROMPT), parse_caption, 256, 0.3, 224 * 28 * 28),
    "candidate": Task("candidate", lambda df: F.lit(CANDIDATE_PROMPT), lambda raw: parse_candidates(extract_json(raw)), 512, 0.2, 448 * 28 * 28),
    "judge": Task("judge", _judge_build, lambda raw: parse_judgement(extract_json(raw)), 256, 0.1, 448 * 28 * 28),
}
BACKENDS: dict[str, Callable[..., Backend]] = {}


def register_backend(name: str):
    def add(make: Callable[..., Backend]):
        BACKENDS[name] = make
        return make

    return add


@register_backend("echo")
def echo_backend(**_: object) -> Backend:
    """A deterministic stand-in: the answer is the prompt and the image's name."""
    return lambda prompts, images: [f"{p} [{i}]" for p, i in zip(prompts, images)]


def keyed(records: DataFrame, task: Task) -> DataFrame:
    rid = F.col("reason_id") if "reason_id" in records.columns else None
    return records.withColumn("_key", make_key(F.col("image"), task.name, task.version, rid, F.lit(True) if rid is not None else None))


def pending(records: DataFrame, done: DataFrame | None, task: Task) -> DataFrame:
    """Records whose key has no result yet, one for each key."""
    todo = keyed(records, task).dropDuplicates(["_key"])
    return todo if done is None else todo.join(done.select("_key").distinct(), "_key", "left_anti")


def infer(todo: DataFrame, task: Task, backend: Backend, chunk: int = 64, retries: int = 3) -> DataFrame:
    """Adds ``raw``: answers in chunks; a chunk that fails ``retries`` times gives empty answers and the rest goes on."""
    rows = todo.withColumn("_prompt", task.build(todo))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw: list[str] = []
            for at in range(0, len(f), chunk):
                part = f.iloc[at : at + chunk]
                for left in range(retries, 0, -1):
                    try:
                        raw += backend(part["_prompt"].tolist(), part["image"].tolist())
                        break
                    except Exception:  # noqa: BLE001 - whatever a backend raises, its records are failures
                        if left == 1:
                            raw += [""] * len(part)
            yield f.assign(raw=raw)

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, raw string").drop("_prompt")


def split_results(answered: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """Results (record, parsed fields, _key, _task, _pv) and failures (record, raw_output of 500 characters, reason).

    The parser marks what is wrong in ``reason``; a record is one or the other, by one pass over the answers.
    """
    record = [c for c in answered.columns if c not in ("raw", "_key")]
    rows = answered.withColumn("_p", task.parse(F.col("raw")))
    ok = rows.filter(F.col("_p.reason").isNull())
    parsed = [f for f in rows.schema["_p"].dataType.fieldNames() if f != "reason"]
    results = ok.select(*record, *[F.col(f"_p.{f}").alias(f) for f in parsed], "_key", F.lit(task.name).alias("_task"), F.lit(task.version).alias("_pv"))
    failures = rows.filter(F.col("_p.reason").isNotNull()).select("_key", F.struct(*record).alias("record"), F.substring(F.coalesce("raw", F.lit("")), 1, 500).alias("raw_output"), F.col("_p.reason").alias("reason"))
    return results, failures


def retry_failures(failures: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The records of failures that have no result by now, one for each key however often it failed."""
    failures = failures.dropDuplicates(["_key"])
    left = failures if done is None else failures.join(done.select("_key").distinct(), "_key", "left_anti")
    return left.select("record.*")
