"""Strict JSON from generated text, and the parsers of the three tasks.

Spark's own parsers accept text after a first value; a generated answer must be one value and nothing else. The check is
one vectorised UDF that returns canonical JSON or null; all else is column expressions on its result.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LABELS = ("相关", "不相关")


@F.pandas_udf(StringType())
def strict_json(raw: pd.Series) -> pd.Series:
    """Canonical JSON of each string that is exactly one JSON object, else null."""

    def one(s):
        try:
            value = json.loads(s) if s else None
        except (ValueError, RecursionError):
            return None
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return raw.map(one, na_action="ignore")


def extract_json(raw: Column) -> Column:
    """The stretch from the first { to the last } of ``raw`` if it is one JSON object, else null."""
    return strict_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def parse_caption(raw: Column) -> Column:
    """struct(reason, caption): reason is null where the caption is long enough."""
    from tessera.functions.text import squeeze

    c = squeeze(raw)
    ok = F.coalesce(F.length(c) >= 20, F.lit(False))
    return F.struct(F.when(~ok, F.lit("too short")).alias("reason"), F.when(ok, c).alias("caption"))


def parse_candidates(obj: Column) -> Column:
    """struct(reason, candidates) from ``extract_json``'s result; 1 to 3 relevant entries are wanted, each with an id."""
    entry = "array<struct<id:string,evidence:string>>"
    parsed = F.from_json(obj, f"relevant {entry}, irrelevant {entry}")
    rel, irr = parsed["relevant"], parsed["irrelevant"]
    reason = (
        F.when(obj.isNull(), "no json")
        .when(rel.isNull() | irr.isNull(), "fields missing")
        .when(~F.size(rel).between(1, 3), "relevant count")
        .when(F.exists(F.concat(rel, irr), lambda e: e["id"].isNull()), "id missing")
    )
    pair = lambda e, text, prior: F.struct(e["id"].alias("reason_id"), text.alias("reason_text"), F.lit(prior).alias("prior"))
    pairs = F.concat(F.transform(rel, lambda e: pair(e, F.coalesce(e["evidence"], F.lit("")), "relevant")), F.transform(irr, lambda e: pair(e, F.lit(""), "irrelevant")))
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), pairs).alias("candidates"))


def parse_judgement(obj: Column) -> Column:
    """struct(reason, label, teacher_score, confidence, analysis); confidence may be a number or a numeric string.

    The JSON is read once a row: what follows is a function of the parsed value.
    """
    found = F.struct(obj.isNull().alias("none"), F.from_json(obj, "label string, analysis string, confidence string").alias("p"))

    def judge(v: Column) -> Column:
        parsed = v["p"]
        conf = _number(F.coalesce(parsed["confidence"], F.lit("0.5")))
        reason = (
            F.when(v["none"], "no json")
            .when(~F.coalesce(parsed["label"].isin(*LABELS), F.lit(False)), "label")
            .when(F.coalesce(F.length(parsed["analysis"]), F.lit(0)) < 10, "analysis")
            .when(conf.isNull(), "confidence")
        )
        ok = reason.isNull()
        score = F.when(parsed["label"] == LABELS[0], conf).otherwise(1 - conf)
        return F.struct(
            reason.alias("reason"),
            F.when(ok, parsed["label"]).alias("label"),
            F.when(ok, F.round(score, 4)).alias("teacher_score"),
            F.when(ok, F.round(conf, 4)).alias("confidence"),
            F.when(ok, parsed["analysis"]).alias("analysis"),
        )

    return F.get(F.transform(F.array(found), judge), F.lit(0))
