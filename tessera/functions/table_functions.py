"""Table functions for SQL: generated answers to rows.

Each takes any table with the answer in the column ``raw`` and gives its other columns, then those of what was found; which
they are is told by the table that is put in. Answers are parsed a row at a time in Python: where a column expression will
do, ``parse_candidates`` and ``parse_lines`` are faster.

    SELECT * FROM explode_candidates(TABLE(answers))
    SELECT * FROM explode_lines(TABLE(answers) PARTITION BY conv_id ORDER BY turn)
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Fixed value: characters stripped from both ends of a generated line.
EDGE = "0123456789.、-·* \t\"'“”‘’"
BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


def _extended(table: AnalyzeArgument, *more: tuple[str, object]) -> AnalyzeResult:
    """The columns of the table but ``raw``, and ``more``; a name may not occur twice."""
    if not table.isTable:
        raise ValueError("give a table: TABLE(...)")
    names = [f.name for f in table.dataType.fields]
    if "raw" not in names:
        raise ValueError("the table has no column raw")
    clash = {n for n, _ in more} & set(names)
    if clash:
        raise ValueError(f"the table has columns of the result already: {sorted(clash)}")
    return AnalyzeResult(StructType([f for f in table.dataType.fields if f.name != "raw"] + [StructField(n, t) for n, t in more]))


def candidates_of(raw: str | None) -> list[tuple[str, str, str]]:
    """(reason_id, reason_text, prior) of an answer's candidates; none of an answer that breaks a rule (see ``parse_candidates``)."""
    found = re.search(r"\{.*\}", raw or "", re.S)
    try:
        said = json.loads(found[0]) if found else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(said, dict):
        return []
    relevant, irrelevant = said.get("relevant"), said.get("irrelevant")
    if not isinstance(relevant, list) or not isinstance(irrelevant, list) or not 1 <= len(relevant) <= 3:
        return []
    every = [(e, "relevant") for e in relevant] + [(e, "irrelevant") for e in irrelevant]
    if any(not isinstance(e, dict) or e.get("id") is None for e, _ in every):
        return []
    evidence = lambda e: "" if e.get("evidence") is None else str(e["evidence"])
    return [(str(e["id"]), evidence(e) if prior == "relevant" else "", prior) for e, prior in every]


class ExplodeCandidates:
    """A row for each candidate of each answer."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _extended(table, ("reason_id", StringType()), ("reason_text", StringType()), ("prior", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        kept = tuple(row[n] for n in row.__fields__ if n != "raw")
        for candidate in candidates_of(row["raw"]):
            yield (*kept, *candidate)


class ExplodeLines:
    """A row for each line of each answer, numbered through the partition: its rows in their order are one text."""

    def __init__(self) -> None:
        self.n = 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _extended(table, ("line_no", IntegerType()), ("line", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        kept = tuple(row[n] for n in row.__fields__ if n != "raw")
        for line in BREAK.split(row["raw"] or ""):
            line = line.strip().strip(EDGE)
            if line:
                yield (*kept, self.n, line)
                self.n += 1


def register(spark: SparkSession) -> None:
    """Makes ``explode_candidates`` and ``explode_lines`` known to the session's SQL."""
    for name, kind in (("explode_candidates", ExplodeCandidates), ("explode_lines", ExplodeLines)):
        spark.udtf.register(name, udtf(kind))
