"""The sitting: findings become evidence, a model proposes, the gate decides, what is accepted is laid out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import dispose
from ..operators.miners import evidence_of

PROPOSALS = "seq int, kind string, name string, description string, standard string, moves array<string>, citations array<string>, quote string"
QUOTES = 3

#: From lines of evidence and of what is installed to a model's free text, or None.
Ask = Callable[[list[str], list[str]], str | None]


def evidence_lines(evidence: DataFrame) -> list[str]:
    """One line for each finding: all that a proposal may cite. The detectors keep a few dozen at most."""
    said = F.array_join(F.transform(F.slice("quotes", 1, QUOTES), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), " · ")
    line = F.concat(F.col("id"), F.lit(" ["), F.col("kind"), F.lit("] "), F.col("claim"), F.when(F.size("quotes") > 0, F.concat(F.lit(" — their words: "), said)).otherwise(""))
    return [row[0] for row in evidence.select("id", line.alias("line")).orderBy("id").select("line").collect()]


def parse(answer: str | None) -> list[tuple]:
    """The proposals in a model's answer, none if it has no such JSON."""
    found = re.search(r"\{.*\}", answer or "", re.DOTALL)
    try:
        given = json.loads(found[0]).get("proposals") if found else None
    except ValueError:
        return []
    rows = []
    for seq, p in enumerate(p for p in (given if isinstance(given, list) else []) if isinstance(p, dict)):
        texts = [str(p.get(c) or "") for c in ("kind", "name", "description", "standard")]
        lists = [[str(x) for x in p.get(c) or []] if isinstance(p.get(c), list) else [] for c in ("moves", "citations")]
        rows.append((seq, *texts, *lists, str(p.get("quote") or "")))
    return rows


def artifacts(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(seq, name, path, content) of accepted proposals: a model's prose, receipts that were counted."""
    cited = proposals.select("seq", F.posexplode("citations").alias("place", "id")).join(evidence.select("id", "receipt"), "id")
    lines = cited.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "receipt"))), lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["receipt"])), "\n").alias("receipts"))
    own = proposals.join(lines, "seq", "left")
    moves = F.array_join(F.transform("moves", lambda m: F.concat(F.lit("- "), m)), "\n")
    quote = F.when(F.col("quote") != "", F.concat(F.lit('\nIn their own words: "'), F.col("quote"), F.lit('"\n'))).otherwise("")
    content = F.concat(
        F.lit("---\nname: "), "name", F.lit("\ndescription: "), "description", F.lit("\n---\n\n# "), "name", F.lit("\n\n"), "standard",
        F.lit("\n\n## The moves\n\n"), moves, F.lit("\n"), quote, F.lit("\n## Receipts\n\n"), F.coalesce("receipts", F.lit("")), F.lit("\n"),
    )
    return own.select("seq", "name", F.concat("name", F.lit("/SKILL.md")).alias("path"), content.alias("content"))


def sit(findings: DataFrame, installed: DataFrame, ask: Ask) -> tuple[list[dict], DataFrame]:
    """(every proposal with ok and reasons, the artifacts of those accepted). installed: name, description, minted."""
    spark = findings.sparkSession
    evidence = evidence_of(findings)
    notes = installed.where("not minted").select(F.concat_ws(" — ", "name", F.nullif("description", F.lit(""))).alias("line")).orderBy("line").collect()
    proposals = spark.createDataFrame(parse(ask(evidence_lines(evidence), [row[0] for row in notes])), PROPOSALS)
    decided = dispose(proposals, evidence, installed)
    accepted = proposals.where(F.col("seq").isin([d["seq"] for d in decided if d["ok"]]))
    return decided, artifacts(accepted, evidence)


def strongest(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(seq, receipt): of what each proposal cites, the receipt with the largest number, the first of equals. citations: seq, place, id."""
    own = citations.join(evidence.select("id", "receipt", "largest"), "id")
    return own.groupBy("seq").agg(F.max_by("receipt", F.struct("largest", -F.col("place"))).alias("receipt"))
