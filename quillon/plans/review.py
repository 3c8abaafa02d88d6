"""Whole reviews: one document against criteria, a pair of documents, a set of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import linking, rules, structure, summary


@dataclass
class Criterion:
    """A rule to review by. Without a mode the agent decides: reviewers' rules are run, all else is left to people."""

    no: str
    text: str
    check: str | None = None
    mode: str | None = None
    agent: str | None = None
    params: dict = field(default_factory=dict)


#: Rule checks by name: (sections, parameters) -> findings. Add to it to run more.
CHECKS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "placeholder": lambda parts, p: rules.placeholders(parts, p.get("markers", [])),
    "text_pattern": lambda parts, p: rules.text_pattern(parts, p.get("forbid"), p.get("find"), p.get("must")),
    "completeness": lambda parts, p: rules.completeness(parts, [tuple(x) for x in p["sections"]]) if p.get("sections") else rules.unreviewed(parts, "completeness", "no sections named"),
}


def mode_of(c: Criterion) -> str:
    """rule, model or human; an unknown check or mode is left to people."""
    if c.mode in ("rule", "model", "human"):
        return c.mode if c.mode != "rule" or c.check in CHECKS else "human"
    return "rule" if c.check in CHECKS else "model" if c.agent == "quality" else "human"


def review(docs: DataFrame, criteria: list[Criterion]) -> tuple[DataFrame, DataFrame]:
    """Findings of all rule criteria, numbered by criterion, and the status of every criterion. Sections are planned once for all checks."""
    parts = structure.sections(docs)
    run = [c for c in criteria if mode_of(c) == "rule"]
    found = [CHECKS[c.check](parts, c.params).withColumn("no", F.lit(c.no)) for c in run]
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "doc_id string, ord long, severity string, kind string, quote string, detail string, unreviewed boolean, no string")
    findings = reduce(DataFrame.unionByName, found) if found else empty
    known = spark.createDataFrame([(i, c.no, c.text, mode_of(c)) for i, c in enumerate(criteria)], "pos int, no string, text string, mode string")
    per = summary.item_status(F.broadcast(known).join(findings.select("no", F.monotonically_increasing_id().alias("finding_id"), "unreviewed"), "no", "left").select("no", "finding_id", "unreviewed"))
    status = known.join(per, "no", "left").select("pos", "no", "text", F.when(F.col("mode") == "rule", F.col("status")).when(F.col("mode") == "human", "manual").otherwise("noanswer").alias("status"), "n_findings")
    return findings, status


def compare(left: DataFrame, right: DataFrame, pattern: str, scope: str | None = None, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Matrix and findings of the ids in two documents' sections (doc_id, ord, title, text)."""
    from quillon.operators.extraction import id_anchors

    a, b = id_anchors(left, pattern).select("id", "ord"), id_anchors(right, pattern).select("id", "ord")
    return linking.traceability_matrix(a, b, scope, separator), linking.traceability(a.select("id"), b.select("id"))


def review_case(values: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Verdict of each field over a case's outputs (case_id, field, output_key, value, found)."""
    return linking.majority(values)
