"""Counts, orders, merges and unions of findings, verdicts and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import squash, version_order


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "major", 0).when(F.col(c) == "minor", 1).otherwise(2)


def counts(findings: DataFrame, by: str = "severity") -> DataFrame:
    return findings.groupBy(by).agg(F.count("*").alias("n"))


def collected(findings: DataFrame, key: list[str]) -> DataFrame:
    """The first (by seq) of findings that agree in ``key``, with place: majors first, then in order."""
    first = findings.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("turn = 1").drop("turn")
    return first.withColumn("rank", severity_rank())


def merged(findings: DataFrame) -> DataFrame:
    """seq, survivor: findings of equal kind, section and quotes, white space and order aside, point to the first. Without kind or quotes none merges."""
    quotes = F.array_sort(F.transform("quotes", squash))
    key = F.when((F.coalesce("kind", F.lit("")) != "") & (F.size("quotes") > 0), F.concat_ws("\u001f", F.col("kind"), F.coalesce("section", F.lit("")), F.array_join(quotes, "\u001e")))
    rows = findings.withColumn("key", key)
    first = rows.where("key is not null").groupBy("key").agg(F.min("seq").alias("first"))
    return rows.join(first, "key", "left").select("seq", F.coalesce("first", "seq").alias("survivor"))


def verdict_key(findings: DataFrame) -> DataFrame:
    """seq, key of what a verdict is kept by: checker and sorted quotes, or checker, section and message."""
    quotes = F.array_sort(F.transform("quotes", squash))
    key = F.when(F.size("quotes") > 0, F.concat_ws("\u001f", F.lit("q"), "checker", F.array_join(quotes, "\u001f"))).otherwise(F.concat_ws("\u001f", F.lit("m"), F.col("checker"), F.coalesce("section", F.lit("")), "message"))
    return findings.select("seq", key.alias("key"))


def stamped(findings: DataFrame, source: str) -> DataFrame:
    return findings.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.lit(source)))


def folded_verdicts(answers: DataFrame) -> DataFrame:
    """criterion, verdict: violation over pass over n/a over undetermined. A partial view can't pass."""
    rank = F.when(F.col("verdict") == "violation", 3).when((F.col("verdict") == "pass") & ~F.col("partial"), 2).when(F.col("verdict") == "n/a", 1).otherwise(0)
    best = answers.groupBy("criterion").agg(F.max(rank).alias("r"))
    return best.select("criterion", F.element_at(F.array(*[F.lit(x) for x in ("undetermined", "n/a", "pass", "violation")]), F.col("r") + 1).alias("verdict"))


def case_id(requests: DataFrame) -> DataFrame:
    """case_key, request: the most frequent request number of each case, the first seen of equals. Needs case_key, request, pos."""
    each = requests.where("request is not null").groupBy("case_key", "request").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return each.groupBy("case_key").agg(F.max_by("request", F.struct("n", -F.col("first"))).alias("request"))


def item_status(rows: DataFrame) -> DataFrame:
    """no, status, n_findings: flagged with any real finding, unreviewed with only unreviewed ones, clean with none. Needs no, finding_id, unreviewed."""
    real = F.count_if(F.col("finding_id").isNotNull() & ~F.coalesce("unreviewed", F.lit(False)))
    out = rows.groupBy("no").agg(real.alias("real"), F.count("finding_id").alias("n_findings"))
    return out.select("no", F.when(F.col("real") > 0, "flagged").when(F.col("n_findings") > 0, "unreviewed").otherwise("clean").alias("status"), "n_findings")


def status_summary(items: DataFrame, statuses: list[str], by: str | None = None) -> DataFrame:
    """One row, or one for each ``by``: how many items have each status, and the total."""
    sums = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    return (items.groupBy(by) if by else items).agg(*sums, F.count("*").alias("total"))


def size_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"))


def resolved_criteria(layers: DataFrame) -> DataFrame:
    """Layers (layer_no, layer, no, text, pos) as one list: of equal texts the first layer's stays; a number that an earlier layer has gets its layer as suffix."""
    order = ["layer_no", "pos"]
    rows = layers.withColumn("trimmed", F.trim("text")).where("trimmed <> ''")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("trimmed").orderBy(*order))).where("turn = 1")
    rows = rows.withColumn("same", F.row_number().over(Window.partitionBy("no").orderBy(*order)))
    return rows.select("layer_no", "pos", "layer", F.when(F.col("same") > 1, F.concat_ws("-", "no", "layer")).otherwise(F.col("no")).alias("no"), F.col("trimmed").alias("text"))


def applied_params(criteria: DataFrame, allowed: list[str]) -> DataFrame:
    """key, value: the first non-empty value of each allowed parameter. Needs pos, params (map)."""
    each = criteria.select("pos", F.explode("params").alias("key", "value")).where(F.col("key").isin(allowed) & (F.trim("value") != ""))
    return each.groupBy("key").agg(F.min_by("value", "pos").alias("value"))


def capped(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("turn") <= most)


def progress(events: DataFrame) -> DataFrame:
    """run_id, lane, i, total: the last state of each lane. Needs run_id, seq, lane, i, total. Works on streams in update mode too."""
    return events.groupBy("run_id", "lane").agg(F.max_by("i", "seq").alias("i"), F.max_by("total", "seq").alias("total"))


def checklist_export(items: DataFrame, results: DataFrame) -> DataFrame:
    """All items by position, those without a result labelled; joined by position, not by number. Needs pos, no, text, and pos, status."""
    return items.join(results, "pos", "left").select("pos", "no", "text", F.coalesce("status", F.lit("not judged")).alias("status"))


def newest(entries: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest entries by id."""
    return entries.orderBy(F.desc("entry_id")).limit(most)


def report_json(findings: DataFrame) -> DataFrame:
    """doc_id, report: severity counts and findings, majors first, as JSON."""
    item = F.struct(severity_rank().alias("rank"), "seq", "severity", "message")
    own = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"), F.count_if(F.col("severity") == "info").alias("info"))
    return own.select("doc_id", F.to_json(F.struct(F.struct("major", "minor", "info").alias("counts"), F.transform("items", lambda s: F.struct(s["severity"].alias("severity"), s["message"].alias("message"))).alias("findings"))).alias("report"))


#: How a matrix's states are written.
STATUS_LABELS = {"linked": "✅ 연결됨", "missing": "❌ 누락", "orphan": "⚠️ 근거없음", "out_of_scope": "➖ 범위 밖", "rolled_up": "🔗 부모 수준 검증"}


def report_markdown(findings: DataFrame) -> DataFrame:
    """doc_id, report: a heading, the number of findings by severity, and a line for each finding, majors first."""
    line = F.struct(severity_rank().alias("rank"), "seq", F.concat(F.lit("- **["), "severity", F.lit("]** "), "message").alias("line"))
    own = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("major", "minor", "info")])
    head = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s)) for s in ("major", "minor", "info")]), F.lit("\n\n"))
    return own.select("doc_id", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))


def matrix_reports(rtm: DataFrame) -> DataFrame:
    """run_id, markdown, json of each traceability matrix (run_id, ord, upper_id, lower_ids, status): every row, whatever its state, and the counts.

    A null upper_id, as orphans have, is a dash; no lower ids are written as such.
    """
    states = list(STATUS_LABELS)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "upper_id", "lower_ids", "status"))), lambda r: F.struct(r["upper_id"].alias("upper_id"), r["lower_ids"].alias("lower_ids"), r["status"].alias("status")))
    own = rtm.groupBy("run_id").agg(rows.alias("rtm"), F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    label = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), s)
    line = lambda r: F.concat(F.lit("| "), F.coalesce(r["upper_id"], F.lit("—")), F.lit(" | "), F.when(F.size(r["lower_ids"]) > 0, F.array_join(r["lower_ids"], ", ")).otherwise("(없음)"), F.lit(" | "), label(r["status"]), F.lit(" |"))
    counts = F.concat_ws(", ", F.concat(F.lit("total "), "total"), *[F.concat(F.lit(f"{s} "), F.col(s)) for s in states])
    text = F.concat(counts, F.lit("\n\n| 상위 ID | 하위 연결 | 상태 |\n|---|---|---|\n"), F.array_join(F.transform("rtm", line), "\n"), F.lit("\n"))
    return own.select("run_id", text.alias("markdown"), F.to_json(F.struct(F.struct("total", *states).alias("summary"), "rtm"), {"ignoreNullFields": "false"}).alias("json"))


def shown(findings: DataFrame, severities: list[str], unreviewed: bool = True, category: Column | None = None, by: str = "severity") -> DataFrame:
    """Findings of the severities and, where ``category`` is true, of one kind of checker; unreviewed ones by their own switch, whatever their severity.

    Sorted by severity, or by section, numbers in it as numbers and those without a section first.
    """
    on = F.when(F.col("unreviewed"), F.lit(unreviewed)).otherwise(F.col("severity").isin(severities))
    order = [severity_rank()] if by == "severity" else [F.coalesce("section", F.lit("")) != "", version_order(F.col("section")), F.col("section")]
    return findings.where(on & (category if category is not None else F.lit(True))).orderBy(*order)


def criteria_of(items: DataFrame) -> DataFrame:
    """finding_id, labels, layers: the criteria that name a finding, in their order. Needs pos, no, text, layer, findings (an array); null or no findings name none."""
    rows = items.select("pos", F.coalesce(F.nullif("text", F.lit("")), "no", F.lit("")).alias("label"), F.coalesce("layer", F.lit("")).alias("layer"), F.explode("findings").alias("finding_id"))
    both = rows.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "layer"))).alias("both"))
    return both.select("finding_id", F.col("both.label").alias("labels"), F.col("both.layer").alias("layers"))


def document_sides(x: Column) -> Column:
    """Names of the documents that a label holds, parted by an arrow or a middle dot; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), " (?:↔|·) "), lambda s: F.trim(s)), lambda s: s != "")


def stages(sizes: DataFrame) -> DataFrame:
    """doc_id, pos, key, detail: the five steps of a review and what each dealt with. Needs doc_id, chars, sections, chunks, findings."""
    counted = lambda c, unit: F.concat(F.col(c).cast("string"), F.lit(f" {unit}"))
    details = [("ingestion", F.concat(F.format_number("chars", 0), F.lit(" chars"))), ("normalize", counted("sections", "sections")), ("chunking", counted("chunks", "chunks")), ("review", F.lit("completeness · consistency")), ("report", counted("findings", "findings"))]
    steps = F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), d.alias("detail")) for k, d in details])).alias("pos", "step")
    return sizes.select("doc_id", steps).select("doc_id", "pos", "step.key", "step.detail")


def case_stats(facts: DataFrame) -> DataFrame:
    """Counts of a case's facts (case_id, kind, unreviewed): outputs, missing, findings, unreviewed, unclassified, ignored, checks judged, checks, manual."""
    kind, blind = F.col("kind"), F.coalesce("unreviewed", F.lit(False))
    counted = {"outputs": kind == "output", "missing": kind == "missing", "findings": (kind == "finding") & ~blind, "unreviewed": (kind == "finding") & blind, "unclassified": kind == "unclassified", "ignored": kind == "ignored", "wide_checked": (kind == "wide") & ~blind, "wide_total": kind == "wide", "manual": kind == "manual"}
    return facts.groupBy("case_id").agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
