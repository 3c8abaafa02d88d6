"""Rule checks: each takes text or values and gives findings, and a row with unreviewed = true where it can't judge.

Findings are (doc_id, ord, severity, kind, quote, detail, unreviewed). "Not checked" is never "clean": what can't be
measured comes back as an info row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import broken, date_key, full, java_pattern, marker_pattern, squash, strip

COLUMNS = ["doc_id", "ord", "severity", "kind", "quote", "detail", "unreviewed"]


def finding(severity: str, kind: str, quote: Column, detail: Column | None = None, ord_: Column | None = None, unreviewed: bool = False) -> list[Column]:
    return [F.col("doc_id"), (ord_ if ord_ is not None else F.lit(None)).cast("long").alias("ord"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), quote.cast("string").alias("quote"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"), F.lit(unreviewed).alias("unreviewed")]


def unreviewed(docs: DataFrame, kind: str, why: str) -> DataFrame:
    return docs.select("doc_id").distinct().select(*finding("info", kind, F.lit(None), F.lit(why), unreviewed=True))


def placeholders(parts: DataFrame, markers: list[str]) -> DataFrame:
    """Lines that hold a marker, equal lines of a section as one with their number. Without markers nothing is said."""
    split = parts.select("doc_id", "ord", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", strip(F.col("line")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("line").rlike(marker_pattern(m))
    return split.where(hit).groupBy("doc_id", "ord", "line").agg(F.count("*").alias("times")).select(*finding("major", "placeholder", F.col("line"), F.col("times"), F.col("ord")))


def text_pattern(parts: DataFrame, forbid: str | None = None, find: str | None = None, must: str | None = None, most: int = 30) -> DataFrame:
    """Every match of ``forbid``, or every match of ``find`` that ``must`` doesn't match in full; ``most`` a document, in order, then one unreviewed row.

    Without ``forbid``, and without both others, or with a pattern that can't be read, each document is unreviewed.
    """
    if not (forbid or find and must):
        return unreviewed(parts, "text_pattern", "no pattern")
    if broken(forbid, find, must):
        return unreviewed(parts, "text_pattern", "broken pattern")
    pattern = java_pattern(forbid or find)
    hits = parts.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "quote"))
    if not forbid:
        hits = hits.where(~F.col("quote").rlike(full(java_pattern(must))))
    hits = hits.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "at")))
    shown = hits.where(F.col("turn") <= most).select(*finding("minor", "text_pattern", F.col("quote"), F.col("turn"), F.col("ord")))
    rest = hits.where(F.col("turn") == most + 1).select(*finding("info", "text_pattern", F.lit(None), F.lit("more"), unreviewed=True))
    return shown.unionByName(rest)


def file_names(files: DataFrame, pattern: str | None = None, forbidden: list[str] | None = None) -> DataFrame:
    """Stems (doc_id, name) that don't match in full (major), or hold a forbidden part (minor); a pattern that can't be read: unreviewed."""
    if broken(pattern):
        return unreviewed(files, "filename", "broken pattern")
    stem = F.regexp_replace(F.regexp_replace(F.col("name"), r"^.*[\\/]", ""), r"\.[^.]+$", "")
    rows = files.withColumn("stem", stem)
    out = rows.where(F.lit(False)).select(*finding("minor", "filename", F.col("stem")))
    if pattern:
        out = out.unionByName(rows.where(~F.col("stem").rlike(full(java_pattern(pattern)))).select(*finding("major", "filename", F.col("stem"), F.lit("pattern"))))
    for part in forbidden or []:
        out = out.unionByName(rows.where(F.lower("stem").contains(part.lower())).select(*finding("minor", "filename", F.col("stem"), F.lit(part))))
    return out if pattern or forbidden else unreviewed(files, "filename", "no rule")


def header_footer(docs: DataFrame, labels: list[str], pattern: str | None = None) -> DataFrame:
    """Labels that header and footer lines (doc_id, marks) lack, white space aside, as one finding; no lines: unreviewed."""
    if broken(pattern):
        return unreviewed(docs, "header_footer", "broken pattern")
    joined = squash(F.array_join("marks", "\n"))
    missing = F.filter(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), lambda x: ~joined.contains(squash(x)))
    rows = docs.withColumn("none", F.coalesce(F.size("marks"), F.lit(0)) <= 0).withColumn("missing", missing)
    out = rows.where("none").select(*finding("info", "header_footer", F.lit(None), F.lit("no lines"), unreviewed=True))
    out = out.unionByName(rows.where(~F.col("none") & (F.size("missing") > 0)).select(*finding("minor", "header_footer", F.array_join("missing", ", "))))
    if pattern:
        out = out.unionByName(rows.where(~F.col("none") & ~F.array_join("marks", "\n").rlike(java_pattern(pattern))).select(*finding("minor", "header_footer", F.lit(pattern), F.lit("pattern"))))
    return out


def font_sizes(sizes: DataFrame, allowed: list[float]) -> DataFrame:
    """Sizes outside ``allowed``; of a size's counts the last table's holds. Needs doc_id, table_no, size, chars."""
    last = sizes.groupBy("doc_id", "size").agg(F.max_by("chars", "table_no").alias("chars"))
    return last.where(~F.col("size").isin(allowed)).select(*finding("minor", "font_size", F.col("size"), F.col("chars")))


def completeness(parts: DataFrame, required: list[tuple[str | None, str]]) -> DataFrame:
    """Required sections (number or None, title): missing is major, another title minor; a document without numbered sections can't be judged by number."""
    spark = parts.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, n, " ".join(t.split())) for i, (n, t) in enumerate(required)], "want int, number string, title string"))  # the rule's own list
    heads = parts.select("doc_id", "ord", "sec_id", F.trim(F.regexp_replace("title", r"(?U)\s+", " ")).alias("found"))
    docs = heads.groupBy("doc_id").agg(F.max(F.col("sec_id").rlike(r"^\d").cast("int")).alias("numbered"))
    grid = docs.crossJoin(wanted)
    by_number = grid.where("number is not null").join(heads.groupBy("doc_id", F.col("sec_id").alias("number")).agg(F.min_by("found", "ord").alias("found")), ["doc_id", "number"], "left")
    by_title = grid.where("number is null").join(heads.groupBy("doc_id", F.col("found").alias("title")).agg(F.min("ord").alias("at")), ["doc_id", "title"], "left")
    blind = by_number.where("numbered = 0").select(*finding("info", "completeness", F.concat_ws(" ", "number", "title"), F.lit("no numbered sections"), unreviewed=True))
    gone = by_number.where("numbered = 1 and found is null").select(*finding("major", "completeness", F.concat_ws(" ", "number", "title"), F.lit("missing")))
    other = by_number.where("numbered = 1 and found <> title").select(*finding("minor", "completeness", F.concat_ws(" ", "number", "title"), F.col("found")))
    return blind.unionByName(gone).unionByName(other).unionByName(by_title.where("at is null").select(*finding("major", "completeness", F.col("title"), F.lit("missing"))))


def field_presence(values: DataFrame, specs: DataFrame) -> DataFrame:
    """Values (doc_id, field, value, found) against specs (field, required, pattern, format, equals).

    An absent field is unreviewed; a required one that is blank is major, and so is each of pattern, format ("date" or
    "date_range") and equals that a value breaks. A format of another name is unreviewed. Null values are blank.
    """
    rows = values.join(specs, "field").withColumn("value", strip(F.coalesce("value", F.lit(""))))
    blank = squash(F.col("value")) == ""
    wrong = F.array_compact(F.array(
        F.when(F.expr("NOT value RLIKE concat('^(?:', pattern, ')$')"), "pattern"),
        F.when(F.col("format").isin("date", "date_range"), F.when(format_state(F.col("value"), F.col("format")) != "fine", format_state(F.col("value"), F.col("format")))).when(F.col("format").isNotNull(), "unknown format"),
        F.when(squash(F.col("value")) != squash(F.col("equals")), "equals"),
    ))
    states = F.when(~F.col("found"), F.array(F.lit("absent"))).when(blank, F.when(F.col("required"), F.array(F.lit("blank"))).otherwise(F.array().cast("array<string>"))).otherwise(wrong)
    rows = rows.withColumn("state", F.explode(states))
    blind = F.col("state").isin("absent", "unknown format")
    return rows.select("doc_id", F.lit(None).cast("long").alias("ord"), F.when(blind, "info").otherwise("major").alias("severity"), F.lit("field").alias("kind"), F.col("value").alias("quote"), F.concat_ws(":", "field", "state").alias("detail"), blind.alias("unreviewed"))


def format_state(value: Column, kind: Column) -> Column:
    """"fine", "unreadable" or, of a range, "reversed" for a date or a date_range (two dates with "~" between)."""
    start, end = (date_key(F.get(F.split(value, "~"), i)) for i in (0, 1))
    span = F.when((F.size(F.split(value, "~")) != 2) | start.isNull() | end.isNull(), "unreadable").when(start > end, "reversed").otherwise("fine")
    return F.when(kind == "date", F.when(date_key(value).isNull(), "unreadable").otherwise("fine")).otherwise(span)


def date_ranges(rows: DataFrame) -> DataFrame:
    """Dates (doc_id, start_text, end_text): unreadable, or an end before its start, is major; null is unreadable."""
    quote = F.concat_ws(" ~ ", "start_text", "end_text")
    state = format_state(F.concat(F.coalesce("start_text", F.lit("")), F.lit("~"), F.coalesce("end_text", F.lit(""))), F.lit("date_range"))
    return rows.withColumn("state", state).where("state <> 'fine'").select(*finding("major", "date_range", quote, F.col("state")))


def checkboxes(cells: DataFrame, options: list[str], box: str = "□☐○◯▢", ticked: str = "■☑▣●◉✔✓☒⊠") -> DataFrame:
    """doc_id, found, selected (in order of the options, once for each ticked cell), n_selected. Needs doc_id, cell.

    A cell counts for an option if that is left without its box signs; found is false where no cell does. Null cells count for none.
    """
    bare = squash(F.regexp_replace("cell", f"^[{box}{ticked} \\t]+", ""))
    on = F.substring(strip(F.col("cell")), 1, 1).rlike(f"[{ticked}]")
    marked = cells.withColumn("bare", bare).withColumn("on", on)
    times = [F.count_if(F.col("on") & (F.col("bare") == squash(F.lit(o)))) for o in options]
    picked = F.flatten(F.array(*[F.array_repeat(F.lit(o), n.cast("int")) for o, n in zip(options, times, strict=True)]))
    found = F.coalesce(F.max(F.col("bare").isin([re.sub(r"\s+", "", o) for o in options])), F.lit(False))
    return marked.groupBy("doc_id").agg(found.alias("found"), picked.alias("selected")).withColumn("n_selected", F.size("selected"))


def checkbox_findings(groups: DataFrame) -> DataFrame:
    """Of ``checkboxes``: no such group is unreviewed, none ticked is major, and more than one is major."""
    state = F.when(~F.col("found"), "absent").when(F.col("n_selected") == 0, "none").when(F.col("n_selected") > 1, "several")
    rows = groups.withColumn("state", state).where("state IS NOT NULL")
    return rows.select("doc_id", F.lit(None).cast("long").alias("ord"), F.when(F.col("found"), "major").otherwise("info").alias("severity"), F.lit("checkbox").alias("kind"), F.array_join("selected", " / ").alias("quote"), F.col("state").alias("detail"), (~F.col("found")).alias("unreviewed"))


def fixed_texts(parts: DataFrame, texts: list[str]) -> DataFrame:
    """Texts that no section of a document holds, white space aside: major. Needs doc_id, text; a null text holds nothing."""
    each = parts.select("doc_id", squash(F.coalesce("text", F.lit(""))).alias("flat"), F.explode(F.array(*[F.lit(x) for x in texts]).cast("array<string>")).alias("wanted"))
    held = each.groupBy("doc_id", "wanted").agg(F.max(F.col("flat").contains(squash(F.col("wanted")))).alias("held"))
    return held.where(~F.col("held")).select(*finding("major", "fixed_text", F.lit(None), F.col("wanted")))


def routed(items: DataFrame, ignore: list[tuple[str, str]]) -> DataFrame:
    """Items (name) with status "ignored" and a reason where a pattern matches, "kept" otherwise; nothing is dropped."""
    reason = F.coalesce(*[F.when(F.col("name").rlike(java_pattern(p)), F.lit(why)) for p, why in ignore], F.lit(None).cast("string"))
    return items.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("ignored"))


def is_process_report() -> Column:
    return (F.col("severity") == "info") | F.col("unreviewed")
