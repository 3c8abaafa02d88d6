"""Ids, statements, labelled fields and table rows from text and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import captured, java_pattern, original_name, squash, strip


def unwrapped(text):
    """Text with words joined again that a hyphen broke at a line's end."""
    return F.regexp_replace(text, r"-[ \t]*\n[ \t]*", "-")


def id_anchors(parts: DataFrame, pattern: str) -> DataFrame:
    """doc_id, id, ord of the first section (its title, then its text) that holds each id. Needs doc_id, ord, title, text."""
    both = F.concat_ws("\n", unwrapped(F.col("title")), unwrapped(F.col("text")))
    each = parts.select("doc_id", "ord", F.explode(F.regexp_extract_all(both, F.lit(java_pattern(pattern)), F.lit(0))).alias("id"))
    return each.groupBy("doc_id", "id").agg(F.min("ord").alias("ord"))


def id_statements(lines: DataFrame, pattern: str) -> DataFrame:
    """doc_id, id, line_no, line of the first line that holds each id. Needs doc_id, line_no, line."""
    each = lines.select("doc_id", "line_no", strip(F.col("line")).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(java_pattern(pattern)), F.lit(0))).alias("id"))
    first = Window.partitionBy("doc_id", "id").orderBy("line_no")
    return each.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")


def labelled_fields(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """Value right of or below a label's cell, for each document and spec (field, label, at).

    Labels match whole cells, white space aside. The first place with a value that isn't blank wins, else the first
    blank one; found is false where no label is there or nothing lies beside it. Needs doc_id, table_no, row_no, col_no, cell.
    """
    rules = specs.withColumn("squashed", squash(F.col("label")))
    fields = specs.select("field").distinct().agg(F.collect_list("field").alias("fields"))  # of one rule set
    docs = cells.select("doc_id").distinct().select("doc_id", F.explode(fields.scalar()).alias("field"))
    below = (F.col("at") == "below").cast("int")
    heads = cells.withColumn("squashed", squash(F.col("cell"))).join(F.broadcast(rules), "squashed")  # specs are a short list
    heads = heads.select("doc_id", "field", "label", "table_no", (F.col("row_no") + below).alias("row_no"), (F.col("col_no") + 1 - below).alias("col_no"))
    # cells made from few columns or exploded are estimated far too small, so that without the hints they would be broadcast
    beside = heads.join(cells.hint("merge"), ["doc_id", "table_no", "row_no", "col_no"])
    best = beside.groupBy("doc_id", "field").agg(F.min(F.struct((F.trim("cell") == "").alias("blank"), "table_no", "row_no", "col_no", F.col("cell").alias("value"), F.col("label").alias("matched_label"))).alias("best"))
    return docs.join(best.hint("merge"), ["doc_id", "field"], "left").select("doc_id", "field", "best.value", F.col("best").isNotNull().alias("found"), "best.matched_label")


def extract_fields(cells: DataFrame, specs: list[dict]) -> DataFrame:
    """A row for every document and spec, whatever was found: doc_id, field, value, found, matched_label, selected, n_rows.

    specs: name, source, and what the source takes: "table" labels, at, pattern; "table_cell" labels; "checkbox_group"
    options; "table_rows" columns, key. Header, footer and sources of other names can't be read here and come back with
    found = false. Needs doc_id, table_no, row_no, col_no, cell; an empty table gives no rows.
    """
    from quillon.operators import rules

    spark, docs = cells.sparkSession, cells.select("doc_id").distinct()
    none = {"value": F.lit(None).cast("string"), "found": F.lit(False), "matched_label": F.lit(None).cast("string"), "selected": F.lit(None).cast("array<string>"), "n_rows": F.lit(None).cast("long")}

    def shaped(frame: DataFrame, name: str, **own: Column) -> DataFrame:
        return frame.select("doc_id", F.lit(name).alias("field"), *[own.get(c, empty).alias(c) for c, empty in none.items()])

    out = []
    for s in specs:
        name, source, labels = s["name"], s.get("source", "table"), s.get("labels", [])
        if source == "table":
            table = spark.createDataFrame([(name, x, s.get("at", "right")) for x in labels], "field string, label string, at string")
            got = docs.join(labelled_fields(cells, table), "doc_id", "left")
            got = captured_fields(got, s["pattern"]) if s.get("pattern") else got
            out.append(shaped(got, name, value=F.col("value"), found=F.coalesce("found", F.lit(False)), matched_label=F.col("matched_label")))
        elif source == "table_cell":
            got = docs
            for i, x in enumerate(labels):
                got = got.join(table_cell(cells, x).withColumnRenamed("value", f"value{i}"), "doc_id", "left")
            hits = [F.struct(F.col(f"value{i}").alias("value"), F.lit(x).alias("label")) for i, x in enumerate(labels)]
            first = F.get(F.filter(F.array(*hits), lambda h: h["value"].isNotNull()), F.lit(0)) if labels else F.lit(None).cast("struct<value string, label string>")
            got = got.withColumn("first", first)
            out.append(shaped(got, name, value=F.col("first.value"), found=F.col("first").isNotNull(), matched_label=F.col("first.label")))
        elif source == "checkbox_group":
            out.append(shaped(rules.checkboxes(cells, s.get("options", [])), name, found=F.col("found"), selected=F.col("selected")))
        elif source == "table_rows":
            heads = header_rows(cells, s["columns"])
            rows = table_rows(cells, s["columns"], s["key"]).groupBy("doc_id").agg(F.count("*").alias("rows"))
            got = docs.join(heads, "doc_id", "left").join(rows, "doc_id", "left")
            out.append(shaped(got, name, found=F.col("head").isNotNull(), n_rows=F.when(F.col("head").isNotNull(), F.coalesce("rows", F.lit(0)))))
        else:
            out.append(shaped(docs, name))
    return reduce(DataFrame.unionByName, out) if out else shaped(docs.where("false"), "")


def captured_fields(values: DataFrame, pattern: str) -> DataFrame:
    """Values cut down to what the pattern captures; without a match found turns false."""
    cut = captured(F.col("value"), pattern)
    return values.withColumn("cut", cut).withColumn("found", F.col("found") & F.col("cut").isNotNull()).withColumn("value", F.col("cut")).drop("cut")


def table_lines(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cells (array, in order of the columns)."""
    return cells.groupBy("doc_id", "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda s: s["cell"]).alias("cells"))


def header_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, head (table_no, row_no, cells): the first row that holds all ``columns``."""
    wanted = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    rows = table_lines(cells).where(F.forall(wanted, lambda c: F.array_contains(F.col("cells"), c)))
    return rows.groupBy("doc_id").agg(F.min(F.struct("table_no", "row_no", "cells")).alias("head"))


def table_rows(cells: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows below the first header row that holds all ``columns``: doc_id, table_no, row_no, cells (map). Short rows, repeated headers and blank keys are skipped."""
    rows, head = table_lines(cells), header_rows(cells, columns)
    wanted = F.array(*[F.lit(c) for c in columns])
    is_head = F.forall(wanted, lambda c: F.array_contains(F.col("cells"), c))
    below = rows.where(~is_head).join(head, "doc_id").where("table_no = head.table_no and row_no > head.row_no and size(cells) >= size(head.cells)")
    cut = F.map_from_arrays(wanted, F.transform(wanted, lambda c: F.element_at("cells", F.array_position("head.cells", c).cast("int"))))
    return below.withColumn("row", cut).where(F.trim(F.element_at("row", key)) != "").select("doc_id", "table_no", "row_no", F.col("row").alias("cells"))


def table_cell(cells: DataFrame, label: str) -> DataFrame:
    """doc_id, value: blanks dropped from the header row that holds ``label`` and from the next row that isn't blank, the value at the same place; lengths must agree."""
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda s: s["cell"]), lambda c: c != "").alias("full"))
    rows = rows.where(F.size("full") > 0)
    after = F.lead("full").over(Window.partitionBy("doc_id", "table_no").orderBy("row_no"))
    rows = rows.withColumn("next", after).where(F.array_contains("full", label) & (F.size("full") == F.size("next")))
    first = rows.groupBy("doc_id").agg(F.min(F.struct("table_no", "row_no", F.element_at("next", F.array_position("full", label).cast("int")).alias("value"))).alias("best"))
    return first.select("doc_id", "best.value")


def lower_spelled(words: DataFrame) -> DataFrame:
    """doc_id, upper-cased word of words that are also written otherwise than in capitals. Needs doc_id, word."""
    return words.where(F.col("word") != F.upper("word")).select("doc_id", F.upper("word").alias("word")).distinct()


def classified(files: DataFrame, specs: DataFrame) -> DataFrame:
    """Files (file_id, name) with the output whose stem, the longest, their name holds; the first spec of equals. specs: ord, output_key, stem, revision."""
    names = files.withColumn("squashed", squash(F.col("name")))
    rules = F.broadcast(specs)  # rules are a short list
    met = names.join(rules, F.col("squashed").contains(squash(F.col("stem"))))
    best = met.groupBy("file_id").agg(F.max_by(F.struct("output_key", "stem", "revision"), F.struct(F.length("stem"), -F.col("ord"))).alias("best"))
    out = files.join(best, "file_id", "left").select(*files.columns, "best.output_key", F.col("best.stem").alias("form"), F.col("best.revision").alias("expected"))
    found = F.regexp_extract("name", r"(?i)rev\.?\s*(\d+)", 1)
    return out.withColumn("revision_stale", F.coalesce((found != "") & F.col("expected").isNotNull() & (found != F.col("expected")), F.lit(False)))


def originals(files: DataFrame) -> DataFrame:
    return files.withColumn("original", original_name(F.col("name")))


#: Words that tell a checklist's columns by their headings, in the order in which columns are given out.
ROLE_WORDS = {
    "text": ("항목", "내용", "item", "description"),
    "no": ("no", "id", "번호"),
    "group": ("종류", "위치", "구분", "characteristic"),
}


def guessed_columns(cells: Column) -> Column:
    """Struct of positions from 0 of a heading row's columns: text, no, group, note; null where none is.

    Each column has one role, the first that fits; note is the last column left over.
    """
    lowered = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    at = F.transform(lowered, lambda c, i: F.struct(c.alias("cell"), i.alias("i")))
    taken: list[Column] = []

    def free(cell: Column) -> Column:
        return reduce(lambda a, t: a & ~cell["i"].eqNullSafe(t), taken, F.lit(True))

    for words in ROLE_WORDS.values():
        fits = F.filter(at, lambda s: free(s) & reduce(lambda a, b: a | b, [s["cell"].contains(w) for w in words]))  # noqa: B023
        taken.append(F.get(fits, F.lit(0))["i"])
    left = F.filter(at, free)
    note = F.element_at(F.transform(left, lambda s: s["i"]), -1)
    return F.struct(*[t.alias(role) for t, role in zip(taken, ROLE_WORDS, strict=True)], F.when(F.size(left) > 0, note).alias("note"))


def checklist_items(rows: DataFrame, most_header: int = 10) -> DataFrame:
    """Items of checklist tables: doc_id, table_no, row_no, no, text, group, note. Needs doc_id, table_no, row_no, cells.

    The heading is, of a table's first ``most_header`` rows, the first in which most of text, no and group are found; rows
    below it with a text are items. A table without a heading has none. Null cells are empty.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("row_no"))
    guessed = rows.withColumn("turn", first).where(F.col("turn") <= most_header).withColumn("at", guessed_columns(F.col("cells")))
    score = sum(F.col(f"at.{c}").isNotNull().cast("int") for c in ROLE_WORDS)
    heads = guessed.withColumn("score", score).where("score > 0")
    heads = heads.groupBy("doc_id", "table_no").agg(F.max_by(F.struct("row_no", "at"), F.struct("score", -F.col("row_no"))).alias("head"))
    items = rows.join(heads, ["doc_id", "table_no"]).where(F.col("row_no") > F.col("head.row_no"))
    cut = {c: F.coalesce(F.trim(F.get("cells", F.col(f"head.at.{c}"))), F.lit("")) for c in ("no", "text", "group", "note")}
    return items.select("doc_id", "table_no", "row_no", *[v.alias(c) for c, v in cut.items()]).where("text <> ''")
