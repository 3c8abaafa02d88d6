"""From text to sections, chunks, tables and cells, and checks of layout, as DataFrame operators.

Documents are (doc_id, text). Everything that depends on order within a document carries it as a column and uses
windows over the document; only ``page_texts`` gathers the blocks of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import collapse, strip

LEVELS = range(1, 7)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, page: pages count from 1 where a document has page marks (a lone form feed), else null."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = (F.trim("line") == "\f").cast("int")
    split = split.withColumn("mark", mark).withColumn("any", F.max("mark").over(Window.partitionBy("doc_id")))
    split = split.withColumn("page", F.when(F.col("any") > 0, 1 + F.sum("mark").over(order)))
    return split.where("mark = 0").drop("mark", "any")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, parent_ord, sec_id, title, level, text, page of each section, headings in order after the preface.

    A heading is "#" to "######" and a title. Its number is made of the counters of its level and those above; text
    before the first heading is one section per page, or one without number. Lines of a section are stripped, and
    blank ones vanish.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+.*$", 1))
    rows = lines(docs).withColumn("level", level)
    rows = rows.withColumn("open", F.sum((F.col("level") > 0).cast("int")).over(order))
    heads = rows.where("level > 0")
    for n in LEVELS:
        heads = heads.withColumn(f"g{n}", F.sum(((F.col("level") < n)).cast("int")).over(order))
    for n in LEVELS:
        own = Window.partitionBy("doc_id", f"g{n}").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        heads = heads.withColumn(f"c{n}", F.sum((F.col("level") == n).cast("int")).over(own))
    for n in LEVELS:  # the nearest heading of a lower level holds this one
        heads = heads.withColumn(f"p{n}", F.max(F.when(F.col("level") < n, F.col("open"))).over(order))
    numbers = F.array(*[F.when(F.col("level") >= n, F.col(f"c{n}")).otherwise(0) for n in LEVELS])
    parent = F.coalesce(*[F.when(F.col("level") == n, F.col(f"p{n}")) for n in LEVELS])
    heads = heads.select("doc_id", F.col("open").alias("ord"), parent.alias("parent_ord"), F.array_join(F.transform(F.filter(numbers, lambda x: x > 0), lambda x: x.cast("string")), ".").alias("sec_id"), strip(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)).alias("title"), "level", "page")
    body = rows.where("level = 0").withColumn("line", strip(F.col("line"))).where("line <> ''")
    inside = body.where("open > 0").groupBy("doc_id", F.col("open").alias("ord")).agg(_joined().alias("text"))
    before = body.where("open = 0").groupBy("doc_id", "page").agg(_joined().alias("text"))
    none = F.lit(None)
    preface = before.select("doc_id", F.lit(0).cast("long").alias("ord"), none.cast("long").alias("parent_ord"), F.coalesce(F.col("page").cast("string"), F.lit("")).alias("sec_id"), F.when(F.col("page").isNull(), F.lit("(body)")).otherwise(F.concat(F.lit("page "), "page")).alias("title"), F.lit(1).alias("level"), "text", "page")
    full = heads.join(inside, ["doc_id", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return full.select(*preface.columns).unionByName(preface)


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")


def chunks(parts: DataFrame, most: int = 4000) -> DataFrame:
    """Slices of at most ``most`` characters of each section's stripped text; empty ones are left out. Needs doc_id, ord, sec_id, text."""
    text = parts.withColumn("text", strip(F.col("text"))).where("text <> ''")
    n = F.explode(F.sequence(F.lit(0), F.ceil(F.char_length("text") / most).cast("int") - 1))
    return text.select("doc_id", "ord", "sec_id", n.alias("n"), "text").select("doc_id", "ord", F.concat("sec_id", F.lit("#"), "n").alias("chunk_id"), "n", F.substring(F.col("text"), F.col("n") * most + 1, F.lit(most)).alias("text"))


def table_cells(split: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, col_no, cell of runs of lines that start and end with a pipe. Needs doc_id, line_no, line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = split.withColumn("line", strip(F.col("line"))).withColumn("is_row", F.col("line").rlike(r"^\|.*\|$") & (F.length("line") > 1))
    rows = rows.withColumn("new", (F.col("is_row") & ~F.coalesce(F.lag("is_row").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("table_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("is_row")
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("line_no")))
    cells = F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|")
    return rows.select("doc_id", "table_no", "row_no", F.posexplode(F.transform(cells, strip)).alias("col_no", "cell"))


def collapsed_merges(cells: DataFrame) -> DataFrame:
    """Without cells that repeat the one before them in their row: continuations of horizontal merges."""
    before = F.lag("cell").over(Window.partitionBy("doc_id", "table_no", "row_no").orderBy("col_no"))
    return cells.withColumn("before", before).where("cell = '' or before is null or before <> cell").drop("before")


def blocks(split: DataFrame) -> DataFrame:
    """doc_id, block_no, kind (heading, table, code, paragraph), first_line, n_lines. Needs doc_id, line_no, line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim("line").startswith("```").cast("int")
    rows = split.withColumn("fence", fence).withColumn("fences", F.sum("fence").over(upto))
    kind = F.when((F.col("fences") % 2 == 1) | (F.col("fence") == 1), "code").when(F.col("line").rlike(r"^#{1,6}\s"), "heading").when(F.trim("line").rlike(r"^\|.*\|$"), "table").when(F.trim("line") != "", "paragraph")
    rows = rows.withColumn("kind", kind)
    new = F.col("kind").isNotNull() & ((F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order)))
    rows = rows.withColumn("block_no", F.sum(new.cast("int")).over(upto)).where("kind is not null")
    return rows.groupBy("doc_id", "block_no", "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def section_number(x: Column) -> Column:
    """A number of a section, with a dot in it, without stars around; null for other texts, page numbers among them."""
    bare = F.trim(F.regexp_replace(F.trim(x), r"^\*+|\*+$", ""))
    return F.when(bare.rlike(r"^\d+(\.\d+)*\.?$") & bare.contains("."), bare)


def heading_level(number: Column) -> Column:
    """Number of a section number's parts, a last 0 left out, at most 6."""
    parts = F.filter(F.split(number, r"\."), lambda p: p != "")
    zero = (F.size(parts) > 1) & (F.element_at(parts, -1) == "0")
    return F.least(F.size(parts) - zero.cast("int"), F.lit(6))


def rescued_headings(heads: DataFrame) -> DataFrame:
    """A page's lone section number put before its only unnumbered heading. Needs doc_id, page, kind ("number" or "title"), text.

    Rows of kind number that hold none, and titles that are null, blank or begin with a digit, don't count.
    """
    number = F.when(F.col("kind") == "number", section_number(F.col("text")))
    title = F.when((F.col("kind") == "title") & F.trim("text").rlike(r"^\D"), F.trim("text"))
    lone = heads.groupBy("doc_id", "page").agg(F.count(number).alias("numbers"), F.count(title).alias("titles"), F.max(number).alias("number"), F.max(title).alias("title"))
    return lone.where("numbers = 1 and titles = 1").select("doc_id", "page", F.concat_ws(" ", "number", "title").alias("heading"))


def lifted_headings(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, heading, level of tables whose first row holds a section number, a short title and nothing else.

    Needs doc_id, table_no, row_no, col_no, cell; blank and null cells are nothing. A title starts with a letter and has
    at most 80 characters.
    """
    filled = cells.where("trim(cell) <> ''").select("doc_id", "table_no", "row_no", "col_no", F.trim("cell").alias("cell"))
    first = cells.groupBy("doc_id", "table_no").agg(F.min("row_no").alias("row_no"))
    rows = filled.join(first, ["doc_id", "table_no", "row_no"]).groupBy("doc_id", "table_no").agg(F.count("*").alias("n"), F.min_by("cell", "col_no").alias("number"), F.max_by("cell", "col_no").alias("title"))
    good = rows.where("n = 2").where(section_number(F.col("number")).isNotNull() & F.col("title").rlike(r"^\p{L}") & (F.char_length("title") <= 80))
    return good.select("doc_id", "table_no", F.concat_ws(" ", "number", "title").alias("heading"), heading_level(section_number(F.col("number"))).alias("level"))


def without_cell_lines(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line) that no table cell of their page says too, white space aside; a cell of several lines says each of them. Null lines stay."""
    said = cells.select("doc_id", "page", F.explode(F.split("cell", "\n")).alias("line")).select("doc_id", "page", collapse(F.col("line")).alias("flat")).where("flat <> ''").distinct()
    return lines.withColumn("flat", collapse(F.col("line"))).join(said, ["doc_id", "page", "flat"], "left_anti").drop("flat")


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, text, headers, footers of blocks (doc_id, page, ord, part, kind, level, text, rows).

    Pages, those without blocks too, are parted by a line with a form feed. Blocks of a part "header..." or another than
    "body" go to headers or footers, each line once, in order; those without text give their table's cells. Tables
    without rows and figures are said to be there. Null texts are empty, and null parts are "body".
    """
    flat = F.concat_ws(" ", F.transform("rows", lambda r: F.concat_ws(" ", F.filter(F.transform(r, collapse), lambda c: c != ""))))
    mark = F.when(collapse(F.coalesce("text", F.lit(""))) != "", collapse(F.col("text"))).otherwise(collapse(flat))
    part = F.coalesce("part", F.lit("body"))
    slot = F.when(part == "body", "body").when(F.startswith(part, F.lit("header")), "headers").otherwise("footers")
    body = (slot == "body") & (F.col("kind") == "figure")
    number = F.sum(body.cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "ord"))
    table = F.when(F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))) <= 0, F.lit("(표: 구조 미복원)")).otherwise(F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))), "\n"))
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n")))
    shown = shown.when(F.col("kind") == "table", F.concat(table, F.lit("\n")))
    shown = shown.when(F.col("kind") == "figure", F.concat(F.lit("[그림 "), number, F.when(collapse(F.col("text")) != "", F.concat(F.lit(": "), collapse(F.col("text")))).otherwise(""), F.lit("]"))).otherwise(F.col("text"))
    rows = blocks.select("doc_id", F.coalesce("page", F.lit(0)).alias("page"), "ord", slot.alias("slot"), shown.alias("shown"), mark.alias("mark"))
    gathered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "slot", "shown", "mark"))).alias("all"))  # the blocks of one document
    last = F.array_max(F.transform(F.filter("all", lambda b: b.slot == "body"), lambda b: b.page))
    page = lambda i: F.regexp_replace(F.array_join(F.transform(F.filter("all", lambda b: (b.slot == "body") & (b.page == i) & (F.coalesce(b.shown, F.lit("")) != "")), lambda b: b.shown), "\n"), r"^[ \n]+|[ \n]+$", "")
    text = F.when(last.isNull(), "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("int"), F.coalesce(last, F.lit(0)).cast("int")), page), "\n\f\n"))
    marks = lambda name: F.array_distinct(F.transform(F.filter("all", lambda b: (b.slot == name) & (b.mark != "")), lambda b: b.mark))
    return gathered.select("doc_id", text.alias("text"), marks("headers").alias("headers"), marks("footers").alias("footers"))


def watermarks(paged: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """doc_id, line, pages of lines of 2 to 40 characters on at least half the pages, two at least, or with a keyword. Needs doc_id, page, line."""
    rows = paged.withColumn("line", strip(F.col("line"))).where("length(line) between 2 and 40")
    total = paged.groupBy("doc_id").agg(F.count_distinct("page").alias("all_pages"))
    seen = rows.groupBy("doc_id", "line").agg(F.count_distinct("page").alias("pages")).join(total, "doc_id")
    word = F.lit(False)
    for k in keywords or []:
        word = word | F.lower("line").contains(k.lower())
    return seen.where(word | (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all_pages") / 2)))).select("doc_id", "line", "pages")


def degenerate(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_distinct, degenerate, repeated: texts of 12 words or more that repeat a handful, and the word they repeat most, the first of equals. Needs doc_id, text."""
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    rows = texts.select("doc_id", words.alias("words")).withColumn("n_words", F.size("words")).withColumn("n_distinct", F.size(F.array_distinct("words")))
    rows = rows.withColumn("degenerate", (F.col("n_words") >= 12) & (F.col("n_distinct") <= F.greatest(F.lit(2), F.floor(F.col("n_words") * 0.15))))
    each = rows.where("degenerate").select("doc_id", F.posexplode("words").alias("at", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("times"), F.min("at").alias("first"))
    mode = each.groupBy("doc_id").agg(F.max_by("word", F.struct("times", -F.col("first"))).alias("repeated"))
    return rows.drop("words").join(mode, "doc_id", "left")


def enclosing(inner: DataFrame, outer: DataFrame, share: float = 0.8) -> DataFrame:
    """For each inner box the smallest outer box of its page that holds at least ``share`` of it. Boxes: page, box_id, x0, y0, x1, y1."""
    a, b = inner.alias("a"), outer.alias("b")
    wide = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    high = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (wide > 0) & (high > 0) & (wide * high >= share * area("a")))
    met = met.select(F.col("a.page").alias("page"), F.col("a.box_id").alias("box_id"), F.struct(area("b").alias("area"), F.col("b.box_id").alias("outer_id")).alias("found"))
    return met.groupBy("page", "box_id").agg(F.min("found").alias("found")).select("page", "box_id", "found.outer_id")


def centred(inner: DataFrame, outer: DataFrame, margin: float = 0.05) -> DataFrame:
    """page, inner_id, outer_id of boxes whose centre lies in an outer box of their page, widened by ``margin`` of its size on each side. Boxes as above."""
    a, b = inner.alias("a"), outer.alias("b")
    inside = F.lit(True)
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        middle, slack = (F.col(f"a.{lo}") + F.col(f"a.{hi}")) / 2, (F.col(f"b.{hi}") - F.col(f"b.{lo}")) * margin
        inside = inside & (middle >= F.col(f"b.{lo}") - slack) & (middle <= F.col(f"b.{hi}") + slack)
    return a.join(b, (F.col("a.page") == F.col("b.page")) & inside).select("a.page", F.col("a.box_id").alias("inner_id"), F.col("b.box_id").alias("outer_id"))


def overlapping(left: DataFrame, right: DataFrame, margin: float = 0.15) -> DataFrame:
    """Pairs of boxes of a page that overlap when the left one is grown by ``margin`` of its size."""
    a, b = left.alias("a"), right.alias("b")
    dx, dy = (F.col("a.x1") - F.col("a.x0")) * margin, (F.col("a.y1") - F.col("a.y0")) * margin
    near = (F.col("a.x0") - dx < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1") + dx) & (F.col("a.y0") - dy < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1") + dy)
    return a.join(b, (F.col("a.page") == F.col("b.page")) & near).select(F.col("a.page").alias("page"), F.col("a.box_id").alias("left_id"), F.col("b.box_id").alias("right_id"))


def columns(spans: DataFrame, width: Column, gap: float = 0.06) -> DataFrame:
    """page, column_no, x0, x1: spans of a page merged unless a gap of at least ``gap`` of its width parts them. Needs page, x0, x1."""
    order = Window.partitionBy("page").orderBy("x0", "x1")
    rows = spans.withColumn("reach", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("new", F.coalesce(F.col("x0") - F.col("reach") >= gap * width, F.lit(True)).cast("int"))
    rows = rows.withColumn("column_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page", "column_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def failed_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, failed: less than half the median volume of the document's good pages; never where no page is good. Needs doc_id, page, volume, good."""
    middle = pages.where("good").groupBy("doc_id").agg(F.median("volume").alias("middle"))
    return pages.join(middle, "doc_id", "left").select("doc_id", "page", F.coalesce(F.col("volume") < 0.5 * F.col("middle"), F.lit(False)).alias("failed"))


def engine_agreement(pages: DataFrame, pattern: str = r"\p{IsHangul}", least: float = 0.8) -> DataFrame:
    """doc_id, ratio, agrees, empty_pages: letters that engine a found as a share of engine b's. Needs doc_id, page, a, b (texts)."""
    n = lambda c: F.regexp_count(F.col(c), F.lit(pattern))
    out = pages.groupBy("doc_id").agg(F.sum(n("a")).alias("na"), F.sum(n("b")).alias("nb"), F.array_sort(F.collect_list(F.when(F.trim("a") == "", F.col("page")))).alias("empty_pages"))
    ratio = F.when(F.col("nb") > 0, F.col("na") / F.col("nb"))
    return out.select("doc_id", ratio.alias("ratio"), F.coalesce(ratio >= least, F.lit(True)).alias("agrees"), "empty_pages")


def described_images(parts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """"[figure n]" replaced by "[figure n: text]" where n is described. Needs doc_id, ord, text, and doc_id, figure, description."""
    marks = parts.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\[figure (\d+)\]"), F.lit(1))).alias("n")).distinct()
    told = marks.join(descriptions.withColumn("n", F.col("figure").cast("string")), ["doc_id", "n"]).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("n", "description"))).alias("told"))
    text = F.aggregate("told", F.col("text"), lambda acc, s: F.replace(acc, F.concat(F.lit("[figure "), s["n"], F.lit("]")), F.concat(F.lit("[figure "), s["n"], F.lit(": "), s["description"], F.lit("]"))))
    return parts.join(told, ["doc_id", "ord"], "left").withColumn("text", F.when(F.col("told").isNull(), F.col("text")).otherwise(text)).drop("told")


def continued_tables(tables: DataFrame) -> DataFrame:
    """doc_id, table_no, whole_no: tables without a header that are as wide as the one before continue it. Needs doc_id, table_no, width, has_header."""
    order = Window.partitionBy("doc_id").orderBy("table_no")
    new = (F.col("has_header") | ~F.col("width").eqNullSafe(F.lag("width").over(order))).cast("int")
    return tables.withColumn("new", new).withColumn("whole_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "table_no", "whole_no")
