"""All queries over the driver's tables, each with SQL that gives the same rows.

The tables are business rows and prose; each query first brings them into the shape that an operator takes, by the
same rule on both sides, and then applies the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as fn
from quillon.operators import extraction, linking, rules, structure, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- shapes -------------------------------------------------------------------------------------------------------

LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
HEADED = LINES + ", h AS (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN '# ' || line WHEN 2 THEN '## ' || line ELSE line END AS line FROM l)"
SECTIONS = HEADED + r""", v AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+.*$', 1)) AS level FROM h),
o AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS ord, sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS c1 FROM v),
hd AS (SELECT doc_id, ord, level, CASE WHEN level = 2 THEN max(CASE WHEN level = 1 THEN ord END) OVER (PARTITION BY doc_id ORDER BY line_no) END AS parent_ord,
 c1 || CASE WHEN level = 2 THEN '.' || sum((level = 2)::INT) OVER (PARTITION BY doc_id, c1 ORDER BY line_no) ELSE '' END AS sec_id,
 trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) AS title FROM o WHERE level > 0),
bd AS (SELECT doc_id, ord, string_agg(trim(line), chr(10) ORDER BY line_no) AS text FROM o WHERE level = 0 AND trim(line) <> '' GROUP BY ALL),
sec AS (SELECT hd.doc_id, hd.ord, parent_ord, sec_id, title, level, coalesce(text, '') AS text FROM hd LEFT JOIN bd USING (doc_id, ord))"""
CELLS = LINES + r""", p AS (SELECT doc_id, line_no, CASE WHEN contains(line, ' | ') THEN '| ' || line || ' |' ELSE line END AS line FROM l),
r AS (SELECT *, regexp_matches(trim(line), '^\|.*\|$') AND length(trim(line)) > 1 AS is_row FROM p),
n AS (SELECT *, (is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc_id ORDER BY line_no), false))::INT AS new FROM r),
t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS table_no FROM n),
k AS (SELECT doc_id, table_no, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY line_no) AS row_no, string_split(substring(trim(line), 2, length(trim(line)) - 2), '|') AS parts FROM t WHERE is_row),
cell AS (SELECT doc_id, table_no, row_no, generate_subscripts(parts, 1) - 1 AS col_no, trim(unnest(parts)) AS cell FROM k)"""
FINDINGS = """f AS (SELECT event_id AS seq, event_id % 40 AS doc_id, CASE event_id % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'info' END AS severity, event_type AS message, 'c' || (event_id % 4) AS checker, 's' || (event_id % 7) AS section, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS kind, CASE WHEN event_id % 9 = 0 THEN []::VARCHAR[] ELSE ['  ' || event_type, event_type || ' ' || (event_id % 11)] END AS quotes, event_id % 6 = 0 AS unreviewed FROM events)"""


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return structure.lines(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "line_no", "line")


def headed(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x))
    return read(spark, sf, "documents").select("doc_id", F.array_join(mark, "\n").alias("text"))


def sections_of(spark: SparkSession, sf: str) -> DataFrame:
    return structure.sections(headed(spark, sf))


def cells_of(spark: SparkSession, sf: str) -> DataFrame:
    piped = F.when(F.col("line").contains(" | "), F.concat(F.lit("| "), "line", F.lit(" |"))).otherwise(F.col("line"))
    return structure.table_cells(lines_of(spark, sf).withColumn("line", piped))


def findings_of(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    quotes = F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("  "), kind), F.concat(kind, F.lit(" "), (i % 11).cast("string"))))
    severity = F.when(i % 3 == 0, "major").when(i % 3 == 1, "minor").otherwise("info")
    return e.select(i.alias("seq"), (i % 40).alias("doc_id"), severity.alias("severity"), kind.alias("message"), F.concat(F.lit("c"), i % 4).alias("checker"), F.concat(F.lit("s"), i % 7).alias("section"), F.when(i % 5 == 0, "").otherwise(kind).alias("kind"), quotes.alias("quotes"), (i % 6 == 0).alias("unreviewed"))


# --- structure ----------------------------------------------------------------------------------------------------


@query(f"WITH {SECTIONS} SELECT doc_id, ord::BIGINT AS ord, parent_ord::BIGINT AS parent_ord, sec_id, title, level::INT AS level, text FROM sec")
def document_structure(spark: SparkSession, sf: str) -> DataFrame:
    return sections_of(spark, sf).drop("page")


@query("WITH " + SECTIONS + ", s AS (SELECT *, unnest(range(0, ceil(length(text) / 200.0)::INT)) AS n FROM sec WHERE text <> '') SELECT doc_id, ord::BIGINT AS ord, sec_id || '#' || n AS chunk_id, n::INT AS n, substring(text, (n * 200 + 1)::INT, 200) AS text FROM s")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return structure.chunks(sections_of(spark, sf), 200)


@query(f"WITH {CELLS} SELECT doc_id, table_no::BIGINT AS table_no, row_no::INT AS row_no, col_no::INT AS col_no, cell FROM cell")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_of(spark, sf)


@query(f"WITH {CELLS}, b AS (SELECT *, lag(cell) OVER (PARTITION BY doc_id, table_no, row_no ORDER BY col_no) AS before FROM cell) SELECT doc_id, table_no::BIGINT AS table_no, row_no::INT AS row_no, col_no::INT AS col_no, cell FROM b WHERE cell = '' OR before IS NULL OR before <> cell")
def collapsed_merges(spark: SparkSession, sf: str) -> DataFrame:
    return structure.collapsed_merges(cells_of(spark, sf))


@query("WITH " + HEADED + r""", q AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(trim(line, ' '), '^\|.*\|$') THEN 'table' WHEN trim(line, ' ') <> '' THEN 'paragraph' END AS kind FROM h),
w AS (SELECT *, (kind IS NOT NULL AND (kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no)))::INT AS new FROM q),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM w)
SELECT doc_id, block_no::BIGINT AS block_no, kind, min(line_no)::INT AS first_line, count(*) AS n_lines FROM z WHERE kind IS NOT NULL GROUP BY ALL""")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return structure.blocks(structure.lines(headed(spark, sf)))


@query("WITH g AS (SELECT conv_id AS doc_id, turn // 2 AS page, count_if(role = 'user') AS nu, count_if(role <> 'user') AS na, max(CASE WHEN role = 'user' THEN conv_id || '.' || turn END) AS number, max(CASE WHEN role <> 'user' THEN 'Title ' || conv_id END) AS title FROM conversations GROUP BY ALL) SELECT doc_id, page, number || ' ' || title AS heading FROM g WHERE nu = 1 AND na = 1")
def rescued_headings_all(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("role") == "user"
    heads = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("page"), F.when(user, "number").otherwise("title").alias("kind"), F.when(user, F.concat_ws(".", "conv_id", "turn")).otherwise(F.concat(F.lit("Title "), "conv_id")).alias("text"))
    return structure.rescued_headings(heads)


@query("WITH " + LINES + ", g AS (SELECT doc_id % 100 AS doc_id, doc_id AS page, trim(line) AS line FROM l), n AS (SELECT doc_id, count(DISTINCT page) AS all_pages FROM g GROUP BY ALL), s AS (SELECT doc_id, line, count(DISTINCT page) AS pages FROM g WHERE length(line) BETWEEN 2 AND 40 GROUP BY ALL) SELECT doc_id, line, pages FROM s JOIN n USING (doc_id) WHERE contains(lower(line), 'license') OR pages >= greatest(2, ceil(all_pages / 2.0))")
def watermark_lines(spark: SparkSession, sf: str) -> DataFrame:
    paged = lines_of(spark, sf).select((F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").alias("page"), "line")
    return structure.watermarks(paged, ["license"])


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents), d AS (SELECT doc_id, len(words) AS n_words, len(list_distinct(words)) AS n_distinct, words FROM w), g AS (SELECT *, n_words >= 12 AND n_distinct <= greatest(2, floor(n_words * 0.15)) AS degenerate FROM d), e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM g WHERE degenerate), c AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM e GROUP BY ALL), m AS (SELECT doc_id, arg_max(word, n * 1000000 - first) AS repeated FROM c GROUP BY ALL) SELECT doc_id, n_words::INT AS n_words, n_distinct::INT AS n_distinct, degenerate, repeated FROM g LEFT JOIN m USING (doc_id)")
def degenerate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return structure.degenerate(read(spark, sf, "documents"))


BOXES = "a AS (SELECT p_partkey % 20 AS page, p_partkey AS box_id, (p_partkey % 90)::DOUBLE AS x0, (p_partkey % 70)::DOUBLE AS y0, (p_partkey % 90 + 5)::DOUBLE AS x1, (p_partkey % 70 + 4)::DOUBLE AS y1 FROM part), b AS (SELECT s_suppkey % 20 AS page, s_suppkey AS box_id, (s_suppkey % 60)::DOUBLE AS x0, (s_suppkey % 40)::DOUBLE AS y0, (s_suppkey % 60 + 20 + s_suppkey % 13)::DOUBLE AS x1, (s_suppkey % 40 + 20)::DOUBLE AS y1 FROM supplier)"


def boxes_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    a = read(spark, sf, "part").select((p % 20).alias("page"), p.alias("box_id"), (p % 90).cast("double").alias("x0"), (p % 70).cast("double").alias("y0"), (p % 90 + 5).cast("double").alias("x1"), (p % 70 + 4).cast("double").alias("y1"))
    b = read(spark, sf, "supplier").select((s % 20).alias("page"), s.alias("box_id"), (s % 60).cast("double").alias("x0"), (s % 40).cast("double").alias("y0"), (s % 60 + 20 + s % 13).cast("double").alias("x1"), (s % 40 + 20).cast("double").alias("y1"))
    return a, b


@query(f"WITH {BOXES}, m AS (SELECT a.page, a.box_id, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, b.box_id AS outer_id FROM a JOIN b ON a.page = b.page AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.8 * (a.x1 - a.x0) * (a.y1 - a.y0)) SELECT page, box_id, outer_id FROM (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY area, outer_id) AS t FROM m) WHERE t = 1")
def enclosing_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return structure.enclosing(*boxes_of(spark, sf))


@query(f"WITH {BOXES} SELECT a.page, a.box_id AS left_id, b.box_id AS right_id FROM a JOIN b ON a.page = b.page AND a.x0 - 0.15 * (a.x1 - a.x0) < b.x1 AND b.x0 < a.x1 + 0.15 * (a.x1 - a.x0) AND a.y0 - 0.15 * (a.y1 - a.y0) < b.y1 AND b.y0 < a.y1 + 0.15 * (a.y1 - a.y0)")
def overlapping_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return structure.overlapping(*boxes_of(spark, sf))


@query("WITH s AS (SELECT l_orderkey AS page, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500 + l_quantity)::DOUBLE AS x1 FROM lineitem), r AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), n AS (SELECT *, sum(coalesce(x0 - reach >= 0.06 * 500, true)::INT) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS column_no FROM r) SELECT page, column_no::BIGINT AS column_no, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY ALL")
def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.col("l_partkey") % 500).cast("double")
    return structure.columns(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), at.alias("x0"), (at + F.col("l_quantity")).alias("x1")), F.lit(500.0))


@query("WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_totalprice AS volume, o_orderstatus = 'F' AS good FROM orders), m AS (SELECT doc_id, median(volume) AS middle FROM p WHERE good GROUP BY ALL) SELECT doc_id, page, coalesce(volume < 0.5 * middle, false) AS failed FROM p LEFT JOIN m USING (doc_id)")
def failed_pages(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return structure.failed_pages(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("volume"), (F.col("o_orderstatus") == "F").alias("good")))


@query("WITH p AS (SELECT doc_id % 50 AS doc_id, doc_id AS page, text AS a, CASE WHEN doc_id % 3 = 0 THEN text || text ELSE text END AS b FROM documents), g AS (SELECT doc_id, sum(len(regexp_extract_all(a, '[éèêüöäßñóí]'))) AS na, sum(len(regexp_extract_all(b, '[éèêüöäßñóí]'))) AS nb FROM p GROUP BY ALL) SELECT doc_id, CASE WHEN nb > 0 THEN na / nb END AS ratio, coalesce(na / nullif(nb, 0) >= 0.8, true) AS agrees FROM g")
def engine_agreement(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    pages = d.select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("page"), F.col("text").alias("a"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", "text")).otherwise(F.col("text")).alias("b"))
    return structure.engine_agreement(pages, "[éèêüöäßñóí]").drop("empty_pages")


@query("WITH p AS (SELECT p_partkey AS doc_id, 0::BIGINT AS ord, 'see [figure ' || (p_partkey % 5) || '] and [figure 9]' AS text FROM part) SELECT doc_id, ord, CASE WHEN doc_id % 2 = 0 THEN replace(text, '[figure ' || (doc_id % 5) || ']', '[figure ' || (doc_id % 5) || ': ' || p_name || ']') ELSE text END AS text FROM p JOIN part ON p_partkey = doc_id")
def described_images(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    n = F.col("p_partkey") % 5
    parts = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("see [figure "), n, F.lit("] and [figure 9]")).alias("text"))
    told = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), n.alias("figure"), F.col("p_name").alias("description"))
    return structure.described_images(parts, told)


@query("WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_no, o_orderkey % 3 AS width, o_orderstatus = 'O' AS has_header FROM orders), n AS (SELECT *, (has_header OR width IS DISTINCT FROM lag(width) OVER (PARTITION BY doc_id ORDER BY table_no))::INT AS new FROM t) SELECT doc_id, table_no, sum(new) OVER (PARTITION BY doc_id ORDER BY table_no)::BIGINT AS whole_no FROM n")
def continued_tables(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return structure.continued_tables(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_no"), (F.col("o_orderkey") % 3).alias("width"), (F.col("o_orderstatus") == "O").alias("has_header")))


# --- rules --------------------------------------------------------------------------------------------------------


@query("WITH " + SECTIONS + r", s AS (SELECT doc_id, ord, trim(unnest(string_split(text, chr(10)))) AS line FROM sec) SELECT doc_id, ord::BIGINT AS ord, 'major' AS severity, 'placeholder' AS kind, line AS quote, count(*)::VARCHAR AS detail, false AS unreviewed FROM s WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])(password|reserved)([^A-Za-z0-9_]|$)') GROUP BY ALL")
def placeholder_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rules.placeholders(sections_of(spark, sf), ["password", "reserved"])


@query("WITH " + SECTIONS + r", m AS (SELECT doc_id, ord, regexp_extract_all(text, '[A-Z][a-z]+\.') AS found FROM sec), e AS (SELECT doc_id, ord, unnest(found) AS quote, generate_subscripts(found, 1) AS i FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) AS turn FROM e WHERE NOT regexp_full_match(quote, '[A-Z][a-z]{0,5}\.')) SELECT doc_id, CASE WHEN turn <= 3 THEN ord END::BIGINT AS ord, CASE WHEN turn <= 3 THEN 'minor' ELSE 'info' END AS severity, 'text_pattern' AS kind, CASE WHEN turn <= 3 THEN quote END AS quote, CASE WHEN turn <= 3 THEN turn::VARCHAR ELSE 'more' END AS detail, turn > 3 AS unreviewed FROM r WHERE turn <= 4")
def notation_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return rules.text_pattern(sections_of(spark, sf), find=r"[A-Z][a-z]+\.", must=r"[A-Z][a-z]{0,5}\.", most=3)


@query(r"WITH s AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(url, '^.*[\\/]', ''), '\.[^.]+$', '') AS stem FROM pages) SELECT doc_id, NULL::BIGINT AS ord, 'major' AS severity, 'filename' AS kind, stem AS quote, 'pattern' AS detail, false AS unreviewed FROM s WHERE NOT regexp_full_match(stem, '[0-9]+') UNION ALL SELECT doc_id, NULL, 'minor', 'filename', stem, 'TOP', false FROM s WHERE contains(lower(stem), 'top')")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return rules.file_names(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("name")), "[0-9]+", ["TOP"])


@query(r"WITH g AS (SELECT o_custkey AS doc_id, list(o_orderpriority) AS marks FROM orders GROUP BY ALL), d AS (SELECT c_custkey AS doc_id, marks FROM customer LEFT JOIN g ON doc_id = c_custkey), j AS (SELECT *, regexp_replace(array_to_string(marks, ''), '\s+', '', 'g') AS flat FROM d), m AS (SELECT *, list_filter(['1-URGENT', '4-NOT SPECIFIED'], lambda x: NOT contains(flat, replace(x, ' ', ''))) AS missing FROM j) SELECT doc_id, NULL::BIGINT AS ord, 'info' AS severity, 'header_footer' AS kind, NULL::VARCHAR AS quote, 'no lines' AS detail, true AS unreviewed FROM m WHERE marks IS NULL UNION ALL SELECT doc_id, NULL, 'minor', 'header_footer', array_to_string(missing, ', '), NULL, false FROM m WHERE marks IS NOT NULL AND len(missing) > 0")
def header_footer(spark: SparkSession, sf: str) -> DataFrame:
    marks = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list("o_orderpriority").alias("marks"))
    docs = read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")).join(marks, "doc_id", "left")
    return rules.header_footer(docs, ["1-URGENT", "4-NOT SPECIFIED"])


SIZES = "z AS (SELECT l_suppkey AS doc_id, l_orderkey AS table_no, l_quantity AS size, max(l_partkey) AS chars FROM lineitem GROUP BY ALL)"


@query(f"WITH {SIZES}, w AS (SELECT doc_id, size, arg_max(chars, table_no) AS chars FROM z GROUP BY ALL) SELECT doc_id, NULL::BIGINT AS ord, 'minor' AS severity, 'font_size' AS kind, (size::INT)::VARCHAR || '.0' AS quote, chars::VARCHAR AS detail, false AS unreviewed FROM w WHERE size NOT IN (10, 11, 12)")
def font_sizes(spark: SparkSession, sf: str) -> DataFrame:
    z = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("table_no"), F.col("l_quantity").alias("size")).agg(F.max("l_partkey").alias("chars"))
    return rules.font_sizes(z, [10.0, 11.0, 12.0])


@query("WITH " + SECTIONS + r", t AS (SELECT doc_id, ord, sec_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS found FROM sec), d AS (SELECT DISTINCT doc_id FROM t), n AS (SELECT doc_id, arg_min(found, ord) AS found FROM t WHERE sec_id = '2.1' GROUP BY ALL), u AS (SELECT DISTINCT doc_id FROM t WHERE found = 'The.') SELECT doc_id, NULL::BIGINT AS ord, CASE WHEN found IS NULL THEN 'major' ELSE 'minor' END AS severity, 'completeness' AS kind, '2.1 Scope' AS quote, coalesce(found, 'missing') AS detail, false AS unreviewed FROM d LEFT JOIN n USING (doc_id) WHERE found IS DISTINCT FROM 'Scope' UNION ALL SELECT doc_id, NULL, 'major', 'completeness', 'The.', 'missing', false FROM d ANTI JOIN u USING (doc_id)")
def required_sections(spark: SparkSession, sf: str) -> DataFrame:
    return rules.completeness(sections_of(spark, sf), [("2.1", "Scope"), (None, "The.")])


VALUES = "fv AS (SELECT c_custkey AS doc_id, 'name' AS field, c_name AS value, c_custkey % 7 <> 0 AS found FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END, c_custkey % 11 <> 0 FROM customer)"


def values_of(spark: SparkSession, sf: str) -> DataFrame:
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    a = c.select(k.alias("doc_id"), F.lit("name").alias("field"), F.col("c_name").alias("value"), (k % 7 != 0).alias("found"))
    return a.unionByName(c.select(k.alias("doc_id"), F.lit("segment").alias("field"), F.when(k % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("value"), (k % 11 != 0).alias("found")))


@query(f"""WITH {VALUES}, s AS (SELECT doc_id, field, found, trim(value) AS value FROM fv), t AS (SELECT *, CASE WHEN NOT found THEN ['absent'] WHEN value = '' THEN CASE WHEN field = 'segment' THEN ['blank'] ELSE [] END
 WHEN field = 'name' THEN list_concat(CASE WHEN regexp_full_match(value, '.*[0-4]') THEN [] ELSE ['pattern'] END, ['unknown format'])
 ELSE list_concat(CASE WHEN regexp_full_match(value, 'B.*|M.*') THEN [] ELSE ['pattern'] END, CASE WHEN replace(value, ' ', '') = 'BUILDING' THEN [] ELSE ['equals'] END) END AS states FROM s), e AS (SELECT *, unnest(states) AS state FROM t)
SELECT doc_id, NULL::BIGINT AS ord, CASE WHEN state IN ('absent', 'unknown format') THEN 'info' ELSE 'major' END AS severity, 'field' AS kind, value AS quote, field || ':' || state AS detail, state IN ('absent', 'unknown format') AS unreviewed FROM e""")
def field_presence(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame([("name", False, ".*[0-4]", "time", None), ("segment", True, "B.*|M.*", None, "BUILD ING")], "field string, required boolean, pattern string, format string, equals string")
    return rules.field_presence(values_of(spark, sf), specs)


@query("""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, strftime(o_orderdate, '%Y. %-m. %-d.') AS start_text, CASE WHEN l_orderkey % 9 = 0 THEN '2001. 13. 1.' WHEN l_orderkey % 4 = 0 THEN strftime(o_orderdate - INTERVAL 3 DAY, '%Y.%m.%d') WHEN l_orderkey % 7 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y .%m .%d .') END AS end_text, o_orderdate AS a,
 CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN o_orderdate - INTERVAL 3 DAY WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_shipdate END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT doc_id, NULL::BIGINT AS ord, 'major' AS severity, 'date_range' AS kind, start_text || ' ~ ' || end_text AS quote, CASE WHEN b IS NULL THEN 'unreadable' ELSE 'reversed' END AS detail, false AS unreviewed FROM d WHERE b IS NULL OR a::DATE > b::DATE""")
def date_ranges(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_orderkey")
    end = F.when(k % 9 == 0, "2001. 13. 1.").when(k % 4 == 0, F.date_format(F.expr("o_orderdate - interval 3 days"), "yyyy.MM.dd"))
    end = end.when(k % 7 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyy .MM .dd ."))
    return rules.date_ranges(both.select((k * 10 + F.col("l_linenumber")).alias("doc_id"), F.date_format("o_orderdate", "y. M. d.").alias("start_text"), end.alias("end_text")))


@query("WITH " + LINES + r" SELECT doc_id, line_no::INT AS line_no, NOT regexp_matches(line, '\.{6,}') AND length(line) - length(replace(line, '|', '')) < 7 AND len(regexp_extract_all(line, '\|\s*\|')) < 2 AND regexp_matches(line, '[A-Za-z가-힣]{2,}') AS prose, length(trim(regexp_replace(line, '\s+', ' ', 'g'))) >= 4 AND regexp_matches(line, '[\pL\pN]') AS substantive FROM l")
def quotable_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(spark, sf).select("doc_id", "line_no", fn.is_prose(F.col("line")).alias("prose"), fn.is_substantive(F.col("line")).alias("substantive"))


BOXES = "bx AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 0 AS found, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_concat(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN ['red', 'red'] ELSE ['red'] END ELSE [] END, CASE WHEN o_orderkey % 3 = 0 THEN ['blue green'] ELSE [] END) END AS selected FROM orders)"


def box_cells(spark: SparkSession, sf: str) -> DataFrame:
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    red = F.when(k % 5 == 0, "□ other").when(k % 2 == 0, " ▣ red").otherwise("◯red")
    again = F.when((k % 7 == 0) & (k % 2 == 0) & (k % 5 != 0), "✓red").otherwise("none")
    blue = F.when(k % 5 == 0, "").when(k % 3 == 0, "⊠ blue  green").otherwise("▢ blue green")
    return o.select(k.alias("doc_id"), F.explode(F.array(red, again, blue)).alias("cell"))


@query(f"WITH {BOXES} SELECT doc_id, found, selected, len(selected)::INT AS n_selected FROM bx")
def checkboxes(spark: SparkSession, sf: str) -> DataFrame:
    return rules.checkboxes(box_cells(spark, sf), ["red", "blue green"])


@query(f"WITH {BOXES} SELECT doc_id, NULL::BIGINT AS ord, CASE WHEN found THEN 'major' ELSE 'info' END AS severity, 'checkbox' AS kind, array_to_string(selected, ' / ') AS quote, CASE WHEN NOT found THEN 'absent' WHEN len(selected) = 0 THEN 'none' ELSE 'several' END AS detail, NOT found AS unreviewed FROM bx WHERE NOT found OR len(selected) <> 1")
def checkbox_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.checkbox_findings(rules.checkboxes(box_cells(spark, sf), ["red", "blue green"]))


@query("WITH w(wanted) AS (VALUES ('the'), ('qu ality')), l AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS flat FROM documents) SELECT doc_id, NULL::BIGINT AS ord, 'major' AS severity, 'fixed_text' AS kind, NULL::VARCHAR AS quote, wanted AS detail, false AS unreviewed FROM l, w GROUP BY doc_id, wanted HAVING NOT bool_or(contains(flat, replace(wanted, ' ', '')))".replace("\\\\", "\\"))
def fixed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.fixed_texts(read(spark, sf, "documents").select("doc_id", "text"), ["the", "qu ality"])


@query("SELECT p_partkey, p_name AS name, CASE WHEN regexp_matches(p_name, '1$') THEN 'draft' WHEN regexp_matches(p_name, '^.*2') THEN 'second' END AS reason, CASE WHEN regexp_matches(p_name, '1$') OR regexp_matches(p_name, '^.*2') THEN 'ignored' ELSE 'kept' END AS status FROM part")
def routed_items(spark: SparkSession, sf: str) -> DataFrame:
    return rules.routed(read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), [("1$", "draft"), ("^.*2", "second")])


# --- extraction ---------------------------------------------------------------------------------------------------


@query("WITH " + SECTIONS + r", e AS (SELECT doc_id, ord, unnest(regexp_extract_all(concat_ws(chr(10), title, text), '[Tt]h[a-z]{2}')) AS id FROM sec) SELECT doc_id, id, min(ord)::BIGINT AS ord FROM e GROUP BY ALL")
def id_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.id_anchors(sections_of(spark, sf), "[Tt]h[a-z]{2}")


@query("WITH " + LINES + r", e AS (SELECT doc_id, line_no, trim(line) AS line, unnest(regexp_extract_all(line, '[Tt]hat,|[a-z]{3}ción[.]')) AS id FROM l) SELECT doc_id, line_no::INT AS line_no, line, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY line_no) AS t FROM e) WHERE t = 1")
def id_statements(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.id_statements(lines_of(spark, sf), "[Tt]hat,|[a-z]{3}ción[.]").select("doc_id", "line_no", "line", "id")


FORM = "c AS (SELECT o_orderkey AS doc_id, 1 AS table_no, r AS row_no, k AS col_no, CASE WHEN r = 1 AND k = 0 THEN 'Sta tus' WHEN r = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END WHEN k = 0 THEN 'Priority' WHEN r = 3 THEN 'Total' ELSE o_orderpriority END AS cell FROM orders, range(1, 4) t(r), range(0, 2) u(k) WHERE NOT (r = 2 AND o_orderkey % 5 = 0))"


def form_of(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    grid = o.withColumn("row_no", F.explode(F.expr("sequence(1, 3)"))).withColumn("col_no", F.explode(F.expr("sequence(0, 1)"))).where("not (row_no = 2 and o_orderkey % 5 = 0)")
    cell = F.expr("case when row_no = 1 and col_no = 0 then 'Sta tus' when row_no = 1 then case when o_orderkey % 3 = 0 then ' ' else o_orderstatus end when col_no = 0 then 'Priority' when row_no = 3 then 'Total' else o_orderpriority end")
    return grid.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("table_no"), "row_no", "col_no", cell.alias("cell"))


@query(f"""WITH {FORM}, s(field, label, place) AS (VALUES ('status', 'Status', 'right'), ('under', 'Priority', 'below'), ('none', 'Nothing', 'right')), m AS MATERIALIZED (SELECT doc_id, row_no, col_no, cell, replace(cell, ' ', '') AS flat FROM c),
h AS MATERIALIZED (SELECT doc_id, field, label, row_no + (place = 'below')::INT AS row_no, col_no + (place = 'right')::INT AS col_no FROM m JOIN s ON flat = label),
b AS (SELECT doc_id, field, label, cell, row_number() OVER (PARTITION BY doc_id, field ORDER BY trim(cell) = '', row_no, col_no) AS t FROM h JOIN m USING (doc_id, row_no, col_no))
SELECT o_orderkey AS doc_id, f.field, b.cell AS value, b.doc_id IS NOT NULL AS found, b.label AS matched_label FROM orders CROSS JOIN (SELECT field FROM s) f LEFT JOIN (SELECT * FROM b WHERE t = 1) b ON b.doc_id = o_orderkey AND b.field = f.field""")
def labelled_fields(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame([("status", "Status", "right"), ("under", "Priority", "below"), ("none", "Nothing", "right")], "field string, label string, at string")
    return extraction.labelled_fields(form_of(spark, sf), specs)


@query(f"""WITH {FORM}, o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
SELECT k AS doc_id, 'status' AS field, CASE WHEN k % 3 = 0 THEN ' ' ELSE st END AS value, true AS found, 'Status' AS matched_label, NULL::VARCHAR[] AS selected, NULL::BIGINT AS n_rows FROM o
UNION ALL SELECT k, 'digit', CASE WHEN k % 5 <> 0 THEN left(pr, 1) END, k % 5 <> 0, 'Priority', NULL, NULL FROM o
UNION ALL SELECT k, 'cell', CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'Total' ELSE pr END END, k % 3 <> 0, CASE WHEN k % 3 <> 0 THEN st END, NULL, NULL FROM o WHERE st = 'O'
UNION ALL SELECT k, 'cell', NULL, false, NULL, NULL, NULL FROM o WHERE st <> 'O'
UNION ALL SELECT k, 'tick', NULL, true, NULL, [], NULL FROM o
UNION ALL SELECT k, 'rows', NULL, true, NULL, NULL, 0 FROM o
UNION ALL SELECT k, 'foot', NULL, false, NULL, NULL, NULL FROM o""")
def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    specs = [
        {"name": "status", "labels": ["State", "Status"]},
        {"name": "digit", "labels": ["Priority"], "pattern": r"^\d"},
        {"name": "cell", "source": "table_cell", "labels": ["O"]},
        {"name": "tick", "source": "checkbox_group", "options": ["Priority", "Total"]},
        {"name": "rows", "source": "table_rows", "columns": ["Priority"], "key": "Priority"},
        {"name": "foot", "source": "footer"},
    ]
    return extraction.extract_fields(form_of(spark, sf), specs)


@query("SELECT c_custkey AS doc_id, 'name' AS field, CASE WHEN regexp_matches(c_name, '#0*([1-9][0-9]*)') THEN regexp_extract(c_name, '#0*([1-9][0-9]*)', 1) END AS value, regexp_matches(c_name, '#0*([1-9][0-9]*)') AS found FROM customer")
def captured_values(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("name").alias("field"), F.col("c_name").alias("value"), F.lit(True).alias("found"))
    return extraction.captured_fields(v, "#0*(?P<value>[1-9][0-9]*)")


ROWS = "c AS (SELECT l_orderkey AS doc_id, 1 AS table_no, 1 AS row_no, k AS col_no, ['Key', 'Qty', 'Flag'][k + 1] AS cell FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(0, 3) t(k)), i AS (SELECT l_orderkey AS doc_id, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_no, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE l_partkey::VARCHAR END AS k, l_linestatus AS q, l_returnflag AS f FROM lineitem)"


def rows_of(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    head = li.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("row_no"), F.array(F.lit("Key"), F.lit("Qty"), F.lit("Flag")).alias("cells"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    body = li.select(F.col("l_orderkey").alias("doc_id"), (n + 1).alias("row_no"), F.array(F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.col("l_partkey").cast("string")), "l_linestatus", "l_returnflag").alias("cells"))
    return head.unionByName(body).select("doc_id", F.lit(1).alias("table_no"), "row_no", F.posexplode("cells").alias("col_no", "cell"))


@query(f"WITH {ROWS} SELECT doc_id, 1 AS table_no, row_no::INT AS row_no, k AS key, f AS flag FROM i WHERE k <> ''")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = extraction.table_rows(rows_of(spark, sf), ["Key", "Flag"], "Key")
    return found.select("doc_id", "table_no", "row_no", F.element_at("cells", "Key").alias("key"), F.element_at("cells", "Flag").alias("flag"))


@query(f"WITH {ROWS} SELECT doc_id, f AS value FROM i WHERE row_no = 2 AND k <> ''")
def table_cell(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.table_cell(rows_of(spark, sf), "Flag")


@query("WITH n AS (SELECT p_partkey AS file_id, p_name || ' rev ' || (p_partkey % 4) || '.docx' AS name FROM part), s(ord, output_key, stem, revision) AS (VALUES (0, 'a', 'part', '1'), (1, 'b', 'art1', '2'), (2, 'c', 'Part 1', '3')), m AS (SELECT file_id, output_key, stem, revision, row_number() OVER (PARTITION BY file_id ORDER BY length(stem) DESC, ord) AS t FROM n JOIN s ON contains(replace(name, ' ', ''), replace(stem, ' ', ''))) SELECT n.file_id, name, output_key, stem AS form, revision AS expected, coalesce(regexp_extract(name, 'rev (\\d+)', 1) <> revision, false) AS revision_stale FROM n LEFT JOIN m ON m.file_id = n.file_id AND t = 1".replace("\\\\", "\\"))
def classified_files(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.concat("p_name", F.lit(" rev "), F.col("p_partkey") % 4, F.lit(".docx")).alias("name"))
    specs = spark.createDataFrame([(0, "a", "part", "1"), (1, "b", "art1", "2"), (2, "c", "Part 1", "3")], "ord int, output_key string, stem string, revision string")
    return extraction.classified(files, specs)


@query("SELECT p_partkey, p_name || ['_v2.docx', '_수정.pdf', '.hwpx', '_v9.md'][(p_partkey % 4 + 1)::INT] AS name, p_name || CASE WHEN p_partkey % 4 = 3 THEN '_v9' ELSE '' END AS original FROM part")
def original_names(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("_v2.docx", "_수정.pdf", ".hwpx", "_v9.md")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return extraction.originals(read(spark, sf, "part").select("p_partkey", F.concat("p_name", suffix).alias("name")))


# --- links --------------------------------------------------------------------------------------------------------

IDS = "p AS (SELECT 'C-' || c_custkey AS id, c_custkey AS ord FROM customer), c AS (SELECT DISTINCT CASE WHEN o_custkey % 4 = 0 THEN 'C-' || o_custkey || '-1' ELSE 'C-' || o_custkey END AS id, o_custkey AS ord FROM orders UNION ALL SELECT 'S-' || s_suppkey, 1000000 + s_suppkey FROM supplier)"


def ids_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf, "customer").select(F.concat(F.lit("C-"), "c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    o = read(spark, sf, "orders").select("o_custkey").distinct().select(F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("C-"), "o_custkey", F.lit("-1"))).otherwise(F.concat(F.lit("C-"), "o_custkey")).alias("id"), F.col("o_custkey").alias("ord"))
    return p, o.unionByName(read(spark, sf, "supplier").select(F.concat(F.lit("S-"), "s_suppkey").alias("id"), (F.col("s_suppkey") + 1000000).alias("ord")))


@query(f"WITH {IDS}, r AS (SELECT regexp_extract(id, '^(.*)-[^-]*$', 1) AS up, id, ord FROM c), g AS (SELECT up, list(id ORDER BY ord) AS ids FROM r WHERE up IN (SELECT id FROM p) GROUP BY ALL) SELECT p.id AS upper_id, CASE WHEN c.id IS NOT NULL THEN [c.id] ELSE coalesce(g.ids, []) END AS lower_ids, CASE WHEN c.id IS NOT NULL THEN 'linked' WHEN g.ids IS NOT NULL THEN 'rolled_up' WHEN NOT regexp_matches(p.id, '[02468]$') THEN 'out_of_scope' ELSE 'missing' END AS status, p.ord FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN g ON g.up = p.id UNION ALL SELECT NULL, [r.id], 'orphan', r.ord FROM r WHERE r.id NOT IN (SELECT id FROM p) AND r.up NOT IN (SELECT id FROM p)")
def traceability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return linking.traceability_matrix(*ids_of(spark, sf), scope="[02468]$", separator="-")


@query(f"WITH {IDS} SELECT 'parent' AS side, id, 'major' AS severity, false AS unreviewed FROM p WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT 'child', id, 'major', false FROM c WHERE id NOT IN (SELECT id FROM p)")
def traceability_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p, c = ids_of(spark, sf)
    return linking.traceability(p.select("id"), c.select("id"))


@query("WITH a AS (SELECT o_orderkey AS case_id, o_orderstatus AS st, o_orderpriority AS pr FROM orders), b AS (SELECT l_orderkey AS case_id, max(l_linestatus) AS st FROM lineitem GROUP BY ALL) SELECT case_id, 'status' AS field, a.st AS left_value, b.st AS right_value, CASE WHEN a.st IS NULL OR b.st IS NULL THEN 'unreviewed' WHEN a.st = b.st THEN 'same' ELSE 'differs' END AS verdict FROM a FULL JOIN b USING (case_id) UNION ALL SELECT case_id, 'priority', pr, NULL, 'unreviewed' FROM a FULL JOIN b USING (case_id)")
def compared_pair(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    left = o.select(F.col("o_orderkey").alias("case_id"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.lit(True).alias("found")).unionByName(o.select(F.col("o_orderkey").alias("case_id"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(True).alias("found")))
    right = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max("l_linestatus").alias("value")).select("case_id", F.lit("line status").alias("field"), "value", F.lit(True).alias("found"))
    wanted = spark.createDataFrame([("status", "line status"), ("priority", None)], "field string, right_field string")
    return linking.compared_pair(wanted, left, right)


@query("WITH v AS (SELECT l_orderkey AS case_id, 'flag' AS field, l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity::INT AS output_key, CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END AS key FROM lineitem), c AS (SELECT case_id, key, count(*) AS n FROM v WHERE key IS NOT NULL GROUP BY ALL), t AS (SELECT case_id, count(*) AS n_values, max(n) AS most, arg_max(key, n) AS mode FROM c GROUP BY ALL), e AS (SELECT case_id, count(*) AS ties FROM c JOIN t USING (case_id) WHERE n = most GROUP BY ALL) SELECT case_id, field, coalesce(list(output_key ORDER BY output_key) FILTER (key IS NOT NULL AND n_values > 1 AND (ties > 1 OR key <> mode)), []) AS wrong, count_if(key IS NULL)::BIGINT AS gaps, CASE WHEN max(coalesce(n_values, 0)) > 1 THEN 'differs' WHEN count_if(key IS NULL) > 0 THEN 'unreviewed' ELSE 'same' END AS verdict FROM v LEFT JOIN t USING (case_id) LEFT JOIN e USING (case_id) GROUP BY case_id, field")
def majority_values(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    v = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("flag").alias("field"), key.alias("output_key"), F.concat("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, " (Ver 2)").otherwise("")).alias("value"), (F.col("l_partkey") % 7 != 0).alias("found"))
    return linking.majority(v)


DATES = "v AS (SELECT o_custkey AS case_id, o_orderkey AS pos, o_orderkey::VARCHAR AS output_key, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS key FROM orders), b AS (SELECT *, lag(key) OVER (PARTITION BY case_id ORDER BY pos) AS before FROM v WHERE key IS NOT NULL)"


def dates_of(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "y. M. d."))
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("pos"), k.cast("string").alias("output_key"), value.alias("value"))


@query(f"""WITH {DATES}, w AS (SELECT case_id, list(output_key ORDER BY output_key) AS wrong FROM b WHERE key < before GROUP BY ALL)
SELECT v.case_id, coalesce(any_value(wrong), []) AS wrong, count(*) FILTER (key IS NULL) AS unread, CASE WHEN any_value(wrong) IS NOT NULL THEN 'differs' WHEN count(*) FILTER (key IS NULL) > 0 THEN 'unreviewed' ELSE 'same' END AS verdict FROM v LEFT JOIN w USING (case_id) GROUP BY v.case_id""")
def order_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return linking.order_verdicts(dates_of(spark, sf))


@query("WITH v AS (SELECT o_custkey AS case_id, o_orderkey AS pos, o_orderkey::VARCHAR AS output_key, strftime(o_orderdate, '%Y%m%d') AS key FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT *, lag(key) OVER (PARTITION BY case_id ORDER BY pos) AS before FROM v) SELECT case_id, pos, output_key, key, before FROM b WHERE key < before")
def nondecreasing_dates(spark: SparkSession, sf: str) -> DataFrame:
    return linking.nondecreasing(dates_of(spark, sf))


WORDS = LINES + r", w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]{2,}')) AS word FROM l), used AS (SELECT DISTINCT doc_id, word FROM w WHERE regexp_full_match(word, '[A-Z]{2,6}') AND line_no >= 2), hd AS (SELECT DISTINCT doc_id, word FROM w WHERE regexp_full_match(word, '[A-Z]{2,6}') AND line_no < 2), lo AS (SELECT DISTINCT doc_id, upper(word) AS word FROM w WHERE word <> upper(word))"


@query("WITH " + WORDS + ", n AS (SELECT doc_id, count(*) AS n FROM hd GROUP BY ALL) SELECT doc_id, word, 'unregistered' AS kind FROM used WHERE doc_id IN (SELECT doc_id FROM n WHERE n >= 2) AND word NOT IN ('IT') AND (doc_id, word) NOT IN (SELECT doc_id, word FROM hd) AND (doc_id, word) NOT IN (SELECT doc_id, word FROM lo) UNION ALL SELECT doc_id, word, 'unused' FROM hd WHERE word NOT IN ('IT') AND (doc_id, word) NOT IN (SELECT doc_id, word FROM used) UNION ALL SELECT doc_id, NULL, 'unreviewed' FROM n WHERE n < 2")
def abbreviation_list(spark: SparkSession, sf: str) -> DataFrame:
    w = lines_of(spark, sf).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("word"))
    short = w.where(F.col("word").rlike("^[A-Z]{2,6}$"))
    heads = short.where("line_no < 2").select("doc_id", "word").distinct()
    return linking.abbreviations(short.where("line_no >= 2"), heads, heads, ["IT"], extraction.lower_spelled(w))


@query("WITH " + SECTIONS + r", root AS (SELECT doc_id, min(sec_id) AS root FROM sec WHERE sec_id = '1' GROUP BY ALL), e AS (SELECT doc_id, sec_id AS number FROM sec JOIN root USING (doc_id) WHERE starts_with(sec_id, root || '.')), n AS (SELECT root.doc_id, count(number) AS n FROM root LEFT JOIN e ON e.doc_id = root.doc_id GROUP BY ALL), ci AS (SELECT DISTINCT doc_id, (1 + length(text) % 3) || '.' || (length(text) % 4) AS number FROM sec) SELECT doc_id, number, 'unknown' AS kind FROM ci WHERE doc_id IN (SELECT doc_id FROM n WHERE n >= 2) AND (doc_id, number) NOT IN (SELECT doc_id, number FROM e) AND (doc_id, number) NOT IN (SELECT doc_id, sec_id FROM sec) UNION ALL SELECT doc_id, number, 'unused' FROM e WHERE doc_id IN (SELECT doc_id FROM n WHERE n >= 2) AND (doc_id, number) NOT IN (SELECT doc_id, number FROM ci) UNION ALL SELECT doc_id, NULL, 'unreviewed' FROM n WHERE n < 2")
def reference_list(spark: SparkSession, sf: str) -> DataFrame:
    parts = sections_of(spark, sf)
    cited = parts.select("doc_id", F.concat_ws(".", 1 + F.char_length("text") % 3, F.char_length("text") % 4).alias("number"))
    titled = parts.withColumn("title", F.when(F.col("sec_id") == "1", "References").otherwise(F.lit("x")))
    return linking.references(titled, cited, "References")


QUOTES = "qt AS (SELECT doc_id, doc_id AS quote_id, CASE doc_id % 4 WHEN 0 THEN substring(text, 20, 30) WHEN 1 THEN 'no such words here' WHEN 2 THEN 'ab' ELSE substring(text, 1, 60) END AS quote FROM documents)"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def quotes_of(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 4
    quote = F.when(m == 0, F.substring("text", 20, 30)).when(m == 1, "no such words here").when(m == 2, "ab").otherwise(F.substring("text", 1, 60))
    return read(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("quote_id"), quote.alias("quote"))


@query("WITH " + LINES + ", " + QUOTES + f", q AS (SELECT doc_id, quote_id, {FLAT.format('quote')} AS q FROM qt WHERE length({FLAT.format('quote')}) >= 4 AND regexp_matches(quote, '[\\pL\\pN]')), a AS (SELECT q.doc_id, quote_id, min(line_no) AS line_no FROM q JOIN l USING (doc_id) WHERE contains({FLAT.format('line')}, q) GROUP BY ALL), b AS (SELECT q.doc_id, quote_id, 0 AS ord FROM q JOIN documents USING (doc_id) WHERE contains({FLAT.format('text')}, q)) SELECT q.doc_id, q.quote_id, line_no::INT AS line_no, CASE WHEN line_no IS NULL THEN ord END::BIGINT AS ord, CASE WHEN line_no IS NOT NULL THEN 'line' WHEN ord IS NOT NULL THEN 'section' ELSE 'missing' END AS place FROM q LEFT JOIN a USING (doc_id, quote_id) LEFT JOIN b USING (doc_id, quote_id)")
def verified_quotes(spark: SparkSession, sf: str) -> DataFrame:
    whole = read(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("ord"), "text")
    return linking.verified_quotes(quotes_of(spark, sf), lines_of(spark, sf), whole)


@query("WITH " + LINES + ", " + QUOTES + f", q AS (SELECT doc_id, quote_id, {FLAT.format('quote')} AS q FROM qt), x AS (SELECT *, list_distinct(list_filter(string_split(q, ' '), lambda w: length(w) >= 2)) AS words FROM q), s AS (SELECT x.doc_id, quote_id, line_no, CASE WHEN contains({FLAT.format('line')}, q) THEN len(words) + 1 ELSE len(list_filter(words, lambda w: contains({FLAT.format('line')}, w))) END AS score FROM x JOIN l USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_id ORDER BY score DESC, line_no) AS turn FROM s WHERE score > 0) SELECT doc_id, quote_id, line_no::INT AS line_no, score::INT AS score, turn::INT AS turn FROM r WHERE turn <= 5")
def closest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return linking.closest_lines(quotes_of(spark, sf), lines_of(spark, sf))


@query("WITH " + LINES + ", h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM l WHERE contains(line, 'than')) SELECT doc_id, line_no::INT AS line_no, substring(line, 1, 2000) AS line FROM h WHERE t <= 3")
def find_term(spark: SparkSession, sf: str) -> DataFrame:
    return linking.find_term(lines_of(spark, sf), "than", 3)


LINEAGE = """pr AS (SELECT p_partkey AS id, 'c' || (p_partkey % 5) AS checker, 's' || (p_partkey % 3) AS section, p_type AS message, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_name || ' of the ' || p_brand || ' series'] END AS quotes FROM part),
nw AS (SELECT p_partkey AS id, 'c' || (p_partkey % 5) AS checker, 's' || (p_partkey % 3) AS section, p_type AS message, CASE WHEN p_partkey % 4 = 0 THEN [] WHEN p_partkey % 4 = 1 THEN [p_name || ' of the ' || p_brand || ' series'] WHEN p_partkey % 4 = 2 THEN ['see ' || p_name || ' of the ' || p_brand || ' series now'] ELSE ['changed ' || p_name] END AS quotes FROM part WHERE p_partkey % 8 <> 4)"""


def lineage_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    phrase = F.concat("p_name", F.lit(" of the "), "p_brand", F.lit(" series"))
    none = F.array().cast("array<string>")
    base = [k.alias("id"), F.concat(F.lit("c"), k % 5).alias("checker"), F.concat(F.lit("s"), k % 3).alias("section"), F.col("p_type").alias("message")]
    prior = p.select(*base, F.when(k % 4 == 0, none).otherwise(F.array(phrase)).alias("quotes"))
    new = p.where(k % 8 != 4).select(*base, F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(phrase)).when(k % 4 == 2, F.array(F.concat(F.lit("see "), phrase, F.lit(" now")))).otherwise(F.array(F.concat(F.lit("changed "), "p_name"))).alias("quotes"))
    return prior, new


@query(f"""WITH {LINEAGE}, a AS (SELECT id, checker, replace(unnest(quotes), ' ', '') AS q FROM pr), b AS (SELECT id, checker, replace(unnest(quotes), ' ', '') AS q FROM nw),
x AS (SELECT a.id AS pid, b.id AS nid FROM a JOIN b ON a.checker = b.checker AND a.q = b.q),
y AS (SELECT a.id AS pid, b.id AS nid FROM a JOIN b ON a.checker = b.checker AND least(length(a.q), length(b.q)) >= 20 AND (contains(a.q, b.q) OR contains(b.q, a.q)) WHERE a.id NOT IN (SELECT pid FROM x) AND b.id NOT IN (SELECT nid FROM x)),
z AS (SELECT p.id AS pid, n.id AS nid FROM pr p JOIN nw n USING (checker, section, message) WHERE len(p.quotes) = 0 AND len(n.quotes) = 0),
m AS (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z), g AS (SELECT pid, min(nid) AS nid FROM m GROUP BY ALL)
SELECT p.id AS prior_id, nid AS new_id, CASE WHEN nid IS NOT NULL THEN 'seen' WHEN checker = 'c1' THEN 'cannot tell' ELSE 'not seen' END AS status FROM pr p LEFT JOIN g ON pid = p.id UNION ALL SELECT NULL, id, 'new' FROM nw WHERE id NOT IN (SELECT nid FROM m)""")
def matched_findings(spark: SparkSession, sf: str) -> DataFrame:
    return linking.matched_findings(*lineage_of(spark, sf), spark.createDataFrame([("c1",)], "checker string"))


@query(f"WITH {FINDINGS}, k AS (SELECT seq, CASE WHEN len(quotes) > 0 THEN concat_ws(chr(31), 'q', checker, array_to_string(list_sort(list_transform(quotes, lambda x: replace(x, ' ', ''))), chr(31))) ELSE concat_ws(chr(31), 'm', checker, section, message) END AS key, severity FROM f), p AS (SELECT seq, key, unnest(CASE WHEN starts_with(key, 'q' || chr(31)) THEN list_transform(string_split(key, chr(31))[3:], lambda x: string_split(key, chr(31))[2] || chr(31) || x) ELSE [key] END) AS share FROM k), o AS (SELECT DISTINCT share FROM p WHERE seq % 50 = 0), c AS (SELECT DISTINCT seq FROM p JOIN o USING (share)) SELECT k.seq AS id, key, CASE WHEN c.seq IS NOT NULL THEN 'not applicable' END AS verdict FROM k LEFT JOIN c USING (seq)")
def carried_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    keyed = summary.verdict_key(findings_of(spark, sf))
    old = keyed.select("key", F.when(F.col("seq") % 50 == 0, "not applicable").otherwise("agreed").alias("verdict"))
    return linking.carried_verdicts(keyed.withColumnRenamed("seq", "id"), old)


@query("SELECT n_nationkey AS name_id, n_name AS name, max(entry_id) AS entry_id FROM nation LEFT JOIN (SELECT s_suppkey AS entry_id, n.n_name || ' report ' || s_suppkey AS title FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey) ON contains(title, n_name) GROUP BY ALL")
def prior_entries(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation")
    history = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entry_id"), F.concat("n_name", F.lit(" report "), "s_suppkey").alias("title"))
    return linking.prior_entry(nation.select(F.col("n_nationkey").alias("name_id"), F.col("n_name").alias("name")), history)


@query("WITH r AS (SELECT c_custkey AS item, 'f' || (c_custkey % 20) AS field, CASE WHEN c_custkey % 3 <> 0 THEN 'v' || (c_custkey % 40) END AS given FROM customer), x AS (SELECT 'f' || s_suppkey % 20 AS field, 'v' || (s_suppkey % 20) AS value, s_suppkey % 9 <> 0 AS found FROM supplier), g AS (SELECT item, max(given) AS given, count(*) FILTER (found) AS nf, count(*) FILTER (found AND value <> given) AS nd FROM r LEFT JOIN x USING (field) GROUP BY ALL) SELECT item, CASE WHEN given IS NULL THEN 'manual' WHEN nf = 0 THEN 'unreviewed' WHEN nd > 0 THEN 'flagged' ELSE 'clean' END AS status FROM g")
def manual_review(spark: SparkSession, sf: str) -> DataFrame:
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    wanted = c.select(k.alias("item"), F.concat(F.lit("f"), k % 20).alias("field"))
    given = c.where(k % 3 != 0).select(k.alias("item"), F.concat(F.lit("v"), k % 40).alias("value"))
    s = F.col("s_suppkey")
    fields = read(spark, sf, "supplier").select(F.concat(F.lit("f"), s % 20).alias("field"), F.concat(F.lit("v"), s % 20).alias("value"), (s % 9 != 0).alias("found"))
    return linking.manual_review(wanted, given, fields)


#: All of part and events, with keys that a few findings share.
ATTRIBUTED_ALL = FINDINGS + ", cr AS (SELECT p_partkey AS no, CASE WHEN p_partkey % 2 = 0 THEN 'model' ELSE 'rule' END AS mode, 's' || p_partkey AS rule_id, 'c' || p_partkey AS checker_key FROM part), fi AS (SELECT seq AS finding_id, 's' || (seq // 3) AS rule_id, 'c' || (seq // 4) AS checker, unreviewed FROM f), att AS (SELECT no, mode, cr.rule_id, checker_key, finding_id, unreviewed FROM cr LEFT JOIN fi ON fi.rule_id = cr.rule_id WHERE mode = 'model' UNION ALL SELECT no, mode, cr.rule_id, checker_key, finding_id, unreviewed FROM cr LEFT JOIN fi ON fi.checker = cr.checker_key WHERE mode <> 'model')"


def attributed_all_of(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    criteria = read(spark, sf, "part").select(k.alias("no"), F.when(k % 2 == 0, "model").otherwise("rule").alias("mode"), F.concat(F.lit("s"), k).alias("rule_id"), F.concat(F.lit("c"), k).alias("checker_key"))
    found = findings_of(spark, sf).select(F.col("seq").alias("finding_id"), F.expr("concat('s', seq div 3)").alias("rule_id"), F.expr("concat('c', seq div 4)").alias("checker"), "unreviewed")
    return linking.attributed(criteria, found)


@query(f"WITH {ATTRIBUTED_ALL} SELECT no, mode, rule_id, checker_key, finding_id, unreviewed FROM att")
def attributed_criteria_all(spark: SparkSession, sf: str) -> DataFrame:
    return attributed_all_of(spark, sf)


@query(f"WITH {ATTRIBUTED_ALL} SELECT no, CASE WHEN count_if(finding_id IS NOT NULL AND NOT unreviewed) > 0 THEN 'flagged' WHEN count(finding_id) > 0 THEN 'unreviewed' ELSE 'clean' END AS status, count(finding_id) AS n_findings FROM att GROUP BY no")
def item_status_all(spark: SparkSession, sf: str) -> DataFrame:
    return summary.item_status(attributed_all_of(spark, sf))


@query("WITH t(team, pattern) AS (VALUES ('a', 'th[a-z]'), ('b', 'ció[a-z]'), ('c', 'AKIA[A-Z0-9]{3}')), m AS (SELECT doc_id, team, len(list_distinct(regexp_extract_all(text, pattern))) AS n_ids FROM documents, t) SELECT doc_id, team, n_ids::INT AS n_ids, max(n_ids) OVER (PARTITION BY doc_id) > 0 AND n_ids = max(n_ids) OVER (PARTITION BY doc_id) AS best FROM m")
def detected_teams(spark: SparkSession, sf: str) -> DataFrame:
    teams = spark.createDataFrame([("a", "th[a-z]"), ("b", "ció[a-z]"), ("c", "AKIA[A-Z0-9]{3}")], "team string, pattern string")
    return linking.detected(read(spark, sf, "documents").select("doc_id", "text"), teams)


# --- summaries ----------------------------------------------------------------------------------------------------


@query(f"WITH {FINDINGS} SELECT severity, count(*) AS n FROM f GROUP BY ALL")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.counts(findings_of(spark, sf))


@query(f"WITH {FINDINGS}, d AS (SELECT *, row_number() OVER (PARTITION BY checker, severity, message, doc_id ORDER BY seq) AS t FROM f) SELECT seq, severity, checker, message, doc_id, CASE severity WHEN 'major' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END AS rank FROM d WHERE t = 1")
def collected_findings(spark: SparkSession, sf: str) -> DataFrame:
    return summary.collected(findings_of(spark, sf), ["checker", "severity", "message", "doc_id"]).select("seq", "severity", "checker", "message", "doc_id", "rank")


@query(f"WITH {FINDINGS}, k AS (SELECT seq, CASE WHEN kind <> '' AND len(quotes) > 0 THEN concat_ws('~', kind, section, array_to_string(list_sort(list_transform(quotes, lambda x: replace(x, ' ', ''))), '^')) END AS key FROM f) SELECT seq, CASE WHEN key IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY key) END AS survivor FROM k")
def merged_findings(spark: SparkSession, sf: str) -> DataFrame:
    return summary.merged(findings_of(spark, sf))


@query(f"WITH {FINDINGS} SELECT seq, CASE WHEN kind = '' THEN 'rules' ELSE kind END AS label FROM f")
def stamped_findings(spark: SparkSession, sf: str) -> DataFrame:
    return summary.stamped(findings_of(spark, sf).withColumn("label", F.col("kind")), "rules").select("seq", "label")


@query("WITH a AS (SELECT o_custkey AS criterion, max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 0 THEN 3 WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS r FROM orders GROUP BY ALL) SELECT criterion, ['undetermined', 'n/a', 'pass', 'violation'][r + 1] AS verdict FROM a")
def folded_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    verdict = F.when((s == "F") & (k % 50 == 0), "violation").when(s == "O", "pass").when(s == "P", "n/a").otherwise("undetermined")
    return summary.folded_verdicts(read(spark, sf, "orders").select(F.col("o_custkey").alias("criterion"), verdict.alias("verdict"), (k % 3 == 0).alias("partial")))


@query("WITH e AS (SELECT o_custkey AS case_key, o_orderpriority AS request, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT case_key, request FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY n DESC, first) AS t FROM e) WHERE t = 1")
def case_requests(spark: SparkSession, sf: str) -> DataFrame:
    return summary.case_id(read(spark, sf, "orders").select(F.col("o_custkey").alias("case_key"), F.col("o_orderpriority").alias("request"), F.col("o_orderkey").alias("pos")))


@query("SELECT o_orderpriority AS priority, count_if(o_orderstatus = 'O') AS n_O, count_if(o_orderstatus = 'F') AS n_F, count_if(o_orderstatus = 'P') AS n_P, count(*) AS total FROM orders GROUP BY ALL")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return summary.status_summary(o, ["O", "F", "P"], "priority")


@query("SELECT l_suppkey AS doc_id, l_quantity AS size, sum(l_partkey)::BIGINT AS chars FROM lineitem GROUP BY ALL")
def characters_per_size(spark: SparkSession, sf: str) -> DataFrame:
    return summary.size_totals(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("size"), F.col("l_partkey").alias("chars")))


@query("WITH a AS (SELECT 0 AS layer_no, 'common' AS layer, (p_partkey % 30)::VARCHAR AS no, ' ' || p_type AS text, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, 'team', (p_partkey % 30)::VARCHAR, p_type || ' ' || p_brand, p_partkey FROM part WHERE p_partkey % 3 = 0), d AS (SELECT *, trim(text) AS t, row_number() OVER (PARTITION BY trim(text) ORDER BY layer_no, pos) AS k FROM a), s AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY layer_no, pos) AS same FROM d WHERE k = 1) SELECT layer_no, pos, layer, CASE WHEN same > 1 THEN no || '-' || layer ELSE no END AS no, t AS text FROM s")
def resolved_criteria(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    no = (k % 30).cast("string").alias("no")
    a = p.where(k % 2 == 0).select(F.lit(0).alias("layer_no"), F.lit("common").alias("layer"), no, F.concat(F.lit(" "), "p_type").alias("text"), k.alias("pos"))
    b = p.where(k % 3 == 0).select(F.lit(1).alias("layer_no"), F.lit("team").alias("layer"), no, F.concat_ws(" ", "p_type", "p_brand").alias("text"), k.alias("pos"))
    return summary.resolved_criteria(a.unionByName(b))


@query("WITH e AS (SELECT p_partkey AS pos, unnest(['brand', 'type', 'other']) AS key, unnest([CASE WHEN p_partkey < 5 THEN ' ' ELSE p_brand END, p_type, 'x']) AS value FROM part) SELECT key, arg_min(value, pos) AS value FROM e WHERE key IN ('brand', 'type') AND trim(value) <> '' GROUP BY ALL")
def applied_params(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    params = F.create_map(F.lit("brand"), F.when(k < 5, " ").otherwise(F.col("p_brand")), F.lit("type"), F.col("p_type"), F.lit("other"), F.lit("x"))
    return summary.applied_params(read(spark, sf, "part").select(k.alias("pos"), params.alias("params")), ["brand", "type"])


@query("SELECT c_nationkey, c_custkey, c_acctbal, t::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS t FROM customer) WHERE t <= 3")
def top_three(spark: SparkSession, sf: str) -> DataFrame:
    return summary.capped(read(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "turn")


@query("SELECT user_id AS run_id, event_type AS lane, arg_max(event_id % 17, event_id) AS i, arg_max(17, event_id)::BIGINT AS total FROM events GROUP BY ALL")
def progress_state(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return summary.progress(read(spark, sf, "events").select(F.col("user_id").alias("run_id"), i.alias("seq"), F.col("event_type").alias("lane"), (i % 17).alias("i"), F.lit(17).cast("long").alias("total")))


@query("SELECT p_partkey AS pos, p_brand AS no, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN 'not judged' WHEN p_partkey % 2 = 0 THEN 'clean' ELSE 'flagged' END AS status FROM part")
def checklist_export(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    results = p.where(k % 3 != 0).select(k.alias("pos"), F.when(k % 2 == 0, "clean").otherwise("flagged").alias("status"))
    return summary.checklist_export(p.select(k.alias("pos"), F.col("p_brand").alias("no"), F.col("p_name").alias("text")), results)


@query("SELECT event_id AS entry_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def newest_entries(spark: SparkSession, sf: str) -> DataFrame:
    return summary.newest(read(spark, sf, "events").select(F.col("event_id").alias("entry_id"), "event_type"), 200)


@query(f"""WITH {FINDINGS} SELECT doc_id, '{{"counts":{{"major":' || count_if(severity = 'major') || ',"minor":' || count_if(severity = 'minor') || ',"info":' || count_if(severity = 'info') || '}},"findings":[' || string_agg('{{"severity":"' || severity || '","message":"' || message || '"}}', ',' ORDER BY CASE severity WHEN 'major' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END, seq) || ']}}' AS report FROM f GROUP BY doc_id""")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    return summary.report_json(findings_of(spark, sf))


@query(r"SELECT DISTINCT (p_size % 4) || '.' || (p_size % 13) AS number, [p_size % 4, p_size % 13]::BIGINT[] AS version, CASE WHEN contains(p_brand, '#') THEN regexp_replace(p_brand, '#[^#]*$', '') END AS parent FROM part")
def number_keys(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat_ws(".", F.col("p_size") % 4, F.col("p_size") % 13)
    return read(spark, sf, "part").select(number.alias("number"), fn.version_order(number).alias("version"), fn.rollup_parent(F.col("p_brand"), "#").alias("parent")).distinct()


@query("WITH " + LINES + r" SELECT doc_id, line_no::INT AS line_no, CASE WHEN length(line) > 24 THEN substring(line, 1, 23) || '…' ELSE line END AS clipped, regexp_matches(line, '\pL') AND NOT regexp_matches(line, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') AS capitals, regexp_replace(line, '\s+', '', 'g') AS squashed FROM l")
def text_functions_all(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return lines_of(spark, sf).select("doc_id", F.col("line_no").cast("int").alias("line_no"), fn.clip(line, 24).alias("clipped"), fn.all_caps(line).alias("capitals"), fn.squash(line).alias("squashed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"id\": ' || event_id || ', \"kind\": \"' || event_type || '\"}' END AS answer FROM events")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "id": '), i, F.lit("}"))
    answer = F.when(i % 3 == 0, F.concat(F.lit("<think>{}</think> so: "), body, F.lit(" as asked, "), body)).when(i % 3 == 1, F.concat(F.lit("no { object"), i)).otherwise(F.concat(body, F.lit(' or {"id": -1}')))
    found = fn.json_object({"id"})(fn.without_reasoning(answer))
    return read(spark, sf, "events").select("event_id", found.alias("answer"))


@query(f"""WITH {FINDINGS} SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || 'major ' || count_if(severity = 'major') || ', minor ' || count_if(severity = 'minor') || ', info ' || count_if(severity = 'info') || chr(10) || chr(10)
|| string_agg('- **[' || severity || ']** ' || message, chr(10) ORDER BY CASE severity WHEN 'major' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END, seq) || chr(10) AS report FROM f GROUP BY doc_id""")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    return summary.report_markdown(findings_of(spark, sf))


RTM = """r AS (SELECT o_custkey % 10 AS run_id, o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 4 THEN 'U-' || o_orderkey END AS upper_id, CASE o_orderkey % 5 WHEN 0 THEN ['L-' || o_orderkey, 'M-' || o_orderkey] WHEN 3 THEN ['L-' || o_orderkey, 'M-' || o_orderkey] WHEN 4 THEN ['L-' || o_orderkey] ELSE [] END AS lower_ids,
 ['linked', 'missing', 'out_of_scope', 'rolled_up', 'orphan'][(o_orderkey % 5 + 1)::INT] AS status, ['✅ 연결됨', '❌ 누락', '➖ 범위 밖', '🔗 부모 수준 검증', '⚠️ 근거없음'][(o_orderkey % 5 + 1)::INT] AS label FROM orders)"""


@query(f"""WITH {RTM}, n AS (SELECT run_id, count(*) AS total, count_if(status = 'linked') AS a, count_if(status = 'missing') AS b, count_if(status = 'orphan') AS c, count_if(status = 'out_of_scope') AS d, count_if(status = 'rolled_up') AS e,
 string_agg('| ' || coalesce(upper_id, '—') || ' | ' || CASE WHEN len(lower_ids) > 0 THEN array_to_string(lower_ids, ', ') ELSE '(없음)' END || ' | ' || label || ' |', chr(10) ORDER BY ord) AS body,
 string_agg('{{"upper_id":' || coalesce('"' || upper_id || '"', 'null') || ',"lower_ids":[' || array_to_string(list_transform(lower_ids, lambda x: '"' || x || '"'), ',') || '],"status":"' || status || '"}}', ',' ORDER BY ord) AS items FROM r GROUP BY run_id)
SELECT run_id, 'total ' || total || ', linked ' || a || ', missing ' || b || ', orphan ' || c || ', out_of_scope ' || d || ', rolled_up ' || e || chr(10) || chr(10) || '| 상위 ID | 하위 연결 | 상태 |' || chr(10) || '|---|---|---|' || chr(10) || body || chr(10) AS markdown,
 '{{"summary":{{"total":' || total || ',"linked":' || a || ',"missing":' || b || ',"orphan":' || c || ',"out_of_scope":' || d || ',"rolled_up":' || e || '}},"rtm":[' || items || ']}}' AS json FROM n""")
def matrix_reports(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 5
    low, mid = F.concat(F.lit("L-"), k), F.concat(F.lit("M-"), k)
    lower = F.when(n.isin(0, 3), F.array(low, mid)).when(n == 4, F.array(low)).otherwise(F.array().cast("array<string>"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("linked", "missing", "out_of_scope", "rolled_up", "orphan")]), (n + 1).cast("int"))
    rtm = read(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("run_id"), k.alias("ord"), F.when(n != 4, F.concat(F.lit("U-"), k)).alias("upper_id"), lower.alias("lower_ids"), status.alias("status"))
    return summary.matrix_reports(rtm)


@query("SELECT p_size AS doc_id, 1 AS table_no, p_partkey AS row_no, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS no, p_name AS text, p_type AS \"group\", p_partkey::VARCHAR AS note FROM part WHERE p_partkey % 4 <> 0")
def checklist_items(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    text, no = F.when(k % 4 == 0, " ").otherwise(F.col("p_name")), F.when(k % 3 != 0, F.concat(F.lit(" "), "p_brand"))
    odd = F.col("p_size") % 2 == 1
    body = p.select(F.col("p_size").alias("doc_id"), k.alias("row_no"), F.when(odd, F.array(text, k.cast("string"), no, F.col("p_type"))).otherwise(F.array(no, text, F.col("p_type"), k.cast("string"))).alias("cells"))
    sizes = p.select("p_size").distinct()
    title = sizes.select(F.col("p_size").alias("doc_id"), F.lit(-2).cast("long").alias("row_no"), F.array(F.lit("Review"), F.lit(None)).alias("cells"))
    odd_head, head = (F.array(*[F.lit(x) for x in names]) for names in (("Item", "Remark", "No.", "구분"), ("번호", "항목 내용", "characteristic", "Remark")))
    heads = sizes.select(F.col("p_size").alias("doc_id"), F.lit(-1).cast("long").alias("row_no"), F.when(odd, odd_head).otherwise(head).alias("cells"))
    rows = body.unionByName(title).unionByName(heads).withColumn("table_no", F.lit(1))
    return extraction.checklist_items(rows)


@query("""WITH a AS (SELECT n_name AS field, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS outputs FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS field, list(DISTINCT r_name ORDER BY r_name) AS rules FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT field, coalesce(outputs, []) AS outputs, coalesce(rules, []) AS rules FROM a FULL JOIN b USING (field)""")
def fields_by_name_all(spark: SparkSession, sf: str) -> DataFrame:
    nation, regional = read(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")
    a = nation.join(read(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("field"), F.col("c_mktsegment").alias("output_key"))
    b = nation.join(read(spark, sf, "region"), regional).select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("field"), F.col("r_name").alias("rule"))
    return linking.fields_by_name(a, b)


@query("""SELECT p_size AS doc_id, p_partkey AS table_no, (p_partkey % 4) || '.' || p_size || ' ' || trim(p_name) AS heading, 2 AS level
FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 AND regexp_matches(trim(p_name), '^\\p{L}') AND length(trim(p_name)) <= 80""")
def lifted_headings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    number = F.when(k % 4 == 3, k.cast("string")).otherwise(F.concat(k % 4, F.lit("."), "p_size"))
    row = F.array(F.lit(" "), number, F.lit(None), F.col("p_name"), F.when(k % 5 == 0, F.col("p_brand")))
    rows = read(spark, sf, "part").select(F.col("p_size").alias("doc_id"), k.alias("table_no"), F.explode(F.array(F.struct(F.lit(2).alias("row_no"), row.alias("cells")), F.struct(F.lit(3).alias("row_no"), F.array(F.lit("9.9"), F.lit("Later")).alias("cells")))).alias("r"))
    return structure.lifted_headings(rows.select("doc_id", "table_no", "r.row_no", F.posexplode("r.cells").alias("col_no", "cell")))


@query(r"""WITH """ + LINES + r""", c AS (SELECT DISTINCT doc_id, trim(regexp_replace(unnest(string_split(line, ' | ')), '\s+', ' ', 'g')) AS flat FROM l WHERE contains(line, ' | '))
SELECT doc_id, 1 AS page, line FROM l WHERE NOT EXISTS (FROM c WHERE c.doc_id = l.doc_id AND flat <> '' AND flat = trim(regexp_replace(l.line, '\s+', ' ', 'g')))""")
def lines_without_cells(spark: SparkSession, sf: str) -> DataFrame:
    lines = lines_of(spark, sf).select("doc_id", F.lit(1).alias("page"), "line")
    cells = lines.where(F.col("line").contains(" | ")).select("doc_id", "page", F.explode(F.split("line", r" \| ")).alias("cell"))
    return structure.without_cell_lines(lines, cells)


@query(f"WITH {FINDINGS} SELECT seq, severity, section, unreviewed FROM f WHERE CASE WHEN unreviewed THEN true ELSE severity IN ('major', 'info') END AND checker IN ('c1', 'c2')")
def shown_findings(spark: SparkSession, sf: str) -> DataFrame:
    return summary.shown(findings_of(spark, sf), ["major", "info"], True, F.col("checker").isin("c1", "c2"), "section").select("seq", "severity", "section", "unreviewed")


@query("""WITH i AS (SELECT l_orderkey % 500 AS finding_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 1 THEN l_linenumber || '' ELSE l_linestatus END AS label, CASE WHEN l_linenumber = 2 THEN '' ELSE l_returnflag END AS layer FROM lineitem WHERE l_linenumber <> 4)
SELECT finding_id, list(label ORDER BY pos, label, layer) AS labels, list(layer ORDER BY pos, label, layer) AS layers FROM i GROUP BY ALL""")
def criteria_of_findings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    named = F.when(n != 4, F.array(F.col("l_orderkey") % 500))
    text = F.when(n == 1, "").otherwise(F.col("l_linestatus"))
    items = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("pos"), n.cast("string").alias("no"), text.alias("text"), F.when(n != 2, F.col("l_returnflag")).alias("layer"), named.alias("findings"))
    return summary.criteria_of(items)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['a-b', o_orderpriority] ELSE ['a-b', o_orderpriority, o_orderstatus] END AS sides FROM orders")
def document_sides(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    both = F.concat(F.lit("a-b ↔ "), "o_orderpriority")
    label = F.when(n == 1, both).when(n == 2, F.concat(both, F.lit(" ·  · "), "o_orderstatus"))
    return read(spark, sf, "orders").select("o_orderkey", summary.document_sides(label).alias("sides"))


@query("""WITH s AS (SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS sections FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos::INT AS pos, ['ingestion', 'normalize', 'chunking', 'review', 'report'][pos + 1] AS key,
 [format('{:,}', chars) || ' chars', sections || ' sections', '3 chunks', 'completeness · consistency', '0 findings'][pos + 1] AS detail FROM s, range(5) r(pos)""")
def review_stages(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return summary.stages(d.select("doc_id", F.char_length("text").alias("chars"), F.size(F.split("text", "\n")).alias("sections"), F.lit(3).alias("chunks"), F.lit(0).alias("findings")))


@query("""WITH f AS (SELECT event_id % 30 AS case_id, event_id % 7 AS k, event_id % 4 = 0 AS u FROM events)
SELECT case_id, count_if(k = 0) AS outputs, count_if(k = 1) AS missing, count_if(k = 2 AND NOT u) AS findings, count_if(k = 2 AND u) AS unreviewed, count_if(k = 3) AS unclassified, count_if(k = 4) AS ignored, count_if(k = 5 AND NOT u) AS wide_checked, count_if(k = 5) AS wide_total, count_if(k = 6) AS manual FROM f GROUP BY ALL""")
def case_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("output", "missing", "finding", "unclassified", "ignored", "wide", "manual")]), (i % 7 + 1).cast("int"))
    return summary.case_stats(read(spark, sf, "events").select((i % 30).alias("case_id"), kind.alias("kind"), F.when(i % 4 == 0, F.lit(True)).alias("unreviewed")))
