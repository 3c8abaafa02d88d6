"""Removal of lines that are similar to an earlier line, by an exact set-similarity join in DataFrame functions only.

A line is the set of its words. Words are put in order of rarity by a table of merged counts; sets of a Jaccard
similarity of at least t share a word among their first n - ceil(t n) + 1. Postings of those words are joined on the
word, under the length filter, the positional filter and a bound on the symmetric difference by parity sketches.

One earlier line is enough to remove a line, so not all pairs are made. Where a word would make too many, as in large
groups of near copies, each of its postings first meets only the earliest one of about its length, then some of the
next earliest; what finds a similar set there asks no more. Candidates are verified on their words, the closest of each
set first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import exchange, scratch

MOST_BITS = 25  # cells of the table of counts, as a power of two, one byte each: 32 MB at most
COMMON = 8  # level from which a word may be dense: more than 128 words fall into its cell
DENSE = 128  # a word is dense if more sets of about one size have it in their prefixes
PIVOTS = (1, 8, 16)  # how many of the earliest postings of its word a posting of a dense word meets in each round, others each time
MOST_BROADCAST = 10_000  # pairs, or dense words, that are sent to every executor; more are joined by a shuffle
MOST_PIVOTS = 100_000  # postings of one round that are sent to every executor, some 60 bytes each
SHORT = 40  # sets of at most so many words have 64 bits of parity sketch, others 128
SPACE = r"[\x20\x09-\x0D]+"


def cell(word: str, bits: int) -> str:
    """SQL of a word's cell in the table of counts."""
    return f"hash({word}) & {(1 << bits) - 1}"


def lines_with_words(table: DataFrame, *columns: str) -> DataFrame:
    """``columns``, line and words (with repeats) of each line that has any."""
    lines = table.select(*columns, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    lines = lines.select(*columns, "line", F.btrim("said", F.lit(" \t\n\x0b\x0c\r")).alias("said")).where("said <> ''")
    odd = F.lit(False)  # a split at one space needs no regular expression
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains("said", F.lit(x))
    return lines.select(*columns, "line", F.when(odd, F.split("said", SPACE)).otherwise(F.split("said", " ")).alias("words"))


def levels(texts: DataFrame, bits: int) -> DataFrame:
    """One row, ``levels``: of each of 2**bits cells the level of its count of words.

    Level 0 is a word that occurs once; up to 128 a level is a power of two, beyond that a power of four.
    """
    words = texts.select(F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    counts = words.selectExpr(f"{cell('word', bits)} AS cell").groupBy("cell").agg(F.count("*").alias("n"))
    level = "CASE WHEN n <= 128 THEN ceil(log2(n)) ELSE least(15, ceil(log2(n) / 2) + 4) END"
    packed = counts.selectExpr("CAST(shiftright(cell, 4) AS bigint) AS at", f"shiftleft(CAST({level} AS bigint), 4 * (cell & 15)) AS bits")
    none = texts.sparkSession.range(1 << (bits - 4)).selectExpr("id AS at", "0L AS bits")  # so that no cell is missing
    longs = packed.unionByName(none).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    parts = longs.groupBy(F.shiftright("at", 10).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"].alias("longs"))
    cells = "flatten(transform(longs, x -> transform(sequence(0, 15), k -> CAST(shiftright(x, 4 * k) & 15 AS tinyint)))) AS cells"
    return parts.selectExpr("part", cells).agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "cells")))["cells"]).alias("levels"))


def line_sets(table: DataFrame, levels: DataFrame, bits: int, percent: int) -> DataFrame:
    """The set of each line with words: doc_id, key, line, sid (128-bit hash of its words), n, parity sketch, prefix.

    ``prefix`` has tokens in order of rarity, four bits of level and 59 of hash, without those of words that occur once;
    ``skip`` of these come before them. Sets to which none of another size can be similar have an empty prefix. The
    lambdas over words are what this costs, so there are few; all else is compiled.
    """
    rows = lines_with_words(table, "doc_id", "key").select("*", levels.scalar().alias("levels"))
    token = f"shiftleft(CAST(coalesce(levels[{cell('w', bits)}], 0Y) AS bigint), 59) | (xxhash64(w) & {(1 << 59) - 1})"
    sets = rows.selectExpr("doc_id", "key", "line", f"sort_array(array_distinct(transform(words, w -> {token}))) AS tokens")
    size = f"CASE WHEN 100 * n >= {percent} * (n + 1) THEN n - ({percent} * n + 99) div 100 + 1 ELSE 0 END"
    both = "aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, CAST(t & 63 AS int)))"
    high = "aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(shiftright(t, 6) & 1, CAST(t & 63 AS int)))"
    sets = sets.selectExpr(
        "doc_id", "key", "line", "size(tokens) AS n", "struct(xxhash64(tokens) AS a, xxhash64(1, tokens) AS b) AS sid",
        f"{both} AS both", f"CASE WHEN size(tokens) > {SHORT} THEN {high} ELSE 0L END AS high", "tokens",
    )
    sets = sets.selectExpr("doc_id", "key", "line", "sid", "n", "both", "high", f"slice(tokens, 1, CAST({size} AS int)) AS every")
    sets = sets.selectExpr("doc_id", "key", "line", "sid", "n", "both ^ high AS low", "high", "every", f"filter(every, t -> t >= {1 << 59}) AS prefix")
    return sets.selectExpr("doc_id", "key", "line", "sid", "n", "low", "high", "prefix", "size(every) - size(prefix) AS skip")


def overlap(a: str, b: str, percent: int) -> str:
    """SQL of the least overlap at which sets of a and b are similar."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


# of words in one set only, at least so many; the sketch of a longer set is folded where it meets that of a short one
DIFFER = f"if(a.n > {SHORT} AND b.n > {SHORT}, bit_count(a.low ^ b.low) + bit_count(a.high ^ b.high), bit_count(a.low ^ a.high ^ b.low ^ b.high))"


def near(percent: int) -> str:
    """SQL of the filters on postings a and b of one word: lengths, positions of the first word they share, sketches."""
    least = overlap("a.n", "b.n", percent)
    return f"""100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        AND {DIFFER} <= a.n + b.n - 2 * {least}
        AND least(a.n - a.i, b.n - b.i) >= {least}"""


def postings(sets: DataFrame, *more: str) -> DataFrame:
    """token, id, n, i, low, high, and more if asked, of each word in a prefix."""
    rows = sets.select("id", "n", "low", "high", "skip", "place", F.posexplode("prefix").alias("at", "token"))
    return rows.selectExpr("token", "id", "n", "skip + at AS i", "low", "high", *more)


def dense_words(sets: DataFrame, band: str) -> DataFrame:
    """token of each word that more than DENSE sets of one band of sizes have in their prefixes."""
    rows = sets.select("n", F.explode("prefix").alias("token")).where(f"token >= {COMMON << 59}")
    return rows.groupBy("token", F.expr(band)).agg(F.count("*").alias("rows")).where(f"rows > {DENSE}").select("token").distinct()


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of postings of one word that pass the filters."""
    both = rows.alias("a").join(rows.alias("b"), F.expr(f"a.token = b.token AND a.id < b.id AND {near(percent)}"))
    return both.selectExpr("a.id AS a", "b.id AS b", f"{DIFFER} AS differ")


def earliest(every: DataFrame, first: int, last: int) -> DataFrame:
    """The first-th to last-th earliest postings of each word and band."""
    rank = F.row_number().over(Window.partitionBy("token", "band").orderBy("place"))
    return every.withColumn("rank", rank).where(f"rank <= {last}").where(f"rank >= {first}").drop("rank", "place")


def pivot_pairs(open_: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs of each open posting of a dense word with the pivots of its word and band that pass the filters."""
    both = open_.alias("a").join(pivots.alias("b"), F.expr(f"a.token = b.token AND a.band = b.band AND a.id <> b.id AND {near(percent)}"))
    return both.selectExpr("a.id AS a", "b.id AS b", f"{DIFFER} AS differ")


def earlier_pairs(open_: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Pairs of open postings of dense words with all earlier ones that pass the filters."""
    asking = open_.withColumn("band", F.expr("explode(array(band - 1, band, band + 1))"))
    both = asking.alias("a").join(every.alias("b"), F.expr(f"a.token = b.token AND a.band = b.band AND b.place < a.place AND {near(percent)}"))
    return both.selectExpr("a.id AS a", "b.id AS b", f"{DIFFER} AS differ")


def lines_of(table: DataFrame) -> DataFrame:
    """``table`` with the lines of its text; made by a generator, so that no lambda splits the text again for each line."""
    return table.select("*", F.explode(F.array(F.split("text", "\n"))).alias("lines"))


def beside(table: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``table`` joined with ``rows`` of its keys (chunk, key and more) where the texts lie: only ``rows`` are shuffled.

    The chunk alone is the key of the join, as it is that of the buckets; within a chunk keys are compared one by one.
    """
    rows = rows.withColumnsRenamed({"chunk": "of_chunk", "key": "of_key"})
    return table.join(rows, F.expr("chunk = of_chunk AND key - of_key = 0"), how).drop("of_chunk", "of_key")


def later_ones(spark: SparkSession, table: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """id of each set of ``pairs`` (a, b, differ), but those of ``known``, that is similar to an earlier one that it is paired with."""
    pairs = scratch.written(spark, pairs.distinct(), "line-pairs")
    count = pairs.count()
    if not count:
        return pairs.selectExpr("a AS id")
    sent = F.broadcast if count <= MOST_BROADCAST else lambda frame: frame
    a, b = (sets.selectExpr(f"id AS {x}", f"struct(id, n, place) AS set_{x}") for x in "ab")
    met = sent(sent(pairs).join(a, "a")).join(b, "b")
    before = "set_b.place < set_a.place"
    close = met.selectExpr(f"if({before}, set_a, set_b) AS late", f"if({before}, set_b, set_a) AS early", "differ")
    close = close.selectExpr("late.id AS later", "early.id AS earlier", "differ", "late", "early")
    close = close if known is None else close.join(known.withColumnRenamed("id", "later"), "later", "left_anti")
    close = scratch.written(spark, close.dropDuplicates(["later", "earlier"]), "line-candidates")

    asked = close.select("late.*").union(close.select("early.*")).distinct()
    of_text = asked.groupBy("place.key").agg(F.collect_list(F.struct("id", "n", "place.line")).alias("asked"))  # of one document
    of_text = of_text.withColumn("chunk", F.shiftright("key", exchange.CHUNK_ROWS))
    words = "array_remove(array_distinct(split(lines[x.line], '[\\\\x20\\\\x09-\\\\x0D]+')), '')"
    found = lines_of(beside(table.select("chunk", "key", "text"), sent(of_text), "inner"))
    found = scratch.written(spark, found.selectExpr(f"inline(transform(asked, x -> struct(x.id, x.n, {words} AS words)))"), "line-words")

    def similar(candidates: DataFrame) -> DataFrame:
        x, y = (found.selectExpr(f"id AS {c}", f"n AS n_{c}", f"words AS words_{c}") for c in ("later", "earlier"))
        met = candidates.join(y, "earlier").join(x, "later")
        least = overlap("n_later", "n_earlier", percent)
        return met.where(f"size(array_intersect(words_later, words_earlier)) >= {least}").selectExpr("later AS id").distinct()

    best = close.groupBy("later").agg(F.expr("min(struct(differ, earlier)).earlier AS earlier"))
    first = scratch.written(spark, similar(best), "line-later")
    rest = close.join(first.selectExpr("id AS later"), "later", "left_anti").join(best, ["later", "earlier"], "left_anti").select("later", "earlier")
    both = scratch.written(spark, first.unionByName(similar(rest)), "line-later")
    for x in (pairs, close, found, first):
        scratch.forget(spark, x)
    return both


def similar_to_earlier(spark: SparkSession, table: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id of each set that is similar to an earlier one."""
    band = f"CAST(floor(ln(n) / {math.log(100 / min(percent, 99))} + 1e-9) AS int) AS band"  # of similar sets at most one apart
    dense = scratch.written(spark, dense_words(sets, band), "dense-words")
    words = dense.count()
    if not words:
        return later_ones(spark, table, sets, all_pairs(postings(sets), percent), percent)
    sent = F.broadcast(dense) if words <= MOST_BROADCAST else dense
    every = scratch.written(spark, postings(sets, "place", band).join(sent, "token"), "dense-postings")
    # words and bands of no more postings need no pivots: all of them may meet
    sizes = scratch.written(spark, every.groupBy("token", "band").agg(F.count("*").alias("every")).where(f"every > {DENSE}"), "dense-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    open_, later = every, spark.createDataFrame([], "id long")
    for i, n in enumerate(PIVOTS):
        asking = open_.groupBy("token", "band").agg(F.count("*").alias("open"))
        pairs, rows = asking.join(sizes, ["token", "band"]).agg(F.expr("sum(every * open)"), F.sum("open")).head()
        if not rows or pairs <= DENSE * rows:
            break
        first = sum(PIVOTS[:i]) + 1
        crowded = every.join(sizes, ["token", "band"], "left_semi")
        pivots = scratch.written(spark, earliest(crowded, first, first + n - 1), "pivots")
        few = pivots.count() <= MOST_PIVOTS
        found = later_ones(spark, table, sets, pivot_pairs(open_, F.broadcast(pivots) if few else pivots, percent), percent)
        scratch.forget(spark, pivots)
        if found.isEmpty():
            continue
        later = scratch.written(spark, later.unionByName(found), "line-later")
        open_ = every.join(later, "id", "left_anti")
    rest = all_pairs(postings(sets).join(sent, "token", "left_anti"), percent)
    return later.unionByName(later_ones(spark, table, sets, rest.unionByName(earlier_pairs(open_, every, percent)), percent, later)).distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame, *, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with those lines removed that are similar to an earlier one, and n_lines and n_removed.

    Lines are what lies between "\\n"; two are similar if the Jaccard similarity of their sets of words is at least
    ``percent`` %. Earlier is by id, null first, then by input order, then by line; lines are judged on the input, not on
    what is left. Lines without words are kept. A null text stays null, with no lines; an empty one has one line. Of rows
    that repeat only the first keeps its lines. Columns named n_lines or n_removed are replaced; other columns stay; an
    empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    table = exchange.keyed(spark, docs, id_column, text_column, whole_rows=True, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    bytes_in = table.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(MOST_BITS, max(14, (bytes_in // 100).bit_length()))
    counted = scratch.written(spark, levels(table, bits), "line-levels")
    lines = scratch.written(spark, line_sets(table, counted, bits, percent), "line-sets")
    distinct = lines.groupBy("sid").agg(F.expr("min(struct(doc_id, key, line)) AS place"), *[F.first(c).alias(c) for c in ("n", "low", "high", "skip", "prefix")])
    sets = scratch.written(spark, distinct.withColumn("id", F.monotonically_increasing_id()), "line-distinct")
    of_lines = scratch.written(spark, lines.select("key", "line", "sid"), "lines")
    scratch.forget(spark, lines)

    later = similar_to_earlier(spark, table, sets, percent).withColumn("later", F.lit(True))
    judged = sets.select("id", "sid", "place").join(later, "id", "left").selectExpr("sid", "place.key AS first_key", "place.line AS first_line", "later")
    gone = of_lines.join(judged, "sid").where("later OR key <> first_key OR line <> first_line")
    gone = gone.groupBy("key").agg(F.collect_list("line").alias("gone")).withColumn("chunk", F.shiftright("key", exchange.CHUNK_ROWS))
    gone = scratch.written(spark, gone, "lines-gone")
    for x in (sets, of_lines):
        scratch.forget(spark, x)
    kept = "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')"
    done = lines_of(beside(table, gone, "left")).selectExpr("row", f"CASE WHEN gone IS NULL THEN text ELSE {kept} END AS text", "CAST(coalesce(size(lines), 0) AS bigint) AS n_lines", "CAST(coalesce(size(gone), 0) AS bigint) AS n_removed")
    return done.select(*[F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns], "n_lines", "n_removed")


def op1_line_similarity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=80)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH whole AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, file_row) AS k, doc_id, text FROM (SELECT doc_id, text, row_number() OVER () AS file_row FROM documents)),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM whole WHERE text IS NOT NULL),
words AS MATERIALIZED (SELECT k, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM line),
sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min((k, i))) AS id, words, len(words) AS n FROM words WHERE len(words) > 0 GROUP BY words),
token AS MATERIALIZED (SELECT id, n, unnest(words) AS t FROM sets),
ranked AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY often, t) AS i FROM token JOIN (SELECT t, count(*) AS often FROM token GROUP BY t) USING (t)),
prefix AS MATERIALIZED (SELECT id, n, t FROM ranked WHERE i <= n - (80 * n + 99) // 100 + 1),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b USING (t) WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT b, p.n + q.n AS total, len(list_intersect(p.words, q.words)) AS c FROM pair JOIN sets p ON p.id = a JOIN sets q ON q.id = b),
later AS (SELECT DISTINCT b AS id FROM shared WHERE 100 * c >= 80 * (total - c)),
judged AS (SELECT w.k, w.i, w.line, len(w.words) > 0 AND (l.id IS NOT NULL OR row_number() OVER (PARTITION BY w.words ORDER BY w.k, w.i) > 1) AS gone FROM words w LEFT JOIN sets s ON s.words = w.words LEFT JOIN later l ON l.id = s.id),
kept AS (SELECT k, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY k)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN whole.text IS NOT NULL THEN sha256(kept.text) END AS kept_sha256 FROM whole LEFT JOIN kept USING (k)
"""
