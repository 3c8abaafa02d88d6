"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units become typed placeholders. Windows of the benchmark's templates are hash-joined with those
windows of the documents that hold a window's rarest word at its place. Of one alignment those windows count whose
placeholders' values agree: each benchmark value has one value in the document, and no two share one. So a question is
found again with other numbers or names in it, but not a text that merely has numbers in the same places. Windows with
the same raw words always agree, so that one changed value doesn't hide what is copied before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import scratch

NUMBER, UNIT, NAME = "⟨n⟩", "⟨u⟩", "⟨p⟩"
#: Words for units, after a number.
UNITS = "mm|cm|m|km|inch|inches|in|ft|feet|foot|yards?|miles?|mg|g|kg|lbs?|pounds?|ounces?|oz|tons?|ml|l|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|%|dollars?|euros?|cents?|kmh|km/h|mph|degrees?|volts?|watts?|amps?|joules?|hz|kb|mb|gb|tb"
_SPACE = " \t\n\x0b\x0c\r"
MOST_WINDOWS = 200_000  # more benchmark windows than these are joined by shuffles instead of being sent to every executor


def canonical(text: Column) -> Column:
    """Template of a text, word by word: no white space comes or goes, so its words align with the text's."""
    text = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;][ \t\n])\p{Lu}\p{Ll}[\p{L}'-]*", NAME)
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_.,:/⟨])\d+(?:[.,:/]\d+)*(?![\p{L}\p{N}_])", NUMBER)
    text = F.regexp_replace(text, rf"(?i)(?<={NUMBER}[ \t\n])(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.lower(text)


def words(text: Column) -> Column:
    return F.split(F.trim(text, F.lit(_SPACE)), "[ \\x09-\\x0D]+")


def _slot(word: Column) -> Column:
    return word.contains("⟨")


def _agree(pairs: Column) -> Column:
    """Whether each value of a kind has one value on the other side; ``pairs`` are distinct."""
    return (F.size(pairs) == _values(pairs, "a")) & (F.size(pairs) == _values(pairs, "b"))


def _values(pairs: Column, side: str) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, lambda s: F.struct(s["kind"], s[side]))))


def _changed(pairs: Column) -> Column:
    return F.exists(pairs, lambda s: s["a"] != s["b"])


def _largest(found: Column) -> Column:
    """Size of a set of windows (start, pairs) that agree, and whether it changes nothing.

    If not all agree, sets are grown from the windows with the same raw words and from each window that agrees with itself,
    by adding every further one, in the text's order, that agrees with the set; the largest is taken.
    """

    def grown(first: Column, rest: Column) -> Column:
        start = F.struct(F.array_distinct(F.transform(first, lambda w: w["start"])).alias("starts"), F.array_distinct(F.flatten(F.transform(first, lambda w: w["pairs"]))).alias("pairs"))

        def add(own: Column, w: Column) -> Column:
            both = F.array_union(own["pairs"], w["pairs"])
            return F.when(_agree(both), F.struct(F.array_union(own["starts"], F.array(w["start"])).alias("starts"), both.alias("pairs"))).otherwise(own)

        return F.aggregate(rest, start, add, lambda own: F.struct(F.size(own["starts"]).alias("n"), (~_changed(own["pairs"])).alias("same")))

    every = F.array_distinct(F.flatten(F.transform(found, lambda w: w["pairs"])))
    whole = F.struct(F.size(F.array_distinct(F.transform(found, lambda w: w["start"]))).alias("n"), (~_changed(every)).alias("same"))
    single = F.array_sort(F.filter(found, lambda w: _agree(F.array_distinct(w["pairs"]))))
    equal = F.filter(single, lambda w: ~_changed(w["pairs"]))
    sets = F.concat(F.array(grown(equal, single)), F.transform(single, lambda w: grown(F.array(w), single)))
    return F.when(_agree(every), whole).otherwise(F.array_max(sets))


def windows(benchmark: DataFrame, size: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Template windows of each item: item_id, start, length, template, raw, exact, hash, anchor and its offset.

    An item of more than ``size`` words has all its windows of that size; a shorter one has two, without its last and
    without its first word, since that word's case says nothing about a name. Windows of which more than half are
    placeholders say too little: those of ``size`` words are exact, they count only where they are copied word for word,
    and shorter ones and those of placeholders alone are left out. The anchor is the rarest of the window's words in the
    benchmark.
    """
    rows = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    rows = rows.select("item_id", words(canonical(F.col("text"))).alias("whole"), words(F.col("text")).alias("raw_whole")).where(F.element_at("whole", 1) != "")
    n = F.size("whole")
    length = F.when(n > size, F.lit(size)).otherwise(F.greatest(F.lit(1), n - 1))
    rows = rows.withColumn("length", length).withColumn("start", F.explode(F.sequence(F.lit(0), n - length)))
    rows = rows.withColumn("template", F.slice("whole", F.col("start") + 1, F.col("length"))).withColumn("raw", F.slice("raw_whole", F.col("start") + 1, F.col("length")))
    rows = rows.withColumn("exact", 2 * F.size(F.filter("template", _slot)) > F.col("length")).where(~F.col("exact") | (F.col("length") == size))
    rows = rows.drop("whole", "raw_whole").withColumn("hash", F.xxhash64("template"))
    each = rows.select("item_id", "start", F.posexplode("template").alias("offset", "word")).where(~_slot(F.col("word")))
    often = each.groupBy("word").agg(F.count("*").alias("times"))
    rank = Window.partitionBy("item_id", "start").orderBy("times", F.desc(F.length("word")), "word", "offset")
    best = each.join(often, "word").withColumn("turn", F.row_number().over(rank)).where("turn = 1").select("item_id", "start", F.col("word").alias("anchor"), "offset")
    return rows.distinct().join(best, ["item_id", "start"])


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, size: int = 13, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold which items: doc_id, text_key (SHA-1 of the text), item_id, n_windows, item_windows, reparameterised, n_exact.

    n_windows: of the item's ``item_windows`` windows those found in the best alignment whose placeholders agree, which are
    at least those copied word for word; reparameterised: a value differs there. n_exact: windows mostly of placeholders that
    are copied word for word in one alignment; item_windows leaves them out, and they alone make a match too. Whole texts
    are searched; null and empty texts hold nothing, and neither do null or empty items. Rows with the same id and text count once; null ids are kept. Empty tables give no rows;
    other columns are not read.
    """
    table = windows(benchmark, size, item_column, item_text)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("text <> ''")
    both = texts.withColumn("found", words(canonical(F.col("text"))))
    count = table.count()
    if count <= MOST_WINDOWS:
        anchors = [r["anchor"] for r in table.select("anchor").distinct().collect()]  # at most MOST_WINDOWS words
        table = F.broadcast(table)
        at = F.filter(F.transform("found", lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull()) if anchors else F.array().cast("array<int>")
        hits = both.withColumn("places", at).where(F.size("places") > 0)
    else:
        hits = both.withColumn("places", F.sequence(F.lit(0), F.size("found") - 1))
    hits = hits.withColumn("text_key", F.sha1(F.col("text").cast("binary"))).withColumn("raw_found", words(F.col("text"))).drop("text")
    hits = hits.withColumn("at", F.explode("places")).drop("places").withColumn("anchor", F.get("found", F.col("at")))
    hits = hits.withColumn("near", F.slice("found", F.greatest(F.lit(1), F.col("at") - size + 2), 2 * size)).withColumn("raw_near", F.slice("raw_found", F.greatest(F.lit(1), F.col("at") - size + 2), 2 * size))
    hits = hits.withColumn("near_at", F.least(F.col("at"), F.lit(size - 1))).drop("found", "raw_found")
    met = hits.join(table, "anchor").withColumn("from", F.col("near_at") - F.col("offset")).where("from >= 0 and from + length <= size(near)")
    met = met.where(F.xxhash64(F.slice("near", F.greatest(F.lit(1), F.col("from") + 1), F.col("length"))) == F.col("hash")).where(F.slice("near", F.greatest(F.lit(1), F.col("from") + 1), F.col("length")) == F.col("template"))
    met = met.withColumn("raw_there", F.slice("raw_near", F.greatest(F.lit(1), F.col("from") + 1), F.col("length"))).withColumn("shift", F.col("at") - F.col("offset") - F.col("start"))
    pairs = F.filter(F.arrays_zip("template", "raw", "raw_there"), lambda s: _slot(s["template"]))
    met = met.withColumn("pairs", F.transform(pairs, lambda s: F.struct(s["template"].alias("kind"), s["raw"].alias("a"), s["raw_there"].alias("b")))).where(~F.col("exact") | ~_changed(F.col("pairs")))
    own = met.groupBy("doc_id", "text_key", "item_id", "shift").agg(F.collect_set(F.when(~F.col("exact"), F.struct("start", "pairs"))).alias("found"), F.size(F.collect_set(F.when(F.col("exact"), F.col("start")))).cast("long").alias("n_exact"))
    agree = own.select("doc_id", "text_key", "item_id", "n_exact", _largest(F.col("found")).alias("best")).where("best.n > 0 or n_exact > 0")
    total = table.groupBy("item_id").agg(F.count_if(~F.col("exact")).alias("item_windows"))
    best = agree.groupBy("doc_id", "text_key", "item_id").agg(F.max("best").alias("best"), F.max("n_exact").alias("n_exact")).select("doc_id", "text_key", "item_id", F.col("best.n").cast("long").alias("n_windows"), "n_exact", (~F.col("best.same")).alias("reparameterised"))
    return best.join(F.broadcast(total) if count <= MOST_WINDOWS else total, "item_id").select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "reparameterised", "n_exact")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, size: int = 13, text_column: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay as they are."""
    found = scratch.written(spark, matches(spark, docs, benchmark, size=size, text_column=text_column, **names).select("text_key").distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= MOST_WINDOWS else found
    key = F.sha1(F.col(text_column).cast("string").cast("binary"))
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("text_key"))
    return held.join(found, "text_key", "left_anti").select("row.*")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(spark, docs, benchmark, size=13).select("doc_id", "item_id", "n_windows", "item_windows", "reparameterised", "n_exact")
