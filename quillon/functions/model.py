"""Language models as injected functions: prompt -> answer. A failure is a value in a column, never an exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import collapse, is_prose, is_substantive

Model = Callable[[str], str]
ORDER = ["undetermined", "n/a", "pass", "violation"]


def echo(prompt: str) -> str:
    """The model where none is given: it has nothing to say."""
    return ""


def asked(frame: DataFrame, prompt: str, model: Model = echo, concurrency: int | None = None) -> DataFrame:
    """``frame`` with answer and error; at most ``concurrency`` partitions call the model at once."""
    dealt = frame.repartition(concurrency) if concurrency else frame

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for p in f[prompt]:
                try:
                    answers.append(model(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 the error is the answer
                    answers.append("")
                    errors.append(str(e))
            yield f.assign(answer=answers, error=errors)

    return dealt.mapInPandas(run, T.StructType([*frame.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))


def criteria_prompts(units: DataFrame, criteria: DataFrame, size: int = 4) -> DataFrame:
    """A prompt for each unit (doc_id, unit, text) and batch of ``size`` criteria (no, text)."""
    batches = criteria.withColumn("batch", F.floor((F.row_number().over(_by_number()) - 1) / size)).groupBy("batch").agg(F.array_sort(F.collect_list(F.concat_ws(". ", "no", "text"))).alias("asked"))
    both = units.crossJoin(F.broadcast(batches))  # criteria are a short list
    return both.select("doc_id", "unit", "batch", F.concat_ws("\n", F.array_join("asked", "\n"), F.lit("---"), "text").alias("prompt"))


def _by_number():
    from pyspark.sql import Window

    return Window.orderBy("no")


def whole_or_chunks(docs: DataFrame, most: int = 120_000, chunk: int = 4000) -> DataFrame:
    """doc_id, unit, text, partial: whole documents of up to ``most`` characters, longer ones in chunks that see only a part."""
    short = docs.where(F.char_length("text") <= most).select("doc_id", F.lit(0).alias("unit"), "text", F.lit(False).alias("partial"))
    long = docs.where(F.char_length("text") > most).withColumn("unit", F.explode(F.sequence(F.lit(0), F.ceil(F.char_length("text") / chunk).cast("int") - 1)))
    return short.unionByName(long.select("doc_id", "unit", F.substring(F.col("text"), F.col("unit") * chunk + 1, F.lit(chunk)).alias("text"), F.lit(True).alias("partial")))


def gated(findings: DataFrame, places: DataFrame) -> DataFrame:
    """A model's findings (finding_id, quote_id, quote) with their quote's place; a quote that stands nowhere or is no prose makes its finding unreviewed."""
    rows = findings.join(places.select("quote_id", "place"), "quote_id", "left")
    return rows.withColumn("unreviewed", ~(F.coalesce(F.col("place"), F.lit("missing")) != "missing") | ~is_prose(F.col("quote")))


def rescued(failed: DataFrame, shown: DataFrame, model: Model, most: int = 10) -> DataFrame:
    """A second call for at most ``most`` failed quotes a document, with the lines (quote_id, line) that come closest; the new quote must lie in what was shown."""
    from pyspark.sql import Window

    first = failed.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("quote_id"))).where(F.col("turn") <= most).drop("turn")
    lines = shown.groupBy("quote_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("shown"))
    prompts = first.join(lines, "quote_id").withColumn("prompt", F.concat_ws("\n---\n", "quote", "shown"))
    done = asked(prompts, "prompt", model)
    good = (F.trim("answer") != "") & F.col("shown").contains(F.trim("answer"))
    return done.select("doc_id", "quote_id", F.when(good, F.trim("answer")).alias("quote"), good.alias("rescued"), "error")


def suggestions(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, original, revised: the model's revision, null where it is empty or changes nothing."""
    done = asked(texts.withColumn("prompt", F.col("original")), "prompt", model)
    return done.select("doc_id", "original", F.when((F.trim("answer") != "") & (F.trim("answer") != F.trim("original")), F.col("answer")).alias("revised"), "error")


#: How an answer that names a contradiction starts, and how it quotes both sides.
ISSUE = "ISSUE:"
BOTH_QUOTES = r'상위\s*["“]([^"”]+)["”]\s*vs\s*하위\s*["“]([^"”]+)["”]'


def content_matched(parents: DataFrame, children: DataFrame, parent_lines: DataFrame, child_lines: DataFrame, model: Model) -> DataFrame:
    """doc_id, id, severity, message, evidence, unreviewed: statements of one id on both sides (doc_id, id, text) that a model finds at odds.

    Each quote must stand in its own side's lines or sections (doc_id, text), white space aside; one of the two is
    enough. A failed call is an unreviewed row. Findings without a quote that stands are dropped, and a row without an id
    counts them. An id on one side only is left to traceability; null texts are empty.
    """
    text = lambda t: F.coalesce(t, F.lit(""))
    prompt = F.concat_ws("\n", F.lit(f'Do both statements agree? If not, answer: {ISSUE} what differs, 상위 "quote" vs 하위 "quote"'), F.col("id"), text(F.col("p.text")), F.lit("---"), text(F.col("c.text")))
    met = parents.alias("p").join(children.alias("c"), ["doc_id", "id"]).select("doc_id", "id", prompt.alias("prompt"))
    done = asked(met, "prompt", model)
    for side, lines in (("upper", parent_lines), ("lower", child_lines)):
        done = done.join(lines.groupBy("doc_id").agg(F.collect_list(collapse(F.col("text"))).alias(side)), "doc_id", "left")
    answer = F.trim(text(F.col("answer")))
    quote = lambda i: collapse(F.regexp_extract(answer, BOTH_QUOTES, i))
    stands = lambda i, side: F.when(is_substantive(quote(i)) & F.exists(F.coalesce(side, F.array().cast("array<string>")), lambda u: u.contains(quote(i))), quote(i))
    none = F.array().cast("array<string>")
    evidence = F.array_compact(F.array(stands(1, F.col("upper")), stands(2, F.col("lower"))))
    failed = F.col("error").isNotNull()
    rows = done.where(failed | F.startswith(answer, F.lit(ISSUE))).select("doc_id", "id", failed.alias("unreviewed"), F.when(failed, F.col("error")).otherwise(F.trim(F.substring(answer, len(ISSUE) + 1, 1 << 30))).alias("message"), F.when(failed, none).otherwise(evidence).alias("evidence"))
    kept = F.col("unreviewed") | (F.size("evidence") > 0)
    own = F.struct("id", F.when(F.col("unreviewed"), "info").otherwise("minor").alias("severity"), "message", "evidence", "unreviewed")
    folded = rows.groupBy("doc_id").agg(F.collect_list(F.when(kept, own)).alias("found"), F.count_if(~kept).alias("dropped"))
    count = F.struct(F.lit(None).cast("string").alias("id"), F.lit("info").alias("severity"), F.concat(F.lit("dropped without a quote that stands: "), F.col("dropped")).alias("message"), none.alias("evidence"), F.lit(False).alias("unreviewed"))
    return folded.select("doc_id", F.explode(F.when(F.col("dropped") > 0, F.array_append("found", count)).otherwise(F.col("found"))).alias("f")).select("doc_id", "f.*")
