"""Quality rules: simple counts, and robust multivariate outliers for each language and source.

Each document's counts become a vector of transformed statistics. For each language and source the minimum covariance
determinant is sought by concentration steps from three deterministic starts: each step takes the mean and covariance
of the half of the group that lies nearest to the last estimate. After two steps from each start the fit with the least
determinant goes on until it falls no more. All groups step together, as aggregations; no group is gathered into one task. Distances are
scaled, up or down, to the median that they should have, the estimate is reweighted once, and vectors beyond a high
quantile are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import scratch, wordnum
from quillon.llm.wordnum import Words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Added to each standard deviation. Most texts have no symbols or repeats at all, so half of a group may not vary there;
#: each floor is small enough that a text can be rejected for any one of the statistics.
FLOORS = {"log_words": 0.01, "log_word_length": 0.01, "symbols": 0.05, "dup_lines": 0.05, "repeats": 0.05, "upper": 0.01}
MOST_GROUPS = 100_000  # groups whose estimates, of some 300 bytes each, are sent to every executor
GROUP_ROWS = 1_000_000  # rows of a group that may meet in one task where there are more groups
_symbol = np.zeros(256, dtype=bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a slice."""
    words = Words(buf, off)
    n = len(off) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[off])

    first = (buf & 0xC0) != 0x80
    after = np.zeros(len(buf), dtype=bool)
    after[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    out = {"n_words": words.n, "word_chars": total(first & ~wordnum._space[buf]), "n_symbols": total(_symbol[buf]), "n_upper": total(((buf >= 65) & (buf <= 90)) | after)}
    breaks = np.flatnonzero(buf == 10)
    edge = np.unique(np.concatenate([off, breaks, breaks + 1]))  # a span for each line and each break
    start, end = edge[:-1], edge[1:]
    full = np.searchsorted(words.start, end, "left") > np.searchsorted(words.start, start, "left")
    start, end = start[full], end[full]
    doc = np.searchsorted(off, start, "right") - 1
    h = wordnum.spans(buf, start, end)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=n)
    at = wordnum.inside(words, 3)
    of = words.doc()
    w = wordnum.windows(words.hashes(), 3)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((w, of[at]))
    same = (w[order][1:] == w[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.start), dtype=bool)
    for i in range(3):
        covered[at[twice] + i] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return out


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """doc_id, lang, source and COUNTS of every whole text; a null text has none of anything."""
    kinds = [docs.schema[c].dataType for c in (id_column, lang_column, source_column)]
    schema = T.StructType([*[T.StructField(c, k) for c, k in zip(("doc_id", "lang", "source"), kinds, strict=True)], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = wordnum.flat(batch.column(3))
            for lo, hi in wordnum.slices(off):
                own = counts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(3)], *[pa.array(own[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", "lang", "source", *COUNTS])

    return docs.select(id_column, lang_column, source_column, text_column).mapInArrow(run, schema)


def vector() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "log_words": F.log(words),
        "log_word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.least(F.lit(1.0), F.col("n_upper") / chars)),
    }


def quantile(d: int, z: float) -> float:
    """Chi-squared quantile with d degrees of freedom at the normal quantile z (Wilson and Hilferty)."""
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def beside(rows: DataFrame, groups: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """``rows`` joined with the row of their group; a group's rows never meet in one task unless they are few.

    With ``few`` groups, MOST_GROUPS at most, all go to every executor. Otherwise only those of more than GROUP_ROWS rows
    do, of which there is one for GROUP_ROWS rows at most, and the others are joined by a shuffle.
    """
    if few:
        return rows.join(F.broadcast(groups), "in_group")
    large = F.broadcast(sizes.where(F.col("size") > GROUP_ROWS).select("in_group"))
    hot = rows.join(large, "in_group", "left_semi").join(F.broadcast(groups.join(large, "in_group", "left_semi")), "in_group")
    return hot.unionByName(rows.join(large, "in_group", "left_anti").join(groups, "in_group"))


def outlier_distances(spark: SparkSession, table: DataFrame, keys: list[str], floors: dict[str, float], *, steps: int = 12, least: int = 60) -> DataFrame:
    """``table`` (keys and the statistics named in ``floors``) with distance2: squared robust distance within its group.

    Each group's estimate starts from its medians with three scatters (of each statistic alone, of hyperbolic tangents, of
    spatial signs), the deterministic starts of the minimum covariance determinant. Two concentration steps from each fit
    the nearer half again; of each group the fit with the least determinant goes on until no group's determinant falls
    any more, ``steps`` at most, and is reweighted. Groups of fewer than ``least`` rows are pooled by the first key; a pool
    that is still smaller gets null. An empty table gives no rows.
    """
    names, d = list(floors), len(floors)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    table = table.withColumn("in_group", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    sizes = scratch.written(spark, table.groupBy("in_group").agg(F.count("*").alias("size")), "group-sizes")
    few = sizes.count() <= MOST_GROUPS
    pooled = F.when(F.col("size") >= least, F.col("in_group")).otherwise(F.to_json(F.struct(keys[0]), {"ignoreNullFields": "false"}))
    table = scratch.written(spark, beside(table, sizes, sizes, few).withColumn("in_group", pooled).drop("size"), "statistics")
    sizes = sizes if few else scratch.written(spark, table.groupBy("in_group").agg(F.count("*").alias("size")), "group-sizes")
    matrix = [*[f"m{i}" for i in range(d)], *[f"q{i}_{j}" for i, j in pairs]]
    schema = "in_group string, determinant double, " + ", ".join(f"{c} double" for c in matrix)

    def solve(group: str, mean: np.ndarray, cov: np.ndarray) -> list:
        cov = cov + np.diag(np.array(list(floors.values())) ** 2)  # keeps it invertible where a statistic is constant
        inverse = np.linalg.inv(cov)
        return [group, np.linalg.slogdet(cov)[1], *mean, *[inverse[i, j] for i, j in pairs]]

    def moments(r: dict) -> np.ndarray:
        """Second moments of a row of sums of products."""
        out = np.zeros((d, d))
        for i, j in pairs:
            out[i, j] = out[j, i] = r[f"p{i}_{j}"] / r["n"]
        return out

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                rows.append(solve(r["in_group"], mean, moments(r) - np.outer(mean, mean)))
            yield pd.DataFrame(rows, columns=["in_group", "determinant", *matrix])

    def axes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Eigenvectors of each group's scatter."""
        for f in frames:
            rows = [[r["in_group"], *np.linalg.eigh(moments(r))[1].ravel()] for r in f.to_dict("records")]
            yield pd.DataFrame(rows, columns=["in_group", *[f"e{i}_{k}" for i in range(d) for k in range(d)]])

    def started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Medians and absolute deviations along the axes, in the scales of the statistics."""
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                own = np.array([[r[f"e{i}_{k}"] for k in range(d)] for i in range(d)])
                scale, mean = np.array([r[f"a{i}"] for i in range(d)]), np.array([r[f"c{i}"] for i in range(d)])
                wide = np.diag([(1.4826 * r[f"w{k}"]) ** 2 for k in range(d)])
                rows.append(solve(r["in_group"], mean + scale * (own @ [r[f"v{k}"] for k in range(d)]), own @ wide @ own.T * np.outer(scale, scale)))
            yield pd.DataFrame(rows, columns=["in_group", "determinant", *matrix])

    def sums(columns: list[Column]) -> list[Column]:
        return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]]

    def measured(estimates: DataFrame) -> DataFrame:
        away = [F.col(names[i]) - F.col(f"m{i}") for i in range(d)]
        total = reduce(add, [away[i] * away[j] * F.col(f"q{i}_{j}") * (1 if i == j else 2) for i, j in pairs])
        return beside(table, estimates, sizes, few).withColumn("distance2", total).select(*table.columns, "distance2")

    def half(frame: DataFrame) -> DataFrame:
        return frame.groupBy("in_group").agg(F.percentile_approx("distance2", 0.5, 1000).alias("middle"), F.count("*").alias("rows"))

    def fitted(nearest: DataFrame) -> DataFrame:
        return nearest.groupBy("in_group").agg(*sums([F.col(c) for c in names])).mapInPandas(estimate, schema)

    def concentrated(estimates: DataFrame, most: int) -> DataFrame:
        """Steps, ``most`` at most, until no group's determinant falls by more than a part in 10,000; a step that raises a group's is not taken."""
        for _ in range(most):
            far = measured(estimates)
            new = fitted(beside(far, half(far), sizes, few).where("distance2 <= middle"))
            old = estimates.select("in_group", F.col("determinant").alias("before"), F.struct(*matrix).alias("old"))
            both = new.join(old, "in_group").withColumn("fell", F.col("before") - F.col("determinant"))
            better = F.col("fell") > 0
            kept = [F.when(better, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in matrix]
            taken = scratch.written(spark, both.select("in_group", F.when(better, F.col("determinant")).otherwise(F.col("before")).alias("determinant"), F.when(better, F.col("fell")).otherwise(0.0).alias("fell"), *kept), "estimates")
            estimates = taken.drop("fell")
            if (taken.agg(F.max("fell")).head()[0] or 0) <= 1e-4:
                break
        return estimates

    middle = table.groupBy("in_group").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"c{i}") for i, c in enumerate(names)])
    off = beside(table, middle, sizes, few)
    spread = off.groupBy("in_group").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"c{i}")), 0.5, 1000).alias(f"a{i}") for i, c in enumerate(names)])
    scale = middle.join(spread, "in_group").select("in_group", *[f"c{i}" for i in range(d)], *[(1.4826 * F.col(f"a{i}") + floors[names[i]]).alias(f"a{i}") for i in range(d)])
    scale = scratch.written(spark, scale, "scales")
    z = [(F.col(c) - F.col(f"c{i}")) / F.col(f"a{i}") for i, c in enumerate(names)]
    length = F.sqrt(reduce(add, [x * x for x in z]) + 1e-12)
    scatters = [[F.tanh(x) for x in z], [x / length for x in z]]
    scaled = beside(table, scale, sizes, few)
    every = None
    for number in range(1 + len(scatters)):
        if number:
            found = scaled.groupBy("in_group").agg(*sums(scatters[number - 1])).mapInPandas(axes, "in_group string, " + ", ".join(f"e{i}_{k} double" for i in range(d) for k in range(d)))
        else:
            found = scale.select("in_group", *[F.lit(float(i == k)).alias(f"e{i}_{k}") for i in range(d) for k in range(d)])
        found = scratch.written(spark, found.join(scale, "in_group"), "axes")
        along = beside(table, found, sizes, few).select("in_group", *[reduce(add, [z[i] * F.col(f"e{i}_{k}") for i in range(d)]).alias(f"u{k}") for k in range(d)])
        centre = scratch.written(spark, along.groupBy("in_group").agg(*[F.percentile_approx(f"u{k}", 0.5, 1000).alias(f"v{k}") for k in range(d)]), "centres")
        wide = beside(along, centre, sizes, few).groupBy("in_group").agg(*[F.percentile_approx(F.abs(F.col(f"u{k}") - F.col(f"v{k}")), 0.5, 1000).alias(f"w{k}") for k in range(d)])
        one = scratch.written(spark, found.join(centre, "in_group").join(wide, "in_group").mapInPandas(started, schema), "estimates")
        far = measured(one)  # the scatter of a start is no fit: the first step is always taken
        one = concentrated(scratch.written(spark, fitted(beside(far, half(far), sizes, few).where("distance2 <= middle")), "estimates"), 1).withColumn("start", F.lit(number))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("in_group").agg(F.min(F.struct("determinant", "start", *matrix)).alias("best"))  # three rows a group
    estimates = concentrated(scratch.written(spark, best.select("in_group", "best.determinant", *[f"best.{c}" for c in matrix]), "estimates"), steps)

    size = quantile(d, 0.0)
    far = measured(estimates)
    near = beside(far, half(far), sizes, few).where(F.col("distance2") * size <= F.greatest("middle", F.lit(1e-9)) * quantile(d, 1.96))
    estimates = scratch.written(spark, fitted(near), "estimates")
    last = measured(estimates)
    middle = half(last).withColumn("by", F.when(F.col("rows") >= least, size / F.greatest("middle", F.lit(quantile(1, 0.0)))))  # at least as if one statistic varied: a group of copies has no scale
    return beside(last, middle, sizes, few).withColumn("distance2", F.col("distance2") * F.col("by")).drop("in_group", "middle", "rows", "by")


def quality_rules(spark: SparkSession, docs: DataFrame, *, z: float = 5.0, least: int = 60, least_words: int = 50, most_repeats: int = 50, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Counts of every whole text, base_failed, and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeats`` % of the words in three-word runs that
    the text holds twice. kept: not base_failed and not an outlier, beyond the chi-squared quantile of normal quantile
    ``z``, among the documents of its language and source that passed the base rules. Nulls in language or source are
    values like others; groups of fewer than ``least`` documents are pooled by language, and where that is too few the
    document is kept. Null and empty texts fail. Repeated rows are judged one by one; an empty table gives no rows.
    """
    own = scratch.written(spark, statistics(docs, id_column, text_column, lang_column, source_column), "counts")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    own = own.withColumn("base_failed", failed)
    passed = own.where("not base_failed").select("lang", "source", "doc_id", *COUNTS, "base_failed", *[v.alias(k) for k, v in vector().items()])
    judged = outlier_distances(spark, passed, ["lang", "source"], FLOORS, least=least)
    judged = judged.withColumn("kept", F.coalesce(F.col("distance2") <= quantile(len(FLOORS), z), F.lit(True)))
    columns = ["doc_id", "lang", "source", *COUNTS, "base_failed"]
    rest = own.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return judged.select(*columns, "distance2", "kept").unionByName(rest)


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
