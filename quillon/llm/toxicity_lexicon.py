"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters and accents to plain ones, and reads digits and signs within words as the
letters they stand for. Lexicon entries are words and word beginnings with weights learned from labelled documents;
phrases that hold an entry but occur in harmless documents only are exceptions. The score depends on the weight of the
matches and on that weight in proportion to the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import scratch
from quillon.llm.labelled import fold_of, sample

#: Letters of other scripts that look like Latin ones: Cyrillic, Greek.
LOOK_ALIKE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": ""}
LEET = str.maketrans("013457@$!|", "oieastasil")
#: Harmless phrases that hold a word which may well be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish")
STEM = (4, 5, 6)


def _folding() -> dict[int, str]:
    table = {}
    for point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x400), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).lower()
        table[point] = "".join(LOOK_ALIKE.get(c, c) for c in plain)
    return table | {point: "" for point in range(0x300, 0x370)} | {ord(k): v for k, v in LOOK_ALIKE.items()}


_fold = _folding()
_within = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])")
_before = re.compile(r"(?<![^\W_])[013457@$]+(?=[a-z][a-z])")
_gaps = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words, each with a space before and after it."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_fold)
    text = _before.sub(lambda m: m[0].translate(LEET), _within.sub(lambda m: m[0].translate(LEET), text))
    return " " + _gaps.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """weights: " word " or " beginning" -> weight. exceptions: " folded phrase ". bias, by_sum, by_density: of the score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -3.0
    by_sum: float = 1.0
    by_density: float = 0.0
    automaton: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def matcher(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            self.automaton.make_automaton()
        return self.automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Weight of the best entry at each place where one begins outside every exception phrase."""
        if not self.weights:
            return {}
        found: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, weight) in self.matcher().iter(folded):
            if weight is None:
                harmless.append((end - size + 1, end))
            else:
                start = end - size + 1
                found[start] = max(found.get(start, weight), weight)
        for a, b in harmless:
            for start in [x for x in found if a <= x < b]:
                del found[start]
        return found

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(self.matches(folded).values())
        return float(np.log1p(max(0.0, total))), float(np.log1p(100 * max(0.0, total) / (folded.count(" ") or 1)))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.by_sum * a + self.by_density * b, -30, 30))))


def entries_of(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in STEM if len(word) > n)
    return out


def choose(rows: list, toxic: int, harmless: int, most: int) -> dict[str, float]:
    """Weights of the entries that mark toxic texts.

    A beginning is taken only where many words share it: neither one word nor a longer beginning has nearly all of its
    occurrences. Entries that a chosen beginning covers are left out.
    """
    words: dict[str, int] = {}
    longer: dict[str, int] = {}
    for r in rows:
        entry = r["entry"]
        for n in STEM:
            if len(entry.strip()) > n:
                best = words if entry[-1] == " " else longer
                best[entry[: n + 1]] = max(best.get(entry[: n + 1], 0), r["toxic"])
    chosen: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (r["entry"][-1] == " ", len(r["entry"]), r["entry"])):
        entry, times = r["entry"], r["toxic"]
        weight = np.log((times + 0.5) / (toxic + 1)) - np.log((r["harmless"] + 0.5) / (harmless + 1))
        beginning = entry[-1] != " "
        if beginning and (words.get(entry, 0) >= 0.6 * times or longer.get(entry, 0) >= 0.95 * times):
            continue
        precise = times >= (0.97 if beginning else 0.7) * (times + r["harmless"])
        if precise and weight > 1.5 and not any(entry[: n + 1] in chosen for n in STEM if n + 1 < len(entry)):
            chosen[entry] = float(weight)
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:most])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label_column: str = "toxic", folds: int = 4, held_out: int = 2, most: int = 20000, entries: int = 5000, exceptions: tuple[str, ...] = EXCEPTIONS, id_column: str = "doc_id", text_column: str = "text") -> Lexicon:
    """Learn from at most ``most`` labelled rows outside the held-out fold.

    One half of them, of near copies only one each, gives the entries, of which at most ``entries`` are kept; the other
    half gives the exception phrases and fits the score. Without both labels every text scores low.
    """
    known = sample(docs, labels, label_column, folds, held_out, most, id_column, text_column).repartition(16, F.xxhash64("doc_id"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fold(x or "") for x in batch.column(2).to_pylist()]
            marks = []
            for t in texts:
                w = t.split()
                marks.append(min((hash_of(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(texts)], names=["doc_id", "label", "mark", "folded"])

    table = known.mapInArrow(folded, T.StructType([known.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("mark", T.LongType()), T.StructField("folded", T.StringType())]))
    table = scratch.written(spark, table, "labelled")
    parity = F.pmod(F.xxhash64(F.lit(1), "mark"), F.lit(2))
    first = table.where(parity == 0).withColumn("turn", F.row_number().over(Window.partitionBy("mark", "label").orderBy("doc_id"))).where("turn = 1")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((e, label) for e in entries_of(text))
                if len(seen) > 500_000:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["entry", "label", "n"])

    sizes = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    least = max(4, int(0.004 * sizes.get(1, 0)))
    table_of = first.select("label", "folded").mapInArrow(counted, "entry string, label int, n long")
    summed = table_of.groupBy("entry").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("harmless"))
    likely = summed.where((F.col("toxic") >= least) & (F.col("toxic") >= 0.7 * (F.col("toxic") + F.col("harmless"))))
    rows = likely.orderBy(F.desc("toxic"), "entry").limit(8 * entries).collect()
    lexicon = Lexicon(choose(rows, sizes.get(1, 0), sizes.get(0, 0), entries), {fold(x) for x in exceptions})
    shared = spark.sparkContext.broadcast(lexicon)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = set()
                for at in own.matches(text):
                    before, after = text[:at].rsplit(" ", 1)[-1], text[at + 1 :].split(" ", 2)
                    near.add(f" {before} {after[0]} " if before else "")
                    near.add(f" {after[0]} {after[1]} " if len(after) > 1 and after[1] else "")
                seen.update((x, label) for x in near if x)
            if seen:
                yield out(seen)

    second = table.where(parity == 1)
    about = second.select("label", "folded").mapInArrow(phrases, "entry string, label int, n long")
    harmless = about.groupBy("entry").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"))
    lexicon.exceptions |= {r["entry"] for r in harmless.where("n >= 3 and bad = 0").orderBy(F.desc("n"), "entry").limit(entries).collect()}
    lexicon.automaton = None
    again = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [again.value.features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], names=["label", "a", "b"])

    points = second.select("label", "folded").mapInArrow(measured, "label int, a double, b double").collect()
    x = np.array([[1.0, r["a"], r["b"]] for r in points]).reshape(-1, 3)
    y = np.array([float(r["label"]) for r in points])
    if len(np.unique(y)) == 2:
        lexicon.bias, lexicon.by_sum, lexicon.by_density = logistic(x, y)
    return lexicon


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> list[float]:
    """Weights by Newton steps, with a ridge on all but the constant; later weights are kept from going below zero."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return [float(w[0]), *[max(0.0, float(v)) for v in w[1:]]]


def score(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, *, column: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with ``column``, 0 to 1, for every whole text; a null or empty text scores as one without matches.

    An existing column of that name is replaced; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(lexicon)  # at most ``entries`` words and as many phrases
    plain = docs.drop(column)
    at = plain.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value.score(x.as_py() or "") for x in batch.column(at)], pa.float64())], names=[*batch.schema.names, column])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_column="toxic", folds=4, held_out=2)
    scored = score(spark, docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
