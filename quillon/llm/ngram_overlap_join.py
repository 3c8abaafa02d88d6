"""Exact Jaccard join of documents on word n-grams by T-occurrence search.

1. Every document posts its least n-gram hashes; a document of which too few are posted by others has no partner.
2. The others, with equal sets taken as one, fall into families that share a prefix hash. A prefix has the rarest
   hashes, by a table of merged counts, so that a passage that many documents share does not tie them together.
3. In a family, inverted lists are searched document by document with DivideSkip: the short lists are merged and
   what they yield is looked up in the long lists by binary search.
4. The links, of which only those that join two components are needed, give the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import exchange, scratch, wordnum
from quillon.llm.components import blocks, components, tied
from quillon.llm.wordnum import Words

BLOCK_CLASSES = 8192  # classes of a family that meet in one task; larger families are searched block against block
BLOCK, MOST_BITS = 20, 26  # cells of a block and of the whole table of counts, as powers of two: 64 MB at most
MOST_BROADCAST = 1_000_000  # keys of removed rows that are sent to every executor; more are joined by a shuffle
_SKIP = 0.0085  # weight of a binary probe against a merge step, in the choice of the number of long lists


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of n with any set that links with it."""
    return -(-n * percent // 100)


def overlap(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap at which sets of a and b link."""
    return -(-(a + b) * percent // (100 + percent))


def packed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in batch.column(0):
        yield np.frombuffer(x.as_buffer(), np.uint64)


def frequencies(spark: SparkSession, frame: DataFrame, bits: int, hashes: Callable = packed) -> np.ndarray:
    """2**bits cells: how often hashes that fall into each occur, on a logarithmic scale of 16 steps an octave; 0 is once.

    ``hashes`` takes the batches of ``frame`` and gives arrays.
    """
    block = min(BLOCK, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(own, np.arange(0, (1 << bits) + 1, 1 << block))
            for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                if hi > lo:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(own[lo:hi] - (b << block)).astype(np.uint32).tobytes()], pa.binary()), pa.array([times[lo:hi].astype(np.uint32).tobytes()], pa.binary())], names=["block", "cells", "times"])

        for batch in batches:
            for x in hashes(batch):
                held.append(cell(x, bits))
                size += len(held[-1])
                if size >= 4 << 20:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << block, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(255, 16 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()], pa.binary())], names=["block", "levels"])

        for batch in batches:
            for b, own, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at:
                    if at is not None:
                        yield out()
                    at = b
                    total[:] = 0
                total[np.frombuffer(own, np.uint32)] += np.frombuffer(times, np.uint32)
        if at is not None:
            yield out()

    parts = frame.mapInArrow(count, "block int, cells binary, times binary").repartition("block").sortWithinPartitions("block")
    levels = np.zeros(1 << bits, dtype=np.uint8)
    for r in parts.mapInArrow(merge, "block int, levels binary").toLocalIterator():  # 2**bits bytes in all
        levels[r["block"] << block : (r["block"] + 1) << block] = np.frombuffer(r["levels"], np.uint8)
    return levels


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64)


class Shingles:
    """Distinct n-gram hashes of each text of a slice: ``value`` ascending within ``first``[i]:``first``[i + 1]."""

    def __init__(self, words: Words, n: int):
        h, doc = words.hashes(), words.doc()
        at = wordnum.inside(words, n)
        values, owners = [wordnum.windows(h, n)[at]], [doc[at]]
        for k in range(1, n):  # texts of fewer words are one sequence
            short = np.flatnonzero(words.n == k)
            if len(short):
                values.append(wordnum.windows(h, k, 100 + k)[words.first[short]])
                owners.append(short)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(words.n) + 1))
        self.size = np.diff(self.first)

    def rank(self) -> np.ndarray:
        return np.arange(len(self.value)) - self.first[self.owner]


def search(sizes: np.ndarray, sets: list[np.ndarray], percent: int, old: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join two components, as index pairs; old: blocks of the sets, where only pairs across them count."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    side = old[order] if old is not None else None
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    _, which, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    owner, which = owner[shared], which[shared]
    lists = owner[np.argsort(which, kind="stable")]  # each list ascends, as owners do
    number = np.bincount(which, minlength=len(count))
    ends = np.cumsum(number)
    starts = ends - number
    mine = np.searchsorted(owner, np.arange(len(order) + 1))
    sorted_sets = [which[mine[i] : mine[i + 1]] for i in range(len(order))]  # list numbers; ascending as hashes are
    label = np.arange(len(order))
    members: dict[int, list[int]] = {i: [i] for i in range(len(order))}
    found: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        a, b = label[x], label[y]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        label[members[b]] = a
        members[a] += members.pop(b)
        found.append((int(order[x]), int(order[y])))

    def linked(x: int, y: int) -> bool:
        return len(np.intersect1d(sorted_sets[x], sorted_sets[y], assume_unique=True)) >= overlap(int(sizes[x]), int(sizes[y]), percent)

    for x in range(len(order)):
        least = int(overlap(int(sizes[x]), int(needed(int(sizes[x]), percent)), percent))
        own = sorted_sets[x]
        if len(own) < least:
            continue
        own = own[np.argsort(number[own], kind="stable")]
        long = min(least - 1, int(least / (_SKIP * np.log2(max(2, number[own[-1]])) + 1)))
        short = own[: len(own) - long]
        merged = np.concatenate([lists[starts[t] : ends[t]] for t in short]) if len(short) else np.zeros(0, np.int64)
        merged = merged[merged < x]
        merged = merged[sizes[merged] * 100 >= sizes[x] * percent]
        if side is not None:
            merged = merged[side[merged] != side[x]]
        for _ in range(3):  # in a family of near copies any candidate settles all of its component
            merged = merged[label[merged] != label[x]]
            if not len(merged):
                break
            if linked(x, y := int(merged[len(merged) // 2])):
                join(x, y)
        merged = merged[label[merged] != label[x]]
        if not len(merged):
            continue
        merged = np.sort(merged, kind="stable")  # merges the runs that the short lists are
        new = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        candidate, times = merged[new], np.diff(np.append(new, len(merged)))
        candidate, times = candidate[times >= least - long], times[times >= least - long]
        for t in own[len(own) - long :]:
            if not len(candidate):
                break
            row = lists[starts[t] : ends[t]]
            at = np.searchsorted(row, candidate)
            times = times + ((at < len(row)) & (row[np.minimum(at, len(row) - 1)] == candidate))
        for y in candidate[times >= overlap(sizes[x], sizes[candidate], percent)]:
            if label[y] != label[x]:
                join(x, int(y))
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame | None, *, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", table: DataFrame | None = None) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of at least ``percent`` %.

    A-Z are lower-cased; a text with fewer than n words is one n-gram; one without words, or null, links with nothing.
    Returns key, doc_id, n_shingles, component_id, the least doc_id reachable by links, itself included, and kept: true
    for one row of each component. Rows are
    linked, not ids: rows that share an id are told apart by key, and null ids never are a component's id unless it has
    no other. Similarities of exactly ``percent`` % link. An empty table gives no rows; other columns are not read.
    """
    own = table is None
    table = exchange.keyed(spark, docs, id_column, text_column) if own else table
    size = table.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    named = exchange.bucket_bits(size // 12)
    kind = table.schema["doc_id"].dataType

    def slices(unit: exchange.Unit) -> Iterator[tuple[int, int, Shingles]]:
        for lo, hi in wordnum.slices(unit.off):
            yield lo, hi, Shingles(Words(unit.buf[unit.off[lo] : unit.off[hi]], unit.off[lo : hi + 1] - unit.off[lo], fold=True), n)

    def posted(s: Shingles) -> np.ndarray:
        """The least hashes of each set: as many as a partner may ask for."""
        most = s.size - needed(s.size, percent) + np.maximum(1, s.size * (100 - percent) // percent + 1)
        return s.rank() < most[s.owner]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in exchange.units(batches):
            parts = [s.value[posted(s)] for _, _, s in slices(unit)]
            if (batch := exchange.blobs(unit, np.concatenate(parts), named)) is not None:
                yield batch

    def sift(unit: exchange.Unit, bits: list[bytes], columns: list[pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
        parts = list(slices(unit))
        sent = [posted(s) for _, _, s in parts]
        again = exchange.flags(np.concatenate([s.value[p] for (_, _, s), p in zip(parts, sent, strict=True)]), bits, named)
        done = 0
        for (lo, hi, s), p in zip(parts, sent, strict=True):
            flag = np.zeros(len(s.value), dtype=bool)
            flag[p] = again[done : done + int(p.sum())]
            done += int(p.sum())
            least = np.maximum(1, s.size * (100 - percent) // 100)
            asked = s.rank() < (s.size - needed(s.size, percent) + least)[s.owner]
            hits = np.bincount(s.owner[flag & asked], minlength=hi - lo)
            stays = (hits >= least) & (s.size > 0)
            sets = [s.value[s.first[i] : s.first[i + 1]].tobytes() if stays[i] else None for i in range(hi - lo)]
            prints = [hashlib.blake2b(x, digest_size=16).digest() if x is not None else None for x in sets]
            ids = columns[0].combine_chunks() if isinstance(columns[0], pa.ChunkedArray) else columns[0]
            yield pa.RecordBatch.from_arrays([pa.array(unit.keys[lo:hi]), ids.slice(lo, hi - lo), pa.array(s.size.astype(np.int64)), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], names=["key", "doc_id", "n_shingles", "print", "hashes"])

    sent = table.select("key", "chunk", "text").mapInArrow(send, exchange.BLOBS)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
    sets = scratch.written(spark, exchange.with_verdicts(table, exchange.verdicts(spark, sent), sift, schema, ["doc_id"]), "sets")
    if own:
        scratch.forget(spark, table)
    some = sets.where("print is not null")
    classes = scratch.written(spark, some.groupBy("print").agg(F.min("key").alias("node"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "key")).alias("keeper"), F.first("n_shingles").alias("n"), F.first("hashes").alias("hashes")), "classes")

    total = classes.agg(F.sum("n")).head()[0] or 0
    bits = int(min(MOST_BITS, max(12, np.ceil(np.log2(max(1, total))))))
    levels = spark.sparkContext.broadcast(frequencies(spark, classes.select("hashes"), bits))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                nodes = part.column(0).to_numpy()
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                own = [x[np.lexsort((x, table[cell(x, bits)]))][: len(x) - needed(len(x), percent) + 1] for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(nodes, [len(x) for x in own]))], names=["token", "node"])

    tokens = classes.select("node", "hashes").mapInArrow(prefix, "token long, node long")
    heads = tokens.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("times")).where("times > 1")
    near = tokens.join(heads, "token").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = tied(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    near = near.mapInArrow(contract, "u long, v long")
    families = components(spark, near)
    placed = blocks(families, BLOCK_CLASSES)
    met = placed.join(classes.select("node", "n", "hashes"), "node").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def links() -> pa.RecordBatch:
            nodes = [r[0] for r in rows]
            across = np.array([r[4] for r in rows]) if group[1] != group[2] else None
            pairs = search(np.array([r[5] for r in rows], dtype=np.int64), [np.frombuffer(r[6], np.uint64) for r in rows], percent, across)
            u, v = tied(np.array([nodes[x] for x, _ in pairs], dtype=np.int64), np.array([nodes[y] for _, y in pairs], dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "i", "j", "block", "n", "hashes")), strict=True):
                if group != r[1:4]:
                    if rows:
                        yield links()
                    group, rows = r[1:4], []
                rows.append(r)
        if rows:
            yield links()

    joined = components(spark, met.mapInArrow(link, "u long, v long"))
    known = classes.select("print", "node", "least_id", "keeper").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("keeper").alias("keeper"))
    named = known.drop("keeper").join(least, "component").select("print", "component_id", "keeper.key")
    named = named.withColumnRenamed("key", "keeper")
    every = sets.select("key", "doc_id", "n_shingles", "print").join(named, "print", "left")
    alone = F.col("print").isNull()
    return every.select("key", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("key") == F.col("keeper"))).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, *, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the least id and of those the first; all columns stay."""
    table = exchange.keyed(spark, docs, id_column, text_column, whole_rows=True)
    found = near_duplicates(spark, docs, n=n, percent=percent, table=table)
    gone = scratch.written(spark, found.where("not kept").select("key"), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    left = table.join(gone, "key", "left_anti")
    return left.select(*[F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_ngram_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, n=5, percent=80).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE whole AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT k, len(words) AS total, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM whole),
windowed AS (SELECT k, i, total, string_agg(w, ' ') OVER f AS x, count(*) OVER f AS n FROM word WINDOW f AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
shingle AS MATERIALIZED (SELECT DISTINCT k, x FROM windowed WHERE n = 5 OR (total < 5 AND i = 1)),
size AS MATERIALIZED (SELECT k, count(*) AS n FROM shingle GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN size p ON p.k = a JOIN size q ON q.k = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT k, doc_id AS least FROM whole UNION SELECT link.b, reach.least FROM reach JOIN link ON link.a = reach.k)
SELECT doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(least) AS component_id FROM whole JOIN reach USING (k) LEFT JOIN size USING (k) GROUP BY whole.k, doc_id
"""
