"""Best-fit decreasing packing of tokenised documents into fixed-size sequences.

Best-fit decreasing looks only at lengths, and pieces of one length are interchangeable. So the packing is planned
on the driver from a histogram of at most ``size`` lengths, and the plan, a few runs per length, is applied to all
pieces in parallel. The plan is the one that placing piece after piece would give: longest first, each into the
open sequence with the least room that still holds it, found by descending a segment tree over remaining capacities.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.llm import scratch

_SPECIAL = "<|endoftext|>"


class CapacityTree:
    """Segment tree over capacities 0..size; a leaf says whether an open sequence has exactly that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = is_open
        at >>= 1
        while at:
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
            at >>= 1

    def tightest(self, length: int) -> int:
        """Least open capacity of at least ``length``, or -1."""
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.any[2 * at])
                return at - self.leaves
            at >>= 1
        return -1


def plan(counts: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Runs of each length: (first rank, first sequence, pieces of this length in each sequence, offset).

    The piece of rank r in a run that starts at rank a goes to sequence ``first + (r - a) // each`` at
    ``offset + (r - a) % each * length``. Runs of a length are in ascending order of rank.
    """
    tree, rooms, used = CapacityTree(size), {}, 0  # rooms: capacity -> runs of sequences (first, number)
    out: dict[int, list[tuple[int, int, int, int]]] = {}

    def give(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            rooms.setdefault(capacity, []).append((first, number))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, out.setdefault(length, [])
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:  # all further pieces of this length open new sequences
                each = size // length
                first, number, capacity = used, -(-left // each), size
                used += number
            else:
                first, number = rooms[capacity].pop()
                if not rooms[capacity]:
                    tree.put(capacity, False)
                each = capacity // length  # after one piece this sequence has the least room, as long as it holds another
            runs.append((rank, first, each, size - capacity))
            full = min(number, left // each)
            give(capacity - each * length, first, full)
            rest = 0
            if full < number:
                rest = left - full * each
                give(capacity - rest * length, first + full, 1 if rest else 0)
                give(capacity, first + full + bool(rest), number - full - bool(rest))
            left -= full * each + rest
            rank += full * each + rest
    return out


def encoder(vocabulary: str):
    """text -> ids of the byte-level BPE in ``vocabulary`` (tokenizers' JSON), as uint32.

    The same merges, as ranks beside the JSON file, are run by a faster library wherever both libraries' character
    classes agree for sure; any other text goes to ``tokenizers`` itself, and so does one with runs of white space so
    long that the faster library gives up.
    """
    import tiktoken

    lines = open(vocabulary.removesuffix(".json") + ".tiktoken", "rb")
    with lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})
    beyond, slow = re.compile("[^\x00-\u024f]").search, []

    def encode(text: str) -> np.ndarray:
        if not (beyond(text) or _SPECIAL in text):
            try:
                return np.asarray(fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype=np.uint32)
            except ValueError:  # its patterns' stack is full
                pass
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(vocabulary))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of at most ``size``: part, rank (within part and length), doc_id, piece, start, length, ids (little-endian uint32)."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    most = 8 << 20  # bytes of ids handed on at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        rows: list[tuple] = []
        held = 0
        arrow = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], arrow), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size if len(ids) > size else len(ids)
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((seen[b - a], doc, k, a, b - a, ids[a:b].tobytes()))
                    seen[b - a] += 1
                held += 4 * len(ids)
                if held >= most:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, *, size: int = 1024, end_id: int = 2, vocabulary: str | None = None, columns: dict[str, Column] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens by best-fit decreasing over the whole corpus.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only longer documents are
    cut, into pieces of ``size``; the first may be shorter. Returns a row per piece: doc_id, piece, start, length,
    sequence_id, offset, and ``columns``: expressions over ``ids`` (binary, little-endian uint32), by default the ids
    themselves. Equal lengths are placed in input order; repeated rows and null ids are packed like any others; an
    empty table gives no rows; further columns of ``docs`` are not read.
    """
    columns = {"ids": F.col("ids")} if columns is None else columns
    made = pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), size, end_id, id_column, text_column)
    made = scratch.written(spark, made.select("part", "rank", "doc_id", "piece", "start", "length", *[c.alias(f"own_{name}") for name, c in columns.items()]), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = by_part.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    base = base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs = plan(counts, size)
    tables = {length: np.array(x, dtype=np.int64).T for length, x in runs.items()}
    shared = spark.sparkContext.broadcast(tables)  # its size depends on ``size``, not on the number of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, first, each, room = table[int(n)]
                k = np.searchsorted(starts, rank[at], "right") - 1
                i = rank[at] - starts[k]
                sequence[at], offset[at] = first[k] + i // each[k], room[k] + i % each[k] * n
            keep = [i for i, x in enumerate(batch.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)], names=[*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    ranked = made.join(base, ["part", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), *[f"own_{name}" for name in columns], (F.col("rank") + F.col("base")).alias("rank"))
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    placed = ranked.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.select("doc_id", "piece", "start", "length", *[F.col(f"own_{name}").alias(name) for name in columns], "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(spark, docs, size=1024, end_id=2, columns={"ids_crc32": F.crc32("ids")}).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
