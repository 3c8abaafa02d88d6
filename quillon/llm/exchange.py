"""Which hashes of a corpus occur in more than one place, told back to the rows that hold them.

Rows are dealt into chunks, written once. A unit is a run of rows of one chunk. For each unit the distinct hashes go,
sorted and packed, to the bucket that their leading bits name; a bucket counts them over all units and returns one bit
per hash to each unit. A hash travels once for each unit however often it occurs there, so that neither a very common
hash nor a large group of copies makes a bucket large, and the answer takes a bit per hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scratch, wordnum

CHUNK_ROWS = 10  # as a power of two
UNIT_BYTES = 8 << 20
BUCKET_HASHES = 1 << 19
BLOBS = "chunk long, lo long, hi long, bucket long, hashes binary, again binary"
_MASKS = pa.schema([("chunk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


@dataclass
class Unit:
    """Rows of one chunk: their keys, and their texts as bytes and offsets."""

    chunk: int
    keys: np.ndarray
    buf: np.ndarray
    off: np.ndarray


def keyed(spark: SparkSession, docs: DataFrame, id_column: str, text_column: str, whole_rows: bool = False, buckets: int = 0) -> DataFrame:
    """docs written to the shared folder as key, chunk, doc_id, text and, if asked, row: all columns but the text.

    In ``buckets`` by chunk, if asked: a join on the chunk then leaves the texts where they are.
    """
    rest = [docs[f"`{c}`"] for c in docs.columns if c != text_column]
    row = [F.struct(*rest).alias("row")] if whole_rows else []
    frame = docs.select(docs[f"`{id_column}`"].alias("doc_id"), docs[f"`{text_column}`"].cast("string").alias("text"), *row).withColumn("key", F.monotonically_increasing_id())
    frame = frame.withColumn("chunk", F.shiftright("key", CHUNK_ROWS))
    return scratch.bucketed(spark, frame, "keyed", "chunk", buckets) if buckets else scratch.written(spark, frame, "keyed")


def join_units(parts: list[Unit]) -> Unit:
    if len(parts) == 1:
        return parts[0]
    ends = np.cumsum([p.off[-1] for p in parts])
    return Unit(parts[0].chunk, np.concatenate([p.keys for p in parts]), np.concatenate([p.buf for p in parts]), np.concatenate([[0], *[p.off[1:] + e - p.off[-1] for p, e in zip(parts, ends, strict=True)]]))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    """Units of the rows of (key, chunk, text), in the order in which they come."""
    held: list[Unit] = []
    for batch in batches:
        keys, chunks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        buf, off = wordnum.flat(batch.column(2))
        for lo, hi in wordnum.slices(off, UNIT_BYTES // 2):
            cuts = [lo, *(np.flatnonzero(np.diff(chunks[lo:hi])) + lo + 1), hi]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[0].chunk != chunks[a] or sum(len(x.buf) for x in held) + off[b] - off[a] > UNIT_BYTES):
                    yield join_units(held)
                    held = []
                held.append(Unit(int(chunks[a]), keys[a:b], buf[off[a] : off[b]].copy(), off[a : b + 1] - off[a]))
    if held:
        yield join_units(held)


def bucket_bits(hashes: int) -> int:
    """Leading bits that name a bucket, for buckets of at most about ``BUCKET_HASHES`` of that many hashes."""
    return max(0, -(-hashes // BUCKET_HASHES) - 1).bit_length()


def bucketed(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes the buckets that hold any, and where each of them starts, with the end after the last."""
    named = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
    starts = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    return named[starts], np.append(starts, len(own))


def blobs(unit: Unit, hashes: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """Distinct hashes of a unit by bucket; again: bits of those that occur more than once in it."""
    own, count = np.unique(hashes, return_counts=True)
    if not len(own):
        return None
    names, edges = bucketed(own, bits)
    n, ranges = len(names), list(zip(edges, edges[1:], strict=False))
    packed = [own[a:b].tobytes() for a, b in ranges], [np.packbits(count[a:b] > 1).tobytes() for a, b in ranges]
    place = [pa.array([x] * n, pa.int64()) for x in (unit.chunk, int(unit.keys[0]), int(unit.keys[-1]))]
    return pa.RecordBatch.from_arrays([*place, pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["chunk", "lo", "hi", "bucket", "hashes", "again"])


def verdicts(spark: SparkSession, sent: DataFrame) -> DataFrame:
    """For each blob the bits of those hashes that occur at least twice in all units together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []

        def judged() -> pa.RecordBatch:
            parts = [np.frombuffer(r[4], np.uint64) for r in rows]
            again = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=len(p)) for r, p in zip(rows, parts, strict=True)])
            values = np.concatenate(parts)
            order = np.argsort(values)
            ordered = values[order]
            same = ordered[1:] == ordered[:-1]
            twice = again.astype(bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            # a hash that one unit holds more than once, and others once, has another of those beside it
            ends = np.cumsum([len(p) for p in parts])
            bits = [np.packbits(twice[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 4)] + [pa.array(bits, pa.binary())], schema=_MASKS)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[3] != bucket:
                    yield judged()
                    rows = []
                bucket = r[3]
                rows.append(r)
        if rows:
            yield judged()

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, lo long, hi long, bucket long, bits binary")


def with_verdicts(table: DataFrame, masks: DataFrame, process: Callable, schema, extra: list[str]) -> DataFrame:
    """Meet each unit again with its verdicts: process(unit, bits, columns) -> record batches.

    bits: a boolean for each of the unit's distinct hashes in ascending order. columns: the ``extra`` columns' Arrow
    arrays of the unit's rows. Units without hashes come with no bits. Rows stream by in order of chunk and key, so a
    task holds the rows of one unit, at most ``UNIT_BYTES`` and one text, and the verdicts of one chunk, a bit for each
    hash, at a time.
    """
    types = dict(table.dtypes)
    docs = table.select("chunk", F.lit(1).alias("kind"), F.col("key"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "text", *extra)
    told = masks.select("chunk", F.lit(0).alias("kind"), F.col("lo").alias("key"), "hi", "bucket", "bits", F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    both = docs.unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "kind", "key", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, told_of, edges, bits_of = None, {}, None, []
        held, size, place = [], 0, None

        def judge() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                buf, off = wordnum.flat(whole["text"])
                unit = Unit(chunk, whole["key"].to_numpy(), buf, off)
                yield from process(unit, bits_of[place // 2] if place % 2 else [], [whole[c] for c in extra])
                held, size = [], 0

        for batch in batches:
            chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1), len(chunks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    yield from judge()
                    chunk, told_of, edges = int(chunks[a]), {}, None
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    for lo, hi, bucket, bits in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                        told_of.setdefault((lo, hi), []).append((bucket, bits))
                    continue
                if edges is None:  # all verdicts of the chunk are there: its units, and what lies between them
                    edges = np.array([e for lo, hi in sorted(told_of) for e in (lo, hi + 1)], dtype=np.int64)
                    bits_of = [[bits for _, bits in sorted(told_of[u])] for u in sorted(told_of)]
                places = np.searchsorted(edges, part.column(2).to_numpy(), "right")
                ends = [0, *(np.flatnonzero(np.diff(places)) + 1), len(places)]
                for x, y in zip(ends, ends[1:], strict=False):
                    if places[x] != place or (not place % 2 and size > UNIT_BYTES):
                        yield from judge()
                        place = int(places[x])
                    held.append(part.slice(x, y - x))
                    size += held[-1].nbytes
        yield from judge()

    return both.mapInArrow(run, schema)


def flags(hashes: np.ndarray, told: list[bytes], bits: int) -> np.ndarray:
    """For each of a unit's hashes, as they were given to ``blobs``, whether it occurs twice or more in the corpus."""
    own, inverse = np.unique(hashes, return_inverse=True)
    if not len(own):
        return np.zeros(0, dtype=bool)
    _, edges = bucketed(own, bits)
    if len(edges) - 1 != len(told):
        raise RuntimeError("a unit's verdicts do not fit its hashes")
    found = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(told, np.diff(edges), strict=True)]).astype(bool)
    return found[inverse]
