"""Removal of long word sequences that occur more than once, with a count-min prefilter.

First pass: each partition counts, in a count-min sketch, the places that stand for its windows; the sketches are
merged. A window is stood for by the place of its least eight-word shingle, so that overlapping windows share a count.
Equal windows choose equal places, so the merged estimate is never below the number of a window's occurrences.
Second pass: only windows whose estimate is two or more are grouped, exactly, over the whole corpus; every window that
does occur again is among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import exchange, scratch, wordnum
from quillon.llm.wordnum import Words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
BLOCK = 20  # cells of a block, as a power of two
MOST_BITS = 28  # two rows of 2**28 bits, 64 MB in all, are the largest sketch that is sent to executors


def cells(places: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((places * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


class WindowPlaces:
    """Windows of k words in a slice of texts: start, and hash of the least shingle with its place."""

    def __init__(self, words: Words, k: int, shingle: int):
        h = words.hashes()
        self.start = wordnum.inside(words, k)
        self.h = h
        if not len(self.start):
            self.place = np.zeros(0, np.int64)
            return
        least, at, span, most = wordnum.windows(h, shingle, 1), None, 1, k - shingle + 1
        at = np.arange(len(least))
        self.shingles = least
        while span < most:
            step = min(span, most - span)
            take = least[step:] < least[:-step]  # the first of equal shingles is chosen
            at = np.where(take, at[step:], at[:-step])
            least = np.where(take, least[step:], least[:-step])
            span += step
        self.place = at[self.start]

    def chosen(self) -> np.ndarray:
        """Hash of each place that stands for windows, once for each place."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        return self.shingles[self.place[np.append(True, self.place[1:] != self.place[:-1])]]

    def candidates(self, sketch: list[np.ndarray], bits: int) -> np.ndarray:
        """Starts of the windows that are estimated to occur twice or more."""
        if not len(self.start):
            return self.start
        first = np.append(True, self.place[1:] != self.place[:-1])
        hashes = self.shingles[self.place[first]]
        ok = np.ones(len(hashes), dtype=bool)
        for row, packed in enumerate(sketch):
            c = cells(hashes, row, bits)
            ok &= (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return self.start[ok[np.cumsum(first) - 1]]


def sketched(spark: SparkSession, table: DataFrame, k: int, shingle: int, bits: int) -> list[np.ndarray]:
    """Bits of the cells whose merged count is two or more, for each of two rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            buf, off = wordnum.flat(batch.column(0))
            for lo, hi in wordnum.slices(off):
                found.append(WindowPlaces(Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), k, shingle).chosen())
        places = np.concatenate(found) if found else np.zeros(0, np.uint64)
        for row in range(2):
            own, n = np.unique(cells(places, row, bits), return_counts=True)
            edges = np.searchsorted(own, np.arange(0, (1 << bits) + 1, 1 << min(BLOCK, bits)))
            for block, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    local, many = (own[a:b] - (block << BLOCK)).astype(np.uint32), n[a:b] > 1
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([local[~many].tobytes()], pa.binary()), pa.array([local[many].tobytes()], pa.binary())], names=["row", "block", "once", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = None, 1 << min(BLOCK, bits)
        seen, twice = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for row, block, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, block) != at:
                    if at:
                        yield out()
                    at = (row, block)
                    seen[:] = twice[:] = False
                own = np.frombuffer(once, np.uint32)
                twice[own[seen[own]]] = True
                seen[own] = True
                twice[np.frombuffer(more, np.uint32)] = True
                seen[np.frombuffer(more, np.uint32)] = True
        if at:
            yield out()

    parts = table.select("text").mapInArrow(count, "row int, block int, once binary, more binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    sketch = [np.zeros(max(1, 1 << (bits - 3)), dtype=np.uint8) for _ in range(2)]
    for r in merged.toLocalIterator():  # 2**(bits - 2) bytes in all, whatever the corpus
        own = np.frombuffer(r["bits"], np.uint8)
        at = r["block"] << (BLOCK - 3)
        sketch[r["row"]][at : at + len(own)] = own
    return sketch


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = 35, shingle: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each word that lies in a ``window``-word sequence which also starts anywhere else in the corpus.

    Windows are judged on the input, copies in the same document included. Returns doc_id, n_words, n_removed and
    text: the kept words joined by one space. A null or empty text has no words and comes back empty; texts shorter
    than a window are kept whole; rows that repeat count as further occurrences of their windows, with any id, null
    too; an empty table gives none; other columns are not read.
    """
    table = exchange.keyed(spark, docs, id_column, text_column)
    size = table.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(1, size) / 10)))))  # about eight cells for each place
    named = exchange.bucket_bits(size // 12)
    shared = spark.sparkContext.broadcast(sketched(spark, table, window, shingle, bits))

    def places(unit: exchange.Unit) -> list[tuple[Words, np.ndarray, np.ndarray, int, int]]:
        out = []
        for lo, hi in wordnum.slices(unit.off):
            words = Words(unit.buf[unit.off[lo] : unit.off[hi]], unit.off[lo : hi + 1] - unit.off[lo])
            found = WindowPlaces(words, window, shingle)
            at = found.candidates(shared.value, bits)
            out.append((words, at, wordnum.windows(found.h, window)[at] if len(at) else np.zeros(0, np.uint64), lo, hi))
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in exchange.units(batches):
            if (batch := exchange.blobs(unit, np.concatenate([x[2] for x in places(unit)]), named)) is not None:
                yield batch

    def cut(unit: exchange.Unit, bits_of: list[bytes], columns: list[pa.ChunkedArray]) -> Iterator[pa.RecordBatch]:
        found = places(unit)
        again = exchange.flags(np.concatenate([x[2] for x in found]), bits_of, named)
        done = 0
        for words, at, own, lo, hi in found:
            at = at[again[done : done + len(own)]]
            done += len(own)
            depth = np.zeros(len(words.start) + 1, dtype=np.int32)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + window, -1)
            kept = np.cumsum(depth)[:-1] == 0
            text = kept_text(words, kept)
            removed = np.add.reduceat(np.append(~kept, False).astype(np.int64), np.minimum(words.first[:-1], len(kept))) * (words.n > 0)
            ids = pa.chunked_array(columns[0]).combine_chunks() if not isinstance(columns[0], pa.Array) else columns[0]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(words.n.astype(np.int64)), pa.array(removed), text.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    sent = table.select("key", "chunk", "text").mapInArrow(send, exchange.BLOBS)
    schema = T.StructType([T.StructField("doc_id", table.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    return exchange.with_verdicts(table, exchange.verdicts(spark, sent), cut, schema, ["doc_id"])


def kept_text(words: Words, kept: np.ndarray) -> pa.Array:
    """Kept words of each text joined by one space."""
    depth = np.zeros(len(words.buf) + 1, dtype=np.int8)
    depth[words.start[kept]] += 1
    np.add.at(depth, words.end[kept], -1)
    keep = np.cumsum(depth[:-1], dtype=np.int8).astype(bool) if len(words.buf) else np.zeros(0, bool)
    out = words.buf.copy()
    doc = words.doc()[kept]
    glue = words.end[kept][:-1][doc[1:] == doc[:-1]]  # the byte after each kept word that another one follows
    keep[glue] = True
    out[glue] = 0x20
    sizes = np.append(0, np.cumsum(keep))
    return wordnum.strings(out[keep], sizes[words.off])


def op3_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH whole AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM whole),
windowed AS (SELECT k, i, w, string_agg(w, ' ') OVER f AS x, count(*) OVER f AS n FROM word WINDOW f AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
counted AS (SELECT k, i, w, (n = 35 AND count(*) OVER (PARTITION BY n, x) > 1)::INT AS again FROM windowed),
covered AS (SELECT k, i, w, max(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT k, sum(gone)::BIGINT AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS text FROM covered GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM whole LEFT JOIN kept USING (k)
"""
