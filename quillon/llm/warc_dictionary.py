"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own archive.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then a frame for each record, so any record
can be read by itself. The dictionary is built from the archive's own records before any of them is compressed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import scratch

DICTIONARY_FRAME = 0x184D2A5D
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f0b1f0e-5a0c-4a0e-9a52-0d1c7f2d8f11")


def record_id(row_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{row_id}/{digest}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with only its HTTP head, which keeps the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:quillon:no-url"
    headers = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(row_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if row_id is not None:
        headers.append(("Quillon-Row-Id", str(row_id)))
    if is_revisit:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, digest)), ("Quillon-Refers-To-Row", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http if is_revisit else http + payload)


def dictionary(records: list[bytes], size: int, sample: int) -> zstandard.ZstdCompressionDict:
    """Trained on evenly spaced records of up to ``sample`` bytes; where these are too few to train on, their raw bytes."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), chosen)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], *, dictionary_size: int = 32 << 10, sample: int = 2 << 20, level: int = 3) -> bytes:
    own = dictionary(records, dictionary_size, sample)
    data = own.as_bytes()
    compress = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *map(compress, records)])


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    at = 8 + size
    while at < len(content):
        reader, parts, step = decompress.decompressobj(), [], 4096
        while not reader.eof:
            if at >= len(content):
                raise ValueError("an archive's last frame is cut short")
            parts.append(reader.decompress(content[at : at + step]))
            at, step = min(len(content), at + step), 2 * step
        at -= len(reader.unused_data)
        data = b"".join(parts)
        head, _, tail = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, tail[: int(headers["Content-Length"])]


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, archive_bytes: int = 16 << 20, dictionary_size: int = 32 << 10, sample: int = 2 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into archives of about ``archive_bytes`` uncompressed bytes under ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are responses and the
    others revisits of it; smaller payloads are all responses. A null payload is empty; null ids count as smallest and
    rows that share id and payload are written once each, alike; a null url becomes a fixed URN. Every attempt of a task
    writes files of its own, which appear under their names only when whole; ``folder``/manifest, which Spark commits,
    names those of the attempts that count. Returns it: path, records, bytes and raw_bytes of the archives; an empty
    table writes none. ``folder`` is a URI that Spark and pyarrow's file systems can open on every executor.
    """
    rows = pages.select(F.col(id_column).alias("row_id"), F.col(url_column).alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha1(F.col("payload").cast("binary")))))
    last = keyed.select("digest", "row_id").where("digest is not null").groupBy("digest").agg(F.max("row_id").alias("last_id"))
    todo = keyed.join(last, "digest", "left").select("row_id", "url", "payload", "last_id")
    where, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        held: list[bytes] = []
        size, number = 0, 0
        store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))

        def flush() -> pa.RecordBatch:
            name = f"part-{at.partitionId():06d}-{number:04d}-{at.taskAttemptId()}.warc.zst"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            data = archive([info, *held], dictionary_size=dictionary_size, sample=sample, level=level)
            tries = f"{root}/_tries-{name}"
            with store.open_output_stream(tries) as out:
                out.write(data)
            store.move(tries, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(held), "bytes": len(data), "raw_bytes": size}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("raw_bytes", pa.int64())]))

        for batch in batches:
            for row, url, payload, last_id in zip(*(batch.column(i) for i in range(4)), strict=True):
                row, last_id = row.as_py(), last_id.as_py()
                revisit = last_id is not None and row != last_id
                held.append(page_record(row, url.as_py(), payload.as_py().encode(), last_id, revisit, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    todo.mapInArrow(run, "path string, records long, bytes long, raw_bytes long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record of the archives that the manifest in ``folder`` names: row_id, type, url, payload_bytes,
    payload_digest, refers_to, payload (null for revisits), digest_ok.

    Files that it doesn't name, such as those of lost attempts, are not read; an empty manifest gives no rows. A null id
    comes back as null, a null payload as an empty one, and of rows that repeat each record comes back.
    """
    schema = pa.schema([("row_id", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
                with store.open_input_stream(name) as file:
                    content = file.read()
                for head, block in records_of(content):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    ok = len(payload) == length and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if response else None
                    rows.append({"row_id": int(x) if (x := head.get("Quillon-Row-Id")) else None, "type": head["WARC-Type"], "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "refers_to": None if response else int(head["Quillon-Refers-To-Row"]), "payload": payload if response else None, "digest_ok": ok})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.parquet(f"{folder}/manifest").select("path").repartition("path")
    return files.mapInArrow(run, T.StructType([T.StructField(f.name, {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType(), pa.bool_(): T.BooleanType()}[f.type]) for f in schema]))


def op2_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.folder(spark, "warc")
    write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least_bytes=0)
    back = read_archives(spark, folder)
    checked = back.withColumn("payload_digest", F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload read back differs from its digest"))))
    return checked.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP2_SQL = r"""
WITH payload AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
owner AS (SELECT hex, max(page_id) AS owner FROM payload GROUP BY hex)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM payload JOIN owner USING (hex)
"""
