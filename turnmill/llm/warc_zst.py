"""Operator 6: WARC archives, compressed record by record with a dictionary made from the archived records.

A file begins with a skippable Zstandard frame (magic 0x184D2A5D) that holds the dictionary; then each record is a frame of its
own that refers to it. Of records with equal payloads of at least LEAST bytes the one with the largest page_id is the response
and the others revisit it; payloads are compared by SHA-256 and length. The owners are found by a partial aggregation and come
back by a skewed join.

The dictionary is trained on SAMPLE records at most (by hash of page_id), PART bytes of each at most. With too little to train
on, the sample itself is the dictionary; an empty table leaves none and no files. Files are written under a new name and
renamed, so a repeated task replaces them; only files that their task has told are read.

Null payloads are empty, null URLs leave their header out. A null page_id is smaller than any other and is told as "null".
Rows that repeat the largest page_id with an equal payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import chunks, prepared, scratch

LEAST, SAMPLE, PART, DICTIONARY, FILE_BYTES, MAGIC = 1000, 800, 16_384, 64 * 1024, 64_000_000, 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
_NAME = "urn:turnmill:page:"


def _slim(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, record_type, refers_to."""
    rows = _slim(pages).withColumn("size", F.octet_length("html")).withColumn("key", F.sha2("html", 256))
    owners = rows.filter(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return rows.join(owners, ["key", "size"], "left").select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("owner")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<{_NAME}{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(rows: DataFrame, sample: int = SAMPLE, part: int = PART, size: int = DICTIONARY) -> bytes:
    """From a bounded number of records, each cut to a bounded length."""
    import zstandard as zstd

    ids = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()  # numbers only
    few = rows.filter(F.col("page_id").isin([r.page_id for r in ids if r.page_id is not None])).select("page_id", "url", F.substring("html", 1, part).alias("html")).limit(sample).collect() if ids else []
    records = sorted(record(r.page_id, r.url, r.html.encode()[:part], "response", None) for r in few)
    if not records:
        return b""
    try:
        return zstd.train_dictionary(size, records, k=512, d=8).as_bytes()
    except zstd.ZstdError:  # too few or too small
        return b"".join(records)[-size:]


def _write(target: str, words: bytes, level: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        use = zstd.ZstdCompressionDict(words) if words else None
        press = zstd.ZstdCompressor(level=level, dict_data=use, write_content_size=True, write_checksum=True)
        rows = ((i, u, h.encode(), k, r) for b in chunks(batches, "html") for i, u, h, k, r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to"))))
        shard, made = TaskContext.get().partitionId(), []
        row = next(rows, None)
        while row is not None:
            path, n, size = f"{target}/part-{shard:05d}-{len(made):04d}.warc.zst", 0, 0
            with files.whole(path) as put:
                if words:
                    put(struct.pack("<II", MAGIC, len(words)) + words)
                while row is not None and size < most:
                    frame = press.compress(record(*row))
                    put(frame)
                    n, size = n + 1, size + len(frame)
                    row = next(rows, None)
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "n": [m[1] for m in made], "size": [m[2] for m in made]}, pa.schema([("path", pa.string()), ("n", pa.int64()), ("size", pa.int64())]))

    return run


def write(pages: DataFrame, target: str | None = None, least: int = LEAST, level: int = 3, most: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Write the archives; returns path, number of records and compressed bytes of each, a row for each file."""
    spark = prepared(pages.sparkSession)
    target = target or scratch(spark, "warc")
    rows = planned(pages, least)
    words = dictionary(_slim(pages))
    return sorted(map(tuple, rows.mapInArrow(_write(target, words, level, most), "path string, n long, size long").collect()))


def frames(stream: io.RawIOBase, size: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one at a time: reads the dictionary, then a frame after the other."""
    import zstandard as zstd

    held = stream.read(8)
    use = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == MAGIC:
        use, held = zstd.ZstdCompressionDict(stream.read(struct.unpack("<I", held[4:])[0])), b""
    press = zstd.ZstdDecompressor(dict_data=use)
    held += stream.read(size)
    while held:
        one, out = press.decompressobj(), []
        while True:
            out.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = stream.read(size)
            if not held:
                raise ValueError("the archive ends inside a record")
        yield b"".join(out)
        if not held:
            held = stream.read(size)


def parsed(said: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to of a record; a response's payload must have its digest."""
    head, _, rest = said.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: None if (x := fields.get(name, "<null>").strip("<>").removeprefix(_NAME)) == "null" else int(x)
    return number("WARC-Record-ID"), size, digest.hex(), fields["WARC-Type"], number("WARC-Refers-To")


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            fs, at = files.opened(path)
            with fs.open_input_stream(at, compression=None) as stream:
                some = []
                for said in frames(stream):
                    some.append(parsed(said))
                    if len(some) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), READ.types)], schema=READ)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), READ.types)], schema=READ)


def read(spark: SparkSession, written: list[tuple[str, int, int]]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives."""
    prepared(spark)
    paths = spark.createDataFrame([(p,) for p, *_ in written], "path string").repartition(max(1, len(written)))
    return paths.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
