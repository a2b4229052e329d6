"""Media columns: payloads stored as PNG members of tar shards, addressed by their content.

Each task appends the media that it hasn't stored yet to a shard of its own, named at random so that a repeated task
never touches another's file; the manifest that Spark commits names only the shards of tasks that succeeded. A
manifest row carries digest (SHA-256 of the stored medium), shard, offset and length. Metadata columns come from reads
of the 33 header bytes alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import shared_dir, whole

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADERS = "width int, height int, bit_depth int, colour int"
CONTENT = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def padded(text: bytes, width: int = WIDTH) -> bytes:
    """``text`` filled with bytes 255 up to a positive multiple of ``width``."""
    return text + b"\xff" * (-len(text) % width if text else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale image of ``width`` columns, a sample for each byte; equal payloads give equal files."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)  # each row after a zero: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    if head[:8] != SIGNATURE:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(medium: bytes) -> bytes:
    """The samples of an image made by ``to_png``."""
    width, height, _, _ = png_header(medium[:HEADER_BYTES])
    at, data = 8, []
    while at < len(medium):
        (size,) = struct.unpack(">I", medium[at : at + 4])
        kind, body = medium[at + 4 : at + 8], medium[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", medium[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and the mean step between neighbours."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    step = np.abs(np.diff(samples.astype(np.int16))).mean()
    return f"mean={samples.mean():.4f};sd={samples.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Shard:
    """A tar file under construction."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        system, path = _file_system(self.uri)
        self.out, self.size, self.known = system.open_output_stream(path), 0, {}

    def put(self, medium: bytes) -> tuple[str, int, int]:
        digest = hashlib.sha256(medium).hexdigest()
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(medium)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + medium + b"\0" * (-len(medium) % 512))
            self.known[digest] = self.size + len(head)
            self.size += len(head) + len(medium) + -len(medium) % 512
        return digest, self.known[digest], len(medium)

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store_media(docs: DataFrame, folder: str, *, shard_bytes: int = 1 << 30) -> DataFrame:
    """Stores every whole text as a medium below ``folder`` and returns the manifest, read from there.

    Null texts count as empty (a payload of 576 bytes 255). Equal texts of one shard share a member. Repeated rows get a
    manifest row each; an empty table gives an empty manifest and no shard.
    """
    spark = docs.sparkSession
    system, path = _file_system(f"{folder}/shards")
    system.create_dir(path, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = shard or _Shard(f"{folder}/shards")
                raw = text.as_buffer().to_pybytes()
                digest, offset, length = shard.put(to_png(padded(raw)))
                rows.append((key, len(raw), digest, shard.uri, offset, length))
                if shard.size >= shard_bytes:
                    shard.close()
                    shard = None
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])
        if shard:
            shard.close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    source.mapInArrow(put, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Reader:
    """Ranges of the shard read last."""

    def __init__(self):
        self.uri = self.file = None

    def read(self, uri: str, offset: int, size: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            system, path = _file_system(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(size, offset)


def _with_reads(manifest: DataFrame, schema: str, read) -> DataFrame:
    """Adds the columns that ``read(reader, shard, offset, length)`` returns, once for rows in a row that share a member.

    Rows are dealt out by shard and by stretches of it, so a shard with many rows is read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, got = _Reader(), None, None
        for batch in batches:
            rows = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if place != last:
                    last, got = place, read(reader, *place)
                rows.append(got)
            more = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(more, kinds, strict=True))], [*batch.schema.names, *names])

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, kinds = zip(*((n, arrow[k]) for n, k in (c.split() for c in schema.split(", "))), strict=True)
    spread = manifest.withColumn("_stretch", F.floor(F.col("offset") / (4 << 20)))
    spread = spread.repartition("shard", "_stretch").sortWithinPartitions("shard", "offset").drop("_stretch")
    return spread.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema) + f", {schema}")


def header_columns(manifest: DataFrame) -> DataFrame:
    """``manifest`` with width, height, bit_depth and colour, from range reads of the headers only."""
    return _with_reads(manifest, HEADERS, lambda reader, shard, offset, _: png_header(reader.read(shard, offset, HEADER_BYTES)))


def read_media(manifest: DataFrame) -> DataFrame:
    """``manifest`` with header columns and with digests and features of the stored bytes, read back and decoded."""

    def read(reader: _Reader, shard: str, offset: int, length: int) -> tuple:
        header = png_header(reader.read(shard, offset, HEADER_BYTES))
        medium = reader.read(shard, offset, length)
        payload = from_png(medium)
        return (*header, len(medium), hashlib.sha256(medium).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(payload))

    return _with_reads(manifest, f"{HEADERS}, {CONTENT}", read)


def payload_of(manifest_row) -> bytes:
    """The payload of one manifest row, for callers on the driver."""
    return from_png(_Reader().read(manifest_row["shard"], manifest_row["offset"], manifest_row["length"]))


def members(shard: str) -> list[str]:
    """The names in a shard, as any tar reader sees them."""
    system, path = _file_system(shard)
    with system.open_input_stream(path) as stream, tarfile.open(fileobj=io.BytesIO(stream.read())) as tar:
        return tar.getnames()


def media_of_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the texts of ``docs`` and reads them back: the manifest with header, digest and feature columns."""
    return read_media(store_media(docs, folder or shared_dir(docs.sparkSession)))
