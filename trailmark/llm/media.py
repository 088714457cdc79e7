"""Media columns: payloads in archives of images, and a data source that reads them.

Writing packs payloads losslessly as 8-bit grey images (PNG) into ZIP archives,
one for each task, in a folder that all executors share.  A task writes to a
name of its own and renames at the end, so that a repeated task replaces its
own archive by an equal one.

The data source plans byte ranges over the archives, as many as their sizes
ask for; the driver sees paths and sizes only.  A task reads the directory at
the end of its archive and takes the members that begin in its range.  Members
are read by their offsets, each is checked and retried on its own, and they go
out in Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailmark.llm.common import shared_dir, table

#: Samples in a row of an image; payloads are filled up with spaces to whole rows.
WIDTH = 192
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
SOURCE = "media_archive"
SCHEMA = "archive string, position long, name string, media binary"
_PNG = b"\x89PNG\r\n\x1a\n"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int, level: int = 3) -> bytes:
    """``payload`` (a positive multiple of WIDTH) as rows of grey samples; ``n_bytes`` of them are the text's own."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # a row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Payload and ``n_bytes`` of an image that :func:`encode_png` has made; damage of any kind is a ValueError."""
    if media[:8] != _PNG:
        raise ValueError("not an image")
    at, head, n_bytes, data = 8, None, None, b""
    while at + 12 <= len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    if head is None or n_bytes is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of image")
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes(), n_bytes


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = filesystem(folder)
        name = f"{base}/part-{context.partitionId():06d}.zip"
        draft, n = f"{base}/_draft-{uuid.uuid4().hex}", 0
        out = archive = None
        try:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    if archive is None:
                        out = store.open_output_stream(draft)
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    data = (text.as_py() or "").encode()
                    payload = data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b" ")
                    key = key.as_py()
                    info = zipfile.ZipInfo(f"{n:08d}_{'null' if key is None else key}.png")
                    archive.writestr(info, encode_png(payload, len(data)))
                    n += 1
            if archive is not None:
                archive.close()
                out.close()
                store.move(draft, name)
        except BaseException:
            # a task that fails leaves no draft; one whose executor is lost may, and readers pass over it
            if out is not None and store.get_file_info(draft).type == fs.FileType.File:
                store.delete_file(draft)
            raise
        if archive is not None:
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "members"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every text into archives in ``folder``, a new one; returns (archive, members), which is small.

    A member is named by its place and its id.  Null texts are empty ones, which
    make a row of spaces; a null id is named ``null``; repeated rows are members
    of their own.  Tasks without rows write nothing.  A text of any length is one
    member; other columns of ``docs`` play no part.
    """
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    written = rows.mapInArrow(_packer(folder), "archive string, members long").collect()
    return docs.sparkSession.createDataFrame(written, "archive string, members long")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options ``split_bytes`` and ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, attempts: int):
        self.path, self.split_bytes, self.attempts = path, split_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over all archives of the folder; one that holds nothing if there is none."""
        store, base = filesystem(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and PurePosixPath(f.path).suffix == ".zip"]
        ranges = [ByteRange(f.path, at, at + self.split_bytes) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, self.split_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = filesystem(self.path)
        rows: list[tuple[str, int, str, bytes]] = []
        size = 0
        for member in self._directory(store, partition):
            media = self._member(store, partition.archive, member)
            rows.append((partition.archive, member.header_offset, member.filename, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _retried(self, what: str, read):
        """``read()``; it opens its file anew for every attempt."""
        error: Exception | None = None
        for _ in range(self.attempts):
            try:
                return read()
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                error = e
        raise OSError(f"{what}: {error}") from error

    def _directory(self, store: fs.FileSystem, partition: ByteRange) -> list[zipfile.ZipInfo]:
        def read() -> list[zipfile.ZipInfo]:
            with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as archive:
                return [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]

        return self._retried(f"the directory of {partition.archive}", read)

    def _member(self, store: fs.FileSystem, archive: str, member: zipfile.ZipInfo) -> bytes:
        """The bytes of one member, read at its offset."""

        def read() -> bytes:
            with store.open_input_file(archive) as f:
                f.seek(member.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                name, extra = struct.unpack("<HH", head[26:30])
                f.seek(member.header_offset + 30 + name + extra)
                data = f.read(member.compress_size)
            if zlib.crc32(data) != member.CRC:
                raise ValueError("a damaged member")
            return data

        return self._retried(f"{member.filename} at {member.header_offset} of {archive}", read)


def _batch(rows: list[tuple[str, int, str, bytes]]) -> pa.RecordBatch:
    archive, position, name, media = zip(*rows, strict=True)
    return pa.record_batch([pa.array(archive), pa.array(position, pa.int64()), pa.array(name), pa.array(media, pa.binary())], names=["archive", "position", "name", "media"])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(archive, position, name, media) of all members of the archives in ``folder``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(SOURCE).options(**options).load(folder)


def image_feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash of the image."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    tiles = np.array([t.mean() for band in np.array_split(x.reshape(-1, WIDTH), 8) for t in (np.array_split(band, 8, axis=1) if len(band) else [np.zeros(1)] * 8)])
    bits = "".join("1" if t > tiles.mean() else "0" for t in tiles)
    return f"mean={x.mean():.4f};sd={x.std():.4f};bits={-(share * np.log2(share)).sum():.4f};hash={int(bits, 2):016x}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, media in zip(batch.column("name"), batch.column("media"), strict=True):
            media = media.as_py()
            payload, n_bytes = decode_png(media)
            key = name.as_py().split("_", 1)[1].removesuffix(".png")
            out.append((None if key == "null" else int(key), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(payload)))
        if out:
            ids, *rest = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(members: DataFrame) -> DataFrame:
    """Payload sizes, digests and features of members that :func:`write_archives` has packed with integer ids."""
    return members.select("name", "media").mapInArrow(_features, FEATURES)


def op3_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not urlsplit(folder).scheme and not default.startswith("file:"):
        folder = default.rstrip("/") + folder  # a path without a scheme is one of the cluster's own file system
    write_archives(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return media_features(read_archives(spark, folder))
