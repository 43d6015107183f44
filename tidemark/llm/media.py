"""A data source for archives of media members: byte-range partitions, Arrow streams, retried members.

A dataset is a folder of tar archives, one for each writing task, each with an index of its members
(number, offset, bytes) beside it, and a manifest for each commit, which names the archives that it
adds and, if it overwrites, the manifests that it replaces. A reader plans byte ranges from the
archives' sizes alone; a task looks up the members that begin in its range and streams them in Arrow
batches of bounded bytes. A member that is short or fails its checksums is read again on its own, by
its offset from the archive opened anew, ``TRIES`` times; if that fails too, the error names archive
and offset and the task fails, to be run again by Spark; no member is left out. Paths go through Arrow's file systems, so any store that Arrow opens will do.

The members are PNG images, 64 grey samples of 8 bits in a row, whose samples are the payload: a
text's UTF-8 bytes and zeros up to a positive multiple of 64. The unpadded size is in a text chunk.

Defined results: a null text is stored as empty; a null ``doc_id`` is stored as null; repeated rows
are members each; an empty table reads back empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import small_batches

WIDTH = 64
#: Bytes of a reading task's range and of one Arrow batch; tries of a member.
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("offset", "<i8"), ("size", "<i8")])
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with zeros up to a positive multiple of 64, their number without the zeros)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0"), len(data)


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey 8-bit PNG whose samples are ``payload``."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # the first byte of a row: no filter
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of a PNG that ``encode_png`` made; its checksums are checked."""
    if data[:8] != _PNG:
        raise OSError("not a PNG member")
    at, size, packed = 8, 0, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise OSError("damaged PNG member")
        if kind == b"tEXt":
            size = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, WIDTH + 1)
    return np.ascontiguousarray(rows[:, 1:]).tobytes(), size


def check_png(data: bytes) -> None:
    """Raise ``OSError`` unless the chunks' checksums hold and the last one ends the image and the bytes."""
    at, kind = 8, b""
    if data[:8] != _PNG:
        raise OSError("not a PNG member")
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        end = at + 8 + n
        if end + 4 > len(data) or struct.unpack_from(">I", data, end)[0] != zlib.crc32(memoryview(data)[at + 4 : end]):
            raise OSError("damaged PNG member")
        at = end + 4
    if kind != b"IEND" or at != len(data):
        raise OSError("incomplete PNG member")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


class Archived(WriterCommitMessage):
    def __init__(self, name: str, size: int):
        self.name, self.size = name, size


_MANIFEST = "_manifest-"


def _manifests(store: fs.FileSystem, folder: str) -> dict[str, tuple[list[str], list[tuple[str, int]]]]:
    """Manifests in force by name, each with the names it replaces and its archives with their sizes."""
    found: dict[str, tuple[list[str], list[tuple[str, int]]]] = {}
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith(_MANIFEST):
            with store.open_input_file(info.path) as f:
                read = json.loads(f.read())
            found[info.base_name] = read["replaces"], [tuple(x) for x in read["archives"]]
    gone = {name for replaces, _ in found.values() for name in replaces}
    return {name: found[name] for name in sorted(found) if name not in gone}


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archived:
        store, folder = _store(self.path)
        name, index = uuid.uuid4().hex, []
        with store.open_output_stream(f"{folder}/{name}.tar") as out:
            at = 0
            for batch in iterator:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = encode_png(*payload_of(text))
                    info = tarfile.TarInfo(f"{len(index)}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    index.append((doc or 0, doc is not None, at + len(head), len(data)))
                    whole = head + data + bytes(-len(data) % 512)
                    out.write(whole)
                    at += len(whole)
            out.write(bytes(1024))
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.array(index, dtype=_INDEX).tobytes())
        return Archived(name, at)

    def commit(self, messages: list[Archived | None]) -> None:
        store, folder = _store(self.path)
        old = _manifests(store, folder) if self.overwrite else {}
        whole = {"replaces": sorted(old), "archives": [[m.name, m.size] for m in messages if m is not None]}
        with store.open_output_stream(f"{folder}/{_MANIFEST}{uuid.uuid4().hex}") as out:
            out.write(json.dumps(whole).encode())
        for _, archives in old.values():  # readers no longer see them
            for name, _ in archives:
                self._delete(store, folder, name)

    def abort(self, messages: list[Archived | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                self._delete(store, folder, m.name)

    @staticmethod
    def _delete(store: fs.FileSystem, folder: str, name: str) -> None:
        for end in ("tar", "idx"):
            store.delete_file(f"{folder}/{name}.{end}")


class Range(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


def read_member(store: fs.FileSystem, path: str, offset: int, size: int, tries: int = TRIES) -> bytes:
    """One member by its offset; a failed read opens the archive anew, other members are untouched."""
    for left in reversed(range(tries)):
        try:
            with store.open_input_file(path) as f:
                data = f.read_at(size, offset)
            if len(data) != size:
                raise OSError(f"{len(data)} of {size} bytes")
            check_png(data)
            return data
        except OSError as e:
            if not left:
                raise OSError(f"member at {offset} of {path}: {e}") from e
            time.sleep(0.2)
    raise AssertionError


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        archives = [x for _, found in _manifests(*_store(self.path)).values() for x in found]
        return [Range(name, k, min(k + self.range_bytes, size)) for name, size in archives for k in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), dtype=_INDEX)
        lo, hi = np.searchsorted(index["offset"], [partition.begin, partition.end])
        path = f"{folder}/{partition.name}.tar"
        while lo < hi:
            upto = lo + max(1, int(np.searchsorted(np.cumsum(index["size"][lo:hi]), BATCH_BYTES)))
            some = index[lo:upto]
            first, last = int(some["offset"][0]), int(some["offset"][-1] + some["size"][-1])
            try:
                with store.open_input_file(path) as f:
                    block = f.read_at(last - first, first)
            except OSError:
                block = b""  # each member is then read on its own
            members = []
            for offset, size in zip(some["offset"].tolist(), some["size"].tolist(), strict=True):
                data = block[offset - first : offset - first + size]
                try:
                    check_png(data)
                except OSError:
                    data = read_member(store, path, offset, size)
                members.append(data)
            ids = pa.array(some["doc_id"], mask=some["known"] == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(members, pa.binary())], names=["doc_id", "media"])
            lo = upto


class MediaArchive(DataSource):
    """Format ``media_archive``: writes ``(doc_id, text)``, reads ``(doc_id, media)``; options ``path``, ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema: object) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: object, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], overwrite)


def write(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Store the whole texts of ``docs`` as members of archives under ``path``, beside or (``overwrite``) instead of others."""
    docs.sparkSession.dataSource.register(MediaArchive)
    small_batches(docs).select(F.col("doc_id").cast("long"), "text").write.format("media_archive").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, media)`` of all members under ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


def feature(payload: bytes) -> str:
    """16 hex digits: in which of the 64 columns the mean sample is above the whole mean."""
    means = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH).mean(axis=0)
    return np.packbits(means > means.mean()).tobytes().hex()


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        cols: list[list] = [[] for _ in names[1:]]
        for member in batch.column(1):
            data = member.as_buffer().to_pybytes()
            payload, size = decode_png(data)
            row = (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)


def features(media: DataFrame) -> DataFrame:
    """Digests and a feature of each member, from the stored bytes."""
    return small_batches(media).select("doc_id", "media").mapInArrow(
        _feature_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
