import hashlib
import tarfile
import zlib

import pyarrow as pa
import pytest
from pyarrow import fs

from tidemark.llm import media, queries

TEXTS = [None, "", "short", "é" * 32, "x" * 64, "y" * 65, "\x00 zeros \x00", "long " * 60_000, "dup", "dup"]


def test_query_against_the_texts(documents):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    folder, df = documents(rows)
    got = sorted(queries.op9_media(df.sparkSession, folder).collect(), key=str)
    want = []
    for d, t in rows:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_ranges_and_archives(documents, tmp_path):
    rows = [(k, f"text {k} " * (k % 50)) for k in range(500)]
    folder, df = documents(rows)
    path = f"file://{tmp_path}/media"
    media.write(df.repartition(3), path)
    for size in (700, 5000, media.RANGE_BYTES):
        spark = df.sparkSession
        back = spark.read.format("media_archive").option("range_bytes", size).load(path)
        assert sorted((r.doc_id, media.decode_png(r.media)[0]) for r in back.collect()) == [(d, media.payload_of(t)[0]) for d, t in rows]
    members = 0
    for archive in tmp_path.glob("media/*.tar"):
        with tarfile.open(archive) as tar:
            members += len(tar.getmembers())
    assert members == 500


def test_members_are_retried_by_offset(documents, tmp_path, monkeypatch):
    folder, df = documents([(k, f"text {k}") for k in range(5)])
    path = f"file://{tmp_path}/media"
    media.write(df.coalesce(1), path)
    reader = media.MediaReader(path, media.RANGE_BYTES)
    (part,) = reader.partitions()
    failures = [3]

    class Flaky:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, name):
            if name.endswith(".tar") and failures[0]:
                failures[0] -= 1
                raise OSError("lost connection")
            return self.store.open_input_file(name)

    store, at = fs.FileSystem.from_uri(path)
    monkeypatch.setattr(media, "_store", lambda p: (Flaky(store), at))
    got = [x for b in reader.read(part) for x in b.column(1).to_pylist()]
    assert sorted(media.decode_png(x) for x in got) == [media.payload_of(f"text {k}") for k in range(5)] and failures == [0]
    failures[0] = 100
    with pytest.raises(OSError):
        list(reader.read(part))


def contents(spark, path):
    return sorted((r.doc_id, media.decode_png(r.media)[0]) for r in media.read(spark, path).collect())


def test_append_and_overwrite(documents, tmp_path):
    folder, df = documents([(k, f"text {k}") for k in range(6)])
    path, spark = f"file://{tmp_path}/media", df.sparkSession
    payload = lambda ks: [(k, media.payload_of(f"text {k}")[0]) for k in ks]
    media.write(df.where("doc_id < 2"), path)
    media.write(df.where("doc_id = 2"), path)
    assert contents(spark, path) == payload(range(3))
    media.write(df.where("doc_id >= 4").withColumn("media", df.text), path, "overwrite")
    assert contents(spark, path) == payload((4, 5))
    media.write(df.where("doc_id = 0"), path)
    assert contents(spark, path) == payload((0, 4, 5))
    media.write(df.limit(0), path, "overwrite")
    assert contents(spark, path) == []
    writer = media.MediaWriter(path, False)
    message = writer.write(iter(df.select("doc_id", "text").toArrow().to_batches()))
    writer.abort([message, None])
    assert not list(tmp_path.glob(f"media/{message.name}*")) and contents(spark, path) == []


def test_a_damaged_member_is_read_again(documents, tmp_path, monkeypatch):
    folder, df = documents([(k, f"text {k}") for k in range(5)])
    path = f"file://{tmp_path}/media"
    media.write(df.coalesce(1), path)
    reader = media.MediaReader(path, media.RANGE_BYTES)
    (part,) = reader.partitions()
    store, at = fs.FileSystem.from_uri(path)
    damaged = [1]

    class Flipping:
        def open_input_file(self, name):
            f = store.open_input_file(name)
            if not name.endswith(".tar") or not damaged[0]:
                return f
            damaged[0] -= 1
            data = bytearray(f.read())
            data[560] ^= 4  # in the first member, and in the second
            data[1580] ^= 4
            return pa.BufferReader(bytes(data))

    monkeypatch.setattr(media, "_store", lambda p: (Flipping(), at))
    got = [x for b in reader.read(part) for x in b.column(1).to_pylist()]
    assert sorted(media.decode_png(x) for x in got) == [media.payload_of(f"text {k}") for k in range(5)] and damaged == [0]
    damaged[0] = 100
    with pytest.raises(OSError, match="member at"):
        list(reader.read(part))


def test_damage_and_empty_table(documents):
    data = media.encode_png(*media.payload_of("some text"))
    with pytest.raises(OSError):
        media.decode_png(data[:60] + bytes([data[60] ^ 1]) + data[61:])
    folder, df = documents([])
    assert queries.op9_media(df.sparkSession, folder).count() == 0
