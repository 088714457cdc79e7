import math
import random
from collections import Counter
import glob
import hashlib
import os
import zlib

import pyarrow as pa
import pytest

from trailmark.llm import media as d


def test_png_round_trip_and_damage():
    payload = os.urandom(192 * 7)
    media = d.encode_png(payload, 1000)
    assert d.decode_png(media) == (payload, 1000)
    for i in (3, 20, 60, len(media) - 20):
        broken = bytearray(media)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            d.decode_png(bytes(broken))


def test_texts_come_back_whole(spark, tmp_path):
    texts = [None, "", "é" * 96, "x" * 192, "y" * 193, "long " * 60000, "a", "a"]
    docs = spark.createDataFrame([(None if i == 1 else i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, name string").repartition(3)
    folder = str(tmp_path / "media")
    assert sum(r.members for r in d.write_archives(docs, folder).collect()) == 8
    rows = {r.doc_id: r for r in d.media_features(d.read_archives(spark, folder, split_bytes=200)).collect()}
    assert len(rows) == 8 and d.read_archives(spark, folder, split_bytes=200).rdd.getNumPartitions() > 3
    for i, t in enumerate(texts):
        r, data = rows[None if i == 1 else i], (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert rows[6][3:] == rows[7][3:] and rows[0][3:] == rows[None][3:]


def test_members_are_retried_by_offset(spark, tmp_path, monkeypatch):
    d.write_archives(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").coalesce(1), str(tmp_path))
    reader = d.ArchiveReader(str(tmp_path), 1 << 20, 3)
    calls = []

    class Flaky(pa.fs.LocalFileSystem):
        def open_input_file(self, path, **kw):
            calls.append(path)
            if len(calls) in (2, 4, 5):
                raise OSError("lost")
            return super().open_input_file(path, **kw)

    monkeypatch.setattr(d, "filesystem", lambda path: (Flaky(), path))
    [part] = reader.partitions()
    names = [x for b in reader.read(part) for x in b.column("name").to_pylist()]
    assert len(names) == 2 and len(calls) == 6
    path = glob.glob(f"{tmp_path}/*.zip")[0]
    broken = bytearray(open(path, "rb").read())
    broken[80] ^= 1
    open(path, "wb").write(bytes(broken))
    with pytest.raises(OSError):
        list(d.ArchiveReader(str(tmp_path), 1 << 20, 2).read(part))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert d.write_archives(docs, str(tmp_path / "x")).count() == 0
    assert d.media_features(d.read_archives(spark, str(tmp_path / "x"))).count() == 0


def test_query(spark):
    rows = d.op3_media_archive(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in docs.items()}


def naive_feature(payload):
    """The features by plain Python."""
    n = len(payload)
    mean = sum(payload) / n
    deviation = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    bits = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    rows = [payload[i : i + d.WIDTH] for i in range(0, n, d.WIDTH)]
    size, extra = divmod(len(rows), 8)
    tiles, at = [], 0
    for k in range(8):
        band = rows[at : at + size + (k < extra)]
        at += len(band)
        for c in range(8):
            some = [x for r in band for x in r[c * d.WIDTH // 8 : (c + 1) * d.WIDTH // 8]]
            tiles.append(sum(some) / len(some) if some else 0.0)
    middle = sum(tiles) / 64
    return f"mean={mean:.4f};sd={deviation:.4f};bits={bits:.4f};hash={int(''.join('1' if t > middle else '0' for t in tiles), 2):016x}"


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, None), (1, ""), (2, "é" * 200), (3, "".join(chr(rng.randint(32, 1000)) for _ in range(5000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in d.op3_media_archive(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        media = d.encode_png(payload, len(data))
        assert d.decode_png(media) == (payload, len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), naive_feature(payload))
