import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import resampling
from trailmark.llm.registry import oracle_sql, queries

NAME = "op11_importance_resampling"


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def runs(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in runs(x, n):
                counts[bucket(f)] += 1
    out = []
    for doc, text in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in map(bucket, runs(text, n)))
        name = str(doc) if doc is not None else "null:" + hashlib.sha256((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(runs(text, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for r, x in enumerate(may[: len(may) * percent // 100], 1):
        x[4] = r
    return sorted((tuple(x[:5]) for x in out), key=str)


def drawn(spark, docs, target, **kw):
    df = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), **kw)
    return sorted((tuple(r) for r in df.select("doc_id", "_n_features", "_weight", "_score", "_rank").collect()), key=str)


def test_sql(spark):
    same(spark, queries()[NAME], oracle_sql()[NAME], "/root/testdata/sf0.001")


@pytest.mark.parametrize("n", [1, 3])
def test_chunks_make_no_difference(spark, n):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Über", "the", "a1", "x" * 90, "naïve", "B-c"], size=k)) for k in (0, 1, 2, 25, 400, 3000)]
    docs = [*enumerate(texts), (None, texts[3]), (None, texts[4]), (None, None), (9, ""), (8, "- " * 300), (3, texts[3]), (3, texts[3])]
    want = brute(docs, texts[2:4], n, percent=50)
    assert drawn(spark, docs, texts[2:4], n=n, percent=50) == want
    assert drawn(spark, docs, texts[2:4], n=n, percent=50, limit=100) == want
    assert sum(r[4] is not None for r in want) == 3


def test_empty_tables_and_clashing_columns(spark):
    assert drawn(spark, [], ["a b"]) == []
    docs = [(1, "a b c"), (2, None)]
    assert drawn(spark, docs, []) == brute(docs, [])
    df = spark.createDataFrame([(1, "x " * 30, 5, "k")], "doc_id long, text string, _rank int, `_own.b` string")
    out = resampling.resample(df, spark.createDataFrame([("x",)], "text string"), percent=100)
    assert out.columns == ["doc_id", "_own.b", "_n_words", "_n_features", "_weight", "_score", "_rank"] and out.first()["_rank"] == 1


def test_ranks_over_partitions(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS s").repartition(16)
    got = sorted((tuple(r) for r in resampling.ranked(df, [df.s.desc(), df.id.asc()], 3000).where("_rank IS NOT NULL").collect()), key=lambda r: r[2])
    want = sorted(((i, i % 7) for i in range(5000)), key=lambda x: (-x[1], x[0]))[:3000]
    assert got == [(*x, r) for r, x in enumerate(want, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=20))
def test_crc(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts]).astype(np.int64)
    start = end - np.array([len(p) for p in parts], np.int64)
    assert resampling.crc32(data, start, end).tolist() == [zlib.crc32(p) for p in parts]
