import random
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import linededup as d

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, min_docs, min_chars, keep):
    docs, first = defaultdict(set), {}
    key = lambda x: x.strip(BLANK).translate(LOWER)
    rows = [(i, t or "") for i, t in rows]
    for i, t in rows:
        for x in t.split("\n"):
            docs[key(x)].add(i)
    bad = {k for k, v in docs.items() if len(k) >= max(1, min_chars) and len(v) >= min_docs}
    for k in bad:
        first[k] = min((i, p) for i, t in rows for p, x in enumerate(t.split("\n")) if key(x) == k)
    stays = lambda i, p, x: key(x) not in bad or keep == "first" and (i, p) == first[key(x)]
    return sorted((i, t.count("\n") + 1, sum(not stays(i, p, x) for p, x in enumerate(t.split("\n"))), "\n".join(x for p, x in enumerate(t.split("\n")) if stays(i, p, x))) for i, t in rows)


def make(n, seed):
    rng = random.Random(seed)
    pool = ["Hot line", " hot LINE\t", "é x", "", "  ", "a", "zz\r", "licence"] + [f"some {k}" for k in range(40)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "only\n")]
    for i in range(4, n):
        rows.append((i, "\n".join(rng.choice(pool[:3] if rng.random() < 0.4 else pool) for _ in range(rng.randint(1, 9)))))
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, h1 int").repartition(5)
    return sorted((r.doc_id, r._n_lines, r._n_dropped, r.text) for r in d.drop_frequent_lines(docs, **kw).collect())


def test_matches_brute_force(spark):
    rows = make(400, 1)
    for keep in ("none", "first"):
        for min_docs, min_chars in ((10, 1), (2, 4), (60, 1)):
            assert run(spark, rows, keep=keep, min_docs=min_docs, min_chars=min_chars) == brute_force(rows, min_docs, min_chars, keep)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, "hot\nown %d" % i) for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert run(spark, rows, keep="first")[:2] == [(0, 2, 0, "hot\nown 0"), (1, 2, 1, "own 1")]
        assert run(spark, rows) == [(i, 2, 1, "own %d" % i) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = make(120, 5)
        for keep in ("none", "first"):
            assert run(spark, rows, keep=keep, min_docs=5) == brute_force(rows, 5, 1, keep)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_repeated_and_null_ids(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(None, "x\ny")] * 2 + [(5, "x\ny")] * 2 + [(5, "x")], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.text) for r in d.drop_frequent_lines(docs, min_docs=2).collect()))
    assert out == [(0, ""), (0, ""), (5, ""), (5, ""), (5, "")]


def test_sql(spark):
    assert same(spark, d.op6_line_dedup, d.OP6_SQL, "/root/testdata/sf0.01") == 1000


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"same line\nown {i}", "t", "b", 5) for i in range(12)], "doc_id long, text string, tag string, bitmap string, _N_lines int")
    out = d.drop_frequent_lines(docs)
    assert out.columns == ["doc_id", "text", "tag", "bitmap", "_n_lines", "_n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"own {i}", "t", "b", 2, 1) for i in range(12)]
