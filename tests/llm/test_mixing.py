import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import mixing as d


def test_shares_and_draws(spark):
    rows = [(i, "big" if i % 10 else "small", "x") for i in range(20000)] + [(20000 + i, "off", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, weight string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("never", 5.0), ("off", None)], "source string, weight double")
    out = d.mix_sources(docs, weights=weights, total=40000).collect()
    # the weight of a source without rows doesn't count
    per = Counter(r.source for r in out)
    assert abs(per["big"] - 10000) < 400 and abs(per["small"] - 30000) < 700 and set(per) == {"big", "small"}
    counts = Counter(r.doc_id for r in out if r.source == "big")
    assert all(r._n_copies == counts[r.doc_id] for r in out if r.source == "big")
    n = 18000
    mean = 10000 / n
    zero = n - len(counts)
    assert abs(zero / n - 2.718281828 ** -mean) < 0.02
    assert len({(r.doc_id, r._copy) for r in out}) == len(out)


def test_large_rate_and_order(spark):
    docs = spark.createDataFrame([(i, None if i < 5 else "s") for i in range(105)], "doc_id long, source string")
    out = d.mix_sources(docs, total=21000, alpha=1.0)
    got = Counter(r.doc_id for r in out.collect())
    assert len(got) == 105 and abs(sum(got.values()) / 105 - 200) < 6
    for part in out.select("_mix_key").rdd.glom().collect():
        assert part == sorted(part)


def test_cases(spark):
    docs = spark.createDataFrame([(None, "a", "t"), (None, "a", "t"), (1, "a", None)], "doc_id long, source string, text string")
    got = Counter((r.doc_id, r._copy) for r in d.mix_sources(docs, total=30).collect())
    assert got[(None, 0)] == 2 and got[(1, 0)] == 1
    assert d.mix_sources(docs.limit(0)).count() == 0


def test_sql(spark):
    assert same(spark, d.op7_poisson_mixing, d.OP7_SQL, "/root/testdata/sf0.01") > 900


def test_tiny_shares_and_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a" if i % 2 else None if i % 10 == 0 else f"s{i}") for i in range(400)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 1.0), ("s2", 4e-10), (None, 0.5)], "source string, weight double")
    rates = {r.source: r.rate for r in d.source_rates(docs, weights=weights, total=1e10).collect()}
    assert abs(rates["s2"] - 4e-10 / (1.5 + 4e-10) * 1e10) < 1e-6 and rates["s4"] == 0
    want = sorted(tuple(r) for r in d.mix_sources(docs).collect())
    monkeypatch.setattr(d, "BROADCAST_SOURCES", 10)
    for bound in (1000, 20):
        monkeypatch.setattr(d, "hot_bound", lambda n, bound=bound: bound)
        assert sorted(tuple(r) for r in d.mix_sources(docs).collect()) == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", 7, "x", "y") for i in range(50)], "doc_id long, source string, _COPY int, cdf string, source_key string")
    out = d.mix_sources(docs)
    assert out.columns == ["doc_id", "source", "cdf", "source_key", "_n_copies", "_copy", "_mix_key"]
    assert all((r.cdf, r.source_key) == ("x", "y") for r in out.collect())
