import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import jaccardjoin as j
from trailmark.llm.registry import oracle_sql, queries

NAME = "op13_jaccard_join"


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, percent=90, k=3):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def mine(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in j.jaccard_components(df, **kw).collect()), key=str)


def family(rng, n, words, edits):
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, words)]
    for _ in range(n):
        text = list(base)
        for at in rng.choice(words, size=rng.integers(0, edits + 1), replace=False):
            text[at] = f"e{rng.integers(0, 1 << 30)}"
        yield " ".join(text)


def test_sql(spark):
    same(spark, queries()[NAME], oracle_sql()[NAME], "/root/testdata/sf0.001")


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [t for n, words, edits in ((30, 60, 3), (30, 200, 12), (20, 40, 2), (5, 9, 1)) for t in family(rng, n, words, edits)]
    common = " ".join(f"c{i}" for i in range(50))
    texts += [common + " " + " ".join(f"u{x}" for x in rng.integers(0, 1 << 30, n)) for n in (0, 1, 2, 3, 5, 80, 90) for _ in range(4)]
    # chains at the edge of the threshold
    texts += [" ".join(f"k{i}" for i in range(a, a + 100)) for a in range(0, 40, 4)] + [" ".join(f"k{i}" for i in range(a, a + 100)) for a in range(200, 260, 7)]
    texts += ["", " \n", "One", "one", "ONE two", "one  two", None, None, "a b c", "A b\tc"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[0]), (None, "alone here now"), (3, texts[5]), (3, texts[5]), (7, texts[40]), (None, "")]
    assert mine(spark, rows) == brute(rows)
    assert mine(spark, rows, percent=70, shingle=2) == brute(rows, 70, 2)


def test_large_families_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(j, "GROUP", 4)
    monkeypatch.setattr(j, "COLUMNS", 64)
    rng = np.random.default_rng(5)
    rows = list(enumerate(t for n, words, edits in ((150, 80, 6), (80, 30, 1), (60, 300, 16)) for t in family(rng, n, words, edits)))
    got = mine(spark, rows)
    assert got == brute(rows)
    assert 3 < len({c for _, _, c in got}) < 290


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")], [(5, "a b c d"), (2, "a b c d")]])
def test_small_tables(spark, rows):
    assert mine(spark, rows) == brute(rows)


def test_other_columns_play_no_part(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2), (2, "A B C", 3, 4)], "doc_id long, text string, node int, `k1.x` int")
    assert sorted(tuple(r) for r in j.jaccard_components(df).collect()) == [(1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("level", [0, 1, 40])
def test_frequent_and_rare_tokens(spark, monkeypatch, level):
    """Which tokens count as frequent changes nothing."""
    monkeypatch.setattr(j, "frequent_level", lambda levels: level)
    monkeypatch.setattr(j, "hot_bound", lambda n: 3)
    monkeypatch.setattr(j, "GROUP", 4)
    rng = np.random.default_rng(7)
    rows = list(enumerate(t for n, words, edits in ((60, 80, 6), (40, 30, 1)) for t in family(rng, n, words, edits)))
    assert mine(spark, rows) == brute(rows)


def test_rare_tokens_and_texts_are_dealt_once(spark):
    heads = spark.createDataFrame([(i, i, i, -i, [i % 7, 100 + i], 2) for i in range(40)], "node long, doc long, k1 long, k2 long, prefix array<long>, rare int").checkpoint()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = j.shared_tokens(heads, 80)
    rare = heads.sparkSession.createDataFrame(found.where("NOT often").collect(), found.schema)
    assert sorted(tuple(r)[:2] for r in rare.collect()) == sorted((i, i % 7) for i in range(40))
    assert plan(found.where("NOT often")).count("hashpartitioning(token#") == 1
    texts = spark.createDataFrame([(i, i, -i, f"t{i}") for i in range(40)], "doc long, k1 long, k2 long, text string")
    own = j._texts_of(heads.select("node"), heads, texts)
    # a join by node takes them where they are
    assert plan(own).count("hashpartitioning(node#") == plan(heads.select("node").hint("merge").join(own, "node")).count("hashpartitioning(node#") - 1


def test_rare_rows_of_the_matrix_are_dealt_once(spark):
    torn = spark.createDataFrame([(i % 9, i, i % 3, i % 5, 0, 10 + i, i % 2 == 0, i % 9 == 4) for i in range(90)], "token long, node long, label long, key long, part int, size long, away boolean, often boolean").checkpoint()
    rare, often = j.matrices(torn)
    met = rare.select("token", "key").hint("merge").join(rare.withColumnRenamed("key", "q_key"), "token")
    assert met._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 2  # one for each side, of which one is used again
    assert {r.token for r in often.collect()} == {4} and {r.token for r in rare.collect()} == {*range(9)} - {4}
    assert rare.count() + often.count() == len({(i % 9, i % 5) for i in range(90)})


@pytest.mark.parametrize("parts", [1, 3])
def test_counts_of_any_size(spark, parts):
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(500)),)] * 300, "text string").repartition(parts)
    levels = j.token_levels(texts, 1)
    assert len(levels) == j.SLOTS and levels.max() >= 8 and (levels >= 8).sum() + (levels == 9).sum() == 500
