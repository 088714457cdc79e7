"""Texts that are built to be hard: patterns that sums cancel, very long strings, broken markup, rows without ids."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import bytewords, decontaminate, langid, linededup, mixing, neardup, secrets, toxicity


def thue_morse(n, a="a", b="b"):
    """Two strings of 2**n letters that are each other's mirror in a and b; polynomials of them agree modulo high powers of two."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("which", [0, 1])
def test_spans(which):
    parts = [*thue_morse(11), *thue_morse(8), "abc", "abd", "", "cba", "abc"]
    data = np.frombuffer("|".join(parts).encode(), np.uint8)
    end = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = end - np.array([len(p) for p in parts])
    hashes = bytewords.SpanHash(data, which)(start, end).tolist()
    assert len(set(hashes)) == len(parts) - 1 and hashes[4] == hashes[8]
    # the same spans elsewhere
    apart = [int(bytewords.SpanHash(np.frombuffer(f"..{p}.".encode(), np.uint8), which)(np.array([2]), np.array([2 + len(p)]))[0]) for p in parts]
    assert apart == hashes


def test_lines_of_one_pattern(spark):
    x, y = thue_morse(10)
    docs = spark.createDataFrame([(i, x if i % 2 else y) for i in range(10)], "doc_id long, text string")
    assert {r._n_dropped for r in linededup.drop_frequent_lines(docs).collect()} == {0}
    assert {r._n_dropped for r in linededup.drop_frequent_lines(docs, min_docs=5).collect()} == {1}


def test_words_of_one_pattern(spark):
    x, y = thue_morse(11)
    docs = spark.createDataFrame([(1, f"a b {x} c"), (2, f"a b {y} c")], "doc_id long, text string")
    items = spark.createDataFrame([("i", f"{x} c")], "item_id string, text string")
    for words in (10**6, 0):
        got = {r.doc_id: r._items for r in decontaminate.mark_contamination(docs, items, index_words=words).collect()}
        assert got == {1: ["i"], 2: []}


def test_shingles_of_one_pattern(spark):
    x, y = thue_morse(11)
    body = " ".join(f"{{0}}{i}" for i in range(40))
    docs = spark.createDataFrame([(1, body.format(x)), (2, body.format(y)), (3, body.format(x) + " z")], "doc_id long, text string")
    assert {r.doc: r.class_id for r in neardup.near_duplicate_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_candidate(spark):
    rng = np.random.default_rng(1)
    text = "x " + "".join(rng.choice(list("ABCDEFGHIJabcdefghij0123456789+/"), 100_000)) + " y"
    began = time.monotonic()
    [found] = secrets.scan_secrets(spark.createDataFrame([(text,)], "text string")).select("_secrets").collect()
    assert time.monotonic() - began < 60
    assert [s.rank for s in found[0]].count(3) == 1 and found[0][-1].end > 99_900


@pytest.mark.parametrize("piece", ["<", "<!--", "<script>", "<style", "<script><!--", "&a", "<html "])
def test_broken_markup_is_linear(piece):
    began = time.monotonic()
    langid.bare_text("ab " + piece * (400_000 // len(piece)))
    assert time.monotonic() - began < 5


def test_markup():
    page = "a<!-- <script> -->b<SCRIPT src='x'>if (a > b) {}</script >c</script>d<style>p{}</STYLE>e&amp;f<br/>g<p title='>'>h <!-- i < j > k"
    assert langid.bare_text(page).split() == ["a", "b", "d", "e", "f", "g", "'>h", "k"]  # the open comment is a tag up to its first >
    assert langid.bare_text("1 < 2 and no more") == "1 < 2 and no more" and langid.bare_text("") == "" and langid.bare_text("x > y") == "x > y"


def test_blank_labels_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "le chat est la", "fr"), (2, "the cat is there", "en"), (3, "xyz", ""), (4, "abc", "  "), (5, None, None)], "doc_id long, text string, lang string")
    assert langid.fit_text_model(docs).languages == ["en", "fr"]
    none = langid.fit_text_model(docs.withColumn("lang", F.lit(None).cast("string")))
    rows = docs.unionByName(spark.createDataFrame([(6, "12 - 34", None), (7, "", None), (8, "é", None)], docs.schema)).withColumn("source", F.lit("h"))
    assert sorted(r.doc_id for r in langid.keep_identified(rows, none).collect()) == [1, 2, 3, 4, 8]


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.range(4000).select(F.when(F.col("id") < 2000, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(docs, weights=spark.createDataFrame([("s", 1.0), ("s", 2.0)], "source string, weight double"))
    copies = Counter(r._n_copies for r in mixed.where("doc_id IS NULL AND _copy = 0").collect())
    assert len(copies) > 3 and 1150 < sum(copies.values()) < 1380  # 1 - exp(-1) of 2000
    assert 3700 < mixed.count() < 4300
    parts = [r["n"] for r in mixed.where("doc_id IS NULL").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 1 or max(parts) < 0.4 * sum(parts)
    again = [r._mix_key for r in mixing.mix_sources(docs).orderBy("_mix_key").limit(50).collect()]
    assert again == [r._mix_key for r in mixing.mix_sources(docs.repartition(7)).orderBy("_mix_key").limit(50).collect()]


def test_lines_of_rows_without_ids(spark):
    rows = [(None, f"common\nown {i}") for i in range(12)] + [(None, "twice")] * 20 + [(3, "x\ntwice")] * 15
    got = Counter((r.doc_id, r.text, r._n_dropped) for r in linededup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter({**{(None, f"own {i}", 1): 1 for i in range(12)}, (None, "twice", 0): 20, (3, "x\ntwice", 0): 15})


def test_one_huge_text_leaves_the_sample(spark):
    rows = [(i, "bad awful words" if i % 2 else "good kind words") for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000 + i, "filler " * 20_000) for i in range(20)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_bytes=1 << 20)
    assert np.count_nonzero(model.weight) > 20
    scored = {r.text: r._score for r in toxicity.score_toxicity(docs.where("doc_id < 2"), model).collect()}
    assert scored["bad awful words"] > scored["good kind words"]
