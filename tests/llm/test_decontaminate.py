import random
import re
import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import decontaminate as d
from trailmark.llm.bytewords import Words

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(texts, items, window=10):
    """(words, hit words, items) of each text by comparing every window with every place."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    out = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for name, item in items:
            own = split(item)
            n = min(window, len(own))
            for j in range(len(own) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == own[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(name)
        out.append((len(words), len(hit), sorted(found)))
    return out


def run(spark, texts, items, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    rows = d.mark_contamination(docs, bench, **kw).orderBy("doc_id").collect()
    return [(r._n_words, sum(s["end"] - s["first"] for s in r._spans), r._items) for r in rows]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["uno", "dos", "tres", "été", "42", "Foo", "bar"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([10, 12, 25, 40, 60, 60])] + [(6, "solo!"), (7, ""), (8, None), (9, "alpha beta gamma"), (0, say(11))]
    texts = [None, "", "...", "SOLO", "alpha-beta,gamma delta"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(items)[1] or "x"
            words = words.split()
            a = rng.randint(0, len(words))
            parts.append(" ".join(words[a : a + rng.randint(5, 30)]))
            parts.append(say(rng.randint(0, 15)))
        texts.append("\n".join(parts).upper() if rng.random() < 0.3 else ", ".join(parts))
    items += [(10, "bis " * 40), (11, "bis uno " * 20), (12, "uno " + "bis " * 12)]
    texts += ["bis " * 300 + say(5), "bis uno " * 150, say(30) + " bis" * 200 + " uno bis" * 60, texts[-1], texts[-1]]
    want = brute_force(texts, [(str(i), t) for i, t in items])
    assert run(spark, texts, items) == want
    assert run(spark, texts, items, index_words=60) == want  # by a join of fingerprints
    assert sum(h > 0 for _, h, _ in want) > 20


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, ["a b c"], []) == [(3, 0, [])]
    assert run(spark, [], [(1, "a b c " * 30)], index_words=10) == []


def test_repeated_words_take_linear_time():
    words = lambda n: Words(np.frombuffer(b"same " * n, np.uint8), np.array([0, 5 * n]))
    index = d.BenchmarkIndex([("a", words(800).hash)])
    began = time.perf_counter()
    assert [*index.hits(words(200_000))] == [(0, 0, 0, 200_000)]
    assert time.perf_counter() - began < 5


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", 5), (2, "clean text", 6), (2, "clean text", 6)], "doc_id long, text string, hash int")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = d.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    more = docs.withColumnRenamed("hash", "_Spans")
    assert d.drop_contaminated(more, bench).columns == more.columns
    assert [tuple(r) for r in out.collect()] == [(2, "clean text", 6)] * 2


def test_sql(spark):
    assert same(spark, d.op10_winnowing_decontamination, d.OP10_SQL, "/root/testdata/sf0.01") > 900
