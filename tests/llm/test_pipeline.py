import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import test_decontaminate
import test_linededup
import test_neardup

import corpus_pipeline as p
from trailmark.llm import mixing

SENTENCES = "the quick river runs over old stones while bright birds sing in tall green trees and small boats drift slowly toward the wide open sea under pale morning light".split()


def corpus():
    import random

    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(SENTENCES) + rng.choice(["", "s", "ed", "ly", "ing"]) for _ in range(n))
    items = [(i, say(30)) for i in range(3)]
    rows = []
    for i in range(120):
        text = "\n".join(say(rng.randint(8, 30)) for _ in range(rng.randint(2, 5)))
        if i % 4 == 0:
            text += "\nShared footer line"
        if i % 10 == 3:
            text = rows[rng.randrange(len(rows))][1] + rng.choice(["", " more"])
        if i % 15 == 7:
            text += "\n" + items[i % 3][1][: 20 + len(items[i % 3][1]) // 2]
        rows.append((i, text))
    rows += [(120, None), (121, ""), (122, "12 34 ###"), (123, rows[0][1]), (124, "the ok")]
    rows += [(125, "Это просто текст на другом языке, которого модель не знает"), (126, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 a")]
    return rows, items


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus()
    data = [(i, t, "en" if i != 125 else None, f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == p.COLUMNS
        if name == "language_id":
            # 122 has no letters, 125 no known language, and 126 hardly a letter
            want = [(i, t) for i, t in want if t and i not in (122, 125, 126)]
        elif name == "line_dedup":
            want = [(i, t) for i, _, _, t in test_linededup.brute_force(want, 10, 1, "none")]
        elif name == "near_dedup":
            classes = test_neardup.brute_force([(i, t.lower()) for i, t in want])
            want = [(i, t) for i, t in want if classes[i] == i]
        else:
            hits = test_decontaminate.brute_force([t for _, t in want], [(str(i), t) for i, t in items])
            want = [x for x, h in zip(want, hits) if not h[1]]
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in got)
    assert 60 < len(want) < 110
    mixed = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    again = Counter(r.doc_id for r in mixing.mix_sources(docs).collect())
    assert Counter(r.doc_id for r in mixed) == again and {r.doc_id for r in mixed} <= {i for i, _ in want}
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == again


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
