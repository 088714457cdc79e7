import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trailmark.llm import toxicity as d
from trailmark.llm.bytewords import _BASE, blocks

SF, LARGE = "/root/testdata/sf0.1", "/root/testdata/check_s"


@pytest.mark.parametrize(("sf", "least", "most"), [(SF, 0.55, 0.03), (LARGE, 0.9, 0.01)])
def test_held_out_accuracy(spark, sf, least, most):
    """The larger table has 50,000 documents and five times as many toxic ones to learn from."""
    if not Path(f"{sf}/documents.parquet").exists():
        pytest.skip("no such table here")
    got = {r.doc_id: r for r in d.op9_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].score, got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    toxic, clean = [x for x in held if x[2]], [x for x in held if not x[2]]
    assert sum(p for _, p, _ in toxic) / len(toxic) > least
    assert sum(p for _, p, _ in clean) / len(clean) < most
    order = np.sort([t for t, _, _ in clean])
    above = np.mean([np.searchsorted(order, s) / len(order) for s, _, _ in toxic])
    assert above > 0.9


def test_misspellings_share_vectors():
    texts = [f"this is {w} number {i}" for i in range(60) for w in ("worthless", "wonderful")]
    model = d.train(pa.array(texts), np.array([1, 0] * 60), 0.5)
    _, _, data, off = next(blocks(pa.array(["this is wortless", "this is wonderfull", "", None])))
    score = model.score(data, off)
    assert score[0] > 0.6 > 0.4 > score[1] and score[2] == score[3] and 0 < score[2] < 1


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "x", 1)], "doc_id long, text string, toxic string, _SCORE int")
    labels = spark.createDataFrame([(2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = d.fit(docs, labels)
    out = d.score_toxicity(docs, model).collect()
    assert len(out) == 3 and len({r._score for r in out}) == 1
    assert d.score_toxicity(docs.limit(0), model).count() == 0


def naive_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % 2**64
    return x ^ (x >> 31)


def naive_word(data):
    base = int(_BASE)
    values = (naive_mix((naive_mix((256 * i + b + 1) * base % 2**64) + 0x11B54A32D192ED03) % 2**64) for i, b in enumerate(data))
    return naive_mix((sum(values) + len(data) * base) % 2**64)


def naive_gram(data):
    return naive_mix(len(data) << 56 | int.from_bytes(data, "little"))


def naive_score(model, text):
    """The score of one text, n-gram by n-gram."""
    words, word = [], b""
    for b in ((text or "").encode() + b" "):
        b += 32 if 65 <= b <= 90 else 0
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    total = 0.0
    for w in words:
        grams = [naive_mix((naive_word(w) + 7) % 2**64)]
        for k in d.GRAMS:
            for at in range(-1, len(w) + 2 - k):
                side = (at < 0) + 2 * (at + k > len(w))
                grams.append(naive_mix((naive_gram(w[max(at, 0) : at + k]) + side * int(_BASE) + k) % 2**64))
        total += sum(float(model.weight[g % d.BUCKETS]) for g in grams) / len(grams)
    return 1 / (1 + math.exp(-(d.SCALE * total / (len(words) + d.SMOOTH) + model.bias)))


def test_scores_match_brute_force(spark):
    model = d.Model(np.random.default_rng(2).standard_normal(d.BUCKETS), -0.3)
    texts = [None, "", "...", "a", "Du bist BLÖD, du bist!", "an ordinary sentence with words " * 40, "x1 é y\n\nzz-top"]
    rows = d.score_toxicity(spark.createDataFrame([*enumerate(texts)], "i long, text string"), model).collect()
    assert all(abs(r._score - naive_score(model, texts[r.i])) < 1e-5 for r in rows) and len(rows) == len(texts)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    vectors, soft, bias = rng.standard_normal((9, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)
    own, col, x = np.array([0, 0, 1, 2, 2, 2]), np.array([1, 4, 4, 8, 1, 0]), rng.random(6)
    truth = np.array([[0.7, 0], [0, 1.3], [0.7, 0]])
    loss = lambda: d.gradients(vectors, soft, bias, own, col, x, truth)[0]
    for some, grad in zip((vectors, soft, bias), d.gradients(vectors, soft, bias, own, col, x, truth)[1:]):
        for at in np.ndindex(some.shape):
            some[at] += 1e-2
            up = loss()
            some[at] -= 2e-2
            assert abs((up - loss()) / 2e-2 - grad[at]) < 1e-3
            some[at] += 1e-2
