import random
from collections import Counter

import numpy as np
import pyarrow as pa

from trailmark.llm import neardup as d
from trailmark.llm.bytewords import Words, blocks
from trailmark.llm.components import connected_components


def prob_jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in x if i in y)


def bag(text, k=5):
    w = text.split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def classes_of(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_force(rows, threshold=0.8):
    bags = {i: bag(t or "") for i, t in rows}
    text = {i: t or "" for i, t in rows}
    links = []
    for a in bags:
        for b in bags:
            if a < b and (text[a] == text[b] or bags[a] and bags[b] and max(prob_jaccard(bags[a], bags[b]), len(bags[a].keys() & bags[b].keys()) / len(bags[a].keys() | bags[b].keys())) >= threshold):
                links.append((a, b))
    return classes_of(list(bags), links)


def make(seed=1, n=60):
    rng = random.Random(seed)
    say = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") for _ in range(n)]
    rows = [(0, None), (1, ""), (2, "uno"), (3, "uno"), (4, "uno dos"), (5, "..."), (6, "uno!")]
    passage = say(30)
    for i in range(10, n):
        if i % 3 == 0 and i > 12:
            words = rng.choice(rows[7:])[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "x"
        else:
            words = say(rng.randint(20, 120))
            if i % 5 == 0:
                words = passage + say(rng.randint(1, 12))
            if i % 7 == 0:
                words = words[:8] * 6 + words
        rows.append((i, " ".join(words)))
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, node string").repartition(4)
    return {r.doc: r.class_id for r in d.near_duplicate_classes(docs, **kw).collect()}


def test_similarity_and_signature():
    rows = [t for _, t in make(4) if t]
    _, _, data, off = next(blocks(pa.array(rows)))
    doc, element, count = d.bags(Words(data, off))
    sig = d.signatures(doc, element, count.astype(float), len(rows), 4000)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = ((element[doc == i], count[doc == i]) for i in (a, b))
            if len(x[0]) and len(y[0]):
                want = prob_jaccard(bag(rows[a].replace("!", "")), bag(rows[b].replace("!", "")))
                assert abs(d.similarity(x, y)[0] - want) < 1e-9
                assert abs((sig[a] == sig[b]).mean() - want) < 0.05


def test_classes_match_brute_force(spark):
    rows = make()
    want = brute_force([(i, t.replace("!", "").replace("...", "")) if t and i not in (5, 6) else (i, t) for i, t in rows])
    got = run(spark, rows)
    want[5], want[6] = 5, got[6]
    assert got[6] == got[2] == 2 and got[0] == got[1] == 0  # by words alone; null and empty are equal
    assert got == want


def test_large_group_and_chains(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):  # every copy differs from its neighbour in one word more
        base[i] = f"v{i}"
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    rows += [(1000 + i, " ".join(f"q{rng.random()}" for _ in range(30))) for i in range(20)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    got = run(spark, rows)
    assert {got[i] for i in range(400)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(20)) and all(got[2000 + i] == 0 for i in range(300))


def test_drop_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text, "a"), (7, text, "a"), (3, text + " w", "b"), (9, "clean text", "c"), (None, None, "d")], "doc_id long, text string, label string")
    out = d.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.label) for r in out.collect()) == [(0, "d"), (3, "b"), (9, "c")]
    assert d.drop_near_duplicates(docs.limit(0)).count() == 0


def test_null_and_clashing_ids(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [say(40) for _ in range(30)]
    rows = [(None, t) for t in texts[:20]] + [(5, t) for t in texts[20:]] + [(None, texts[0] + " more"), (6, texts[20] + " more"), (6, texts[20] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = d.near_duplicate_classes(docs).collect()
    assert len(found) == len(rows) and sum(r.is_kept for r in found) == len(texts)
    assert all(r.class_id == (5 if r.doc == 6 else r.doc) for r in found)
    kept = sorted(r.text for r in d.drop_near_duplicates(docs).collect())
    assert len(kept) == len(texts) and {t.removesuffix(" more") for t in kept} == {*texts} and texts[20] in kept


def test_repeated_passages_are_linked(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(20):  # alike by plain Jaccard only
        body, passage = say(400), say(12)
        rows += [(3 * i, f"{body} {passage}"), (3 * i + 1, body + f" {passage}" * 20), (3 * i + 2, body + f" {passage}" * 40)]
    a, c = bag(rows[0][1]), bag(rows[2][1])
    assert prob_jaccard(a, c) < 0.6 and len(a.keys() & c.keys()) / len(a.keys() | c.keys()) > 0.9
    assert run(spark, rows) == {i: i // 3 * 3 for i in range(60)}
    ends = [r for r in rows if r[0] % 3 != 1]
    assert run(spark, ends) == {i: i // 3 * 3 for i, _ in ends}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    want = classes_of({x for e in links for x in e if e[0] != e[1]}, links)
    for at_once in (10_000, 50, 0):  # in one task, in rounds and one task, in rounds only
        got, n = connected_components(spark.createDataFrame(links, "a long, b long"), len(links), at_once)
        assert n == len(want)
        assert {r.node: r.label for r in got.collect()} == want
    assert np.unique([*want.values()]).size > 3


def test_no_link_is_lost_on_a_real_table(spark):
    """Ids divisible by 20 against all documents: pairs at 0.8 or more, found exactly by an inverted index, are of one class."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    classes = {r.doc_id: r.class_id for r in d.op4_probminhash_near_dedup(spark, sf).collect()}
    parts = []
    for i, j, data, off in blocks(pa.array(docs["text"], pa.string())):
        doc, element, count = d.bags(Words(data, off))
        parts.append((doc + i, element, count))
    doc, element, count = (np.concatenate(x) for x in zip(*parts))
    first = np.searchsorted(doc, np.arange(len(docs) + 1))
    order = np.argsort(element, kind="stable")
    named = element[order]
    links = lost = 0
    for q in np.flatnonzero(docs["doc_id"] % 20 == 0):
        own = slice(first[q], first[q + 1])
        left, right = np.searchsorted(named, element[own], "left"), np.searchsorted(named, element[own], "right")
        shared = np.bincount(np.concatenate([doc[order[a:b]] for a, b in zip(left, right)] or [np.zeros(0, int)]), minlength=len(docs))
        for x in np.flatnonzero(shared > 0.05 * (first[q + 1] - first[q])):
            if x != q and docs["text"][x] != docs["text"][q]:
                other = slice(first[x], first[x + 1])
                if max(d.similarity((element[own], count[own]), (element[other], count[other]))) >= 0.8:
                    links += 1
                    lost += classes[docs["doc_id"][x]] != classes[docs["doc_id"][q]]
    print(f"{links} links, {lost} lost")
    assert links > 20 and lost <= links / 1000
