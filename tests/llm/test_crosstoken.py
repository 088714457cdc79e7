import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import crosstoken as c
from trailmark.llm.registry import queries


@pytest.fixture(scope="module")
def both():
    return c.Tokenizers(*c.load_files())


@pytest.fixture(scope="module")
def plain():
    """The encoders as their makers load them."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{c.TOKENIZERS}/{c.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{c.TOKENIZERS}/{c.PIECE_BPE}")


def brute(both, plain, rows):
    aligned = []
    for _, text in rows:
        text = text or ""
        a, b = plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(both.b_bytes[i] for i in b) != whole or b"".join(both.a_bytes[i] for i in a) != whole:
            aligned.append(([], [], [], []))
            continue
        ends = []
        for ids, size in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for i in ids:
                at += len(size[i])
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side]):
                groups[bisect_left(cuts, e)][side].append(i)
        aligned.append((a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    docs = Counter(p for *_, links in aligned for p in set(links))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, aligned):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def mine(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in c.align(df).collect()), key=str)


ODD = ["", None, " ", "\n\n", "▁ low", "<s> x </s>", "<|endoftext|>", "naïve café", "日本語 text", "\x00\x01", "a  b   c", "  x", "x  ", "é" * 300, "🙂🙂 ok", "x" * 3000, " " * 1500 + "z", "1234567 89,5%", "don't we'll", "ﬁ ½", "\t a\r\n b"]


def test_brute_force(spark, both, plain, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "naïve café"), (None, "other text"), (5, "x y"), (5, "x y"), (1, "x y z")]
    want = brute(both, plain, rows)
    assert mine(spark, rows) == want
    # links too many to be broadcast
    monkeypatch.setattr(c, "BROADCAST_LINKS", 0)
    assert mine(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, "")]])
def test_small_tables(spark, both, plain, rows):
    assert mine(spark, rows) == brute(both, plain, rows)


def test_query_and_what_it_leaves(spark, both, plain):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op12_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(both, plain, rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tokens_")]


def test_no_row_of_tokens_is_shuffled(spark):
    texts = spark.createDataFrame([(i, -i, f"one two {i}") for i in range(50)], "k1 long, k2 long, text string")
    kept = c.TokenTable(texts, c.load_files())
    sizes = spark.createDataFrame([(i, 1) for i in range(60000)], "id int, size int")
    try:
        with c.co_partitioned(spark):
            plan = c.groups(kept.read(), c.cuts(kept.read(), sizes, sizes))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    finally:
        kept.drop()


def test_tokens_carry_their_ends(spark, both):
    """Rows of tokens are sorted for the join only: no running sum over rows, no lookup of lengths."""
    texts = spark.createDataFrame([(i, -i, f"naïve two {i} " * (1 + i % 3)) for i in range(50)], "k1 long, k2 long, text string")
    kept = c.TokenTable(texts, c.load_files())
    sizes = [spark.createDataFrame([(i, len(x)) for i, x in enumerate(side) if x], "id int, size int") for side in (both.a_bytes, both.b_bytes)]
    try:
        with c.co_partitioned(spark):
            found = c.cuts(kept.read())
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan and "Broadcast" not in plan and "hashpartitioning" not in plan
            assert sorted(found.collect()) == sorted(c.cuts(kept.read(), *sizes).collect())
    finally:
        kept.drop()


def test_texts_in_small_blocks(spark, both, plain, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_TOKENS", 4)
    pairs = c._pairs(len(both.a_bytes), len(both.b_bytes))
    texts = spark.createDataFrame([(i, -i, t) for i, t in enumerate(ODD) if t], "k1 long, k2 long, text string").coalesce(1)
    kept = c.TokenTable(texts, c.load_files())
    try:
        rows = c.groups(kept.read(), c.cuts(kept.read())).toArrow().combine_chunks().to_batches()
        found = {r["k1"]: r for batch in pairs(iter(rows)) for r in batch.to_pylist()}
    finally:
        kept.drop()
    want = brute(both, plain, list(enumerate(ODD)))
    assert {i: (r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), r["groups_sha256"]) for i, r in found.items()} == {r[0]: (*r[1:5], r[7]) for r in want if r[1]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_encoders_are_equal(both, plain, texts):
    a, b = both.encode(texts)
    for text, x, y in zip(texts, a, b):
        if x or y:
            assert x == plain[0].encode(" " + text, add_special_tokens=False).ids and y == plain[1].encode(text)
