import itertools

import numpy as np

from trailmark.llm import transcripts as d


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(1)
    model = d.Model(rng.random(d.STATES), rng.random((d.STATES, d.STATES)), [rng.random((d.STATES, n)) * 9 for n in d.SIZES])
    seen = [np.stack([rng.integers(0, n, size) for n in d.SIZES], axis=1).reshape(size, len(d.SIZES)) for size in (4, 1, 3, 0, 5, 4)]
    for x, got in zip(seen, model.viterbi(seen)):
        score = lambda path: model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(e[s, v] for s, row in zip(path, x) for e, v in zip(model.emit, row))
        if len(x):
            best = max(itertools.product(range(d.STATES), repeat=len(x)), key=score)
            assert tuple(got) == best
        else:
            assert len(got) == 0


def test_markers():
    assert [d.marker_of(x)[0] for x in ("User: hi", "### Assistant", "[system] be", "Speaker 2: x", "<|user|> y", "**Bot** z", "Note: x", "user", "", "a: b")] == [1, 2, 3, 5, 1, 2, 6, 0, 0, 2]
    turns, text = d.render(["User: hi", "there", "", "### Assistant", "yes"], np.array([3, 2, 2, 5, 4]))
    assert turns == [("user", "hi\nthere"), ("assistant", "yes")]
    assert text == "<|user|>\nhi\nthere\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"


def test_held_out_accuracy(spark):
    rows = [r for r in d.op8_transcript_roles(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    share = lambda new: sum(r.n_lines_right for r in rows if r.new_style == new) / sum(r.n_lines for r in rows if r.new_style == new)
    assert share(False) > 0.9 and share(True) > 0.75, (share(False), share(True))
    assert sum(r.n_turns for r in rows) > 500 and all(r.rendered.count("<|end|>\n") >= r.n_turns for r in rows)


def score(model, seen, path):
    return model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(e[s, v] for s, row in zip(path, seen) for e, v in zip(model.emit, row))


def naive_viterbi(model, seen):
    best = [model.start[s] + sum(e[s, v] for e, v in zip(model.emit, seen[0])) for s in range(d.STATES)]
    for row in seen[1:]:
        best = [max(best[a] + model.move[a, b] for a in range(d.STATES)) + sum(e[b, v] for e, v in zip(model.emit, row)) for b in range(d.STATES)]
    return max(best)


def test_query_matches_brute_force(spark):
    """Ranks, raw lines, likelihood of the states and rendering, on a table that is sorted, cut and parsed in plain Python."""
    table = spark.createDataFrame(
        [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 3, "tool", "x\ny?"), (None, 3, None, "")]
        + [(8, i // 2, ("user", "assistant", "system")[i * i % 3], f"line {i}\n\nmore" if i % 4 else f"is it {i}?") for i in range(150)]
        + [(7, 5, "user", "same turn") for _ in range(60)],
        "conv_id long, turn long, role string, text string",
    ).repartition(7)
    model = d.fit(d.raw_transcripts(d.pieces(d.ranked_turns(table))))
    want = {}
    for c in (1, None, 8, 7):
        turns = sorted((r.turn if r.turn is not None else 1 << 63, r.role if r.role in d.ROLES else "user", r.text or "") for r in table.collect() if r.conv_id == c)
        want[c] = [(role, text) for _, role, text in turns]
    for size, fan in ((3, 2), (7, 100), (1000, 2)):
        raw = d.raw_transcripts(d.pieces(d.ranked_turns(table), size))
        got = d.parse_transcripts(raw, model, id_col="conv_id", piece_col="piece", fan=fan).collect()
        for c, turns in want.items():
            own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(-(-len(turns) // size)))
            lines, truth = d.raw_transcript("" if c is None else str(c), turns)
            assert [x for r in own for x in r.text.split("\n")] == lines and [x for r in own for x in r.states] == truth
            states, seen = [x for r in own for x in r._states], d.see(lines)
            assert abs(score(model, seen, states) - naive_viterbi(model, seen)) < 1e-6
            assert "".join(r._rendered for r in own) == "".join(d.render(r.text.split("\n"), r._states)[1] for r in own)


def test_all_conversations_are_parsed(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = d.op8_transcript_roles(spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id for r in rows} == {r.conv_id for r in table.select("conv_id").distinct().collect()}


def test_cases(spark):
    table = spark.createDataFrame([(7, 5, "user", f"same turn {i}") for i in range(3000)] + [(8, i * 10**12, "user", "long") for i in range(600)], "conv_id long, turn long, role string, text string")
    parts = d.pieces(d.ranked_turns(table)).collect()
    assert sum(len(r.turns) for r in parts) == table.count()
    assert max(len(r.turns) for r in parts) == 256 and sum(r.conv_id == 8 for r in parts) == 3
    raw = d.raw_transcripts(d.pieces(d.ranked_turns(table)))
    model = d.fit(raw)
    docs = spark.createDataFrame([(1, None, 2, 3), (2, "", 2, 3), (3, "User: a\nb\nAssistant: c", 2, 3)], "doc_id long, text string, _STATES int, entry int")
    out = {r.doc_id: r for r in d.parse_transcripts(docs, model).collect()}
    assert len(out[1]._turns) == len(out[2]._turns) == 1 and out[1]._turns[0].text == "" and out[3].entry == 3
    assert d.parse_transcripts(docs.limit(0), d.fit(raw.limit(0))).count() == 0
    assert d.pieces(d.ranked_turns(table.limit(0))).count() == 0
