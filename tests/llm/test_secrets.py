import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.llm import secrets as d

PATTERN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute_force(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer(d.CANDIDATE, text):
        if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]) or any(re.search(p, m[0]) for p in d.ALLOW):
            continue
        good = []
        for i in range(len(m[0]) - d.WINDOW + 1):
            win = m[0][i : i + d.WINDOW]
            bits = -sum(n / d.WINDOW * math.log2(n / d.WINDOW) for n in Counter(win).values())
            if not win.isdigit() and round(bits, 6) >= (d.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", win) else d.OTHER_BITS):
                good.append(i)
        if good:
            out.append((m.start() + good[0], 3, m.start() + good[-1] + d.WINDOW))
    return sorted(out)


def make():
    rng = random.Random(7)
    texts = [None, "", "é", "token=abc", 'Token : "abcdef"', "token token=token=abcdefg", 'token="token"="abcdefg"', "AKIAAKIA" + "Z9" * 7, "AKIA123", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "a" * 5000 + "1"]
    bits = ["password", "token = ", "secret:", "API_KEY", "apikey", " = ", ":", "'", '"', "é", "𝒳", " ", "\n", "AKIA", "x"]
    pools = ["0123456789abcdef", d.ALPHABET, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abc1", "0123456789"]
    for _ in range(300):
        texts.append("".join(rng.choice(bits) if rng.random() < 0.7 else "".join(rng.choice(p) for p in [rng.choice(pools)] * rng.randint(1, 60)) for _ in range(rng.randint(1, 25))))
    return texts


def test_matches_brute_force(spark):
    texts = make()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    got = [[tuple(s) for s in r._secrets] for r in d.scan_secrets(docs).orderBy("doc_id").collect()]
    want = [brute_force(t) for t in texts]
    assert got == want
    assert all(sum(s[1] == k for x in want for s in x) > 10 for k in range(4))


def test_redaction_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef12 x"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in d.redact_secrets(docs).orderBy("doc_id").collect()] == ["é [SECRET] x", None, "clean"]
    assert d.scan_secrets(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = d.op2_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_sql(spark):
    assert same(spark, d.op2_secret_scan, d.OP2_SQL, "/root/testdata/sf0.01") == 1000


def test_many_matches_and_clashing_columns(spark):
    text = "".join(f"x{i} AKIA{i:016d} é " for i in range(700)) + "a" * 5
    rows = spark.createDataFrame([(1, text, 7), (2, "none", 8)], "doc_id long, text string, _SECRETS int")
    found = d.scan_secrets(rows, out_col="out").where("doc_id = 1").first()
    assert [text[s.start : s.end] for s in found.out if s.rank == 1] == [f"AKIA{i:016d}" for i in range(700)]
    out = {r.doc_id: r for r in d.redact_secrets(rows).collect()}
    assert out[1].text.count("[SECRET]") == 700 and out[1]._SECRETS == 7 and out[2].text == "none"
