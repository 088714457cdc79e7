import math

import pyarrow.parquet as pq

from pyspark.sql import functions as F

from trailmark.llm import langid as d

SF = "/root/testdata/sf0.01"


def test_declared_languages_are_found(spark):
    rows = d.op5_language_id(spark, SF).collect()
    assert len(rows) == pq.read_metadata(f"{SF}/pages.parquet").num_rows
    assert sum(r.lang == r.declared for r in rows) / len(rows) > 0.97


def test_text_alone_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = d.fit_text_model(docs.where(half == 0))
    rows = d.identify_languages(docs.where((half == 1) & (F.length("text") > 40)), model, "text").select("lang", "_lang").collect()
    assert sum(r.lang == r._lang for r in rows) / len(rows) > 0.97
    assert d.keep_identified(docs, model).count() == docs.count()


def test_evidence_decides_short_texts(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("der hund und die katze sind nicht hier", "de")] * 30)], "doc_id long, text string, lang string")
    model = d.fit_text_model(docs)
    rows = [(i, "der hund und die katze", "a.example.org", None) for i in range(20)] + [(100, "ha", "a.example.org", None), (101, "ha", "b.site.test", "en"), (102, "", "x.site.de", "de"), (103, None, "a.example.org", None), (104, "42 ...", None, None), (105, "", None, "xx")]
    pages = spark.createDataFrame(rows, "n long, text string, host string, declared string")
    got = {r.n: r for r in d.identify_languages(pages, model, "text", F.col("host"), F.col("declared")).collect()}
    assert got[0]._lang == got[100]._lang == got[102]._lang == "de" and got[101]._lang == "en"
    assert got[103]._lang == got[104]._lang == "und" and got[104].declared is None
    assert all(0 < r._posterior <= 1 for r in got.values())


def test_posterior_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund da", "de"), (3, None, None)], "doc_id long, text string, lang string")
    model = d.fit_text_model(docs)
    pages = [("the hund", "www.a.com", "en"), ("der cat", "www.a.com", None), ("sat sat", "b.a.com", "de"), ("da", "c.net", "fr")]
    import pyarrow as pa

    from trailmark.llm.bytewords import blocks

    _, _, data, off = next(blocks(pa.array([p[0] for p in pages])))
    ll, _ = model.likelihoods(data, off)
    soft = [[math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v] for v in ll.tolist()]
    total = lambda keep: ([sum(s[k] for s, p in zip(soft, pages) if keep(p)) for k in range(2)], sum(keep(p) for p in pages))
    share = [(x + 1) / (4 + 2) for x in total(lambda p: True)[0]]
    mix = lambda s, n, q: [(s[k] + d.SMOOTH * q[k]) / (n + d.SMOOTH) for k in range(2)]
    said = {x: [d.AGREE_ROWS * (d.AGREE if x == lang else (1 - d.AGREE) / 2) for lang in model.languages] for x in (*model.languages, "other")}
    for k, x in enumerate(model.languages):
        said[x][k] = d.AGREE_ROWS * d.AGREE
    for s, p in zip(soft, pages):
        if p[2]:
            said[p[2] if p[2] in model.languages else "other"] = [a + b for a, b in zip(said[p[2] if p[2] in model.languages else "other"], s)]
    columns = [sum(v[k] for v in said.values()) for k in range(2)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i long, text string, host string, declared string")
    got = {r.i: r for r in d.identify_languages(rows, model, "text", F.col("host"), F.col("declared")).collect()}
    for i, p in enumerate(pages):
        suffix, domain = p[1].split(".")[-1], ".".join(p[1].split(".")[-2:])
        q = mix(*total(lambda x: x[1].endswith("." + suffix)), share)
        q = mix(*total(lambda x: x[1].endswith(domain)), q)
        s, n = total(lambda x: x[1] == p[1])
        prior = mix([s[k] - soft[i][k] for k in range(2)], n - 1, q)
        logs = [ll[i][k] + math.log(prior[k]) + (math.log(said[p[2] if p[2] in model.languages else "other"][k] / columns[k]) if p[2] else 0) for k in range(2)]
        best = max(math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs)
        assert abs(got[i]._posterior - best) < 1e-9 and got[i]._lang == model.languages[logs.index(max(logs))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    model = d.fit_text_model(docs)
    assert d.keep_identified(docs, model).count() == 0
    some = spark.createDataFrame([(1, "x", "en", "s")], docs.schema)
    assert [r._lang for r in d.identify_languages(some, model, "text").collect()] == ["und"]
    assert d.keep_identified(docs, d.fit_text_model(some)).count() == 0


def test_kept_by_posterior(spark):
    words = {"en": "the cat sat on the mat with the hat and this was there", "de": "der hund und die katze sind nicht hier aber auch das ist schon", "fr": "le chien est dans la maison avec les enfants qui sont ici"}
    docs = [(i, t, lang, "a") for i, (lang, t) in enumerate([*words.items()] * 30)]
    docs += [(100, "Это просто текст на другом языке, которого модель не знает", None, "a"), (101, "1234 5678 #### 90 !! 12 34 x 77 88", "en", "a"), (102, "12 34", "en", "a")]
    docs += [(103, "xqj", None, "a"), (104, "the cat", None, "a"), (105, words["de"], "en", "a"), (106, "kissa istuu matolla", "fi", "a")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = d.fit_text_model(docs.where("doc_id < 100"))
    kept = {r.doc_id: r.lang for r in d.keep_identified(docs, model, lang_col="lang").collect()}
    # 103 may be of any of three languages: its posterior is below a half
    assert kept == {i: ("en", "de", "fr")[i % 3] for i in range(90)} | {104: "en", 105: "de", 106: "fi"}
    judged = {r.doc_id: r for r in d.identify_languages(docs, model, "text", F.col("source"), F.col("lang")).collect()}
    assert judged[103]._posterior < d.LEAST_POSTERIOR and judged[103]._lang == "und"
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert d.keep_identified(bare, d.fit_text_model(bare), lang_col="lang").count() == docs.count() - 1  # all with letters


def test_many_languages_and_hosts(spark, monkeypatch):
    say = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}q" for c in "abcdefgh")
    docs = spark.createDataFrame([(i, say(i % 70), f"l{i % 70:02d}") for i in range(700)], "doc_id long, text string, lang string")
    model = d.fit_text_model(docs)
    assert len(model.languages) == 70
    rows = spark.createDataFrame([(i, say(i % 70), "big" if i % 3 else f"h{i}", 7, "r") for i in range(300)] + [(900, "", None, 7, "r")], "i long, text string, host string, `_POSTERIOR` int, `row` string")
    run = lambda: sorted(tuple(r) for r in d.identify_languages(rows, model, "text", F.col("host")).collect())
    want = run()
    assert all(r[4] == f"l{r[0] % 70:02d}" for r in want[:300]) and want[300][4] == "und" and all(r[3] == "r" for r in want)
    monkeypatch.setattr(d, "BROADCAST_HOSTS", 5)
    for bound in (1000, 20):  # hosts joined by key, and the large one looked up
        monkeypatch.setattr(d, "hot_bound", lambda n, bound=bound: bound)
        got = run()
        assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs(a[5] - b[5]) < 1e-9 for a, b in zip(got, want))
