"""Language identification by fusing evidence of text, markup and address.

The posterior of a language is proportional to the product of

* the likelihood of the text: hashed byte trigrams, fitted on a bounded sample
  of labelled texts, tempered by the text's length as trigrams overlap,
* the likelihood of the declared markup language under each language, and
* the prior of the host, smoothed towards the domain, that towards the address
  suffix, and that towards the corpus.

The priors and the table of declarations are grouped aggregations of the
posteriors that the text alone gives; a row's own share is taken out of its
host's counts before they are used for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.bytewords import IS_BLANK, LOWER, blocks, mix
from trailmark.llm.common import cut, fresh, hot_bound, join_counted, table, without

#: Labelled texts of each language that fitting reads, on average; chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
#: Trigrams that count as one independent observation.
TEMPER = 4.0
#: Rows of weight that each level of the address adds to the one below.
SMOOTH = 5.0
#: Share of declarations that agree, before any is seen, and the rows that this counts as.
AGREE, AGREE_ROWS = 0.9, 20.0
#: A decision needs this much of the posterior.
LEAST_POSTERIOR = 0.5
#: Odds of a language that the model does not know, under which all trigrams are equally likely.
UNKNOWN_ODDS = 1e-3
#: Least share of letters among the bytes of a text that aren't blank; the given tables have 0.30 or more.
LEAST_LETTERS = 0.1
#: Country suffixes that speak for a language (fixed values); they count as SMOOTH rows.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}
UNDECIDED = "und"
#: Hosts up to which the table of their priors is broadcast; beyond, rows are joined with it by the host.
BROADCAST_HOSTS = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the byte trigram around every letter; all other bytes, and the edges of a text, are alike."""
    low = LOWER[data]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    padded = np.full(len(low) + 2 * len(off), 32, np.uint32)
    place = np.arange(len(low)) + 2 * doc + 1
    padded[place] = np.where(_LETTER[low], low, 32)
    letters = np.flatnonzero(_LETTER[low])
    at = place[letters]
    code = (padded[at - 1] << 16) | (padded[at] << 8) | padded[at + 1]
    return doc[letters], (mix(code.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


class TextModel:
    """Log-likelihoods of trigram buckets under each of ``languages``, which are in order of their names."""

    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp.astype(np.float32)

    def likelihoods(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (texts x languages) and the number of trigrams of each text."""
        doc, bucket = _trigrams(data, off)
        n = len(off) - 1
        out = np.stack([np.bincount(doc, weights=self.logp[bucket, k], minlength=n) for k in range(len(self.languages))], axis=1) if self.languages else np.zeros((n, 0))
        return out / TEMPER, np.bincount(doc, minlength=n)


def fit_text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """A model from about ``sample_per_language`` rows of each label; null and blank labels take no part.

    Trigrams are counted by the tasks and summed by language; the model has
    256 KB for each language.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{id_col}`")).alias("key")).where("trim(lang) <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    # the rows whose hash is low enough: sample_per_language of each label, give or take what chance does
    share = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample_per_language / n)) for lang, n in counts.items()], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for i, _, data, off in blocks(batch.column(1)):
                doc, bucket = _trigrams(data, off)
                key, n = np.unique(code[i + doc] * BUCKETS + bucket, return_counts=True)
                yield pa.record_batch([pa.array(names[key // BUCKETS], pa.string()), pa.array(key % BUCKETS), pa.array(n)], names=["lang", "bucket", "n"])

    # at most languages * BUCKETS rows
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    total[counted["bucket"].to_numpy(), [place[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    smooth = total + 0.5
    return TextModel(languages, np.log(smooth / smooth.sum(axis=0)))


_OPENING = re.compile("<!--|<(script)|<(style)", re.I | re.A)
_CLOSING = {"": re.compile("-->"), "script": re.compile("</script>", re.I | re.A), "style": re.compile("</style>", re.I | re.A)}
_ENTITY = re.compile("&[#A-Za-z0-9]+;")


def bare_text(html: str) -> str:
    """``html`` without scripts, styles, comments, tags and entities; each character is looked at a few times, however broken it is."""
    out: list[str] = []
    at, seek = 0, 0
    endless: set[str] = set()  # kinds that nothing closes from here on
    while found := _OPENING.search(html, seek):
        kind, seek = (found[1] or found[2] or "").lower(), found.end()
        if kind in endless:
            continue
        begin = html.find(">", seek) + 1 if kind else seek
        end = _CLOSING[kind].search(html, begin) if begin or not kind else None
        if end is None:
            endless.add(kind)
            continue
        out += (html[at : found.start()], " ")
        at = seek = end.end()
    *parts, last = "".join((*out, html[at:])).split(">")
    # a tag is all from the first < on to the next >
    text = "".join(f"{p.partition('<')[0]} " if "<" in p else f"{p}>" for p in parts) + last
    return _ENTITY.sub(" ", text)


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags; null stays null."""
    return F.udf(lambda h: None if h is None else bare_text(h), "string", useArrow=True)(html)


def declared_language(html: Column) -> Column:
    """The primary subtag that the page declares for itself, in lower case; null if it declares none."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html[^<>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _posterior(logs: np.ndarray) -> np.ndarray:
    """Rows of log-weights as shares."""
    weights = np.exp(logs - logs.max(axis=1, keepdims=True)) if logs.size else logs
    return weights / weights.sum(axis=1, keepdims=True) if logs.size else logs


def _evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """(host, said, n, rows, s0, s1, ...) of (host, said, text): rows, those with letters, and the sums of what their texts say."""
    shipped, size = rows.sparkSession.sparkContext.broadcast(model), len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, said = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names: dict[tuple[str, str | None], int] = {}
            at = np.array([names.setdefault(x, len(names)) for x in zip(hosts, said, strict=True)])
            sums, n = np.zeros((len(names), size)), np.zeros(len(names), np.int64)
            for i, j, data, off in blocks(batch.column(2)):
                ll, count = shipped.value.likelihoods(data, off)
                own = count > 0
                np.add.at(sums, at[i:j][own], _posterior(ll[own]))
                np.add.at(n, at[i:j][own], 1)
            keys = [pa.array([k[c] for k in names], pa.string()) for c in (0, 1)]
            yield pa.record_batch([*keys, pa.array(n), pa.array(np.bincount(at)), *(pa.array(sums[:, k]) for k in range(size))], names=["host", "said", "n", "rows", *(f"s{k}" for k in range(size))])

    return rows.mapInArrow(run, ", ".join(["host string, said string, n long, rows long", *(f"s{k} double" for k in range(size))]))


def _decide(docs: DataFrame, model: TextModel, text_col: str, host: Column | None, declared: Column | None, smooth: float, least_posterior: float, by_text: bool) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three columns more, whose names follow: the language, its posterior, and whether the text has letters."""
    languages = model.languages
    names = range(len(languages))
    none = F.lit(None).cast("string")
    host = F.coalesce(none if host is None else host.cast("string"), F.lit(""))
    declared = none if declared is None else declared.cast("string")
    # 'other' stands for all declared languages that are not told apart, so that their table is small
    said = F.when(declared.isin(languages), declared).when(declared != "", F.lit("other"))
    text = F.col(f"`{text_col}`").cast("string")
    # what the text says of those rows that have one, by host and declaration; texts are read again for the decision
    add = [F.sum(c).alias(c) for c in ("n", "rows", *(f"s{k}" for k in names))]
    evidence = cut(_evidence(docs.select(host.alias("host"), said.alias("said"), text.alias("text")), model).groupBy("host", "said").agg(*add))

    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.size(parts) - 1, F.lit(2)), ".")).otherwise(F.col("host"))
    hosts = evidence.groupBy("host").agg(*add).withColumns({"domain": domain, "suffix": F.element_at(parts, -1)})
    sums = evidence.groupBy("said").agg(F.count("*").alias("hosts"), *add).collect()  # a row for each language, 'other' and none
    seen = float(sum(r["n"] for r in sums))
    share = np.array([(sum(r[f"s{k}"] for r in sums) + 1.0) / (seen + len(languages)) for k in names])

    speaks = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    own = speaks[F.col("suffix")]
    base = lambda k: F.when(own == languages[k], F.lit(1.0)).when(own.isin(languages), F.lit(0.0)).otherwise(F.lit(float(share[k])))
    level = lambda k, above: (F.col(f"s{k}") + smooth * above) / (F.col("n") + smooth)
    up = lambda key: hosts.groupBy(key).agg(*add)
    suffixes = up("suffix").select("suffix", *[level(k, 0.9 * base(k) + 0.1 * F.lit(float(share[k]))).alias(f"q{k}") for k in names])
    domains = up("domain").withColumn("suffix", F.element_at(F.split("domain", r"\."), -1)).join(suffixes, "suffix")
    domains = domains.select("domain", *[level(k, F.col(f"q{k}")).alias(f"q{k}") for k in names])
    priors = hosts.join(domains, "domain").select("host", F.col("rows").alias("n"), F.col("n").alias("seen"), F.array(*[F.col(f"s{k}") for k in names]).alias("s"), F.array(*[F.col(f"q{k}") for k in names]).alias("q"))

    # P(declared | language)
    markup = np.full((len(languages) + 1, len(languages)), AGREE_ROWS * (1 - AGREE) / len(languages))
    markup[np.arange(len(languages)), np.arange(len(languages))] = AGREE_ROWS * AGREE
    place = {x: i for i, x in enumerate([*languages, "other"])}
    for r in sums:
        if r["said"] is not None:
            markup[place[r["said"]]] += [r[f"s{k}"] for k in names]
    markup = np.log(markup / markup.sum(axis=0))

    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    lang, posterior, letters = fresh(docs, "lang_found", "posterior_found", "letters_found")
    rows = docs.select(packed, host.alias("host"), said.alias("said"))
    if sum(r["hosts"] for r in sums) <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(priors), "host", "left")
    else:
        rows = join_counted(rows, cut(priors), "host", hot_bound(sum(r["rows"] for r in sums)), F.monotonically_increasing_id().cast("string"), keep=True)
    rows = rows.select(*[F.col(f"row.`{c}`") for c in docs.columns], *[F.col(c).alias(f"evidence_{c}") for c in ("host", "said", "seen", "s", "q")])
    if docs.schema[text_col].dataType != T.StringType():
        rows = rows.withColumn(text_col, text)
    fields = rows.schema.fields[: len(docs.columns)]
    shipped = docs.sparkSession.sparkContext.broadcast((model, markup, share))
    at, n_fields = docs.columns.index(text_col), len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, markup, share = shipped.value
        size = len(languages)
        table_of = lambda c: np.array([x if x is not None else [0.0] * size for x in c.to_pylist()], float).reshape(-1, size)
        for batch in batches:
            hosts, said, seen, s, q = batch.columns[n_fields:]
            parts = [(np.zeros((0, size)), np.zeros(0, int), np.zeros(0, int))]
            for _, _, data, off in blocks(batch.column(at)):
                filled = np.concatenate([[0], np.cumsum(~IS_BLANK[data])])
                parts.append((*model.likelihoods(data, off), filled[off[1:]] - filled[off[:-1]]))
            ll, n, solid = (np.concatenate(x) for x in zip(*parts, strict=True))
            mine = np.where((n > 0)[:, None], _posterior(ll), 0.0)
            rest = seen.fill_null(0).to_numpy(zero_copy_only=False) - (n > 0)
            prior = np.log((np.maximum(table_of(s) - mine, 0) + smooth * table_of(q)) / (rest + smooth)[:, None] + 1e-300)
            known = np.array([h != "" for h in hosts.to_pylist()], bool) & ~np.array(seen.is_null())
            prior = np.where(known[:, None], prior, np.log(share))
            code = np.array([place.get(x, -1) for x in said.to_pylist()], int)
            p = _posterior(ll + prior + np.where((code >= 0)[:, None], markup[code], 0.0))
            best = p.max(axis=1) if size else np.zeros(len(n))
            clear = (best >= least_posterior) & ((n > 0) | (code >= 0))
            if by_text:
                clear &= (n > 0) & (n >= LEAST_LETTERS * solid)
                clear &= ll.max(axis=1) >= n * float(-np.log(BUCKETS) / TEMPER) + float(np.log(UNKNOWN_ODDS))
            found = np.where(clear, np.array([*languages], object)[p.argmax(axis=1)], UNDECIDED) if len(n) else np.zeros(0, object)
            yield pa.record_batch([*batch.columns[:n_fields], pa.array(found, pa.string()), pa.array(best), pa.array(n > 0)], names=[*batch.schema.names[:n_fields], lang, posterior, letters])

    schema = T.StructType([*fields, T.StructField(lang, T.StringType()), T.StructField(posterior, T.DoubleType()), T.StructField(letters, T.BooleanType())])
    return rows.mapInArrow(run, schema), lang, posterior, letters


def identify_languages(
    docs: DataFrame,
    model: TextModel,
    text_col: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    smooth: float = SMOOTH,
    least_posterior: float = LEAST_POSTERIOR,
    by_text: bool = False,
) -> DataFrame:
    """``docs`` with ``_lang`` and ``_posterior``, by text, host and declared language (columns of ``docs``, or None).

    A text without a letter, null and empty ones too, has no likelihood
    of its own and gets what markup and host say; without a declaration, or if
    no language has ``least_posterior``, it is ``und``; of equal ones the first
    by name counts.  A null host has no prior but that of the corpus, a null
    declaration says nothing.  Texts may have any length, repeated rows are
    treated alike.  A table without rows stays empty; without labelled texts to
    fit every row is ``und``.  Other columns stay, whatever their names, but for
    the two added, which are replaced.
    ``by_text`` asks that the text itself speaks for a language, whatever markup
    and host say: it has letters, in a share of LEAST_LETTERS, and no language
    that the model does not know is likelier, at UNKNOWN_ODDS.
    """
    docs = without(docs, "_lang", "_posterior")
    if not model.languages:
        return docs.select("*", F.lit(UNDECIDED).alias("_lang"), F.lit(0.0).alias("_posterior"))
    found, lang, posterior, _ = _decide(docs, model, text_col, host, declared, smooth, least_posterior, by_text)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(lang).alias("_lang"), F.col(posterior).alias("_posterior"))


def keep_identified(docs: DataFrame, model: TextModel, text_col: str = "text", host_col: str = "source", languages: tuple[str, ...] | None = None, lang_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language (one of ``languages``, if given) by the fused posterior.

    ``lang_col`` counts as the declaration of a row, and what is found is written
    there; other columns are as they were.  A label that the model does not know
    cannot be judged: such rows stay as they are if they have letters.  Without a
    model nothing can be judged, and all rows with letters stay.  Null and empty
    texts go.
    """
    if not model.languages:
        return docs.where(F.col(f"`{text_col}`").cast("string").rlike("[A-Za-z]|[^\\x00-\\x7F]"))
    label = None if lang_col is None else F.col(f"`{lang_col}`")
    judged, lang, _, letters = _decide(docs, model, text_col, F.col(f"`{host_col}`"), label, SMOOTH, LEAST_POSTERIOR, True)
    found = F.col(lang)
    if lang_col is not None:
        beyond = F.coalesce((label != "") & ~label.isin(model.languages) & F.col(letters), F.lit(False))
        found = F.when(beyond, label).otherwise(found)
    judged = judged.where(found != UNDECIDED)
    if languages is not None:
        judged = judged.where(found.isin(list(languages)))
    return judged.select(*[found.alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_text_model(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"), html_text(F.col("html")).alias("body"))
    found = identify_languages(rows, model, "body", F.col("host"), F.col("declared"))
    return found.select("page_id", "host", "declared", F.col("_lang").alias("lang"), F.round("_posterior", 6).alias("posterior"))
