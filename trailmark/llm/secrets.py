"""Secret scans in DataFrame functions only: patterns, and sliding-window entropy.

Four kinds of spans are found: ``assign`` (a value assigned to a telling name),
``access`` (access key ids), ``hex`` (long hexadecimal runs) and ``entropy``.
For the last, long token-like strings with letters and digits are candidates;
a window slides over each and keeps, by incremental counts of its characters,
the sum of c*log2(c), hence the Shannon entropy.  Windows are judged by the
class of their characters: decimal ones never count, hexadecimal and other
ones have thresholds of their own.  An allow-list of patterns suppresses
candidates that are known to be harmless; it never hides the other kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import fresh, table


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"
VALUE_LENGTH = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Matches of one text whose places are folded together.
CHUNK = 256

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window of hexadecimal digits, and of other characters.
HEX_BITS = 3.0
OTHER_BITS = 3.9
#: Candidates that match one of these are no finding of the entropy scan (fixed values).
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    "^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",  # digests of nothing
    "(EXAMPLE|[Ee]xample|[Pp]laceholder|[Dd]ummy|0123456789)",
    "^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]+$",  # words, then a number
)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of leftmost, non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:long,end:long,value:string>>")

    size = lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def shift(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    # there is one gap more than there are matches
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    # a fold copies what it has so far at every match, so matches are folded in chunks, from where each begins
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + size(x)))
    begin = F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")), shift, lambda acc: acc["out"])
    fold = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    scanned = F.when(F.size(found) <= CHUNK, fold(steps, F.lit(0).cast("long"))).otherwise(F.flatten(F.zip_with(chunks, begin, fold)))
    return F.when(text.rlike(pattern), scanned).otherwise(empty)


def _clog(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _entropy_hull(value: Column, window: int, hex_bits: float, other_bits: float) -> Column:
    """struct<first, last>: the first and the last window (0-based) with enough entropy; both null if there is none."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("count"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("letters"),
        F.lit(0).alias("others"),
        F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    code = {c: i for i, c in enumerate(ALPHABET)}
    is_digit = lambda p: p.between(code["0"], code["9"])
    is_hex = lambda p: is_digit(p) | p.between(code["a"], code["f"]) | p.between(code["A"], code["F"])

    def step(acc: Column, x: Column) -> Column:
        came, went = x["came"], x["went"]
        has = F.element_at(acc["count"], came + 1)
        had = F.element_at(acc["count"], went + 1) + (came == went).cast("int")
        total = acc["sum"] + _clog(has + 1) - _clog(has) + F.when(went.isNull(), 0.0).otherwise(_clog(had - 1) - _clog(had))
        out = F.coalesce(went, F.lit(-1))
        count = F.transform(acc["count"], lambda n, i: n + (i == came).cast("int") - (i == out).cast("int"))
        gone = lambda test: F.coalesce(test(went).cast("int"), F.lit(0))
        letters = acc["letters"] + (~is_digit(came)).cast("int") - gone(lambda p: ~is_digit(p))
        others = acc["others"] + (~is_hex(came)).cast("int") - gone(lambda p: ~is_hex(p))
        bits = F.round(F.log2(F.lit(float(window))) - total / window, 6)
        good = (acc["i"] >= window - 1) & (letters > 0) & (bits >= F.when(others == 0, hex_bits).otherwise(other_bits))
        at = acc["i"] - (window - 1)
        return F.struct(
            count.alias("count"),
            total.alias("sum"),
            letters.alias("letters"),
            others.alias("others"),
            (acc["i"] + 1).alias("i"),
            F.when(acc["first"].isNull() & good, at).otherwise(acc["first"]).alias("first"),
            F.when(good, at).otherwise(acc["last"]).alias("last"),
        )

    # each character with the one that leaves the window; nothing is worked out anew inside of a lambda
    before = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), window), places), F.lit(1), F.length(value))
    steps = F.zip_with(places, before, lambda came, went: F.struct(came.alias("came"), went.alias("went")))
    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def scan_secrets(
    df: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    other_bits: float = OTHER_BITS,
    allow: tuple[str, ...] = ALLOW,
    out_col: str = "_secrets",
) -> DataFrame:
    """``df`` with ``out_col``: array<struct<start long, rank int, end long>> in order, ``rank`` an index of :data:`KINDS`.

    Offsets are code points, ends are exclusive.  A null text counts as empty and
    has no spans; work grows in proportion to the length of a text and of each
    candidate in it.  Rows are treated one by one: repeated rows get equal spans, an
    empty table stays empty, and columns of ``df`` stay but for one named ``out_col``.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    span = lambda rank: lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= VALUE_LENGTH)
    harmless = lambda v: v.rlike("|".join(f"(?:{p})" for p in allow)) if allow else F.lit(False)
    candidates = F.filter(_matches(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~harmless(m["value"]))
    judged = F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), _entropy_hull(m["value"], window, hex_bits, other_bits).alias("hull")))
    entropy = F.transform(F.filter(judged, lambda m: m["hull"]["first"].isNotNull()), lambda m: F.struct((m["start"] + m["hull"]["first"]).alias("start"), F.lit(3).alias("rank"), (m["start"] + m["hull"]["last"] + window).alias("end")))
    spans = F.concat(F.transform(assign, span(0)), F.transform(_matches(text, ACCESS), span(1)), F.transform(_matches(text, HEX), span(2)), entropy)
    return df.withColumn(out_col, F.array_sort(spans))


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of :func:`scan_secrets` (overlapping ones merged) replaced by ``mark``; other columns stay, whatever their names."""
    (own,) = fresh(df, "_secrets")
    found = scan_secrets(df, text_col, out_col=own)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(own, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    rest = F.substring(text, done["at"].cast("int") + 1, F.length(text))
    whole = F.when(F.size(own) > 0, F.concat(done["out"], rest)).otherwise(F.col(f"`{text_col}`"))
    return found.withColumn(text_col, whole).drop(own)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_secrets", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("_secrets", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_secrets")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def _sql_matches(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, m AS value, i,
         sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT rid, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i
        FROM (SELECT rid, regexp_extract_all(text, '{quoted}') AS found, string_split_regex(text, '{quoted}') AS gaps FROM src WHERE regexp_matches(text, '{quoted}'))))"""


OP2_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_matches("assigned", ASSIGN)},
{_sql_matches("accesses", ACCESS)},
{_sql_matches("hexes", HEX)},
{_sql_matches("runs", CANDIDATE)},
windows AS (
  SELECT rid, start, w, substr(value, w + 1, {WINDOW}) AS win
  FROM (SELECT rid, start, value, unnest(generate_series(0, length(value) - {WINDOW})) AS w FROM runs
        WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{"|".join(f"(?:{p})" for p in ALLOW)}'))),
bits AS (
  SELECT rid, start, w, any_value(win) AS win, round(log2({float(WINDOW)}) - sum(n * log2(n)) / {WINDOW}, 6) AS h
  FROM (SELECT rid, start, w, win, c, count(*) AS n FROM (SELECT *, unnest(string_split(win, '')) AS c FROM windows) GROUP BY ALL) GROUP BY rid, start, w),
hull AS (
  SELECT rid, start + min(w) AS s, start + max(w) + {WINDOW} AS e FROM bits
  WHERE regexp_matches(win, '[^0-9]') AND h >= CASE WHEN regexp_matches(win, '[^0-9a-fA-F]') THEN {OTHER_BITS} ELSE {HEX_BITS} END GROUP BY rid, start),
spans AS (
  SELECT rid, 0 AS rank, 'assign' AS kind, start AS s, start + length(value) AS e FROM assigned WHERE length(regexp_extract(value, '{ASSIGN.replace("'", "''")}', 2)) >= {VALUE_LENGTH}
  UNION ALL SELECT rid, 1, 'access', start, start + length(value) FROM accesses
  UNION ALL SELECT rid, 2, 'hex', start, start + length(value) FROM hexes
  UNION ALL SELECT rid, 3, 'entropy', s, e FROM hull),
joined AS (
  SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank = 3) AS n_entropy,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM src LEFT JOIN joined USING (rid)
"""
