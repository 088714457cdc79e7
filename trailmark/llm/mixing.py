"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is
the repetition rate of its source.  The variable is drawn by inverting the
distribution function at a number in (0, 1) that is hashed from seed and
document, so that the outcome neither depends on partitions nor changes when a
task is run again.  The copies are then shuffled globally by a hash as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import cut, fresh, hot_bound, join_counted, table, without

SEED = "mix-1"
#: Weights are (rows of the source) ** ALPHA unless they are given: large sources are damped, small ones lifted.
ALPHA = 0.5
#: A source's rate is cut into equal parts of at most this mean; their sum is Poisson distributed again.
PIECE = 16.0
#: Terms of the distribution function; beyond them the tail of a mean of PIECE is below 2**-53.
TERMS = 96
#: Rows of the table of rates up to which it is broadcast; beyond, only the largest sources are.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, joined by '|'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def source_rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, n_rows, rate): rate = total * weight share / rows, where ``total`` defaults to all rows.

    ``weights`` has (source, weight); sources that it lacks, or with a weight
    that is null or not positive, get rate 0, and those that it names more than
    once the sum of their weights.  A null source is a source.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(alpha)))
    else:
        own = weights.select(F.col("source").alias("_s"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")).groupBy("_s").agg(F.sum("weight").alias("weight"))
        counts = counts.join(own, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = cut(counts)
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n")).first()
    if not sums["w"]:
        return counts.select("source", "n_rows", F.lit(0.0).alias("rate"))
    goal = float(sums["n"] if total is None else total)
    return counts.select("source", "n_rows", (F.lit(goal) * (F.col("weight") / F.lit(sums["w"])) / F.col("n_rows")).alias("rate"))


def _distribution(rate: Column, pieces: Column) -> Column:
    """Distribution function of one piece, at 0, 1, 2, ..."""
    mean = rate / pieces
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), zero, step, lambda acc: acc["cdf"])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: DataFrame | None = None,
    total: float | None = None,
    alpha: float = ALPHA,
    seed: str = SEED,
    text_col: str | None = "text",
) -> DataFrame:
    """``docs`` repeated to the target weights and shuffled, with ``_copy`` (0, 1, ...), ``_n_copies`` and ``_mix_key``.

    The output is in order of ``_mix_key``, a hash of seed, id, text and copy,
    within each of its partitions, to which rows are dealt by the same hash.  The
    draw depends on id and text (on the id alone if there is no such column), so rows
    without an id, or with one id, are drawn each for itself; only repeated rows
    are repeated alike.  A null source is a source, a null text an empty one, and
    an empty table stays empty.  Other columns stay, whatever their names, but
    for ``_copy``, ``_n_copies`` and ``_mix_key``, which are replaced.
    """
    docs = without(docs, "_copy", "_n_copies", "_mix_key")
    source, absent, pieces, cdf = fresh(docs, "source_key", "source_null", "pieces", "cdf")
    rates = source_rates(docs, source_col, weights, total, alpha)
    n_pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1))
    rates = rates.select(F.coalesce("source", F.lit("")).alias(source), F.col("source").isNull().alias(absent), F.col("n_rows").alias("n"), n_pieces.cast("int").alias(pieces), _distribution(F.col("rate"), n_pieces).alias(cdf))
    own = F.col(f"`{source_col}`").cast("string")
    rows = docs.select("*", F.coalesce(own, F.lit("")).alias(source), own.isNull().alias(absent))
    sums = rates.agg(F.count("*").alias("sources"), F.sum("n").alias("n")).first()
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    if text_col is not None and text_col in docs.columns:
        name = F.concat(name, F.lit(":"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    if sums["sources"] <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates.drop("n")), [source, absent])
    else:  # the largest sources are looked up all the same, and their rows are not dealt by the source
        packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        found = join_counted(rows.select(packed, source, absent), rates, [source, absent], hot_bound(sums["n"]), F.sha1(F.monotonically_increasing_id().cast("string")), F.lit(False))
        joined = found.select("row.*", source, absent, pieces, cdf)

    (named,) = fresh(joined, "name")
    joined = joined.withColumn(named, name)

    def drawn(k: Column) -> Column:
        u = uniform(F.lit(seed), F.col(named), k.cast("string"))
        return F.size(F.filter(cdf, lambda c: c < u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(pieces)), drawn), F.lit(0), lambda a, n: a + n)
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], named, copies.alias("_n_copies")).where("_n_copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(named), F.col("_copy").cast("string")).cast("binary"))
    return out.withColumn("_mix_key", key).drop(named).repartition("_mix_key").sortWithinPartitions("_mix_key")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", F.col("_copy").alias("copy"), F.col("_n_copies").alias("n_copies"), F.col("_mix_key").alias("mix_key"))


_NAME = "coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))"

OP7_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows, pow(CAST(count(*) AS DOUBLE), {ALPHA}) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST(greatest(ceil(rate / {PIECE}), 1) AS INT) AS pieces, rate / greatest(ceil(rate / {PIECE}), 1) AS mean
  FROM (SELECT source, (SELECT CAST(sum(n_rows) AS DOUBLE) FROM counts) * (weight / (SELECT sum(weight) FROM counts)) / n_rows AS rate FROM counts)),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {TERMS - 1}),
draws AS (
  SELECT rid, source, (CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', {_NAME}, CAST(piece AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / pow(2.0, 52) AS u
  FROM (SELECT rid, doc_id, text, d.source, unnest(generate_series(1, pieces)) AS piece
        FROM (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents) d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)),
numbers AS (SELECT rid, count(c) AS n_copies FROM draws d LEFT JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c < d.u GROUP BY rid)
SELECT doc_id, source, lang, text, copy, n_copies, md5(concat_ws('|', '{SEED}', 'order', {_NAME}, CAST(copy AS VARCHAR))) AS mix_key
FROM (SELECT doc_id, source, lang, text, CAST(n_copies AS INT) AS n_copies, CAST(unnest(generate_series(0, n_copies - 1)) AS INT) AS copy
      FROM (SELECT row_number() OVER () AS rid, * FROM documents) JOIN numbers USING (rid) WHERE n_copies > 0)
"""
