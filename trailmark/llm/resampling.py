"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn more often.

Features are runs of ``n`` words (and shorter ones), hashed into a fixed number
of buckets.  Both corpora are counted by bucket, and a bucket's gain is the
logarithm of how much likelier it is in the target.  A document weighs the sum
of the gains of its features; adding Gumbel noise that is hashed from its id and
taking the highest sums draws without replacement in proportion to the weights.

Texts may be of very different length.  A long one is cut at word boundaries
into chunks that carry the ``n - 1`` words that follow; a chunk owns the
features that start in its own words, so that each is counted in one chunk and
none is lost.  Chunks are dealt to all tasks, and their counts and weights are
summed by document.  What is broadcast, and what the driver sees, are tables of
a fixed number of buckets and one count for each partition of a sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.bytewords import Words, blocks
from trailmark.llm.common import cut, fresh, table, without

N = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes above which a text is cut into chunks of about as many.
CHUNK_BYTES = 1 << 16
#: Bytes of a feature up to which many are hashed at once.
LONG_FEATURE = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data`` (uint8)."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG_FEATURE]
    at, left = start[order], np.sort(size[order])
    state = out[order]
    for j in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, j, side="right"))  # spans that are longer than j come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_FEATURE):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def features(words: Words, own: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to ``n`` words that start in the first ``own[d]`` words of text d."""
    size = words.end - words.start
    # words one after the other, with a blank behind each
    start = np.cumsum(size + 1) - size - 1
    flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[at] = words.data[np.repeat(words.start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    mine = np.arange(len(size)) - words.first[words.doc] < own[words.doc]
    docs, found = [], []
    for k in range(1, n + 1):
        first = np.flatnonzero(mine[: len(size) - k + 1] & (words.doc[: len(size) - k + 1] == words.doc[k - 1 :])) if len(size) >= k else np.zeros(0, np.int64)
        last = first + k - 1
        docs.append(words.doc[first])
        found.append(crc32(flat, start[first], start[last] + size[last]) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _chunks(text: bytes, n: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """(words of a chunk and the n - 1 after it, number of its own words); a text without words is one chunk."""
    data = np.frombuffer(text, np.uint8)
    words = Words(data, np.array([0, len(data)]))
    count, i = len(words.start), 0
    if not count:
        yield b"", 0
    while i < count:
        j = max(i + 1, int(np.searchsorted(words.end, words.start[i] + limit, side="right")))
        yield data[words.start[i] : words.end[min(count, j + n - 1) - 1]].tobytes(), j - i
        i = j


def chunked(docs: DataFrame, text_col: str = "text", n: int = N, limit: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(short, long): texts up to ``limit`` bytes as they are, and chunks of longer ones, dealt to all tasks.

    Both have the columns of ``docs`` but the text, ``_text`` binary, ``_own``
    (the number of words that a chunk owns, null for a whole text) and ``_row``,
    a number of the row in ``docs``.
    """
    rest = [c for c in docs.columns if c != text_col]
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.monotonically_increasing_id().alias("_row"), body.alias("_text"))
    size = F.octet_length("_text")
    schema = T.StructType([*rows.schema.fields, T.StructField("_own", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for piece, own in _chunks(batch.column("_text")[i].as_py(), n, limit):
                    yield pa.record_batch([*(c.slice(i, 1) for c in batch.columns[:-1]), pa.array([piece], pa.binary()), pa.array([own], pa.int64())], names=[*batch.schema.names, "_own"])

    cut_up = rows.where(size > limit).mapInArrow(run, schema)
    dealt = cut_up.repartition(F.xxhash64("_row", F.sha1("_text")))
    return rows.where(size <= limit).withColumn("_own", F.lit(None).cast("long")), dealt


def _each(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, own words, text, bucket) of blocks of rows."""
    for batch in batches:
        texts, given = batch.column("_text"), batch.column("_own")
        for i, j, data, off in blocks(texts):
            words = Words(data, off)
            own = given.slice(i, j - i).fill_null(-1).to_numpy(zero_copy_only=False)
            own = np.where(own < 0, np.diff(words.first), own)
            doc, bucket = features(words, own, n, buckets)
            yield batch.slice(i, j - i), own, doc, bucket


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS, limit: int = CHUNK_BYTES) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, _, bucket in _each(batches, n, buckets):
            total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    short, long = chunked(docs.select(F.col(f"`{text_col}`").alias("text")), "text", n, limit)
    both = short.select("_text", "_own").mapInArrow(run, "bucket long, n long").unionByName(long.select("_text", "_own").mapInArrow(run, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    found = both.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket at most
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket, in doubles."""
    s, t, own, theirs = (x.astype(np.float64) for x in (counts, target, counts.sum(), target.sum()))
    size = float(len(counts))
    return np.floor(1000.0 * np.log((t + 1.0) * (own + size) / ((s + 1.0) * (theirs + size)))).astype(np.int64)


def noise(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, hashed from seed and id; rows without an id have their text instead."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", n: int = N, limit: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without the text, with ``_n_words``, ``_n_features`` and ``_weight`` long: the sum of the gains of all features."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in docs.columns if c != text_col]
    short, long = chunked(docs, text_col, n, limit)
    short, long = (x.select(*[F.col(f"`{c}`") for c in kept], "_row", "_text", "_own") for x in (short, long))
    schema = T.StructType([*short.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in ("_n_words", "_n_features", "_weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for rows, own, doc, bucket in _each(batches, n, len(table)):
            count = np.bincount(doc, minlength=len(own))
            weight = np.zeros(len(own), np.int64)
            np.add.at(weight, doc, table[bucket])
            yield pa.record_batch([*rows.columns[:-2], *(pa.array(x.astype(np.int64)) for x in (own, count, weight))], names=schema.names)

    sums = [F.sum(c).alias(c) for c in ("_n_words", "_n_features", "_weight")]
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in kept]
    whole = long.mapInArrow(run, schema).groupBy("_row").agg(*first, *sums)
    return short.mapInArrow(run, schema).unionByName(whole.select(*[F.col(f"`{c}`") for c in schema.names])).drop("_row")


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rows`` with ``_rank``: 1, 2, ... in ``order`` up to ``most``, null beyond; sorted by ranges, no task has them all.

    Equal rows are told apart by their place, so that many of them are no hot key.
    """
    (own,) = fresh(rows, "own")
    apart = rows.withColumn(own, F.monotonically_increasing_id())
    by = [*order, F.col(own)]
    placed = cut(apart.repartitionByRange(*by).sortWithinPartitions(*by).drop(own).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long"))
    rank = F.col("_before") + place + 1
    joined = placed.join(starts, part == F.col("_part"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(rank <= most, rank).alias("_rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``docs`` without the text, with ``_n_words``, ``_n_features``, ``_weight``, ``_score`` and ``_rank`` (all long).

    Of the rows with ``min_words`` words or more ``percent`` in a hundred
    (rounded down) with the highest scores get a rank, ties go to the smaller
    id, null last; other rows have a null rank.  A null or empty text has no
    words, no features and weight 0.  Texts of any length are weighed by chunks.
    Repeated rows are ranked one by one; rows with a null id draw by their text.
    Without a target, or without documents, all counts are those of smoothing;
    an empty table stays empty.  Other columns stay, whatever their names, but
    for the five added, which are replaced.
    """
    docs = without(docs, "_n_words", "_n_features", "_weight", "_score", "_rank")
    gain = gains(bucket_counts(docs, text_col, n, buckets, limit), bucket_counts(target, "text", n, buckets, limit))
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # the columns that stay are one, so that their names play no part
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    packed = docs.select(kept.alias("kept"), own.alias("id"), noise(own, text, seed).alias("noise"), text.alias("text"))
    weighed = weigh(packed, gain, "text", n, limit)
    scored = cut(weighed.select("kept", "id", "_n_words", "_n_features", "_weight", (F.col("_weight") + F.col("noise")).alias("_score")))
    may = scored.where(F.col("_n_words") >= min_words)
    most = may.count() * percent // 100
    drawn = ranked(may, [F.desc("_score"), F.asc_nulls_last("id")], most)
    whole = drawn.unionByName(scored.where(F.col("_n_words") < min_words).withColumn("_rank", F.lit(None).cast("long")))
    return whole.select("kept.*", "_n_words", "_n_features", "_weight", "_score", "_rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


_WORDS = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS("text")} AS w FROM documents),
goal AS (SELECT {_WORDS("text")} AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM src UNION ALL SELECT unnest(w) FROM goal)),
division(byte, k, v) AS (SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM division WHERE k < 8),
crc AS (SELECT byte, v FROM division WHERE k = 8),
bytes AS (SELECT word, hex(encode(word)) AS h FROM vocabulary),
running(word, h, j, state) AS (
  SELECT word, h, 0, 4294967295::BIGINT FROM bytes
  UNION ALL SELECT word, h, j + 1, xor(v, state >> 8) FROM running JOIN crc ON byte = xor(state & 255, CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT)) WHERE 2 * j < length(h)),
buckets AS (SELECT word, xor(state, 4294967295) % {BUCKETS} AS bucket FROM running WHERE 2 * j = length(h)),
used AS (SELECT rid, bucket, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM src) JOIN buckets USING (word) GROUP BY ALL),
ours AS (SELECT bucket, sum(n) AS s FROM used GROUP BY bucket),
theirs AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM goal) JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM ours) AS a, (SELECT coalesce(sum(t), 0)::DOUBLE FROM theirs) AS b),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (a + {BUCKETS}) / ((s::DOUBLE + 1) * (b + {BUCKETS})))) AS BIGINT) AS g FROM ours LEFT JOIN theirs USING (bucket), sums),
weighed AS (SELECT rid, sum(n * g) AS weight, sum(n) AS n FROM used JOIN gain USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || sha256(text))), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM src LEFT JOIN weighed USING (rid)),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS r FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * {PERCENT} // 100 FROM drawn) THEN r END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""
