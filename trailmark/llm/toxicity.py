"""Toxicity by a bag of subword embeddings and a linear softmax.

A word is the mean of the vectors of its byte n-grams and of itself, a document
the mean of its words; a linear softmax over that mean gives the score.  The
vectors (hashed into a fixed table) and the softmax are trained together in
numpy on a bounded sample of labelled rows.  Words that were never seen share
the n-gram vectors of those they resemble.

For scoring, vectors and softmax collapse into one number for each n-gram, as
the score depends only on the difference of the two logits; that table of
fixed size is broadcast and texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.bytewords import _BASE, Words, blocks, mix
from trailmark.llm.common import table, without

#: Lengths of n-grams in bytes; word edges count as a byte.
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
#: Labelled rows of label 1 and of label 0 that training reads at most, chosen by a hash of the id, and the bytes of their texts.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2500, 5000, 1 << 26
#: A text is left out of the sample if fewer than so many like it would fill it.
LARGEST = 64
#: Buckets in fewer training texts have no weight.
MIN_TEXTS = 3
#: Minibatches of training, in as many passes over the sample as they take.
BATCHES = 2000
BATCH = 64
RATE = 0.3
DECAY = 1e-4
#: The mean over words is multiplied by this, as single words decide.
SCALE = 100.0
#: Words of weight nothing that every text has besides its own, so that single words don't decide alone.
SMOOTH = 20
THRESHOLD = 0.7


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans of up to seven bytes as one number each, with their length."""
    out = size.astype(np.uint64) << np.uint64(56)
    for j in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > j)
        out[some] |= data[start[some] + j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, the word of each, and how many each word has."""
    n = len(words.start)
    length = words.end - words.start
    bucket, owner = [mix(words.hash + np.uint64(7))], [np.arange(n)]
    for k in GRAMS:
        # with an edge on both sides there are length + 2 - k + 1 n-grams
        count = np.maximum(length + 3 - k, 0)
        own = np.repeat(np.arange(n), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) - 1
        a, z = np.maximum(at, 0), np.minimum(at + k, length[own])
        side = ((at < 0) * 1 + (at + k > length[own]) * 2).astype(np.uint64)
        bucket.append(mix(mix(_packed(words.data, words.start[own] + a, z - a)) + side * _BASE + np.uint64(k)))
        owner.append(own)
    owner_all = np.concatenate(owner)
    return (np.concatenate(bucket) % np.uint64(BUCKETS)).astype(np.int64), owner_all, np.bincount(owner_all, minlength=n)


class Model:
    """Logit = SCALE * mean over words of the mean weight of their n-grams + bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        words = Words(data, off)
        n = len(off) - 1
        if not len(words.start):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        # a word that comes often in the block is worked out once
        _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        few = Words.__new__(Words)
        few.data, few.start, few.end, few.hash = words.data, words.start[one], words.end[one], words.hash[one]
        bucket, owner, count = _features(few)
        per_word = np.bincount(owner, weights=self.weight[bucket], minlength=len(one)) / count
        per_doc = np.bincount(words.doc, weights=per_word[back], minlength=n) / (np.diff(words.first) + SMOOTH)
        return 1 / (1 + np.exp(-np.clip(SCALE * per_doc + self.bias, -40, 40)))


def _bag(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of a block: how much each bucket's vector counts in the mean of each text."""
    words = Words(data, off)
    _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
    few = Words.__new__(Words)
    few.data, few.start, few.end, few.hash = words.data, words.start[one], words.end[one], words.hash[one]
    bucket, owner, count = _features(few)
    order = np.argsort(owner, kind="stable")
    bucket, begin = bucket[order], np.concatenate([[0], np.cumsum(count)])
    pair, times = np.unique(words.doc * len(one) + back, return_counts=True)
    doc, word = pair // max(1, len(one)), pair % max(1, len(one))
    n = count[word]
    at = np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
    share = times / (n * (np.diff(words.first)[doc] + SMOOTH))
    key, place = np.unique(np.repeat(doc, n) * BUCKETS + bucket[at], return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(place, weights=np.repeat(share, n))


def gradients(vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray, own: np.ndarray, col: np.ndarray, x: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss and its gradients by vectors, softmax and bias of a batch of texts.

    Entry k counts the vector of bucket ``col[k]`` with ``x[k]`` in text ``own[k]``;
    ``truth`` has the weight of each text at its label and zero elsewhere.
    """
    n, dim = len(truth), vectors.shape[1]
    doc_vec = np.stack([np.bincount(own, weights=vectors[col, k] * x, minlength=n) for k in range(dim)], axis=1).astype(np.float32)
    logit = doc_vec @ soft + bias
    logit -= logit.max(1, keepdims=True)
    p = np.exp(logit)
    total = p.sum(1, keepdims=True)
    loss = float((truth * (np.log(total) - logit)).sum() / n)
    error = (p / total * truth.sum(1, keepdims=True) - truth) / n
    d_doc = error @ soft.T
    d_vec = np.stack([np.bincount(col, weights=d_doc[own, k] * x, minlength=len(vectors)) for k in range(dim)], axis=1).astype(np.float32)
    return loss, d_vec, doc_vec.T @ error, error.sum(0)


def train(texts: pa.Array, labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Joint training of vectors and softmax by minibatches of Adagrad.

    ``prior`` is the share of label 1 among all labelled rows.  Both labels
    weigh alike in training; the bias then goes half of the way, in log-odds,
    from even odds to that share, as misses cost about as much as false alarms.
    """
    n = len(texts)
    share = np.clip(prior, 1e-3, 1 - 1e-3)
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    # the bags of all texts in compact arrays: bucket and weight, text after text
    sizes, buckets, values = [], [], []
    for i, j, data, off in blocks(texts):
        d, b, x = _bag(data, off)
        sizes.append(np.bincount(d, minlength=j - i))
        buckets.append(b.astype(np.int32))
        values.append((SCALE * x).astype(np.float32))
    begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    bucket, value = np.concatenate(buckets), np.concatenate(values)
    del buckets, values
    # buckets of very few texts only would be learned by heart
    keep = np.bincount(bucket, minlength=BUCKETS)[bucket] >= MIN_TEXTS
    begin = np.concatenate([[0], np.cumsum(keep)])[begin]
    named, bucket = np.unique(bucket[keep], return_inverse=True)
    value = value[keep]
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((len(named), DIM)) * 0.01).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # both labels weigh alike, however many rows they have
    truth = np.eye(2, dtype=np.float32)[labels] * (0.5 / np.bincount(labels, minlength=2).clip(1)).astype(np.float32) * n
    squares = [np.full_like(x, 1e-6) for x in (vectors, soft, bias)]
    epochs = -(-BATCHES * BATCH // n)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            docs = order[i : i + BATCH]
            size = begin[docs + 1] - begin[docs]
            at = np.repeat(begin[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
            _, d_vec, d_soft, d_bias = gradients(vectors, soft, bias, np.repeat(np.arange(len(docs)), size), bucket[at], value[at], truth[docs])
            for v, s, g in zip((vectors, soft, bias), squares, (d_vec + DECAY * vectors, d_soft + DECAY * soft, d_bias), strict=True):
                s += g * g
                v -= rate * g / np.sqrt(s)
    weight = np.zeros(BUCKETS, np.float32)
    weight[named] = vectors @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(bias[1] - bias[0]) + 0.5 * np.log(share / (1 - share)))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; 1 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample_toxic`` and ``sample_clean`` rows of each label, and ``sample_bytes`` of text, outside the held-out fold.

    Rows with a null id or label take no part; of contradicting labels of an id
    the greater counts.  A text longer than a 64th of ``sample_bytes`` is passed
    over.  Without labels, or with one kind only, the score is the
    share of label 1.  The sample goes to one task, where the model is trained;
    the driver gets one number for each bucket.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # two lists of bounded length, which are small enough to broadcast
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(sample_toxic).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(sample_clean))
    # rows are chosen by their lengths; texts that alone would fill a good part of the sample are passed over
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("bytes")).where(F.col("bytes") <= sample_bytes // LARGEST)
    narrow = narrow.join(F.broadcast(chosen), "doc_id").distinct().orderBy(*by_hash, "key").limit(sample_toxic + sample_clean)
    sofar = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(*by_hash, "key").rowsBetween(Window.unboundedPreceding, 0))
    picked = narrow.withColumn("sofar", sofar).where(F.col("sofar") <= sample_bytes).select("doc_id", "key", "toxic")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key")).join(F.broadcast(picked), ["doc_id", "key"])
    rows = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select(F.lit(0).alias("all"), "text", "toxic", F.xxhash64("doc_id").alias("place"), "doc_id", "key")
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("key", "ascending")])
        model = train(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy().astype(np.int64), prior)
        return pa.table({"weight": pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    made = rows.groupBy("all").applyInArrow(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(made[0].weight, "<f4"), made[0].bias) if made else train(pa.array([], pa.string()), np.zeros(0, np.int64), prior)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (0 to 1).

    Null and empty texts get what the bias alone gives.  Texts may have any
    length, repeated rows are scored alike, an empty table stays empty.  Other
    columns stay, whatever their names, but for ``_score``, which is replaced.
    """
    docs = without(docs, "_score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shipped.value.score(data, off) for _, _, data, off in blocks(batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
