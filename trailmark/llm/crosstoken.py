"""Alignment of two tokenizers' tokens, as relations of tokens.

Every distinct text is encoded by both tokenizers once, and a running sum of
lengths gives the byte where each token ends.  Tokens become rows, and an equal
join of both sides on text and end finds the cuts: places where both have a
border.  A token's group is the number of cuts before it, so groups are the
ranges of tokens between neighbouring cuts, and all pairs within a group are
links.  Groups are written out and paired by arrays of a block of texts.  Links
are counted over the corpus by the documents that hold them.

Token lists are kept in a table that is bucketed by text.  Tokens of one text
stay together, and with Spark's ``requireAllClusterKeysForCoPartition`` off for
that one job no join or window moves them again.  Tokenizer
files and tables of token lengths have the fixed size of a vocabulary; what else
is looked up by broadcast is counted first.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import cut, hot_bound, join_counted, shared_dir, table

#: Folder of the tokenizer files.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a bucket of the table of tokens, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 100_000
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 1 << 20
#: Tokens of one side that are paired at once.
BLOCK_TOKENS = 1 << 17
#: Different links up to which their counts are broadcast; beyond, only those of hot links are.
BROADCAST_LINKS = 1_000_000
#: Splits a text into words, marks and blanks for the byte-level tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other letters than these, or with very long blanks, go to the slower of two equal encoders.
_ODD = re.compile("[^\x00-ԯ]|\\s{1000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Tokenizers:
    """Both encoders, made from the bytes of their files, and the bytes of each token."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        letters = _byte_letters()
        spec = json.loads(byte_bpe)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        vocabulary = {i: bytes(letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in special}
        self.slow = Tokenizer.from_buffer(byte_bpe)
        self.slow.encode_special_tokens = True
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        piece = lambda i: self.pieces.id_to_piece(i)
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and the text, by either side; of none if the text is empty or a side does not give its bytes back."""
        a = [self.slow.encode(f" {t}", add_special_tokens=False).ids if _ODD.search(t) else self.fast.encode_ordinary(f" {t}") for t in texts]
        b = self.pieces.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole:
                a[i], b[i] = [], []
        return a, b


def load_files(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    out = []
    for name in (BYTE_BPE, PIECE_BPE):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


@lru_cache(maxsize=1)
def tokenizers_of(byte_bpe: bytes, piece_bpe: bytes) -> Tokenizers:
    """The encoders of these files, made once in a process."""
    return Tokenizers(byte_bpe, piece_bpe)


def _lists(ids: list[list[int]], sizes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Lists of ids, and of the bytes where their tokens end."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    so_far = np.concatenate([[0], np.cumsum(sizes[flat], dtype=np.int64)])
    ends = so_far[1:] - np.repeat(so_far[offsets[:-1]], np.diff(offsets))
    return tuple(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (flat, ends))


def _encoder(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(*files.value)
        for batch in batches:
            sizes = np.cumsum(batch.column("text").cast(pa.large_binary()).to_pandas().str.len().to_numpy()) if batch.num_rows else np.zeros(0)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
                part = batch.slice(i, j - i)
                a, b = both.encode(part.column("text").to_pylist())
                yield pa.record_batch([*(part.column(c) for c in ("k1", "k2", "n")), *_lists(a, both.a_sizes), *_lists(b, both.b_sizes)], names=["k1", "k2", "n", "a", "a_end", "b", "b_end"])
                i = j

    return run


class TokenTable:
    """(k1, k2, node, n, a, b, a_end, b_end) of distinct texts, kept in the shared folder in buckets by (k1, k2); ends are written as differences."""

    def __init__(self, texts: DataFrame, files: tuple[bytes, bytes]):
        self.spark = texts.sparkSession
        self.name, self.folder = f"tokens_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/tokens-{uuid.uuid4().hex}"
        n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        dealt = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # as many buckets for each partition of the shuffle, so that few tasks write to a bucket
        buckets = min(MOST_BUCKETS // dealt, -(-n_bytes // (BUCKET_BYTES * dealt))) * dealt or dealt
        # copies are put together before they are dealt
        one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        encoded = one.select("k1", "k2", "n", "text").mapInArrow(_encoder(self.spark.sparkContext.broadcast(files)), "k1 long, k2 long, n long, a array<int>, a_end array<int>, b array<int>, b_end array<int>")
        kept = encoded.where(F.size("a") > 0).select("k1", "k2", F.monotonically_increasing_id().alias("node"), "n", "a", "b", "a_end", "b_end")
        as_differences = {"parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("a_end", "b_end")}
        kept.write.option("path", self.folder).options(compression="zstd", **as_differences).bucketBy(buckets, "k1", "k2").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """The table and its files go."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Within, sides that are dealt by some of the keys of a join are joined where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def token_ends(tokens: DataFrame, ids: str, sizes: DataFrame | None = None) -> DataFrame:
    """(k1, k2, pos, end): the byte after each token of a text; ``sizes`` has (id, size) of the vocabulary, for a running sum where ``tokens`` has no ends."""
    if sizes is None:
        return tokens.select("k1", "k2", F.posexplode(f"{ids}_end").alias("pos", "end"))
    rows = tokens.select("k1", "k2", F.posexplode(ids).alias("pos", "id")).join(F.broadcast(sizes), "id")
    so_far = Window.partitionBy("k1", "k2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("k1", "k2", "pos", F.sum("size").over(so_far).alias("end"))


def cuts(tokens: DataFrame, a_sizes: DataFrame | None = None, b_sizes: DataFrame | None = None) -> DataFrame:
    """(k1, k2, a_pos, b_pos): the tokens of both sides that end at the same byte of a text."""
    a = token_ends(tokens, "a", a_sizes).withColumnRenamed("pos", "a_pos")
    b = token_ends(tokens, "b", b_sizes).withColumnRenamed("pos", "b_pos")
    # files of lists are far smaller than their rows, so neither side is one to broadcast
    return a.join(b.hint("merge"), ["k1", "k2", "end"]).select("k1", "k2", "a_pos", "b_pos")


def groups(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """``tokens`` with ``cuts``: the last tokens of each group in order, that of ``a`` times 2 to the 32 plus that of ``b``."""
    at = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.shiftleft(F.col("a_pos").cast("long"), 32) + F.col("b_pos"))).alias("cuts"))
    return tokens.join(at, ["k1", "k2"]).select("k1", "k2", "node", "n", "a", "b", "cuts")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, and the place at which each list starts."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _written(n: int, last: str) -> list[str]:
    """Ids as they are written within a group, and as the last ones of their side."""
    return [f"{i}{mark}" for mark in (",", last) for i in range(n)]


def _pairs(n_a: int, n_b: int):
    """Groups of texts written out and hashed, and their links; of vocabularies of so many ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(_written(n_a, "|") + _written(n_b, ";"), pa.large_string())
        for batch in batches:
            so_far = _flat(batch.column("a"))[1] if batch.num_rows else np.zeros(1, np.int32)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(so_far, so_far[i] + BLOCK_TOKENS, side="right")) - 1)
                part = batch.slice(i, j - i)
                (a, a_at), (b, b_at), (cut_, at) = (_flat(part.column(c)) for c in ("a", "b", "cuts"))
                # the last cut of a text is its end, so a group starts where the one before has ended
                n_groups = np.diff(at)
                a_to = (cut_ >> 32) + np.repeat(a_at[:-1], n_groups) + 1
                b_to = (cut_ & 0xFFFFFFFF) + np.repeat(b_at[:-1], n_groups) + 1
                a_of, b_of = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
                a_from, b_from = a_to - a_of, b_to - b_of

                word = np.empty(len(a) + len(b), np.int64)
                is_last = np.zeros(len(a), bool)
                is_last[a_to - 1] = True
                word[np.arange(len(a)) + np.repeat(b_from, a_of)] = a + n_a * is_last
                is_last = np.zeros(len(b), bool)
                is_last[b_to - 1] = True
                word[np.arange(len(b)) + np.repeat(a_to, b_of)] = 2 * n_a + b + n_b * is_last
                _, offsets, data = words.take(pa.array(word)).buffers()
                byte, data = np.frombuffer(offsets, np.int64)[a_at + b_at], memoryview(data)
                digests = [hashlib.sha256(data[s : e - 1]).hexdigest() for s, e in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]

                n_links = a_of * b_of
                so_many = np.concatenate([[0], np.cumsum(n_links)])
                of = np.repeat(np.arange(len(cut_)), n_links)
                x, y = np.divmod(np.arange(so_many[-1]) - so_many[of], b_of[of])
                links = (a[a_from[of] + x].astype(np.int64) << 32) + b[b_from[of] + y]
                lists = pa.ListArray.from_arrays(pa.array(so_many[at].astype(np.int32)), pa.array(links))
                figures = [*(part.column(c) for c in ("k1", "k2", "node", "n")), *(pa.array(np.diff(x).astype(np.int32)) for x in (a_at, b_at, at)), pa.array(digests, pa.string()), lists]
                yield pa.record_batch(figures, names=["k1", "k2", "node", "n", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                i = j

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A text is encoded with a blank in front.  ``groups_sha256`` is of the groups'
    ids, ``a1,a2|b1;a3|b2``.  Links are pairs of tokens in one group; a pair of
    ids counts the documents that hold it linked, ``count_sum`` adds this up over
    the links, and ``n_best`` are links whose count no other pair with the same
    first id exceeds.  Null and empty texts, and those that a tokenizer does not
    give back byte by byte, have no tokens: zeros, and an empty string.  Repeated
    rows count as documents each, ids may be null, texts may have any length, an
    empty table stays empty, and other columns play no part.
    """
    spark = docs.sparkSession
    files = files or load_files()
    both = tokenizers_of(*files)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("text"))
    kept = TokenTable(rows.where("text <> ''").select("k1", "k2", "text"), files)
    tokens = kept.read()
    grouped = groups(tokens, cuts(tokens))
    figures = ["k1", "k2", "node", "n", "n_a", "n_b", "n_groups", "groups_sha256"]
    kinds = "k1 long, k2 long, node long, n long, n_a int, n_b int, n_groups int, groups_sha256 string, links array<long>"
    one = grouped.mapInArrow(_pairs(len(both.a_bytes), len(both.b_bytes)), kinds)
    folder = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    with co_partitioned(spark):
        one.write.option("compression", "zstd").parquet(folder)
    kept.drop()
    linked = spark.read.parquet(folder)

    # documents that hold a link, and how many rows of links it has
    held = linked.select("n", F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.sum("n").alias("docs"))
    times = linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = cut(held.join(times, "link"))
    top = counts.groupBy(F.shiftright("link", 32).alias("a_id")).agg(F.max("docs").alias("most"))  # a row for each id of the vocabulary at most
    judged = counts.join(F.broadcast(top), F.shiftright("link", 32) == F.col("a_id")).select("link", "docs", (F.col("docs") == F.col("most")).alias("best"), "n")
    sums = counts.agg(F.count("*").alias("links"), F.sum("n").alias("n")).first()
    own = linked.select("node", F.explode("links").alias("link"))
    if sums["links"] <= BROADCAST_LINKS:
        met = own.join(F.broadcast(judged), "link")
    else:
        met = join_counted(own, judged, "link", hot_bound(sums["n"]), F.col("node"))
    per_node = met.groupBy("node").agg(F.count("*").alias("n_links"), F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("docs").alias("count_sum"))
    of_text = linked.select(*figures).join(per_node, "node").drop("node")
    found = join_counted(rows.select("doc", "k1", "k2"), of_text, ["k1", "k2"], hot_bound(linked.agg(F.sum("n")).first()[0] or 0), F.xxhash64(F.monotonically_increasing_id()), F.lit(0).cast("long"), keep=True)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("doc", *map(number, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("doc", "doc_id")
