"""Benchmark decontamination by winnowed fingerprints.

Both sides are reduced to fingerprints: of every window of ``w`` consecutive
k-grams (k words each) the one with the least hash is kept, where
``k + w - 1`` is the window length.  Two texts that share a window of that
many words therefore share a fingerprint, at the same place of the window.
Equal fingerprints give alignments, which are extended to maximal equal runs.

The fingerprints of a benchmark up to a fixed size are broadcast, and every
text passes them once, so documents are never shuffled and a passage that a
third of them hold makes no hot key.  Those of a larger benchmark are joined
with the fingerprints of documents that pass a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.bytewords import Words, blocks, grams
from trailmark.llm.common import cut, cut_small, fresh, join_hot, table, without

WINDOW = 10
GRAM = 5
#: Words of benchmark text up to which its index is broadcast (8 bytes a word, and as much for the index).
INDEX_WORDS = 1_000_000
#: Bits of the bitmap of fingerprints of larger benchmarks.
BITMAP_BITS = 1 << 25
#: Parts that the rows of a key are dealt to where a key may be hot.
SALTS = 64


def winnow(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Indexes of the k-grams kept: of each w in a row of one text the least, the last of equal ones."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = hashes[:n].copy(), np.arange(n)
    for j in range(1, w):
        lower = hashes[j : j + n] <= best
        best = np.where(lower, hashes[j : j + n], best)
        place = np.where(lower, np.arange(j, j + n), place)
    whole = doc[at[:n]] == doc[at[w - 1 :]]
    return np.unique(place[whole])


class BenchmarkIndex:
    """Fingerprints of benchmark items: ``(item id, word hashes)`` each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = [i for i, _ in items]
        sizes = np.array([len(h) for _, h in items], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hash = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(items)), sizes)
        prints, places = [], []
        words = Words.__new__(Words)
        words.hash, words.doc = self.hash, self.item
        hashes, at = grams(words, gram)
        chosen = winnow(hashes, at, self.item, window - gram + 1)
        prints.append(hashes[chosen])
        places.append(at[chosen])
        self.short = sorted({int(n) for n in sizes if 0 < n < window})
        for n in self.short:  # an item shorter than the window is one window
            hashes, at = grams(words, n)
            own = sizes[self.item[at]] == n
            prints.append(hashes[own])
            places.append(at[own])
        self.print = np.concatenate(prints)
        self.place = np.concatenate(places).astype(np.int64)
        order = np.argsort(self.print, kind="stable")
        self.print, self.place = self.print[order], self.place[order]

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end word) of every maximal run that holds a window."""
        shapes = [(self.gram, self.window - self.gram + 1), *((n, 1) for n in self.short)]
        found = []
        for k, w in shapes:
            hashes, at = grams(words, k)
            keep = winnow(hashes, at, words.doc, w)
            hashes, at = hashes[keep], at[keep]
            left = np.searchsorted(self.print, hashes, side="left")
            count = np.searchsorted(self.print, hashes, side="right") - left
            some = np.flatnonzero(count)
            found.append(np.stack([at[some], left[some], count[some]]))
        at, left, count = np.concatenate(found, axis=1)
        if not len(at):
            return
        # texts that repeat words have alignments at nearly every offset: their windows are looked up instead
        n_texts = len(words.first) - 1
        many = np.bincount(words.doc[at], weights=count, minlength=n_texts) > 8 * np.diff(words.first) + 1000
        for doc in np.flatnonzero(many):
            own = words.doc[at] == doc
            starts, one = np.unique(left[own], return_index=True)
            places = np.concatenate([self.place[i : i + n] for i, n in zip(starts, count[own][one], strict=True)])
            yield from self._window_hits(words, int(doc), np.unique(self.item[places]))
        at, left, count = (x[~many[words.doc[at]]] for x in (at, left, count))
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = self.place[np.repeat(left, count) + steps]
        mine = np.repeat(at, count)
        pairs = np.unique(np.stack([words.doc[mine], self.item[place], mine - place]), axis=1)
        for doc, item, diagonal in pairs.T.tolist():
            a = max(int(words.first[doc]), int(self.first[item]) + diagonal)
            z = min(int(words.first[doc + 1]), int(self.first[item + 1]) + diagonal)
            if z <= a:
                continue
            equal = words.hash[a:z] == self.hash[a - diagonal : z - diagonal]
            least = min(self.window, int(self.first[item + 1] - self.first[item]))
            for s, e in _runs(equal):
                if e - s >= least:
                    yield doc, item, a + s, a + e

    def _window_hits(self, words: Words, doc: int, items: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The words of one text that are inside of windows of ``items``, as runs."""
        base = int(words.first[doc])
        own = words.hash[base : int(words.first[doc + 1])]
        windows: dict[int, np.ndarray] = {}
        for item in items.tolist():
            theirs = self.hash[self.first[item] : self.first[item + 1]]
            n = min(self.window, len(theirs))
            if n not in windows:
                windows[n] = _window_hashes(own, n)
            begins = np.flatnonzero(np.isin(windows[n], _window_hashes(theirs, n)))
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, begins, 1)
            np.add.at(edge, begins + n, -1)
            for s, e in _runs(np.cumsum(edge[:-1]) > 0):
                yield doc, item, base + s, base + e


def _window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    words = Words.__new__(Words)
    words.hash, words.doc = hashes, np.zeros(len(hashes), np.int64)
    return grams(words, n)[0]


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of true values."""
    turn = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    yield from zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, hashes, n): the word hashes of each item with words; a null id is 'null'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in blocks(batch.column(1)):
                words = Words(data, off)
                first = words.first
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array([words.hash[first[d] : first[d + 1]].tobytes() for d in range(j - i)], pa.binary()), pa.array(np.diff(first).astype(np.int64))],
                    names=["item", "hashes", "n"],
                )

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, hashes binary, n long").where("n > 0")


_ADDED = T.StructType([T.StructField("_n_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("_items", T.ArrayType(T.StringType()))])


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """``docs`` with ``_n_words`` long, ``_spans`` array<struct<first, end>> (hit words,
    merged and in order) and ``_items`` array<string> (ids of items with an occurring window).

    A null or empty text has no words and no hits.  A benchmark without words
    hits nothing.  Texts and items may have any length.  Repeated rows are
    treated alike; rows are neither lost nor added.  All columns of ``docs``
    stay, whatever their names, but for the three added, which are replaced.
    """
    docs = without(docs, *_ADDED.names)
    items = item_words(benchmark)
    total = items.agg(F.sum("n")).first()[0] or 0
    if total > index_words:
        return _mark_by_join(docs, items, text_col, window, gram)
    rows = items.select("item", "hashes").collect()  # index_words words at most
    shipped = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex([(r.item, np.frombuffer(r.hashes, dtype=np.uint64)) for r in sorted(rows)], window, gram))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            spans, items = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j, data, off in blocks(batch.column(at)):
                words = Words(data, off)
                counts[i:j] = np.diff(words.first)
                for doc, item, a, z in index.hits(words):
                    base = int(words.first[doc])
                    spans[i + doc].append((a - base, z - base))
                    items[i + doc].append(index.ids[item])
            yield pa.record_batch([*batch.columns, *_added(counts, spans, items)], names=[*batch.schema.names, *_ADDED.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_ADDED.fields]))


def _added(counts: np.ndarray, spans: list[list[tuple[int, int]]], items: list[list[str]]) -> list[pa.Array]:
    merged = [[{"first": a, "end": z} for a, z in _merged(s)] for s in spans]
    return [pa.array(counts), pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]


def _mark_by_join(docs: DataFrame, items: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """``mark_contamination`` by a join of fingerprints, for benchmarks of any size.

    Fingerprints of equal texts are joined once.  Those that many texts hold,
    items that many texts hit, and texts of many copies are dealt in parts.
    """
    context = docs.sparkSession.sparkContext
    items = cut(items.withColumn("item_no", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect())

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = BenchmarkIndex([("", np.frombuffer(h, np.uint64)) for h in batch.column(1).to_pylist()], window, gram)
            some = np.unique(np.stack([index.print.view(np.int64), index.item[index.place]]), axis=1)
            yield pa.record_batch([pa.array(some[0]), batch.column(0).take(pa.array(some[1]))], names=["print", "item_no"])

    prints = cut(items.select("item_no", "hashes").mapInArrow(item_prints, "print long, item_no long"))
    bit = F.pmod("print", F.lit(BITMAP_BITS))
    filled = prints.select(bit.alias("place")).selectExpr("shiftright(place, 5) AS at", "shiftleft(1L, CAST(place % 32 AS INT)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    bitmap[filled["at"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
    shipped = context.broadcast(bitmap)

    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [F.xxhash64(body), F.xxhash64(F.lit(1), body)]
    texts = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), body.alias("text"))

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            for i, _, data, off in blocks(batch.column(2)):
                words = Words(data, off)
                for k, w in [(gram, window - gram + 1), *((n, 1) for n in short)]:
                    hashes, at = grams(words, k)
                    keep = winnow(hashes, at, words.doc, w)
                    place = hashes[keep].view(np.int64) % BITMAP_BITS
                    known = keep[(bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1]
                    some = np.unique(np.stack([words.doc[at[known]], hashes[known].view(np.int64)]), axis=1)
                    rows = pa.array(some[0] + i)
                    yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(some[1])], names=["k1", "k2", "print"])

    found, n = cut_small(texts.mapInArrow(doc_prints, "k1 long, k2 long, print long").distinct())
    by_print = prints.groupBy("print").agg(F.collect_set("item_no").alias("items"))
    pairs = cut(join_hot(found, n, by_print, "print", F.col("k1")).select("k1", "k2", F.explode("items").alias("item_no")).distinct())
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = pairs.select("*", salt("k1", "k2")).join(items.select("item_no", "item", "hashes", all_salts), ["item_no", "salt"])
    held = held.groupBy("k1", "k2", salt("item_no")).agg(F.collect_list(F.struct("item", "hashes")).alias("held"))
    own = texts.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, names = [], []
            for text, some in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
                index = BenchmarkIndex([(x["item"], np.frombuffer(x["hashes"], np.uint64)) for x in some], window, gram)
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                hits = [*index.hits(Words(raw, np.array([0, len(raw)])))]
                spans.append([(a, z) for _, _, a, z in hits])
                names.append([index.ids[item] for _, item, _, _ in hits])
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), *_added(np.zeros(len(spans), np.int64), spans, names)[1:]], names=["k1", "k2", "spans", "items"])

    hits = held.join(own, ["k1", "k2"]).select("k1", "k2", "text", "held").mapInArrow(extend, "k1 long, k2 long, spans array<struct<first: long, end: long>>, items array<string>")
    of_text = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).where("size(spans) > 0")
    k1, k2, part, spans, items = fresh(docs, "k1", "k2", "part", "spans", "items")
    rows = docs.select("*", keys[0].alias(k1), keys[1].alias(k2), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias(part))
    rows = rows.join(of_text.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans), F.col("items").alias(items), all_salts.alias(part)), [k1, k2, part], "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], spans, items)
    at = docs.columns.index(text_col)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(Words(data, off).first) for _, _, data, off in blocks(batch.column(at))]
            spans = [[(x["first"], x["end"]) for x in s or []] for s in batch.columns[-2].to_pylist()]
            columns = _added(np.concatenate([np.zeros(0, np.int64), *counts]), spans, [x or [] for x in batch.columns[-1].to_pylist()])
            yield pa.record_batch([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], *_ADDED.names])

    return rows.mapInArrow(assemble, T.StructType([*docs.schema.fields, *_ADDED.fields]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with no word inside an occurring benchmark window, columns as they were.

    Null and empty texts and repeated rows stay; so does everything if the
    benchmark has no words.  All columns stay, whatever their names.
    """
    if len(without(docs, *_ADDED.names).columns) == len(docs.columns):
        return mark_contamination(docs, benchmark).where(F.size("_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return mark_contamination(packed, benchmark).where(F.size("_spans") == 0).select("row.*")


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return marked.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS("text")} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS("text")} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM items)),
doc_windows AS (
  SELECT rid, i, k, array_to_string(w[i + 1:i + k], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM src, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
hits AS (SELECT rid, i, k, item FROM doc_windows JOIN item_windows USING (k, win)),
words_hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
items_hit AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM src LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)
"""
