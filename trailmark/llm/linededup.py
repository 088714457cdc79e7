"""Line dedup: frequent lines are found by a range-partitioned sort of line hashes.

Lines are reduced to 128-bit hashes of their keys.  The rows (hash, document,
position) are range-partitioned by all of these, so that a line that a third of
all documents hold is spread over many partitions, and sorted within each.  One
streaming pass over a partition then sees all occurrences of a key in order:
first occurrences are known at once and a key's documents are counted by runs.
Only the first and the last key of a partition may go on in another one; their
rows are counted again by a grouped aggregation, whose result has at most two
keys for each partition.  The outcome is a compressed bitmap of kept lines for
each document, which is then applied to the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.bytewords import IS_BLANK, LOWER, SpanHash, blocks
from trailmark.llm.common import cut, fresh, without, table

MIN_DOCS = 10
#: Bytes of text that are hashed together, so that what is made of them stays in a processor's cache.
BLOCK_BYTES = 1 << 16
NEWLINE = 10
_KEY = ["h1", "h2", "doc", "tag", "pos"]


def _line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line, and where each text's lines begin."""
    breaks = np.flatnonzero(data == NEWLINE)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    count = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    return start, end, np.concatenate([[0], np.cumsum(count)])


def _tags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return SpanHash(data, 1)(off[:-1], off[1:]).view(np.int64)


def _emit_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            given = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, data, off in blocks(batch.column(1), BLOCK_BYTES):
                start, end, first = _line_bounds(data, off)
                tags = _tags(data, off)
                ids = np.where(null[i:j], tags, given[i:j])
                # of repeated rows the lines of one count, in each task
                pairs = list(zip(ids.tolist(), tags.tolist(), strict=True))
                again = np.array([p in seen or seen.add(p) is not None for p in pairs], bool)
                solid = np.flatnonzero(~IS_BLANK[data])
                a, z = np.searchsorted(solid, start), np.searchsorted(solid, end)
                some = np.flatnonzero(z > a)
                begin, stop = solid[a[some]], solid[z[some] - 1] + 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                long = points[stop] - points[begin] >= max(1, min_chars)
                doc = np.searchsorted(first, some, side="right") - 1
                long &= ~again[doc]
                some, begin, stop, doc = some[long], begin[long], stop[long], doc[long]
                low = LOWER[data]
                count = np.diff(first)
                yield pa.record_batch(
                    [
                        pa.array(SpanHash(low, 0)(begin, stop).view(np.int64)),
                        pa.array(SpanHash(low, 1)(begin, stop).view(np.int64)),
                        pa.array(ids[doc].astype(np.int64)),
                        pa.array(tags[doc]),
                        pa.array((some - first[doc]).astype(np.int32)),
                        pa.array(count[doc].astype(np.int32)),
                    ],
                    names=[*_KEY, "n_lines"],
                )

    return run


class _Key:
    """The key that the stream is at; it may have begun in an earlier batch."""

    def __init__(self, key: tuple[int, int], is_first: bool):
        self.key, self.is_first = key, is_first
        self.docs, self.last_doc, self.held, self.lead = 0, None, [], None

    def feed(self, rows: np.ndarray, docs: int, min_docs: int, keep_first: bool) -> list[tuple[np.ndarray, bool]]:
        if self.is_first:
            return [(rows, True)]
        if self.lead is not None:
            return [(rows, False)]
        self.docs += docs - (self.last_doc == int(rows[2, 0]))
        self.last_doc = int(rows[2, -1])
        self.held.append(rows)
        if self.docs < min_docs:
            return []
        rows = np.concatenate(self.held, axis=1)
        starts = np.flatnonzero(np.diff(rows[2], prepend=rows[2, :1] - 1))
        self.lead, self.held = rows[:, : starts[min_docs - 1] + 1], []
        return [(rows[:, 1:] if keep_first else rows, False)]

    def end(self) -> list[tuple[np.ndarray, bool]]:
        """What another partition must know of this key if it goes on there."""
        return [(x, True) for x in ([self.lead] if self.lead is not None else self.held)]


def _stream(min_docs: int, keep_first: bool):
    """Rows to drop, of keys that are decided within the partition, and ``edge`` rows of its first and last key.

    The edge rows of a key hold all its documents, or so many that it is frequent, and its first occurrence.
    """

    def out(rows: np.ndarray, edge: bool) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(c) for c in rows[:4]), pa.array(rows[4].astype(np.int32)), pa.array(rows[5].astype(np.int32)), pa.array(np.full(rows.shape[1], edge))], names=[*_KEY, "n_lines", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Key | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            new_key = np.ones(rows.shape[1], bool)
            new_key[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            new_doc = new_key.copy()
            new_doc[1:] |= rows[2, 1:] != rows[2, :-1]
            begin = np.flatnonzero(new_key)
            end = np.append(begin[1:], rows.shape[1])
            docs = np.add.reduceat(new_doc.astype(np.int64), begin)
            ready: list[tuple[np.ndarray, bool]] = []
            for r in (0, len(begin) - 1) if len(begin) > 1 else (0,):
                if r:  # runs between the first and the last begin and end here
                    often = np.flatnonzero(docs[1:r] >= min_docs) + 1
                    if len(often):
                        size = end[often] - begin[often]
                        at = np.repeat(begin[often] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        ready.append((rows[:, np.setdiff1d(at, begin[often]) if keep_first else at], False))
                key = (int(rows[0, begin[r]]), int(rows[1, begin[r]]))
                if state is None or state.key != key:
                    state = _Key(key, state is None)
                ready += state.feed(rows[:, begin[r] : end[r]], int(docs[r]), min_docs, keep_first)
            yield from (out(x, edge) for x, edge in ready if x.shape[1])
        if state is not None:
            yield from (out(x, edge) for x, edge in state.end())

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for at, n in zip(batch.column("drop"), batch.column("n_lines"), strict=True):
            keep = np.ones(n.as_py(), bool)
            keep[at.values.to_numpy()] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.record_batch([batch.column("doc"), batch.column("tag"), batch.column("n_lines"), pa.array(maps, pa.binary())], names=["doc", "tag", "n_lines", "bitmap"])


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc, tag, n_lines, bitmap) of every text that loses lines.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
    lower-cased.  Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all lines (``keep="none"``) or all but the first
    by document and position (``keep="first"``).  ``bitmap`` is the zlib-packed
    bits of the kept lines.  Documents are told apart by their integer id, those
    without one by ``tag``, a hash of the text; rows that share an id but not the
    text get bitmaps of their own, and equal rows count once.  Null and empty texts are one empty line, which has no key.  Texts
    may have any length; an empty table has no bitmaps; other columns play no part.
    """
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_emit_lines(min_chars), "h1 long, h2 long, doc long, tag long, pos int, n_lines int")
    spread = lines.repartitionByRange(*[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY)
    found = cut(spread.mapInArrow(_stream(min_docs, keep == "first"), "h1 long, h2 long, doc long, tag long, pos int, n_lines int, edge boolean"))
    edges = found.where("edge")
    # the first and the last key of each partition of the sort, so that this table has two rows a partition at most
    totals = edges.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs"), F.min(F.struct("doc", "tag", "pos")).alias("head")).where(F.col("docs") >= min_docs)
    across = edges.join(F.broadcast(totals), ["h1", "h2"])
    if keep == "first":
        across = across.where(F.struct("doc", "tag", "pos") != F.col("head"))
    cols = ["doc", "tag", "pos", "n_lines"]
    drops = found.where("not edge").select(*cols).unionByName(across.select(*cols))
    return drops.groupBy("doc", "tag").agg(F.collect_set("pos").alias("drop"), F.max("n_lines").alias("n_lines")).mapInArrow(_pack, "doc long, tag long, n_lines int, bitmap binary")


def _tagger(at: int, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [_tags(data, off) for _, _, data, off in blocks(batch.column(at), BLOCK_BYTES)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(tags) if tags else np.zeros(0, np.int64))], names=[*batch.schema.names, tag])

    return run


def _apply(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Texts in column ``at`` without the lines that the bitmap in the last column lacks."""
    for batch in batches:
        texts, total, lost = [], [], []
        for text, bitmap in zip(batch.column(at), batch.columns[-1], strict=True):
            text, bitmap = text.as_py() or "", bitmap.as_py()
            n = text.count("\n") + 1
            total.append(n)
            if bitmap is None:
                texts.append(text)
                lost.append(0)
            else:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
                texts.append("\n".join(x for x, k in zip(text.split("\n"), keep, strict=True) if k))
                lost.append(n - int(keep.sum()))
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*batch.schema.names[:-1], "_n_lines", "_n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text (joined by \\n; null becomes empty), ``_n_lines`` and ``_n_dropped``.

    Other columns stay, whatever their names, but for the two counts, which are replaced.
    """
    docs = without(docs, "_n_lines", "_n_dropped")
    at = docs.columns.index(text_col)
    fields = docs.schema.fields
    tag, doc, own, bits = fresh(docs, "tag", "doc", "own_tag", "bitmap")
    tagged = docs.mapInArrow(_tagger(at, tag), T.StructType([*fields, T.StructField(tag, T.LongType())]))
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("tag").alias(own), F.col("bitmap").alias(bits))
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.col(tag)) == F.col(doc)) & (F.col(tag) == F.col(own))
    joined = tagged.join(maps, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], bits)
    return joined.mapInArrow(lambda batches: _apply(batches, at), T.StructType([*fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())]))


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that :func:`line_keep_bitmaps` does not keep, and the two counts."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep), id_col, text_col)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Lines of `src` (doc_id, text), whether they stay, and how to join those that do.
LINES_SQL = """
lines AS (
  SELECT rid, doc_id, tag, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, tag, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT rid, doc_id, 'null:' || md5(coalesce(text, '')) AS tag, string_split(coalesce(text, ''), chr(10)) AS parts FROM src))),
often AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), tag)) >= 10),
kept AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE often.key IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '') AS text
  FROM lines LEFT JOIN often ON lines.key = often.key GROUP BY rid)
"""

OP6_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept
"""
