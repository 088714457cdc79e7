"""Workbooks (.xlsx) as a table of rows or of cells, each sheet read as a stream by a task of its own.

A file is opened only to find its sheets: their compressed bytes are dealt to
the tasks, which unpack and parse them piece by piece.  So memory holds a part
of a sheet, however many rows it has, and the table of shared strings.  Sheets
and shared strings that unpack to more than a fixed size are refused.  Old
binary workbooks (.xls) have no reader here; they come out as an error row.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet_no int, sheet string, r int, c int, value string, merged_to_r int, merged_to_c int, error string"
#: A row of a sheet: its cells, and all merged ranges that cover it, with the value of their first cell.
CELLS_TYPE = "array<struct<c: int, value: string>>"
RANGES_TYPE = "array<struct<r: int, c: int, merged_to_r: int, merged_to_c: int, value: string>>"
ROWS = f"path string, sheet_no int, sheet string, r int, cells {CELLS_TYPE}, ranges {RANGES_TYPE}, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("value", pa.string()), ("merged_to_r", pa.int32()), ("merged_to_c", pa.int32()), ("error", pa.string())])
_ROWS = pa.schema([
    ("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("r", pa.int32()), ("cells", pa.list_(pa.struct([("c", pa.int32()), ("value", pa.string())]))),
    ("ranges", pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32()), ("merged_to_r", pa.int32()), ("merged_to_c", pa.int32()), ("value", pa.string())]))), ("error", pa.string()),
])
_PARTS = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("method", pa.int32()), ("body", pa.binary()), ("shared_method", pa.int32()), ("shared", pa.binary()), ("error", pa.string())])
#: Files above this are refused.
MAX_BYTES = 50 << 20
#: Unpacked bytes above which a sheet, and a table of shared strings, is refused.
MAX_SHEET_BYTES, MAX_STRINGS_BYTES = 4 << 30, 1 << 28
#: Bytes that are unpacked at once, and cells that are handed on together.
PIECE, CELLS_AT_ONCE = 1 << 16, 20_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_STRINGS = "xl/sharedStrings.xml"
_BROKEN = (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, AttributeError, NotImplementedError, zlib.error, struct.error)


class TooLarge(ValueError):
    pass


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref.replace("$", "")).groups()
    c = 0
    for ch in letters:
        c = c * 26 + ord(ch) - 64
    return int(digits) - 1, c - 1


def _pieces(method: int, body: bytes, most: int) -> Iterator[bytes]:
    """The unpacked bytes of an archive member, piece by piece."""
    total, at = 0, 0
    packed = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    rest = b""
    while at < len(body) or rest:
        if packed is None:
            piece, at = body[at : at + PIECE], at + PIECE
        else:
            if not rest:
                rest, at = body[at : at + PIECE], at + PIECE
            piece = packed.decompress(rest, PIECE)
            rest = packed.unconsumed_tail
        total += len(piece)
        if total > most:
            raise TooLarge
        yield piece
    if packed is not None:
        yield packed.flush()


def _elements(method: int, body: bytes, most: int, *ends: str) -> Iterator[ET.Element]:
    """Elements of these names when they are complete; what is done with is dropped, so that the tree never grows."""
    parser = ET.XMLPullParser(("start", "end"))
    names, open_, inside = {f"{_MAIN}{e}" for e in ends}, [], 0
    for piece in chain(_pieces(method, body, most), (None,)):
        # the parser may hold back what it has until it is told that no more comes
        parser.close() if piece is None else parser.feed(piece)
        for event, element in parser.read_events():
            wanted = element.tag in names
            if event == "start":
                open_.append(element)
                inside += wanted
                continue
            open_.pop()
            inside -= wanted
            if wanted:
                yield element
            # a complete element goes from the one around it, but for parts of what is wanted
            if open_ and not inside:
                open_[-1].remove(element)


def _texts(method: int, body: bytes) -> list[str]:
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in _elements(method, body, MAX_STRINGS_BYTES, "si")]


def _merged(method: int, body: bytes) -> dict[tuple[int, int], tuple[int, int]]:
    """The last cell of each merged range by its first one; the whole sheet is parsed, so a broken one shows here."""
    out = {}
    for e in _elements(method, body, MAX_SHEET_BYTES, "mergeCell"):
        first, _, last = e.get("ref").partition(":")
        out[_place(first)] = _place(last or first)
    return out


def _values(method: int, body: bytes, shared: list[str] | None) -> Iterator[tuple[int, int, str]]:
    """(row, column, value) of each cell that has one, row by row; without ``shared`` the values of shared strings are empty."""
    for row in _elements(method, body, MAX_SHEET_BYTES, "row"):
        for cell in row.iter(f"{_MAIN}c"):
            kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = "" if shared is None else shared[int(v.text)]
            else:
                value = v.text
            yield (*_place(cell.get("r")), value)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    names = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = names[s.get(_REL)]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def _packed(z: zipfile.ZipFile, content: bytes, name: str) -> tuple[int, bytes]:
    """How a member is packed, and its bytes as they are in the archive."""
    info = z.getinfo(name)
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError
    name_length, extra_length = struct.unpack_from("<HH", content, info.header_offset + 26)
    begin = info.header_offset + 30 + name_length + extra_length
    return info.compress_type, content[begin : begin + info.compress_size]


def _why(e: Exception) -> str:
    return "the workbook unpacks to too much" if isinstance(e, TooLarge) else f"the workbook can't be read: {type(e).__name__}"


def workbook_parts(path: str, content: bytes) -> list[tuple]:
    """Rows of _PARTS: one for each sheet with its packed bytes and those of the shared strings, or one error."""
    fail = lambda why: [(path, None, None, None, None, None, None, why)]
    if len(content) > MAX_BYTES:
        return fail("the file is larger than 50 MB")
    if content[:4] != b"PK\x03\x04":
        return fail("not an .xlsx workbook")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            strings = _packed(z, content, _STRINGS) if _STRINGS in z.namelist() else (None, None)
            parts = [(path, no, name, *_packed(z, content, part), *strings, None) for no, (name, part) in enumerate(_sheets(z))]
            # a sheet's first cell is found at its beginning
            if any(next(_values(p[3], p[4], None), None) is not None for p in parts):
                return parts
            return fail("the workbook is empty")
    except _BROKEN as e:
        return fail(_why(e))


def sheet_cells(part: tuple) -> Iterator[tuple]:
    """Rows of CELLS of one row of _PARTS; the anchor of a merged range names the range's last cell."""
    path, no, name, method, body, shared_method, shared, error = part
    if error is not None:
        yield (path, None, None, None, None, None, None, None, error)
        return
    try:
        strings = [] if shared is None else _texts(shared_method, shared)
        merged = _merged(method, body)
        for r, c, value in _values(method, body, strings):
            yield (path, no, name, r, c, value, *merged.get((r, c), (None, None)), None)
    except _BROKEN as e:
        yield (path, None, None, None, None, None, None, None, _why(e))


def _covering(ranges: list[tuple]) -> Callable[[int], list[tuple]]:
    """Which of ``ranges``, sorted by their first row, cover a row; rows that are asked for in their order cost no more than what begins and ends."""
    here, at, last = [], 0, -1

    def of(r: int) -> list[tuple]:
        nonlocal here, at, last
        if r < last:  # rows of a file may come in any order
            here, at = ranges, bisect_right(ranges, r, key=lambda m: m[0])
            here = here[:at]
        while at < len(ranges) and ranges[at][0] <= r:
            here, at = [*here, ranges[at]], at + 1
        here, last = [m for m in here if m[2] >= r], r
        return here

    return of


def sheet_rows(part: tuple) -> Iterator[tuple]:
    """Rows of ROWS of one row of _PARTS."""
    path, no, name, method, body, shared_method, shared, error = part
    fail = lambda why: (path, None, None, None, [], [], why)
    if error is not None:
        yield fail(error)
        return
    try:
        strings = [] if shared is None else _texts(shared_method, shared)
        merged = _merged(method, body)
        # a range may begin in a row that comes later in the file, so values of first cells are looked up before
        firsts = ((r, c, *merged[r, c], value) for r, c, value in (_values(method, body, strings) if merged else ()) if (r, c) in merged)
        covering = _covering(sorted(m for m in firsts if m[2] >= m[0] and m[3] >= m[1]))
        for r, cells in groupby(_values(method, body, strings), key=lambda x: x[0]):
            yield (path, no, name, r, [(c, value) for _, c, value in cells], covering(r), None)
    except _BROKEN as e:
        yield fail(_why(e))


def workbook_cells(path: str, content: bytes) -> list[tuple]:
    """Rows of CELLS of a whole file."""
    return [cell for part in workbook_parts(path, content) for cell in sheet_cells(part)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sheets_of(files: DataFrame, of: Callable[[tuple], Iterator[tuple]], n_cells: Callable[[tuple], int], schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``of`` makes of all sheets of ``files`` (path, content), each sheet in a task of its own or with other small ones."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(workbook_parts(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), _PARTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, n = [], 0
                for row in of(tuple(c[i].as_py() for c in batch.columns)):
                    rows.append(row)
                    n += n_cells(row)
                    if n >= CELLS_AT_ONCE:
                        yield _batch(rows, schema)
                        rows, n = [], 0
                yield _batch(rows, schema)

    parts = files.select("path", "content").mapInArrow(split, "path string, sheet_no int, sheet string, method int, body binary, shared_method int, shared binary, error string")
    return parts.repartition("path", "sheet_no").mapInArrow(read, ddl)


def cells_of(files: DataFrame) -> DataFrame:
    """CELLS of all workbooks of ``files`` (path, content)."""
    return _sheets_of(files, sheet_cells, lambda _: 1, _SCHEMA, CELLS)


def rows_of(files: DataFrame) -> DataFrame:
    """ROWS of all workbooks of ``files`` (path, content)."""
    return _sheets_of(files, sheet_rows, lambda row: 1 + len(row[4]) + len(row[5]), _ROWS, ROWS)


def _read(spark: SparkSession, path: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    refused = files.where(F.col("length") > MAX_BYTES).select("path", F.lit("the file is larger than 50 MB").alias("error"))
    return of(files.where(F.col("length") <= MAX_BYTES)).unionByName(refused, allowMissingColumns=True)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """CELLS of all workbooks under ``path`` (any path that Spark can read); files that are too large are not opened."""
    return _read(spark, path, cells_of)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of all workbooks under ``path``, as :func:`read_workbooks` reads them; rows need not be put together from cells then."""
    return _read(spark, path, rows_of)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, source_sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("source_sha256"))
