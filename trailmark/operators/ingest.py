"""Ingestion: cells of workbooks to ledger rows, and why a sheet was refused.

Sheets with data that can't be read for sure contribute no rows but an error:
partial figures are worse than none.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import parse
from trailmark.functions.banks import canonical_ifsc, with_bank
from trailmark.functions.headers import HEADERS
from trailmark.functions.similar import best_labels
from trailmark.functions.text import blank_to_null, let, loose_header, normalised_header, without_label
from trailmark.schema import LEDGER
from trailmark.session import stored

HEADER_ROWS, HEADER_MATCHES = 11, 3
#: Files up to which the table of them is broadcast.
BROADCAST_FILES = 100_000
#: Sheets, and ways in which sheets are laid out, up to which the table of them is broadcast: some fifty bytes and two kilobytes each.
BROADCAST_SHEETS, BROADCAST_LAYOUTS = 4_000_000, 10_000
#: Rows of a sheet that look for their merged ranges together.
BLOCK = 1024
SHEET = ["path", "sheet_no", "sheet"]
ROW = [*SHEET, "r"]
#: Sheet names in lower case, and their channels (fixed values); for names that no pattern knows.
SHEET_NAMES = [
    ("money transfer to", "TRANSFER"),
    ("withdrawal through atm", "ATM"),
    ("withdrawal through pos", "POS"),
    ("aeps", "AEPS"),
    ("transaction put on hold", "HOLD"),
    ("others less then 500", "OTHER"),
    ("old transaction", "OLD_TRANSACTION"),
]
#: Rows of a sheet in which an export names one of its columns at least, the words that tell (fixed values), and file endings.
TOKEN_ROWS = 5
TOKENS = ("layer", "acknowledg", "account no", "accountno", "beneficiary", "disputed", "utr")
ENDINGS = (".xlsx", ".xls")
#: Headers that only sheets of old transactions have, in their loose form, and the columns that they become (fixed values).
OLD_ONLY = {"ptrans": "parent_txn", "paccountno": "parent_account", "pifsccode": "pifsc_code", "pisnodal": "pis_nodal"}


def _strict(h: str) -> str:
    return " ".join(h.lower().split())


def _loose(h: str) -> str:
    return "".join(ch for ch in h.lower() if ch.isascii() and ch.isalnum() or "ऀ" <= ch <= "ॿ")


def _known() -> tuple[dict[str, str], dict[str, str]]:
    """Headers by their normalised and by their loose form; loose forms of two columns are left out."""
    strict: dict[str, str] = {}
    loose: dict[str, set[str]] = {}
    for column, names in HEADERS.items():
        for name in (column, *names):
            strict[_strict(name)] = column
            loose.setdefault(_loose(name), set()).add(column)
    return strict, {k: next(iter(v)) for k, v in loose.items() if k and len(v) == 1}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def known_column(header: Column) -> Column:
    """The ledger column that a header names, exactly or but for punctuation."""
    strict, loose = _known()
    return F.coalesce(_lookup(strict, normalised_header(header)), _lookup(loose, loose_header(header)))


def upload_problems(rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, problem): of all files of ``rows`` (ROWS), or of ``paths`` too if ``rows`` are the first ones only, files that have another ending than workbooks, or no header word in the first rows of any sheet."""
    words = lambda x: F.regexp_replace(F.lower(x["value"]), r"\s+", " ")
    tells = (F.col("r") < TOKEN_ROWS) & F.exists("cells", lambda x: reduce(or_, [words(x).contains(t) for t in TOKENS]))
    files = rows.groupBy("path").agg(F.max("error").alias("_error"), F.coalesce(F.bool_or(tells), F.lit(False)).alias("_tells"))
    if paths is not None:
        files = files.join(paths.distinct(), "path", "right").withColumn("_tells", F.coalesce("_tells", F.lit(False)))
    fine = reduce(or_, [F.lower("path").endswith(e) for e in ENDINGS])
    problem = F.when(F.col("_error").isNotNull(), F.col("_error")).when(~fine, "FILE_TYPE").when(~F.col("_tells"), "NOT_AN_EXPORT")
    return files.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, r, cells, ranges, error): one row for each row of a sheet, with the merged ranges that begin in it."""
    cell, merged = F.struct("c", "value"), F.struct("r", "c", "merged_to_r", "merged_to_c", "value")
    return cells.groupBy(*ROW).agg(F.collect_list(F.when(F.col("error").isNull(), cell)).alias("cells"), F.collect_list(F.when(F.col("merged_to_r").isNotNull(), merged)).alias("ranges"), F.max("error").alias("error"))


def with_ranges(rows: DataFrame) -> DataFrame:
    """:func:`sheet_rows` as ROWS, each row with all merged ranges that cover it.

    A row meets the ranges of its block of rows only, so a sheet with a range
    in each of its rows costs no more than its rows.
    """
    block = lambda r: F.floor(r / BLOCK)
    ranges = rows.where(F.size("ranges") > 0).select(*SHEET, F.explode("ranges").alias("m")).where("m.merged_to_r >= m.r AND m.merged_to_c >= m.c")
    blocks = ranges.select(*SHEET, "m", F.explode(F.sequence(block(F.col("m.r")), block(F.col("m.merged_to_r")))).alias("_block"))
    blocks = blocks.groupBy(*SHEET, "_block").agg(F.collect_list("m").alias("_m"))
    here = F.filter("_m", lambda m: F.col("r").between(m["r"], m["merged_to_r"]))
    own = rows.withColumn("_block", block(F.col("r"))).drop("ranges")
    return own.join(blocks, [*SHEET, "_block"], "left").select(*ROW, "cells", F.coalesce(here, F.array()).alias("ranges"), "error")


def row_form(cells: DataFrame) -> DataFrame:
    """``cells`` (CELLS) as ROWS; ROWS stay as they are."""
    return cells if "cells" in cells.columns else with_ranges(stored(sheet_rows(cells)))


def cells_in(rows: DataFrame) -> DataFrame:
    """The cells of :func:`sheet_rows`: (path, sheet_no, sheet, r, c, value)."""
    return rows.select(*ROW, F.inline("cells"))


def _filled(x: Column) -> Column:
    return blank_to_null(x["value"]).isNotNull()


def _sure(m: Column) -> Column:
    """Whether a range fills one column, whatever others the sheet uses."""
    return (m["c"] == m["merged_to_c"]) & _filled(m)


def used_columns(rows: DataFrame, whole: DataFrame) -> DataFrame | None:
    """(path, sheet_no, sheet, _used): columns that have values in ``whole``, of sheets in which ``rows`` are covered by ranges over several columns, or over empty ones; None without such sheets."""
    asked = stored(rows.where("error IS NULL").where(F.exists("ranges", lambda m: ~_sure(m))).select(*SHEET).distinct())
    if asked.isEmpty():
        return None
    columns = whole.where("error IS NULL").select(*SHEET, F.array_distinct(F.transform(F.filter("cells", _filled), lambda x: x["c"])).alias("_c"))
    return stored(columns.join(asked, SHEET, "left_semi").select(*SHEET, F.explode("_c").alias("c")).groupBy(*SHEET).agg(F.collect_set("c").alias("_used")))


def fill_rows(rows: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """ROWS without their ranges, which are filled as :func:`fill_merged` says; ``used`` as :func:`used_columns` finds it. Other columns stay."""
    own = rows.where("error IS NULL").drop("error")
    rest = [c for c in own.columns if c not in ("cells", "ranges")]

    def fill(some: DataFrame, places) -> DataFrame:
        added = F.flatten(F.transform("ranges", lambda m: F.transform(places(m), lambda c: F.struct(c.alias("c"), m["value"].alias("value")))))
        missing = F.filter(added, lambda x: ~F.exists("cells", lambda y: (y["c"] == x["c"]) & _filled(y)))
        new = let(missing, lambda ms: F.concat(F.filter("cells", lambda y: ~F.exists(ms, lambda x: x["c"] == y["c"])), ms))
        met = (F.size("ranges") > 0) & F.exists("cells", _filled)
        # made once for each row, as conditions and columns name them often
        return some.select(*rest, F.inline(F.array(F.struct(F.when(met, new).otherwise(F.col("cells")).alias("cells")))))

    if used is None:
        return fill(own, lambda m: F.array(m["c"]))
    # only rows that such ranges cover look for the columns of their sheet
    wide = F.exists("ranges", lambda m: ~_sure(m))
    places = lambda m: F.when(_sure(m), F.array(m["c"])).otherwise(F.filter("_used", lambda c: c.between(m["c"], m["merged_to_c"])))
    return fill(own.where(~wide), lambda m: F.array(m["c"])).unionByName(fill(own.where(wide).join(used, SHEET, "left"), places))


def fill_merged(cells: DataFrame) -> DataFrame:
    """The cells of CELLS or ROWS, with the value of a merged range's first cell in all of its empty ones, in rows and columns that the sheet uses.

    A merged range may span a whole column or sheet; places are made only for
    the rows and columns in which some cell of the sheet has a value.
    """
    rows = stored(row_form(cells))
    return cells_in(fill_rows(rows, used_columns(rows, rows)))


def _heads(rows: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, header_r, cells): of the first rows the one that names most columns, three at least, the upper one of equals."""
    known = F.array_distinct(F.filter(F.transform("cells", lambda x: known_column(x["value"])), lambda f: f.isNotNull()))
    some = rows.where(F.col("r") < HEADER_ROWS).select(*ROW, F.array_sort("cells").alias("cells"), F.size(known).alias("matches")).where(F.col("matches") >= HEADER_MATCHES)
    rank = F.row_number().over(Window.partitionBy(*SHEET).orderBy(F.desc("matches"), "r"))
    return some.withColumn("rank", rank).where("rank = 1").select(*SHEET, F.col("r").alias("header_r"), "cells")


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, header_r) of CELLS or ROWS, as they are: which row of a sheet names its columns."""
    rows = cells if "cells" in cells.columns else sheet_rows(cells)
    return _heads(rows).drop("cells")


def column_mapping(heads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_r, c, header, field, how) of header rows (keys, header_r, cells): which column is which field; the first column wins.

    Headers that are only similar are taken for fields that no other column names.
    """
    row = heads.select(*keys, "header_r", F.inline("cells")).where("value IS NOT NULL").withColumnRenamed("value", "header")
    exact = row.withColumn("field", known_column(F.col("header")))
    first = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "field").orderBy("c"))).where("rank = 1").drop("rank")
    sure = first(exact.where("field IS NOT NULL")).withColumn("how", F.lit("exact"))
    labels = sorted({(_loose(n), c) for c, names in HEADERS.items() for n in (c, *names)})
    place = [*keys, "header_r", "c", "header"]
    unknown = exact.where("field IS NULL").withColumn("_loose", loose_header(F.col("header"))).where(~F.col("_loose").isin(*OLD_ONLY))
    near = best_labels(unknown, place, "_loose", labels).withColumnRenamed("value", "field")
    near = first(near.join(sure.select(*keys, "field"), [*keys, "field"], "left_anti")).withColumn("how", F.lit("similar"))
    return sure.unionByName(near)


def sheet_channels(sheets: DataFrame) -> DataFrame:
    """(sheet, category, known) of names of sheets: by name, else by a similar name, else OTHER and not known."""
    names = sheets.select("sheet").distinct().withColumn("_category", parse.sheet_category(F.col("sheet")))
    name = F.trim(F.regexp_replace(F.lower("sheet"), "[^a-z0-9]+", " "))
    near = best_labels(names.where("_category IS NULL").withColumn("_name", name), ["sheet"], "_name", SHEET_NAMES)
    found = F.coalesce("_category", "value")
    return names.join(near, "sheet", "left").select("sheet", F.coalesce(found, F.lit("OTHER")).alias("category"), found.isNotNull().alias("known"))


def layout_places(layouts: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row for each of ``layouts`` (layout, header_r, cells) with mapped columns: where its fields are.

    ``fields``, ``at`` (the mapped columns and their headers), ``places`` (the
    column of each field, in the order of HEADERS) and ``old`` (the columns of
    each of OLD_ONLY).
    """
    at = mapping.groupBy("layout").agg(
        F.collect_set("field").alias("fields"),
        F.collect_list(F.struct("c", normalised_header(F.col("header")).alias("header"))).alias("at"),
        F.array(*[F.max(F.when(F.col("field") == f, F.col("c"))) for f in HEADERS]).alias("places"),
    )
    named = lambda f: F.transform(F.filter("cells", lambda x: _lookup(OLD_ONLY, loose_header(x["value"])) == f), lambda x: x["c"])
    return layouts.select("layout", "header_r", F.array(*[named(f) for f in OLD_ONLY.values()]).alias("old")).join(at, "layout")


def sheet_kinds(sheets: DataFrame, places: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, layout, category, known, missing, blind, _has_beneficiary) of ``sheets`` with their ``layout``.

    A sheet whose columns are ``missing`` is refused; a ``blind`` one says
    nowhere what channel its money went through.
    """
    got = lambda f: F.array_contains("fields", f)
    needs_amount = ~F.col("category").isin("OTHER", "OLD_TRANSACTION")
    missing = ~(got("victim_account") | got("beneficiary_account")) | (needs_amount & ~got("transaction_amount")) | ((F.col("category") == "TRANSFER") & ~got("disputed_amount"))
    evidence = got("payment_mode") | got("atm_id") | got("beneficiary_account")
    blind = ~F.col("known") & ~evidence & got("transaction_amount")
    one = sheets.join(sheet_channels(sheets), "sheet").join(places.select("layout", "fields"), "layout")
    return one.select(*SHEET, "layout", "category", "known", missing.alias("missing"), blind.alias("blind"), got("beneficiary_account").alias("_has_beneficiary"))


#: What rows know of their sheet.
KIND = ["layout", "category", "known", "missing", "blind", "_has_beneficiary"]


class Sheets:
    """Sheets with their kinds, and the places of fields; they are looked up by rows, which are not dealt for that unless there are very many."""

    def __init__(self, kinds: DataFrame, places: DataFrame):
        self.kinds, self.places = kinds, places
        kind = kinds.select(*KIND).distinct().withColumn("kind", F.monotonically_increasing_id())
        self.kind = stored(kind.join(places, "layout"))
        self.few = kinds.count() <= BROADCAST_SHEETS and self.kind.count() <= BROADCAST_LAYOUTS

    def of(self, rows: DataFrame, where: str = "true") -> DataFrame:
        """``rows`` of the sheets that are meant, with what is known of them."""
        if not self.few:
            return rows.join(self.kinds.where(where).join(self.places, "layout"), SHEET)
        # a sheet is a hash of 64 bits here, and is told apart from what shares it by another of 32
        sheets = self.kinds.where(where).join(F.broadcast(self.kind.select("kind", *KIND)), KIND).select(F.xxhash64(*SHEET).alias("_key"), F.hash(*SHEET).alias("_check"), "kind")
        same = (F.xxhash64(*SHEET) == F.col("_key")) & (F.hash(*SHEET).bitwiseXOR(F.col("_check")) == 0)
        return rows.join(F.broadcast(sheets), same).drop("_key", "_check").join(F.broadcast(self.kind), "kind").drop("kind")


def raw_rows(rows: DataFrame) -> DataFrame:
    """One row for each data row of a sheet (path, sheet_no, sheet, r, cells, and what :class:`Sheets` knows): its mapped cells by field; repeated header rows are left out."""
    headed = lambda x: F.exists("at", lambda h: (h["c"] == x["c"]) & (h["header"] == normalised_header(x["value"])))
    data = let(F.filter("cells", lambda x: F.array_contains("places", x["c"])), lambda mine: (F.size(mine) > 0) & ~((F.size(mine) >= 2) & F.forall(mine, headed)))
    # of cells in one place the greatest counts; where there are none, cells are found by their position
    alone = F.size(F.array_distinct("cells.c")) == F.size("cells")
    greatest = F.transform(F.array_distinct("cells.c"), lambda c: F.struct(c.alias("c"), F.array_max(F.transform(F.filter("cells", lambda x: x["c"] == c), lambda x: x["value"])).alias("value")))
    kept = rows.where("r > header_r").where(data).withColumn("_cells", F.when(alone, F.col("cells")).otherwise(greatest))
    value = lambda i: F.get("_cells.value", F.array_position("_cells.c", F.col("places")[i]).cast("int") - 1)
    old = lambda i: F.when(F.size(F.col("old")[i]) > 0, F.array_max(F.transform(F.filter("cells", lambda x: F.array_contains(F.col("old")[i], x["c"])), lambda x: blank_to_null(x["value"]))))
    fields = [value(i).alias(f) for i, f in enumerate(HEADERS)] + [old(i).alias(f) for i, f in enumerate(OLD_ONLY.values())]
    # made once for each row, however many conditions and columns name them
    return kept.select(*ROW, *KIND, F.inline(F.array(F.struct(*fields))))


def sheet_problems(rows: DataFrame) -> DataFrame:
    """(sheet, category, known, data_rows, problem) of :func:`raw_rows`: REQUIRED_COLUMN_MISSING, UNKNOWN_CHANNEL, ZERO_AMOUNTS or null."""
    account = blank_to_null(F.coalesce("victim_account", "beneficiary_account"))
    amount = blank_to_null(F.col("transaction_amount"))
    # what is in the rows is asked of blind sheets only
    shaped = F.when(F.col("blind"), account.isNotNull() & amount.isNotNull())
    nonzero = F.when(shaped, F.abs(parse.parse_amount(F.col("transaction_amount"))) > 0.01)
    counts = rows.groupBy(*SHEET).agg(F.count("*").alias("data_rows"), F.coalesce(F.bool_or(shaped), F.lit(False)).alias("shaped"), F.coalesce(F.bool_or(nonzero), F.lit(False)).alias("nonzero"), *[F.first(c).alias(c) for c in ("category", "known", "missing")])
    problem = F.when(F.col("missing"), "REQUIRED_COLUMN_MISSING").when(F.col("nonzero"), "UNKNOWN_CHANNEL").when(F.col("shaped"), "ZERO_AMOUNTS")
    return counts.select(*SHEET, "category", "known", "data_rows", problem.alias("problem"))


def typed_rows(rows: DataFrame, *more: str) -> DataFrame:
    """Ledger columns of :func:`raw_rows`, and ``more`` of theirs."""
    text = lambda c: blank_to_null(F.col(c))
    cash = F.col("category").isin("ATM", "POS")
    remarks = text("remarks")
    beneficiary = F.when(~F.col("_has_beneficiary"), F.coalesce(text("beneficiary_account"), text("victim_account"))).otherwise(text("beneficiary_account"))
    out = rows.select(
        *ROW,
        "category",
        text("ack_no").alias("ack_no"),
        parse.parse_date(F.col("complaint_date")).alias("complaint_date"),
        text("victim_account").alias("victim_account"),
        text("victim_bank").alias("victim_bank"),
        beneficiary.alias("beneficiary_account"),
        text("beneficiary_bank").alias("raw_beneficiary_bank"),
        text("beneficiary_name").alias("beneficiary_name"),
        canonical_ifsc(F.col("ifsc_code")).alias("ifsc_code"),
        parse.parse_date(F.col("transaction_date")).alias("transaction_date"),
        parse.parse_amount(F.col("transaction_amount")).alias("transaction_amount"),
        parse.parse_amount(F.col("disputed_amount")).alias("disputed_amount"),
        text("utr_no").alias("utr_no"),
        parse.channel_mode(F.col("category"), remarks, F.col("payment_mode")).alias("payment_mode"),
        parse.parse_layer(F.col("layer_no")).alias("layer_no"),
        F.coalesce(without_label(F.col("atm_id")), F.when(cash, parse.terminal_of(remarks))).alias("atm_id"),
        F.coalesce(without_label(F.col("atm_location")), F.when(cash, parse.acceptor_of(remarks))).alias("atm_location"),
        text("city").alias("city"),
        text("state").alias("state"),
        remarks.alias("remarks"),
        *more,
    ).where("ack_no IS NOT NULL OR victim_account IS NOT NULL OR beneficiary_account IS NOT NULL")
    # rows without any bank say nothing about one
    none = F.col("raw_beneficiary_bank").isNull() & F.col("ifsc_code").isNull()
    return with_bank(out).withColumns({c: F.when(~none, F.col(c)) for c in ("beneficiary_bank", "bank_source", "bank_flag")})


#: What ingestion gives: the ledger of all accepted sheets, rows of old transactions, which column is which field, sheets and their problems, and why files and sheets were refused.
OUTPUTS = ("rows", "old_transactions", "mapping", "sheets", "errors")


def parse_workbooks(cells: DataFrame, wanted: tuple[str, ...] = OUTPUTS) -> dict[str, DataFrame]:
    """Those of OUTPUTS that are ``wanted``, of CELLS or ROWS.

    Rows are kept once, as they are read: what sheets are is found from their
    first rows, and looked up by the others, which are never dealt by sheet.
    """
    whole = row_form(cells)
    if set(wanted) - {"mapping"}:
        # read once, as each reader of the result would open the workbooks again
        whole = stored(whole)
    first = stored(whole.where(F.col("error").isNotNull() | (F.col("r") < HEADER_ROWS)))
    uploads = stored(upload_problems(first))
    heads = stored(_heads(fill_rows(first.join(uploads, "path", "left_anti"), used_columns(first, whole))))
    # sheets repeat each other's headers, so each row of headers is looked at once
    layouts = stored(heads.select("header_r", "cells").distinct().withColumn("layout", F.monotonically_increasing_id()))
    columns = stored(column_mapping(layouts, ["layout"]))
    placed = heads.join(layouts, ["header_r", "cells"]).select(*SHEET, "layout")
    out = {}
    if "mapping" in wanted:
        out["mapping"] = placed.join(columns, "layout").select(*SHEET, "header_r", "c", "header", "field", "how")
    if not set(wanted) - {"mapping"}:
        return out

    places = stored(layout_places(layouts, columns))
    sheets = Sheets(stored(sheet_kinds(placed, places)), places)
    used = used_columns(whole, whole)
    raw = lambda where, of=sheets: raw_rows(fill_rows(of.of(whole, where), used))
    if "sheets" in wanted:
        out["sheets"] = sheet_problems(raw("true"))
    if "errors" in wanted:
        broken = upload_problems(first, whole.select("path")).select("path", F.lit(None).cast("string").alias("sheet"), "problem")
        refused = sheet_problems(raw("missing OR blind")).where("problem IN ('REQUIRED_COLUMN_MISSING', 'UNKNOWN_CHANNEL')").select("path", "sheet", "problem")
        out["errors"] = broken.unionByName(refused)
    if {"rows", "old_transactions"} & set(wanted):
        fine = sheets
        if not sheets.kinds.where("blind AND NOT missing").isEmpty():
            bad = stored(sheet_problems(raw("blind AND NOT missing")).where("problem IS NOT NULL").select(*SHEET))
            fine = Sheets(stored(sheets.kinds.join(bad, SHEET, "left_anti")), places)
        if "rows" in wanted:
            out["rows"] = typed_rows(raw("NOT missing AND category <> 'OLD_TRANSACTION'", fine))
        if "old_transactions" in wanted:
            out["old_transactions"] = typed_rows(raw("NOT missing AND category = 'OLD_TRANSACTION'", fine), *OLD_ONLY.values())
    return out


def _rows_before(files: DataFrame) -> DataFrame:
    """(path, _shift) of ``files`` (path, _n): the rows of all files before; files are numbered by ranges of their paths."""
    placed = stored(files.repartitionByRange("path").withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.sum("_n").alias("n")).collect())  # one row for each range
    before = [(p, sum(n for q, n in sums if q < p)) for p, _ in sums]
    first = F.broadcast(files.sparkSession.createDataFrame(before, "_range int, _first long"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_within", within).join(first, "_range").select("path", (F.col("_first") + F.col("_within")).alias("_shift"))


def with_ids(rows: DataFrame, report_id: int, first: int = 0) -> DataFrame:
    """Ledger rows with ids in the order of file, sheet and row, unique over all files, after ``first``.

    Rows of a file are numbered apart; files are shifted by the numbers of those
    before them, which are looked up by broadcast if there are few.
    """
    known = {f.name for f in LEDGER.fields}
    shifts = stored(_rows_before(rows.groupBy("path").agg(F.count("*").alias("_n"))))
    place = F.row_number().over(Window.partitionBy("path").orderBy("sheet_no", "r"))
    out = rows.join(F.broadcast(shifts) if shifts.count() <= BROADCAST_FILES else shifts, "path").withColumns({"id": F.lit(first) + F.col("_shift") + place, "report_id": F.lit(report_id).cast("long")})
    return out.select(*[c for c in out.columns if c in known or c in ("raw_beneficiary_bank", "bank_source", "bank_flag")])


def row_problems(rows: DataFrame, most: int = 100) -> DataFrame:
    """(id, problem) of rows without an account or with a layer out of bounds; a report of ``most`` of them."""
    problem = F.when(F.col("victim_account").isNull() & F.col("beneficiary_account").isNull(), "no account").when(~F.col("layer_no").between(parse.LAYER_LEAST, parse.LAYER_MOST), "layer out of bounds").when(F.col("transaction_amount").isNull(), "no amount")
    return rows.select("id", problem.alias("problem")).where("problem IS NOT NULL").orderBy("id").limit(most)


def weak_duplicates(rows: DataFrame) -> DataFrame:
    """(utr_no, beneficiary_account, transaction_amount, transaction_date, n): legs that look alike; a warning only."""
    keys = ["utr_no", "beneficiary_account", "transaction_amount", "transaction_date"]
    return rows.where("utr_no IS NOT NULL AND beneficiary_account IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
