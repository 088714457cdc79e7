"""Text columns: blanks, accounts, identifiers, display forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading and trailing white space of cells, with the byte-order mark.
_EDGE = r"^[\s\x{FEFF}]+|\s+$"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it; a column that is named n times is made n times."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _EDGE, "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty cells and the tokens ``-``, ``—`` and ``n/a`` are null."""
    return let(trimmed(c), lambda t: F.when(~F.lower(t).isin("", "-", "—", "n/a"), t))


def or_empty(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def account_key(c: Column) -> Column:
    """The identity of an account: digits without leading zeros, anything else as it is, '' for none."""
    t = or_empty(c)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


def normalised_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), r"\s+", " ")


def loose_header(c: Column) -> Column:
    """Latin letters, digits and Devanagari only."""
    return F.regexp_replace(normalised_header(c), "[^a-z0-9\\x{0900}-\\x{097F}]+", "")


def without_label(c: Column) -> Column:
    """The value of a cell such as ``ATM ID :-123``, white space collapsed."""
    value = lambda t: let(F.regexp_extract(t, r"(?s)^[A-Za-z][A-Za-z ./]*?:\s*-?\s*(.+)$", 1), lambda v: F.when(v != "", v).otherwise(t))
    return let(F.regexp_replace(F.trim(let(blank_to_null(c), value)), r"\s+", " "), lambda out: F.when(out != "", out))


def masked_account(c: Column) -> Column:
    """Bullets (eight at most) and the last four characters."""
    t = or_empty(c)
    hidden = F.least(F.greatest(F.length(t) - 4, F.lit(0)), F.lit(8))
    return F.concat(F.repeat(F.lit("•"), hidden), F.substring(t, F.greatest(F.length(t) - 3, F.lit(1)), F.lit(4)))


def safe_identifier(c: Column, length: int = 64) -> Column:
    """Without control characters and markup, cut to ``length``."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1F\\x7F<>&\"'`]", "")), 1, length)


def indian_money(c: Column) -> Column:
    """``Rs. 1,23,456.00``: groups of two digits above the thousands."""
    amount = c.cast("decimal(18,2)")
    fixed = F.abs(amount).cast("string")
    whole, part = F.split_part(fixed, F.lit("."), F.lit(1)), F.split_part(fixed, F.lit("."), F.lit(2))
    head = F.regexp_replace(F.substring(whole, F.lit(1), F.length(whole) - 3), r"\B(?=([0-9]{2})+$)", ",")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(amount < 0, "-Rs. ").otherwise("Rs. "), grouped, F.lit("."), part)


def display_date(c: Column) -> Column:
    return F.date_format(c, "dd MMM yyyy")


def escaped_like(text: str) -> str:
    """A pattern for ILIKE that finds ``text`` anywhere, wildcards taken literally."""
    return "%" + "".join(f"\\{ch}" if ch in "\\%_" else ch for ch in text) + "%"
