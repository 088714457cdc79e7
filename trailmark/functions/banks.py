"""Banks of accounts, from branch codes (IFSC) and names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.text import blank_to_null, let, or_empty

#: First four characters of a branch code, and the bank (fixed values).
BANKS = {
    "SBIN": "State Bank of India",
    "CBIN": "Central Bank of India",
    "BKID": "Bank of India",
    "UCBA": "UCO Bank",
    "MAHB": "Bank of Maharashtra",
    "IOBA": "Indian Overseas Bank",
    "PSIB": "Punjab & Sind Bank",
    "BARB": "Bank of Baroda (including Vijaya Bank and Dena Bank)",
    "VIJB": "Bank of Baroda (including Vijaya Bank and Dena Bank)",
    "DENA": "Bank of Baroda (including Vijaya Bank and Dena Bank)",
    "PUNB": "Punjab National Bank (including Oriental Bank of Commerce and United Bank of India)",
    "ORBC": "Punjab National Bank (including Oriental Bank of Commerce and United Bank of India)",
    "UTBI": "Punjab National Bank (including Oriental Bank of Commerce and United Bank of India)",
    "UBIN": "Union Bank of India (including Andhra Bank and Corporation Bank)",
    "ANDB": "Union Bank of India (including Andhra Bank and Corporation Bank)",
    "CORP": "Union Bank of India (including Andhra Bank and Corporation Bank)",
    "CNRB": "Canara Bank",
    "SYNB": "Canara Bank",
    "IDIB": "Indian Bank",
    "ALLA": "Indian Bank",
    "HDFC": "HDFC Bank",
    "ICIC": "ICICI Bank",
    "UTIB": "Axis Bank",
    "KKBK": "Kotak Mahindra Bank",
    "INDB": "IndusInd Bank",
    "YESB": "Yes Bank",
    "IBKL": "IDBI Bank",
    "FDRL": "Federal Bank",
    "SIBL": "South Indian Bank",
    "KVBL": "Karur Vysya Bank",
    "CIUB": "City Union Bank",
    "TMBL": "Tamilnad Mercantile Bank",
    "DLXB": "Dhanlaxmi Bank",
    "KARB": "Karnataka Bank",
    "RATN": "RBL Bank",
    "BDBL": "Bandhan Bank",
    "CSBK": "CSB Bank",
    "NKGS": "NKGSB Co-operative Bank",
    "JSBP": "Janata Sahakari Bank",
    "SURY": "Suryoday Small Finance Bank",
    "ESFB": "Equitas Small Finance Bank",
    "UJVN": "Ujjivan Small Finance Bank",
    "AUBL": "AU Small Finance Bank",
    "JSFB": "Jana Small Finance Bank",
    "FINF": "Fincare Small Finance Bank",
    "UTKS": "Utkarsh Small Finance Bank",
    "ESMF": "ESAF Small Finance Bank",
    "NESF": "North East Small Finance Bank",
    "PYTM": "Paytm Payments Bank",
    "AIRP": "Airtel Payments Bank",
    "FINO": "Fino Payments Bank",
    "IPOS": "India Post Payments Bank",
    "NSPB": "NSDL Payments Bank",
    "JIOP": "Jio Payments Bank",
    "SCBL": "Standard Chartered Bank",
    "CITI": "Citibank",
    "HSBC": "HSBC Bank",
    "DEUT": "Deutsche Bank",
    "DBSS": "DBS Bank India",
    "JAKA": "Jammu and Kashmir Bank",
    "IDFB": "IDFC FIRST Bank",
    "NTBL": "Nainital Bank",
    "ABHY": "Abhyudaya Co-operative Bank",
    "TJSB": "TJSB Sahakari Bank",
    "BCBM": "Bharat Co-operative Bank (Mumbai)",
    "GSCB": "Gujarat State Co-operative Bank",
    "TSAB": "Telangana State Co-operative Apex Bank",
    "KSBK": "Kerala State Co-operative Bank",
    "RMGB": "Rajasthan Marudhara Gramin Bank",
    "MAHG": "Maharashtra Gramin Bank",
    "PKGB": "Karnataka Gramin Bank",
    "KLGB": "Kerala Gramin Bank",
}
#: Codes of wallets that look like branch codes.
WALLET_PREFIX = "PPIW"
IFSC = "^[A-Z]{4}0[A-Z0-9]{6}$"
#: Wallets, payment aggregators and gateways by name; the list itself is an assumption, see the README.
WALLETS = r"(?i)\b(phone ?pe|paytm|mobikwik|cred|ease ?buzz|razor ?pay|pine ?labs|payu|cashfree|bill ?desk|amazon ?pay|google ?pay|gpay|freecharge|cc ?avenue|instamojo|jio ?money|ola ?money|airtel ?money|wallet)\b"
#: Words of bank names that don't tell banks apart (fixed values).
GENERIC_WORDS = ("bank", "of", "india", "ltd", "limited", "the", "payments", "payment", "small", "finance", "cooperative", "co-operative")
GENERIC = rf"\b({'|'.join(GENERIC_WORDS)})\b"
#: How account numbers of wallets begin, and what stands for no account at all (fixed values).
WALLET_ACCOUNTS = ("FPPI", "PPI", "BILLNUMBER")
NO_ACCOUNT = ("", "—", "-", ".", "NA", "N/A", "NULL", "UNDEFINED")


def clean_ifsc(c: Column) -> Column:
    up = F.upper(or_empty(c))
    return F.when(up.rlike(IFSC), up)


def canonical_ifsc(c: Column) -> Column:
    """Valid codes in capitals, anything else as it is, so that a reader sees what the source held."""
    return F.coalesce(clean_ifsc(c), blank_to_null(c))


def bank_core(c: Column) -> Column:
    """A bank's name for comparison: without brackets, punctuation and words that all banks share."""
    t = F.lower(or_empty(c))
    bare = F.regexp_replace(t, r"\(.*?\)", " ")
    tidy = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    core = lambda b: let(tidy(F.regexp_replace(b, GENERIC, " ")), lambda x: F.when(x != "", x).otherwise(tidy(b)))
    return F.when(t.isin("others", "other", "na"), "").otherwise(let(bare, core))


def same_core(x: Column, y: Column) -> Column:
    return (x == "") | (y == "") | x.contains(y) | y.contains(x)


def same_bank(a: Column, b: Column) -> Column:
    """Equal or one within the other; a blank name contradicts nothing."""
    return let(F.struct(bank_core(a).alias("x"), bank_core(b).alias("y")), lambda v: same_core(v["x"], v["y"]))


def bank_table(spark: SparkSession) -> DataFrame:
    """(prefix, mapped_bank, mapped_core): one row for each known prefix."""
    return spark.createDataFrame(list(BANKS.items()), "prefix string, mapped_bank string").withColumn("mapped_core", bank_core(F.col("mapped_bank")))


def with_bank(df: DataFrame, ifsc: str = "ifsc_code", raw: str = "raw_beneficiary_bank", out: str = "beneficiary_bank") -> DataFrame:
    """``df`` with ``out``, ``bank_source`` (IFSC, TEXT) and ``bank_flag``, by the code where it is known, else by the text.

    The table of prefixes has a fixed number of rows, so it is broadcast.
    """
    code, text = F.col("_code"), or_empty(F.col(raw))
    prefix = F.substring(code, 1, 4)
    wallet = prefix == WALLET_PREFIX
    known = F.col("mapped_bank").isNotNull()
    coded = df.withColumn("_code", clean_ifsc(F.col(ifsc))).withColumn("_prefix", prefix)
    joined = coded.join(F.broadcast(bank_table(df.sparkSession)), F.col("_prefix") == F.col("prefix"), "left")
    bank = F.when(known, F.col("mapped_bank")).when(text != "", text).when(code.isNull() | wallet, "Unknown").otherwise(F.concat(F.lit("Unknown (IFSC "), prefix, F.lit(")")))
    flag = (
        F.when(code.isNull() & (or_empty(F.col(ifsc)) != ""), "INVALID_IFSC")
        .when(code.isNull() | wallet, "NO_IFSC")
        .when(~known, "UNKNOWN_IFSC_PREFIX")
        .when(~let(bank_core(F.col(raw)), lambda y: same_core(F.col("mapped_core"), y)), "IFSC_TEXT_MISMATCH")
    )
    named = joined.withColumns({"_bank": bank, "bank_source": F.when(known, "IFSC").otherwise("TEXT"), "bank_flag": flag})
    return named.withColumn(out, F.col("_bank")).drop("_code", "_prefix", "prefix", "mapped_bank", "mapped_core", "_bank")


def instrument_kind(account: Column, ifsc: Column, bank: Column) -> Column:
    """``wallet``, ``masked`` or ``bank``, in this precedence."""
    number, code, name = F.upper(or_empty(account)), F.upper(or_empty(ifsc)), F.coalesce(bank, F.lit(""))
    by_number = reduce(or_, [number.startswith(x) for x in WALLET_ACCOUNTS], number.contains("@"))
    by_code = code.isin("NA", "N/A") | code.rlike(WALLETS) | (code.startswith(WALLET_PREFIX) & code.rlike(IFSC))
    by_name = name.rlike(WALLETS) & ~F.array_contains(F.split(F.lower(name), "[^a-z0-9_]+"), "bank")
    masked = number.isin(*NO_ACCOUNT) | number.contains("XX")
    return F.when(by_number | by_code | by_name, "wallet").when(masked, "masked").otherwise("bank")
