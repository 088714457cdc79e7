"""The registry of accounts across reports, kept up to date by what changes: a report that is added, replaced or withdrawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.text import account_key
from trailmark.operators import registry
from trailmark.operators.core import total
from trailmark.schema import MONEY
from trailmark.sources.store import VersionedStore

CONTRIBUTED = T.StructType([T.StructField("account_no", T.StringType()), T.StructField("report_id", T.LongType()), T.StructField("bank_name", T.StringType()), T.StructField("amount_passed", MONEY)])
#: Parts of the aggregate; one with no account that a report touches is not written again.
BUCKETS = 256


class RegistryView:
    """Contributions in one part for each report, and their aggregate in parts by a hash of the account.

    A change reads the report's old and new contributions, counts the accounts
    of either again from all their contributions, as earliest reports and banks
    can't be taken back from a sum, and writes the parts that hold them.  Both
    tables change in one commit.
    """

    def __init__(self, store: VersionedStore, buckets: int = BUCKETS):
        self.store, self.buckets = store, buckets

    def contributions(self) -> DataFrame:
        found = self.store.read("contributions")
        return self.store.spark.createDataFrame([], CONTRIBUTED) if found is None else found

    def read(self) -> DataFrame:
        """(account_no, bank_name, first_seen_report_id, appearance_count, total_amount_passed)."""
        found = self.store.read("registry")
        return registry.aggregate(self.contributions()) if found is None else found

    def load(self, contributed: DataFrame, token: str = "loaded") -> bool:
        """Contributions of many reports as the first version; False if there is a version already.

        ``contributed`` has (account_no, report_id, bank_name, amount_passed), each
        account once for a report, under its key.
        """
        store, base = self.store, self.store.current()
        if base["version"]:
            return False
        made = store.write(contributed.select([f.name for f in CONTRIBUTED.fields]).withColumn("_part", F.col("report_id")), by="_part")
        kept = store.spark.read.schema(CONTRIBUTED).parquet(f"{store.folder}/{made}")
        reports = [r["report_id"] for r in kept.select("report_id").distinct().collect()]  # one row for each report
        buckets, folder = self._written(registry.aggregate(kept))
        applied = {f"report-{r}": token for r in reports}
        store.commit({"contributions": {str(r): f"{made}/_part={r}" for r in reports}, "registry": {str(b): f"{folder}/bucket={b}" for b in buckets}}, base | {"applied": base["applied"] | applied})
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("account_no"), F.lit(self.buckets)).cast("int")

    def _written(self, counted: DataFrame) -> tuple[set[int], str]:
        """The parts that ``counted`` has accounts in, and the folder of them."""
        folder = self.store.write(counted.withColumn("bucket", self._bucket()).repartition("bucket"), by="bucket")
        schema = counted.withColumn("bucket", self._bucket()).schema
        written = self.store.spark.read.schema(schema).parquet(f"{self.store.folder}/{folder}")
        return {r["bucket"] for r in written.select("bucket").distinct().collect()}, folder  # as many as there are parts at most

    def apply(self, report_id: int, fresh: DataFrame, token: str) -> bool:
        """``fresh`` (account_no, bank_name, amount_passed) takes the place of the report's contributions.

        Accounts may come more than once and are put together by their keys.
        ``token`` names the report's content, such as a hash of its source; if it
        was applied last nothing is done, and the answer is False.
        """
        own = fresh.withColumn("account_no", account_key(F.col("account_no"))).where("account_no <> ''")
        one = own.groupBy("account_no").agg(F.min("bank_name").alias("bank_name"), total(F.col("amount_passed")).alias("amount_passed"))
        return self._change(report_id, one.select("account_no", F.lit(report_id).cast("long").alias("report_id"), "bank_name", "amount_passed"), token)

    def withdraw(self, report_id: int) -> bool:
        """The report's contributions go; False if there are none."""
        return self._change(report_id, None, "withdrawn")

    def _change(self, report_id: int, fresh: DataFrame | None, token: str) -> bool:
        store, key, part = self.store, f"report-{report_id}", str(report_id)
        base = store.current()
        known = base["tables"].get("contributions", {})
        if base["applied"].get(key) == token or (fresh is None and part not in known):
            return False
        spark, version = store.spark, base["version"] or None
        folder = None if fresh is None else store.write(fresh)
        new = spark.createDataFrame([], CONTRIBUTED) if folder is None else spark.read.parquet(f"{store.folder}/{folder}")
        old = store.read("contributions", version, [part]) if version else None
        touched = new.select("account_no") if old is None else registry.touched(old, new)
        touched = touched.distinct().withColumn("bucket", self._bucket())

        others = store.read("contributions", version, [p for p in known if p != part]) if version else None
        counted = new if others is None else new.unionByName(others.join(touched.select("account_no"), "account_no", "left_semi").select(new.columns))
        again = registry.aggregate(counted)
        numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # as many as there are parts at most
        stays = store.read("registry", version, [str(b) for b in numbers]) if version else None
        if stays is not None:
            again = stays.join(touched.select("account_no"), "account_no", "left_anti").select(again.columns).unionByName(again)
        full, made = self._written(again)
        parts = {str(b): f"{made}/bucket={b}" if b in full else None for b in numbers}
        store.commit({"contributions": {part: folder}, "registry": parts}, base, key, token)
        return True


def store_upsert(store: VersionedStore, name: str, fresh: DataFrame, keys: list[str], key: str, token: str) -> bool:
    """A stored table after ``registry.upsert`` with ``fresh``, as one commit; False if ``token`` was the last applied for ``key``."""
    base = store.current()
    if base["applied"].get(key) == token:
        return False
    old = store.read(name, base["version"]) if base["tables"].get(name) else None
    store.commit({name: {"all": store.write(fresh if old is None else registry.upsert(old, fresh, keys))}}, base, key, token)
    return True
