from pyspark.sql import functions as F

from test_core import trail
from trailmark.operators import exports, registry
from trailmark.schema import LEDGER
from trailmark.streaming import ingest


def test_written_tables(spark, tmp_path):
    tables = exports.report_tables(trail(spark))
    some = {n: tables[n] for n in ("liens", "timeline", "letters")}
    for fmt in ("parquet", "csv"):
        exports.write_tables(some, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet/liens")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/timeline")).count() == 2
    exports.append_audit(spark, str(tmp_path), [("upload", "r1", {"rows": 5})])
    exports.append_audit(spark, str(tmp_path), [("delete", "r1", {})])
    log = spark.read.parquet(str(tmp_path / "audit_log"))
    assert log.count() == 2 and [r.action for r in registry.newest(log, 1).collect()] == ["delete"]
    assert [r.action for r in registry.newest(log).collect()] == ["delete", "upload"] and log.select("id").distinct().count() == 2
    kept = registry.delete_report({"lines": spark.createDataFrame([(1,), (2,)], "report_id long"), "audit_log": log}, 1)
    assert kept["lines"].count() == 1 and kept["audit_log"].count() == 2
    reports = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "A", "y"), (4, "B", "z")], "report_id long, ack_no string, source_sha256 string")
    assert {tuple(r) for r in registry.earlier_sources(reports).collect()} == {("A", "y", "x")}


def test_stream(spark, tmp_path):
    rows = trail(spark)
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER.fields])
    full.write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    batch = lambda df, n: seen.append((n, df.count()))
    ingest.ingest(ingest.ledger_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), batch).awaitTermination()
    ingest.ingest(ingest.ledger_stream(spark, str(tmp_path / "in")), str(tmp_path / "c"), batch).awaitTermination()
    assert sum(n for _, n in seen) == 6  # a second run finds nothing new
    out = ingest.daily_exits(ingest.ledger_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("exits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    out.awaitTermination()
    assert {(r.channel, float(r.amount)) for r in spark.table("exits").collect()} == {("ATM", 140000.0)}
