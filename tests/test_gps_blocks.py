"""Telemetry lines in blocks, and events of all of the spline's range."""

from pyspark.sql import Window, functions as F

from lumicube import registry
from lumicube.sources import products
from lumicube.sources.testdata import table


def test_blocks_do_not_show(spark, monkeypatch):
    """Seconds that repeat across the ends of blocks, blank blocks, and lines without seconds; in more than one task."""
    monkeypatch.setattr(products, "BLOCK_LINES", 7)
    monkeypatch.setattr(products, "telemetry_fields", lambda lines, order: lines)
    n = F.col("id")
    fields = F.array(*[F.when((F.floor(n / 5) % 9) == 3, None).otherwise(F.floor(n / 5).cast("string")) if k == 11 else F.lit("1") for k in range(18)])
    lines = spark.range(400).filter("id < 100 OR id > 130").select(n.alias("line"), fields.alias("fields"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = products.parse_gps(lines).select("line", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    s = F.get("fields", F.lit(11))
    want = lines.withColumn("b", F.lag(s).over(Window.orderBy("line"))).filter(~F.col("b").eqNullSafe(s)).collect()
    assert sorted(r["line"] for r in got) == sorted(r["line"] for r in want) and len({r["task"] for r in got}) > 1


def test_every_event_meets_a_segment(spark, data, same_as_oracle):
    rows = registry.queries()["join_spline_segment"](spark, data)
    assert same_as_oracle(rows, registry.oracle_sql()["join_spline_segment"]) == table(spark, data, "events").count()
