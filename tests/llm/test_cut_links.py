"""Shards with one text on a third of all rows."""

from pyspark.sql import functions as F

from prosegauge.llm import shards


def test_a_hot_text_leaves_the_other_hubs_together(spark):
    total, count = 12_000, 16
    hub = F.when(F.col("id") < total // 3, 1).when(F.col("id") < 2 * total // 3, 10 + F.floor(F.col("id") / 4))
    rows = spark.range(total).select(F.concat(F.lit("r"), "id").alias("row"), hub.cast("long").alias("hub")).cache()
    found = shards.assign(rows, count).cache()
    held = rows.join(found, "row").groupBy("hub", "shard").count().filter("hub IS NOT NULL").collect()
    assert sum(r["hub"] == 1 for r in held) == 6  # 4,000 rows at 750 a shard
    assert all(r["count"] == 4 for r in held if r["hub"] != 1)
    assert {r["count"] for r in found.groupBy("shard").count().collect()} == {total // count}
    assert shards.cut_links(rows, found).first()["cut"] == total // 3 - total // count


def test_hubs_of_nearly_a_shard(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("row"), F.when(F.col("id") < 880, F.floor(F.col("id") / 220)).cast("long").alias("hub"))
    assert shards.cut_links(rows, shards.assign(rows, 4)).first()["cut"] == 0
