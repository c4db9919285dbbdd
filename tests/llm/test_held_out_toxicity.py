"""Toxic documents of the given table that no label was learned from."""

from prosegauge.llm import toxicity


def test_held_out_toxicity(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    found, toxic = sum(r["predicted"] for r in rows), sum(r["toxic"] for r in rows)
    assert len(rows) > 700
    assert hit >= 0.7 * toxic and hit >= 0.95 * found
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.96 * len(rows)
