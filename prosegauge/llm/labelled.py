"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, modulus: int) -> Column:
    """The fold of a row: crc32 of the key as text; a null key is fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(0))


def _one_label(labels: DataFrame, label: str, allowed: Column, key: str) -> DataFrame:
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & allowed)
    return one.groupBy(key).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))


def label_sample(labels: DataFrame, label: str, allowed: Column, most: int, key: str = "doc_id") -> DataFrame:
    """(key, y) of at most `most` labelled keys, chosen by a hash of the key.

    Null keys and null labels are left out.  Where a key has several labels,
    their mean decides, and a tie is 1.
    """
    return _one_label(labels, label, allowed, key).orderBy(F.xxhash64(F.lit("sample"), key), key).limit(most)


def halved_sample(labels: DataFrame, label: str, allowed: Column, most: int, key: str = "doc_id") -> tuple[DataFrame, float]:
    """Like `label_sample` with at most `most` / 2 keys of each label, and the smoothed share of label 1 in all rows."""
    one = _one_label(labels, label, allowed, key)
    n, ones = one.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen = [one.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit("sample"), key), key).limit(most // 2) for y in (0, 1)]
    return chosen[0].unionByName(chosen[1]), (ones + 0.5) / (n + 1)
