"""Ties, very small and very large vectors, and recall on the given tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def nearest(rows, is_query, k=5):
    """Brute force in double precision on vectors scaled by powers of two."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x = x / 2.0 ** np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True)))
    norm = np.sqrt((x * x).sum(axis=1))
    out = []
    for q in np.flatnonzero([is_query(i) for i in ids]):
        score = np.clip((x[q] * x).sum(axis=1) / (norm[q] * norm), -1, 1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r, int(ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    return out


def found(spark, rows, parts=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in neighbours.search(df, F.col("vec_id") % 50 == 0, 5).collect())


def test_multiples_tie_to_smaller_ids(spark):
    base = [0.3, -1.5, 0.25, 2.0]
    rows = [(i, [c * 2.0 ** (i % 40 - 20) for c in base]) for i in range(160, 99, -1)]
    got = found(spark, rows)
    assert [(r[0], r[2]) for r in got if r[0] == 100] == [(100, i) for i in (101, 102, 103, 104, 105)]
    assert [r[2] for r in got if r[0] == 150] == [100, 101, 102, 103, 104]
    assert len({r[3] for r in got}) == 1 and abs(got[0][3] - 1) < 1e-12


def test_ties_of_unlike_vectors(spark):
    """Small whole numbers: many different vectors have exactly the same cosine."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.integers(0, 2, 4)]) for i in range(1, 400)]
    rows = [(i, v) for i, v in rows if any(v)] + [(400, [1.0, 1.0, 0.0, 0.0])]
    got = [(q, r, v, round(s, 9)) for q, r, v, s in found(spark, rows)]
    assert got == [(q, r, v, round(s, 9)) for q, r, v, s in nearest(rows, lambda i: i % 50 == 0)]


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1, 120):
        v = rng.normal(size=8)
        rows.append((i, (v * 10.0 ** [-170, 0, 150, -300][i % 4]).tolist()))
    rows += [(50, [5e-324] * 8), (100, [1e308, 1e-300, *[0.0] * 6])]
    rows = [r for r in rows if r[0] not in (50, 100)] + rows[-2:]
    got = found(spark, rows)
    assert all(np.isfinite(r[3]) for r in got) and {r[0] for r in got} == {50, 100}
    want = {(q, r): s for q, r, _, s in nearest(rows, lambda i: i % 50 == 0)}
    assert all(abs(want[q, r] - s) < 1e-9 for q, r, _, s in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect() if r.embedding is not None and any(r.embedding)]
    want = {(q, v) for q, _, v, _ in nearest(rows, lambda i: i % 50 == 0)}
    got = {(r[0], r[2]) for r in neighbours.search(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert len(want & got) >= 0.9 * len(want)
