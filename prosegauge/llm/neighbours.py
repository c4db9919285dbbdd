"""Nearest neighbours by cosine with cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.
A unit vector is hashed to the signed axis it is nearest to after a rotation; near
vectors tend to share it.  Several rotations make several tables.  A query probes
the axes it is nearest to in every table, so it needs few tables, and every
candidate found is scored exactly on the original vectors.

Vectors are scaled by a power of two first, so that no square is too small or too
large for a double; that changes no digit of a cosine.  Vectors that are equal then
are one class with its smallest ids, so a vector that very many rows share is hashed
and compared once.  Buckets that hold many vectors or many queries are cut into
blocks; a task compares one block of each side with one matrix product and hands on
the best of each query only, never the pairs.  The product only says which classes
come near the best; those are scored one by one before any is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions.text import let
from prosegauge.llm.shared import written

#: With these, recall of the 5 nearest is over 0.9 on the given tables; the tests hold it against brute force.
TABLES, PROBES, SEED = 14, 8, 20
#: How far a matrix product of unit vectors may be from the cosine, with room; pairs that are scored at once.
MARGIN, PAIRS = 1e-9, 100_000
#: Vectors and queries that one task compares at once.
MEMBERS, QUERIES = 4096, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of every row; the width is a power of two."""
    x, width, half = x.copy(), x.shape[1], 1
    while half < width:
        pairs = x.reshape(len(x), width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        half *= 2
    return x / np.sqrt(width)


def rotations(x: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """`x` after each table's pseudo-rotation."""
    for table in range(tables):
        signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, x.shape[1]))
        turned = x
        for sign in signs:
            turned = hadamard(turned * sign)
        yield turned


def _axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row; axis k is 2k or, if positive, 2k + 1."""
    near = np.stack([-turned, turned], 2).reshape(len(turned), -1)
    probes = min(probes, near.shape[1])
    return np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(probes), (len(near), 1))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column to rows of doubles, filled up with zeros."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _hashed(classes: DataFrame, width: int, tables: int, probes: int, seed: int) -> DataFrame:
    """A row per class, table and probed axis: class_id, table, axis, vector."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1), width)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for table, turned in enumerate(rotations(x, tables, seed)):
                    axes = _axes(turned, probes)
                    rows = part.take(pa.array(np.repeat(np.arange(len(x)), axes.shape[1])))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(np.full(len(rows), table, np.int32)), pa.array(axes.reshape(-1).astype(np.int32)), rows.column(1)],
                        ["class_id", "table", "axis", "vector"],
                    )

    return classes.select("class_id", "vector").mapInArrow(make, "class_id long, table int, axis int, vector array<double>")


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return finite & F.exists(v, lambda c: c != 0)


def _scaled(v: Column) -> Column:
    """`v` times the power of two that brings its largest component to 1 or more and below 2.

    -0.0 becomes 0.0: they are one number, and must be one key.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    # In two steps, since the power for a very small number is itself too large.
    by = lambda x, e: x * power(F.floor(e / 2)) * power(e - F.floor(e / 2))
    largest = F.array_max(F.transform(v, F.abs))
    # The logarithm is rounded, so the exponent may be one off.
    near = let(largest, lambda m: let(-F.floor(F.log2(m)), lambda e: F.struct(e.alias("e"), by(m, e).alias("m"))))
    exponent = let(near, lambda n: F.when(n["m"] >= 2, n["e"] - 1).when(n["m"] < 1, n["e"] + 1).otherwise(n["e"]))
    return let(exponent, lambda e: F.transform(v, lambda c: by(c, e) + F.lit(0.0)))


def classes_of(vectors: DataFrame, most: int) -> DataFrame:
    """Usable vectors, scaled, as classes of equal ones: class_id (the smallest id), ids (the `most` smallest), vector.

    Null, empty and zero vectors and those with null or non-finite components are
    left out, and so are rows without an id.  A row that repeats id and vector counts once.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & _usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), _scaled(v).alias("vector"))
    # A limit per group is taken before the shuffle, so a vector of very many rows sends `most` ids per task.
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("r") <= most)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "vector")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """How many blocks of about `size` rows each (table, axis) needs; at most one row per table and axis."""
    return rows.groupBy("table", "axis").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))


def search(vectors: DataFrame, is_query: Column, k: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """The `k` nearest found for every row where `is_query`: query_id, rank, vec_id, score.

    Candidates are all usable rows but the query's own.  Score is the cosine in
    double precision; ties go to the smaller id.  Queries whose vector is not
    usable have no rows, and neither has an empty table; with fewer candidates
    there are fewer rows.  Vectors of unequal length are compared as if filled up
    with zeros.  Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", is_query.alias("is_query"))
    classes = written(classes_of(rows, k + 1), "vector-classes")
    asking = classes_of(rows.filter("is_query"), 1).select("vector")
    longest = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    width = 1 << max(1, int(longest - 1).bit_length())
    members = _hashed(classes, width, tables, 1, seed)
    queries = _hashed(classes.join(asking, "vector", "left_semi"), width, tables, probes, seed)
    # One row per table and axis: 2 * tables * width of them, whatever the size of the data.
    blocks = _blocks(members, MEMBERS, "m").join(_blocks(queries, QUERIES, "q"), ["table", "axis"])
    blocks = F.broadcast(blocks)
    number = lambda of: F.pmod(F.xxhash64("class_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = members.join(blocks, ["table", "axis"]).withColumn("mb", number("m")).withColumn("qb", every("q"))
    queries = queries.join(blocks, ["table", "axis"]).withColumn("qb", number("q")).withColumn("mb", every("m"))
    keep, key = k + 1, ["table", "axis", "mb", "qb"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ask, have = (_matrix(t.column("vector").combine_chunks(), width) for t in (left, right))
        n_ask, n_have = np.sqrt((ask * ask).sum(axis=1)), np.sqrt((have * have).sum(axis=1))
        ask_ids, have_ids = (np.asarray(t.column("class_id"), np.int64) for t in (left, right))
        near = (ask / n_ask[:, None]) @ (have / n_have[:, None]).T
        if near.shape[1] > keep:
            last = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
            a, b = np.nonzero(near >= last[:, None] - 2 * MARGIN)
        else:
            a, b = np.repeat(np.arange(len(ask)), len(have)), np.tile(np.arange(len(have)), len(ask))
        # Row sums, not a matrix product: the same two vectors give the same score wherever they stand.
        parts = [(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
        score = np.concatenate([(ask[x] * have[y]).sum(axis=1) / (n_ask[x] * n_have[y]) for x, y in parts] or [np.zeros(0)])
        score = np.clip(score, -1.0, 1.0)
        order = np.lexsort((have_ids[b], -score, a))
        first = np.searchsorted(a[order], np.arange(len(ask)))
        kept = order[np.arange(len(order)) - first[a[order]] < keep]
        return pa.table({"query_class": ask_ids[a[kept]], "class_id": have_ids[b[kept]], "score": score[kept]})

    columns = ["class_id", "vector", *key]
    grouped = lambda df: df.select(*columns).groupBy(*key)
    found = grouped(queries).cogroup(grouped(members)).applyInArrow(compare, "query_class long, class_id long, score double")
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    found = found.dropDuplicates(["query_class", "class_id"]).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    pairs = found.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    # Query ids of each class: a class of many queries has at most (k + 1) ** 2 pairs to join with.
    asked = rows.filter("is_query").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.filter(_usable(F.col("v"))).select("query_id", _scaled(F.col("v")).alias("vector")).dropDuplicates()
    asked = asked.join(classes.select(F.col("class_id").alias("query_class"), "vector"), "vector").select("query_id", "query_class")
    near = pairs.join(asked, "query_class").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = near.select("query_id", rank.alias("rank"), "vec_id", "score")
    return near.filter(F.col("rank") <= k)
