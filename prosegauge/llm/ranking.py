"""Lexical ranking of all documents for short items, by exact search in sparse ball trees.

A document is a sparse vector of whole numbers, one for each term of the items that
it holds; an item is the vector of its terms' weights, and the score is their inner
product.  Every task builds ball trees over its own documents: a node knows the
centroid of its documents and the radius around it, so no document below scores
more than ``<item, centroid> + |item| * radius``.  Long vectors that share few terms
make wide balls, so a node knows the largest entry of each term too, and the lower of
both bounds holds.  Nodes are visited best-first, and a search ends when the best open
bound is below the last score that it would keep.
Bounds are doubles, widened by more than their rounding; scores at the leaves are
64-bit integers.  So the result is exact, whatever is pruned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.llm.shared import written
from prosegauge.llm.textscan import hash_spans, text_blocks, text_buffers

TOP = 10
#: Terms of items (a term once per item) that are broadcast at once; more items are searched in further passes.
ITEM_TERMS = 400_000
#: Relative widening of squared distances and of bounds, far above the rounding of sums of doubles.
SLACK = 1e-9
#: Groups of tasks whose best are ranked first.
RANKED_APART = 64

# ASCII letters and digits and all bytes of longer sequences are in terms.
_IN = np.zeros(256, bool)
_IN[48:58] = _IN[65:91] = _IN[97:123] = _IN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

VECTOR = "doc_id long, n long, terms binary, counts binary"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the rows, and the first of each row."""
    data = _LOWER[data]
    solid = _IN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(data, start, end), np.searchsorted(start, offsets)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each; rows of one id, or of none, are one item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                hashes, first = terms(*text_buffers(block.column("text")))
                row = pa.array(np.repeat(np.arange(block.num_rows), np.diff(first)))
                yield pa.RecordBatch.from_arrays([block.column("item_id").take(row), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(make, "item_id long, term long").dropDuplicates()


@dataclass(frozen=True)
class Limits:
    """Sizes of what a task holds; they change no result."""

    #: Documents of a leaf; terms in the documents of one tree; searches of one tree that go on together.
    leaf: int = 48
    tree_terms: int = 1_500_000
    items_at_once: int = 512


@dataclass
class Items:
    """Some items: their ids, and their terms one item after another as places in `vocabulary`."""

    ids: list[int | None]
    first: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    weight: np.ndarray | None = None  # of each entry of the vocabulary

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts, terms and weights of the items from `a` to `b`."""
        at = slice(self.first[a], self.first[b])
        return self.first[a : b + 1] - self.first[a], self.term[at], self.weight[self.term[at]]


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (of all terms) and the terms of the items in each document with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in text_blocks(batch, "text"):
                hashes, first = terms(*text_buffers(block.column("text")))
                row = np.repeat(np.arange(block.num_rows), np.diff(first))
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                entry, count = np.unique(row[hit] * len(known) + place[hit], return_counts=True)
                cut = np.searchsorted(entry, np.arange(block.num_rows + 1) * len(known))
                term, count = (entry % len(known)).astype(np.int32), count.astype(np.int32)
                packed = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), packed(term), packed(count)], ["doc_id", "n", "terms", "counts"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = written(texts.mapInArrow(make, VECTOR), "term-vectors")
    shared.destroy()
    return out


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            total += np.bincount(held, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    rows = vectors.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for term, df in rows.collect():  # a row per term of the vocabulary, which is bounded
        out[term] = df
    return out


class BallTree:
    """Documents as sparse vectors: entries `first[i]` to `first[i + 1]` of `term` and `value` are document i's, none empty."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, leaf: int = Limits.leaf) -> None:
        self.first, self.term, self.value, self.size, self.leaf = first, term, value, size, leaf
        self.order = np.arange(len(first) - 1)
        real = value.astype(np.float64)
        self.square = np.add.reduceat(real * real, first[:-1]) if len(term) else np.zeros(0)

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of `docs`, and where each one's begin among them."""
        n = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(n)
        return np.repeat(self.first[docs] - (ends - n), n) + np.arange(ends[-1]), ends - n

    def bounds(self, cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """The nodes as (from, to, first child or -1 for a leaf), and for each a bound of every item's score below it."""
        weights = weights.astype(np.float64)
        some = np.flatnonzero(np.diff(cuts))
        norm = np.zeros(len(cuts) - 1)
        norm[some] = np.sqrt(np.add.reduceat(weights * weights, cuts[:-1][some])) if len(some) else 0
        nodes, rows, at = [(0, len(self.order), -1)], [], 0
        while at < len(nodes):
            a, b, _ = nodes[at]
            docs = self.order[a:b]
            entry, begin = self._entries(docs)
            term, value = self.term[entry], self.value[entry].astype(np.float64)
            along = lambda v: np.add.reduceat(value * v[term], begin)  # noqa: B023, E731
            centre = np.bincount(term, value, self.size) / (b - a)
            own = centre @ centre
            apart = self.square[docs] - 2 * along(centre) + own
            radius = math.sqrt(max(0.0, apart.max()) + SLACK * (self.square[docs].max() + own))
            row = norm * radius
            if len(some):
                most = np.zeros(self.size)
                np.maximum.at(most, term, value)
                sums = lambda v: np.add.reduceat(weights * v[terms], cuts[:-1][some])
                row[some] = np.minimum(row[some] + sums(centre), sums(most))
            rows.append(row * (1 + SLACK) + 1)
            if b - a > self.leaf:
                far = self._dense(docs[np.argmax(apart)])
                away = self.square[docs] - 2 * along(far)
                side = along(self._dense(docs[np.argmax(away)]) - far)
                middle = (b - a) // 2
                self.order[a:b] = docs[np.argpartition(side, middle)]
                nodes[at] = (a, b, len(nodes))
                nodes += [(a, a + middle, -1), (a + middle, b, -1)]
            at += 1
        return nodes, np.stack(rows)

    def _dense(self, doc: int) -> np.ndarray:
        out = np.zeros(self.size)
        at = slice(self.first[doc], self.first[doc + 1])
        out[self.term[at]] = self.value[at]
        return out

    def search(self, cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray, keys: list[tuple], best: list[list]) -> int:
        """Put into `best`, a heap of (score, key) per item, what this tree has better; the number of leaves scored.

        Of equal scores the larger key is better.  Every heap has its length already
        and is never made longer.
        """
        nodes, bound = self.bounds(cuts, terms, weights)
        dense, seen = np.zeros(self.size, np.int64), 0
        for i, heap in enumerate(best):
            at = slice(cuts[i], cuts[i + 1])
            dense[terms[at]] = weights[at]
            open_nodes = [(-bound[0, i], 0)]
            while open_nodes and -open_nodes[0][0] >= heap[0][0]:
                most, k = heapq.heappop(open_nodes)
                a, b, child = nodes[k]
                if child >= 0:
                    for c in (child, child + 1):
                        heapq.heappush(open_nodes, (max(most, -bound[c, i]), c))
                    continue
                seen += 1
                docs = self.order[a:b]
                entry, begin = self._entries(docs)
                score = np.add.reduceat(self.value[entry] * dense[self.term[entry]], begin)
                for j in np.flatnonzero(score >= max(1, heap[0][0])).tolist():
                    heapq.heappushpop(heap, (int(score[j]), keys[docs[j]]))
            dense[terms[at]] = 0
        return seen


#: Worse than any document: scores are above 0 in the result.
_NONE = (0, (-1, 0))


def _key(doc_id: int | None) -> tuple:
    """Larger is better among equal scores: ascending ids, then none."""
    return (0, 0) if doc_id is None else (1, -doc_id)


def _found(vectors: DataFrame, items: Items, n_docs: int, n_terms: int, top: int, limits: Limits) -> DataFrame:
    """item_id, doc_id, score: the best `top` of each task's documents for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast(items)

    def impact(counts: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        if 90 * n_docs * int(n.max(initial=0)) < 2**63:
            m = 10 + 90 * n * n_docs // n_terms
        else:
            m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n])
        counts = counts.astype(np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, np.diff(first)))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        ids, n, term, count, held = [], [], [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(row[0])
                n.append(row[1])
                term.append(row[2])
                count.append(row[3])
                held += len(row[2]) // 4
                if held >= limits.tree_terms:
                    yield ids, np.array(n), term, count
                    ids, n, term, count, held = [], [], [], [], 0
        if ids:
            yield ids, np.array(n), term, count

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [[_NONE] * top for _ in items.ids]
        for ids, n, term, count in trees(batches):
            first = np.cumsum([0, *(len(t) // 4 for t in term)])
            held, counts = np.frombuffer(b"".join(term), np.int32), np.frombuffer(b"".join(count), np.int32)
            # Only the terms that occur here become dimensions.
            own, place = np.unique(held, return_inverse=True)
            tree = BallTree(first, place, impact(counts, n, first), len(own), limits.leaf)
            keys = [_key(x) for x in ids]
            for a in range(0, len(items.ids), limits.items_at_once):
                b = min(len(items.ids), a + limits.items_at_once)
                cuts, wanted, weights = items.part(a, b)
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                hit = own[at] == wanted
                cuts = np.concatenate([[0], np.cumsum(hit)])[cuts]
                tree.search(cuts, at[hit], weights[hit], keys, best[a:b])
        rows = [(items.ids[i], key, score) for i, heap in enumerate(best) for score, key in heap if score]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([-r[1][1] if r[1][0] else None for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["item_id", "doc_id", "score"],
        )

    some = vectors.filter(F.octet_length("terms") > 0).select("doc_id", "n", "terms", "counts")
    found = some.mapInArrow(search, "item_id long, doc_id long, score long").withColumn("apart", F.spark_partition_id() % RANKED_APART)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("item_id", "apart").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).drop("rank", "apart")


def _parts(pairs: DataFrame) -> Iterator[Items]:
    """All items, as many at once as may be broadcast."""
    sizes = pairs.agg(F.count(F.lit(1))).first()[0]
    parts = 1 + sizes // ITEM_TERMS
    for k in range(parts):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
        rows = sorted(rows.collect(), key=lambda r: (r["item_id"] is None, r["item_id"]))
        if rows:
            held = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
            vocabulary, term = np.unique(np.concatenate(held), return_inverse=True)
            yield Items([r["item_id"] for r in rows], np.cumsum([0, *map(len, held)]), term, vocabulary)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, limits: Limits = Limits()) -> DataFrame:
    """The `top` best documents of each item: item_id, rank (from 1), doc_id, score.

    `items` is (item_id, text).  Scores are those of the module's contract: whole
    numbers, summed over the terms of an item once each.  Documents with score 0 are
    not in the result; equal scores go by ascending doc_id, documents without an id
    last.  Every row of `docs` is a document, repeated ones too; rows of `items` that
    share an id, or have none, are one item.  Null texts have no terms, and an item
    without terms, or an empty table, gives no row.  Other columns play no part.
    """
    spark, found = docs.sparkSession, None
    pairs = written(_item_terms(items), "item-terms")
    for part in _parts(pairs):
        vectors = _vectors(docs, part)
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_counts(vectors, len(part.vocabulary))
        part.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        of_part = _found(vectors, part, n_docs, max(1, n_terms), top, limits)
        found = of_part if found is None else found.unionByName(of_part)
    if found is None:
        return _none(spark)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS doc,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL
), totals AS (
    SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM texts WHERE len(w) > 0
), items AS (
    SELECT DISTINCT item_id, term FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), held AS (
    SELECT doc, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT doc, doc_id, len(w) AS n, unnest(w) AS term FROM texts) WHERE term IN (SELECT term FROM items) GROUP BY doc, term
), weighted AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, nd
), scored AS (
    SELECT item_id, doc, any_value(doc_id) AS doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt)))) AS BIGINT) AS score
    FROM items JOIN held USING (term) JOIN weighted USING (term), totals GROUP BY item_id, doc
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
