"""Quality of texts: random-indexing word vectors, pooled, and a small network.

Every token has a fixed sparse index vector, drawn from its hash.  The vector of a
token is the sum of the index vectors of its neighbours over all texts; tokens
share a fixed number of rows by hash, so the table has one size at every scale.
A text is pooled into means over its tokens.  A network of two layers, fitted in
numpy on a bounded sample of labelled rows, turns them into a logit, and a
temperature fitted on rows that the network did not see turns that into a
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.labelled import fold, label_sample
from prosegauge.llm.shared import summed_arrays
from prosegauge.llm.textscan import hash_spans, mix, text_blocks, text_buffers

ROWS, WIDTH, NONZERO, REACH = 8192, 48, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 3e-3, 1e-4
#: At most so many labelled rows are fitted on; every fifth of them sets the temperature.
MOST_LABELLED = 12_000
FEATURES = 3 * WIDTH + 3
_BYTES = 1 << 18

# Classes of bytes: white space, letters (and all of longer UTF-8 sequences), digits, the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of one byte class but white space, and the first of each row."""
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    cut[-1] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    return hash_spans(data, start, end), np.searchsorted(start, offsets)


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of index vectors, a column for each."""
    spread = [mix(hashes + np.uint64(k + 1)) for k in range(NONZERO)]
    places = np.stack([(s % np.uint64(WIDTH)).astype(np.int64) for s in spread], 1)
    signs = np.stack([(s >> np.uint64(63)).astype(np.float32) * 2 - 1 for s in spread], 1)
    return places, signs


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of word vectors of the column `text`, one unit row per hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(ROWS * WIDTH, np.int64)
        for batch in batches:
            for block in text_blocks(batch, "text"):
                hashes, first = tokens(*text_buffers(block.column("text")))
                row = np.repeat(np.arange(block.num_rows), np.diff(first))
                bucket = (hashes % np.uint64(ROWS)).astype(np.int64) * WIDTH
                places, signs = _index(hashes)
                cells, weights = [], []
                for reach in range(1, REACH + 1):
                    near = row[:-reach] == row[reach:] if len(row) > reach else np.zeros(0, bool)
                    left, right = np.flatnonzero(near), np.flatnonzero(near) + reach
                    for of, by in ((left, right), (right, left)):
                        cells.append((bucket[of, None] + places[by]).reshape(-1))
                        weights.append(signs[by].reshape(-1))
                # Steps of one, so whole numbers: the sum does not depend on the order of tasks.
                total += np.bincount(np.concatenate(cells), np.concatenate(weights), ROWS * WIDTH).astype(np.int64)
        return total

    table = summed_arrays(texts, count, ROWS * WIDTH, "i8").reshape(ROWS, WIDTH).astype(np.float64)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    table -= table.mean(axis=0)
    return table.astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Features of each row: means of vectors, of their squares, of products of neighbours; three sizes."""
    hashes, first = tokens(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        bucket = (hashes % np.uint64(ROWS)).astype(np.int64)
        vectors, starts = table[bucket], first[:-1][some]
        nearby = np.zeros_like(vectors)
        nearby[:-1] = vectors[:-1] * vectors[1:]
        nearby[first[1:][some] - 1] = 0  # the last token of a row has no neighbour in it
        for k, what in enumerate((vectors, vectors * vectors, nearby)):
            out[some, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(what, starts, axis=0) / n[some, None]
        row = np.repeat(np.arange(len(n)), n)
        kinds = np.bincount((np.unique(row * ROWS + bucket)) // ROWS, minlength=len(n))
        out[some, -3] = np.linalg.norm(out[some, :WIDTH], axis=1)
        out[some, -2] = kinds[some] / n[some]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers over standardized features, and the temperature of the logit."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the cross entropy, then the temperature on every fifth row.

    Without rows of both labels the network is the share of label 1, smoothed.
    """
    x = x.astype(np.float64)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(np.unique(y)) < 2:
        return Network(mean, scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), prior)
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    z, goal = ((x - mean) / scale)[~held], y[~held]
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(prior)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            b, t = z[order[at : at + BATCH]], goal[order[at : at + BATCH]]
            hidden = np.tanh(b @ w[0] + w[1])
            off = (_sigmoid(hidden @ w[2] + w[3]) - t) / len(b)
            back = off[:, None] * w[2] * (1 - hidden**2)
            slopes = [b.T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ off + DECAY * w[2], off.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, w[0], w[1], w[2], float(w[3]))
    if held.any():
        logit, goal = net.logit(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, -(2 * goal - 1) * logit / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MOST_LABELLED) -> QualityModel:
    """Word vectors over all of `docs`, the network on at most `most` rows of `labels` where `allowed`.

    Only the text is ever an input.  The sample is small by its bound, so it is
    broadcast and no text is shuffled.
    """
    table = word_vectors(docs.select("text"))
    sample = label_sample(labels, label, allowed, most)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = _features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), shared).orderBy("doc_id", "x").collect()
    shared.destroy()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    return QualityModel(table, fit_network(x, np.array([r["y"] for r in rows], np.float64)))


def _features(rows: DataFrame, table) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text", _BYTES):
                x = pooled(*text_buffers(block.column("text")), table.value)
                made = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("y"), made], ["doc_id", "y", "x"])

    return rows.select("doc_id", "text", "y").mapInArrow(make, "doc_id long, y int, x binary")


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 for every whole text.

    Null and empty texts have the features of no token and so one defined score.
    Rows are scored one by one: repeats get equal scores, other columns pass
    through, a column named like `into` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != into]
    names = [f"c{i}" for i in range(len(kept))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    at = kept.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in text_blocks(batch, names[at], _BYTES):
                p = model.network.probability(pooled(*text_buffers(block.column(at)), model.table).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p)], [*names, "p"])

    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.mapInArrow(make, f"{schema}, p double").toDF(*kept, into)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; fold 2 of 4 is held out of fitting."""
    held = fold("doc_id", 4) == 2
    model = fit(docs, labels, "quality", ~held)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
