"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of its words and of their beginnings (stems
take many endings), hashed to a fixed number of weights.  A document is toxic unless every sentence is harmless (noisy-or, with a
small leak), so document labels teach sentence scores, and the sentences that
carry a document's score can be named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.labelled import fold, halved_sample
from prosegauge.llm.textscan import hash_spans, text_blocks, text_buffers

BUCKETS = 1 << 18
#: Bytes of the beginnings that count beside the whole word.
BEGINNINGS = (4, 5, 6)
#: At most so many labelled rows are fitted on, half of them of each label; a word or beginning
#: needs so many of their texts to get a weight.
MOST_LABELLED, LEAST_TEXTS = 5_000, 6
STEPS, RATE, DECAY, START = 150, 0.15, 2e-5, -5.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Sentences of a block with words in them: their rows, byte spans, and (sentence, bucket) pairs."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    bucket: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Split at full stops, exclamation and question marks and line ends; a bucket counts once per sentence."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    lowered, long = _LOWER[data], [np.flatnonzero(end - start > k) for k in BEGINNINGS]
    spans = [(start, end), *((start[at], start[at] + k) for at, k in zip(long, BEGINNINGS, strict=True))]
    bucket = np.concatenate([hash_spans(lowered, a, b) + np.uint64(k) for k, (a, b) in enumerate(spans)])
    bucket = (bucket % np.uint64(BUCKETS)).astype(np.int64)
    cut = edge.copy()
    cut[1:] |= _STOP[data]
    cuts = np.flatnonzero(cut)
    number = np.searchsorted(cuts, start, "right") - 1  # the sentence of each word
    used, number = np.unique(number, return_inverse=True)
    pairs = np.unique(np.concatenate([number, *(number[at] for at in long)]) * BUCKETS + bucket)
    begin = cuts[used]
    return Sentences(np.searchsorted(offsets, begin, "right") - 1, begin, cuts[used + 1], pairs // BUCKETS, pairs % BUCKETS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    leak: float

    def of_sentences(self, s: Sentences) -> np.ndarray:
        return _sigmoid(np.bincount(s.of, self.weights[s.bucket], len(s.row)) + self.bias)

    def of_rows(self, s: Sentences, n: int) -> np.ndarray:
        harmless = np.bincount(s.row, np.log1p(-np.minimum(self.of_sentences(s), 1 - 1e-12)), n)
        return 1 - np.exp(harmless - self.leak)


def fit_model(row: np.ndarray, of: np.ndarray, bucket: np.ndarray, y: np.ndarray, share: float) -> ToxicityModel:
    """Adam on the likelihood of document labels.

    `row` is the document of each sentence; `of` and `bucket` are the sentence and
    bucket of each word, for words that may have a weight.  `share` is the share of label 1 among all labelled rows:
    weights undo the sample's equal halves.  Without rows of both labels only the
    leak is fitted.
    """
    if len(np.unique(y)) < 2:
        return ToxicityModel(np.zeros(BUCKETS), -60.0, float(-np.log(1 - share)))
    known, word = np.unique(bucket, return_inverse=True)
    word = word.astype(np.int32)
    w = np.concatenate([np.zeros(len(known)), [START, -4.0]])  # weights, bias, logarithm of the leak
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    for step in range(1, STEPS + 1):
        z = np.bincount(of, w[word], len(row)) + w[-2]
        total = np.bincount(row, np.logaddexp(0, z), len(y)) + np.exp(w[-1])
        pull = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0) * weight
        back = pull[row] * _sigmoid(z)
        slope = np.concatenate([np.bincount(word, back[of], len(known)) + DECAY * w[:-2], [back.sum(), pull.sum() * np.exp(w[-1])]])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[known] = w[:-2]
    return ToxicityModel(weights, float(w[-2]), float(np.exp(w[-1])))


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MOST_LABELLED) -> ToxicityModel:
    """Fit on at most `most` rows of `labels` where `allowed`; only the text is ever an input."""
    sample, share = halved_sample(labels, label, allowed, most)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                s = sentences(*text_buffers(block.column("text")))
                cut = np.searchsorted(s.row, np.arange(block.num_rows + 1))
                words = np.searchsorted(s.of, cut)
                each = [(s.of[a:b] - i).astype(np.int32).tobytes() for a, b, i in zip(words[:-1], words[1:], cut[:-1], strict=True)]
                found = [s.bucket[a:b].astype(np.int32).tobytes() for a, b in zip(words[:-1], words[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("y"), pa.array(np.diff(cut)), pa.array(each, pa.binary()), pa.array(found, pa.binary())],
                    ["doc_id", "y", "n", "of", "bucket"],
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.mapInArrow(make, "doc_id long, y int, n long, of binary, bucket binary").orderBy("doc_id", "bucket").collect()
    # One document at a time: only what can get a weight is kept, in 32 bits.
    texts = np.zeros(BUCKETS, np.int32)
    for r in rows:
        texts[np.unique(np.frombuffer(r["bucket"], np.int32))] += 1
    n = np.array([r["n"] for r in rows], np.int64)
    base = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    y, of, bucket = np.array([r["y"] for r in rows]), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in range(len(rows)):
        each = np.frombuffer(rows[i]["bucket"], np.int32)
        kept = texts[each] >= LEAST_TEXTS
        bucket.append(each[kept])
        of.append(np.frombuffer(rows[i]["of"], np.int32)[kept] + base[i])
        rows[i] = None
    return fit_model(np.repeat(np.arange(len(n)), n), np.concatenate(of), np.concatenate(bucket), y, share)


def score(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """`docs` with the probability that a whole text is toxic.

    Null and empty texts have no sentence and get the leak alone.  Rows are
    scored one by one: repeats get equal scores, other columns pass through, a
    column named like `into` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != into]
    names = [f"c{i}" for i in range(len(kept))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    at = kept.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                p = shared.value.of_rows(sentences(*text_buffers(block.column(at))), block.num_rows)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p)], [*names, "p"])

    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.mapInArrow(make, f"{schema}, p double").toDF(*kept, into)


def offending(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """Sentences that score at least `least`: doc_id, start and stop in UTF-8 bytes, sentence, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                data, offsets = text_buffers(block.column("text"))
                s = sentences(data, offsets)
                p = shared.value.of_sentences(s)
                hits = np.flatnonzero(p >= least)
                raw, base = data.tobytes(), offsets[s.row[hits]]
                texts = [raw[a:b].decode() for a, b in zip(s.start[hits], s.end[hits], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").take(pa.array(s.row[hits])),
                        pa.array(s.start[hits] - base),
                        pa.array(s.end[hits] - base),
                        pa.array(texts, pa.string()),
                        pa.array(p[hits]),
                    ],
                    ["doc_id", "start", "stop", "sentence", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, start long, stop long, sentence string, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; fold 0 of 5 is held out of fitting."""
    held = fold("doc_id", 5) == 0
    model = fit(docs, labels, "toxic", ~held)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
