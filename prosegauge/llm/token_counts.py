"""Token counts by a map-side lookup of pre-token lengths in two tiers.

A tokenizer splits a text into pre-tokens and encodes each by itself, so a count
is a sum of pre-token lengths.  The first tier holds the lengths of the most
frequent pre-tokens of all texts: every task counts its own, keeps a bounded
summary, and the summaries are added up; the merged table is packed and broadcast.
The second tier is a cache in each worker: what is in neither is encoded once by
the library.  No pre-token of a text is ever shuffled, only the summaries are.
Which pre-tokens are in a tier changes the time, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.pieces import splitter
from prosegauge.llm.textscan import text_blocks

#: Entries of the broadcast table, of a task's summary, and of a worker's cache.
FREQUENT = 16_384
SUMMARY = 8_192
CACHED = 400_000


def frequent_pieces(texts: DataFrame, path: str, top: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent pre-tokens of the column `text`, by the summaries of all tasks."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(path), Counter()
        for batch in batches:
            for block in text_blocks(batch, "text"):
                for text in block.column("text").to_pylist():
                    counts.update(split.pieces(text or "") or ())
                if len(counts) > 16 * summary:  # a bounded summary: rare ones go
                    counts = Counter(dict(counts.most_common(4 * summary)))
        kept = counts.most_common(summary)
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())}
        )

    found = texts.mapInArrow(summaries, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(top).collect()]


class PackedLengths:
    """Lengths of pre-tokens as three flat buffers, a fraction of a dictionary's size on the wire."""

    def __init__(self, pieces: list[str], lengths: list[int]) -> None:
        raw = [p.encode() for p in pieces]
        self.text = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32).tobytes()
        self.lengths = np.asarray(lengths, np.uint32).tobytes()

    def table(self) -> dict[str, int]:
        ends = np.frombuffer(self.ends, np.uint32).tolist()
        spans = zip([0, *ends], ends, strict=False)
        lengths = np.frombuffer(self.lengths, np.uint32).tolist()
        return {self.text[a:b].decode(): n for (a, b), n in zip(spans, lengths, strict=True)}


class Lookup(dict):
    """Both tiers in one worker: lengths by pre-token, the frequent ones and a cache that is filled on the way."""

    def __init__(self, path: str, packed: PackedLengths, cached: int = CACHED) -> None:
        self.split, self.frequent, self.cached = splitter(path), packed.table(), cached
        self.update(self.frequent)

    def __missing__(self, piece: str) -> int:
        if len(self) > self.cached:
            self.clear()
            self.update(self.frequent)
        found = self[piece] = len(self.split.encoded([piece])[0])
        return found

    def counts(self, texts: list[str]) -> list[int]:
        length, split = self.__getitem__, self.split
        each = ((t, split.pieces(t)) for t in texts)
        return [len(split.whole(t)) if p is None else sum(map(length, p)) for t, p in each]


def with_token_counts(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens that the library gives for the whole text.

    Null and empty texts have 0 tokens.  Added tokens' strings inside a text
    count as the library's default has it.  Every row is counted by itself, so
    repeated rows and any other columns pass through unchanged; an existing
    column `into` is replaced.  Texts of any length are split whole; a worker
    holds one text and its pre-tokens.
    """
    spark = docs.sparkSession
    pieces = frequent_pieces(docs.select(F.col(text).alias("text")), path)
    lengths = [len(ids) for ids in splitter(path).encoded(pieces)]
    packed = spark.sparkContext.broadcast(PackedLengths(pieces, lengths))
    kept = [c for c in docs.columns if c != into]
    names = [f"c{i}" for i in range(len(kept))]  # free of clashes with the two columns added
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    at = kept.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(path, packed.value)
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                found = lookup.counts([t or "" for t in block.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.int64())], [*names, "n"])

    # Only the text has to travel to Python, but rows must stay whole: no key is needed to join counts back.
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.mapInArrow(count, f"{schema}, n long").toDF(*kept, into)


def counted(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than `limit` tokens."""
    rows = with_token_counts(docs.select("doc_id", "text"), path)
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
