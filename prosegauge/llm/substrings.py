"""Repeated passages, found with suffix automata of reference shards.

A window of `size` words is repeated if its words also start at another place of
any document.  Two equal windows have the same minimizer, the least hash among
their short word runs, at the same offset.  So every document is cut into segments,
the words of all neighbouring windows with one minimizer, and equal windows always
meet under their minimizer's key.

Segments that are equal are one reference with a count, so copies cost one row per
task.  A reference that occurs twice repeats in all its windows.  The others are
streamed through the suffix automaton of the references with their key: matching
statistics give the maximal spans that occur elsewhere.  The corpus is its own
reference and has no size bound, so automata are not sent to every task: references
are dealt out by key, and a key of very many references is cut into shards, with
every segment streamed through each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import textscan
from prosegauge.llm.automaton import SuffixAutomaton
from prosegauge.llm.shared import written
from prosegauge.llm.textscan import Words, mix, scan_words, text_blocks, text_buffers, window_hashes

SIZE, RUN = 35, 8
#: References in one automaton.
SHARD = 20_000
_NO_ID = -(2**63)


def segments(words: Words, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, minimizer's hash and whole hash of every segment."""
    n = len(words) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    runs = window_hashes(words.hash, np.arange(len(words) - run + 1), run)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])  # windows inside one row
    if not len(at):
        return none, none, none, none
    least = np.lib.stride_tricks.sliding_window_view(runs, size - run + 1)[at].argmin(axis=1) + at
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
    length = np.diff(np.append(first, len(at))) + size - 1
    start = at[first]
    up, down = textscan._WINDOW_POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words.hash * up[: len(words)], out=sums[1:])
    whole = mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))
    return start, length, runs[least[first]].view(np.int64), whole.view(np.int64)


def _segments(texts: DataFrame, size: int, run: int) -> DataFrame:
    """Segments of (id, th, text): id, th, pos, len, key, ref."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = scan_words(*text_buffers(block.column("text")))
                start, length, key, ref = segments(words, size, run)
                row = pa.array(words.row[start] if len(start) else start)
                pos = start - words.first[words.row[start]] if len(start) else start
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("id").take(row),
                        block.column("th").take(row),
                        pa.array(pos.astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                        pa.array(key),
                        pa.array(ref),
                    ],
                    ["id", "th", "pos", "len", "key", "ref"],
                )

    return texts.select("id", "th", "text").mapInArrow(make, "id long, th long, pos int, len int, key long, ref long")


def _with_words(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Word hashes of asked segments (key, ref, n, refs, id, th, pos, len): key, ref, n, refs, words.

    Requests of one document are gathered first, so its text is joined once.
    """
    lists = asked.groupBy("id", "th").agg(F.collect_list(F.struct("key", "ref", "n", "refs", "pos", "len")).alias("asked"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                words = scan_words(*text_buffers(block.column("text")))
                lists = block.column("asked")
                row = np.repeat(np.arange(block.num_rows), np.asarray(lists.value_lengths(), np.int64))
                each = lists.flatten()
                get = lambda name, each=each: each.field(each.type.get_field_index(name))
                start = words.first[row] + get("pos").to_numpy()
                length = get("len").to_numpy().astype(np.int64)
                ends = np.cumsum(length)
                places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(words.hash[places].view(np.int64)))
                yield pa.RecordBatch.from_arrays([get("key"), get("ref"), get("n"), get("refs"), found], ["key", "ref", "n", "refs", "words"])

    joined = texts.join(lists, ["id", "th"]).select("text", "asked")
    return joined.mapInArrow(make, "key long, ref long, n long, refs long, words array<long>")


def _match(references: DataFrame, size: int, shard: int) -> DataFrame:
    """Spans of references (key, ref, n, refs, words) that occur once but have windows elsewhere: key, ref, spans."""
    shards = F.ceil(F.col("refs") / shard).cast("int")
    home = F.pmod(F.col("ref"), shards)
    # A reference that occurs twice is all repeated; it needs no streaming, but others may match it.
    every = F.when(F.col("n") > 1, F.array(home)).otherwise(F.sequence(F.lit(0), shards - 1))
    rows = references.select("key", "ref", "n", "words", home.alias("home"), F.explode(every).alias("shard"))
    rows = rows.withColumn("away", F.col("shard") != F.col("home"))
    rows = rows.repartition("key", "shard").sortWithinPartitions("key", "shard", "away", "ref")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, held, seen, found = None, SuffixAutomaton(), [], set(), []

        def stream(key: int, ref: int, words: list[int], times: int) -> None:
            spans = automaton.spans(words, size, times)
            if spans:
                found.append((key, ref, spans))

        def finish() -> None:
            """All references of the shard are in: their own segments need a second occurrence."""
            if not automaton.closed:
                automaton.close()
                for ref, n, words in held:
                    if n == 1:
                        stream(group[0], ref, words, 2)
                held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "shard", "away", "ref", "n")]
            words_of = batch.column("words")
            for i, (key, number, away, ref, n) in enumerate(zip(*columns, strict=True)):
                if (key, number) != group:
                    finish()
                    group, automaton, seen = (key, number), SuffixAutomaton(), set()
                words = words_of[i].values.to_pylist()
                if away:
                    finish()
                    stream(key, ref, words, 1)
                elif ref not in seen:  # a repeated row of the same document brings its segments again
                    seen.add(ref)
                    automaton.add(words, min(n, 2))
                    held.append((ref, n, words))
            if len(found) > 10_000:
                yield _spans_batch(found)
                found = []
        finish()
        yield _spans_batch(found)

    return rows.select("key", "shard", "away", "ref", "n", "words").mapInArrow(make, "key long, ref long, spans array<int>")


def _spans_batch(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "ref", "spans"])


def repeated_spans(docs: DataFrame, size: int = SIZE, run: int = RUN, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The texts (id, th, text) and, for those with repeated windows, (id, th, spans).

    `spans` are word offsets, start and stop by turns; they may overlap.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    found = _segments(texts, size, run)
    place = F.min(F.struct("id", "th", "pos", "len")).alias("place")
    refs = found.groupBy("key", "ref").agg(F.count(F.lit(1)).alias("n"), place)
    keys = refs.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("refs")).filter("total > 1")
    refs = written(refs.join(keys, "key").select("key", "ref", "n", "refs", "place.*"), "repeated-segments")
    several = refs.filter("refs > 1")
    part = _match(_with_words(several, texts), size, shard).groupBy("key", "ref").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    full = refs.filter("n > 1").select("key", "ref", F.array(F.lit(0), F.col("len")).alias("spans"))
    at = found.select("id", "th", "pos", "key", "ref").join(full.unionByName(part), ["key", "ref"])
    at = at.select("id", "th", F.transform("spans", lambda s: s + F.col("pos")).alias("spans"))
    return texts, at.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, size: int = SIZE, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed of every row: the words in no repeated window, joined by one space.

    Windows are judged on the input.  Null and blank texts have no words and an
    empty kept text; texts shorter than a window lose nothing.  Rows that repeat a
    text repeat all its windows, so all of them go.  Other columns are ignored.
    """
    texts, spans = repeated_spans(docs, size, run, shard)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                kept, total, gone = [], [], []
                raw, (data, offsets) = block.column("spans"), text_buffers(block.column("text"))
                bytes_of = data.tobytes()
                for i in range(block.num_rows):
                    words = bytes_of[offsets[i] : offsets[i + 1]].split()  # at the same six bytes
                    total.append(len(words))
                    if raw[i].is_valid:
                        cuts = raw[i].values.to_numpy().reshape(-1, 2)
                        depth = np.bincount(cuts[:, 0], minlength=len(words) + 1) - np.bincount(cuts[:, 1], minlength=len(words) + 1)
                        words = list(compress(words, (np.cumsum(depth)[:-1] == 0).tolist()))
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([block.column("id"), text, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["id", "kept_text", "n_words", "n_removed"])

    joined = texts.join(spans, ["id", "th"], "left").select("id", "text", "spans")
    made = joined.mapInArrow(make, "id long, kept_text string, n_words long, n_removed long")
    return made.select(F.when(F.col("id") > _NO_ID, F.col("id")).alias("doc_id"), "kept_text", "n_words", "n_removed")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = without_repeats(docs)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
