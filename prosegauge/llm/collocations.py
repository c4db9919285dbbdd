"""Phrases whose words go together, mined with stripes.

A stripe belongs to a language and a prefix: an associative counter of the words that
come next, where the counter of each next word goes on with those that come after
it.  Tasks make the stripes of their own texts, and stripes of one prefix are merged
elementwise.  One merged stripe gives everything: its entries are the counts of the
extensions of two and of three words, an entry of two words is the prefix total of
the three, and the largest of these is what may subsume it.  The empty prefix has a
stripe of its own, the counts of single words.

A stripe of a common word would be too much for one task.  So single words are
counted first, and the few that hold more than a set share of all words have their
stripes cut into as many segments as that takes, by a hash of the words that follow.
Next words stand in a stripe as one string, which is about as long as the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.shared import written
from prosegauge.llm.textscan import hash_spans, mix, text_blocks, text_buffers

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
NO_LANG = "und"
#: Segments of the stripe of single words.
WORD_SEGMENTS = 64
#: A word that holds more than one in so many of all words for each shuffle partition has its stripe cut.
SEGMENTS_A_PARTITION = 16
#: Ranges of rows that a first ranking deals a language's phrases to.
RANKED_APART = 64
STRIPE = "lang string, word string, segment int, seconds string, pairs binary, sizes binary, thirds string, triples binary"
GRAMS = "lang string, phrase string, size int, a long"

_WORD = 0xFFFFFFFF
# Classes of bytes: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Limits:
    """Sizes of what a task holds; they change no result."""

    #: UTF-8 bytes of text whose words are looked at together.
    block_bytes: int = 1 << 20
    #: Entries of stripes that a task adds up before it hands them on, and stripes handed on together.
    held_entries: int = 1_000_000
    rows_at_once: int = 5_000
    #: Bytes of stripes that are merged together; a longer stripe is merged by itself.
    merged_bytes: int = 4 << 20


@dataclass
class _Block:
    """The words of a block of texts; `pair` and `triple` are the places where two and three of a piece start."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    lang: np.ndarray  # of each word, a place in `langs`
    langs: pa.Array
    pair: np.ndarray
    triple: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[_Block]:
    for batch in batches:
        for part in text_blocks(batch, "text", limit):
            data, offsets = text_buffers(part.column("text"))
            langs = pc.dictionary_encode(part.column("lang"))
            data = _LOWER[data]
            kind = _KIND[data]
            solid = kind == 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            first, last = solid.copy(), solid.copy()
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            row = np.searchsorted(offsets, start, "right") - 1
            piece = np.cumsum(kind == 2)[start]
            linked = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
            lang = langs.indices.to_numpy().astype(np.int64)[row]
            pair, triple = np.flatnonzero(linked), np.flatnonzero(linked[:-1] & linked[1:])
            yield _Block(data, start, end, hash_spans(data, start, end), lang, langs.dictionary, pair, triple)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and how long they are."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return at, np.diff(np.append(at, len(ordered)))


def _strings(block: _Block, at: np.ndarray) -> pa.Array:
    """The words at the places of `at`."""
    start, size = block.start[at], block.end[at] - block.start[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    raw = pa.py_buffer(block.data[place].tobytes())
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), raw)


class _Numbers:
    """Whole numbers 0, 1, .. for keys, in the order in which they first came."""

    def __init__(self, kind: type) -> None:
        self.keys, self.of = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of `keys`, which are sorted and differ, and where the new ones stand among them."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        numbers = np.empty(len(keys), np.int64)
        numbers[known] = self.of[at[known]]
        numbers[new] = len(self.keys) + np.arange(len(new))
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.of = np.insert(self.of, at[new], numbers[new])
        return numbers, new

    def in_order(self) -> np.ndarray:
        return self.keys[np.argsort(self.of)]


class _Counter:
    """How often each key came; counts of a part of the input are added up before the next come."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at, _ = _runs(keys)
        self.keys, self.counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts


class _Words:
    """Numbers and strings of the words of some blocks, and of their languages."""

    def __init__(self) -> None:
        self.numbers, self.pool, self.langs = _Numbers(np.uint64), [], []

    def add(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the block, and of its language."""
        hashes, at, word = np.unique(block.hash, return_index=True, return_inverse=True)
        numbers, new = self.numbers.add(hashes)
        self.pool.append(_strings(block, at[new]))
        names = block.langs.to_pylist()
        self.langs += [name for name in names if name not in self.langs]
        return numbers[word], np.array([self.langs.index(name) for name in names])[block.lang]

    def strings(self) -> pa.Array:
        return pa.concat_arrays(self.pool) if self.pool else pa.array([], pa.large_string())


def _word_counts(texts: DataFrame, limits: Limits) -> DataFrame:
    """(lang, word, a) for every word."""

    def rows(words: _Words, counter: _Counter) -> pa.RecordBatch:
        hashes = words.numbers.in_order()
        word = counter.keys & _WORD
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words.langs, pa.string()).take(counter.keys >> 32),
                pa.array((mix(hashes[word]) % np.uint64(WORD_SEGMENTS)).astype(np.int32)),
                words.strings().take(word).cast(pa.string()),
                pa.array(counter.counts),
            ],
            ["lang", "segment", "word", "a"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counter = _Words(), _Counter()
        for block in _blocks(batches, limits.block_bytes):
            if len(block.hash):
                word, lang = words.add(block)
                counter.add(lang << 32 | word)
            if len(counter.keys) >= limits.held_entries:
                yield rows(words, counter)
                words, counter = _Words(), _Counter()
        if len(counter.keys):
            yield rows(words, counter)

    parts = texts.mapInArrow(count, "lang string, segment int, word string, a long")
    return written(parts.groupBy("lang", "segment", "word").agg(F.sum("a").alias("a")).select("lang", "word", "a"), "words")


class _Stripes:
    """The stripes of some blocks: words, prefixes and entries are whole numbers until they are written.

    `segments` has the hash of each word whose stripe is cut, by language, with the
    number of its segments.
    """

    def __init__(self, segments: dict[str, tuple[np.ndarray, np.ndarray]], limits: Limits) -> None:
        self.segments, self.limits = segments, limits
        self.words, self.one, self.two = _Words(), _Numbers(np.int64), _Numbers(np.int64)
        self.pairs, self.triples = _Counter(), _Counter()

    def __len__(self) -> int:
        return len(self.pairs.keys) + len(self.triples.keys)

    def add(self, block: _Block) -> None:
        if not len(block.pair):
            return
        word, lang = self.words.add(block)
        pair = self._numbered(self.two, self._numbered(self.one, lang[block.pair] << 32 | word[block.pair]) << 32 | word[block.pair + 1])
        self.pairs.add(pair)
        # Every triple starts with a pair, and both are in the order of the text.
        first = pair[np.searchsorted(block.pair, block.triple)]
        self.triples.add(first << 32 | word[block.triple + 2])

    @staticmethod
    def _numbered(numbers: _Numbers, keys: np.ndarray) -> np.ndarray:
        keys, place = np.unique(keys, return_inverse=True)
        return numbers.add(keys)[0][place]

    def _cut(self, one: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Into how many segments each prefix's stripe is cut."""
        out = np.ones(len(one), np.int64)
        for number, name in enumerate(self.words.langs):
            known, parts = self.segments.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if len(known):
                here = np.flatnonzero(one >> 32 == number)
                at = np.minimum(np.searchsorted(known, hashes[one[here] & _WORD]), len(known) - 1)
                out[here] = np.where(known[at] == hashes[one[here] & _WORD], parts[at], 1)
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not len(self):
            return
        pool, langs, hashes = self.words.strings(), pa.array(self.words.langs, pa.string()), self.words.numbers.in_order()
        one, two = self.one.in_order(), self.two.in_order()
        spread = mix(hashes)
        pair, triple = self.pairs.keys, self.triples.keys >> 32
        second = np.concatenate([two[pair], two[triple]])
        third = np.concatenate([np.full(len(pair), -1), self.triples.keys & _WORD])
        counts = np.concatenate([self.pairs.counts, self.triples.counts])
        number = np.concatenate([pair, triple])
        prefix = second >> 32
        parts = self._cut(one, hashes)[prefix]
        follow = spread[second & _WORD] + np.where(third < 0, np.uint64(0), mix(spread[third] + np.uint64(1)))
        segment = np.where(parts > 1, (follow % parts.astype(np.uint64)).astype(np.int64), 0)
        # Entries of one stripe together, in it those of one second word, the pair first.
        by_stripe = np.unique(prefix << 32 | segment, return_inverse=True)[1]
        order = np.lexsort((third, by_stripe << 32 | number))
        by_stripe, number, third, counts = by_stripe[order], number[order], third[order], counts[order]
        prefix, segment, second = prefix[order], segment[order], second[order]
        stripe_at, _ = _runs(by_stripe)
        second_at, _ = _runs(by_stripe << 32 | number)
        is_third = third >= 0
        thirds_before = np.append(0, np.cumsum(is_third))
        first_of_second = np.where(is_third[second_at], 0, counts[second_at])
        ends_of_second = np.append(second_at[1:], len(number))
        thirds_of = thirds_before[ends_of_second] - thirds_before[second_at]
        third_word, third_count = third[is_third], counts[is_third]
        second_word = second[second_at] & _WORD
        seconds_before = np.append(np.searchsorted(second_at, stripe_at), len(second_at))
        stripe_ends = np.append(stripe_at, len(number))
        for a in range(0, len(stripe_at), self.limits.rows_at_once):
            b = min(len(stripe_at), a + self.limits.rows_at_once)
            cut = seconds_before[a : b + 1]
            cut3 = thirds_before[stripe_ends[a : b + 1]]
            joined = lambda words, ends: pc.binary_join(pa.LargeListArray.from_arrays(ends - ends[0], pool.take(words)), pa.scalar(" ", pa.large_string())).cast(pa.string())
            packed = lambda values, ends: pa.array([values[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            at = stripe_at[a:b]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(one[prefix[at]] >> 32),
                    pool.take(one[prefix[at]] & _WORD).cast(pa.string()),
                    pa.array(segment[at].astype(np.int32)),
                    joined(second_word[cut[0] : cut[-1]], cut),
                    packed(first_of_second, cut),
                    packed(thirds_of, cut),
                    joined(third_word[cut3[0] : cut3[-1]], cut3),
                    packed(third_count, cut3),
                ],
                ["lang", "word", "segment", "seconds", "pairs", "sizes", "thirds", "triples"],
            )


@dataclass
class _Flat:
    """Entries of stripes one by one: the stripe's number, the next words, the count; no third word is null."""

    keys: pa.Table  # lang, word and segment of each stripe
    stripe: np.ndarray
    second: pa.Array
    third: pa.Array
    count: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Flat:
        numbers = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u4").astype(np.int64)
        split = lambda name: pc.split_pattern(batch.column(name).cast(pa.large_string()), " ")
        seconds, sizes, pairs = split("seconds"), numbers("sizes"), numbers("pairs")
        row = pc.list_parent_indices(seconds).to_numpy()
        second = pc.list_flatten(seconds)
        whole = np.flatnonzero(pairs)
        third = split("thirds").filter(pc.greater(pc.binary_length(batch.column("triples")), 0))
        third = pc.list_flatten(third)
        own = np.repeat(np.arange(len(sizes)), sizes)
        return _Flat(
            pa.table({name: batch.column(name) for name in ("lang", "word", "segment")}),
            np.concatenate([row[whole], row[own]]),
            pa.concat_arrays([second.take(whole), second.take(own)]),
            pa.concat_arrays([pa.nulls(len(whole), pa.large_string()), third]),
            np.concatenate([pairs[whole], numbers("triples")]),
        )

    def and_then(self, other: _Flat) -> _Flat:
        return _Flat(
            pa.concat_tables([self.keys, other.keys]).combine_chunks(),
            np.concatenate([self.stripe, other.stripe + len(self.keys)]),
            pa.concat_arrays([self.second, other.second]),
            pa.concat_arrays([self.third, other.third]),
            np.concatenate([self.count, other.count]),
        )

    def merged(self) -> _Flat:
        """Stripes of one key, which stand together, as one, and their entries added up."""
        new = np.ones(len(self.keys), bool)
        same = np.ones(max(0, len(self.keys) - 1), bool)
        for column in self.keys.columns:
            code = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices.to_numpy()
            same &= code[1:] == code[:-1]
        new[1:] = ~same
        stripe = (np.cumsum(new) - 1)[self.stripe]
        both = pc.dictionary_encode(pa.concat_arrays([self.second, self.third]))
        code = both.indices.fill_null(-1).to_numpy().astype(np.int64)
        second, third = code[: len(stripe)], code[len(stripe) :]
        # Stripe and second word make one number, which with the third makes another.
        prefix = np.unique(stripe << 32 | second, return_inverse=True)[1]
        order = np.argsort(prefix << 32 | (third + 1), kind="stable")
        at, _ = _runs((prefix << 32 | (third + 1))[order])
        count = np.add.reduceat(self.count[order], at) if len(at) else self.count
        one = order[at]
        return _Flat(self.keys.take(np.flatnonzero(new)).combine_chunks(), stripe[one], self.second.take(one), self.third.take(one), count)

    def part(self, first: int, last: int) -> _Flat:
        """The entries of some stripes; they are in the order of their stripes."""
        a, b = np.searchsorted(self.stripe, [first, last])
        return _Flat(self.keys.slice(first, last - first), self.stripe[a:b] - first, self.second.slice(a, b - a), self.third.slice(a, b - a), self.count[a:b])

    def grams(self, least: int) -> pa.RecordBatch:
        some = np.flatnonzero(self.count >= least)
        word = self.keys.column("word").combine_chunks().cast(pa.large_string()).take(self.stripe[some])
        third = self.third.take(some)
        space = pa.scalar(" ", pa.large_string())
        pair = pc.binary_join_element_wise(word, self.second.take(some), space)
        phrase = pc.if_else(third.is_valid(), pc.binary_join_element_wise(pair, third.fill_null(""), space), pair)
        size = np.where(third.is_valid().to_numpy(zero_copy_only=False), 3, 2).astype(np.int32)
        lang = self.keys.column("lang").combine_chunks().take(self.stripe[some])
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(size), pa.array(self.count[some])], ["lang", "phrase", "size", "a"])


def _parts(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, as many as have `limit` bytes, or one."""
    sizes = sum(pc.binary_length(batch.column(name)).to_numpy() for name in ("seconds", "pairs", "sizes", "thirds", "triples"))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _merged(batches: Iterator[pa.RecordBatch], least: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Phrases met `least` times or more, from stripes that are sorted by their keys.

    Only the last stripe of a batch may go on in the next, so one merged stripe is carried.
    """
    carry = None
    for batch in batches:
        for part in _parts(batch, limits.merged_bytes):
            flat = _Flat.of(part)
            flat = (flat if carry is None else carry.and_then(flat)).merged()
            last = len(flat.keys) - 1
            yield flat.part(0, last).grams(least)
            carry = flat.part(last, last + 1)
    if carry is not None:
        yield carry.grams(least)


def _segments(words: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For words that hold more than one in `most` of all words: their hashes and the segments of their stripes.

    There can be no more than `most` such words.
    """
    total = words.agg(F.sum("a")).first()[0] or 0
    common = words.filter(F.col("a") * most > total).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in common:
        raw = np.frombuffer(r["word"].encode(), np.uint8)
        found = hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]
        out.setdefault(r["lang"], []).append((int(found), -(-r["a"] * most // total)))
    return {lang: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(pairs), strict=True), (np.uint64, np.int64), strict=True)) for lang, pairs in out.items()}


def grams(docs: DataFrame, least: int = LEAST, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of one to three words met `least` times or more; (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = _word_counts(texts, limits)
    most = SEGMENTS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(_segments(words, most))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Stripes(shared.value, limits)
        for block in _blocks(batches, limits.block_bytes):
            made.add(block)
            if len(made) >= limits.held_entries:
                yield from made.rows()
                made = _Stripes(shared.value, limits)
        yield from made.rows()

    keys = ("lang", "word", "segment")
    stripes = texts.mapInArrow(make, STRIPE).repartition(*keys).sortWithinPartitions(*keys)
    longer = written(stripes.mapInArrow(lambda batches: _merged(batches, least, limits), GRAMS), "grams")
    shared.destroy()
    single = words.filter(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "a")
    return single.unionByName(longer), words.groupBy("lang").agg(F.sum("a").alias("n"))


def _cuts() -> Column:
    """Each cut of `words` (up to three) as (k, left, right)."""
    cut = lambda k: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.slice("words", k + 1, LONGEST), " ").alias("right")
    )
    return F.when(F.size("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, limits: Limits = Limits()) -> DataFrame:
    """All candidates that no longer one stands for: lang, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends; words are
    what stands between spaces and tabs.  `a`, `l` and `r` count the phrase and the
    parts of its lowest-scoring cut, `n` all words of the language.  A null text is
    empty, a null lang is `und`; rows count as often as they are repeated; other
    columns play no part.  An empty table has no phrases.
    """
    every, totals = grams(docs, least, limits)
    found = every.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cut = found.select("lang", "phrase", "a", F.explode(_cuts()).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = every.filter(F.col("size") < LONGEST)
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    cut = cut.withColumn("over", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", wide("l") * wide("r"))
    cut = cut.withColumn("score", F.expr("over div under"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # The phrases of two words inside each of three, with its count: one starts it, one ends it.
    inner = F.array(F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " "))
    longer = found.filter(F.col("size") == LONGEST).select("lang", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    # A language has one row of totals: a short table, not one that grows with the texts.
    return kept.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, limits: Limits = Limits()) -> DataFrame:
    """The first `top` of `phrases` in each language, by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    apart = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order)
    found = phrases(docs, least, share, limits).withColumn("rank", F.row_number().over(apart)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT lang, doc, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
            string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
        FROM documents)
), texts AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM texts
), counted AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS a
    FROM placed, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
), found AS (
    SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE size > 1 AND a >= 10
), cuts AS (
    SELECT lang, size, phrase, a, k, array_to_string(words[1 : k], ' ') AS lp, array_to_string(words[k + 1 : size], ' ') AS rp
    FROM (SELECT *, unnest(range(1, size)) AS k FROM found)
), scored AS (
    SELECT c.lang, c.size, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
        CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.lp JOIN counted y ON y.lang = c.lang AND y.phrase = c.rp
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, inside, max(a) AS most FROM (
        SELECT lang, a, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS inside FROM found WHERE size = 3)
    GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest s JOIN totals t ON t.lang = s.lang LEFT JOIN longer o ON o.lang = s.lang AND o.inside = s.phrase
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
