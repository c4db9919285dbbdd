"""Documents of similar shingle sets, by prefix filters under several global orders.

A global order sorts all shingles.  If two sets have a Jaccard similarity of 3/4 or
more, then under every order the first floor(n / 4) + 1 shingles of one and of the
other share one.  Orders that put rare shingles first make such prefixes selective;
how frequent a shingle is comes from a table of hashed counts over all documents,
of fixed size.  Any table gives an order, so it decides about time and never about
results.

1. Documents of equal sets are one node.
2. Under the first order, nodes that share a prefix shingle meet.  They are not
   paired with each other: each is compared with the smallest node there, its centre.
   A group of thousands of near copies costs a comparison each.
3. Where a member is not similar to its centre, it is compared with all other members
   of the centre that are in another component, in blocks.  These candidates must
   share prefix shingles under every order; then the sets are compared exactly.

Before a text is moved for either comparison, sketches decide whether it can succeed.
A sketch counts a set's shingles by low bits of their hashes, in a byte for every two
to four of them.  Two sketches differ by no more than the sets do, and similar sets
differ by at most a seventh of their sizes; so no similar pair is lost.

Tables of nodes, pairs and texts grow with the input, so they are joined by merging and
never broadcast.

So every similar pair is either verified or joined by verified links, and the
components are those of the full join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.components import components
from prosegauge.llm.shared import summed_arrays, written
from prosegauge.llm.textscan import Words, mix, scan_words, text_blocks, text_buffers, window_hashes, windows
from prosegauge.llm.words import SPACES

SHINGLE, ORDERS = 5, 3
#: Cells of the table of counts, and by how many counts over the mean cell a shingle is hot.
CELLS, HOT = 1 << 22, 1000
#: Members that one task holds at once when members of a centre are compared.
BLOCK = 128
_NO_ID = -(2**63)
_U = np.uint64


def shingle_sets(words: Words, rows: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; a row of one to four words has one, of none an empty set."""
    at, hashes = windows(words, SHINGLE)
    cut = np.searchsorted(at, words.first)
    for row in range(rows):
        n = words.first[row + 1] - words.first[row]
        if n >= SHINGLE:
            yield np.unique(hashes[cut[row] : cut[row + 1]])
        elif n:
            yield window_hashes(words.hash, words.first[row : row + 1], int(n))
        else:
            yield np.zeros(0, _U)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for block in text_blocks(batch, "text"):
            words = scan_words(*text_buffers(block.column("text")), lower=True)
            yield block, list(shingle_sets(words, block.num_rows))


def _node(s: np.ndarray) -> int:
    """A 64-bit name of a set, from two sums over its elements."""
    both = np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)])
    return int(mix(both[:1] + mix(both[1:]) + _U(len(s))).view(np.int64)[0])


def prefix(s: np.ndarray, order: int, counts: np.ndarray) -> np.ndarray:
    """The first floor(n / 4) + 1 shingles of a set under one of the orders: rare ones first, ties by hash.

    The first order goes by the counts themselves, the others by their magnitude.
    """
    n = len(s) // 4 + 1
    if n >= len(s):
        return s
    often = counts[(s % _U(CELLS)).astype(np.int64)].astype(np.int64)
    if order:
        often = np.log2(np.maximum(often, 1)).astype(np.int64)
    rank = (often.astype(_U) << _U(32)) | (mix(s + _U(order)) >> _U(32))
    return s[np.argpartition(rank, n - 1)[:n]] if len(np.unique(rank)) == len(s) else s[np.lexsort((s, rank))[:n]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * |intersection| >= 75 * |union|, for sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < 75 * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    shared = int(np.count_nonzero(large[place] == small))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles by low bits of their hashes, at most 255 in a cell."""
    cells = 1 << max(4, len(s).bit_length() - 2)
    counted = np.bincount((s & _U(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(counted, 255).astype(np.uint8)


def _folded(sketches: np.ndarray, cells: int) -> np.ndarray:
    """Sketches, one in a row, as they are with fewer cells."""
    return sketches.reshape(*sketches.shape[:-1], -1, cells).sum(axis=-2, dtype=np.int32)


def may_be_similar(one: np.ndarray, n: int, sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of `sketches`, of sets of `sizes`, whether the set of `n` with sketch `one` can be similar."""
    cells = min(len(one), sketches.shape[1])
    one, step, found = _folded(one, cells), max(1, (1 << 20) // sketches.shape[1]), []
    for at in range(0, len(sketches), step):
        found.append(np.abs(_folded(sketches[at : at + step], cells) - one).sum(axis=1))
    return 7 * np.concatenate(found) <= n + sizes


def _counts(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        # A task's texts hold far fewer than 2 ** 32 shingles; sums over tasks stop there.
        total, held, n = np.zeros(CELLS, np.uint32), [np.zeros(0, np.int64)], 0
        for _, sets in _sets(batches):
            held.append((np.concatenate(sets) % _U(CELLS)).astype(np.int64))
            n += len(held[-1])
            if n > CELLS // 4:
                total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                held, n = [np.zeros(0, np.int64)], 0
        total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
        return total

    return summed_arrays(texts.select("text"), count, CELLS, "u4")


def _is_hot(tokens: np.ndarray, counts: np.ndarray, limit: float) -> np.ndarray:
    return counts[(tokens % _U(CELLS)).astype(np.int64)] > limit


def _nodes(texts: DataFrame, counts: Broadcast, limit: float) -> DataFrame:
    """id, th, node, n, the hot tokens of the prefix under the first order and the sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets in _sets(batches):
            node, n = pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            first = [prefix(s, 0, counts.value) if len(s) else s for s in sets]
            hot = pa.array([p[_is_hot(p, counts.value, limit)].view(np.int64) for p in first], pa.list_(pa.int64()))
            drawn = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("th"), node, n, hot, drawn], ["id", "th", "node", "n", "hot", "sketch"])

    return texts.select("id", "th", "text").mapInArrow(make, "id long, th long, node long, n long, hot array<long>, sketch binary")


def _prefixes(texts: DataFrame, counts: Broadcast, limit: float) -> DataFrame:
    """token, node for the other tokens of the prefix; a node that a task has met is not repeated."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            tokens, nodes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for s in sets:
                node = _node(s) if len(s) else None
                if node is None or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                first = prefix(s, 0, counts.value)
                tokens.append(first[~_is_hot(first, counts.value, limit)])
                nodes.append(np.full(len(tokens[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return texts.select("text").mapInArrow(make, "token long, node long")


def _centred(cold: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, centre) for nodes that share a token with a smaller one, the smallest being the centre."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, centre = None, None
        for batch in batches:
            tokens, nodes = (batch.column(c).to_numpy() for c in ("token", "node"))
            if not len(tokens):
                continue
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            centres = np.repeat(nodes[first], np.diff(np.append(first, len(tokens))))
            if tokens[0] == token:  # the token goes on from the batch before
                centres[: first[1] if len(first) > 1 else len(tokens)] = centre
            token, centre = tokens[-1], centres[-1]
            other = nodes != centres
            pairs = np.unique(np.stack([nodes[other], centres[other]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "centre"])

    cold = cold.repartition("token").sortWithinPartitions("token", "node").mapInArrow(make, "node long, centre long")
    # A hot token's centre is found by partial minima, so its nodes never meet in one task.
    often = nodes.select("node", F.explode("hot").alias("token"))
    centres = often.groupBy("token").agg(F.min("node").alias("centre"))
    warm = often.join(centres.hint("merge"), "token").select("node", "centre").filter("node <> centre")
    return cold.unionByName(warm).dropDuplicates()


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """`rows` with the text of their `node`; rows of one node are gathered, so its text is moved once."""
    names = [c for c in rows.columns if c != "node"]
    lists = rows.groupBy("node").agg(F.collect_list(F.struct(*names)).alias("asked"))
    found = texts.join(lists.hint("merge"), "node").select("node", "text", F.explode("asked").alias("a"))
    return found.select("node", "a.*", "text")


def _fits(a: str, b: str) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, centre, may) for pairs (node, n, centre, centre_n): whether sizes and sketches allow the similarity."""
    close = pairs.filter(_fits("n", "centre_n")).join(sketches.select("node", "sketch").hint("merge"), "node")
    close = close.join(sketches.select(F.col("node").alias("centre"), F.col("sketch").alias("centre_sketch")).hint("merge"), "centre")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "sketch", "centre_n", "centre_sketch")
        for batch in batches:
            may = []
            for n, one, m, other in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                one, other = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
                may.append(bool(may_be_similar(one, n, other[None, :], np.array([m]))[0]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre"), pa.array(may, pa.bool_())], ["node", "centre", "may"])

    found = close.select("node", "centre", *("n", "sketch", "centre_n", "centre_sketch")).mapInArrow(make, "node long, centre long, may boolean")
    return found.unionByName(pairs.filter(~_fits("n", "centre_n")).select("node", "centre", F.lit(False).alias("may")))


def _star(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, centre, ok) for pairs (node, centre, may): whether each node is similar to its centre.

    Where that may not be, no text is moved.
    """
    close = pairs.filter("may")
    own = close.select(F.col("centre").alias("node"), "centre").dropDuplicates()
    rows = close.select("node", "centre", F.lit(True).alias("member")).unionByName(own.withColumn("member", F.lit(False)))
    rows = _with_texts(rows, texts).repartition("centre").sortWithinPartitions("centre", "member")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, _U)
        for block, sets in _sets(batches):
            found = []
            names = ("node", "centre", "member")
            for node, of, member, s in zip(*(block.column(c).to_pylist() for c in names), sets, strict=True):
                if not member:
                    centre, held = of, s
                elif of != centre:
                    raise ValueError(f"members of {of} came before it")
                else:
                    found.append((node, of, similar(s, held)))
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names[:2] + ("ok",))

    found = rows.mapInArrow(make, "node long, centre long, ok boolean").dropDuplicates()
    return found.unionByName(pairs.filter("not may").select("node", "centre", F.lit(False).alias("ok")))


_GROUP = ("centre", "class", "block")
_ASKED = "node long, centre long, class int, block int, label long, asks boolean"


def _remaining(verified: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of one centre in different components that may be similar, one of them at least not similar to the centre.

    Sizes are cut into classes a third apart: sets that may be similar are in the
    same class or in neighbouring ones, so members meet by centre and class.  Each
    block of held members is met by all that ask; a row comes out for those whose
    sketch allows a similarity, and no pairs do.
    """
    label = lambda of, name: labels.select(F.col("node").alias(of), F.col("label").alias(name)).hint("merge")
    named = verified.join(label("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(label("centre", "own"), "centre", "left").withColumn("own", F.coalesce("own", "centre"))
    named = named.withColumn("apart", ~F.col("ok") & (F.col("label") != F.col("own"))).join(sketches.hint("merge"), "node")
    named = named.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int"))
    named = named.select("node", "n", "centre", "label", "apart", "class")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class")
    asking = named.select("node", "n", "centre", "label", near)
    held = named.filter("apart")
    meet = held.groupBy("centre", "class").agg(F.count(F.lit(1)).alias("held_n"))
    others = asking.groupBy("centre", "class").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    meet = meet.join(others.hint("merge"), ["centre", "class"]).select("centre", "class", F.ceil(F.col("held_n") / BLOCK).cast("int").alias("blocks"))
    held = held.join(meet.hint("merge"), ["centre", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("asks", F.lit(False))
    asking = asking.join(meet.hint("merge"), ["centre", "class"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    names = ["node", "n", *_GROUP, "label", "asks"]
    rows = held.select(*names).unionByName(asking.select(*names)).join(sketches.select("node", "sketch").hint("merge"), "node")
    rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "asks")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, stacks = None, [], []

        def stacked() -> list[tuple]:
            """The held members by the size of their sketches: rows, labels, sizes, sketches, and which were met."""
            by_cells: dict[int, list] = {}
            for row in kept:
                by_cells.setdefault(len(row[2]), []).append(row)
            parts = [(list(zip(*rows, strict=True)), rows) for rows in by_cells.values()]
            return [(rows, np.array(c[1]), np.array(c[3]), np.stack(c[2]), np.zeros(len(rows), bool)) for c, rows in parts]

        def met() -> list[tuple]:
            return [(row[0], *group, row[1], False) for rows, *_, hit in stacks for row, h in zip(rows, hit, strict=True) if h]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["node", *_GROUP, "label", "asks"])

        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("node", "n", *_GROUP, "label", "asks", "sketch"))
            for node, n, centre, size, number, label, asks, drawn in zip(*columns, strict=True):
                if (centre, size, number) != group:
                    found += met()
                    group, kept, stacks = (centre, size, number), [], []
                one = np.frombuffer(drawn, np.uint8)
                if not asks:
                    kept.append((node, label, one, n))
                    continue
                stacks = stacks or stacked()
                asked = False
                for _, of, sizes, drawn_ones, hit in stacks:
                    may = (of != label) & may_be_similar(one, n, drawn_ones, sizes)
                    hit |= may
                    asked |= bool(may.any())
                if asked:
                    found.append((node, *group, label, True))
            yield batch_of(found)
        yield batch_of(met())

    return rows.select(*names, "sketch").mapInArrow(make, _ASKED)


def _block_links(rows: DataFrame, texts: DataFrame, counts: Broadcast) -> DataFrame:
    """Links (a, b) between the held and the asking rows of each block, enough to join all components that are similar."""
    rows = _with_texts(rows, texts).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "asks")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, index, joined_to = None, [], [], {}

        def root(label: int) -> int:
            while label in joined_to:
                label = joined_to[label]
            return label

        for block, sets in _sets(batches):
            found = []
            names = ("node", "label", "asks", *_GROUP)
            for node, label, asks, centre, size, number, s in zip(*(block.column(c).to_pylist() for c in names), sets, strict=True):
                if (centre, size, number) != group:
                    group, kept, index, joined_to = (centre, size, number), [], [{} for _ in range(ORDERS)], {}
                shares = None
                for order, inverted in enumerate(index):
                    first = prefix(s, order, counts.value).tolist()
                    if not asks:
                        for token in first:
                            inverted.setdefault(token, []).append(len(kept))
                    else:
                        met = {i for token in first for i in inverted.get(token, ())}
                        shares = met if shares is None else shares & met
                        if not shares:
                            break
                if not asks:
                    kept.append((node, label, s))
                    continue
                for i in sorted(shares or ()):
                    other, of, t = kept[i]
                    a, b = root(of), root(label)
                    if a != b and similar(s, t):
                        joined_to[max(a, b)] = min(a, b)
                        found.append((min(node, other), max(node, other)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(make, "a long, b long").dropDuplicates()


def _key() -> tuple[Column, Column]:
    """A row's id, the smallest number for none, and the hash of its text: neither is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th")


def _labelled(docs: DataFrame) -> DataFrame:
    """id, th, n, component_id and label for every row of `docs`.

    A label belongs to one component only, whatever ids its rows have; rows without
    shingles have none.
    """
    spark = docs.sparkSession
    texts = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    table = _counts(texts)
    counts, limit = spark.sparkContext.broadcast(table), float(table.mean()) + HOT
    rows = written(_nodes(texts, counts, limit), "set-nodes")
    some = rows.filter("n > 0")
    places = some.groupBy("node").agg(F.min(F.struct("id", "th")).alias("place"), F.first("n").alias("n"))
    sizes = places.select("node", "n").hint("merge")
    pairs = _centred(_prefixes(texts, counts, limit), rows).join(sizes, "node")
    pairs = written(pairs.join(sizes.select(F.col("node").alias("centre"), F.col("n").alias("centre_n")), "centre"), "centres")
    # One sketch for each node that shares a token with another.
    met = pairs.select("node").union(pairs.select("centre")).dropDuplicates()
    met = places.join(met.hint("merge"), "node").select("node", "place.*", "n")
    sketches = written(some.select("id", "th", "sketch").join(met.hint("merge"), ["id", "th"]).dropDuplicates(["node"]).select("node", "n", "sketch"), "sketches")

    def texts_of(asked: DataFrame) -> DataFrame:
        """(node, text) for the nodes asked for, written once; repeated rows are harmless to what reads it."""
        found = met.join(asked.select("node").dropDuplicates().hint("merge"), "node")
        return written(texts.join(found.hint("merge"), ["id", "th"]).select("node", "text"), "compared-texts")

    promising = written(_promising(pairs, sketches), "promising")
    close = promising.filter("may")
    star = written(_star(promising, texts_of(close.select("node").union(close.select("centre")))), "star")
    links = star.filter("ok").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    labels = components(links)
    rest = written(_remaining(star, sketches, labels), "asking-in-blocks")
    if not rest.isEmpty():
        more = written(_block_links(rest, texts_of(rest), counts), "links-in-blocks")
        labels = components(links.unionByName(more))
    counts.destroy()  # all that needs it is written
    # Rows without an id name no component that has a row with one.
    known = F.when(F.col("id") > _NO_ID, F.col("id"))
    least = rows.filter("n > 0").groupBy("node").agg(F.min(known).alias("least"))
    named = least.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.coalesce(F.min("least"), F.lit(_NO_ID)).alias("component_id"))
    ids = named.join(smallest.hint("merge"), "label").select("node", "component_id", "label")
    found = rows.filter("n > 0").join(ids.hint("merge"), "node").select("id", "th", "n", "component_id", "label")
    return found.unionByName(rows.filter("n = 0").select("id", "th", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("label")))


def joined(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with doc_id, n_shingles, component_id and text_hash.

    Null, empty and blank texts have no shingles, link with nothing and are a
    component of their own, named by their own doc_id.  A component is named by the
    smallest doc_id of its rows; only one whose rows all lack an id has no name.  Rows
    that repeat an id are rows of their own.  Other columns are ignored.
    """
    real = lambda c: F.when(F.col(c) > _NO_ID, F.col(c))
    return _labelled(docs).select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"), F.col("th").alias("text_hash"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept: of each component the one with the smallest doc_id.

    A null doc_id counts as the smallest.  Of rows that repeat that doc_id in one
    component, one is kept, the first by text hash, and of rows that repeat the
    text too the least by their other columns.  Rows without shingles are all kept.
    """
    copies = _labelled(docs).filter("n > 0").groupBy("label", "id", "th").agg(F.count(F.lit(1)).alias("copies"))
    least = copies.groupBy("label").agg(F.min(F.struct("id", "th", "copies")).alias("kept")).select("kept.*")
    least = written(least, "kept-of-components")
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    some = docs.filter(~blank).select(*_key(), F.struct(*docs.columns).alias("row"))
    alone = some.join(least.filter("copies = 1").hint("merge"), ["id", "th"], "left_semi").select("row.*")
    # Partial minima come first, so copies of one row never meet in one task.
    repeated = some.join(least.filter("copies > 1").hint("merge"), ["id", "th"], "left_semi").groupBy("id", "th").agg(F.min("row").alias("row"))
    return alone.unionByName(repeated.select("row.*")).unionByName(docs.filter(blank))
