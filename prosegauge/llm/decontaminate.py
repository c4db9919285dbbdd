"""Benchmark passages inside documents, by windows of the items' sizes.

Everything here is column expressions.  An item is a multiset of shingles, and so is
every run of as many words of a document, a window; all windows are judged, wherever
they start and in whatever order they hold the item's parts.

A similar window lacks at most a quarter of an item's weight, a shingle's weight being
how often it occurs.  So it holds one of any shingles that together weigh more: the
item's rarest ones are its prefix.  A broadcast join finds where documents hold a
shingle of a prefix, and a stretch of three windows' length around it has all windows
that hold it.

In such a stretch the best window is found in one sweep.  A shingle of the stretch
adds one to what a window shares with the item for a run of starts: from the first
window that reaches it, or that no longer holds more of the same shingle before it
than the item has, to the one that begins with it.  Where most of these runs overlap,
the weighted Jaccard similarity is largest.  Nothing is estimated, so no similar pair
is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions.text import let, starts
from prosegauge.llm.words import words

SHINGLE, SIMILARITY = 5, 0.75
#: Bounds are whole numbers but for rounding; this much more is let through to the exact comparison.
SLACK = 1e-6
#: Shingles of the benchmark that are broadcast at once; a larger benchmark is joined in several such parts.
BROADCAST_SHINGLES = 1_000_000
#: Stands for no id; one text with this id and without one is judged once, with the same result.
_NO_ID = -(2**63)


def _id(of: Column | str) -> Column:
    return F.coalesce((F.col(of) if isinstance(of, str) else of).cast("long"), F.lit(_NO_ID))


def _shingles(of: Column, width: int) -> Column:
    """Hashes of all runs of `width` of the words, by place; empty if there are fewer.

    The words are bound once per row: written into the lambda, they would be
    split again for every place.
    """
    run = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: run(w, i))
    return let(of, lambda w: F.when(F.size(w) >= width, runs(w)).otherwise(F.array().cast("array<bigint>")))


def _prefixes(items: DataFrame, similarity: float) -> DataFrame:
    """item, m, g for the rarest shingles of each item, as many as any similar window must hold one of.

    What a window lacks of an item of weight n is at most (1 - similarity) * n.  Any
    order gives a right prefix; shingles that few items have make it selective.
    """
    one = items.select("item", "m", F.size("ig").alias("n"), F.explode("ig").alias("g"))
    one = one.groupBy("item", "m", "n", "g").agg(F.count(F.lit(1)).alias("weight"))
    often = one.groupBy("m", "g").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("item").orderBy("often", "g").rowsBetween(Window.unboundedPreceding, -1)
    ranked = one.join(often, ["m", "g"]).withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    return ranked.filter(F.col("before") <= (1 - similarity) * F.col("n") + SLACK).select("item", "m", "g")


def _best(stretch: Column, item: Column, long: Column, need: Column) -> Column:
    """(shared, start) of the window of `long` shingles of `stretch` that shares most with `item`; null below `need`.

    `item` has (g, weight) sorted by g.  Of equal windows it is the first.
    """

    def matched(r, it):
        """The places of the item's shingles as (g, at, weight), sorted by both."""
        entry = lambda g, kind, at: F.struct(g.alias("g"), F.lit(kind).alias("kind"), at.cast("int").alias("at"))
        every = F.sort_array(
            F.concat(F.transform(it, lambda x: entry(x["g"], 0, F.lit(0))), F.transform(r, lambda g, i: entry(g, 1, i)))
        )

        def paired(e):
            # How many shingles of the item come before: the last of them is the only one that can be equal.
            before = starts(F.transform(e, lambda x: F.when(x["kind"] == 0, 1).otherwise(0)))
            named = let(
                before,
                lambda n: F.transform(
                    e, lambda x, i: F.struct(x["g"].alias("g"), x["kind"].alias("kind"), x["at"].alias("at"), F.get(it, n[i] - 1).alias("of"))
                ),
            )
            same = F.filter(named, lambda x: F.coalesce((x["kind"] == 1) & (x["of"]["g"] == x["g"]), F.lit(False)))
            return F.transform(same, lambda x: F.struct(x["g"].alias("g"), x["at"].alias("at"), x["of"]["weight"].alias("weight")))

        return let(every, paired)

    def swept(m, r):
        last = F.greatest(F.lit(0), F.size(r) - long)

        def run(x, i):
            # With so many of the same shingle from there on, a window would have more than the item.
            earlier = F.get(m, i - x["weight"])
            after = F.when(F.coalesce(earlier["g"] == x["g"], F.lit(False)), earlier["at"] + 1).otherwise(0)
            return F.struct(F.greatest(after, x["at"] - long + 1, F.lit(0)).alias("a"), F.least(x["at"], last).alias("b"))

        runs = F.filter(F.transform(m, run), lambda v: v["a"] <= v["b"])
        step = lambda at, d: F.struct(at.cast("int").alias("at"), F.lit(d).alias("d"))
        # At one start, what ends comes before what begins.
        steps = let(
            runs, lambda v: F.sort_array(F.concat(F.transform(v, lambda x: step(x["b"] + 1, -1)), F.transform(v, lambda x: step(x["a"], 1))))
        )
        count = lambda e, n: F.transform(e, lambda x, i: F.struct((n[i] + x["d"]).alias("shared"), (-x["at"]).alias("less")))
        best = let(steps, lambda e: let(starts(F.transform(e, lambda x: x["d"])), lambda n: F.array_max(count(e, n))))
        return F.struct(best["shared"].alias("shared"), (-best["less"]).alias("start"))

    return let(
        stretch,
        lambda r: let(item, lambda it: let(matched(r, it), lambda m: F.when(F.size(m) >= need, swept(m, r)))),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Which documents hold which items: doc_id, item_id, text_hash, start, similarity.

    `start` is the word at which the most similar window begins, the first of
    equals.  Texts are lower-cased.  An item of fewer than five words is one
    shingle; a document shorter than an item is one window.  Null and blank texts
    on either side match nothing, nor do items without an id; a document without
    one has a null doc_id.  Documents that repeat id and text give one row per item.
    """
    # A benchmark is read once per run and its items are short beside the corpus; it is not collected.
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words(F.lower("text")).alias("w")).dropDuplicates()
    items = items.filter(F.size("w") > 0).withColumn("item", F.xxhash64("item_id", "w")).withColumn("m", F.size("w"))
    by_width = {r["width"]: r["n"] for r in items.groupBy(F.least("m", F.lit(SHINGLE)).alias("width")).agg(F.sum("m").alias("n")).collect()}
    texts = docs.select(_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = None
    for width, n in sorted(by_width.items()):
        some = items.filter(F.least("m", F.lit(SHINGLE)) == width).withColumn("ig", _shingles(F.col("w"), width))
        part = _leaks_of_width(texts, some, width, 1 + n // BROADCAST_SHINGLES, similarity)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.limit(0).select(
            "doc_id", F.lit(0).alias("item_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")
        )
    return found.withColumn("doc_id", F.when(F.col("doc_id") > _NO_ID, F.col("doc_id")).cast(docs.schema["doc_id"].dataType))


def _leaks_of_width(texts: DataFrame, items: DataFrame, width: int, parts: int, similarity: float) -> DataFrame:
    prefixes = _prefixes(items, similarity)
    weighed = items.select("item", F.explode("ig").alias("g")).groupBy("item", "g").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    weighed = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("g", "weight"))).alias("shingles"))
    whole = items.select("item", "item_id").join(weighed, "item")
    places = texts.select("doc_id", "text_hash", _shingles(words(F.lower("text")), width).alias("dg"))
    # The outer form: for the inner one a filter on the array is inferred and pushed down, and shingles are made twice.
    places = places.select("doc_id", "text_hash", "dg", F.posexplode_outer("dg").alias("at", "g"))
    keys, found = ("doc_id", "text_hash", "item", "block"), None
    for k in range(parts):
        # Items are dealt to the parts by their names; the count of shingles is checked: a part has about BROADCAST_SHINGLES.
        of_part = F.pmod(F.hash("item"), F.lit(parts)) == k
        hit = places.join(F.broadcast(prefixes.filter(of_part)), "g").withColumn("long", F.col("m") - width + 1)
        block = F.floor(F.col("at") / F.col("long")).cast("int")
        hit = hit.withColumns({"block": block, "from": F.greatest(F.lit(0), (block - 1) * F.col("long"))})
        # All windows that hold a shingle of a block lie in it and the blocks before and after.
        stretch = F.slice("dg", F.col("from") + 1, 3 * F.col("long")).alias("stretch")
        one = hit.select(*keys, "long", "from", stretch).dropDuplicates(list(keys)).join(F.broadcast(whole.filter(of_part)), "item")
        total = F.least("long", F.size("stretch")) + F.col("long")
        need = F.ceil(similarity / (1 + similarity) * total - SLACK)
        one = one.withColumn("total", total).withColumn("best", _best(F.col("stretch"), F.col("shingles"), F.col("long"), need))
        one = one.filter(F.col("best").isNotNull()).withColumn("similarity", F.col("best.shared") / (F.col("total") - F.col("best.shared")))
        one = one.filter(F.col("similarity") >= similarity)
        one = one.select("doc_id", "item_id", "text_hash", (F.col("from") + F.col("best.start")).cast("int").alias("start"), "similarity")
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("doc_id", "text_hash", "item_id").orderBy(F.desc("similarity"), "start")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with an id and item that it holds: doc_id, item_id, similarity."""
    return leaks(docs.filter(F.col("doc_id").isNotNull()), benchmark).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text holds no item, with or without an id."""
    found = leaks(docs, benchmark).select(_id("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).dropDuplicates()
    return docs.join(found, (_id(docs["doc_id"]) == found["leak_id"]) & (F.xxhash64(docs["text"]) == found["leak_hash"]), "left_anti")


#: Every window of every document that shares a shingle with an item, counted anew.
SQL = r"""
WITH items AS (
    SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), sized AS (
    SELECT row_number() OVER (ORDER BY item_id, w) AS iid, item_id, least(len(w), 5) AS width, len(w) - least(len(w), 5) + 1 AS long, w FROM items WHERE len(w) > 0
), item_grams AS (
    SELECT iid, width, array_to_string(w[o + 1 : o + width], ' ') AS g
    FROM (SELECT *, unnest(range(0, long)) AS o FROM sized)
), item_counts AS (
    SELECT iid, width, g, count(*) AS c FROM item_grams GROUP BY ALL
), texts AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY doc_id) AS rid FROM (
        SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), doc_grams AS MATERIALIZED (
    SELECT rid, width, n, pos, array_to_string(w[pos + 1 : pos + width], ' ') AS g FROM (
        SELECT rid, width, len(w) - width + 1 AS n, unnest(range(0, len(w) - width + 1)) AS pos, w
        FROM texts, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width)
), pairs AS MATERIALIZED (
    SELECT DISTINCT d.rid, d.width, d.n, i.iid, s.long FROM doc_grams d JOIN item_counts i USING (width, g) JOIN sized s USING (iid)
), windows AS (
    SELECT *, unnest(range(0, greatest(0, n - long) + 1)) AS start FROM pairs
), window_counts AS (
    SELECT v.rid, v.iid, v.long, v.start, least(v.n, v.long) AS size, d.g, count(*) AS c, any_value(i.c) AS of_item
    FROM doc_grams d JOIN windows v ON v.rid = d.rid AND v.width = d.width AND d.pos >= v.start AND d.pos < v.start + v.long
    JOIN item_counts i ON i.iid = v.iid AND i.g = d.g GROUP BY ALL
), shared AS (
    SELECT rid, iid, start, size + long AS total, CAST(sum(least(c, of_item)) AS DOUBLE) AS s FROM window_counts GROUP BY ALL
)
SELECT doc_id, item_id, max(s / (total - s)) AS similarity
FROM shared JOIN texts USING (rid) JOIN sized USING (iid) WHERE s / (total - s) >= 0.75
GROUP BY doc_id, item_id
"""
