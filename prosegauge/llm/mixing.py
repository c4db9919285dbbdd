"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens is divided down a tree of domains, languages and sources in
proportion to weights.  A node can take at most its tokens times the number of
epochs.  What a node cannot take goes to its siblings, again by weight; only what
all children of a node together cannot take was never given to that node but to
its own siblings.  A leaf spends its budget on whole epochs and on a prefix of one
more epoch, each in a seeded order of its documents.

The tree is small beside the corpus.  A prefix of a leaf is found by sums over hash
ranges; only the range in which the budget ends is looked at row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.words import words

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Integer weights per name at each level (1 for names not given), the budget as a share of all tokens."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    numerator: int = 1
    denominator: int = 2
    epochs: int = 3
    seed: str = "mix-1"


#: The mix of the registered query: domains are the sources' numbers modulo 4.
PRODUCTION = Mix({"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}})


def domain(source: Column) -> Column:
    """The domain of a source: its last number modulo 4; sources without one are `other`."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise("other")


def _weight(level: str, given: dict[str, int]) -> Column:
    known = F.lit(None).cast("long")
    for name, weight in given.items():
        known = F.when(F.col(level) == name, F.lit(weight).cast("long")).otherwise(known)
    return F.coalesce(known, F.lit(1).cast("long"))


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add `given`: the share of `budget` (that of the parent) for each of `nodes` with `cap` and `weight`.

    Children in the order of cap over weight: as long as a child's cap is below
    its part of what is left, it is filled; the others divide the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    nodes = nodes.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    nodes = nodes.withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("cap") * F.col("left") <= F.col("weight") * (F.col("budget") - F.col("caps"))
    nodes = nodes.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    nodes = nodes.withColumn("used", used).withColumn("free", free)
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(weight * (budget - used)) div free"))
    return nodes.withColumn("given", given).drop("caps", "left", "full", "used", "free")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """`leaves` (domain, lang, source, tokens) with `budget`, the tokens to take from each."""
    sized = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("t"))
    upper = total.select(F.expr(f"(t * {mix.numerator}) div {mix.denominator}").alias("budget"))
    parent: list[str] = []
    for level in LEVELS:
        nodes = sized.groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, mix.weights.get(level, {})))
        nodes = nodes.filter("weight > 0")
        nodes = nodes.crossJoin(F.broadcast(upper)) if not parent else nodes.join(upper, parent)  # one row, the budget of the root
        upper = divide(nodes, parent or [F.lit(0)], level).select(*parent, level, F.col("given").alias("budget"))
        parent.append(level)
    return leaves.join(upper, list(LEVELS))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(domain(F.col("source")), F.lit("other")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("tokens"),
    )


def chosen(docs: DataFrame, mix: Mix) -> DataFrame:
    """What the mix takes: doc_id, text_hash, domain, lang, source, tokens, epoch, one row per time it is taken.

    Rows without a token are never taken; null names are names of their own.
    Rows that repeat id, text and names are one unit with all their tokens.  The
    prefix of an epoch ends before the document that would exceed the budget.
    """
    unit = ["doc_id", "text_hash", *LEVELS]
    units = _named(docs).groupBy(*unit).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    leaves = units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, mix).withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    units = units.join(plan.select(*LEVELS, "epochs", "rest"), list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    units = units.withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    ranges = units.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*LEVELS, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    units = units.join(ranges, [*LEVELS, "range"]).withColumn("at", F.col("before") + F.sum("tokens").over(inside))
    times = F.col("epochs") + (F.col("at") <= F.col("rest")).cast("long")
    taken = units.withColumn("times", times).filter("times > 0")
    return taken.select(*unit, "tokens", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("epoch"))


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of `docs` that the mix takes, each as many times as it is taken."""
    times = chosen(docs, mix).groupBy("doc_id", "text_hash", *LEVELS).agg(F.count(F.lit(1)).cast("int").alias("times"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    lang, source = F.coalesce(names["lang"], F.lit("")), F.coalesce(names["source"], F.lit(""))
    same = F.col(names["doc_id"]).eqNullSafe(times["doc_id"]) & (F.xxhash64(names["text"]) == times["text_hash"])
    same = same & (lang == times["lang"]) & (source == times["source"])
    found = rows.join(times, same).select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time"))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def mix_rows(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of everything that the production mix takes."""
    return chosen(docs, PRODUCTION).drop("text_hash")


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in PRODUCTION.weights.get(level, {}).items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def sql() -> str:
    """The same choice in SQL: three levels of budgets, then running sums per leaf."""
    steps, parent = [], []
    for level in LEVELS:
        keys = ", ".join([*parent, level])
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        link = f"JOIN given_{parent[-1]} USING ({', '.join(parent)})" if parent else "CROSS JOIN root"
        steps.append(f"""
nodes_{level} AS (
    SELECT {keys}, cap, weight, budget FROM (
        SELECT {keys}, CAST(sum(tokens) * {PRODUCTION.epochs} AS BIGINT) AS cap, CAST({_sql_weight(level)} AS BIGINT) AS weight
        FROM leaves GROUP BY {keys}) {link}
), ordered_{level} AS (
    SELECT *, coalesce(CAST(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS caps,
        CAST(sum(weight) OVER ({by}) AS BIGINT)
        - coalesce(CAST(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest_weight
    FROM nodes_{level} WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level})
), filled_{level} AS (
    SELECT *, cap * rest_weight <= weight * (budget - caps) AS is_full FROM ordered_{level}
), given_{level} AS (
    SELECT {keys}, CASE WHEN is_full THEN cap ELSE (weight * (budget - used)) // free END AS budget FROM (
        SELECT *, CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS BIGINT) AS used,
            CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS BIGINT) AS free FROM filled_{level})
)""")
        parent.append(level)
    return rf"""
WITH units AS (
    SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
            THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE 'other' END AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
    FROM documents
), taking AS (SELECT * FROM units WHERE tokens > 0
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM taking GROUP BY domain, lang, source
), root AS (SELECT (CAST(sum(tokens) AS BIGINT) * {PRODUCTION.numerator}) // {PRODUCTION.denominator} AS budget FROM leaves
), {','.join(steps)},
plan AS (
    SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN given_source USING (domain, lang, source)
), placed AS (
    SELECT doc_id, domain, lang, source, tokens, epochs, rest,
        sum(tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('{PRODUCTION.seed}:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM taking JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch
FROM placed
"""
