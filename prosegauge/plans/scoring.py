"""From hits to counts, penalties, density, score, band and advice.

Everything about one document is computed in its row; the plans here read the
input once and shuffle nothing.  Long tables (`hits`, `rule_counts`, `advice`)
are exploded from the finished rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge import config
from prosegauge.functions.text import clean, n_words, round_to
from prosegauge.operators.lexical import no_hits, no_lines, scored_only
from prosegauge.operators.views import masked_text
from prosegauge.plans.rules import Rule, default_rules, with_hits

HIT_FIELDS = ("detector", "match", "context", "penalty", "start", "end", "scored")


def score_of(density: Column) -> Column:
    raw = F.lit(100.0) * F.exp(F.lit(-config.DECAY) * density)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(raw).cast("int")))


def band_of(score: Column) -> Column:
    chain = F.when(score >= config.BANDS[0][1], config.BANDS[0][0])
    for name, floor in config.BANDS[1:-1]:
        chain = chain.when(score >= floor, name)
    return chain.otherwise(config.BANDS[-1][0])


def density_of(weighted: Column, words: Column) -> Column:
    return F.when(words > 0, weighted / (words / F.lit(config.DENSITY_BASIS))).otherwise(F.lit(0.0))


def weight_of(rule: Rule) -> Column:
    """Absolute penalties of one rule's scored hits, amplified where a tic repeats.

    Hits beyond those that a rule scores add nothing more: that is where it saturates.
    """
    total = F.aggregate(
        scored_only(F.col(f"hits_{rule.count_key}")), F.lit(0.0), lambda acc, h: acc + F.abs(h["penalty"])
    )
    if rule.name not in config.AMPLIFIED_RULES:
        return total
    n = F.col(f"n_{rule.count_key}")
    return total * F.when(n > 1, 1 + F.lit(config.CONCENTRATION) * (n - 1)).otherwise(F.lit(1.0))


def scored(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The input with hits, counts, weights, density, score, slop and band.

    A text under the word floor keeps its words, scores 100 and has no hits.
    """
    rules = default_rules() if rules is None else rules
    out = with_hits(df, rules, text)
    long_enough = F.col("word_count") >= config.MIN_WORDS
    out = out.withColumns(
        {
            **{
                f"hits_{r.count_key}": F.when(long_enough, F.col(f"hits_{r.count_key}")).otherwise(no_hits())
                for r in rules
            },
            **{
                f"n_{r.count_key}": F.when(long_enough, F.col(f"n_{r.count_key}")).otherwise(0)
                for r in rules
            },
        }
    )
    zero = F.lit(0.0)
    total = F.lit(0)
    for r in rules:
        total = total + F.aggregate(
            scored_only(F.col(f"hits_{r.count_key}")), F.lit(0), lambda acc, h: acc + h["penalty"]
        )
    out = out.withColumns(
        {"raw_weight": sum((weight_of(r) for r in rules), zero), "total_penalty": total.cast("int")}
    )
    out = out.withColumn(
        "raw_density",
        F.when(long_enough, density_of(F.col("raw_weight"), F.col("word_count"))).otherwise(zero),
    )
    out = out.withColumn("score", score_of(F.col("raw_density")))
    return out.withColumns(
        {
            "weighted_sum": round_to(F.col("raw_weight"), 2),
            "density": round_to(F.col("raw_density"), 2),
            "slop": F.lit(100) - F.col("score"),
            "band": band_of(F.col("score")),
        }
    )


SCORE_COLUMNS = (
    "word_count", "total_penalty", "weighted_sum", "density", "score", "slop", "band",
)


def scores(df: DataFrame, rules: list[Rule] | None = None, *keep: str) -> DataFrame:
    rules = default_rules(complete=False) if rules is None else rules
    return scored(df, rules).select("doc_id", *keep, *SCORE_COLUMNS)


def hit_array(rules: list[Rule]) -> Column:
    """All hits in rule order, each with its rule name and order."""

    def named(rule: Rule, order: int) -> Column:
        return F.transform(
            F.col(f"hits_{rule.count_key}"),
            lambda h: F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(order).alias("rule_order"),
                *[h[f].alias(f) for f in HIT_FIELDS],
            ),
        )

    return F.concat(*[named(rule, order) for order, rule in enumerate(rules)])


def hits(df: DataFrame, rules: list[Rule] | None = None, *keep: str) -> DataFrame:
    """One row per hit, numbered within its document in rule order.

    Every match is there; `scored` marks those that weigh.
    """
    rules = default_rules() if rules is None else rules
    return explode_hits(scored(df, rules), rules, *keep)


def explode_hits(rows: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    return rows.select("doc_id", *keep, F.posexplode(hit_array(rules)).alias("seq", "h")).select(
        "doc_id",
        *keep,
        "seq",
        F.col("h.rule"),
        F.col("h.rule_order"),
        *[F.col(f"h.{f}").alias(f) for f in HIT_FIELDS],
    )


def counts_map(rules: list[Rule]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(r.count_key) for r in rules]),
        F.array(*[F.col(f"n_{r.count_key}") for r in rules]),
    )


def rule_counts(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document and count key, zeros included."""
    rules = default_rules(complete=False) if rules is None else rules
    return scored(df, rules).select(
        "doc_id", F.explode(counts_map(rules)).alias("count_key", "n")
    )


def advice_array(rules: list[Rule]) -> Column:
    """All advice lines in rule order, the first of equal lines kept."""
    lines = F.array_distinct(F.concat(*[r.advice_column for r in rules]))
    return F.when(F.col("word_count") >= config.MIN_WORDS, lines).otherwise(no_lines())


def advice(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = default_rules() if rules is None else rules
    return (
        scored(df, rules)
        .select("doc_id", F.posexplode(advice_array(rules)).alias("rank", "line"))
        .select("doc_id", (F.col("rank") + 1).alias("rank"), "line")
    )


def analyze(df: DataFrame, rules: list[Rule] | None = None, *keep: str) -> DataFrame:
    """One record per document: hits, counts, sums, score, band, advice."""
    rules = default_rules() if rules is None else rules
    return scored(df, rules).select(
        "doc_id",
        *keep,
        *SCORE_COLUMNS,
        hit_array(rules).alias("hits"),
        counts_map(rules).alias("counts"),
        advice_array(rules).alias("advice"),
    )


# --- guards ----------------------------------------------------------------------
def too_large(text: Column, most: int | None) -> Column:
    """Whether a text is over a caller's limit; no limit, no such text."""
    return F.lit(False) if most is None else F.length(text) > most


def scan_status(text: Column, most: int | None = None) -> Column:
    """`too_large`, `no_text`, `not_enough_text` or `ok`.

    `most` is a caller's own limit in characters.  Texts of any size are scored
    without one.
    """
    return (
        F.when(too_large(text, most), "too_large")
        .when(n_words(text) == 0, "no_text")
        .when(n_words(masked_text(text)) < config.MIN_WORDS, "not_enough_text")
        .otherwise("ok")
    )


def retryable(status: Column) -> Column:
    """Whether a later version of the same page may do better: there was too little text yet."""
    return status.isin("no_text", "not_enough_text")


def scan(df: DataFrame, rules: list[Rule] | None = None, most: int | None = None) -> DataFrame:
    """Every document with a status and whether to try again; a score only where the status is ok.

    A text over a caller's limit is never looked at further.
    """
    guarded = df.withColumn("status", scan_status(clean(F.coalesce("text", F.lit(""))), most))
    guarded = guarded.withColumn(
        "text", F.when(F.col("status") == "ok", F.col("text")).otherwise("")
    )
    ok = F.col("status") == "ok"
    rules = default_rules(complete=False) if rules is None else rules
    return scored(guarded, rules).select(
        "doc_id", "status", retryable(F.col("status")).alias("retryable"),
        *[F.when(ok, F.col(c)).alias(c) for c in SCORE_COLUMNS],
    )


def within_limit(df: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Documents within a caller's limit of characters; null texts are within any."""
    return df.filter(F.coalesce(F.length(F.col(text)) <= most, F.lit(True)))
