"""The report: signals, severities, top hits and advice, labels, indicator.

A document's hits stand in its row, so grouping, ranking and cutting them are
array expressions there: nothing here is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.text import fmt_number, let
from prosegauge.operators.lexical import scored_only
from prosegauge.plans.rules import Rule
from prosegauge.plans.scoring import hit_array

# Sizes and shares of the report.
ADVICE_SHOWN = 5
HITS_SHOWN = 12
PAINTED = 200  # what a page can show; a table of hits need not stop there
CRITICAL_SHARE = 0.25
HIGH_SHARE = 0.1

# What the report calls bands and rules.
BAND_BLURBS = {
    "clean": "Reads like a person wrote it.",
    "light": "A few tells, nothing damning.",
    "moderate": "Recognisable model cadence.",
    "heavy": "Heavy formulaic patterning.",
    "saturated": "Dense with generated-text tells.",
}
RULE_LABELS = {
    "slop_word": "Overused vocabulary",
    "slop_phrase": "Stock phrases",
    "structural": "Listicle structure",
    "tone": "Assistant tone",
    "weasel": "Unattributed claims",
    "ai_disclosure": "AI self-disclosure",
    "placeholder": "Unfinished placeholders",
    "rhythm": "Uniform sentence rhythm",
    "em_dash": "Em-dash density",
    "contrast_pair": "Contrast constructions",
    "intrasentence_keyword_bold": "Mid-sentence bold",
    "setup_resolution": "Setup-and-resolution tic",
    "colon_density": "Elaboration colons",
    "pithy_fragment": "Pithy fragments",
    "bullet_density": "Bullet dominance",
    "blockquote_density": "Blockquote overuse",
    "bold_bullet_list": "Bold-term bullet runs",
    "horizontal_rules": "Divider overuse",
    "phrase_reuse": "Repeated phrasing",
    "copula_chain": "“X is Y” chains",
    "extreme_sentence": "Run-on sentences",
    "closing_aphorism": "Moralising close",
    "paragraph_balance": "Uniform paragraph sizes",
    "paragraph_cv": "Uniform paragraph rhythm",
}
# Indicator colours.
BAND_COLOURS = {
    "clean": "#3FB950",
    "light": "#58A6FF",
    "moderate": "#D29922",
    "heavy": "#DB6D28",
    "saturated": "#F85149",
}
BADGE_TEXT_COLOUR = "#0D1117"


def rule_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULE_LABELS.items()), "rule string, label string")


def band_blurbs(spark: SparkSession) -> DataFrame:
    rows = [(b, t, BAND_COLOURS[b]) for b, t in BAND_BLURBS.items()]
    return spark.createDataFrame(rows, "band string, blurb string, colour string")


def signal_array(rules: list[Rule]) -> Column:
    """The rules that hit a document, heaviest first; ties keep the rule order.

    `weight` and `hits` are those of scored hits, `found` counts all.  Grouping and
    order are made in the row of the document, where its hits are.
    """

    def one(rule: Rule, order: int) -> Column:
        found = F.col(f"hits_{rule.count_key}")
        return let(
            scored_only(found),
            lambda h: F.struct(
                (-F.aggregate(h, F.lit(0), lambda a, x: a + F.abs(x["penalty"]))).alias("less_weight"),
                (-F.size(h)).alias("less_hits"),
                F.lit(order).alias("order"),
                F.lit(rule.name).alias("rule"),
                F.size(found).alias("found"),
            ),
        )

    some = F.filter(F.array(*[one(rule, i) for i, rule in enumerate(rules)]), lambda s: s["found"] > 0)
    return F.transform(
        F.sort_array(some),
        lambda s, i: F.struct(
            s["rule"].alias("rule"), (-s["less_weight"]).alias("weight"), (-s["less_hits"]).alias("hits"),
            s["found"].alias("found"), (i + 1).alias("rank"),
        ),
    )


def signals(rows: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """One row per document and signal, from rows of `scoring.scored`."""
    return rows.select("doc_id", *keep, F.explode(signal_array(rules)).alias("s")).select("doc_id", *keep, "s.*")


def severity_of(share: Column) -> Column:
    return F.when(share >= CRITICAL_SHARE, "critical").when(share >= HIGH_SHARE, "high").otherwise("moderate")


def severity(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Signals with their share of their document's weight and a severity."""

    def shares(found):
        total = F.aggregate(found, F.lit(0), lambda a, s: a + s["weight"])
        return let(
            F.when(total == 0, 1).otherwise(total),
            lambda t: F.transform(found, lambda s: s.withField("share", s["weight"] / t)),
        )

    out = rows.select("doc_id", F.explode(let(signal_array(rules), shares)).alias("s")).select("doc_id", "s.*")
    return out.withColumn("severity", severity_of(F.col("share")))


def with_labels(df: DataFrame) -> DataFrame:
    """Add the readable rule name; an unknown rule keeps its own."""
    labels = F.broadcast(rule_labels(df.sparkSession))
    return df.join(labels, "rule", "left").withColumn("label", F.coalesce("label", "rule"))


def top_hits(rows: DataFrame, rules: list[Rule], n: int = HITS_SHOWN) -> DataFrame:
    """The first hits of each rule and document with their `rank`, cut in the row."""

    def first(rule: Rule, order: int, before: Column) -> Column:
        def one(h, i):
            named = F.lit(rule.name).alias("rule"), F.lit(order).alias("rule_order")
            return F.struct((before + i).alias("seq"), *named, (i + 1).alias("rank"), h.alias("h"))

        return F.transform(F.slice(f"hits_{rule.count_key}", 1, n), one)

    # Numbered as in all hits: after those of the rules before.
    shown, before = [], F.lit(0)
    for order, rule in enumerate(rules):
        shown.append(first(rule, order, before))
        before = before + F.size(f"hits_{rule.count_key}")
    out = rows.select("doc_id", F.explode(F.concat(*shown)).alias("t"))
    return out.select("doc_id", "t.seq", "t.rule", "t.rule_order", "t.rank", "t.h.*")


def top_advice(analysis: DataFrame, n: int = ADVICE_SHOWN) -> DataFrame:
    """The first advice lines of each document, or one saying there are none.

    Reads the advice array of analysis rows, so it needs no join or window.
    """
    shown = F.when(F.size("advice") > 0, F.slice("advice", 1, n)).otherwise(
        F.array(F.lit("Nothing flagged."))
    )
    return analysis.select("doc_id", F.posexplode(shown).alias("i", "line")).select(
        "doc_id", (F.col("i") + 1).alias("rank"), "line"
    )


def readable(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))


def hit_label(match: Column, context: Column) -> Column:
    """A quote with its context where the context holds it, else the context."""
    quoted = F.concat(F.lit("“"), readable(match), F.lit("” "), readable(context))
    return F.when(F.contains(context, match), quoted).otherwise(readable(context))


def meta_line(words: Column, signal_count: Column, density: Column, subject: Column | None = None) -> Column:
    first = F.concat(words.cast("string"), F.lit(" words"))
    if subject is not None:
        first = F.concat(first, F.coalesce(F.concat(F.lit(" in "), subject), F.lit("")))
    plural = F.when(signal_count == 1, " signal").otherwise(" signals")
    return F.concat_ws(
        "  ·  ",
        first,
        F.concat(signal_count.cast("string"), plural),
        F.concat(fmt_number(density), F.lit(" penalty per 1k words")),
    )


def rail_at(slop: Column) -> Column:
    """Where the marker stands, kept inside the scale."""
    return F.least(F.lit(99), F.greatest(F.lit(1), slop))


def paintable(rows: DataFrame, rules: list[Rule], most: int | None = None) -> DataFrame:
    """Hits that point at a passage; `most` keeps those among the first so many of a document."""
    hits = F.transform(hit_array(rules), lambda h, i: h.withField("seq", i))
    hits = hits if most is None else F.slice(hits, 1, most)
    whole = lambda h: (h["start"] == 0) & (h["end"] == F.col("text_len"))
    return rows.select("doc_id", F.explode(F.filter(hits, lambda h: ~whole(h))).alias("h")).select("doc_id", "h.*")


@dataclass(frozen=True)
class Settings:
    """What the indicator shows.  Defaults are fixed values."""

    badge: bool = True
    tint_icon: bool = True
    auto_scan: bool = False


def indicator(readings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What the toolbar shows for each reading under the given settings.

    Without a reading (null band), or with a part switched off, it is blank.
    """
    colours = F.create_map(*[F.lit(x) for pair in BAND_COLOURS.items() for x in pair])
    has = F.col("band").isNotNull()
    badge = F.lit(settings.badge) & has
    return readings.select(
        *readings.columns,
        F.when(F.lit(settings.tint_icon) & has, F.col("band")).alias("icon_band"),
        F.when(badge, F.col("slop").cast("string")).otherwise("").alias("badge_text"),
        F.when(badge, F.try_element_at(colours, F.col("band"))).alias("badge_colour"),
        F.when(badge, BADGE_TEXT_COLOUR).alias("badge_text_colour"),
    )


def apply_everywhere(keys: DataFrame, readings: DataFrame, settings: Settings) -> DataFrame:
    """Every open key with its reading under new settings; others are cleared."""
    return indicator(keys.join(readings, "key", "left"), settings)
