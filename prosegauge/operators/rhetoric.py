"""Detectors of sentence-level patterns: triads, contrasts, bold, colons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import patterns as P
from prosegauge.functions.text import (
    chars_at, empty, let, literal_spans, n_matches, spans, spans_with_gaps, trim_ws,
)
from prosegauge.operators.lexical import SPANS, _has, gated_spans


def bold_headers() -> Column:
    return F.when(_has("**"), n_matches(F.col("text"), P.BOLD_HEADER)).otherwise(0)


def triad_spans() -> Column:
    return gated_spans(F.col("text"), P.TRIAD, _has(", and "))


def contrasts() -> Column:
    """Both contrast forms as (start, end, kind, match), in text order."""
    plain = gated_spans(F.col("text"), P.X_NOT_Y, F.contains(F.col("text"), F.lit(", not ")))
    staged = gated_spans(
        F.col("text"),
        P.STAGED,
        (_has("not only") | _has("not just") | _has("not merely")) & _has("but"),
    )

    def shape(kind, label):
        return lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            label(s["match"]).alias("match"),
        )

    return F.sort_array(
        F.concat(
            F.transform(plain, shape("x_not_y", lambda m: m)),
            F.transform(staged, shape("staged_contrast", trim_ws)),
        )
    )


def keyword_bolds(max_words: int) -> Column:
    """Bold spans inside running prose, after all exclusions."""

    def inner(s):
        return F.substring(s["match"], F.lit(3), F.length(s["match"]) - 4)

    def is_label(s):
        return (inner(s).endswith(":") | inner(s).endswith(".")) & s["after"].rlike(
            f"\\A{P.SPACE}+{P.NON_SPACE}"
        )

    def survives(s):
        return ~(
            is_label(s)
            | inner(s).rlike(P.NUMERIC_BOLD)
            | (n_matches(inner(s), f"{P.WORD}+") > max_words)
            | s["before"].rlike(P.OPENING_POSITION)
        )

    # On headings, quotes and items nothing is found: their asterisks are blotted out, one for one.
    prose = let(
        F.split(F.col("text"), "\n", -1),
        lambda lines: F.array_join(
            F.transform(
                F.split(F.col("masked"), "\n", -1),
                lambda line, i: F.when(lines[i].rlike(P.EXCLUDED_LINE), F.translate(line, "*", "x")).otherwise(line),
            ),
            "\n",
        ),
    )
    found = F.transform(
        F.filter(spans_with_gaps(prose, P.BOLD_SPAN), survives),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            chars_at(F.col("chunks"), s["start"], s["end"] - s["start"]).alias("match"),
        ),
    )
    return F.when(_has("**"), found).otherwise(empty(SPANS))


def setups() -> Column:
    """Both setup-and-resolution forms; a span found by both counts once."""
    text = F.col("text")
    gate = (F.contains("lower", F.lit("not")) | F.contains("lower", F.lit("n't"))) & F.col("lower").rlike(P.NEGATION_TOKEN)
    key = lambda s: s["start"].cast("bigint") * F.lit(1 << 32) + s["end"]

    def merge(c):
        extra = F.array_except(F.transform(c["second"], key), F.transform(c["first"], key))
        return F.concat(
            c["first"],
            F.transform(
                extra,
                lambda k: let(
                    F.struct(
                        F.shiftright(k, 32).cast("int").alias("start"),
                        (k % F.lit(1 << 32)).cast("int").alias("end"),
                    ),
                    lambda s: F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        chars_at(F.col("chunks"), s["start"], s["end"] - s["start"]).alias("match"),
                    ),
                ),
            ),
        )

    both = F.struct(
        spans(text, P.SETUP_NEGATED).alias("first"), spans(text, P.SETUP_NOT).alias("second")
    )
    return F.when(gate, let(both, merge)).otherwise(empty(SPANS))


def elaboration_colons() -> Column:
    """Colons before a lower-case word, outside headings, links and data."""
    prose = F.regexp_replace(F.col("unfenced"), P.HEADING_LINES, "")
    return F.when(
        F.contains(F.col("unfenced"), F.lit(": ")), n_matches(prose, P.ELABORATION_COLON)
    ).otherwise(0)


def pithy_sentences(max_words: int) -> Column:
    """Short sentences that turn on a conjunction after a comma, as (s, i, indent).

    `s` is trimmed, `i` is the place of the sentence among the pieces between ends
    of sentences, and `indent` what was trimmed from its start.
    """
    return F.transform(
        F.filter(F.col("sents"), lambda x: (x["w"] <= max_words) & x["s"].rlike(P.PITHY_PIVOT)),
        lambda x: F.struct(
            trim_ws(x["s"]).alias("s"),
            x["i"].alias("i"),
            (F.length(x["s"]) - F.length(F.regexp_replace(x["s"], f"\\A{P.SPACE}+", ""))).alias("indent"),
        ),
    )


def sentence_ends() -> Column:
    """Where each end of a sentence is over, in order."""
    return F.transform(spans(F.col("text"), P.SENTENCE_END), lambda s: s["end"])


def nth_occurrence(lower: Column, literal: Column, n: Column) -> Column:
    """The n-th (from 0) occurrence of a literal as a span, else the first."""
    return let(literal_spans(lower, literal), lambda f: F.coalesce(F.get(f, n), F.get(f, F.lit(0))))


def first_occurrence(lower: Column, literal: Column) -> Column:
    """Where a literal of lower-case text first stands, or null.

    A quoted pattern is searched several times faster than a string; lower-case text
    has no capital that could end the quote.
    """
    quoted = F.concat(F.lit("\\Q"), literal, F.lit("\\E"))
    return let(F.split(lower, quoted, 2), lambda p: F.when(F.size(p) > 1, F.length(p[0])))
