"""Column functions over text: counting, trimming, spans, snippets, numbers.

All of them are plain Spark expressions.  None needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import patterns as P

# Marks put around matches to find their offsets.  `clean` keeps them out of
# the input by replacing them one for one, so that offsets stay right.
OPEN, CLOSE = "\u0001", "\u0002"

#: Numbers that are summed in one fold, and characters of a piece of text that is looked up by its place.
FOLD_CHUNK = 256
TEXT_CHUNK = 256

SPAN_TYPE = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Inside a lambda an ordinary column may be inlined by the optimizer and then
    be computed once per element; a bound variable is not.
    """
    return F.transform(F.array(value), body)[0]


def empty(array_type: str) -> Column:
    return F.expr(f"cast(array() as {array_type})")


def clean(text: Column) -> Column:
    """The text with the two marker characters replaced, lengths unchanged."""
    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.when(marked, F.translate(text, OPEN + CLOSE, "��")).otherwise(text)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{P.NON_SPACE}++")).cast("int")


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, P.TRIM, "")


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def starts(sizes: Column, first: Column | None = None) -> Column:
    """Where each of consecutive pieces of the given sizes starts.

    Appending to an array copies it, so longer arrays are summed in chunks of fixed
    size and only the sums of the chunks are carried on: the time grows with the
    number of pieces, and not with its square.
    """
    zero = F.lit(0) if first is None else first

    def summed(v, begin):
        return F.aggregate(
            v,
            F.struct(begin.cast("int").alias("pos"), empty("array<int>").alias("out")),
            lambda acc, n: F.struct(
                (acc["pos"] + n).cast("int").alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")
            ),
        )

    def chunked(v):
        last = F.ceil(F.size(v) / FOLD_CHUNK).cast("int") - 1
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: summed(F.slice(v, c * FOLD_CHUNK + 1, F.lit(FOLD_CHUNK)), F.lit(0)))
        moved = lambda c, begin: F.flatten(
            F.transform(c, lambda x, i: F.transform(x["out"], lambda at: at + begin[i]))
        )
        return let(chunks, lambda c: let(summed(F.transform(c, lambda x: x["pos"]), zero)["out"], lambda begin: moved(c, begin)))

    return let(sizes, lambda v: F.when(F.size(v) <= FOLD_CHUNK, summed(v, zero)["out"]).otherwise(chunked(v)))


def _marked_spans(pieces: Column, match_of, length_of, more=lambda p, i: ()) -> Column:
    """Spans from the pieces of a text cut before every match; the first piece has none."""

    def build(p, begin):
        def one(i):
            match, start = match_of(p[i]), begin[i]
            fields = (start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))
            return F.struct(*fields, *more(p, i))

        return F.transform(F.sequence(F.lit(1), F.size(p) - 1), one)

    sizes = lambda p: F.transform(p, lambda x, i: F.length(x) - F.when(i > 0, length_of(x)).otherwise(0))
    return let(
        pieces,
        lambda p: F.when(F.size(p) > 1, let(starts(sizes(p)), lambda begin: build(p, begin))),
    )


def _cut(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN, -1)


def _match(piece: Column) -> Column:
    return F.substring_index(piece, CLOSE, 1)


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern``, left to right, as (start, end, match)."""
    # A piece holds the mark that closes its match.
    found = _marked_spans(_cut(text, pattern), _match, lambda piece: F.lit(1))
    return F.coalesce(found, empty("array<struct<start:int,end:int,match:string>>"))


def spans_with_gaps(text: Column, pattern: str) -> Column:
    """As `spans`, with the text between the neighbouring matches."""

    def gap(piece):
        return F.substring_index(piece, CLOSE, -1)

    def around(p, i):
        # A marker stands for the end of the previous match.
        before = F.when(i == 1, p[0]).otherwise(F.concat(F.lit("*"), gap(p[i - 1])))
        after = F.when(i + 1 < F.size(p), F.concat(gap(p[i]), F.lit("*"))).otherwise(gap(p[i]))
        return before.alias("before"), after.alias("after")

    found = _marked_spans(_cut(text, pattern), _match, lambda piece: F.lit(1), around)
    return F.coalesce(found, empty(SPAN_TYPE))


def literal_spans(text: Column, literal: Column) -> Column:
    """Every non-overlapping occurrence of a literal as (start, end, match)."""
    pieces = F.split(F.replace(text, literal, F.lit(OPEN)), OPEN, -1)
    found = _marked_spans(pieces, lambda piece: literal, lambda piece: -F.length(literal))
    return F.coalesce(found, empty("array<struct<start:int,end:int,match:string>>"))


def text_chunks(text: Column) -> Column:
    """The text in pieces of `TEXT_CHUNK` characters, made in one pass.

    Finding a place in a text means walking there; in this array any place is near
    the start of a piece.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))


def chars_at(chunks: Column, start: Column, n: Column) -> Column:
    """`n` characters from `start` (from 0) of a text in chunks; fewer where it ends."""
    first = F.floor(start / TEXT_CHUNK).cast("int")
    count = F.floor((start + F.greatest(n, F.lit(1)) - 1) / TEXT_CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), start - first * TEXT_CHUNK + 1, n)


def context_around(chunks: Column, length: Column, start: Column, end: Column, width: int) -> Column:
    """The snippet of ``width`` characters around the middle of a span of a text in chunks."""
    mid = F.floor((start + end) / 2).cast("int")
    left = F.greatest(F.lit(0), mid - width // 2)
    right = F.least(length, mid + width // 2)
    return F.concat(
        F.when(left > 0, "...").otherwise(""),
        F.replace(chars_at(chunks, left, right - left), F.lit("\n"), F.lit(" ")),
        F.when(right < length, "...").otherwise(""),
    )


def preview(sentence: Column) -> Column:
    """A quoted sentence, cut after 80 characters."""
    cut = F.when(
        F.length(sentence) > 80, F.concat(F.substring(sentence, 1, 80), F.lit("..."))
    ).otherwise(sentence)
    return F.concat(F.lit('"'), cut, F.lit('"'))


def round_to(value: Column, digits: int) -> Column:
    """Round half to even in binary arithmetic."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def fmt_fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_to(value, digits))


def fmt_percent(value: Column) -> Column:
    return F.concat(F.rint(value * 100).cast("int").cast("string"), F.lit("%"))


def fmt_number(value: Column) -> Column:
    """A number with at most two decimals and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", value), "\\.?0+$", "")


def population_cv(values: Column) -> Column:
    """Mean and population coefficient of variation of a non-empty int array."""

    def measure(v):
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return let(
            total / F.size(v),
            lambda mean: F.struct(
                mean.alias("mean"),
                F.when(
                    mean > 0,
                    F.sqrt(
                        F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v)
                    )
                    / mean,
                ).alias("cv"),
            ),
        )

    return F.when(F.size(values) > 0, let(values, measure))
