"""Text views: columns of a document, and the same views as long tables.

A document is one row and everything below is computed inside that row, so no
view shuffles.  The long tables carry the key, never the text.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import patterns as P
from prosegauge.functions.text import CLOSE, OPEN, clean, empty, let, n_words, spans, starts, text_chunks, trim_ws


#: Pieces of texts whose words are counted together: what a worker holds does not grow with its batch.
WORD_PIECES = 1 << 16


# --- code --------------------------------------------------------------------
def has_code(text: Column) -> Column:
    return F.contains(text, F.lit("`"))


def masked_text(text: Column) -> Column:
    """Code replaced by blanks; newlines and length are kept."""
    marked = F.regexp_replace(clean(text), P.CODE, f"$1{OPEN}$2$4{CLOSE}")
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    blanked = F.transform(
        pieces,
        lambda piece, i: F.when(i % 2 == 1, F.regexp_replace(piece, "[^\\n]", " ")).otherwise(piece),
    )
    return F.when(has_code(text), F.array_join(blanked, "")).otherwise(text)


def code_spans(text: Column) -> Column:
    """Code spans as (start, end, fenced)."""
    # The indent before a fence is outside its span.
    marked = F.regexp_replace(clean(text), P.CODE, f"$1{OPEN}$2$4{CLOSE}")
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    out_type = "array<struct<start:int,end:int,fenced:boolean>>"

    def one(p, begin, i):
        # What stands before the piece on its line; a piece of code before it counts as something.
        after_code = F.when(i < 2, "").when(p[i - 2].endswith("\n"), "").otherwise("`")
        head = F.concat(after_code, p[i - 1])
        return F.struct(
            begin[i].alias("start"),
            (begin[i] + F.length(p[i])).alias("end"),
            (p[i].startswith("```") & head.rlike("(?:\\A|\\n)[ \\t]{0,3}\\z")).alias("fenced"),
        )

    def build(p):
        # Every second piece is code.
        code = F.sequence(F.lit(1), F.size(p) - 1, F.lit(2))
        found = let(starts(F.transform(p, F.length)), lambda begin: F.transform(code, lambda i: one(p, begin, i)))
        return F.when(F.size(p) > 1, found).otherwise(empty(out_type))

    return F.when(has_code(text), let(pieces, build)).otherwise(empty(out_type))


def text_no_fences(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, P.FENCE, "$1")).otherwise(text)


def fence_breaks(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("```")), F.regexp_replace(text, P.FENCE, "$1\n.\n")
    ).otherwise(text)


def _table_code(line: Column) -> Column:
    def classify(cells):
        return (
            F.when(~F.contains(cells, F.lit("|")), "x")
            .when(cells.rlike(P.TABLE_DELIMITER), "d")
            .when(cells.rlike(P.CELL_TEXT), "r")
            .otherwise("x")
        )

    return F.when(
        F.contains(line, F.lit("|")),
        let(F.regexp_replace(trim_ws(line), P.OUTER_PIPES, ""), classify),
    ).otherwise("x")


def collapse_tables(text: Column) -> Column:
    """Every pipe table becomes one line holding a full stop.

    Each line gets a letter (d delimiter, r other row, x neither); a table is
    then a run of letters, and the lines are cut at the runs.
    """

    def rebuild(lines):
        codes = F.array_join(F.transform(lines, _table_code), "")
        runs = F.split(
            F.regexp_replace(codes, "[rd]d[rd]*", f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1
        )
        def keep(run, i, begin):
            return F.when(i % 2 == 1, F.array(F.lit("."))).otherwise(F.slice(lines, begin[i] + 1, F.length(run)))

        kept = let(
            runs,
            lambda r: let(starts(F.transform(r, F.length)), lambda begin: F.flatten(F.transform(r, lambda run, i: keep(run, i, begin)))),
        )
        return F.array_join(kept, "\n")

    # A delimiter line holds a pipe and three dashes.
    possible = F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))
    return F.when(possible, let(F.split(text, "\n", -1), rebuild)).otherwise(text)


# --- sentences, paragraphs, lines, tokens --------------------------------------
def sentence_array(text: Column) -> Column:
    """Sentences as (s, w, i): the untrimmed text, its word count, its place among the pieces between ends."""
    return sentences_of(F.split(text, P.SENTENCE_END, -1), lambda s, i: n_words(s))


def sentences_of(pieces: Column, words) -> Column:
    """Those of the pieces between ends that hold words, see `sentence_array`."""
    return F.filter(
        F.transform(pieces, lambda s, i: F.struct(s.alias("s"), words(s, i).alias("w"), i.alias("i"))),
        lambda s: s["w"] > 0,
    )


def words_each(pieces: Column) -> Column:
    """The number of words of each of an array of texts, none for null.

    As `n_words` of each, but counted over the bytes of a whole Arrow batch at once, not by
    making every word.
    """

    together = WORD_PIECES

    # Inside, so that workers get them with the column and need not find this package.
    def count(pieces):
        import numpy as np
        import pyarrow as pa

        texts = pieces.flatten().cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]

        space = (data == 32) | ((data >= 9) & (data <= 13))
        # White space beyond ASCII: the no-break space has two bytes, any other three.
        wide = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            after = np.append(data, np.zeros(2, np.uint8))
            two = after[lead].astype(np.int32) << 8 | after[lead + 1]
            no_break = lead[two == 0xC2A0]
            space[no_break] = space[no_break + 1] = True
            three = lead[np.isin(two << 8 | after[lead + 2], [int.from_bytes(chr(c).encode()) for c in wide])]
            for k in range(3):
                space[three + k] = True

        begins = ~space
        begins[1:] &= space[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = ~space[first]
        return np.diff(np.searchsorted(np.flatnonzero(begins), at))

    def counts(pieces):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // together)) + 1).tolist(), len(pieces)]
        words = np.concatenate([count(pieces.slice(a, b - a)) for a, b in pairwise(cuts)])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(words, pa.int32()))

    return F.when(pieces.isNotNull(), F.arrow_udf(counts, "array<int>")(pieces))


def paragraph_words(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, P.PARAGRAPH_BREAK, -1), n_words), lambda w: w > 0)


def line_code(line: Column) -> Column:
    """One letter for what a line is: T bold-term bullet, b other bullet,
    q quote, f code toggle, h divider, e blank, x anything else."""
    return F.when(
        line.rlike(P.MARKED_LINE),
        F.when(line.rlike(P.BOLD_BULLET), "T")
        .when(line.rlike(P.BULLET), "b")
        .when(line.startswith(">"), "q")
        .when(line.rlike(P.CODE_TOGGLE), "f")
        .when(line.rlike(P.RULE_LINE), "h")
        .when(line.rlike(P.BLANK), "e")
        .otherwise("x"),
    ).otherwise("x")


def line_codes(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), line_code), "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{P.WORD}+"), F.lit(0))


def ngram_tokens(text: Column) -> Column:
    """Tokens between white space without their non-word edges, in lower case."""
    stripped = F.lower(F.regexp_replace(text, P.TOKEN_EDGES, ""))
    # Lowering first is the same, and faster, but where a letter becomes two or a space is no end of a word.
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\ufeff"))
    return F.when(odd, F.array_remove(F.split(stripped, f"{P.SPACE}+", -1), "")).otherwise(
        F.regexp_extract_all(F.lower(text), F.lit(P.TOKEN_CORE), F.lit(0))
    )


# --- the columns the rules read ------------------------------------------------
def with_views(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add the columns every rule reads.

    The views are separate projections: each is read more than once further
    up, so the optimizer keeps them and computes each once per document.
    """
    base = df.withColumn("text", clean(F.col(text)))
    pieces, paragraphs = F.split("text", P.SENTENCE_END, -1), F.split("text", P.PARAGRAPH_BREAK, -1)
    base = base.withColumns({"_pieces": pieces, "_paragraphs": paragraphs})
    counted = F.struct(F.col("_pieces").alias("p"), words_each(F.col("_pieces")).alias("w"))
    base = base.withColumns(
        {
            "text_len": F.length("text"),
            "chunks": text_chunks(F.col("text")),
            "lower": F.lower("text"),
            "masked": masked_text(F.col("text")),
            "unfenced": text_no_fences(F.col("text")),
            "sents": let(counted, lambda c: sentences_of(c["p"], lambda s, i: c["w"][i])),
            "paras": let(words_each(F.col("_paragraphs")), lambda words: F.filter(words, lambda w: w > 0)),
            "codes": line_codes(F.col("text")),
        }
    ).drop("_pieces", "_paragraphs")
    return base.withColumns(
        {
            "lower_masked": F.lower("masked"),
            # Without code the masked text is the text, whose words are those of its paragraphs.
            "word_count": F.when(has_code(F.col("text")), n_words(F.col("masked"))).otherwise(
                F.aggregate("paras", F.lit(0), lambda a, w: a + w)
            ),
            "n_sents": F.size("sents"),
        }
    )


# --- long tables ---------------------------------------------------------------
def lines(df: DataFrame) -> DataFrame:
    """One row per line with its flags and its start offset."""
    def build(ls):
        sizes = F.transform(ls, lambda line: F.length(line) + 1)
        return let(
            starts(sizes),
            lambda begin: F.transform(ls, lambda line, i: F.struct(begin[i].alias("line_start"), line.alias("line"))),
        )

    exploded = df.select(
        "doc_id", F.posexplode(let(F.split("text", "\n", -1), build)).alias("line_no", "l")
    ).select("doc_id", "line_no", "l.line_start", "l.line")
    line = F.col("line")
    toggle = line.rlike(P.CODE_TOGGLE)
    return exploded.select(
        "doc_id",
        "line_no",
        "line_start",
        "line",
        line.rlike(P.BLANK).alias("is_blank"),
        line.rlike(P.BULLET).alias("is_bullet"),
        line.rlike(P.BOLD_BULLET).alias("is_bold_bullet"),
        line.startswith(">").alias("is_quote"),
        line.rlike(P.HEADING).alias("is_heading"),
        line.rlike(P.RULE_LINE).alias("is_hr"),
        toggle.alias("is_code_toggle"),
    )


def sentences(df: DataFrame, text: Column | None = None) -> DataFrame:
    source = F.col("text") if text is None else text
    return df.select("doc_id", F.posexplode(sentence_array(source)).alias("sent_no", "x")).select(
        "doc_id", "sent_no", trim_ws(F.col("x.s")).alias("sentence"), F.col("x.w").alias("n_words")
    )


def long_sentences(df: DataFrame) -> DataFrame:
    """Sentences of the text with fences and tables turned into full stops."""
    return sentences(df, collapse_tables(fence_breaks(F.col("text"))))


def paragraphs(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(paragraph_words(F.col("text"))).alias("para_no", "n_words"))


def tokens(df: DataFrame, masked: bool = False) -> DataFrame:
    source = masked_text(F.col("text")) if masked else F.col("text")
    return df.select("doc_id", F.posexplode(word_tokens(source)).alias("pos", "token"))


def ngram_token_table(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(ngram_tokens(F.col("text"))).alias("pos", "token"))


def match_spans(df: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Matches of any pattern with their offsets, one row each."""
    found = F.when(F.col(column).rlike(pattern), spans(clean(F.col(column)), pattern))
    return df.select("doc_id", F.explode(found).alias("m")).select(
        "doc_id", F.col("m.start"), F.col("m.end"), F.col("m.match")
    )
