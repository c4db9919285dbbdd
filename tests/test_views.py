"""Text views on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import patterns as P
from prosegauge.functions.text import (
    chars_at, context_around, fmt_fixed, fmt_number, fmt_percent, literal_spans, n_words, round_to, spans, starts, text_chunks,
)
from prosegauge.operators import views as V


def evaluate(spark, texts, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in df.select("doc_id", *columns).orderBy("doc_id").collect()]


FENCES = {
    "a\n```\nx\n```\nb": ("a\n   \n \n   \nb", "a\nb"),
    "a\n```py\nx": ("a\n     \n ", "a\n"),
    "a\n```": ("a\n   ", "a\n"),
    "a\n```\nx\n`````\nb": ("a\n   \n \n     \nb", "a\nb"),
    "a\n````\n```\n````\nb": ("a\n    \n   \n    \nb", "a\nb"),
    "a\n``` x`y\nz\n```\nb": ("a\n       \n \n   \nb", "a\nb"),
    "a\n  ```\nx\n  ```\nb": ("a\n     \n \n     \nb", "a\n  b"),
    "a\n    ```\nb": ("a\n    ```\nb", "a\n    ```\nb"),
    "a `b` c ``d ` e`` f": ("a     c           f", "a `b` c ``d ` e`` f"),
    "a `b\nc` d": ("a `b\nc` d", "a `b\nc` d"),
    "a ``b` c": ("a ``b` c", "a ``b` c"),
    "plain": ("plain", "plain"),
}


def test_code_is_masked_and_removed(spark):
    got = evaluate(
        spark, FENCES, V.masked_text(F.col("text")), V.text_no_fences(F.col("text"))
    )
    assert dict(zip(FENCES, got)) == FENCES


def test_code_spans(spark):
    got = evaluate(spark, ["x `a` y\n```\nb\n```\nz", "  ```\nq"], V.code_spans(F.col("text")))
    assert [[tuple(s) for s in row[0]] for row in got] == [[(2, 5, False), (8, 18, True)], [(2, 7, True)]]


def test_tables_collapse(spark):
    texts = [
        "h\n| a | b |\n|---|---|\n| 1 | 2 |\nt",
        "| a |\n| --- |\nx",
        "a | b\n--- | ---\n",
        "| a | b |\nx\n| --- | --- |",
        "| a | b |\n| -- | --- |",
        "|---|---|\n|---|---|\n|x|y|\nend",
    ]
    got = [r[0] for r in evaluate(spark, texts, V.collapse_tables(F.col("text")))]
    assert got == ["h\n.\nt", texts[1], ".\n", texts[3], texts[4], ".\nend"]


def test_sentences_and_words(spark):
    df = spark.createDataFrame(
        [(1, 'One two. "Three!" Four? (five.) six... seven'), (2, " . ! "), (3, "a b c​d")],
        "doc_id long, text string",
    )
    rows = V.sentences(df).orderBy("doc_id", "sent_no").collect()
    assert [(r.doc_id, r.sentence, r.n_words) for r in rows if r.doc_id == 1] == [
        (1, "One two", 2), (1, '"Three', 1), (1, "Four", 1), (1, "(five", 1), (1, "six..", 1), (1, "seven", 1),
    ]
    assert not [r for r in rows if r.doc_id == 2]
    assert df.select(n_words(F.col("text")).alias("n")).collect()[2].n == 3


def test_line_codes(spark):
    text = "- a\n* b\n1. c\n2) d\n- **t** x\n> q\n```\n---\n***\n\n  \nplain\n-x\n1.y"
    assert evaluate(spark, [text], V.line_codes(F.col("text")))[0][0] == "bbbbTqfhheexxx"


def test_tokens(spark):
    text = "It's (the) --dash-- naïve_x «Q» 42 --"
    got = evaluate(spark, [text], V.word_tokens(F.col("text")), V.ngram_tokens(F.col("text")))[0]
    assert got[0] == ["it", "s", "the", "dash", "naïve_x", "q", "42"]
    assert got[1] == ["it's", "the", "dash", "naïve_x", "q", "42"]


def test_tokens_of_odd_texts(spark):
    """Tokens are what stripping their edges and lowering leaves, whatever their letters do."""
    texts = [
        "", " \n", "--", "a", "--A--", "«É» ÉCOLE… ΟΔΟΣ. ΟΔΟΣ.Α 'Σ Σ'", "DİL.İ Aİ İ", "ΣΑΣ\ufeffΑ \ufeffΒΣ\ufeff",
        "x\x85y \x85z\x85", "a\u0301 \u0301b", "Ⅷ, ⓐ ²x² _a_ 😀b😀", "a\u2028b\u00a0c\td",
    ]
    stripped = F.lower(F.regexp_replace("text", P.TOKEN_EDGES, ""))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    rows = df.select(
        "text", V.ngram_tokens(F.col("text")).alias("got"), F.array_remove(F.split(stripped, f"{P.SPACE}+", -1), "").alias("want")
    ).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert rows[4].got == ["a"] and rows[-1].got is None


def test_offsets_count_code_points(spark):
    text = "é😀 ab 😀ab\nab"
    got = evaluate(spark, [text], spans(F.col("text"), "ab"), literal_spans(F.col("text"), F.lit("ab")))[0]
    expected = [(3, 5, "ab"), (7, 9, "ab"), (10, 12, "ab")]
    assert [tuple(s) for s in got[0]] == [tuple(s) for s in got[1]] == expected


def test_snippet(spark):
    text = "x" * 40 + "\nHIT " + "y" * 40
    got = evaluate(
        spark, [text, "short HIT"], context_around(text_chunks(F.col("text")), F.length("text"), F.lit(41), F.lit(44), 60)
    )
    assert got[0][0] == "..." + (text[12:72]).replace("\n", " ") + "..."
    assert got[1][0].startswith("...") or got[1][0] == "short HIT"


@pytest.mark.parametrize(
    "value,digits,expected", [(0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (3.5, 0, 4.0), (-0.5, 0, 0.0)]
)
def test_half_even(spark, value, digits, expected):
    assert spark.range(1).select(round_to(F.lit(value), digits)).first()[0] == expected


def test_number_formats(spark):
    row = spark.range(1).select(
        fmt_fixed(F.lit(0.125), 2), fmt_percent(F.lit(0.565)), fmt_number(F.lit(30.0)), fmt_number(F.lit(0.5)),
        fmt_number(F.lit(100.0)), fmt_number(F.lit(0.0)), fmt_number(F.lit(1234.56)),
    ).first()
    assert list(row) == ["0.12", "56%", "30", "0.5", "100", "0", "1234.56"]


@pytest.mark.parametrize("at,n", [(0, 1), (0, 256), (250, 12), (255, 1), (256, 1), (256, 256), (200, 700), (995, 50), (5000, 3)])
def test_characters_by_place(spark, at, n):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) if i % 5 else "\n" for i in range(1000))
    assert evaluate(spark, [text], chars_at(text_chunks(F.col("text")), F.lit(at), F.lit(n))) == [(text[at : at + n],)]


def test_starts(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        sizes = [i % 11 for i in range(n)]
        got = spark.range(1).select(starts(F.lit(sizes).cast("array<int>"), F.lit(3))).first()[0]
        assert got == [3 + sum(sizes[:i]) for i in range(n)]


def seconds(spark, column, text):
    """The least of three runs over one row."""
    import time

    df = spark.createDataFrame([(text,)], "text string").cache()
    df.count()
    out = []
    for _ in range(3):
        start = time.perf_counter()
        df.select(column).write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return min(out)


@pytest.mark.parametrize("name", ["code", "tables", "lines", "spans"])
def test_time_grows_with_the_pieces_of_one_text(spark, name):
    piece, column = {
        "code": ("a `b` c\n", V.code_spans(F.col("text"))),
        "tables": ("| a | b |\n| --- | --- |\nx\n", V.collapse_tables(F.col("text"))),
        "lines": ("line\n", starts(F.transform(F.split("text", "\n"), F.length))),
        "spans": ("ab cd ", spans(F.col("text"), "ab")),
    }[name]
    few, many = (seconds(spark, column, piece * n) for n in (16_000, 64_000))
    assert many < 8 * few + 0.5  # four times, with room; sixteen times if it grew with the square


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 513])
def test_spans_of_many_matches_keep_their_places(spark, n):
    [(marked, literal)] = evaluate(
        spark, ["ab cdef " * n], spans(F.col("text"), "ab"), literal_spans(F.col("text"), F.lit("cd"))
    )
    assert [(s.start, s.end, s.match) for s in marked] == [(8 * k, 8 * k + 2, "ab") for k in range(n)]
    assert [(s.start, s.end) for s in literal] == [(8 * k + 3, 8 * k + 5) for k in range(n)]


def test_words_of_pieces_are_counted_in_arrow_batches(spark, monkeypatch):
    monkeypatch.setattr(V, "WORD_PIECES", 3)
    spaces = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    others = "\x1c\x1f\x85\u180e\u200b\u2060\u00e9\U0001d518-"
    texts = ["", " ", "a", " a  b|c |d", "|".join(f"a{c}b {c}" for c in spaces + others), "\u00e9|\xa0|\u3000x\u3000|", None, "z|" * 9]
    pieces = F.split("text", "\\|", -1)
    for one, each in evaluate(spark, texts, F.transform(pieces, n_words), V.words_each(pieces)):
        assert one == each


def test_documents_are_dealt_out_by_the_size_of_their_table(spark, sf_dir, monkeypatch):
    """Whatever the number of files and row groups, tasks are of one size."""
    from prosegauge.catalog import fixtures
    from prosegauge.sources import tables

    cores, small = spark.sparkContext.defaultParallelism, fixtures.documents_of(spark, sf_dir)
    assert small.rdd.getNumPartitions() == 2 * cores
    monkeypatch.setattr(fixtures, "DOCUMENT_BYTES", 2000)
    many = fixtures.documents_of(spark, sf_dir)
    size = tables.table_bytes(spark, sf_dir, "documents")
    assert many.rdd.getNumPartitions() == cores * -(-size // (2000 * cores)) > 2 * cores
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, small.collect()))
