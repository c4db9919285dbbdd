"""Phrases against brute force: nulls, blanks, repeats, ties, clashing columns, common prefixes, full sketches."""

import random
import re
from collections import Counter

import pytest

from prosegauge.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, rank long, a string"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["the"] * 10 + ["É", "\x1cq", "x" * 5000]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "; "]) for _ in range(n))
    rows = [prose(rng.randrange(0, 60)) for _ in range(120)] + [None, "", " \t", ".;!", "New York City. " * 30, "new york " * 12, "THE THE the " * 40, prose(9000)]
    return [(i if i % 9 else None, t, [None, "en", "de", "und"][i % 4], "clash", 1, "x") for i, t in enumerate(rows)] * 2


def expected(rows, least=C.LEAST, share=C.SHARE, top=C.TOP):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            if any(len(o) > len(phrase) and n >= least and 100 * n >= share * a and phrase in (o[:2], o[1:]) for o, n in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rows = texts()
    assert rows_of(C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts))) == expected(rows)


def test_other_limits_and_small_blocks(spark):
    """Blocks of a row, stripes handed on often, batches that cut stripes: the same rows."""
    rows, limits = texts(), C.Limits(block_bytes=64, held_entries=300, rows_at_once=9, merged_bytes=50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows_of(C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), top=40, least=3, share=80, limits=limits))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(rows, 3, 80, 40)


@pytest.mark.parametrize("share", [0.001, 2])
def test_cut_and_whole_stripes(spark, monkeypatch, share):
    """Stripes of common words in many segments, or none cut: the same rows."""
    monkeypatch.setattr(C, "SEGMENTS_A_PARTITION", max(1, int(1 / share)))  # read on the driver only
    rows = texts()
    assert rows_of(C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_segments_are_few(spark):
    words = spark.createDataFrame([("en", "the", 600), ("en", "a", 300), ("de", "der", 90), ("en", "x", 10)], "lang string, word string, a long")
    found = C._segments(words, 10)
    assert sorted(found["en"][1].tolist()) == [3, 6] and "de" not in found
    assert C._segments(words.limit(0), 10) == {}


def test_products_beyond_64_bits(spark):
    """Counts of 10 ** 9 and more are scored exactly."""
    a, left, right = 3_000_000_001, 3_000_000_007, 9_000_000_011
    got = spark.sql(
        f"SELECT (CAST({a} AS decimal(38,0)) * CAST({a} AS decimal(38,0)) * CAST(1000000 AS decimal(7,0))) div (CAST({left} AS decimal(38,0)) * CAST({right} AS decimal(38,0))) AS s"
    ).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, "", 1, "")], SCHEMA)).collect() == []
