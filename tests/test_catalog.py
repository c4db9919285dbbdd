"""Registered queries against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

# Quick queries of every family; the driver runs all of them.
CHECKED = (
    "load_documents", "choose_scope", "scan_status", "masked_text", "code_spans", "collapse_tables",
    "sentences", "lines", "ngram_tokens", "paragraphs", "phrase_hits", "context_snippets",
    "slop_words_hits", "slop_phrases_hits", "structural_hits", "setup_resolution_hits",
    "intrasentence_keyword_bold_hits", "colon_density_hits", "paragraph_cv_hits", "repeated_ngrams",
    "scores", "signals", "phrase_advice", "page_markdown", "located_hits", "layout_to_text",
    "dedup_phases", "latest_readings", "first_ready", "newest_request_wins",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert got == expected
    assert got, "an empty result proves nothing"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
