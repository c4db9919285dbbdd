"""Thresholds of the rules, as data."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

# Limits that a caller may ask for.  Nothing is cut by them on its own.
MAX_TEXT_CHARS = 500_000
MAX_PAGE_NODES = 12_000
MIN_WORDS = 10
SNIPPET_CHARS = 60
MAX_FILE_BYTES = 25 * 1024 * 1024
TEXT_EXTENSIONS = ("txt", "md", "markdown", "text", "rst", "org")

# The scoring model.
CONCENTRATION = 2.5
DECAY = 0.04
DENSITY_BASIS = 1000.0
BANDS = (("clean", 80), ("light", 60), ("moderate", 40), ("heavy", 20), ("saturated", 0))
AMPLIFIED_RULES = ("contrast_pair", "pithy_fragment", "setup_resolution")


@dataclass(frozen=True)
class Thresholds:
    """Named thresholds of one configuration.  Field names are `rule__key`."""

    # The default configuration.
    slop_word__penalty: int = -2
    slop_phrase__penalty: int = -3
    structural__bold_header_min: int = 3
    structural__bold_header_penalty: int = -5
    structural__bullet_run_min: int = 6
    structural__bullet_run_penalty: int = -3
    structural__triad_cap: int = 5
    structural__triad_penalty: int = -1
    structural__triad_advice_min: int = 3
    tone__phrase_penalty: int = -3
    tone__opener_penalty: int = -2
    weasel__penalty: int = -2
    ai_disclosure__penalty: int = -10
    placeholder__penalty: int = -5
    rhythm__min_sentences: int = 5
    rhythm__cv_below: float = 0.3
    rhythm__penalty: int = -5
    em_dash__words_basis: float = 150.0
    em_dash__ratio_above: float = 1.0
    em_dash__penalty: int = -3
    contrast_pair__cap: int = 5
    contrast_pair__advice_min: int = 2
    contrast_pair__penalty: int = -1
    intrasentence_keyword_bold__max_words: int = 5
    intrasentence_keyword_bold__cap: int = 5
    intrasentence_keyword_bold__advice_min: int = 3
    intrasentence_keyword_bold__penalty: int = -2
    setup_resolution__cap: int = 5
    setup_resolution__penalty: int = -3
    colon_density__words_basis: float = 150.0
    colon_density__ratio_above: float = 1.5
    colon_density__penalty: int = -3
    pithy_fragment__max_words: int = 6
    pithy_fragment__cap: int = 3
    pithy_fragment__penalty: int = -2
    bullet_density__ratio_above: float = 0.4
    bullet_density__penalty: int = -8
    blockquote_density__min_lines: int = 3
    blockquote_density__free_lines: int = 2
    blockquote_density__cap: int = 4
    blockquote_density__penalty_step: int = -3
    bold_bullet_list__min_run: int = 3
    bold_bullet_list__penalty: int = -5
    horizontal_rules__min_count: int = 4
    horizontal_rules__penalty: int = -3
    phrase_reuse__min_n: int = 4
    phrase_reuse__max_n: int = 8
    phrase_reuse__min_count: int = 3
    phrase_reuse__cap: int = 5
    phrase_reuse__penalty: int = -1
    copula_chain__min_sentences: int = 6
    copula_chain__share_from: float = 0.5
    copula_chain__penalty: int = -3
    extreme_sentence__min_words: int = 140
    extreme_sentence__penalty: int = -5
    closing_aphorism__min_sentences: int = 4
    closing_aphorism__min_forms: int = 2
    closing_aphorism__penalty: int = -4
    paragraph_balance__min_body: int = 3
    paragraph_balance__ratio_above: float = 0.7
    paragraph_balance__penalty: int = -6
    paragraph_cv__min_paragraphs: int = 5
    paragraph_cv__cv_below: float = 0.45
    paragraph_cv__penalty: int = -1


DEFAULT = Thresholds()


def rule_config(spark: SparkSession, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """The thresholds as a table (rule, key, value)."""
    rows = [(*name.split("__"), float(value)) for name, value in asdict(thresholds).items()]
    return spark.createDataFrame(rows, "rule string, key string, value double")
