"""The rules as values: an ordered list a caller can extend, cut or re-tune.

A rule turns facts about a document (columns computed once) into an array of
hits, a count and advice lines.  All of it is column expressions in the row of
the document, so running every rule needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge import config, lexicons as lex
from prosegauge import wording
from prosegauge.functions.text import (
    fmt_fixed, fmt_percent, let, n_matches, n_words, population_cv, preview,
)
from prosegauge.functions import patterns as P
from prosegauge.operators import lexical as L
from prosegauge.operators import measures as M
from prosegauge.operators import rhetoric as R
from prosegauge.operators.views import has_code, with_views

Facts = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """One rule: `name` is the emitted rule name, `count_key` its counter.

    `facts` are columns over the views, `hits` an array over the facts, `advice`
    lines over the scored hits.  The count is the number of scored hits unless
    `count` says otherwise.  The columns are built once per rule and reused.
    """

    name: str
    count_key: str
    hits: Callable[[], Column]
    advice: Callable[[Column], Column]
    facts: Callable[[], Facts] = field(default=dict)
    count: Callable[[], Column] | None = None

    @cached_property
    def fact_columns(self) -> Facts:
        return self.facts()

    @cached_property
    def hit_column(self) -> Column:
        return self.hits()

    @cached_property
    def count_column(self) -> Column:
        n = F.size(L.scored_only(F.col(f"hits_{self.count_key}"))) if self.count is None else self.count()
        return n.cast("int")

    @cached_property
    def advice_column(self) -> Column:
        return self.advice(L.scored_only(F.col(f"hits_{self.count_key}")))


def _one(condition: Column, hit: Column) -> Column:
    return F.when(condition, F.array(hit)).otherwise(L.no_hits())


def _line(condition: Column, line: Column) -> Column:
    return F.when(condition, F.array(line)).otherwise(L.no_lines())


def _context(name: str, *values: Column) -> Column:
    return F.format_string(wording.CONTEXTS[name], *values)


def _advise(name: str, *values: Column) -> Column:
    line = wording.ADVICE[name]
    return F.format_string(line, *values) if values else F.lit(line)


def _matches(found, name: str) -> Column:
    return F.transform(found, lambda h: _advise(name, h["match"]))


def _first(found: str, n: int) -> Column:
    return F.slice(found, 1, n)


def _ratio(count: Column, words: Column, basis: float) -> Column:
    return F.when(words > 0, count / words * F.lit(basis))


def default_rules(
    t: config.Thresholds = config.DEFAULT, lexicons: lex.Lexicons = lex.DEFAULT, complete: bool = True
) -> list[Rule]:
    """The 24 rules in order, as a list the caller may change.

    Rules that are not `complete` make no hits beyond those that weigh: enough for
    counts and scores, and less work.
    """
    return list(_rules(t, lexicons, complete))


@lru_cache(maxsize=16)
def _rules(t: config.Thresholds, lexicons: lex.Lexicons, complete: bool) -> tuple[Rule, ...]:
    c = F.col

    def found(name: str, cap: int) -> Column:
        return c(name) if complete else F.slice(name, 1, cap)
    phrase_lists = lexicons.phrases

    def phrases(detector: str, penalty: int) -> Column:
        return L.span_hits(c(f"found_{detector}"), detector, penalty)

    def phrase_facts(*detectors: str) -> Facts:
        return {
            f"found_{d}": L.phrase_spans(c("lower"), phrase_lists[d]) for d in detectors
        }

    def of(hits: Column, *detectors: str) -> Column:
        return F.filter(hits, lambda h: h["detector"].isin(*detectors))

    # 1 slop_word
    slop_word = Rule(
        "slop_word",
        "slop_words",
        facts=lambda: {"words_found": L.word_spans(lexicons)},
        hits=lambda: L.span_hits(c("words_found"), "word", t.slop_word__penalty, lowered=True),
        advice=lambda h: L.word_advice(h, lexicons),
    )

    # 2 slop_phrase
    def slop_phrase_hits() -> Column:
        staged = F.transform(
            c("not_just"),
            lambda s: let(
                F.lower(F.trim(s["match"])),
                lambda m: L.hit(
                    "not_just", m, L.snippet(s["start"], s["end"]), t.slop_phrase__penalty,
                    s["start"], s["start"] + F.length(m),
                ),
            ),
        )
        return F.concat(phrases("stock_phrase", t.slop_phrase__penalty), staged)

    slop_phrase = Rule(
        "slop_phrase",
        "slop_phrases",
        facts=lambda: {**phrase_facts("stock_phrase"), "not_just": L.not_just_spans()},
        hits=slop_phrase_hits,
        advice=lambda h: F.transform(
            h,
            lambda x: F.when(
                x["detector"] == "not_just",
                _advise("not_just", x["match"]),
            ).otherwise(L.phrase_advice(x["match"], lexicons)),
        ),
    )

    # 3 structural
    def structural_hits() -> Column:
        headers = _one(
            c("bold_headers") >= t.structural__bold_header_min,
            L.hit(
                "bold_headers",
                "bold_header_explanation",
                _context("bold_headers", c("bold_headers")),
                t.structural__bold_header_penalty,
            ),
        )
        bullets = F.transform(
            c("bullet_runs"),
            lambda n: L.hit(
                "bullet_run", "excessive_bullets", _context("bullet_run", n),
                t.structural__bullet_run_penalty,
            ),
        )
        triads = L.span_hits(
            found("triads", t.structural__triad_cap), "triad", t.structural__triad_penalty, match=lambda s: F.lit("triadic"),
            cap=t.structural__triad_cap,
        )
        return F.concat(headers, bullets, triads)

    def structural_advice(h: Column) -> Column:
        return F.concat(
            _line(
                c("bold_headers") >= t.structural__bold_header_min, _advise("bold_headers", c("bold_headers"))
            ),
            F.transform(c("bullet_runs"), lambda n: _advise("bullet_run", n)),
            _matches(_first("triads", t.structural__triad_cap), "triad"),
            _line(F.size("triads") >= t.structural__triad_advice_min, _advise("triads", F.size("triads"))),
        )

    structural = Rule(
        "structural",
        "structural",
        facts=lambda: {
            "bold_headers": R.bold_headers(),
            "bullet_runs": M.runs(c("codes"), "bT", t.structural__bullet_run_min),
            "triads": R.triad_spans(),
        },
        hits=structural_hits,
        advice=structural_advice,
    )

    # 4 tone
    def opener_hits(word: str) -> Column:
        return L.span_hits(
            c(f"opener_{word}"), "opener", t.tone__opener_penalty, match=lambda s: F.lit(word)
        )

    def tone_hits() -> Column:
        return F.concat(
            phrases("assistant_phrase", t.tone__phrase_penalty),
            phrases("false_narrativity", t.tone__phrase_penalty),
            *map(opener_hits, P.OPENERS),
        )

    tone = Rule(
        "tone",
        "tone",
        facts=lambda: {
            **phrase_facts("assistant_phrase", "false_narrativity"),
            **{f"opener_{word}": L.opener_spans(word) for word in P.OPENERS},
        },
        hits=tone_hits,
        advice=lambda h: F.concat(
            *(_matches(of(h, d), d) for d in ("assistant_phrase", "false_narrativity", "opener")),
        ),
    )

    # 5 weasel
    weasel = Rule(
        "weasel",
        "weasel",
        facts=lambda: phrase_facts("weasel_phrase"),
        hits=lambda: phrases("weasel_phrase", t.weasel__penalty),
        advice=lambda h: _matches(h, "weasel_phrase"),
    )

    # 6 ai_disclosure
    ai_disclosure = Rule(
        "ai_disclosure",
        "ai_disclosure",
        facts=lambda: {
            **phrase_facts("disclosure"), "cutoffs": L.cutoff_spans(), "just_ai": L.just_ai_spans(),
        },
        hits=lambda: F.concat(
            phrases("disclosure", t.ai_disclosure__penalty),
            L.span_hits(c("cutoffs"), "cutoff", t.ai_disclosure__penalty, lowered=True),
            L.span_hits(c("just_ai"), "just_ai", t.ai_disclosure__penalty, lowered=True),
        ),
        advice=lambda h: _matches(h, "disclosure"),
    )

    # 7 placeholder
    placeholder = Rule(
        "placeholder",
        "placeholder",
        facts=lambda: {"placeholders": L.placeholder_spans()},
        hits=lambda: L.span_hits(
            c("placeholders"), "placeholder", t.placeholder__penalty, lowered=True
        ),
        advice=lambda h: _matches(h, "placeholder"),
    )

    # 8 rhythm
    uniform = F.coalesce(c("shape.cv") < t.rhythm__cv_below, F.lit(False))
    rhythm = Rule(
        "rhythm",
        "rhythm",
        facts=lambda: {"shape": M.sentence_shape(t.rhythm__min_sentences)},
        hits=lambda: _one(
            uniform,
            L.hit(
                "rhythm",
                "monotonous_rhythm",
                _context("rhythm", fmt_fixed(c("shape.cv"), 2), c("n_sents"), fmt_fixed(c("shape.mean"), 1)),
                t.rhythm__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise(
                "rhythm", fmt_fixed(c("shape.cv"), 2), c("shape.shortest"), c("shape.longest"),
                fmt_fixed(c("shape.mean"), 1),
            ),
        ),
    )

    # 9 em_dash
    dash_ratio = _ratio(c("em_dashes"), c("word_count"), t.em_dash__words_basis)
    em_dash = Rule(
        "em_dash",
        "em_dash",
        facts=lambda: {"em_dashes": M.em_dashes()},
        hits=lambda: _one(
            F.coalesce(dash_ratio > t.em_dash__ratio_above, F.lit(False)),
            L.hit(
                "em_dash",
                "em_dash_density",
                _context("em_dash", c("em_dashes"), c("word_count"), fmt_fixed(dash_ratio, 1)),
                t.em_dash__penalty,
            ),
        ),
        advice=lambda h: _line(F.size(h) > 0, _advise("em_dash", c("em_dashes"), c("word_count"))),
    )

    # 10 contrast_pair
    def contrast_hits() -> Column:
        return F.transform(
            found("contrasts", t.contrast_pair__cap),
            lambda s, i: L.hit(
                s["kind"], s["match"], L.snippet(s["start"], s["end"]), t.contrast_pair__penalty,
                s["start"],
                # A staged match is trimmed, and so is its span.
                s["start"] + F.length(s["match"]),
                i < t.contrast_pair__cap,
            ),
        )

    def contrast_advice(h: Column) -> Column:
        n = F.size("contrasts")
        staged = F.exists("contrasts", lambda s: s["kind"] == "staged_contrast")
        one = lambda x: F.when(
            x["detector"] == "x_not_y", _advise("x_not_y", x["match"])
        ).otherwise(_advise("staged_contrast", x["match"]))
        return F.concat(
            F.transform(h, one),
            _line(
                n >= t.contrast_pair__advice_min,
                F.when(staged, _advise("staged_contrasts", n)).otherwise(_advise("contrasts", n)),
            ),
        )

    contrast_pair = Rule(
        "contrast_pair",
        "contrast_pairs",
        facts=lambda: {"contrasts": R.contrasts()},
        hits=contrast_hits,
        advice=contrast_advice,
    )

    # 11 intrasentence_keyword_bold
    bold = Rule(
        "intrasentence_keyword_bold",
        "intrasentence_keyword_bold",
        facts=lambda: {"bolds": R.keyword_bolds(t.intrasentence_keyword_bold__max_words)},
        hits=lambda: L.span_hits(
            found("bolds", t.intrasentence_keyword_bold__cap), "keyword_bold",
            t.intrasentence_keyword_bold__penalty, cap=t.intrasentence_keyword_bold__cap,
        ),
        count=lambda: F.size("bolds"),
        advice=lambda h: F.concat(
            _matches(h, "keyword_bold"),
            _line(
                F.size("bolds") >= t.intrasentence_keyword_bold__advice_min,
                _advise("keyword_bolds", F.size("bolds")),
            ),
        ),
    )

    # 12 setup_resolution
    setup = Rule(
        "setup_resolution",
        "setup_resolution",
        facts=lambda: {"setups": R.setups()},
        hits=lambda: L.span_hits(
            found("setups", t.setup_resolution__cap), "setup", t.setup_resolution__penalty,
            cap=t.setup_resolution__cap,
        ),
        count=lambda: F.size("setups"),
        advice=lambda h: _matches(h, "setup"),
    )

    # 13 colon_density
    colon_ratio = _ratio(c("colons"), c("unfenced_words"), t.colon_density__words_basis)
    colon = Rule(
        "colon_density",
        "colon_density",
        facts=lambda: {
            "colons": R.elaboration_colons(),
            # Without code both texts are the same.
            "unfenced_words": F.when(has_code(c("text")), n_words(c("unfenced"))).otherwise(
                c("word_count")
            ),
        },
        hits=lambda: _one(
            F.coalesce(colon_ratio > t.colon_density__ratio_above, F.lit(False)),
            L.hit(
                "colon_density",
                "colon_density",
                _context("colon_density", c("colons"), c("unfenced_words"), fmt_fixed(colon_ratio, 1)),
                t.colon_density__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0, _advise("colon_density", c("colons"), c("unfenced_words"))
        ),
    )

    # 14 pithy_fragment
    def pithy_hits() -> Column:
        cap = t.pithy_fragment__cap

        def scored(x, i):
            """One that weighs: equal sentences take successive occurrences in the text."""
            low, earlier = F.lower(x["s"]), F.slice(c("pithy"), 1, i)
            nth = F.size(F.filter(earlier, lambda o: F.lower(o["s"]) == low))
            return let(
                R.nth_occurrence(c("lower"), low, nth),
                lambda at: L.hit("pithy", x["s"], x["s"], t.pithy_fragment__penalty, at["start"], at["end"]),
            )

        def further(x):
            """One beyond: it stands where its own sentence does."""
            start = F.when(x["i"] > 0, F.get(c("sentence_ends"), x["i"] - 1)).otherwise(0) + x["indent"]
            return L.hit(
                "pithy", x["s"], x["s"], t.pithy_fragment__penalty, start, start + F.length(x["s"]), False
            )

        first = F.transform(F.slice("pithy", 1, cap), scored)
        if not complete:
            return first
        rest = F.slice("pithy", cap + 1, F.greatest(F.size("pithy"), F.lit(1)))
        return F.concat(first, F.transform(rest, further))

    def pithy_facts() -> Facts:
        sentences = R.pithy_sentences(t.pithy_fragment__max_words)
        ends = F.when(F.size(sentences) > t.pithy_fragment__cap, R.sentence_ends())
        return {"pithy": sentences, "sentence_ends": ends} if complete else {"pithy": sentences}

    pithy = Rule(
        "pithy_fragment",
        "pithy_fragment",
        facts=pithy_facts,
        hits=pithy_hits,
        count=lambda: F.size("pithy"),
        advice=lambda h: _matches(h, "pithy"),
    )

    # 15 bullet_density
    bullet_ratio = F.when(c("filled_lines") > 0, c("bullet_lines") / c("filled_lines"))
    bullet_density = Rule(
        "bullet_density",
        "bullet_density",
        facts=lambda: {
            "bullet_lines": n_matches(c("codes"), "[bT]"), "filled_lines": n_matches(c("codes"), "[^e]"),
        },
        hits=lambda: _one(
            F.coalesce(bullet_ratio > t.bullet_density__ratio_above, F.lit(False)),
            L.hit(
                "bullet_density",
                "bullet_density",
                _context("bullet_density", c("bullet_lines"), c("filled_lines"), fmt_percent(bullet_ratio)),
                t.bullet_density__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("bullet_density", fmt_percent(bullet_ratio)),
        ),
    )

    # 16 blockquote_density
    blockquote = Rule(
        "blockquote_density",
        "blockquote_density",
        facts=lambda: {"quotes": M.quote_lines(c("codes"))},
        hits=lambda: _one(
            c("quotes") >= t.blockquote_density__min_lines,
            L.hit(
                "blockquote_density",
                "blockquote_density",
                _context("blockquote_density", c("quotes")),
                F.least(
                    c("quotes") - t.blockquote_density__free_lines, F.lit(t.blockquote_density__cap)
                )
                * t.blockquote_density__penalty_step,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("blockquote_density", c("quotes")),
        ),
    )

    # 17 bold_bullet_list
    bold_list = Rule(
        "bold_bullet_list",
        "bold_bullet_list",
        facts=lambda: {"bold_runs": M.runs(c("codes"), "T", t.bold_bullet_list__min_run)},
        hits=lambda: F.transform(
            c("bold_runs"),
            lambda n: L.hit(
                "bold_bullet_run", "bold_bullet_list", _context("bold_bullet_run", n),
                t.bold_bullet_list__penalty,
            ),
        ),
        advice=lambda h: F.transform(c("bold_runs"), lambda n: _advise("bold_bullet_run", n)),
    )

    # 18 horizontal_rules
    dividers = Rule(
        "horizontal_rules",
        "horizontal_rules",
        facts=lambda: {"dividers": n_matches(c("codes"), "h")},
        hits=lambda: _one(
            c("dividers") >= t.horizontal_rules__min_count,
            L.hit(
                "horizontal_rules",
                "horizontal_rules",
                _context("horizontal_rules", c("dividers")),
                t.horizontal_rules__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("horizontal_rules", c("dividers")),
        ),
    )

    # 19 phrase_reuse
    def reuse_hits() -> Column:
        return F.transform(
            found("reuse", t.phrase_reuse__cap),
            lambda g, i: let(
                R.first_occurrence(c("lower"), g["gram"]),
                lambda start: L.hit(
                    "repeated_ngram",
                    g["gram"],
                    _context("repeated_ngram", g["gram"], g["n"], g["count"]),
                    t.phrase_reuse__penalty,
                    F.coalesce(start, F.lit(0)),
                    F.coalesce(start + F.length(g["gram"]), c("text_len")),
                    i < t.phrase_reuse__cap,
                ),
            ),
        )

    reuse = Rule(
        "phrase_reuse",
        "phrase_reuse",
        facts=lambda: {
            "reuse": M.repeated_ngrams(
                t.phrase_reuse__min_n, t.phrase_reuse__max_n, t.phrase_reuse__min_count
            )
        },
        hits=reuse_hits,
        advice=lambda h: F.transform(
            _first("reuse", t.phrase_reuse__cap),
            lambda g: _advise("repeated_ngram", g["gram"], g["count"]),
        ),
    )

    # 20 copula_chain
    copula_share = c("copulas") / c("n_sents")
    copula = Rule(
        "copula_chain",
        "copula_chain",
        facts=lambda: {"copulas": M.copula_sentences(t.copula_chain__min_sentences)},
        hits=lambda: _one(
            F.when(c("copulas").isNotNull(), copula_share >= t.copula_chain__share_from).otherwise(False),
            L.hit(
                "copula_chain",
                "copula_density",
                _context("copula_chain", c("copulas"), c("n_sents"), fmt_percent(copula_share)),
                t.copula_chain__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("copula_chain", fmt_percent(copula_share)),
        ),
    )

    # 21 extreme_sentence
    extreme = Rule(
        "extreme_sentence",
        "extreme_sentence",
        facts=lambda: {"extremes": M.extreme_sentences(t.extreme_sentence__min_words)},
        hits=lambda: F.transform(
            c("extremes"),
            lambda x: L.hit(
                "extreme_sentence",
                "run_on_sentence",
                _context("extreme_sentence", x["n"], x["w"], preview(x["s"])),
                t.extreme_sentence__penalty,
            ),
        ),
        advice=lambda h: F.transform(c("extremes"), lambda x: _advise("extreme_sentence", x["n"], x["w"])),
    )

    # 22 closing_aphorism
    closing = Rule(
        "closing_aphorism",
        "closing_aphorism",
        facts=lambda: {"closing": M.closing_forms(t.closing_aphorism__min_sentences)},
        hits=lambda: _one(
            F.coalesce(c("closing.forms") >= t.closing_aphorism__min_forms, F.lit(False)),
            L.hit(
                "closing_aphorism",
                "closing_aphorism",
                _context("closing_aphorism", c("closing.forms"), preview(c("closing.last"))),
                t.closing_aphorism__penalty,
            ),
        ),
        advice=lambda h: _line(F.size(h) > 0, _advise("closing_aphorism")),
    )

    # 23 paragraph_balance
    balance = Rule(
        "paragraph_balance",
        "paragraph_balance",
        facts=lambda: {"balance": _balance(t.paragraph_balance__min_body)},
        hits=lambda: _one(
            F.coalesce(c("balance") > t.paragraph_balance__ratio_above, F.lit(False)),
            L.hit(
                "paragraph_balance",
                "paragraph_balance",
                _context(
                    "paragraph_balance", _joined(F.slice("paras", F.lit(2), F.size("paras"))), fmt_fixed(c("balance"), 2)
                ),
                t.paragraph_balance__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("paragraph_balance", fmt_fixed(c("balance"), 2)),
        ),
    )

    # 24 paragraph_cv
    cv = Rule(
        "paragraph_cv",
        "paragraph_cv",
        facts=lambda: {"para_cv": _paragraph_cv(t.paragraph_cv__min_paragraphs)},
        hits=lambda: _one(
            F.coalesce(c("para_cv") < t.paragraph_cv__cv_below, F.lit(False)),
            L.hit(
                "paragraph_cv",
                "paragraph_cv",
                _context("paragraph_cv", _joined(c("paras")), fmt_fixed(c("para_cv"), 2)),
                t.paragraph_cv__penalty,
            ),
        ),
        advice=lambda h: _line(
            F.size(h) > 0,
            _advise("paragraph_cv", fmt_fixed(c("para_cv"), 2)),
        ),
    )

    return (
        slop_word, slop_phrase, structural, tone, weasel, ai_disclosure, placeholder, rhythm,
        em_dash, contrast_pair, bold, setup, colon, pithy, bullet_density, blockquote, bold_list,
        dividers, reuse, copula, extreme, closing, balance, cv,
    )


def _joined(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda n: n.cast("string")), ", ")


def _balance(min_body: int) -> Column:
    """Smallest over largest paragraph, the first one left out."""
    return F.when(
        F.size("paras") > min_body,
        let(
            F.slice("paras", F.lit(2), F.size("paras")), lambda b: F.array_min(b) / F.array_max(b)
        ),
    )


def _paragraph_cv(min_paragraphs: int) -> Column:
    return F.when(F.size("paras") >= min_paragraphs, population_cv(F.col("paras"))["cv"])


def with_hits(df: DataFrame, rules: list[Rule], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add `hits_<count key>` and `n_<count key>` columns for every rule.

    Texts under the word floor must be handled by the caller.
    """
    facts: Facts = {}
    for rule in rules:
        facts.update(rule.fact_columns)
    out = with_views(df, text, key)
    out = out.withColumns(facts) if facts else out
    out = out.withColumns({f"hits_{r.count_key}": r.hit_column for r in rules})
    return out.withColumns({f"n_{r.count_key}": r.count_column for r in rules})
