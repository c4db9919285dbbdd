"""Queries over hits and scores: the parts of a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosegauge import wording
from prosegauge.catalog import sql as S
from prosegauge.catalog.fixtures import seeded
from prosegauge.catalog.registry import query
from prosegauge.catalog.sql import Sql
from prosegauge.catalog.text_queries import named
from prosegauge.operators.lexical import scored_only
from prosegauge.plans import report, scoring
from prosegauge.plans.rules import default_rules


def hits_of(spark, sf_dir):
    return scoring.hits(seeded(spark, sf_dir), None)


def rows_of(spark, sf_dir):
    return scoring.scored(seeded(spark, sf_dir))


def _signals(sql: Sql) -> None:
    sql.all_hits()
    sql.add(
        "signals",
        """SELECT doc_id, rule, CAST(weight AS INTEGER) AS weight, CAST(hits AS INTEGER) AS hits, CAST(found AS INTEGER) AS found,
          CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, hits DESC, first) AS INTEGER) AS rank
        FROM (SELECT doc_id, rule, sum(CASE WHEN scored THEN abs(penalty) ELSE 0 END) AS weight, count(*) FILTER (scored) AS hits,
          count(*) AS found, min(rule_order) AS first FROM all_hits GROUP BY doc_id, rule)""",
    )


def _with(build, final: str):
    def make() -> str:
        sql = Sql()
        build(sql)
        return sql.text(final)

    return make


@query("signals", _with(_signals, "SELECT doc_id, rule, weight, hits, found, rank FROM signals"))
def signals(spark, sf_dir):
    return report.signals(rows_of(spark, sf_dir), default_rules())


@query(
    "signal_severity",
    _with(
        _signals,
        f"""SELECT doc_id, rule, round(share, 6) AS share, CASE WHEN share >= {report.CRITICAL_SHARE} THEN 'critical'
          WHEN share >= {report.HIGH_SHARE} THEN 'high' ELSE 'moderate' END AS severity
        FROM (SELECT *, weight / (sum(weight) OVER (PARTITION BY doc_id))::DOUBLE AS share FROM signals)""",
    ),
)
def severity(spark, sf_dir):
    return report.severity(rows_of(spark, sf_dir), default_rules()).select(
        "doc_id", "rule", F.round("share", 6).alias("share"), "severity"
    )


_LABEL_ROWS = ", ".join(f"({S.q(r)}, {S.q(t)})" for r, t in report.RULE_LABELS.items())


@query(
    "signals_by_label",
    _with(
        _signals,
        f"""SELECT label, CAST(count(*) AS BIGINT) AS documents, CAST(sum(weight) AS BIGINT) AS weight
        FROM signals JOIN (VALUES {_LABEL_ROWS}) AS l(rule, label) USING (rule) GROUP BY label""",
    ),
)
def signals_by_label(spark, sf_dir):
    labelled = report.with_labels(report.signals(rows_of(spark, sf_dir), default_rules()))
    return labelled.groupBy("label").agg(F.count("*").alias("documents"), F.sum("weight").alias("weight"))


@query(
    "top_hits",
    _with(
        lambda sql: sql.all_hits(),
        f"""SELECT doc_id, rule, seq, match, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, rule ORDER BY seq) AS INTEGER) AS rank
        FROM all_hits) WHERE rank <= {report.HITS_SHOWN}""",
    ),
)
def top_hits(spark, sf_dir):
    return report.top_hits(rows_of(spark, sf_dir), default_rules()).select("doc_id", "rule", "seq", "match", "rank")


def _label_sql(column: str) -> str:
    return f"replace(replace({column}, '**', ''), '`', '')"


@query(
    "hit_labels",
    _with(
        lambda sql: sql.all_hits(),
        f"""SELECT doc_id, seq, CASE WHEN contains(context, match) THEN '“' || {_label_sql('match')} || '” ' || {_label_sql('context')}
          ELSE {_label_sql('context')} END AS label FROM all_hits""",
    ),
)
def hit_labels(spark, sf_dir):
    return hits_of(spark, sf_dir).select(
        "doc_id", "seq", report.hit_label(F.col("match"), F.col("context")).alias("label")
    )


def _painted(most: str):
    return _with(
        lambda sql: sql.all_hits(),
        f"""SELECT doc_id, seq, rule, start_pos, end_pos FROM all_hits h JOIN docs d USING (doc_id)
        WHERE {most} AND NOT (start_pos = 0 AND end_pos = length(d.text))""",
    )


@query("paintable_hits", _painted("TRUE"))
def paintable_hits(spark, sf_dir):
    return named(report.paintable(rows_of(spark, sf_dir), default_rules())).select("doc_id", "seq", "rule", "start_pos", "end_pos")


@query("painted_hits", _painted(f"seq < {report.PAINTED}"))
def painted_hits(spark, sf_dir):
    """What one page shows."""
    found = report.paintable(rows_of(spark, sf_dir), default_rules(), report.PAINTED)
    return named(found).select("doc_id", "seq", "rule", "start_pos", "end_pos")


@query(
    "report_heads",
    _with(
        lambda sql: sql.scores(),
        """SELECT s.doc_id, s.source, blurb, least(99, greatest(1, slop)) AS rail_at,
          word_count || ' words in ' || s.source || '  ·  ' || n || CASE WHEN n = 1 THEN ' signal' ELSE ' signals' END ||
          '  ·  ' || regexp_replace(printf('%.2f', density), '\\.?0+$', '') || ' penalty per 1k words' AS meta
        FROM (SELECT sc.*, d.source, (SELECT count(*) FROM all_hits h WHERE h.doc_id = sc.doc_id AND scored) AS n FROM scores sc JOIN docs d USING (doc_id)) s
        JOIN (VALUES """
        + ", ".join(f"({S.q(b)}, {S.q(t)})" for b, t in report.BAND_BLURBS.items())
        + ") AS b(band, blurb) USING (band)",
    ),
)
def report_heads(spark, sf_dir):
    rules = default_rules()
    rows = scoring.scored(seeded(spark, sf_dir, "source"), rules).select(
        "doc_id", "source", "word_count", "density", "slop", "band", F.size(scored_only(scoring.hit_array(rules))).alias("n")
    )
    blurbs = F.broadcast(report.band_blurbs(spark).select("band", "blurb"))
    return rows.join(blurbs, "band").select(
        "doc_id", "source", "blurb", report.rail_at(F.col("slop")).alias("rail_at"),
        report.meta_line(F.col("word_count"), F.col("n"), F.col("density"), F.col("source")).alias("meta"),
    )


@query(
    "indicator",
    _with(
        lambda sql: sql.scores(),
        """SELECT doc_id AS key, CASE WHEN word_count >= 10 THEN band END AS icon_band,
          CASE WHEN word_count >= 10 THEN CAST(slop AS VARCHAR) ELSE '' END AS badge_text,
          CASE WHEN word_count >= 10 THEN colour END AS badge_colour FROM scores JOIN (VALUES """
        + ", ".join(f"({S.q(b)}, {S.q(c)})" for b, c in report.BAND_COLOURS.items())
        + ") AS c(band, colour) USING (band)",
    ),
)
def indicator(spark, sf_dir):
    readings = scoring.scan(seeded(spark, sf_dir)).select(F.col("doc_id").alias("key"), "band", "slop")
    return report.indicator(readings).select(
        "key", "icon_band", "badge_text", "badge_colour"
    )


#: Advice on each hit of a rule, by the hit's detector where there are several.
HIT_ADVICE = {
    "tone": ("assistant_phrase", "false_narrativity", "opener"), "weasel": ("weasel_phrase",),
    "ai_disclosure": ("disclosure",), "placeholder": ("placeholder",),
    "contrast_pairs": ("x_not_y", "staged_contrast"), "intrasentence_keyword_bold": ("keyword_bold",),
    "setup_resolution": ("setup",), "pithy_fragment": ("pithy",),
}


def _phrase_lines() -> str:
    lex = ", ".join(f"({S.q(p)}, {S.q(S.L.phrase_class(p))})" for p in S.L.stock_phrases)
    arms = " ".join(f"WHEN {S.q(c)} THEN {S.say(t, 'match')}" for c, t in wording.PHRASE_ADVICE.items())
    return f"""SELECT doc_id, 2 AS r, 0 AS o, seq, CASE WHEN detector = 'not_just' THEN {S.advise('not_just', 'match')}
        ELSE CASE coalesce(class, 'other') {arms} END END AS line
      FROM h_slop_phrases LEFT JOIN (VALUES {lex}) AS l(match, class) USING (match)"""


def _hit_lines(key: str, order: int) -> str:
    detectors = HIT_ADVICE[key]
    arms = " ".join(f"WHEN {S.q(d)} THEN {S.advise(d, 'match')}" for d in detectors)
    line = f"CASE detector {arms} END" if len(detectors) > 1 else S.advise(detectors[0], "match")
    # Where the detectors of a rule come one after another, and not in the order of the text.
    rank = f"list_position({list(detectors)}, detector)" if key == "tone" else "0"
    return f"SELECT doc_id, {order}, {rank}, seq, {line} FROM h_{key} WHERE scored"


def _doc_lines(sql: Sql) -> list[str]:
    """Advice that follows from measures, and not from single hits; the numbers are the places of the rules."""
    t, hit = S.T, lambda key: f"doc_id IN (SELECT doc_id FROM h_{key})"
    one = lambda r, o, line, source, where, seq="0": f"SELECT doc_id, {r}, {o}, {seq}, {line} FROM {source} WHERE {where}"
    n_of = lambda key: f"(SELECT doc_id, count(*) AS n FROM {key} GROUP BY doc_id)"
    shape = "(SELECT doc_id, r.n, mean, cv, min(n_words) AS lo, max(n_words) AS hi FROM rh r JOIN sents USING (doc_id) GROUP BY ALL)"
    staged = f"CASE WHEN st THEN {S.advise('staged_contrasts', 'n')} ELSE {S.advise('contrasts', 'n')} END"
    times = f"CASE WHEN n > 1 THEN {S.say(wording.TIMES, 'n')} ELSE '' END"
    words = " ".join(f"WHEN {S.q(c)} THEN {S.say(text, 'match', times)}" for c, text in wording.WORD_ADVICE.items())
    lex = ", ".join(f"({S.q(w)}, {S.q(S.L.word_class(w))})" for w in S.L.words)
    found = "(SELECT doc_id, match, count(*) AS n, min(seq) AS seq FROM h_slop_words GROUP BY ALL)"
    return [
        f"SELECT doc_id, 1, 0, seq, CASE class {words} END FROM {found} JOIN (VALUES {lex}) AS l(match, class) USING (match)",
        one(3, 0, S.advise("bold_headers", "n"), "bh", f"n >= {t.structural__bold_header_min}"),
        one(3, 1, S.advise("bullet_run", "n"), "br", f"n >= {t.structural__bullet_run_min}", "first"),
        one(3, 2, S.advise("triad", "match"), "tri", f"i <= {t.structural__triad_cap} + 1", "i"),
        one(3, 3, S.advise("triads", "n"), n_of("tri"), f"n >= {t.structural__triad_advice_min}"),
        one(8, 0, S.advise("rhythm", S.fixed("cv", 2), "lo", "hi", S.fixed("mean", 1)), shape, hit("rhythm")),
        one(9, 0, S.advise("em_dash", "n", "word_count"), "em", hit("em_dash")),
        one(10, 1, staged, "(SELECT doc_id, count(*) AS n, bool_or(kind = 'staged_contrast') AS st FROM cp GROUP BY doc_id)", f"n >= {t.contrast_pair__advice_min}", "1000000"),
        one(11, 1, S.advise("keyword_bolds", "n"), n_of("kbs"), f"n >= {t.intrasentence_keyword_bold__advice_min}", "1000000"),
        one(13, 0, S.advise("colon_density", "n", "w"), "co", hit("colon_density")),
        one(15, 0, S.advise("bullet_density", S.percent("ratio")), "bd", hit("bullet_density")),
        one(16, 0, S.advise("blockquote_density", "n"), "bq", hit("blockquote_density")),
        one(17, 0, S.advise("bold_bullet_run", "n"), "bb", f"n >= {t.bold_bullet_list__min_run}", "first"),
        one(18, 0, S.advise("horizontal_rules", "n"), "hr", hit("horizontal_rules")),
        one(19, 0, S.advise("repeated_ngram", "gram", "c"), "reuse", f"i <= {t.phrase_reuse__cap}", "i"),
        one(20, 0, S.advise("copula_chain", S.percent("share")), "cc", hit("copula_chain")),
        one(21, 0, S.advise("extreme_sentence", "(sent_no + 1)", "n_words"), "lsents", f"n_words >= {t.extreme_sentence__min_words}", "sent_no"),
        one(22, 0, S.advise("closing_aphorism"), "ca", hit("closing_aphorism")),
        one(23, 0, S.advise("paragraph_balance", S.fixed("ratio", 2)), "pb", hit("paragraph_balance")),
        one(24, 0, S.advise("paragraph_cv", S.fixed("cv", 2)), "pc", hit("paragraph_cv")),
    ]


def _advice_of(sql: Sql, lines: list[str]) -> None:
    sql.add("advice_lines", " UNION ALL ".join(lines))
    sql.add(
        "advice",
        f"""SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, o, seq) AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY r, o, seq) AS k FROM advice_lines) JOIN views USING (doc_id)
        WHERE k = 1 AND word_count >= {S.config.MIN_WORDS}""",
    )


def _advice_rows(sql: Sql) -> None:
    """Advice of the phrase rules, which follows from the hits alone."""
    for key in PHRASE_RULES:
        getattr(sql, key)()
    sql.code()
    order = {key: i for i, (_, key) in enumerate(S.RULES, 1)}
    _advice_of(sql, [_phrase_lines(), *(_hit_lines(key, order[key]) for key in PHRASE_RULES[1:])])


def _all_advice_rows(sql: Sql) -> None:
    sql.all_hits()
    order = {key: i for i, (_, key) in enumerate(S.RULES, 1)}
    _advice_of(sql, [_phrase_lines(), *(_hit_lines(key, order[key]) for key in HIT_ADVICE), *_doc_lines(sql)])


PHRASE_RULES = ("slop_phrases", "weasel", "ai_disclosure", "placeholder")


def phrase_rules():
    return [r for r in default_rules() if r.count_key in PHRASE_RULES]


@query("phrase_advice", _with(_advice_rows, "SELECT doc_id, rank, line FROM advice"))
def phrase_advice(spark, sf_dir):
    return scoring.advice(seeded(spark, sf_dir), phrase_rules())


@query(
    "top_advice",
    _with(
        _advice_rows,
        f"""SELECT doc_id, coalesce(rank, 1) AS rank, coalesce(line, 'Nothing flagged.') AS line
        FROM docs LEFT JOIN (SELECT * FROM advice WHERE rank <= {report.ADVICE_SHOWN}) USING (doc_id)""",
    ),
)
def top_advice(spark, sf_dir):
    return report.top_advice(scoring.analyze(seeded(spark, sf_dir), phrase_rules()))


@query("advice_of_all_rules", _with(_all_advice_rows, "SELECT doc_id, rank, line FROM advice"))
def advice_of_all_rules(spark, sf_dir):
    """Advice of every rule."""
    return scoring.advice(seeded(spark, sf_dir))
