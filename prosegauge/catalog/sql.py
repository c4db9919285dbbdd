"""Check SQL for the text views, rules, scores and reports.

Each function adds common table expressions to a `Sql` builder and names them
after what they hold.  The SQL is written for DuckDB and takes other routes
than the Spark plans where it can: joins against inline word lists, gaps and
islands over lines, and window sums for offsets.
"""

from __future__ import annotations

from prosegauge import config, wording
from prosegauge import lexicons as lex
from prosegauge.catalog.fixtures import quote, seeded_sql

T = config.DEFAULT
L = lex.DEFAULT

WS = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
SP = f"[{WS}]"
NS = f"[^{WS}]"
W = "[\\p{L}\\p{N}_]"
ANY = "[^\\n\\r\\x{2028}\\x{2029}]"
SENT = f"[.!?][\"'\\x{{201d}}\\x{{2019}})\\]]*(?:{SP}|\\z)"
BULLET = f"^{SP}*[-*]{SP}|^{SP}*[0-9]+[.)]{SP}"
BOLD_BULLET = f"^{SP}*[-*]{SP}+\\*\\*|^{SP}*[0-9]+[.)]{SP}+\\*\\*"
HR = f"^{SP}*(?:---+|\\*\\*\\*+|___+){SP}*\\z"

q = quote


def rx(pattern: str) -> str:
    return quote(pattern)


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, {rx(f'^{SP}+|{SP}+' + chr(92) + 'z')}, '', 'g')"


def words(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {rx(NS + '+')})) AS INTEGER)"


def count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {rx(pattern)})) AS INTEGER)"


def like(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {rx(pattern)})"


def half_even(expr: str) -> str:
    return (
        f"(CASE WHEN ({expr}) - floor({expr}) > 0.5 THEN floor({expr}) + 1 "
        f"WHEN ({expr}) - floor({expr}) < 0.5 THEN floor({expr}) "
        f"ELSE floor({expr}) + (CAST(floor({expr}) AS BIGINT) % 2) END)"
    )


def fixed(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"printf('%.{digits}f', {half_even(f'({expr}) * {scale}')} / {scale})"


def percent(expr: str) -> str:
    return f"(CAST({half_even(f'({expr}) * 100')} AS INTEGER) || '%')"


def ctx(text: str, s: str, e: str) -> str:
    """The 60-character snippet around a span."""
    mid = f"CAST(floor(({s} + {e}) / 2.0) AS INTEGER)"
    left, right = f"greatest(0, {mid} - 30)", f"least(length({text}), {mid} + 30)"
    return (
        f"(CASE WHEN {left} > 0 THEN '...' ELSE '' END || "
        f"replace(substring({text}, {left} + 1, {right} - {left}), chr(10), ' ') || "
        f"CASE WHEN {right} < length({text}) THEN '...' ELSE '' END)"
    )


def say(template: str, *values: str) -> str:
    """A template with SQL expressions in the places of ``%d`` and ``%s``."""
    parts = template.replace("%d", "%s").split("%s")
    out = [quote(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [f"CAST({value} AS VARCHAR)", quote(part)]
    return "(" + " || ".join(out) + ")"


def context(name: str, *values: str) -> str:
    return say(wording.CONTEXTS[name], *values)


def advise(name: str, *values: str) -> str:
    return say(wording.ADVICE[name], *values)


class Sql:
    """An ordered set of named common table expressions."""

    def __init__(self, docs: str | None = None):
        self.parts: dict[str, str] = {}
        self.add("docs", seeded_sql() if docs is None else docs)

    def add(self, name: str, body: str) -> str:
        self.parts.setdefault(name, body)
        return name

    def text(self, final: str) -> str:
        body = ",\n".join(f"{k} AS ({v})" for k, v in self.parts.items())
        return f"WITH {body}\n{final}"

    # --- views ---------------------------------------------------------------
    def code(self) -> str:
        """Code pieces, then masked and unfenced text.

        Fences of width 3 to 6 and inline spans of width 1 to 6, without back
        references: one alternative per width.  An unclosed run is matched
        whole and left as it is.
        """
        fences = [
            f"(?m:^)[ \\t]{{0,3}}`{{{n}}}(?:[^`\\n][^\\n]*)?"
            f"(?:\\n(?s:.*?)(?m:^) {{0,3}}`{{{n},}}[ \\t]*(?:\\n|\\z)|\\n(?s:.*)|\\z)"
            for n in range(3, 7)
        ]
        inline = []
        for k in range(1, 7):
            other = ([f"`{{1,{k - 1}}}"] if k > 1 else []) + [f"`{{{k + 1},}}"]
            inline.append(
                f"`{{{k}}}[^`\\n]+(?:(?:{'|'.join(other)})[^`\\n]+)*`{{{k}}}(?:[^`]|\\z)"
            )
        pattern = "|".join(fences + inline + ["`+"])
        self.add(
            "code_pieces",
            f"""SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
            SELECT doc_id, string_split_regex(regexp_replace(text, {rx(pattern)},
              chr(1) || '\\0' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS ps
            FROM docs WHERE contains(text, '`'))""",
        )
        self.add(
            "code_kinds",
            f"""SELECT *, CASE WHEN i % 2 = 1 THEN 'text'
              WHEN regexp_matches(piece, '^`+$') THEN 'text'
              WHEN regexp_matches(piece, {rx('^[ ' + chr(92) + 't]{0,3}```')}) AND (p IS NULL OR p = '' OR right(p, 1) = chr(10))
                THEN 'fence' ELSE 'inline' END AS kind
            FROM (SELECT *, CASE WHEN lag(piece) OVER w = '' THEN lag(piece, 2) OVER w ELSE lag(piece) OVER w END AS p
                  FROM code_pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
        )
        indent = "regexp_extract(piece, '^[ \\t]*')"
        blank = "regexp_replace({}, '[^\\n]', ' ', 'g')"
        # An inline piece may carry the character after it.
        tail = "CASE WHEN right(piece, 1) = '`' THEN '' ELSE right(piece, 1) END"
        span = "CASE WHEN right(piece, 1) = '`' THEN piece ELSE left(piece, length(piece) - 1) END"
        self.add(
            "code_texts",
            f"""SELECT doc_id,
              string_agg(CASE kind WHEN 'text' THEN piece
                WHEN 'fence' THEN {indent} || {blank.format(f'substring(piece, length({indent}) + 1)')}
                ELSE {blank.format(f'({span})')} || {tail} END, '' ORDER BY i) AS masked,
              string_agg(CASE kind WHEN 'fence' THEN {indent} ELSE piece END, '' ORDER BY i) AS unfenced,
              string_agg(CASE kind WHEN 'fence' THEN {indent} || chr(10) || '.' || chr(10) ELSE piece END, '' ORDER BY i) AS broken
            FROM code_kinds GROUP BY doc_id""",
        )
        return self.add(
            "views",
            f"""SELECT d.*, coalesce(c.masked, text) AS masked, coalesce(c.unfenced, text) AS unfenced,
              coalesce(c.broken, text) AS broken, {words('coalesce(c.masked, text)')} AS word_count
            FROM docs d LEFT JOIN code_texts c USING (doc_id)""",
        )

    def lines(self, source: str = "docs", column: str = "text", name: str = "lines") -> str:
        return self.add(
            name,
            f"""SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no
            FROM (SELECT doc_id, string_split({column}, chr(10)) AS l FROM {source})""",
        )

    def sentences(self, source: str = "docs", column: str = "text", name: str = "sents") -> str:
        raw = f"regexp_split_to_array({column}, {rx(SENT)})"
        kept = f"list_filter(list_transform({raw}, lambda x: {trim('x')}), lambda x: x <> '')"
        return self.add(
            name,
            f"""SELECT doc_id, sentence, sent_no, {words('sentence')} AS n_words FROM (
            SELECT doc_id, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sent_no
            FROM (SELECT doc_id, {kept} AS l FROM {source}))""",
        )

    def collapsed(self) -> str:
        """Tables turned into full stops, by numbering runs of table lines."""
        self.code()
        self.lines("views", "broken", "tlines")
        inner = f"regexp_replace({trim('line')}, '^\\|+|\\|+$', '', 'g')"
        cell = f"^{SP}*:?-{{3,}}:?{SP}*(?:\\|{SP}*:?-{{3,}}:?{SP}*)+$"
        self.add(
            "tflags",
            f"""SELECT *, contains({inner}, '|') AND {like(inner, f'[^|{WS}]')} AS is_row,
              contains({inner}, '|') AND {like(inner, cell)} AS is_delim FROM tlines""",
        )
        # A run of rows: the table starts one line before its first delimiter.
        self.add(
            "truns",
            """SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, is_row ORDER BY line_no) AS run FROM tflags""",
        )
        self.add(
            "tstarts",
            """SELECT doc_id, run, min(line_no) - 1 AS first FROM (
              SELECT *, line_no > min(line_no) OVER (PARTITION BY doc_id, run) AS inside FROM truns WHERE is_row)
            WHERE is_delim AND inside GROUP BY doc_id, run""",
        )
        return self.add(
            "collapsed",
            """SELECT doc_id, string_agg(CASE WHEN line_no = first THEN '.' ELSE line END, chr(10) ORDER BY line_no) AS text
            FROM (SELECT t.doc_id, t.line_no, t.line, s.first FROM truns t LEFT JOIN tstarts s
              ON t.doc_id = s.doc_id AND t.run = s.run AND t.is_row) WHERE first IS NULL OR line_no <= first
            GROUP BY doc_id""",
        )

    def spans(self, name: str, source: str, column: str, pattern: str) -> str:
        self.add(
            f"{name}_p",
            f"""SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
            SELECT doc_id, string_split(regexp_replace({column}, {rx(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS ps
            FROM {source})""",
        )
        return self.add(
            name,
            f"""SELECT doc_id, i, s, CAST(s + length(match) AS INTEGER) AS e, match, rest, before FROM (
              SELECT doc_id, i, CAST(sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER
                (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS s,
              split_part(piece, chr(2), 1) AS match, split_part(piece, chr(2), 2) AS rest,
              lag(piece) OVER (PARTITION BY doc_id ORDER BY i) AS before
              FROM {name}_p) WHERE i > 1""",
        )

    def phrases(self, name: str, phrase_list) -> str:
        rows = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(phrase_list))
        self.add(f"{name}_lex", f"SELECT * FROM (VALUES {rows}) AS v(ord, phrase)")
        self.add(
            f"{name}_p",
            f"""SELECT doc_id, ord, phrase, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
            SELECT doc_id, ord, phrase, string_split(lower(text), phrase) AS ps
            FROM docs JOIN {name}_lex ON contains(lower(text), phrase))""",
        )
        return self.add(
            name,
            f"""SELECT doc_id, ord, phrase AS match, i, s, CAST(s + length(phrase) AS INTEGER) AS e FROM (
            SELECT *, CAST(sum(length(piece) + CASE WHEN i > 1 THEN length(phrase) ELSE 0 END) OVER
              (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS s
            FROM {name}_p) WHERE i > 1""",
        )

    # --- rules -----------------------------------------------------------------
    def hits(self, key: str, branches: list[str], order: str) -> str:
        """A rule's hits from branches giving (doc_id, o1, o2, detector, match,
        context, penalty, start_pos, end_pos, scored)."""
        union = " UNION ALL ".join(branches)
        return self.add(
            f"h_{key}",
            f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INTEGER) AS seq,
              detector, match, context, CAST(penalty AS INTEGER) AS penalty,
              CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos, scored
            FROM ({union})""",
        )

    def text_hits(self, spans: str, o1, o2, detector, penalty, match="x.match", end="x.e", where="TRUE", scored="TRUE"):
        return (
            f"SELECT doc_id, {o1} AS o1, {o2} AS o2, {detector} AS detector, {match} AS match, "
            f"{ctx('d.text', 'x.s', 'x.e')} AS context, {penalty} AS penalty, x.s AS start_pos, {end} AS end_pos, {scored} AS scored "
            f"FROM {spans} x JOIN docs d USING (doc_id) WHERE {where}"
        )

    def doc_hit(self, source, detector, match, context, penalty, where, o1="0", o2="0"):
        return (
            f"SELECT doc_id, {o1} AS o1, {o2} AS o2, {q(detector)} AS detector, {q(match)} AS match, "
            f"{context} AS context, {penalty} AS penalty, 0 AS start_pos, length(d.text) AS end_pos, TRUE AS scored "
            f"FROM {source} m JOIN docs d USING (doc_id) WHERE {where}"
        )

    def slop_words(self):
        self.code()
        alternatives = "|".join(L.words)
        self.spans("sw", "views", "masked", f"(?i)\\b(?:{alternatives})\\b")
        name = "[A-Z][a-z]+(?:['-][A-Z][a-z]+)*"
        before = f"(?:^|[^\\p{{L}}'.-]){name}{SP}*\\z"
        after = f"^{SP}*(?:{name}|[A-Z]\\.)(?:[^\\p{{L}}'.-]|\\z)"
        plain = ", ".join(q(w) for w in L.words if "-" not in w)
        compound = " OR ".join(f"contains(lower(masked), {q(w)})" for w in L.words if "-" in w)
        self.add(
            "sw_gate",
            f"""SELECT doc_id FROM views WHERE list_has_any(regexp_extract_all(lower(masked), {rx(W + '+')}), [{plain}])
            OR {compound}""",
        )
        where = (
            "doc_id IN (SELECT doc_id FROM sw_gate) AND NOT (regexp_matches(x.match, '^\\p{Lu}') AND "
            f"({like('left(d.text, x.s)', before)} OR {like('substring(d.text, x.e + 1)', after)}))"
        )
        return self.hits(
            "slop_words",
            [self.text_hits("sw", "0", "x.i", "'word'", T.slop_word__penalty, "lower(x.match)", where=where)],
            "o2",
        )

    def slop_phrases(self):
        self.phrases("sp", L.stock_phrases)
        self.spans("nj", "docs", "text", f"(?i)not (?:just|only) {ANY}{{1,40}}, but (?:also )?")
        tokens = f"regexp_extract_all(lower(d.text), {rx(W + '+')})"
        return self.hits(
            "slop_phrases",
            [
                self.text_hits("sp", "x.ord", "x.i", "'stock_phrase'", T.slop_phrase__penalty),
                self.text_hits(
                    "nj", "1000", "x.i", "'not_just'", T.slop_phrase__penalty, "lower(trim(x.match))",
                    "x.s + length(trim(x.match))",
                    f"list_contains({tokens}, 'not') AND list_contains({tokens}, 'but')",
                ),
            ],
            "o1, o2",
        )

    def structural(self):
        self.lines()
        self.add("bh", f"SELECT doc_id, {count('text', chr(92)+'*'+chr(92)+'*[^*]+[.:]'+chr(92)+'*'+chr(92)+'*'+SP+'+'+NS)} AS n FROM docs")
        self.run_lengths("br", BULLET)
        self.spans("tri", "docs", "text", f"(?i){W}+, {W}+, and {W}+")
        return self.hits(
            "structural",
            [
                self.doc_hit("bh", "bold_headers", "bold_header_explanation",
                             context("bold_headers", "n"),
                             T.structural__bold_header_penalty, f"n >= {T.structural__bold_header_min}"),
                self.doc_hit("br", "bullet_run", "excessive_bullets",
                             context("bullet_run", "n"),
                             T.structural__bullet_run_penalty, f"n >= {T.structural__bullet_run_min}",
                             "1", "first"),
                self.text_hits("tri", "2", "x.i", "'triad'", T.structural__triad_penalty, "'triadic'",
                               scored=f"x.i <= {T.structural__triad_cap} + 1"),
            ],
            "o1, o2",
        )

    def run_lengths(self, name: str, pattern: str):
        """Maximal runs of matching lines, by gaps and islands."""
        self.lines()
        return self.add(
            name,
            f"""SELECT doc_id, min(line_no) AS first, count(*) AS n FROM (
            SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g
            FROM lines WHERE {like('line', pattern)}) GROUP BY doc_id, g""",
        )

    def tone(self):
        self.phrases("ap", L.assistant_phrases)
        self.phrases("fn", L.false_narrativity)
        branches = [
            self.text_hits("ap", "x.ord", "x.i", "'assistant_phrase'", T.tone__phrase_penalty),
            self.text_hits("fn", "100 + x.ord", "x.i", "'false_narrativity'", T.tone__phrase_penalty),
        ]
        for i, word in enumerate(("certainly", "absolutely")):
            self.spans(f"op{i}", "docs", "text", f"(?i)(?:(?m:^)|[.!?]{SP}+){word}[,! ]")
            branches.append(
                self.text_hits(f"op{i}", f"{200 + i}", "x.i", "'opener'", T.tone__opener_penalty, q(word))
            )
        return self.hits("tone", branches, "o1, o2")

    def weasel(self):
        self.phrases("we", L.weasel_phrases)
        return self.hits(
            "weasel", [self.text_hits("we", "x.ord", "x.i", "'weasel_phrase'", T.weasel__penalty)], "o1, o2"
        )

    def ai_disclosure(self):
        self.phrases("di", L.disclosures)
        self.spans("cu", "docs", "text", "(?i)\\bas of my (?:last |knowledge )?cutoff\\b")
        self.spans("ja", "docs", "text", "(?i)\\bi'm just an? ai\\b")
        p = T.ai_disclosure__penalty
        return self.hits(
            "ai_disclosure",
            [
                self.text_hits("di", "x.ord", "x.i", "'disclosure'", p),
                self.text_hits("cu", "100", "x.i", "'cutoff'", p, "lower(x.match)"),
                self.text_hits("ja", "101", "x.i", "'just_ai'", p, "lower(x.match)"),
            ],
            "o1, o2",
        )

    def placeholder(self):
        kinds = "|".join(f"\\[{k} [^\\]]*\\]" for k in ("insert", "describe", "url", "your"))
        self.spans("ph", "docs", "text", f"(?i)(?:{kinds}|\\[todo[^\\]]*\\])")
        return self.hits(
            "placeholder",
            [self.text_hits("ph", "0", "x.i", "'placeholder'", T.placeholder__penalty, "lower(x.match)")],
            "o2",
        )

    def rhythm(self):
        self.sentences()
        self.add(
            "rh",
            """SELECT doc_id, count(*) AS n, avg(n_words) AS mean, stddev_pop(n_words) / avg(n_words) AS cv
            FROM sents GROUP BY doc_id""",
        )
        return self.hits(
            "rhythm",
            [self.doc_hit("rh", "rhythm", "monotonous_rhythm",
                          context("rhythm", fixed("cv", 2), "n", fixed("mean", 1)),
                          T.rhythm__penalty, f"n >= {T.rhythm__min_sentences} AND cv < {T.rhythm__cv_below}")],
            "o1",
        )

    def em_dash(self):
        self.code()
        self.add(
            "em",
            f"""SELECT doc_id, n, word_count, n / word_count::DOUBLE * 150 AS ratio FROM (
            SELECT doc_id, word_count, {count('text', chr(92) + 'x{2014}| -- ')} AS n FROM views WHERE word_count > 0)""",
        )
        return self.hits(
            "em_dash",
            [self.doc_hit("em", "em_dash", "em_dash_density",
                          context("em_dash", "n", "word_count", fixed("ratio", 1)),
                          T.em_dash__penalty, f"ratio > {T.em_dash__ratio_above}")],
            "o1",
        )

    def contrast_pairs(self):
        self.spans("xn", "docs", "text", f"{W}+, not {W}+")
        self.spans(
            "st", "docs", "text",
            "(?i)\\bnot (?:only|just|merely)\\b[^.!?\\n]{1,80}?\\bbut(?: also)?\\b[^.!?\\n,;:]{1,80}?(?:[,.;:!?\\n]|\\z)",
        )
        # The closing mark is not part of a staged match.
        self.add(
            "cp",
            f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, kind) AS i FROM (
            SELECT doc_id, s, e, 'x_not_y' AS kind, match FROM xn UNION ALL
            SELECT doc_id, s, CAST(s + length(m) AS INTEGER), 'staged_contrast', {trim('m')} FROM (
              SELECT doc_id, s, regexp_replace(match, '[,.;:!?\\n]$', '') AS m FROM st))""",
        )
        return self.hits(
            "contrast_pairs",
            [self.text_hits("cp", "0", "x.i", "x.kind", T.contrast_pair__penalty, end="x.s + length(x.match)",
                            scored=f"x.i <= {T.contrast_pair__cap}")],
            "o2",
        )

    def intrasentence_keyword_bold(self):
        self.code()
        self.spans("kb", "views", "masked", "\\*\\*[^*\\n]+?\\*\\*")
        inner = "substring(x.match, 3, length(x.match) - 4)"
        head = "left(v.masked, x.s)"
        signs = f"{WS}$%\\x{{20ac}}\\x{{a3}}\\x{{a5}}+.,\\-"
        line_head = "regexp_extract(left(v.text, x.s), '[^\\n]*\\z')"
        last = "right({}, 1)"
        stripped = f"regexp_replace({head}, '[ \\t\\r]+\\z', '')"
        again = f"regexp_replace(left({stripped}, length({stripped}) - 1), '[ \\t\\r]+\\z', '')"
        opens = (
            f"({stripped} = '' OR {last.format(stripped)} IN ('.', '!', '?') OR ({last.format(stripped)} = chr(10) AND "
            f"({again} = '' OR {last.format(again)} IN (chr(10), '.', '!', '?'))))"
        )
        self.add(
            "kbs",
            f"""SELECT x.doc_id, x.s, x.e, substring(v.text, x.s + 1, x.e - x.s) AS match,
              row_number() OVER (PARTITION BY x.doc_id ORDER BY x.s) AS i
            FROM kb x JOIN views v USING (doc_id)
            WHERE NOT ({like(inner, '[:.]$')} AND {like('substring(v.masked, x.e + 1)', f'^{SP}+{NS}')})
              AND NOT {like(inner, f'^[{signs}]*[0-9][0-9{signs}]*[%a-zA-Z]{{0,4}}$')}
              AND {count(inner, W + '+')} <= {T.intrasentence_keyword_bold__max_words}
              AND NOT {like(line_head, f'^{SP}*(?:#|>|[-*]{SP}|[0-9]+[.)]{SP})')}
              AND NOT {opens}""",
        )
        return self.hits(
            "intrasentence_keyword_bold",
            [self.text_hits("kbs", "0", "x.i", "'keyword_bold'", T.intrasentence_keyword_bold__penalty,
                            scored=f"x.i <= {T.intrasentence_keyword_bold__cap}")],
            "o2",
        )

    def setup_resolution(self):
        s = SP
        plain_not = "|".join(f"{v}{s}+not" for v in
                             ("is", "are", "was", "were", "does", "do", "did", "has", "have", "will", "could", "should"))
        negated = ("isn't|aren't|wasn't|weren't|doesn't|don't|didn't|hasn't|haven't|won't|can't|couldn't|shouldn't|"
                   f"{plain_not}|cannot")
        short = "it's|they're|that's|he's|she's|we're"
        ends = "|".join(f"{a}{s}+{b}" for a, b in (
            ("it", "is"), ("they", "are"), ("that", "is"), ("this", "is"), ("these", "are"), ("those", "are"),
            ("what", "is"), ("the", "real"), ("the", "actual"))) + "|what's|instead|rather"
        ends_a = ends + "|" + "|".join(f"{a}{s}+{b}" for a, b in (("he", "is"), ("she", "is"), ("we", "are")))
        self.spans("sa", "docs", "text",
                   f"(?i)\\b(?:this|that|these|those|it|they|we){s}+(?:{negated})\\b{ANY}{{0,80}}[.;:,]{s}*(?:{short}|{ends_a})")
        self.spans("sb", "docs", "text",
                   f"(?i)\\b(?:{short}|this{s}+is){s}+not\\b{ANY}{{0,80}}[.;:,]{s}*(?:{short}|{ends})")
        self.add(
            "su",
            f"""SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY o, s) AS i FROM (
            SELECT doc_id, 0 AS o, s, e, match FROM sa UNION ALL
            SELECT doc_id, 1, s, e, match FROM sb WHERE NOT EXISTS (
              SELECT 1 FROM sa WHERE sa.doc_id = sb.doc_id AND sa.s = sb.s AND sa.e = sb.e)) x
            JOIN docs d USING (doc_id) WHERE contains(lower(d.text), 'n''t') OR
              list_has_any(regexp_extract_all(lower(d.text), {rx(W + '+')}), ['not', 'cannot'])""",
        )
        return self.hits(
            "setup_resolution",
            [self.text_hits("su", "0", "x.i", "'setup'", T.setup_resolution__penalty,
                            scored=f"x.i <= {T.setup_resolution__cap}")],
            "o2",
        )

    def colon_density(self):
        self.code()
        self.lines("views", "unfenced", "ulines")
        found = f"regexp_extract_all(line, {rx('(?:https?)?: (?:true|false|null|[a-z])')})"
        self.add(
            "co",
            f"""SELECT doc_id, n, w, n / w::DOUBLE * 150 AS ratio FROM (
            SELECT doc_id, CAST(sum(len(list_filter({found}, lambda x: starts_with(x, ': ') AND length(x) = 3))) AS INTEGER) AS n
            FROM ulines WHERE NOT {like('line', f'^{SP}*#')} GROUP BY doc_id)
            JOIN (SELECT doc_id, {words('unfenced')} AS w FROM views) USING (doc_id) WHERE w > 0""",
        )
        return self.hits(
            "colon_density",
            [self.doc_hit("co", "colon_density", "colon_density",
                          context("colon_density", "n", "w", fixed("ratio", 1)),
                          T.colon_density__penalty, f"ratio > {T.colon_density__ratio_above}")],
            "o1",
        )

    def pithy_fragment(self):
        self.sentences()
        cap = T.pithy_fragment__cap
        self.add(
            "pi_all",
            f"""SELECT doc_id, sentence, sent_no, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS i,
              row_number() OVER (PARTITION BY doc_id, lower(sentence) ORDER BY sent_no) AS nth
            FROM sents WHERE n_words <= {T.pithy_fragment__max_words}
              AND {like('sentence', f'(?i),{SP}+(?:but|yet|and|not|or)' + chr(92) + 'b')}""",
        )
        # Of those that weigh, the nth literal occurrence of the sentence in the text, else the first.
        self.add(
            "pi",
            f"""SELECT doc_id, sentence AS match, i, CAST(list_sum([length(x) FOR x IN ps[1:k]]) + (k - 1) * length(sentence) AS INTEGER) AS s,
              length(sentence) AS n FROM (
            SELECT *, CASE WHEN nth < len(ps) THEN nth ELSE 1 END AS k FROM (
              SELECT p.*, string_split(lower(d.text), lower(sentence)) AS ps FROM pi_all p JOIN docs d USING (doc_id) WHERE i <= {cap}))""",
        )
        # The others by the lengths of all pieces up to and with their ends.
        self.add(
            "pi_places",
            f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_no, before + indent AS s FROM (
              SELECT doc_id, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                length(piece) - length(regexp_replace(piece, {rx(f'^{SP}+')}, '')) AS indent
              FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (
                SELECT doc_id, string_split(regexp_replace(text, {rx(SENT)}, '\\0' || chr(1), 'g'), chr(1)) AS ps FROM docs
                WHERE doc_id IN (SELECT doc_id FROM pi_all WHERE i > {cap}))))
            WHERE {words(f"regexp_replace(piece, {rx(SENT[:-len(f'(?:{SP}|{chr(92)}z)')] + f'{SP}?{chr(92)}z')}, '')")} > 0""",
        )
        return self.hits(
            "pithy_fragment",
            [f"""SELECT doc_id, 0 AS o1, i AS o2, 'pithy' AS detector, match, match AS context,
              {T.pithy_fragment__penalty} AS penalty, s AS start_pos, s + n AS end_pos, TRUE AS scored
            FROM pi""",
             f"""SELECT doc_id, 0, i, 'pithy', sentence, sentence, {T.pithy_fragment__penalty}, s, s + length(sentence), FALSE
            FROM pi_all JOIN pi_places USING (doc_id, sent_no) WHERE i > {cap}"""],
            "o2",
        )

    def line_measure(self, name: str, body: str):
        self.lines()
        return self.add(name, body)

    def bullet_density(self):
        self.line_measure(
            "bd",
            f"""SELECT doc_id, b, n, b / n::DOUBLE AS ratio FROM (SELECT doc_id,
              count(*) FILTER ({like('line', BULLET)}) AS b, count(*) FILTER ({trim('line')} <> '') AS n
            FROM lines GROUP BY doc_id) WHERE n > 0""",
        )
        return self.hits(
            "bullet_density",
            [self.doc_hit("bd", "bullet_density", "bullet_density",
                          context("bullet_density", "b", "n", percent("ratio")),
                          T.bullet_density__penalty, f"ratio > {T.bullet_density__ratio_above}")],
            "o1",
        )

    def blockquote_density(self):
        self.line_measure(
            "bq",
            f"""SELECT doc_id, count(*) AS n FROM (SELECT *, sum(CAST(t AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS k
            FROM (SELECT *, starts_with({trim('line')}, '```') AS t FROM lines))
            WHERE NOT t AND k % 2 = 0 AND starts_with(line, '>') GROUP BY doc_id""",
        )
        step, free, cap = T.blockquote_density__penalty_step, T.blockquote_density__free_lines, T.blockquote_density__cap
        return self.hits(
            "blockquote_density",
            [self.doc_hit("bq", "blockquote_density", "blockquote_density",
                          context("blockquote_density", "n"),
                          f"{step} * least(n - {free}, {cap})", f"n >= {T.blockquote_density__min_lines}")],
            "o1",
        )

    def bold_bullet_list(self):
        self.run_lengths("bb", BOLD_BULLET)
        return self.hits(
            "bold_bullet_list",
            [self.doc_hit("bb", "bold_bullet_run", "bold_bullet_list", context("bold_bullet_run", "n"),
                          T.bold_bullet_list__penalty, f"n >= {T.bold_bullet_list__min_run}", "0", "first")],
            "o2",
        )

    def horizontal_rules(self):
        self.line_measure("hr", f"SELECT doc_id, count(*) AS n FROM lines WHERE {like('line', HR)} GROUP BY doc_id")
        return self.hits(
            "horizontal_rules",
            [self.doc_hit("hr", "horizontal_rules", "horizontal_rules",
                          context("horizontal_rules", "n"),
                          T.horizontal_rules__penalty, f"n >= {T.horizontal_rules__min_count}")],
            "o1",
        )

    def ngram_tokens(self) -> str:
        edge = f"^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+\\z"
        return self.add(
            "toks",
            f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {rx(NS + '+')}),
              lambda x: lower(regexp_replace(x, {rx(edge)}, '', 'g'))), lambda x: x <> '') AS t FROM docs""",
        )

    def repeated(self) -> str:
        self.ngram_tokens()
        lo, hi = T.phrase_reuse__min_n, T.phrase_reuse__max_n
        self.add(
            "tokrows", "SELECT doc_id, unnest(t) AS w0, generate_subscripts(t, 1) - 1 AS pos FROM toks"
        )
        leads = ", ".join(f"lead(w0, {k}) OVER w AS w{k}" for k in range(1, hi))
        self.add(
            "tokleads",
            f"SELECT *, {leads} FROM tokrows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
        )
        sizes = " UNION ALL ".join(
            f"SELECT doc_id, {n} AS n, {' || chr(32) || '.join(f'w{k}' for k in range(n))} AS gram, pos "
            f"FROM tokleads WHERE w{n - 1} IS NOT NULL"
            for n in range(lo, hi + 1)
        )
        self.add(
            "grams",
            f"""SELECT doc_id, n, gram, count(*) AS c, min(pos) AS first FROM ({sizes})
            GROUP BY doc_id, n, gram HAVING count(*) >= {T.phrase_reuse__min_count}""",
        )
        return self.add(
            "reuse",
            """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c DESC, first) AS i FROM grams a
            WHERE NOT EXISTS (SELECT 1 FROM grams b WHERE a.doc_id = b.doc_id AND b.n > a.n AND b.c >= a.c
              AND contains(' ' || b.gram || ' ', ' ' || a.gram || ' '))""",
        )

    def phrase_reuse(self):
        self.repeated()
        where = "strpos(lower(d.text), gram)"
        return self.hits(
            "phrase_reuse",
            [f"""SELECT doc_id, 0 AS o1, i AS o2, 'repeated_ngram' AS detector, gram AS match,
              {context("repeated_ngram", "gram", "n", "c")} AS context,
              {T.phrase_reuse__penalty} AS penalty,
              CASE WHEN {where} > 0 THEN {where} - 1 ELSE 0 END AS start_pos,
              CASE WHEN {where} > 0 THEN {where} - 1 + length(gram) ELSE length(d.text) END AS end_pos, i <= {T.phrase_reuse__cap} AS scored
            FROM reuse JOIN docs d USING (doc_id)"""],
            "o2",
        )

    def copula_chain(self):
        self.sentences()
        first = f"array_to_string(list_slice(regexp_extract_all(sentence, {rx(NS + '+')}), 1, 6), ' ')"
        self.add(
            "cc",
            f"""SELECT doc_id, n, k, k / n::DOUBLE AS share FROM (SELECT doc_id, count(*) AS n,
              count(*) FILTER ({like(first, '(?i)' + chr(92) + 'b(?:is|are|was|were)' + chr(92) + 'b')}) AS k FROM sents GROUP BY doc_id)""",
        )
        return self.hits(
            "copula_chain",
            [self.doc_hit("cc", "copula_chain", "copula_density",
                          context("copula_chain", "k", "n", percent("share")),
                          T.copula_chain__penalty,
                          f"n >= {T.copula_chain__min_sentences} AND share >= {T.copula_chain__share_from}")],
            "o1",
        )

    def extreme_sentence(self):
        self.collapsed()
        self.sentences("collapsed", "text", "lsents")
        view = "'\"' || CASE WHEN length(sentence) > 80 THEN left(sentence, 80) || '...' ELSE sentence END || '\"'"
        lo = T.extreme_sentence__min_words
        return self.hits(
            "extreme_sentence",
            [self.doc_hit("lsents", "extreme_sentence", "run_on_sentence",
                          context("extreme_sentence", "(sent_no + 1)", "n_words", f"({view})"),
                          T.extreme_sentence__penalty, f"n_words >= {lo}", "0", "sent_no")],
            "o2",
        )

    def closing_aphorism(self):
        self.sentences()
        b = "\\b"
        forms = [
            f"(?i)^sometimes{b}", f"(?i){b}isn't{b}{ANY}{{1,40}}{b}it's{b}",
            f"(?i){b}not{b}{ANY}{{1,30}}{b}it's{b}{ANY}{{1,40}}\\z",
            f"(?i)^the (?:real|true|actual|biggest|greatest|most important){b}",
            f"(?i)^(?:in the end|ultimately|at the end of the day){b}",
            f"(?i){b}we (?:bring|carry|create|make|build|choose){b}",
            "(?i)^that's (?:the |what |where |why |how )", f"(?i)^it (?:all )?(?:comes|boils) down to{b}",
        ]
        total = " + ".join(f"CAST({like('last', p)} AS INTEGER)" for p in forms)
        self.add(
            "ca",
            f"""SELECT *, {total} AS k FROM (SELECT doc_id, count(*) AS n, arg_max(sentence, sent_no) AS last FROM sents GROUP BY doc_id)""",
        )
        view = "'\"' || CASE WHEN length(last) > 80 THEN left(last, 80) || '...' ELSE last END || '\"'"
        return self.hits(
            "closing_aphorism",
            [self.doc_hit("ca", "closing_aphorism", "closing_aphorism",
                          context("closing_aphorism", "k", f"({view})"),
                          T.closing_aphorism__penalty,
                          f"n >= {T.closing_aphorism__min_sentences} AND k >= {T.closing_aphorism__min_forms}")],
            "o1",
        )

    def paragraphs(self) -> str:
        raw = f"regexp_split_to_array(text, {rx(f'{chr(92)}n{SP}*{chr(92)}n')})"
        return self.add(
            "paras",
            f"""SELECT doc_id, unnest(l) AS n_words, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS para_no FROM (
            SELECT doc_id, list_filter(list_transform({raw}, lambda x: {words('x')}), lambda x: x > 0) AS l FROM docs)""",
        )

    def paragraph_balance(self):
        self.paragraphs()
        self.add(
            "pb",
            """SELECT doc_id, count(*) AS n, min(n_words) FILTER (para_no > 0) / (max(n_words) FILTER (para_no > 0))::DOUBLE AS ratio,
              string_agg(n_words, ', ' ORDER BY para_no) FILTER (para_no > 0) AS body FROM paras GROUP BY doc_id""",
        )
        return self.hits(
            "paragraph_balance",
            [self.doc_hit("pb", "paragraph_balance", "paragraph_balance",
                          context("paragraph_balance", "body", fixed("ratio", 2)),
                          T.paragraph_balance__penalty,
                          f"n >= {T.paragraph_balance__min_body} + 1 AND ratio > {T.paragraph_balance__ratio_above}")],
            "o1",
        )

    def paragraph_cv(self):
        self.paragraphs()
        self.add(
            "pc",
            """SELECT doc_id, count(*) AS n, stddev_pop(n_words) / avg(n_words) AS cv,
              string_agg(n_words, ', ' ORDER BY para_no) AS sizes FROM paras GROUP BY doc_id""",
        )
        return self.hits(
            "paragraph_cv",
            [self.doc_hit("pc", "paragraph_cv", "paragraph_cv",
                          context("paragraph_cv", "sizes", fixed("cv", 2)),
                          T.paragraph_cv__penalty,
                          f"n >= {T.paragraph_cv__min_paragraphs} AND cv < {T.paragraph_cv__cv_below}")],
            "o1",
        )

    # --- everything together ------------------------------------------------------
    def all_hits(self) -> str:
        """Every rule's hits with rule name and order."""
        self.code()
        for _, key in RULES:
            getattr(self, key)()
        union = " UNION ALL ".join(
            f"SELECT {i} AS rule_order, {q(rule)} AS rule, * FROM h_{key}" for i, (rule, key) in enumerate(RULES)
        )
        return self.add(
            "all_hits",
            f"""SELECT u.doc_id, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY rule_order, u.seq) - 1 AS INTEGER) AS seq,
              rule, CAST(rule_order AS INTEGER) AS rule_order, detector, match, context, penalty, start_pos, end_pos, scored
            FROM ({union}) u JOIN views v ON v.doc_id = u.doc_id AND v.word_count >= {config.MIN_WORDS}""",
        )

    def counts(self) -> str:
        """One row per document and count key."""
        self.all_hits()
        uncapped = {
            "intrasentence_keyword_bold": "kbs", "setup_resolution": "su", "pithy_fragment": "pi_all",
        }
        union = " UNION ALL ".join(
            f"SELECT doc_id, {q(key)} AS count_key FROM {uncapped.get(key, f'h_{key} WHERE scored')}" for _, key in RULES
        )
        keys = ", ".join(f"({q(key)})" for _, key in RULES)
        return self.add(
            "counts",
            f"""SELECT v.doc_id, k.count_key, CAST(CASE WHEN v.word_count >= {config.MIN_WORDS} THEN count(u.doc_id) ELSE 0 END AS INTEGER) AS n
            FROM views v CROSS JOIN (VALUES {keys}) AS k(count_key)
            LEFT JOIN ({union}) u ON u.doc_id = v.doc_id AND u.count_key = k.count_key
            GROUP BY v.doc_id, v.word_count, k.count_key""",
        )

    def scores(self) -> str:
        self.counts()
        amplified = {"contrast_pair": "contrast_pairs", "pithy_fragment": "pithy_fragment",
                     "setup_resolution": "setup_resolution"}
        arms = " ".join(f"WHEN {q(r)} THEN {q(k)}" for r, k in amplified.items())
        self.add(
            "weights",
            f"""SELECT h.doc_id, sum(penalty) AS total, sum(abs(penalty) *
              CASE WHEN c.n > 1 THEN 1 + {config.CONCENTRATION} * (c.n - 1) ELSE 1 END)::DOUBLE AS weighted
            FROM (SELECT *, CASE rule {arms} END AS amp FROM all_hits WHERE scored) h
            LEFT JOIN counts c ON c.doc_id = h.doc_id AND c.count_key = h.amp GROUP BY h.doc_id""",
        )
        self.add(
            "densities",
            f"""SELECT v.doc_id, v.word_count, coalesce(w.total, 0) AS total, coalesce(w.weighted, 0::DOUBLE) AS weighted,
              CASE WHEN v.word_count >= {config.MIN_WORDS} THEN coalesce(w.weighted, 0::DOUBLE) / (v.word_count / 1000.0::DOUBLE) ELSE 0::DOUBLE END AS density
            FROM views v LEFT JOIN weights w USING (doc_id)""",
        )
        raw = f"100 * exp(-{config.DECAY}::DOUBLE * density)"
        self.add(
            "scored",
            f"SELECT *, CAST(greatest(0, least(100, {half_even(raw)})) AS INTEGER) AS score FROM densities",
        )
        arms = " ".join(f"WHEN score >= {lo} THEN {q(name)}" for name, lo in config.BANDS)
        two = lambda x: f"{half_even(f'{x} * 100.0::DOUBLE')} / 100.0::DOUBLE"
        return self.add(
            "scores",
            f"""SELECT doc_id, word_count, CAST(total AS INTEGER) AS total_penalty, {two('weighted')} AS weighted_sum,
              {two('density')} AS density, score, 100 - score AS slop, CASE {arms} END AS band FROM scored""",
        )


RULES = (
    ("slop_word", "slop_words"), ("slop_phrase", "slop_phrases"), ("structural", "structural"),
    ("tone", "tone"), ("weasel", "weasel"), ("ai_disclosure", "ai_disclosure"),
    ("placeholder", "placeholder"), ("rhythm", "rhythm"), ("em_dash", "em_dash"),
    ("contrast_pair", "contrast_pairs"),
    ("intrasentence_keyword_bold", "intrasentence_keyword_bold"),
    ("setup_resolution", "setup_resolution"), ("colon_density", "colon_density"),
    ("pithy_fragment", "pithy_fragment"), ("bullet_density", "bullet_density"),
    ("blockquote_density", "blockquote_density"), ("bold_bullet_list", "bold_bullet_list"),
    ("horizontal_rules", "horizontal_rules"), ("phrase_reuse", "phrase_reuse"),
    ("copula_chain", "copula_chain"), ("extreme_sentence", "extreme_sentence"),
    ("closing_aphorism", "closing_aphorism"), ("paragraph_balance", "paragraph_balance"),
    ("paragraph_cv", "paragraph_cv"),
)
