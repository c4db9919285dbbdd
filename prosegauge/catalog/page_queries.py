"""Queries over web pages and laid-out text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.catalog import sql as S
from prosegauge.catalog.fixtures import documents_of
from prosegauge.catalog.registry import query
from prosegauge.catalog.sql import SP, Sql
from prosegauge.functions.text import chars_at, spans, text_chunks
from prosegauge.operators import layout
from prosegauge.operators import pages as P
from prosegauge.plans import scoring
from prosegauge.sources.tables import load_pages, parts_by_size

NAMES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


class PageSql(Sql):
    """The page tables in SQL: elements are matched and measured by joins."""

    def __init__(self):
        self.parts = {}
        raw = "|".join(f"<{t}\\b[^>]*>(?s:.*?)(?:</{t}[^>]*>|\\z)" for t in P.RAW_TAGS)
        token = (
            f"(?i)<!--(?s:.*?)(?:-->|\\z)|<[!?][^>]*>?|{raw}"
            "|</?[a-z](?:[^>\"']+|\"[^\"]*\"|'[^']*')*>|[^<]+|<"
        )
        decoded = "raw"
        for name, char in NAMES.items():
            decoded = f"replace({decoded}, {S.q(name)}, {S.q(char)})"
        self.add(
            "raw",
            f"""SELECT page_id, unnest(l) AS raw, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS seq
            FROM (SELECT page_id, regexp_extract_all(html, {S.rx(token)}) AS l FROM pages WHERE regexp_matches(url, '^https?:'))""",
        )
        listed = lambda names: ", ".join(S.q(n) for n in names)
        self.add(
            "kinds",
            f"""SELECT *, CASE WHEN starts_with(raw, '<!') OR starts_with(raw, '<?') THEN 'comment'
              WHEN regexp_matches(raw, '^</[a-zA-Z]') THEN 'close' WHEN NOT regexp_matches(raw, '^<[a-zA-Z]') THEN 'text'
              WHEN tag0 IN ({listed(P.RAW_TAGS)}) THEN 'raw' WHEN tag0 IN ({listed(P.VOID_TAGS)}) THEN 'void' ELSE 'open' END AS kind
            FROM (SELECT *, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag0 FROM raw)""",
        )
        block = listed(P.BLOCK_TAGS + P.HEADINGS + P.OTHER_BOUNDARIES)
        self.add(
            "tokens",
            f"""SELECT page_id, seq, kind, CASE WHEN kind IN ('text', 'comment') THEN '' ELSE tag0 END AS tag,
              CASE WHEN kind IN ('open', 'void') THEN regexp_extract(raw, '^<[a-zA-Z0-9-]+\\s*((?s:.*?))/?>$', 1) ELSE '' END AS attrs,
              CASE WHEN kind = 'text' THEN {decoded} ELSE '' END AS text,
              CAST(coalesce(sum(length(raw)) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS src_start,
              tag0 IN ({block}) AND kind IN ('open', 'close', 'void') AS boundary
            FROM kinds""",
        )

    def elements(self) -> str:
        self.add(
            "depths",
            """SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY seq) AS depth
            FROM tokens""",
        )
        soft = ", ".join(S.q(t) for t in P.SOFT_TAGS)
        # The closing tag is the first that brings the depth of the tag below the element's.
        self.add(
            "ends",
            f"""SELECT o.page_id, o.seq, o.tag, o.attrs, c.close IS NOT NULL AS closed, coalesce(c.close,
              CASE WHEN o.tag IN ({soft}) THEN b.next - 1 END, l.last) AS end_seq
            FROM depths o
            LEFT JOIN (SELECT o.page_id, o.seq, min(c.seq) AS close FROM depths o JOIN depths c ON c.page_id = o.page_id AND c.tag = o.tag
              AND c.kind = 'close' AND c.seq > o.seq AND c.depth = o.depth - 1 WHERE o.kind = 'open' GROUP BY ALL) c USING (page_id, seq)
            LEFT JOIN (SELECT o.page_id, o.seq, min(t.seq) AS next FROM tokens o JOIN tokens t ON t.page_id = o.page_id AND t.seq > o.seq AND t.boundary
              WHERE o.kind = 'open' GROUP BY ALL) b USING (page_id, seq)
            JOIN (SELECT page_id, max(seq) AS last FROM tokens GROUP BY page_id) l USING (page_id)
            WHERE o.kind = 'open'""",
        )
        self.add(
            "lengths",
            f"""SELECT e.*, CAST(length({S.trim("coalesce(string_agg(t.text, '' ORDER BY t.seq), '')")}) AS INTEGER) AS text_len
            FROM ends e LEFT JOIN tokens t ON t.page_id = e.page_id AND t.seq BETWEEN e.seq AND e.end_seq GROUP BY ALL""",
        )
        return self.add(
            "elements",
            """SELECT e.*, CAST(coalesce(sum(a.text_len), 0) AS INTEGER) AS link_len FROM lengths e LEFT JOIN lengths a
              ON a.page_id = e.page_id AND a.tag = 'a' AND a.seq > e.seq AND a.seq <= e.end_seq GROUP BY ALL""",
        )

    def credits(self) -> str:
        self.elements()
        self.add(
            "pays",
            f"""SELECT b.page_id, a.seq, b.seq AS block, b.text_len AS n, row_number() OVER (PARTITION BY b.page_id, b.seq ORDER BY a.seq DESC) AS up
            FROM elements b JOIN elements a ON a.page_id = b.page_id AND a.seq < b.seq AND a.end_seq >= b.seq AND a.tag NOT IN ('html', 'body', 'head')
            WHERE b.tag IN ('p', 'li', 'blockquote') AND b.text_len >= {P.MIN_PARAGRAPH_CHARS}""",
        )
        return self.add(
            "credits",
            f"""SELECT c.page_id, c.seq, e.end_seq, e.tag, CASE WHEN e.text_len = 0 THEN 1.0 ELSE e.link_len / e.text_len::DOUBLE END AS density, score, first
            FROM (SELECT page_id, seq, sum(n / up::DOUBLE) AS score, min(block * 6 + up) AS first FROM pays WHERE up <= {P.ANCESTORS} GROUP BY ALL) c
            JOIN elements e USING (page_id, seq)""",
        )

    def roots(self) -> str:
        self.credits()
        self.add(
            "semantic",
            f"""SELECT page_id, seq, end_seq, tag FROM elements WHERE tag = 'article'
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) = 1 AND text_len >= {P.MIN_ROOT_CHARS}""",
        )
        self.add(
            "best",
            f"""SELECT page_id, seq, end_seq, tag FROM (SELECT * FROM credits WHERE density <= {P.MAX_LINK_DENSITY}
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, first) = 1) WHERE score >= {P.MIN_CANDIDATE_SCORE}""",
        )
        return self.add(
            "roots",
            """SELECT e.page_id, coalesce(s.seq, b.seq, e.seq) AS root_seq, coalesce(s.end_seq, b.end_seq, e.end_seq) AS root_end,
              coalesce(s.tag, b.tag, e.tag) AS root_tag,
              CASE WHEN s.seq IS NOT NULL THEN 'semantic' WHEN b.seq IS NOT NULL THEN 'scored' ELSE 'body' END AS how
            FROM elements e LEFT JOIN semantic s USING (page_id) LEFT JOIN best b USING (page_id) WHERE e.tag = 'body'""",
        )

    def visible(self) -> str:
        skip = ", ".join(S.q(t) for t in P.SKIP_TAGS + ("head", "title"))
        self.elements()
        return self.add(
            "visible",
            f"""SELECT t.* FROM tokens t WHERE NOT (t.kind IN ('raw', 'void') AND t.tag IN ({skip}))
            AND NOT EXISTS (SELECT 1 FROM elements e WHERE e.page_id = t.page_id AND e.tag IN ({skip}) AND t.seq BETWEEN e.seq AND e.end_seq)""",
        )

    def markdown(self) -> str:
        self.roots()
        self.visible()
        blocks = ", ".join(S.q(t) for t in P.BLOCK_TAGS)
        self.add(
            "article",
            """SELECT v.*, e.closed, c.seq IS NOT NULL AS matched, sum(CASE WHEN v.boundary THEN 1 ELSE 0 END) OVER (PARTITION BY v.page_id ORDER BY v.seq) AS segment
            FROM visible v JOIN roots r ON r.page_id = v.page_id AND v.seq BETWEEN r.root_seq AND r.root_end
            LEFT JOIN elements e ON e.page_id = v.page_id AND e.seq = v.seq
            LEFT JOIN elements c ON c.page_id = v.page_id AND c.end_seq = v.seq AND c.closed AND c.tag = v.tag""",
        )
        self.add(
            "pieces",
            f"""SELECT page_id, seq, CASE WHEN kind = 'text' THEN text WHEN tag = 'br' THEN chr(1)
              WHEN tag = 'h1' AND kind = 'open' THEN chr(2) || '# ' WHEN tag = 'h1' THEN chr(2)
              WHEN tag = 'b' AND (kind = 'open' OR matched) THEN '**'
              WHEN tag IN ({blocks}) THEN chr(2) ELSE '' END ||
              CASE WHEN row_number() OVER (PARTITION BY page_id, segment ORDER BY seq DESC) = 1
                THEN repeat('**', CAST(count(*) FILTER (tag = 'b' AND kind = 'open' AND NOT closed) OVER (PARTITION BY page_id, segment) AS BIGINT)) ELSE '' END AS piece
            FROM article""",
        )
        joined = "string_agg(piece, '' ORDER BY seq)"
        one = f"regexp_replace({joined}, {S.rx(SP + '+')}, ' ', 'g')"
        two = f"regexp_replace({one}, '[ \\x01]*\\x02[ \\x01\\x02]*', chr(10) || chr(10), 'g')"
        three = f"regexp_replace({two}, ' *\\x01[ \\x01]*', chr(10), 'g')"
        return self.add("markdown", f"SELECT page_id, {S.trim(three)} AS markdown FROM pieces GROUP BY page_id")


def _sql(method: str | None, final: str):
    def build() -> str:
        sql = PageSql()
        if method:
            getattr(sql, method)()
        return sql.text(final)

    return build


def page_parts(spark, sf_dir):
    return parts_by_size(spark, sf_dir, "pages")


def raw_tokens_of(spark, sf_dir):
    return P.html_tokens(load_pages(spark, sf_dir), page_parts(spark, sf_dir))


def tokens_of(spark, sf_dir):
    return P.with_ends(raw_tokens_of(spark, sf_dir))


@query("html_tokens", _sql(None, "SELECT page_id, seq, kind, tag, attrs, text, src_start FROM tokens"))
def html_tokens(spark, sf_dir):
    return raw_tokens_of(spark, sf_dir)


@query(
    "html_elements",
    _sql("elements", "SELECT page_id, seq, end_seq, tag, closed, text_len, link_len FROM elements"),
)
def html_elements(spark, sf_dir):
    return P.elements(tokens_of(spark, sf_dir)).select(
        "page_id", "seq", "end_seq", "tag", "closed", "text_len", "link_len"
    )


@query(
    "link_density",
    _sql(
        "elements",
        "SELECT page_id, seq, tag, CASE WHEN text_len = 0 THEN 1.0 ELSE round(link_len / text_len::DOUBLE, 6) END AS density FROM elements",
    ),
)
def link_density(spark, sf_dir):
    return P.elements(tokens_of(spark, sf_dir)).select(
        "page_id", "seq", "tag", F.round(P.link_density(), 6).alias("density")
    )


@query("drop_furniture", _sql("visible", "SELECT page_id, seq, kind, tag FROM visible"))
def drop_furniture(spark, sf_dir):
    return P.drop_furniture(tokens_of(spark, sf_dir)).select("page_id", "seq", "kind", "tag")


@query(
    "drop_hidden",
    _sql("elements", "SELECT page_id, CAST(count(*) AS BIGINT) AS visible FROM tokens GROUP BY page_id"),
)
def drop_hidden(spark, sf_dir):
    """No test page hides anything; the unit tests cover pages that do."""
    return P.drop_hidden(tokens_of(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("visible"))


@query(
    "page_guard",
    _sql(
        None,
        """SELECT page_id, CAST(count(*) FILTER (kind <> 'close' AND tag <> 'body') AS BIGINT) AS nodes,
          CAST(sum(length(text)) AS BIGINT) AS chars, 'ok' AS status
        FROM tokens t WHERE seq >= (SELECT min(seq) FROM tokens b WHERE b.page_id = t.page_id AND b.tag = 'body' AND b.kind = 'open')
        GROUP BY page_id""",
    ),
)
def page_guard(spark, sf_dir):
    return P.page_guard(raw_tokens_of(spark, sf_dir))


@query(
    "root_scores",
    _sql("credits", "SELECT page_id, seq, tag, round(density, 6) AS density, round(score, 6) AS score FROM credits"),
)
def root_scores(spark, sf_dir):
    return P.score_roots(tokens_of(spark, sf_dir)).select(
        "page_id", "seq", "tag", F.round("density", 6).alias("density"), F.round("score", 6).alias("score")
    )


@query("page_roots", _sql("roots", "SELECT page_id, root_seq, root_end, root_tag, how FROM roots"))
def page_roots(spark, sf_dir):
    return P.pick_root(tokens_of(spark, sf_dir))


@query("page_markdown", _sql("markdown", "SELECT page_id, markdown FROM markdown"))
def page_markdown(spark, sf_dir):
    return P.extract(load_pages(spark, sf_dir), page_parts(spark, sf_dir))


@query(
    "offset_map",
    _sql(
        "markdown",
        f"""SELECT page_id, CAST(sum(len(regexp_extract_all(text, {S.rx(S.NS + '+')}))) AS BIGINT) AS runs, CAST(0 AS BIGINT) AS wrong
        FROM article WHERE kind = 'text' GROUP BY page_id HAVING runs > 0""",
    ),
)
def offset_map(spark, sf_dir):
    """Runs per page, and how many do not read the same on both sides."""
    tokens = tokens_of(spark, sf_dir)
    # The texts of a page by their token, next to the map that one run of the page gives.
    texts = tokens.filter("kind = 'text'").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "text"))).alias("texts"))
    both = P.mapped_markdown(tokens).withColumn("chunks", text_chunks(F.col("markdown"))).join(texts, "page_id")
    there = lambda r: F.substring(F.element_at("texts", r["node"]), r["node_start"] + 1, r["md_end"] - r["md_start"])
    here = lambda r: chars_at(F.col("chunks"), r["md_start"], r["md_end"] - r["md_start"])
    wrong = F.filter("runs", lambda r: ~F.coalesce(here(r) == there(r), F.lit(False)))
    return both.filter(F.size("runs") > 0).select(
        "page_id", F.size("runs").cast("long").alias("runs"), F.size(wrong).cast("long").alias("wrong")
    )


WORD = "[A-Z][a-z]+ing"


@query(
    "located_hits",
    lambda: _located_sql(),
)
def located_hits(spark, sf_dir):
    """Matches in the Markdown of a page, placed in its text tokens."""
    mapped = P.mapped_markdown(tokens_of(spark, sf_dir))
    hits = F.transform(spans(F.col("markdown"), WORD), lambda m, i: m.withField("seq", i))
    return P.located_hits(mapped, hits).select(
        "page_id", "seq", "match", "from_node", "from_offset", "to_node", "to_offset"
    )


def _located_sql() -> str:
    sql = PageSql()
    sql.markdown()
    sql.add("texts", "SELECT page_id * 100000 + seq AS doc_id, text FROM article WHERE kind = 'text'")
    sql.spans("m", "texts", "text", WORD)
    return sql.text(
        """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY node, s) - 1 AS INTEGER) AS seq, match,
          node AS from_node, s AS from_offset, node AS to_node, e AS to_offset
        FROM (SELECT CAST(floor(doc_id / 100000) AS BIGINT) AS page_id, CAST(doc_id % 100000 AS INTEGER) AS node, s, e, match FROM m)"""
    )


# --- pages that exercise every rule ------------------------------------------------
#: The test pages hold headings, paragraphs and bold text only.  Every page gets one of these at the
#: end of its article, by its id: HTML, and the Markdown that it has to become.  Texts are short, so that
#: they earn no credit and leave the choice of the root alone.
PAGE_SNIPPETS = (
    ("<h2>Sec &amp; two</h2><h3>Three</h3><h4>four</h4><h5>five</h5><h6>six</h6>", "## Sec & two\n\n### Three\n\n#### four\n\n##### five\n\n###### six"),
    ("<p>a <b>two</b> <strong>x</strong> <i>y</i> <em>z</em> <code>c</code></p>", "a **two** **x** _y_ _z_ `c`"),
    ("<p>open <b>mark <i>two</p><p>next</p>", "open **mark _two_**\n\nnext"),
    ("<ul><li>a</li><li>b<li>c</ul>", "- a\n- b\n- c"),
    ("<ol><li>x</li><li>y</li></ol><ol><li>z</li></ol>", "1. x\n2. y\n\n1. z"),
    ("<ul> loose <li>a <ol><li>x</li><li>y</li></ol></li> out </ul>", "- a\n\n1. x\n2. y"),
    ("<p>top<br>end</p><hr><p>low</p>", "top\nend\n\n---\n\nlow"),
    ("<blockquote><p>q1</p><p>q2</p><blockquote>in</blockquote></blockquote>", "> q1\n> q2\n> > in"),
    ('<pre><code class="language-py">def f():\n    return 1\n\n</code></pre><p>after</p>', "```py\ndef f():\n    return 1\n```\n\nafter"),
    ("<pre>  two  spaces\n\ttab</pre>", "```\n  two  spaces\n\ttab\n```"),
    ("<table><caption>no</caption><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table>", "| A | B |\n| --- | --- |\n| 1 |  |"),
    ('<div style="white-space: pre-wrap">l1\nl2\n \nl3</div>', "l1\nl2\n\nl3"),
    ('<div style="color: red">l1\nl2\n \nl3</div>', "l1 l2 l3"),
    ("<div hidden>no</div><p>seen</p>", "seen"),
    ('<p>kept</p><div style="color:red; display: none">no <b>no</b></div><p>too</p>', "kept\n\ntoo"),
    ('<p aria-hidden="true">no</p><p aria-hidden="false">aria</p><span style="visibility:hidden">no</span>', "aria"),
    ('<div class="big sidebar">no</div><p class="sidebars">class</p>', "class"),
    ('<div role="search">no</div><p role="note">role</p>', "role"),
    ('<div id="toc">no</div><p id="tocs">id</p>', "id"),
    ("<div data-nosnippet>no</div><p data-snippet>data</p>", "data"),
    ('<aside>no</aside><form>no<input value="x"></form><button>no</button><p>tags</p><dialog>no</dialog>', "tags"),
    ("<noscript>no</noscript><p>raw</p><textarea>no</textarea><script>no</script>", "raw"),
    ("<p>&eacute; &#233; &#x41; &nope; &hellip;</p>", "é é A &nope; …"),
)
#: Containers that stand in for the article, by page: opening and closing tag.
CONTAINERS = (
    ('<div itemprop="articleBody">', "div"), ('<div class="x mw-parser-output">', "div"), ("<article>", "article"),
    ('<div role="main">', "div"), ("<main>", "main"), ('<div class="post-content">', "div"),
    ('<section class="entry-content y">', "section"), ('<div class="article-body">', "div"), ("<div id='content'>", "div"),
)


def _by_page(values) -> Column:
    """One of the values for each page, by its id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))


def _by_page_sql(values) -> str:
    return f"CASE page_id % {len(values)} {' '.join(f'WHEN {i} THEN {S.q(v)}' for i, v in enumerate(values))} END"


def seeded_pages(spark, sf_dir):
    """Every page, whole, with a snippet before the end of its article."""
    ending = F.concat(_by_page([html for html, _ in PAGE_SNIPPETS]), F.lit("</article>"))
    return load_pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</article>"), ending))


def _seeded_markdown_sql() -> str:
    sql = PageSql()
    sql.markdown()
    said = _by_page_sql([markdown for _, markdown in PAGE_SNIPPETS])
    return sql.text(f"SELECT page_id, markdown || chr(10) || chr(10) || {said} AS markdown FROM markdown")


@query("seeded_page_markdown", _seeded_markdown_sql)
def seeded_page_markdown(spark, sf_dir):
    """Markdown of the seeded pages; the SQL knows what each snippet has to become."""
    return P.extract(seeded_pages(spark, sf_dir), page_parts(spark, sf_dir))


@query(
    "seeded_offset_map",
    _sql("markdown", f"SELECT page_id, CAST(0 AS BIGINT) AS wrong, {_by_page_sql([html for html, _ in PAGE_SNIPPETS])} AS snippet FROM markdown"),
)
def seeded_offset_map(spark, sf_dir):
    """How many runs of the seeded pages do not read the same in the Markdown and in their token."""
    pages = seeded_pages(spark, sf_dir)
    tokens = P.with_ends(P.html_tokens(pages, page_parts(spark, sf_dir)))
    texts = tokens.filter("kind = 'text'").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "text"))).alias("texts"))
    both = P.mapped_markdown(tokens).join(texts, "page_id")
    there = lambda r: F.substring(F.element_at("texts", r["node"]), r["node_start"] + 1, r["md_end"] - r["md_start"])
    here = lambda r: F.substring("markdown", r["md_start"] + 1, r["md_end"] - r["md_start"])
    wrong = F.filter("runs", lambda r: ~F.coalesce(here(r) == there(r), F.lit(False)))
    return both.select("page_id", F.size(wrong).cast("long").alias("wrong"), _by_page([html for html, _ in PAGE_SNIPPETS]).alias("snippet"))


def contained_pages(spark, sf_dir):
    """Every page with another container in place of its article."""
    opening, tag = _by_page([o for o, _ in CONTAINERS]), _by_page([t for _, t in CONTAINERS])
    html = F.replace(F.replace("html", F.lit("<article>"), opening), F.lit("</article>"), F.concat(F.lit("</"), tag, F.lit(">")))
    return load_pages(spark, sf_dir).withColumn("html", html)


@query(
    "contained_page_roots",
    _sql(
        "roots",
        f"""SELECT page_id, root_seq, root_end, CASE root_tag WHEN 'article' THEN {_by_page_sql([t for _, t in CONTAINERS])} ELSE root_tag END AS root_tag, how
        FROM roots""",
    ),
)
def contained_page_roots(spark, sf_dir):
    """The root is found by whatever marks the container of the article."""
    return P.pick_root(P.with_ends(P.html_tokens(contained_pages(spark, sf_dir), page_parts(spark, sf_dir))))


OWN_LIMITS = (60, 3000)


@query(
    "page_guard_own_limits",
    _sql(
        None,
        f"""SELECT page_id, nodes, chars, CASE WHEN nodes > {OWN_LIMITS[0]} OR chars > {OWN_LIMITS[1]} THEN 'too_large' ELSE 'ok' END AS status FROM (
          SELECT page_id, CAST(count(*) FILTER (kind <> 'close' AND tag <> 'body') AS BIGINT) AS nodes, CAST(sum(length(text)) AS BIGINT) AS chars
          FROM tokens t WHERE seq >= (SELECT min(seq) FROM tokens b WHERE b.page_id = t.page_id AND b.tag = 'body' AND b.kind = 'open') GROUP BY page_id)""",
    ),
)
def page_guard_own_limits(spark, sf_dir):
    """Labels by limits that some of the pages are over."""
    return P.page_guard(raw_tokens_of(spark, sf_dir), *OWN_LIMITS)


def _page_scores_sql() -> str:
    pages = PageSql()
    pages.markdown()
    sql = Sql("SELECT page_id AS doc_id, markdown AS text FROM markdown")
    sql.parts = {**pages.parts, **sql.parts}
    sql.scores()
    return sql.text("SELECT doc_id AS page_id, word_count, score, band FROM scores")


@query("page_scores", _page_scores_sql)
def page_scores(spark, sf_dir):
    """Pages from HTML to a score."""
    articles = P.extract(load_pages(spark, sf_dir), page_parts(spark, sf_dir))
    return scoring.scores(articles.select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))).select(
        F.col("doc_id").alias("page_id"), "word_count", "score", "band"
    )


# --- layout ----------------------------------------------------------------------------
GLYPHS = """SELECT doc_id, CAST(floor(i / 40) AS INTEGER) AS page, CAST(i AS INTEGER) AS seq,
    CASE WHEN i % 7 = 6 THEN '' ELSE line END AS str,
    CAST(-sum(CASE WHEN i % 5 = 0 THEN 24 ELSE 12 END) OVER (PARTITION BY doc_id ORDER BY i) AS DOUBLE) AS y,
    CAST(CASE WHEN i % 11 = 3 THEN 0 ELSE 12 END AS DOUBLE) AS height, i % 7 = 6 OR i % 3 = 1 AS has_eol
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    "layout_to_text",
    lambda: f"""WITH glyphs AS ({GLYPHS}),
    shown AS (SELECT *, CASE WHEN height > 0 THEN height END AS h FROM glyphs WHERE str <> ''),
    filled AS (SELECT *, coalesce(h, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 12) AS hh,
      lag(y) OVER w AS py, lag(seq) OVER w AS pseq FROM shown WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
    broken AS (SELECT f.*, CASE WHEN abs(py - y) > hh * 1.6 THEN 2
      WHEN abs(py - y) > hh * 0.3 OR EXISTS (SELECT 1 FROM glyphs g WHERE g.doc_id = f.doc_id AND g.page = f.page AND g.has_eol
        AND g.seq >= coalesce(pseq, -1) AND g.seq < f.seq) THEN 1 ELSE 0 END AS br FROM filled f),
    paged AS (SELECT doc_id, page, string_agg(repeat(chr(10), br) || str, '' ORDER BY seq) AS t FROM broken GROUP BY doc_id, page)
    SELECT doc_id, string_agg(coalesce(t, ''), chr(10) || chr(10) ORDER BY p.page) AS text
    FROM (SELECT DISTINCT doc_id, page FROM glyphs) p LEFT JOIN paged USING (doc_id, page) GROUP BY doc_id""",
)
def layout_to_text(spark, sf_dir):
    return layout.layout_to_text(glyph_items(spark, sf_dir))


def glyph_items(spark, sf_dir):
    """One item per line of a document; every seventh is empty with a flag."""
    ls = F.split("text", "\n", -1)
    d = documents_of(spark, sf_dir).select("doc_id", F.posexplode(ls).alias("i", "line"))
    i = F.col("i")
    # Twelve down per line, twelve more at every fifth.
    y = -(12.0 * (i + 1) + 12.0 * (F.floor(i / 5) + 1))
    return d.select(
        "doc_id",
        F.floor(i / 40).cast("int").alias("page"),
        i.alias("seq"),
        F.when(i % 7 == 6, "").otherwise(F.col("line")).alias("str"),
        y.cast("double").alias("y"),
        F.when(i % 11 == 3, 0.0).otherwise(12.0).alias("height"),
        ((i % 7 == 6) | (i % 3 == 1)).alias("has_eol"),
    )
