"""Queries over documents: sources, guards, text views, rules, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge import config, wording
from prosegauge.catalog import sql as S
from prosegauge.catalog.fixtures import documents_of, seeded
from prosegauge.catalog.registry import query
from prosegauge.catalog.sql import RULES, Sql
from prosegauge.functions.text import clean, context_around, n_words, spans, text_chunks
from prosegauge.operators import measures as M
from prosegauge.operators import views as V
from prosegauge.operators.lexical import phrase_spans
from prosegauge.lexicons import STOCK_PHRASES, WEASEL_PHRASES, Lexicons, lexicon, lexicon_rows
from prosegauge.plans import scoring
from prosegauge.plans.rules import default_rules
from prosegauge.sources.tables import (
    MODES, load_documents, load_pages, load_text_files, parts_by_size, parts_of_small, results_json, scope_of, spread, table, write_results,
)
from prosegauge.streaming.run import shared_folder

RAW = "SELECT doc_id, text, lang, source FROM documents"


def rule(key: str):
    return next(r for r in default_rules() if r.count_key == key)


# --- sources and guards ----------------------------------------------------------
@query(
    "load_documents",
    lambda: "SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
)
def documents(spark, sf_dir):
    return documents_of(spark, sf_dir, "lang", "source").withColumn("n_chars", F.length("text")).drop("text")


@query(
    "load_pages",
    lambda: "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages WHERE regexp_matches(url, '^https?:')",
)
def pages(spark, sf_dir):
    return load_pages(spark, sf_dir).select("page_id", "url", F.length("html").alias("n_chars"))


def _scope_sql() -> str:
    return f"""
    WITH j AS (SELECT conv_id, turn, c.text AS passage, d.text, {S.words('c.text')} AS w
      FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id),
    m AS (SELECT *, mode, CASE mode WHEN 'selection' THEN TRUE WHEN 'auto' THEN w >= {config.MIN_WORDS} ELSE FALSE END AS wants
      FROM j, (VALUES ('auto'), ('selection'), ('page')) AS v(mode))
    SELECT conv_id, turn, mode, CASE WHEN wants THEN 'selection' ELSE 'page' END AS scope,
      CASE WHEN wants AND w = 0 THEN 'nothing_selected' ELSE 'ok' END AS scope_status,
      CAST(length(CASE WHEN wants AND w = 0 THEN NULL WHEN wants THEN passage ELSE text END) AS INTEGER) AS n_chars
    FROM m"""


@query("choose_scope", _scope_sql)
def scope(spark, sf_dir):
    """Turns of a conversation as passages chosen from the document of its id."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    joined = turns.join(docs, "conv_id", "left")
    # One join for all modes: each row gives one result per mode.
    chosen = [
        F.struct(F.lit(mode).alias("mode"), of["scope"].alias("scope"), of["scope_status"].alias("scope_status"), F.length(of["scope_text"]).alias("n_chars"))
        for mode in MODES
        for of in [scope_of(mode, F.col("passage"), F.col("text"))]
    ]
    return joined.select("conv_id", "turn", F.explode(F.array(*chosen)).alias("s")).select("conv_id", "turn", "s.*")


# How files of text are named here: by extension, in any case, and others that are not text.
FILE_NAMES = ("txt", "MD", "Markdown", "text", "Rst", "org", "pdf", "csv", "TXT.bak", "html")
FILE_TYPES = {"csv": "text/csv", "html": "text/html", "pdf": "application/pdf"}
# Bytes of the table of documents whose files share a folder, and a task when they are read.
FOLDER_BYTES = 2 << 20


def in_folders(rows: DataFrame, folders: int) -> DataFrame:
    """Files put into folders that their names decide on, all files of a folder in one task.

    If every task wrote into all folders, they would be made as often as tasks times folders.
    """
    dealt = rows.withColumn("folder", F.pmod(F.xxhash64("file"), F.lit(folders)).cast("int")).repartitionById(folders, "folder")
    return dealt.select(F.concat_ws("/", "folder", "file").alias("file"), "text")


def _files_sql() -> str:
    names = ", ".join(f"({i}, {S.q(n)})" for i, n in enumerate(FILE_NAMES))
    return f"""SELECT doc_id || '.' || name AS file, CASE WHEN octet_length(encode(text)) > {config.MAX_FILE_BYTES // 500} THEN 'too_large'
        WHEN lower(name) IN ('txt', 'md', 'markdown', 'text', 'rst', 'org', 'csv', 'html') THEN 'ok' ELSE 'unsupported' END AS status,
      CASE WHEN status = 'ok' THEN CAST(length(text) AS INTEGER) END AS n_chars, CASE WHEN status = 'ok' THEN md5(text) END AS text_md5
      FROM documents JOIN (VALUES {names}) AS f(i, name) ON i = doc_id % {len(FILE_NAMES)}"""


@query("load_text_files", _files_sql)
def text_files(spark, sf_dir):
    """Every document written as a file of the shared folder under some extension, then read back by extension and type."""
    folder = shared_folder(spark, "text-files")
    name = F.element_at(F.array(*map(F.lit, FILE_NAMES)), (F.col("doc_id") % len(FILE_NAMES) + 1).cast("int"))
    rows = load_documents(spark, sf_dir).select(F.concat_ws(".", "doc_id", name).alias("file"), "text")
    parts = parts_by_size(spark, sf_dir, "documents", FOLDER_BYTES)
    rows = in_folders(rows, parts)
    place = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(place)
        fs.create_dir(base, recursive=True)
        made = set()
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = file.partition("/")[0]
                if inside not in made:
                    fs.create_dir(f"{base}/{inside}", recursive=True)
                    made.add(inside)
                with fs.open_output_stream(f"{base}/{file}", compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    found = load_text_files(spark, place, FILE_TYPES, config.MAX_FILE_BYTES // 500, parts)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "status", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


# Every text repeated, so that the longest ones pass the limit.
STRETCH = 16


@query(
    "scan_status",
    lambda: f"""WITH t AS (
      SELECT 'document' AS kind, doc_id AS id, 0 AS part, repeat(text, {STRETCH}) AS text FROM documents
      UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations)
    SELECT *, status IN ('no_text', 'not_enough_text') AS retryable FROM (
      SELECT kind, id, CAST(part AS BIGINT) AS part, CASE WHEN length(text) > {config.MAX_TEXT_CHARS} THEN 'too_large'
      WHEN {S.words('text')} = 0 THEN 'no_text' WHEN {S.words('text')} < {config.MIN_WORDS} THEN 'not_enough_text' ELSE 'ok' END AS status
    FROM t)""",
)
def status(spark, sf_dir):
    docs = documents_of(spark, sf_dir).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"),
        F.repeat("text", F.lit(STRETCH)).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    status_ = scoring.scan_status(F.col("text"), config.MAX_TEXT_CHARS)
    return docs.unionByName(turns).select("kind", "id", "part", status_.alias("status"), scoring.retryable(status_).alias("retryable"))


@query(
    "lexicon_table",
    lambda: "WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS phrase, doc_id FROM documents) "
    "SELECT detector, l.class, CAST(count(DISTINCT l.phrase) AS BIGINT) AS phrases, CAST(count(p.doc_id) AS BIGINT) AS documents FROM (VALUES "
    + ", ".join(f"({S.q(d)}, {S.q(p)}, {S.q(c)})" for d, p, c, _ in lexicon_rows())
    + ") AS l(detector, phrase, class) LEFT JOIN p USING (phrase) GROUP BY ALL",
)
def lexicon_table(spark, sf_dir):
    """The lexicon joined to the token sets of the corpus."""
    words = V.word_tokens(F.col("text"))
    tokens = documents_of(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(words)).alias("phrase"))
    per_token = tokens.groupBy("phrase").agg(F.count("*").alias("k"))
    # The lexicon is a fixed list of a few hundred rows.
    return (
        F.broadcast(lexicon(spark))
        .join(per_token, "phrase", "left")
        .groupBy("detector", "class")
        .agg(F.count_distinct("phrase").alias("phrases"), F.coalesce(F.sum("k"), F.lit(0)).alias("documents"))
    )


# --- views -------------------------------------------------------------------------
def _code_sql(columns: str) -> str:
    sql = Sql()
    sql.code()
    return sql.text(f"SELECT {columns} FROM views")


@query("masked_text", lambda: _code_sql("doc_id, masked, word_count"))
def masked(spark, sf_dir):
    d = seeded(spark, sf_dir).withColumn("masked", V.masked_text(F.col("text")))
    return d.select("doc_id", "masked", n_words(F.col("masked")).alias("word_count"))


@query("text_without_fences", lambda: _code_sql("doc_id, unfenced"))
def unfenced(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", V.text_no_fences(F.col("text")).alias("unfenced"))


@query("fence_breaks", lambda: _code_sql("doc_id, broken"))
def broken(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", V.fence_breaks(F.col("text")).alias("broken"))


def _code_spans_sql() -> str:
    sql = Sql()
    sql.code()
    return sql.text(
        """SELECT doc_id, CAST(s + CASE kind WHEN 'fence' THEN ind ELSE 0 END AS INTEGER) AS start_pos,
          CAST(s + n - CASE WHEN kind = 'inline' AND right(piece, 1) <> '`' THEN 1 ELSE 0 END AS INTEGER) AS end_pos,
          kind = 'fence' AS fenced
        FROM (SELECT *, length(piece) AS n, length(regexp_extract(piece, '^[ \\t]*')) AS ind,
          coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM code_kinds) WHERE kind <> 'text'"""
    )


@query("code_spans", _code_spans_sql)
def code_spans(spark, sf_dir):
    d = seeded(spark, sf_dir).select("doc_id", F.explode(V.code_spans(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.start").alias("start_pos"), F.col("c.end").alias("end_pos"), "c.fenced")


def _collapsed_sql() -> str:
    sql = Sql()
    sql.collapsed()
    return sql.text("SELECT doc_id, text AS collapsed FROM collapsed")


@query("collapse_tables", _collapsed_sql)
def collapsed(spark, sf_dir):
    return seeded(spark, sf_dir).select(
        "doc_id", V.collapse_tables(V.fence_breaks(F.col("text"))).alias("collapsed")
    )


def _word_count_sql() -> str:
    sql = Sql()
    sql.code()
    return sql.text(f"SELECT doc_id, word_count, {S.words('unfenced')} AS unfenced_words FROM views")


@query("word_counts", _word_count_sql)
def word_counts(spark, sf_dir):
    return V.with_views(seeded(spark, sf_dir)).select(
        "doc_id", "word_count", n_words(F.col("unfenced")).alias("unfenced_words")
    )


def _sentences_sql(docs=None) -> str:
    sql = Sql(docs)
    sql.sentences()
    return sql.text("SELECT doc_id, sent_no, sentence, n_words FROM sents")


@query("sentences", _sentences_sql)
def sentences(spark, sf_dir):
    return V.sentences(seeded(spark, sf_dir))


@query("sentences_of_documents", lambda: _sentences_sql(RAW))
def sentences_raw(spark, sf_dir):
    return V.sentences(documents_of(spark, sf_dir))


def _long_sentences_sql() -> str:
    sql = Sql()
    sql.collapsed()
    sql.sentences("collapsed", "text", "lsents")
    return sql.text("SELECT doc_id, sent_no, sentence, n_words FROM lsents")


@query("sentences_without_code_and_tables", _long_sentences_sql)
def long_sentences(spark, sf_dir):
    return V.long_sentences(seeded(spark, sf_dir))


def _lines_sql() -> str:
    sql = Sql()
    sql.lines()
    return sql.text(
        f"""SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_start, line,
          {S.trim('line')} = '' AS is_blank, {S.like('line', S.BULLET)} AS is_bullet,
          {S.like('line', S.BOLD_BULLET)} AS is_bold_bullet, starts_with(line, '>') AS is_quote,
          {S.like('line', f'^{S.SP}*#')} AS is_heading, {S.like('line', S.HR)} AS is_hr,
          starts_with({S.trim('line')}, '```') AS is_code_toggle FROM lines"""
    )


@query("lines", _lines_sql)
def lines(spark, sf_dir):
    return V.lines(seeded(spark, sf_dir))


def _tokens_sql() -> str:
    sql = Sql()
    sql.code()
    one = lambda kind, col: (
        f"""SELECT {S.q(kind)} AS view, doc_id, token, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower({col}), {S.rx(S.W + '+')})) AS token FROM views) GROUP BY ALL"""
    )
    return sql.text(one("raw", "text") + " UNION ALL " + one("masked", "masked"))


@query("word_tokens", _tokens_sql)
def word_tokens(spark, sf_dir):
    """Token counts per document over both views."""
    d = seeded(spark, sf_dir)
    parts = [
        V.tokens(d, masked=m).groupBy("doc_id", "token").agg(F.count("*").alias("n")).withColumn("view", F.lit(v))
        for v, m in (("raw", False), ("masked", True))
    ]
    return parts[0].unionByName(parts[1]).select("view", "doc_id", "token", "n")


def _ngram_tokens_sql() -> str:
    sql = Sql()
    sql.ngram_tokens()
    return sql.text(
        "SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM toks"
    )


@query("ngram_tokens", _ngram_tokens_sql)
def ngram_tokens(spark, sf_dir):
    return V.ngram_token_table(seeded(spark, sf_dir))


def _paragraphs_sql() -> str:
    sql = Sql()
    sql.paragraphs()
    return sql.text("SELECT doc_id, para_no, n_words FROM paras")


@query("paragraphs", _paragraphs_sql)
def paragraphs(spark, sf_dir):
    return V.paragraphs(seeded(spark, sf_dir))


CAPITALISED = "[A-Z][a-z]+ing"


def _spans_sql() -> str:
    sql = Sql(RAW)
    sql.spans("m", "docs", "text", CAPITALISED)
    return sql.text("SELECT doc_id, s AS start_pos, e AS end_pos, match FROM m")


@query("match_spans", _spans_sql)
def match_spans(spark, sf_dir):
    found = V.match_spans(documents_of(spark, sf_dir), CAPITALISED)
    return found.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "match")


def _phrase_sql(docs, phrases) -> str:
    sql = Sql(docs)
    sql.phrases("p", phrases)
    return sql.text("SELECT doc_id, match AS phrase, s AS start_pos, e AS end_pos FROM p")


def _phrase_hits(df: DataFrame, phrases) -> DataFrame:
    found = df.withColumn("lower", F.lower(clean(F.col("text")))).select(
        "doc_id", F.explode(phrase_spans(F.col("lower"), phrases)).alias("m")
    )
    return found.select(
        "doc_id", F.col("m.match").alias("phrase"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos")
    )


@query("phrase_hits", lambda: _phrase_sql(None, STOCK_PHRASES + WEASEL_PHRASES))
def phrase_hits(spark, sf_dir):
    return _phrase_hits(seeded(spark, sf_dir), STOCK_PHRASES + WEASEL_PHRASES)


# A caller's own list, which the raw documents do hold.
OWN_PHRASES = ("of the", "the th", "que la", "de la", "in der", "es an", "th")


@query("phrase_hits_own_list", lambda: _phrase_sql(RAW, OWN_PHRASES))
def phrase_hits_own(spark, sf_dir):
    return _phrase_hits(documents_of(spark, sf_dir), OWN_PHRASES)


def _snippets_sql() -> str:
    sql = Sql(RAW)
    sql.spans("m", "docs", "text", CAPITALISED)
    return sql.text(
        f"SELECT doc_id, s AS start_pos, {S.ctx('d.text', 'm.s', 'm.e')} AS context FROM m JOIN docs d USING (doc_id)"
    )


@query("context_snippets", _snippets_sql)
def context_snippets(spark, sf_dir):
    """The snippets are made in the row of the text, so that no hit carries it."""
    text = F.col("text")
    d = documents_of(spark, sf_dir).select("doc_id", text_chunks(text).alias("chunks"), F.length(text).alias("n"), spans(text, CAPITALISED).alias("found"))
    around = lambda m: context_around(F.col("chunks"), F.col("n"), m["start"], m["end"], config.SNIPPET_CHARS)
    made = F.transform("found", lambda m: F.struct(m["start"].alias("start_pos"), around(m).alias("context")))
    return d.select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.*")


# --- rules ---------------------------------------------------------------------------
HIT_COLUMNS = "doc_id, seq, detector, match, context, penalty, start_pos, end_pos, scored"


def named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _rule_sql(key: str, docs=None):
    def build() -> str:
        sql = Sql(docs)
        sql.code()
        getattr(sql, key)()
        return sql.text(
            f"SELECT {', '.join('h.' + c.strip() for c in HIT_COLUMNS.split(','))} FROM h_{key} h "
            f"JOIN views v ON v.doc_id = h.doc_id AND v.word_count >= {config.MIN_WORDS}"
        )

    return build


def _rule_hits(df: DataFrame, key: str) -> DataFrame:
    found = named(scoring.hits(df, [rule(key)]))
    return found.select(*[c.strip() for c in HIT_COLUMNS.split(",")])


def _register_rule(key: str) -> None:
    @query(f"{key}_hits", _rule_sql(key))
    def over_seeded(spark, sf_dir):
        return _rule_hits(seeded(spark, sf_dir), key)


for _, _key in RULES:
    # Appended snippets never even out the paragraphs; see below.
    if _key != "paragraph_cv":
        _register_rule(_key)


def _register_raw(key: str) -> None:
    @query(f"{key}_hits_of_documents", _rule_sql(key, RAW))
    def over_documents(spark, sf_dir):
        return _rule_hits(documents_of(spark, sf_dir), key)


for _key in ("rhythm", "structural", "phrase_reuse", "intrasentence_keyword_bold"):
    _register_raw(_key)


AS_PARAGRAPHS = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, lang, source FROM documents"


def _register_paragraphs(name: str, key: str) -> None:
    @query(name, _rule_sql(key, AS_PARAGRAPHS))
    def over_lines(spark, sf_dir):
        """The rule with every line of a document as a paragraph of its own."""
        d = documents_of(spark, sf_dir)
        return _rule_hits(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), key)


_register_paragraphs("paragraph_balance_hits_of_lines", "paragraph_balance")
_register_paragraphs("paragraph_cv_hits", "paragraph_cv")


def _measures_sql() -> str:
    sql = Sql(RAW)
    sql.rhythm()
    sql.copula_chain()
    return sql.text(
        """SELECT r.doc_id, CAST(r.n AS INTEGER) AS sentences, round(mean, 6) AS mean, round(cv, 6) AS cv,
          CAST(shortest AS INTEGER) AS shortest, CAST(longest AS INTEGER) AS longest, CAST(k AS INTEGER) AS copulas
        FROM rh r JOIN cc USING (doc_id)
        JOIN (SELECT doc_id, min(n_words) AS shortest, max(n_words) AS longest FROM sents GROUP BY doc_id) USING (doc_id)"""
    )


@query("sentence_measures", _measures_sql)
def sentence_measures(spark, sf_dir):
    """What the rhythm and copula rules measure, for every document."""
    d = V.with_views(documents_of(spark, sf_dir)).filter("n_sents > 0").withColumns(
        {"shape": M.sentence_shape(1), "copulas": M.copula_sentences(1)}
    )
    return d.select(
        "doc_id", F.col("n_sents").alias("sentences"), F.round("shape.mean", 6).alias("mean"),
        F.round("shape.cv", 6).alias("cv"), "shape.shortest", "shape.longest", "copulas",
    )


def _word_advice_sql() -> str:
    sql = Sql()
    sql.slop_words()
    lex_rows = ", ".join(f"({S.q(w)}, {S.q(S.L.word_class(w))})" for w in S.L.words)
    times = f"CASE WHEN n > 1 THEN {S.say(wording.TIMES, 'n')} ELSE '' END"
    arms = " ".join(f"WHEN {S.q(c)} THEN {S.say(text, 'match', times)}" for c, text in wording.WORD_ADVICE.items())
    return sql.text(
        f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS rank, CASE class {arms} END AS line
        FROM (SELECT doc_id, match, count(*) AS n, min(seq) AS first FROM h_slop_words GROUP BY ALL) g
        JOIN (VALUES {lex_rows}) AS l(match, class) USING (match)"""
    )


@query("slop_word_advice", _word_advice_sql)
def slop_word_advice(spark, sf_dir):
    return scoring.advice(seeded(spark, sf_dir), [rule("slop_words")])


def _reuse_sql(docs=None) -> str:
    sql = Sql(docs)
    sql.repeated()
    return sql.text(
        "SELECT doc_id, gram, CAST(n AS INTEGER) AS n, CAST(c AS INTEGER) AS uses, CAST(first AS INTEGER) AS first_pos, CAST(i AS INTEGER) AS rank FROM reuse"
    )


@query("repeated_ngrams", lambda: _reuse_sql(RAW))
def repeated_ngrams(spark, sf_dir):
    """Every repeated n-gram of every document, not only the recorded five."""
    d = documents_of(spark, sf_dir)
    found = d.select("doc_id", F.posexplode(M.repeated_ngrams(4, 8, 3)).alias("i", "g"))
    return found.select(
        "doc_id", "g.gram", "g.n", F.col("g.count").alias("uses"), F.col("g.first").alias("first_pos"),
        (F.col("i") + 1).alias("rank"),
    )


# --- scores ---------------------------------------------------------------------------
def _sql_of(method: str, columns: str, docs=None):
    def build() -> str:
        sql = Sql(docs)
        name = getattr(sql, method)()
        return sql.text(f"SELECT {columns} FROM {name}")

    return build


@query("all_hits", _sql_of("all_hits", "doc_id, seq, rule, rule_order, detector, match, context, penalty, start_pos, end_pos, scored"))
def all_hits(spark, sf_dir):
    return named(scoring.hits(seeded(spark, sf_dir)))


@query("rule_counts", _sql_of("counts", "doc_id, count_key, n"))
def rule_counts(spark, sf_dir):
    return scoring.rule_counts(seeded(spark, sf_dir))


SCORES = "doc_id, word_count, total_penalty, weighted_sum, density, score, slop, band"


@query("scores", _sql_of("scores", SCORES))
def scores(spark, sf_dir):
    return scoring.scores(seeded(spark, sf_dir))


@query("scores_of_documents", _sql_of("scores", SCORES, RAW))
def scores_of_documents(spark, sf_dir):
    return scoring.scores(documents_of(spark, sf_dir))


TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query("scores_of_turns", _sql_of("scores", SCORES, TURNS))
def scores_of_turns(spark, sf_dir):
    """Conversation turns, many of them under the word floor."""
    turns = spread(table(spark, sf_dir, "conversations"), parts_of_small(spark, sf_dir, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"
    )
    return scoring.scores(turns)


def _bands_sql() -> str:
    sql = Sql()
    sql.scores()
    return sql.text(
        """SELECT source, band, CAST(count(*) AS BIGINT) AS documents, CAST(sum(total_penalty) AS BIGINT) AS penalty,
          round(avg(slop), 6) AS mean_slop FROM scores JOIN docs USING (doc_id) GROUP BY source, band"""
    )


@query("bands_by_source", _bands_sql)
def bands_by_source(spark, sf_dir):
    """The flagship: every rule over every document, summed up per source."""
    return (
        scoring.scores(seeded(spark, sf_dir, "source"), None, "source")
        .groupBy("source", "band")
        .agg(
            F.count("*").alias("documents"),
            F.sum("total_penalty").alias("penalty"),
            F.round(F.avg("slop"), 6).alias("mean_slop"),
        )
    )


def _lexical_sql() -> str:
    sql = Sql()
    sql.slop_phrases()
    sql.weasel()
    sql.code()
    return sql.text(
        f"""SELECT v.source, v.word_count > 500 AS is_long, CAST(count(DISTINCT v.doc_id) AS BIGINT) AS documents,
          CAST(count(h.doc_id) AS BIGINT) AS hits, CAST(coalesce(sum(h.penalty), 0) AS BIGINT) AS penalty
        FROM views v LEFT JOIN (SELECT * FROM h_slop_phrases UNION ALL SELECT * FROM h_weasel) h
          ON h.doc_id = v.doc_id AND v.word_count >= {config.MIN_WORDS} GROUP BY ALL"""
    )


@query("phrase_penalty_by_source", _lexical_sql)
def phrase_penalty_by_source(spark, sf_dir):
    """The smallest useful pipeline: two phrase rules, summed per source."""
    rules = [rule("slop_phrases"), rule("weasel")]
    rows = scoring.scored(seeded(spark, sf_dir, "source"), rules)
    n = F.size("hits_slop_phrases") + F.size("hits_weasel")
    return (
        rows.select("source", (F.col("word_count") > 500).alias("is_long"), n.alias("k"), "total_penalty")
        .groupBy("source", "is_long")
        .agg(F.count("*").alias("documents"), F.sum("k").alias("hits"), F.sum("total_penalty").alias("penalty"))
    )


def _written_sql() -> str:
    sql = Sql()
    sql.scores()
    return sql.text(
        """SELECT band, CAST(count(*) AS BIGINT) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits, CAST(coalesce(sum(w), 0) AS BIGINT) AS scored
        FROM scores LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (scored) AS w FROM all_hits GROUP BY doc_id) USING (doc_id) GROUP BY band"""
    )


@query("results_written", _written_sql)
def results_written(spark, sf_dir):
    """Analysis records written by band in the shared folder, then read back."""
    folder = shared_folder(spark, "results")
    write_results(scoring.analyze(seeded(spark, sf_dir)), folder)
    return spark.read.parquet(folder).groupBy("band").agg(
        F.count("*").alias("documents"), F.sum(F.size("hits")).alias("hits"),
        F.sum(F.size(F.filter("hits", lambda h: h["scored"]))).alias("scored"),
    )


def _retuned_sql() -> str:
    sql = Sql(RAW)
    sql.phrases("p", OWN_PHRASES)
    sql.code()
    return sql.text(
        f"""SELECT doc_id, n, -n AS total_penalty, CAST(greatest(0, least(100, {S.half_even('100 * exp(-0.04::DOUBLE * d)')})) AS INTEGER) AS score
        FROM (SELECT v.doc_id, CAST(CASE WHEN word_count >= {config.MIN_WORDS} THEN count(p.doc_id) ELSE 0 END AS INTEGER) AS n,
          CASE WHEN word_count >= {config.MIN_WORDS} THEN count(p.doc_id) / (word_count / 1000.0::DOUBLE) ELSE 0::DOUBLE END AS d
        FROM views v LEFT JOIN p USING (doc_id) GROUP BY v.doc_id, word_count)"""
    )


@query("retuned_rule", _retuned_sql)
def retuned_rule(spark, sf_dir):
    """One rule only, with a caller's phrases and penalty."""
    rules = default_rules(config.Thresholds(weasel__penalty=-1), Lexicons(weasel_phrases=OWN_PHRASES))
    rows = scoring.scored(documents_of(spark, sf_dir), [r for r in rules if r.name == "weasel"])
    return rows.select("doc_id", F.col("n_weasel").alias("n"), "total_penalty", "score")


def _json_sql() -> str:
    sql = Sql()
    sql.scores()
    return sql.text(
        "SELECT to_json({'doc_id': doc_id, 'word_count': word_count, 'total_penalty': total_penalty, 'score': score, 'band': band})::VARCHAR AS value FROM scores"
    )


@query("results_json", _json_sql)
def json_lines(spark, sf_dir):
    return results_json(
        scoring.scores(seeded(spark, sf_dir)).select("doc_id", "word_count", "total_penalty", "score", "band")
    )


def _analysis_sql() -> str:
    sql = Sql()
    sql.scores()
    return sql.text(
        """SELECT s.doc_id, s.score, s.band, CAST(coalesce(h.n, 0) AS INTEGER) AS hits, CAST(coalesce(k.n, 0) AS INTEGER) AS counted,
          CAST(coalesce(k.keys, 0) AS INTEGER) AS rules_hit, h.first AS first_rule
        FROM scores s LEFT JOIN (SELECT doc_id, count(*) AS n, arg_min(rule, seq) AS first FROM all_hits GROUP BY doc_id) h USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(n) AS n, count(*) FILTER (n > 0) AS keys FROM counts GROUP BY doc_id) k USING (doc_id)"""
    )


@query("analysis_record", _analysis_sql)
def analysis_record(spark, sf_dir):
    counts = F.map_values("counts")
    return scoring.analyze(seeded(spark, sf_dir)).select(
        "doc_id", "score", "band", F.size("hits").alias("hits"),
        F.aggregate(counts, F.lit(0), lambda a, x: a + x).alias("counted"),
        F.size(F.filter(counts, lambda x: x > 0)).alias("rules_hit"),
        F.get("hits", F.lit(0))["rule"].alias("first_rule"),
    )
