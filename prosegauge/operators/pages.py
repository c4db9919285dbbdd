"""Article text from raw HTML as Markdown, by a token table and windows.

A page is split into tags and texts inside its row.  Pages are hashed by id
once, before the tokens are exploded, so that every window and every grouping
below finds the rows of a page together and sorts them without moving them
again.  Pages of any size are read; `page_guard` labels those over a caller's limits.

Elements are matched tag by tag: an opening and its closing tag are neighbours
among the rows of one tag at one nesting level.  Paragraphs, list items and
inline marks left open end at the next block.  The repairs browsers make to
broken markup are not reproduced, and only inline styles are seen.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge import config
from prosegauge.functions import patterns as P
from prosegauge.functions.text import FOLD_CHUNK, let, spans, starts

# What is read and what is left out.
SKIP_TAGS = (
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed",
    "video", "audio", "nav", "aside", "footer", "form", "button", "select", "textarea", "input",
    "dialog", "menu",
)
SKIP_ROLES = (
    "navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar",
    "toolbar", "tablist", "dialog", "alert", "form",
)
SKIP_CLASSES = (
    "mw-editsection", "mw-jump-link", "navbox", "catlinks", "infobox", "reference", "reflist",
    "noprint", "sidebar", "toc", "share", "social", "related", "newsletter",
)
SKIP_IDS = ("toc",)
SKIP_ATTRIBUTES = ("data-nosnippet",)
BLOCK_TAGS = (
    "p", "div", "section", "article", "main", "header", "figure", "figcaption", "dl", "dt", "dd",
    "address", "details", "summary", "table", "tbody", "thead", "caption",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PRESERVED = "pre|pre-wrap|pre-line|break-spaces"
MIN_ROOT_CHARS = 400
MIN_CANDIDATE_SCORE = 200
MIN_PARAGRAPH_CHARS = 25
ANCESTORS = 5
MAX_LINK_DENSITY = 0.5
# Elements without content, and elements whose content is not markup.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe")

_OPAQUE = (
    "<!--(?s:.*?)(?:-->|\\z)|<[!?][^>]*+>?"
    f"|<({'|'.join(RAW_TAGS)})\\b[^>]*+>(?s:.*?)(?:</\\1[^>]*+>|\\z)"
)
TOKEN = (
    f"(?i){_OPAQUE}"
    "|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
)

# Marks used while the Markdown is put together.  LINE and PARA stand for one
# and two guaranteed newlines, the others keep characters from being settled.
LINE, PARA = "\u0001", "\u0002"
HARD_SPACE, RAW_NEWLINE, RAW_SPACE, RAW_TAB = "\u0003", "\u0004", "\u0005", "\u0006"
QUOTE, UNQUOTE, RUN = "\u0007", "\u000e", "\u000f"
_MARKS = LINE + PARA + HARD_SPACE + RAW_NEWLINE + RAW_SPACE + RAW_TAB + QUOTE + UNQUOTE + RUN


def decode_entities(text: Column) -> Column:
    """Character references replaced: all names that HTML knows with a semicolon, decimal and hex."""
    # One literal, which the optimizer turns into a map once per query; marks part its entries.
    names = PARA.join(f"{name[:-1]}{LINE}{chars}" for name, chars in html5.items() if name.endswith(";"))
    table = F.str_to_map(F.lit(names), F.lit(PARA), F.lit(LINE))

    def decode(piece):
        name = F.regexp_extract(piece, "\\A(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z0-9]+);", 1)
        digits = F.substring(name, F.lit(2), F.length(name))
        code = (
            F.when(name.rlike("\\A#[xX]"), F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10))
            .when(name.startswith("#"), digits)
            .cast("bigint")
        )
        numeric = F.when(
            code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        )
        char = F.coalesce(numeric, F.try_element_at(table, name))
        return F.when(
            char.isNotNull(), F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece)))
        ).otherwise(F.concat(F.lit("&"), piece))

    def join(pieces):
        return F.concat(
            pieces[0],
            F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode), ""),
        )

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&", -1), join)).otherwise(text)


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, or null."""
    key = f"(?i)(?:\\A|[\\s\"']){name}\\s*=\\s*"
    value = F.coalesce(
        *[
            F.nullif(F.regexp_extract(attrs, key + form, 1), F.lit(""))
            for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")
        ]
    )
    return F.when(attrs != "", value)


def has_attribute(attrs: Column, name: str) -> Column:
    return (attrs != "") & attrs.rlike(f"(?i)(?:\\A|[\\s\"']){name}(?=[\\s=/]|\\z)")


def html_tokens(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, seq, kind, tag, attrs, text, src_start) in page order.

    The pages are hashed to `parts` partitions, if given.  A task sorts its tokens several times and
    holds many times their size, so large tables need more parts, and not larger ones.

    Kinds: open, close, void, text, raw (an element with its unparsed content)
    and comment.  Texts have their entities decoded.
    """
    placed = pages.select("page_id", F.translate("html", _MARKS, "\ufffd" * len(_MARKS)).alias("html"))
    placed = placed.repartition("page_id") if parts is None else placed.repartition(parts, "page_id")
    # Where a token starts is summed up in the page's row: no window has to sort the tokens for it.
    found = let(
        F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)),
        lambda t: let(
            starts(F.transform(t, F.length)),
            lambda begin: F.transform(t, lambda raw, i: F.struct(raw.alias("raw"), begin[i].alias("src_start"))),
        ),
    )
    raw = placed.select("page_id", F.posexplode(found).alias("seq", "t")).select("page_id", "seq", "t.*")
    text = F.col("raw")
    tag = F.lower(F.regexp_extract(text, "\\A</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
    kind = (
        F.when(text.startswith("<!") | text.startswith("<?"), "comment")
        .when(text.rlike("\\A</[a-zA-Z]"), "close")
        .when(~text.rlike("\\A<[a-zA-Z]"), "text")
        .when(tag.isin(*RAW_TAGS), "raw")
        .when(tag.isin(*VOID_TAGS), "void")
        .otherwise("open")
    )
    return raw.select(
        "page_id",
        "seq",
        kind.alias("kind"),
        F.when(kind.isin("text", "comment"), "").otherwise(tag).alias("tag"),
        F.when(
            kind.isin("open", "void"), F.regexp_extract(text, "\\A<[a-zA-Z0-9-]+\\s*((?s:.*?))/?>\\z", 1)
        )
        .otherwise("")
        .alias("attrs"),
        F.when(kind == "text", decode_entities(text)).otherwise("").alias("text"),
        "src_start",
    )


# Further tags at which an open paragraph, item or inline mark ends.
OTHER_BOUNDARIES = (
    "ul", "ol", "li", "blockquote", "pre", "hr", "body", "html", "tr", "td", "th", "nav", "footer",
    "aside",
)


def _boundary() -> Column:
    return F.col("tag").isin(*BLOCK_TAGS, *HEADINGS, *OTHER_BOUNDARIES) & F.col("kind").isin(
        "open", "close", "void"
    )


SOFT_TAGS = ("p", "li", "b", "strong", "i", "em", "code", "a", "dt", "dd", "td", "th", "tr")


def with_ends(tokens: DataFrame) -> DataFrame:
    """Match elements: `end_seq`, `text_len` and `link_len` of every opening.

    An element's lengths are differences of running sums between its first and
    its last row.  The last row is the closing tag, which is the next row of
    the same tag and level, or the next block boundary, or the end of the page;
    in each case a window finds the sum there, so nothing is joined.  Windows that
    need one order of the rows stand together, so that a page is sorted six times.
    """
    page = Window.partitionBy("page_id").orderBy("seq")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back in reverse order: a frame that only grows is
    # linear, one that shrinks from the front is quadratic.
    reverse = Window.partitionBy("page_id").orderBy(F.desc("seq"))
    to_come = reverse.rowsBetween(Window.unboundedPreceding, 0)
    later = reverse.rowsBetween(Window.unboundedPreceding, -1)
    per_tag = Window.partitionBy("page_id", "tag").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    paired = Window.partitionBy("page_id", "tag", "level", "is_pair").orderBy("seq")
    text, kind = F.col("text"), F.col("kind")
    is_open, is_close, soft = kind == "open", kind == "close", F.col("tag").isin(*SOFT_TAGS)
    size = F.length(text)
    blank = text.rlike(P.BLANK)
    lead_ws = size - F.length(F.regexp_replace(text, f"\\A{P.SPACE}+", ""))
    trail_ws = size - F.length(F.regexp_replace(text, f"{P.SPACE}+\\z", ""))

    def at_end(of_close: str, at_boundary: Column) -> Column:
        """A running value at the element's closing tag, or where the next boundary is; else null."""
        return F.when(F.col("closed"), F.col(of_close)).when(soft, at_boundary)

    # 1: levels of each tag
    depth = F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(per_tag)
    out = tokens.withColumn("depth", depth).withColumns(
        {
            "level": F.when(is_close, F.col("depth") + 1).otherwise(F.col("depth")),
            "is_pair": is_open | is_close,
            "boundary": _boundary(),
        }
    )
    # 2: in page order, how much text there is up to a row, and where the last that is not blank ends
    out = out.withColumn("t_end", F.sum(size).over(so_far))
    out = out.withColumn("t_after", F.coalesce(F.max(F.when(~blank, F.col("t_end") - trail_ws)).over(so_far), F.lit(0)))
    # 3: in reverse, where the next text begins, the next boundary, and the end of the page
    ends = F.struct(F.col("seq").alias("seq"), F.col("t_after").alias("t"))
    out = out.withColumns(
        {
            "t_next": F.min(F.when(~blank, F.col("t_end") - size + lead_ws)).over(to_come),
            "next": F.last(F.when(F.col("boundary"), ends), ignorenulls=True).over(later),
            "last": F.first(ends).over(to_come),
        }
    )
    # 4: openings next to their closing tags
    after = F.lead(F.struct("kind", "seq", "t_after")).over(paired)
    out = out.withColumns({"after": after, "opened": F.lag("kind").over(paired)})
    out = out.withColumns(
        {
            "closed": is_open & F.coalesce(F.col("after.kind") == "close", F.lit(False)),
            # Whether a closing tag belongs to an opening one.
            "matched": is_close & F.coalesce(F.col("opened") == "open", F.lit(False)),
        }
    )
    last_text = F.coalesce(at_end("after.t_after", F.col("next.t")), F.col("last.t"))
    out = out.withColumns(
        {
            "end_seq": F.when(F.col("closed"), F.col("after.seq"))
            .when(is_open & soft, F.coalesce(F.col("next.seq") - 1, F.col("last.seq")))
            .when(is_open, F.col("last.seq")),
            "text_len": F.when(
                is_open, F.greatest(F.lit(0), F.coalesce(last_text - F.col("t_next"), F.lit(0)))
            ).cast("int"),
        }
    ).drop("after", "opened", "next", "last", "t_end", "t_after", "t_next")
    # 5: in reverse, the text in links from a row on, here and at the next boundary
    linked = F.when(is_open & (F.col("tag") == "a"), F.col("text_len")).otherwise(0)
    out = out.withColumns({"linked": linked, "links": F.sum(linked).over(to_come)})
    out = out.withColumn("next_links", F.last(F.when(F.col("boundary"), F.col("links")), ignorenulls=True).over(later))
    # 6: and at the closing tag
    out = out.withColumn("closing_links", F.lead("links").over(paired))
    beyond = F.coalesce(at_end("closing_links", F.col("next_links")), F.lit(0))
    out = out.withColumn("link_len", F.when(is_open, F.col("links") - F.col("linked") - beyond).cast("int"))
    return out.drop("level", "is_pair", "linked", "links", "next_links", "closing_links")


def elements(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("kind") == "open")


def _covered(starts: Column) -> Column:
    """True inside any of the elements that `starts` marks.

    A row is inside one if an element that began at or before it ends at or
    after it: a running maximum of ends, no join.
    """
    so_far = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.max(F.when(starts, F.coalesce(F.col("end_seq"), F.col("seq")))).over(so_far)
    return F.coalesce(ends >= F.col("seq"), F.lit(False))


def furniture() -> Column:
    attrs = F.col("attrs")
    classes = F.coalesce(attribute(attrs, "class"), F.lit(""))
    class_hit = classes.rlike(f"(?:\\A|\\s)(?:{'|'.join(SKIP_CLASSES)})(?:\\s|\\z)")
    selected = F.when(
        attrs != "",
        F.coalesce(attribute(attrs, "role"), F.lit("")).isin(*SKIP_ROLES)
        | class_hit
        | F.coalesce(attribute(attrs, "id"), F.lit("")).isin(*SKIP_IDS)
        | has_attribute(attrs, SKIP_ATTRIBUTES[0]),
    ).otherwise(False)
    return F.col("kind").isin("open", "void", "raw") & (
        F.col("tag").isin(*SKIP_TAGS, "head", "title") | selected
    )


def hidden() -> Column:
    attrs = F.col("attrs")
    style = F.lower(F.coalesce(attribute(attrs, "style"), F.lit("")))
    return F.when(
        attrs != "",
        has_attribute(attrs, "hidden")
        | (F.coalesce(attribute(attrs, "aria-hidden"), F.lit("")) == "true")
        | style.rlike("(?:\\A|[;\\s])(?:display\\s*:\\s*none|visibility\\s*:\\s*hidden)"),
    ).otherwise(False)


def drop_furniture(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("skipped", _covered(furniture())).filter(~F.col("skipped")).drop("skipped")


def drop_hidden(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("unseen", _covered(hidden())).filter(~F.col("unseen")).drop("unseen")


def link_density() -> Column:
    return F.when(F.col("text_len") == 0, F.lit(1.0)).otherwise(F.col("link_len") / F.col("text_len"))


def selectors() -> list[Column]:
    """Tests for the root selectors, most specific first."""
    attrs, tag = F.col("attrs"), F.col("tag")
    value = lambda name: F.coalesce(attribute(attrs, name), F.lit(""))
    of_class = lambda name: value("class").rlike(f"(?:\\A|\\s){name}(?:\\s|\\z)")
    # The selectors in order.
    return [
        value("itemprop") == "articleBody",
        of_class("mw-parser-output"),
        tag == "article",
        value("role") == "main",
        tag == "main",
        of_class("post-content"),
        of_class("entry-content"),
        of_class("article-body"),
        value("id") == "content",
    ]


def _credits(els: Column) -> Column:
    """Elements with the credit they got from the paragraphs inside them.

    The elements of one page are folded in order with the stack of open ones; a
    paragraph credits the innermost five around it.  Only the stack is carried from one
    chunk of elements to the next: what a chunk is done with is kept apart, so that
    time grows with the number of elements and not with its square.
    """
    entry = "struct<seq:int,end_seq:int,tag:string,density:double,score:double,first:bigint>"
    none = F.expr(f"cast(array() as array<{entry}>)")

    def credited(stack, e):
        pays = e["tag"].isin("p", "li", "blockquote") & (e["text_len"] >= MIN_PARAGRAPH_CHARS)

        def pay(s, i):
            up = F.size(stack) - i
            counts = pays & (up <= ANCESTORS)
            return F.struct(
                s["seq"].alias("seq"), s["end_seq"].alias("end_seq"), s["tag"].alias("tag"),
                s["density"].alias("density"),
                F.when(counts, s["score"] + e["text_len"] / up).otherwise(s["score"]).alias("score"),
                # When it was first credited, the innermost first.
                F.when(counts & (s["score"] == 0), e["seq"].cast("bigint") * (ANCESTORS + 1) + up)
                .otherwise(s["first"])
                .alias("first"),
            )

        return F.transform(stack, pay)

    def step(acc, e):
        open_ = F.filter(acc["stack"], lambda s: s["end_seq"] >= e["seq"])
        gone = F.filter(acc["stack"], lambda s: (s["end_seq"] < e["seq"]) & (s["score"] > 0))
        new = F.struct(
            e["seq"].alias("seq"), e["end_seq"].alias("end_seq"), e["tag"].alias("tag"),
            e["density"].alias("density"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("first"),
        )
        return F.struct(
            F.concat(let(open_, lambda o: credited(o, e)), F.array(new)).alias("stack"),
            F.concat(acc["out"], gone).alias("out"),
        )

    def chunk(acc, c):
        done = F.aggregate(c, F.struct(acc["stack"].alias("stack"), none.alias("out")), step)
        return let(
            done,
            lambda d: F.struct(d["stack"].alias("stack"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")),
        )

    def chunks(e):
        last = F.greatest(F.ceil(F.size(e) / FOLD_CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(e, k * FOLD_CHUNK + 1, F.lit(FOLD_CHUNK)))

    zero = F.struct(none.alias("stack"), F.expr(f"cast(array() as array<array<{entry}>>)").alias("outs"))
    return let(
        els,
        lambda e: F.aggregate(
            chunks(e),
            zero,
            chunk,
            lambda acc: F.concat(F.flatten(acc["outs"]), F.filter(acc["stack"], lambda s: s["score"] > 0)),
        ),
    )


def _els(toks: Column) -> Column:
    """The elements of a page's token array that may be credited."""
    return F.transform(
        F.filter(toks, lambda t: (t["kind"] == "open") & ~t["tag"].isin("html", "head", "body")),
        lambda t: F.struct(
            t["seq"].alias("seq"), t["end_seq"].alias("end_seq"), t["tag"].alias("tag"),
            t["text_len"].alias("text_len"), t["density"].alias("density"),
        ),
    )


def with_token_array(tokens: DataFrame) -> DataFrame:
    """(page_id, toks): the tokens of each page as one array, in order.

    The rows of a page are together already, so nothing moves.
    """
    matched = F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(selectors())])
    extra = tokens.withColumns(
        {
            "density": F.when(F.col("kind") == "open", link_density()),
            "selected": F.when(
                (F.col("kind") == "open") & ((F.col("attrs") != "") | F.col("tag").isin("article", "main")),
                F.array_compact(matched),
            ),
        }
    )
    names = ["seq"] + [c for c in extra.columns if c not in ("page_id", "seq")]
    return extra.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("toks"))


def score_roots(tokens: DataFrame) -> DataFrame:
    """(page_id, seq, end_seq, tag, density, score) of every credited element."""
    per_page = with_token_array(tokens)
    return per_page.select("page_id", F.explode(_credits(_els(F.col("toks")))).alias("c")).select(
        "page_id", "c.seq", "c.end_seq", "c.tag", "c.density", "c.score"
    )


def with_root(per_page: DataFrame) -> DataFrame:
    """Add (root_seq, root_end, root_tag, how) to pages with a token array.

    A semantic container with enough text, else the best-credited element that
    is not mostly links, else the body.
    """
    toks = F.col("toks")
    opens = lambda test: F.get(F.filter(toks, lambda t: (t["kind"] == "open") & test(t)), F.lit(0))

    def selected(i: int) -> Column:
        first = opens(lambda t: F.coalesce(F.array_contains(t["selected"], i), F.lit(False)))
        return let(first, lambda e: F.when(e["text_len"] >= MIN_ROOT_CHARS, _shape(e)))

    semantic = F.coalesce(*[selected(i) for i in range(len(selectors()))])
    best = F.array_max(
        F.transform(
            F.filter(_credits(_els(toks)), lambda c: c["density"] <= MAX_LINK_DENSITY),
            lambda c: F.struct(
                c["score"].alias("score"), (-c["first"]).alias("first"), _shape(c).alias("root")
            ),
        )
    )
    page = per_page.withColumn("semantic", semantic)
    page = page.withColumn("best", F.when(F.col("semantic").isNull(), best))
    scored = F.when(F.col("best.score") >= MIN_CANDIDATE_SCORE, F.col("best.root"))
    body = F.coalesce(_shape(opens(lambda t: t["tag"] == "body")), _shape(opens(lambda t: F.lit(True))))
    page = page.withColumns(
        {
            "root": F.coalesce(F.col("semantic"), scored, body),
            "how": F.when(F.col("semantic").isNotNull(), "semantic")
            .when(scored.isNotNull(), "scored")
            .otherwise("body"),
        }
    )
    return page.select(
        "page_id",
        "toks",
        F.col("root.seq").alias("root_seq"),
        F.col("root.end_seq").alias("root_end"),
        F.col("root.tag").alias("root_tag"),
        "how",
    )


def _shape(e: Column) -> Column:
    return F.when(
        e["seq"].isNotNull(),
        F.struct(e["seq"].alias("seq"), e["end_seq"].alias("end_seq"), e["tag"].alias("tag")),
    )


def pick_root(tokens: DataFrame) -> DataFrame:
    """One row per page: (page_id, root_seq, root_end, root_tag, how)."""
    return with_root(with_token_array(tokens)).drop("toks")


def page_guard(
    tokens: DataFrame, most_nodes: int = config.MAX_PAGE_NODES, most_chars: int = config.MAX_TEXT_CHARS
) -> DataFrame:
    """Nodes and text characters of the body, and whether they are within a caller's limits.

    A label only: no other function here leaves out a page for its size.
    """
    so_far = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when((F.col("tag") == "body") & (F.col("kind") == "open"), 1)).over(so_far)
    is_node = F.col("kind").isin("open", "void", "text", "comment", "raw") & (F.col("tag") != "body")
    counted = tokens.withColumn("in_body", opened.isNotNull()).groupBy("page_id").agg(
        F.sum(F.when(F.col("in_body") & is_node, 1).otherwise(0)).alias("nodes"),
        F.sum(F.when(F.col("in_body"), F.length("text")).otherwise(0)).alias("chars"),
    )
    return counted.withColumn(
        "status",
        F.when(
            (F.col("nodes") > most_nodes) | (F.col("chars") > most_chars), "too_large"
        ).otherwise("ok"),
    )


# --- Markdown --------------------------------------------------------------------
def article_tokens(tokens: DataFrame) -> DataFrame:
    """The visible tokens of each page's root, with what each one writes.

    `markup` comes before a token's own text and `closing` after it; LINE and
    PARA stand for one and two guaranteed newlines.
    """
    inside = F.filter(
        "toks", lambda t: t["seq"].between(F.col("root_seq"), F.col("root_end"))
    )
    t = with_root(with_token_array(tokens)).select("page_id", F.explode(inside).alias("t"))
    t = t.select("page_id", "t.*").drop("density", "selected", "src_start", "depth", "text_len", "link_len")
    t = t.withColumn("gone", _covered(furniture() | hidden())).filter(~F.col("gone"))
    kind, tag = F.col("kind"), F.col("tag")
    is_open, is_close = kind == "open", kind == "close"
    # What the windows below need of the attributes, so that they need not carry them.
    style = F.coalesce(attribute(F.col("attrs"), "style"), F.lit(""))
    t = t.withColumns(
        {
            "class": F.when(tag.isin("pre", "code"), attribute(F.col("attrs"), "class")),
            "keeps": style.rlike(f"(?i)white-space\\s*:\\s*(?:{PRESERVED})\\s*(?:;|\\z)"),
        }
    ).drop("attrs", "gone")
    page = Window.partitionBy("page_id").orderBy("seq")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("page_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    opens = lambda *tags: is_open & tag.isin(*tags)
    step = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    count = lambda test: F.when(test, 1).otherwise(0)
    latest = lambda test, value, over: F.last(F.when(test, value), ignorenulls=True).over(over)
    cell, row, table = opens("td", "th"), opens("tr"), opens("table")
    mark = (
        F.when(tag.isin("b", "strong"), "**").when(tag.isin("i", "em"), "_").when(tag == "code", "`")
    )
    # In page order; numbers inside rows and lists are differences of running counts, so they need no order of their own.
    t = t.withColumns(
        {
            "in_pre": _covered(opens("pre")),
            "in_table": _covered(table),
            "in_cell": _covered(cell),
            "keeps_lines": _covered(is_open & F.col("keeps")),
            "lists": F.sum(F.when(tag.isin("ul", "ol"), step).otherwise(0)).over(so_far),
            "segment": F.sum(count(F.col("boundary"))).over(so_far),
            "row_no": F.sum(count(row)).over(so_far),
            "cells_so_far": F.sum(count(cell)).over(so_far),
        }
    )
    t = t.withColumns(
        {
            "segment_ends": F.coalesce(F.lead("segment").over(page) != F.col("segment"), F.lit(True)),
            "cell_no": F.col("cells_so_far") - F.coalesce(latest(row, F.col("cells_so_far"), so_far), F.lit(0)),
            "first_row": latest(table, F.col("row_no"), so_far) + 1,
        }
    )
    # In reverse: the next code element, and the cells up to the next row.
    next_row = latest(row, F.col("cells_so_far"), later)
    t = t.withColumns(
        {
            "next_code": latest(opens("code"), F.struct("seq", F.coalesce("class", F.lit("")).alias("c")), later),
            "row_cells": F.coalesce(next_row, F.max("cells_so_far").over(Window.partitionBy("page_id"))),
        }
    ).withColumn("cells", F.col("row_cells") - F.col("cells_so_far") + F.col("cell_no"))
    # In each level of lists.
    at_level = Window.partitionBy("page_id", "lists").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("items", F.sum(count(opens("li"))).over(at_level))
    t = t.withColumns(
        {
            "list_of": latest(opens("ul", "ol"), F.struct("seq", "tag", "items"), at_level),
            "item": latest(tag == "li", F.struct("seq", "kind"), at_level),
        }
    )
    in_this_list = F.col("item.seq") > F.col("list_of.seq")
    t = t.withColumns(
        {
            "item_no": F.col("items") - F.coalesce("list_of.items", F.lit(0)),
            "item_state": F.when(F.col("list_of").isNull() | in_this_list, F.col("item.kind")),
            # Inline marks left open, closed at the end of their segment.
            "left_open": F.array_join(
                F.reverse(F.collect_list(F.when(is_open & ~F.col("closed") & ~F.col("in_pre"), mark)).over(
                    Window.partitionBy("page_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                )),
                "",
            ),
        }
    )
    hard = lambda s: s.replace(" ", HARD_SPACE)
    heading = F.concat(*[F.when(tag == h, "#" * (i + 1)).otherwise("") for i, h in enumerate(HEADINGS)])
    lang = F.regexp_extract(
        F.coalesce(
            F.nullif(F.when(F.col("next_code.seq") < F.col("end_seq"), F.col("next_code.c")), F.lit("")),
            F.col("class"),
            F.lit(""),
        ),
        "language-([A-Za-z0-9_+#-]+)",
        1,
    )
    item = F.when(
        F.col("list_of.tag") == "ol", F.concat(F.col("item_no").cast("string"), F.lit(hard(". ")))
    ).otherwise(hard("- "))
    row_end = F.when(
        F.col("cells") > 0,
        F.concat(
            F.lit(hard(" |")),
            F.when(
                F.col("row_no") == F.col("first_row"),
                F.concat(F.lit(LINE + "|"), F.expr(f"repeat('{hard(' --- |')}', cast(cells as int))")),
            ).otherwise(""),
        ),
    ).otherwise("")
    markup = (
        F.when(opens("pre"), F.concat(F.lit(PARA + "```"), lang, F.lit(LINE)))
        .when(is_close & (tag == "pre"), LINE + "```" + PARA)
        .when(F.col("in_pre"), "")
        .when((tag == "br"), LINE)
        .when((tag == "hr") & (kind == "void"), PARA + "---" + PARA)
        .when(is_open & tag.isin(*HEADINGS), F.concat(F.lit(PARA), heading, F.lit(HARD_SPACE)))
        .when(is_close & tag.isin(*HEADINGS), PARA)
        .when(opens("blockquote"), PARA + QUOTE)
        .when(is_close & (tag == "blockquote"), UNQUOTE + PARA)
        .when(tag.isin("ul", "ol", "table"), PARA)
        .when(opens("li") & F.col("list_of").isNotNull(), F.concat(F.lit(LINE), item))
        .when(opens("tr") & (F.col("cells") > 0), LINE)
        .when(cell, F.when(F.col("cell_no") == 1, hard("| ")).otherwise(hard(" | ")))
        .when(is_close & (tag == "tr"), row_end)
        .when(F.col("in_table") & tag.isin("thead", "tbody", "caption"), "")
        .when((is_open | is_close) & tag.isin(*BLOCK_TAGS), PARA)
        .when(is_open & mark.isNotNull(), mark)
        .when(F.col("matched") & mark.isNotNull(), mark)
        .otherwise("")
    )
    # Text between list items or table cells is not part of either.
    loose = (F.col("list_of").isNotNull() & (F.col("lists") > 0) & F.coalesce(F.col("item_state") != "open", F.lit(True))) | (
        F.col("in_table") & ~F.col("in_cell")
    )
    kept = (kind == "text") & ~loose
    # A mark closed by its own tag is written there; others at the boundary.
    return t.withColumns(
        {
            "markup": markup,
            "closing": F.when(F.col("segment_ends"), F.col("left_open")).otherwise(""),
            "kept": kept,
        }
    )


def _draft(tokens: DataFrame) -> DataFrame:
    """One string per page, with marks for breaks, quotes and text runs.

    `texts` are the texts that have runs, in order.
    """
    text = F.col("text")
    raw = F.translate(text, " \n\t", RAW_SPACE + RAW_NEWLINE + RAW_TAB)
    lined = F.regexp_replace(
        F.regexp_replace(text, f"\\n(?:{P.BLANKS}*\\n)+{P.BLANKS}*", PARA), f"\\n{P.BLANKS}*", LINE
    )
    flowing = F.when(F.col("keeps_lines"), lined).otherwise(text)
    runs = F.regexp_replace(
        flowing, f"[[^\\p{{IsWhite_Space}}\\ufeff{LINE}{PARA}]\\u0085]+", RUN + "$0"
    )
    body = F.when(~F.col("kept"), "").when(F.col("in_pre"), raw).otherwise(runs)
    piece = F.concat(F.col("markup"), body, F.col("closing"))
    return tokens.groupBy("page_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(piece != "", F.struct("seq", piece.alias("p"))))),
                lambda x: x["p"],
            ),
            "",
        ).alias("draft"),
        F.sort_array(
            F.collect_list(F.when(F.col("kept") & ~F.col("in_pre"), F.struct("seq", "text")))
        ).alias("texts"),
    )


def _quoted(text: Column) -> Column:
    """Prefix the lines inside quotes, once per level, and drop blank ones."""
    marks = lambda line, mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))

    def prefixed(line, before):
        depth = before + marks(line, QUOTE)
        plain = F.translate(line, QUOTE + UNQUOTE, "")
        return (
            F.when(depth == 0, plain)
            .when(~plain.rlike(P.BLANK), F.concat(F.repeat(F.lit("> "), depth), plain))
        )

    def build(lines):
        # How many quotes are open before each line: a running sum of what the lines before open and close.
        change = F.transform(lines, lambda line: marks(line, QUOTE) - marks(line, UNQUOTE))
        kept = let(starts(change), lambda depth: F.transform(lines, lambda line, i: prefixed(line, depth[i])))
        return F.array_join(F.array_compact(kept), "\n")

    return F.when(F.contains(text, F.lit(QUOTE)), let(F.split(text, "\n", -1), build)).otherwise(text)


def _settled(draft: Column) -> Column:
    """White space and breaks settled; RUN marks still in place."""
    both = f" {LINE}{PARA}"
    out = F.regexp_replace(draft, f"{P.SPACE}+", " ")
    out = F.regexp_replace(out, f"{RAW_NEWLINE}+(?={LINE}```{PARA})", "")
    # A break at the edge of a quote adds nothing to it.
    out = F.regexp_replace(out, f"{QUOTE}[{both}]+", QUOTE)
    out = F.regexp_replace(out, f"[{both}]+{UNQUOTE}", UNQUOTE)
    out = F.regexp_replace(out, f"[ {LINE}]*{PARA}[{both}]*", "\n\n")
    out = F.regexp_replace(out, f" *{LINE}[ {LINE}]*", "\n")
    out = F.regexp_replace(out, f"{HARD_SPACE} +", HARD_SPACE)
    out = _quoted(F.translate(out, HARD_SPACE + RAW_SPACE + RAW_NEWLINE + RAW_TAB, "  \n\t"))
    return F.regexp_replace(out, P.TRIM, "")


def marked_markdown(article: DataFrame) -> DataFrame:
    """(page_id, marked): the Markdown with a RUN mark before every text run."""
    return _draft(article).select("page_id", "texts", _settled(F.col("draft")).alias("marked"))


def to_markdown(tokens: DataFrame) -> DataFrame:
    """(page_id, markdown) of every page's article."""
    return marked_markdown(article_tokens(tokens)).select(
        "page_id", F.translate("marked", RUN, "").alias("markdown")
    )


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, markdown) from (page_id, html), hashed to `parts` partitions, if given."""
    return to_markdown(with_ends(html_tokens(pages, parts)))


# --- offsets ---------------------------------------------------------------------
def mapped_markdown(tokens: DataFrame) -> DataFrame:
    """(page_id, markdown, runs): the Markdown of every page and where each text run of it comes from.

    `runs` are (md_start, md_end, node, node_start) in order: the run is the text of
    token `node` from `node_start` on.  Both come from one pass over the page.
    """
    found = F.flatten(
        F.transform(
            "texts",
            lambda t: F.transform(
                spans(t["text"], P.NON_SPACE + "+"),
                lambda r: F.struct(
                    t["seq"].alias("node"), r["start"].alias("node_start"), (r["end"] - r["start"]).alias("n")
                ),
            ),
        )
    )

    def placed(begin, runs):
        # The k-th mark stands before the k-th run; the first piece has no mark.
        def one(r, k):
            at = begin[k + 1]
            return F.struct(
                at.alias("md_start"), (at + r["n"]).alias("md_end"), r["node"].alias("node"), r["node_start"].alias("node_start")
            )

        return F.transform(F.slice(runs, 1, F.size(begin) - 1), one)

    begin = starts(F.transform(F.split("marked", RUN, -1), F.length))
    return marked_markdown(article_tokens(tokens)).select(
        "page_id",
        F.translate("marked", RUN, "").alias("markdown"),
        let(begin, lambda b: let(found, lambda r: placed(b, r))).alias("runs"),
    )


def offset_map(tokens: DataFrame) -> DataFrame:
    """One row per text run of the Markdown: (page_id, run_no, md_start, md_end, node, node_start)."""
    return mapped_markdown(tokens).select("page_id", F.posexplode("runs").alias("run_no", "r")).select("page_id", "run_no", "r.*")


def located(hits: Column, runs: Column) -> Column:
    """Hits of a page's Markdown with the text tokens that they stand in; both arrays are in order.

    `hits` have a start and an end.  Found are the first run that ends after a hit's
    start, and the last that begins before its end, both clipped to the hit; hits
    without one are left out.  Runs and hits are merged by one sort each for the
    starts and the ends: what stands before a hit in that order, less the hits before
    it, is the number of runs before it.
    """

    def before(at, edge: int):
        """How many runs begin before each place; at equal places a run counts if `edge` is 1."""

        def counted(h, r):
            places = F.concat(
                F.transform(r, lambda x: F.struct(x["md_start"].alias("at"), F.lit(0).alias("o"), F.lit(-1).alias("k"))),
                F.transform(h, lambda x, k: F.struct(at(x).alias("at"), F.lit(edge).alias("o"), k.alias("k"))),
            )
            numbered = F.transform(F.sort_array(places), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i")))
            mine = F.filter(numbered, lambda x: x["k"] >= 0)
            # By the number of the hit again: ends need not be in the order of starts.
            return F.transform(
                F.sort_array(F.transform(mine, lambda x, j: F.struct(x["k"].alias("k"), (x["i"] - j).alias("n")))), lambda x: x["n"]
            )

        return counted

    def build(h, r):
        start, end = (lambda x: x["start"]), (lambda x: F.greatest(x["end"], x["start"] + 1))

        def place(x, i, n_start, n_end):
            behind = F.get(r, n_start[i] - 1)
            # Runs do not overlap: the run at the start, if it reaches it, else the next.
            first = F.when(F.coalesce(behind["md_end"] > x["start"], F.lit(False)), behind).otherwise(F.get(r, n_start[i]))
            return F.struct(x.alias("hit"), first.alias("first"), F.get(r, n_end[i] - 1).alias("last"))

        def clipped(p):
            x, first, last = p["hit"], p["first"], p["last"]
            inside = F.least(last["md_end"] - last["md_start"], F.greatest(F.lit(1), x["end"] - last["md_start"]))
            return F.struct(
                x.alias("hit"),
                first["node"].alias("from_node"),
                (first["node_start"] + F.greatest(F.lit(0), x["start"] - first["md_start"])).alias("from_offset"),
                last["node"].alias("to_node"),
                (last["node_start"] + inside).alias("to_offset"),
            )

        placed = let(
            before(start, 1)(h, r),
            lambda n_start: let(before(end, -1)(h, r), lambda n_end: F.transform(h, lambda x, i: place(x, i, n_start, n_end))),
        )
        found = F.filter(
            placed, lambda p: F.coalesce(p["first"].isNotNull() & (p["first"]["md_start"] < p["hit"]["end"]), F.lit(False))
        )
        return F.transform(found, clipped)

    return let(hits, lambda h: let(runs, lambda r: build(h, r)))


def located_hits(mapped: DataFrame, hits: Column) -> DataFrame:
    """One row per hit that stands in text, from rows of `mapped_markdown` and the array of their hits.

    (page_id, the fields of a hit, from_node, from_offset, to_node, to_offset).
    """
    rows = mapped.select("page_id", F.explode(located(hits, F.col("runs"))).alias("l"))
    return rows.select("page_id", "l.hit.*", "l.from_node", "l.from_offset", "l.to_node", "l.to_offset")


def locate_hits(hits: DataFrame, mapped: DataFrame) -> DataFrame:
    """As `located_hits` for hits in a table of their own, with page_id, start and end."""
    fields = [c for c in hits.columns if c != "page_id"]
    order = ["start", "end", *(c for c in fields if c not in ("start", "end"))]
    per_page = hits.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("hits"))
    found = located_hits(mapped.join(per_page, "page_id"), F.col("hits"))
    return found.select(*hits.columns, "from_node", "from_offset", "to_node", "to_offset")
