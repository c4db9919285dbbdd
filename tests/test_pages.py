"""Page extraction on small pages."""

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import pages as P
from prosegauge.operators.layout import layout_to_text

LONG = "lorem " * 80

PAGES = {
    1: (
        '<html><head><title>x</title></head><body><nav><a href="/">home</a></nav><article class="post-content">'
        "<h2>T &amp; &#8212; &#x41; &bogus;</h2><p>One <b>two</b> three<p>Four <i>five</i><br>six <code>c</code></p>"
        "<ul> loose <li>a<li>b <ol><li>x</li><li>y</li></ol></li></ul><hr><blockquote><p>q1</p><p>q2</p>"
        "<blockquote>in</blockquote></blockquote><pre><code class=\"language-py\">def f():\n    return 1\n\n</code></pre>"
        "<table><caption>no</caption><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table>"
        '<div style="white-space: pre-wrap">l1\nl2\n \nl3</div><div hidden>no</div><div class="big sidebar">no</div>'
        '<div style="display: none">no</div><p aria-hidden="true">no</p><div role="search">no</div>'
        f"<p>{LONG}</p></article><footer>f</footer></body></html>"
    ),
    2: (
        f"<body><div id=a><div id=b><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div>"
        f"<ul><li><a>{LONG}</a></li></ul></body>"
    ),
    3: "<body><p>too little <b>text</p></body>",
    4: f'<body><main>{LONG}</main><div itemprop="articleBody">{LONG}body</div></body>',
}

MARKDOWN = """## T & — A &bogus;

One **two** three

Four _five_
six `c`

- a
- b

1. x
2. y

---

> q1
> q2
> > in

```py
def f():
    return 1
```

| A | B |
| --- | --- |
| 1 |  |

l1
l2

l3

""" + LONG.strip()


@pytest.fixture(scope="module")
def tokens(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    return P.with_ends(P.html_tokens(df)).cache()


def test_markdown(tokens):
    got = {r.page_id: r.markdown for r in P.to_markdown(tokens).collect()}
    assert got[1] == MARKDOWN
    assert got[3] == "too little **text**"
    assert got[4] == LONG + "body"


def test_roots(tokens):
    got = {r.page_id: (r.root_tag, r.how) for r in P.pick_root(tokens).collect()}
    assert got == {1: ("article", "semantic"), 2: ("div", "scored"), 3: ("body", "body"), 4: ("div", "semantic")}
    root = P.pick_root(tokens).filter("page_id = 2").first()
    attrs = tokens.filter((F.col("page_id") == 2) & (F.col("seq") == root.root_seq)).first().attrs
    # The inner box holds two paragraphs (2n); the outer one gets 3n/2.
    assert attrs == "id=b"


def test_offsets_and_located_hits(spark, tokens):
    md = P.to_markdown(tokens)
    offsets = P.offset_map(tokens)
    both = offsets.join(md, "page_id").join(
        tokens.select("page_id", F.col("seq").alias("node"), "text"), ["page_id", "node"]
    )
    n = F.col("md_end") - F.col("md_start")
    wrong = both.filter(
        F.substring("markdown", F.col("md_start") + 1, n) != F.substring("text", F.col("node_start") + 1, n)
    )
    assert both.count() > 100 and wrong.count() == 0
    start = MARKDOWN.index("two")
    rows = [
        (1, 0, start, start + 3), (1, 1, start + 1, start + 9), (1, 2, MARKDOWN.index("def"), MARKDOWN.index("def") + 3),
        (1, 3, start - 2, start + 5),
    ]
    hits = spark.createDataFrame(rows, "page_id long, seq int, start int, end int")
    got = {r.seq: r for r in P.locate_hits(hits, P.mapped_markdown(tokens)).collect()}
    assert (got[0].from_offset, got[0].to_offset) == (0, 3) and got[0].from_node == got[0].to_node
    assert got[1].from_offset == 1 and got[1].to_node > got[1].from_node
    assert 2 not in got  # code blocks are not mapped
    assert (got[3].from_offset, got[3].to_offset) == (0, 3)


def test_located_against_all_pairs(spark):
    """Runs and hits in any order and overlap, against comparing each hit with each run."""
    import random

    rng = random.Random(4)
    for case in range(30):
        at, runs = 0, []
        for _ in range(rng.randrange(0, 12)):
            at += rng.randrange(0, 4)
            n = rng.randrange(1, 5)
            runs.append((at, at + n, rng.randrange(9), rng.randrange(20)))
            at += n
        hits = sorted((s, s + rng.randrange(0, 6), i) for i, s in enumerate(rng.randrange(0, at + 3) for _ in range(rng.randrange(0, 9))))
        expected = []
        for start, end, name in hits:
            first = next((r for r in runs if r[1] > start), None)
            last = next((r for r in reversed(runs) if r[0] < max(end, start + 1)), None)
            if first and first[0] < end:
                size = min(last[1] - last[0], max(1, end - last[0]))
                expected.append((name, first[2], first[3] + max(0, start - first[0]), last[2], last[3] + size))
        df = spark.createDataFrame(
            [(1, runs, hits)],
            "page_id int, runs array<struct<md_start:int,md_end:int,node:int,node_start:int>>, hits array<struct<start:int,end:int,name:int>>",
        )
        got = [tuple(r) for r in P.located_hits(df, F.col("hits")).select("name", "from_node", "from_offset", "to_node", "to_offset").collect()]
        assert got == expected, (case, runs, hits)


def test_one_run_of_a_page_gives_located_hits(spark):
    from prosegauge.functions.text import spans

    df = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    mapped = P.mapped_markdown(P.with_ends(P.html_tokens(df)))
    found = P.located_hits(mapped, spans(F.col("markdown"), "[a-z]+"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Join" not in plan
    assert found.count() > 200


def test_guard_is_a_label(spark):
    big = "<body>" + "<i></i>" * 12_001 + "</body>"
    df = spark.createDataFrame([(1, big), (2, "<body>" + "x" * 500_001), (3, "<body>x")], "page_id long, html string")
    tokens = P.html_tokens(df)
    got = {r.page_id: r.status for r in P.page_guard(tokens).collect()}
    assert got == {1: "too_large", 2: "too_large", 3: "ok"}
    assert {r.status for r in P.page_guard(tokens, 10**6, 10**6).collect()} == {"ok"}
    assert {r.page_id: len(r.markdown) for r in P.extract(df).collect()} == {1: 24_002, 2: 500_001, 3: 1}


def page_of(n):
    """A page of n elements: paragraphs in boxes in boxes."""
    body = "".join(f"<div id=a{i}><div><p>A paragraph of more than twenty-five letters, number {i}.</p></div></div>" for i in range(n // 3))
    return f"<body>{body}</body>"


def test_a_page_of_20_000_elements(spark):
    df = spark.createDataFrame([(1, page_of(20_000))], "page_id long, html string")
    tokens = P.with_ends(P.html_tokens(df))
    assert P.elements(tokens).filter("tag <> 'body'").count() == 3 * (20_000 // 3)
    credits = P.score_roots(tokens)
    assert credits.count() == 2 * (20_000 // 3)
    text = P.to_markdown(tokens).first().markdown
    assert text.count("\n\n") == 20_000 // 3 - 1


def test_time_of_credits_grows_with_the_elements(spark):
    import time

    def seconds(n):
        df = P.with_token_array(P.with_ends(P.html_tokens(spark.createDataFrame([(1, page_of(n))], "page_id long, html string")))).cache()
        df.count()
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            df.select(F.size(P._credits(P._els(F.col("toks"))))).collect()
            times.append(time.perf_counter() - begin)
        return min(times)

    few, many = seconds(5_000), seconds(20_000)
    assert many < 8 * few + 0.5  # four times, with room


def test_entities(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &eacute;&#233;&#x1F600; &amp;amp; & &nope; &#0;",)], "t string")
    assert df.select(P.decode_entities(F.col("t"))).first()[0] == "a <b> éé😀 &amp; & &nope; &#0;"


def test_all_named_entities(spark):
    from html.entities import html5

    names = [n for n in html5 if n.endswith(";")]
    df = spark.createDataFrame([("|".join(f"&{n}" for n in names),)], "t string")
    assert df.select(P.decode_entities(F.col("t"))).first()[0].split("|") == "|".join(html5[n] for n in names).split("|")


def test_layout(spark):
    rows = [
        (1, 1, 0, "a", 100.0, 10.0, False), (1, 1, 1, "b", 100.0, 10.0, True), (1, 1, 2, "c", 88.0, 10.0, False),
        (1, 1, 3, "", 88.0, 10.0, True), (1, 1, 4, "d", 88.0, 0.0, False), (1, 1, 5, "e", 60.0, 10.0, False),
        (1, 2, 0, "f", 100.0, 10.0, False),
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, page int, seq int, str string, y double, height double, has_eol boolean"
    )
    assert layout_to_text(df).first().text == "ab\nc\nd\n\ne\n\nf"


def test_larger_tables_of_pages_are_dealt_to_more_tasks(spark, sf_dir, monkeypatch):
    """What one task sorts must not grow with the table."""
    from prosegauge.catalog import page_queries
    from prosegauge.sources import tables

    df = spark.createDataFrame([(i, f"<p>Page {i}.</p>") for i in range(40)], "page_id long, html string")
    dealt = P.html_tokens(df, 7)
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, P.html_tokens(df).collect()))
    small = tables.parts_by_size(spark, sf_dir, "pages")
    assert small == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "PAGE_BYTES", 1000)
    size = tables.table_bytes(spark, sf_dir, "pages")
    assert page_queries.tokens_of(spark, sf_dir).rdd.getNumPartitions() == -(-size // 1000) > small
