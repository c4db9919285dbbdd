"""Rows that repeat an id or have none are judged by their texts."""

from collections import Counter

from prosegauge.llm import decontaminate, jaccard


def text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_one_of_each_goes_by_component(spark):
    rows = [
        (None, text("a"), "x"), (None, text("b"), "x"),  # unlike texts, both without an id
        (1, text("c"), "x"), (1, text("d"), "x"),  # unlike texts under one id
        (None, text("e"), "x"), (2, text("e") + " end", "x"),  # alike, one without an id
        (3, text("f"), "x"), (4, text("f") + " end", "x"),
        (5, text("g"), "x"), (5, text("g"), "x"), (6, text("h"), "y"), (6, text("h"), "x"), (None, text("i"), "x"), (None, text("i"), "x"),
        (7, " ", "x"), (7, " ", "x"), (None, None, "x"), (None, "", "x"), (None, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = jaccard.one_of_each(docs)
    gone = Counter([(2, text("e") + " end", "x"), (4, text("f") + " end", "x"), (5, text("g"), "x"), (6, text("h"), "y"), (None, text("i"), "x")])
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(rows) - gone


def test_leaks_of_rows_without_an_id(spark):
    rows = [(None, text("a") + " " + text("b")), (None, text("c")), (None, None), (1, text("a")), (2, text("c"))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(1, text("a"))], "item_id long, text string")
    kept = [tuple(r) for r in decontaminate.without_leaks(docs, bench).collect()]
    assert Counter(kept) == Counter([rows[1], rows[2], rows[4]])
    found = decontaminate.leaking(docs, bench)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 1)]


def test_rows_without_an_id_name_no_component(spark):
    rows = [(1, text("a")), (2, text("a") + " end"), (None, text("a") + " tail"), (3, text("b")), (None, text("b")), (None, text("c")), (None, text("c") + " end"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.joined(docs).collect())
    assert got == Counter([(1, 1), (2, 1), (None, 1), (3, 3), (None, 3), (None, None), (None, None), (None, None), (9, 9)])
