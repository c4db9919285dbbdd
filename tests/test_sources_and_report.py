"""Readers, writers, scopes and the parts of the report."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prosegauge.catalog.fixtures import with_snippets
from prosegauge.catalog.text_queries import in_folders
from prosegauge.config import MAX_FILE_BYTES, rule_config
from prosegauge.plans import report, scoring
from prosegauge.plans.rules import default_rules
from prosegauge.sources import tables as T


def test_text_files(spark, tmp_path):
    for name, data in {"a.MD": "# hé", "b.txt": "x", "c.pdf": "%PDF", "d.log": "log"}.items():
        (tmp_path / name).write_text(data, encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in T.load_text_files(spark, str(tmp_path), {"log": "text/plain"}).collect()}
    assert got == {"a.MD": ("# hé", "ok"), "b.txt": ("x", "ok"), "c.pdf": (None, "unsupported"), "d.log": ("log", "ok")}


def test_files_over_a_limit_are_listed(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 2000)
    (tmp_path / "small.Rst").write_text("y")
    read = lambda **more: {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in T.load_text_files(spark, str(tmp_path), **more).collect()}
    assert read(most_bytes=1000) == {"big.txt": (None, "too_large"), "small.Rst": ("y", "ok")}
    assert read() == {"big.txt": ("x" * 2000, "ok"), "small.Rst": ("y", "ok")}


def test_many_small_files_share_tasks(spark, tmp_path):
    """As many tasks as asked for read the files, which may stand in folders."""
    for i in range(200):
        (tmp_path / str(i % 40)).mkdir(exist_ok=True)
        (tmp_path / str(i % 40) / f"{i}.{('txt', 'pdf')[i % 2]}").write_text(f"text {i}")
    plain, shared = T.load_text_files(spark, str(tmp_path)), T.load_text_files(spark, str(tmp_path), parts=2)
    assert shared.rdd.getNumPartitions() <= 4 < plain.rdd.getNumPartitions()
    assert sorted(shared.collect(), key=str) == sorted(plain.collect(), key=str) and shared.count() == 200


def test_tasks_list_the_files(spark, tmp_path):
    """No listing on the driver, at any depth; hidden files stay out, empty ones are files too."""
    for name, data in {
        "a.txt": "a", "empty.md": "", "no": "n", "1/b c%20.Rst": "b", "1/_x=1/2/3/d.txt": "d", "1/e.pdf": "e", "1/big.org": "x" * 99,
        ".h.txt": "h", "_u.txt": "u", "_h/f.txt": "f", "1/.h/g.txt": "g", "1/i.txt._COPYING_": "i",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    found = T.load_text_files(spark, str(tmp_path), most_bytes=50, parts=3)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString() and found.rdd.getNumPartitions() == 3
    at = f"file:{tmp_path}/"
    assert sorted(map(tuple, found.collect())) == sorted([
        (at + "a.txt", "a", "ok"), (at + "empty.md", "", "ok"), (at + "no", None, "unsupported"), (at + "1/b c%20.Rst", "b", "ok"),
        (at + "1/_x=1/2/3/d.txt", "d", "ok"), (at + "1/e.pdf", None, "unsupported"), (at + "1/big.org", None, "too_large"),
    ])
    # Patterns and single files go through Spark's reader.
    names = lambda path: sorted(r.path.removeprefix(at) for r in T.load_text_files(spark, str(tmp_path / path)).collect())
    assert names("*/*.Rst") == ["1/b c%20.Rst"] and names("a.txt") == ["a.txt"]


def test_long_listings_and_reads_come_in_batches(spark, tmp_path, monkeypatch):
    """No file is lost or doubled where a listing or the contents of a task fill more than one batch."""
    monkeypatch.setattr(T, "LISTED_ROWS", 7)
    monkeypatch.setattr(T, "READ_BYTES", 20)
    for i in range(100):
        (tmp_path / f"{i}.{('txt', 'txt', 'pdf')[i % 3]}").write_text("x" * (i % 9))
    got = T.load_text_files(spark, str(tmp_path), parts=2).collect()
    assert sorted((int(r.path.rsplit("/", 1)[1].split(".")[0]), r.text) for r in got) == [(i, None if i % 3 == 2 else "x" * (i % 9)) for i in range(100)]


def test_a_folder_of_files_is_one_tasks(spark):
    """Each folder is made by one task, and a file's name decides on its folder."""
    rows = spark.range(400).select(F.concat(F.col("id") % 200, F.lit(".txt")).alias("file"), F.lit("t").alias("text")).repartition(7)
    dealt = in_folders(rows, 30).select("file", F.spark_partition_id().alias("task")).collect()
    folders = {r.file.split("/")[0] for r in dealt}
    assert len({(r.file.split("/")[0], r.task) for r in dealt}) == len(folders) > 20
    assert len(dealt) == 400 and len({r.file for r in dealt}) == 200


def test_text_files_of_own_rows(spark, tmp_path):
    """Every document comes back from its file as the check SQL has it, empty and large ones too."""
    texts = ["", "plain", "zwei\nZeilen é 😀", "x" * (MAX_FILE_BYTES // 500), "y" * (MAX_FILE_BYTES // 500 + 1)]
    docs = spark.createDataFrame([(i, texts[i % 5], "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["load_text_files"](spark, str(tmp_path)).select("file", "status", "n_chars", "text_md5").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT file, status, n_chars, text_md5 FROM ({entry.oracle_sql()['load_text_files']})").fetchall())


def test_named_texts(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "a", "text": "t", "note": "n"}, {"name": "b", "text": "u"}]')
    assert sorted(r.name for r in T.load_named_texts(spark, str(tmp_path / "s.json")).collect()) == ["a", "b"]


def test_scope(spark):
    df = spark.createDataFrame(
        [(1, "w " * 10, "page"), (2, "few", "page"), (3, None, "page"), (4, "x" * 500_001, "page")],
        "id int, passage string, text string",
    )
    pick = lambda mode, **more: [(r.scope, r.scope_status) for r in T.choose_scope(df, mode, **more).orderBy("id").collect()]
    assert pick("auto") == [("selection", "ok"), ("page", "ok"), ("page", "ok"), ("page", "ok")]
    assert pick("auto", most=500_000)[3] == ("page", "too_large")
    assert pick("selection")[3] == ("selection", "ok")
    assert pick("selection")[1:3] == [("selection", "ok"), ("selection", "nothing_selected")]
    assert {s for s, _ in pick("page")} == {"page"}


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "plain words " * 10), (2, "crucial robust " * 10)], "doc_id long, text string")
    rules = default_rules()[:2]
    T.write_results(scoring.analyze(df, rules), str(tmp_path / "out"))
    back = {r.doc_id: r.band for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {1: "clean", 2: "saturated"}
    T.write_results_json(scoring.analyze(df, rules), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_report(spark):
    """Signals, severities and top hits, from hits that stand in the row, without a shuffle."""
    from prosegauge.operators.lexical import HITS
    from prosegauge.plans.rules import Rule

    rules = [Rule(n, n, hits=None, advice=None) for n in "abc"]
    hit = lambda context, penalty, scored=True: ("d", "m", context, penalty, 0, 9, scored)
    rows = [(1, 9, [hit("c", -8)], [hit("c m", -1), hit("c", -1), hit("x", -1, False)], [hit("c", -1)]), (2, 9, [], [], [])]
    df = spark.createDataFrame(rows, f"doc_id long, text_len int, hits_a {HITS}, hits_b {HITS}, hits_c {HITS}")
    found = report.severity(df, rules)
    assert [(r.rule, r.weight, r.hits, r.found, r.rank, r.severity) for r in found.orderBy("rank").collect()] == [
        ("a", 8, 1, 1, 1, "critical"), ("b", 2, 2, 3, 2, "high"), ("c", 1, 1, 1, 3, "moderate"),
    ]
    top = report.top_hits(df, rules, 2)
    assert [(r.seq, r.rule, r.rank) for r in top.orderBy("seq").collect()] == [(0, "a", 1), (1, "b", 1), (2, "b", 2), (4, "c", 1)]
    painted = report.paintable(df.withColumn("text_len", F.lit(10)), rules)
    assert painted.count() == 5 and report.paintable(df, rules).count() == 0
    assert report.paintable(df.withColumn("text_len", F.lit(10)), rules, 2).count() == 2
    for plan in (found, top, painted):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    labels = top.orderBy("seq").select(report.hit_label(F.col("match"), F.col("context")).alias("l")).collect()
    assert [r.l for r in labels[:2]] == ["c", "“m” c m"]


def test_indicator(spark):
    readings = spark.createDataFrame([(1, "heavy", 70), (2, None, None)], "key int, band string, slop int")
    on = report.indicator(readings).orderBy("key").collect()
    assert [(r.icon_band, r.badge_text, r.badge_colour) for r in on] == [("heavy", "70", "#DB6D28"), (None, "", None)]
    off = report.indicator(readings, report.Settings(badge=False, tint_icon=False)).first()
    assert (off.icon_band, off.badge_text) == (None, "")


def test_meta_and_rail(spark):
    row = spark.range(1).select(
        report.meta_line(F.lit(10), F.lit(1), F.lit(2.5)), report.meta_line(F.lit(10), F.lit(2), F.lit(30.0), F.lit("x")),
        report.rail_at(F.lit(0)), report.rail_at(F.lit(100)),
    ).first()
    assert list(row) == [
        "10 words  ·  1 signal  ·  2.5 penalty per 1k words", "10 words in x  ·  2 signals  ·  30 penalty per 1k words", 1, 99,
    ]


def test_config_table_and_corpus(spark):
    assert rule_config(spark).filter("rule = 'rhythm'").count() == 3
    df = spark.createDataFrame([(i, "text") for i in range(60)], "doc_id long, text string")
    assert with_snippets(df).filter(F.col("text").startswith("text\n\n")).count() == 60
