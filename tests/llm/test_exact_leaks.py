"""Leaks against all windows, with shingles that weigh much."""

from collections import Counter

from prosegauge.llm import decontaminate


def text(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def best(doc, item):
    """The largest similarity of any window, of the item's number of words, of a document not shorter than the item."""
    doc, item = doc.split(), item.split()
    found, want = [], grams(item)
    for at in range(len(doc) - len(item) + 1):
        have = grams(doc[at : at + len(item)])
        shared = (have & want).total()
        found.append(shared / (have.total() + want.total() - shared))
    return max(found)


def test_heavy_shingles_at_the_limit(spark):
    items = {}
    docs = {}
    # 84 shared shingles, and one word's run of 14 (ten times one shingle) in place of another's.
    for k in range(12):
        items[k] = text(f"a{k}_", 88) + f" {'x%d ' % k * 14}".rstrip()
        docs[k] = text(f"a{k}_", 88) + f" {'y%d ' % k * 14}".rstrip()
    for k in range(12, 16):  # one word of 60 in the middle changed; and a passage that all of these items have
        items[k] = text(f"b{k}_", 40) + " " + text("all", 30)
        docs[k] = text("lead", 7) + " " + items[k].replace(f"b{k}_20 ", "z ") + " " + text("tail", 9)
    docs[90], docs[91] = text("all", 30) + " " + text("c", 80), text("d", 200)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if len(t.split()) >= len(s.split()) and best(t, s) >= 0.75}
    assert want == {(k, k) for k in items}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaking(frame, bench).collect()}
    assert set(got) == want
    assert all(abs(s - best(docs[d], items[i])) < 1e-12 for (d, i), s in got.items())


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 40)
    items = [(k, text(f"p{k}_", 30)) for k in range(6)]
    docs = spark.createDataFrame([(k, f"before it {t} after") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.leaking(docs, bench).collect()} == {(k, k, 1.0) for k, _ in items}


def test_parts_in_another_order(spark):
    """The best window need not begin where the item does."""
    first, second = text("f", 30), text("s", 30)
    items = [(1, f"{first} {second}")]
    docs = {1: f"{text('l', 100)} {second} {first} {text('t', 100)}", 2: f"{second} {first}", 3: f"{text('l', 100)} {first} {second} {text('t', 100)}"}
    got = {r["doc_id"]: r["similarity"] for r in decontaminate.leaking(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 1.0
    assert all(abs(got[d] - best(docs[d], items[0][1])) < 1e-12 for d in docs)


def test_moved_blocks_and_repeats_against_all_windows(spark):
    """Random items, cut into blocks that are moved, repeated or changed inside documents."""
    import random

    rng = random.Random(11)
    items = {i: [f"w{rng.randrange(40)}" if rng.random() < 0.3 else f"i{i}x{k}" for k in range(rng.randrange(6, 60))] for i in range(12)}
    items[12], items[13], items[14] = ["same"] * 25, ["a", "b"] * 15, ["one", "two", "three"]
    docs = {}
    for d in range(150):
        item = list(items[rng.randrange(15)])
        cut = sorted(rng.randrange(len(item) + 1) for _ in range(rng.randrange(3)))
        blocks = [item[a:b] for a, b in zip([0, *cut], [*cut, len(item)])]
        rng.shuffle(blocks)
        body = [w for b in blocks for w in b]
        for _ in range(rng.randrange(3)):
            body[rng.randrange(len(body))] = "changed"
        around = lambda: [f"r{rng.randrange(500)}" for _ in range(rng.randrange(80))]
        docs[d] = around() + body + (body if d % 7 == 0 else []) + around()

    def similarity(doc, item):
        width = min(5, len(item))
        of = lambda words: Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
        want, found = of(item), [0.0]
        if len(doc) >= width:
            for at in range(max(1, len(doc) - len(item) + 1)):
                have = of(doc[at : at + len(item)])
                shared = (have & want).total()
                found.append(shared / (have.total() + want.total() - shared))
        return max(found)

    expected = {(d, i): s for d, w in docs.items() for i, v in items.items() if (s := similarity(w, v)) >= 0.75}
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], f"{name} long, text string")
    rows = decontaminate.leaking(frame(docs, "doc_id").repartition(3), frame(items, "item_id")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert len(expected) > 60 and set(got) == set(expected)
    assert all(abs(s - expected[k]) < 1e-12 for k, s in got.items())
