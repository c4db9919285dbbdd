"""Ranking against brute force: nulls, blanks, ties, repeated ids and rows, long texts, several passes and trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prosegauge.llm import ranking as R

DOCS = "doc_id long, text string, item_id long, score string, rank int"
ITEMS = "item_id long, text string, doc_id long"
WORDS = [f"w{i}" for i in range(300)] + ["É", "ẞ", "ab12", "Zz"]


def tables():
    rng = random.Random(9)
    weight = [1 / (i + 1) for i in range(len(WORDS))]
    prose = lambda n: " ".join(rng.choices(WORDS, weight, k=n))
    docs = [(i, prose(rng.randrange(1, 80)), 1, "s", 2) for i in range(700)]
    docs += [(1000 + i, "w250 w251 w252", None, None, None) for i in range(30)]  # ties
    docs += [(5, prose(30), 1, "s", 2), docs[7], docs[7], (None, docs[9][1], 1, "s", 2), (None, None, 1, "s", 2), (2000, "", 1, "s", 2), (2001, "-- !", 1, "s", 2)]
    docs += [(3000, prose(20_000), 1, "s", 2)]
    items = [(i, prose(rng.randrange(1, 40)) + ("!" if i % 2 else " w0-W0_w1 x"), 4) for i in range(60)]
    items += [(70, "w250 w251 w252", 1), (71, None, 1), (72, "", 1), (73, "nothinghere", 1), (None, "w3 w4", 1), (None, "w9", 1), (2, "w77 w78", 1), items[3]]
    return docs, items


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, top=R.TOP):
    counted = [(d[0], Counter(terms(d[1]))) for d in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text, *_ in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, held in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in held}
        scored = []
        for doc, c in counted:
            n = sum(c.values())
            if n:
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                scored.append((-sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in held if t in c), doc is None, doc))
        scored = sorted(s for s in scored if s[0])
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("parts", "limits", "at_once"), [(1, R.Limits(), R.ITEM_TERMS), (6, R.Limits(4, 500, 7), R.ITEM_TERMS), (3, R.Limits(), 100)])
def test_against_brute_force(spark, monkeypatch, parts, limits, at_once):
    monkeypatch.setattr(R, "ITEM_TERMS", at_once)  # read on the driver only
    docs, items = tables()
    got = R.ranked(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS).repartition(2), limits=limits)
    assert rows_of(got) == expected(docs, items)


def test_empty(spark):
    docs, items = tables()
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert R.ranked(no_docs, spark.createDataFrame(items, ITEMS)).collect() == []
    assert R.ranked(spark.createDataFrame(docs, DOCS), no_items).collect() == []


def tree_of(vectors):
    first = np.cumsum([0, *(len(v) for v in vectors)])
    term = np.concatenate([np.array(sorted(v)) for v in vectors])
    value = np.concatenate([np.array([v[t] for t in sorted(v)], np.int64) for v in vectors])
    return R.BallTree(first, term, value, 400)


def test_bounds_hold_and_prune():
    """No document scores more than the bound of a node above it; groups of like documents are pruned whole."""
    rng = np.random.default_rng(2)
    vectors = [{int(20 * g + t): int(rng.integers(300_000, 990_000)) for t in rng.choice(20, 8, replace=False)} for g in range(20) for _ in range(100)]
    tree = tree_of(vectors)
    cuts, terms_, weights = np.array([0, 8, 8, 12]), np.array([*range(40, 48), 3, 47, 200, 399]), rng.integers(1, 9000, 12)
    nodes, bound = tree.bounds(cuts, terms_, weights)
    for i in range(3):
        q = dict(zip(terms_[cuts[i] : cuts[i + 1]].tolist(), weights[cuts[i] : cuts[i + 1]].tolist(), strict=True))
        for k, (a, b, _) in enumerate(nodes):
            assert max(sum(w * vectors[d].get(t, 0) for t, w in q.items()) for d in tree.order[a:b].tolist()) <= bound[k, i]
    best = [[R._NONE] * 10 for _ in range(3)]
    leaves = sum(child < 0 for *_, child in nodes)
    seen = tree.search(cuts[:2], terms_[:8], weights[:8], [(1, -i) for i in range(len(vectors))], best[:1])
    assert 0 < seen < leaves / 2


def test_equal_vectors_make_a_tree_with_an_end():
    tree = tree_of([{1: 5, 2: 7}] * 1000)
    best = [[R._NONE] * 3]
    tree.search(np.array([0, 1]), np.array([2]), np.array([10]), [(1, -i) for i in range(1000)], best)
    assert sorted(best[0], reverse=True) == [(70, (1, 0)), (70, (1, -1)), (70, (1, -2))]
