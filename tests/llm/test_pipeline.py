"""The pipeline's stages on odd rows: each against brute force on what the one before kept, and the whole."""

import random
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import md5

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from prosegauge.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    """Clean prose and repeated junk; near copies, passages of the benchmark, nulls, blanks, repeats, a very long text."""
    rng = random.Random(3)
    good, bad = [f"word{i}" for i in range(300)], ["BUY", "now!!!", "$$$", "click", "xx9", "free#", "||"]
    prose = lambda n: " ".join(rng.choice(good) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(bad) for _ in range(n))
    texts = [prose(rng.randrange(40, 120)) for _ in range(120)] + [junk(rng.randrange(40, 120)) for _ in range(80)]
    items = [prose(40) for _ in range(5)]
    near = prose(100).split()
    texts += [" ".join(near[:k] + ["edit"] + near[k + 1 :]) for k in range(10, 60, 10)]
    texts += [f"{prose(30)} {item} {prose(30)}" for item in items[:3]]
    halves = items[3].split()
    texts += [f"{prose(60)} {' '.join(halves[20:] + halves[:20])} {prose(60)}"]
    texts += [prose(30_000), None, "", " \t\n", "one", texts[5], texts[5]]
    docs = [(i if i % 17 else None, t, [None, "en", "de"][i % 3], None if i % 11 == 0 else f"src{i % 6}", None) for i, t in enumerate(texts)]
    docs += [docs[7], docs[7], (3, "another text under the same number " + prose(40), "en", "src1", 1)]
    labels = [(i, int(not any(w in (t or "") for w in ("BUY", "click"))), None) for i, t in enumerate(texts) if i % 17 and t and i % 2]
    return docs, labels + [(None, 1, 1), (9, None, None)], [*enumerate(items), (None, items[4]), (77, None), (78, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, benchmark = tables()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def kept(spark, folder, tmp_path_factory):
    """What each stage kept, written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [df.collect() for df in out]


def shingles(text, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_columns(spark, kept, folder):
    names = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(list(rows[0].asDict()) == names for rows in kept[:5])
    assert all(set(map(tuple, b)) <= set(map(tuple, a)) for a, b in zip(kept[:4], kept[1:5]))


def test_quality(spark, kept, folder):
    """Junk goes and prose stays; a row stays or goes by the score of its text alone."""
    before, after = Counter(map(tuple, kept[0])), Counter(map(tuple, kept[1]))
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels, "quality", F.lit(True))
    scores = {r["text"]: r["score"] for r in quality.score(docs, model).collect()}
    assert after == Counter({row: n for row, n in before.items() if scores[row[1]] >= 0.7})
    assert not any("click" in (row[1] or "") for row in after)
    assert sum(after.values()) > 120


def test_one_of_each(kept):
    """Of the rows that similarity links, one stays; rows without words all do."""
    rows = kept[1]
    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, s in enumerate(sets):
        groups.setdefault(root(i) if s else ("blank", i), []).append(rows[i])
    assert any(len(g) >= 5 for g in groups.values())
    left = Counter(map(tuple, kept[2]))
    assert sum(left.values()) == len(groups)
    for members in groups.values():
        assert sum(left[row] > 0 for row in set(map(tuple, members))) == 1


def test_no_leaks(kept, folder, spark):
    items = [r["text"].split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"] and r["item_id"] is not None]

    def leaks(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        if len(words) < 5:
            return False
        for item in items:
            want = Counter(tuple(item[i : i + 5]) for i in range(len(item) - 4))
            for at in range(max(1, len(words) - len(item) + 1)):
                part = words[at : at + len(item)]
                have = Counter(tuple(part[i : i + 5]) for i in range(len(part) - 4))
                shared = (have & want).total()
                if shared and shared / (have.total() + want.total() - shared) >= 0.75:
                    return True
        return False

    expected = [r for r in kept[2] if not leaks(r["text"])]
    assert len(kept[2]) - len(expected) == 4  # three in place, one with its halves swapped
    assert Counter(map(tuple, kept[3])) == Counter(map(tuple, expected))


def budgets(leaves, mix):
    """What each leaf may spend, by exact fractions and integer division as the mix defines it."""
    def share(names, caps, weights, budget):
        given, open_names, left = {}, list(names), budget
        while True:
            total = sum(weights[n] for n in open_names)
            full = [n for n in open_names if total and Fraction(caps[n]) <= Fraction(weights[n] * left, total)]
            if not full:
                break
            for n in full:
                given[n] = caps[n]
                left -= caps[n]
                open_names.remove(n)
        for n in open_names:
            given[n] = weights[n] * left // sum(weights[m] for m in open_names)
        return given

    def down(prefix, budget, depth):
        if depth == len(mixing.LEVELS):
            return {prefix: budget}
        level = mixing.LEVELS[depth]
        children = sorted({k[depth] for k in leaves if k[:depth] == prefix})
        caps = {c: mix.epochs * sum(t for k, t in leaves.items() if k[: depth + 1] == (*prefix, c)) for c in children}
        weights = {c: mix.weights.get(level, {}).get(c, 1) for c in children}
        out = {}
        for c, b in share(children, caps, weights, budget).items():
            out |= down((*prefix, c), b, depth + 1)
        return out

    return down((), sum(leaves.values()) * mix.numerator // mix.denominator, 0)


def test_mixing(kept):
    """Every leaf spends its budget on whole epochs and a prefix of one more, in the seeded order."""
    mix, leaves, units = mixing.PRODUCTION, Counter(), {}
    for r in kept[3]:
        number = "".join(c for c in (r["source"] or "")[3:])
        key = (f"d{int(number) % 4}" if number else "other", r["lang"] or "", r["source"] or "")
        n = len((r["text"] or "").split())
        if n:
            leaves[key] += n
            units.setdefault(key, []).append((r, n))
    expected = Counter()
    for key, budget in budgets(leaves, mix).items():
        epochs, rest = divmod(budget, leaves[key])
        name = lambda r: "-" if r["doc_id"] is None else str(r["doc_id"])
        order = sorted(units[key], key=lambda u: (md5(f"{mix.seed}:{epochs}:{name(u[0])}".encode()).hexdigest(), u[0]["doc_id"] is not None, u[0]["doc_id"] or 0, u[1]))
        total = 0
        for r, n in order:
            total += n
            expected[tuple(r)] += epochs + (total <= rest)
    got = Counter(map(tuple, kept[4]))
    without_id = lambda c: Counter({k: v for k, v in c.items() if k[0] is not None})
    # Rows without an id share a place in the order; their number is all that can differ.
    assert without_id(+expected) == without_id(got)
    assert abs((+expected).total() - got.total()) <= 3


def test_tokens(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(kept[4], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    expected = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in kept[5]) == expected
    starts = sorted((r["start"], r["n_tokens"]) for r in kept[5])
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]


def test_run_is_all_stages(spark, kept, folder):
    whole = corpus_pipeline.run(spark, folder).collect()
    digest = lambda rows: Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert digest(whole) == digest(kept[5])


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
