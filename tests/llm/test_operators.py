"""Small tables with nulls, blanks, repeats, long texts and clashing columns, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosegauge.llm import decontaminate, jaccard, mixing, neighbours, quality, shards, substrings, token_counts, token_ids, toxicity
from prosegauge.llm.automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, node long, key string"
RNG = np.random.default_rng(3)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


LONG, SHARED = prose(30_000), prose(60)
NEAR = prose(200).split()


def edited(k):
    words = list(NEAR)
    words[10 * k] = f"edit{k}"
    return " ".join(words)


TEXTS = [
    None, "", " \t\n", "one", "two words", "two words", prose(40), prose(40) + "　wide é ẞ", LONG, LONG + " end",
    *(edited(k) for k in range(8)), prose(30) + " " + SHARED, SHARED + "\n" + prose(50), SHARED, "A b C d E f", "a B c D e F",
    "rep " * 90, "<|endoftext|> it's 12½ !!", "x\x00y",
]
ROWS = [(i, t, None if i % 7 == 0 else "en", f"src{i % 3}" if i % 5 else None, None, 1.0, 2, 3, "k") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, docs):
    """With rows that repeat an id, and without one."""
    more = [(4, "other text", "en", "src1", 1, 1.0, 2, 3, "k"), (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return docs.unionByName(spark.createDataFrame([*more, ROWS[8], ROWS[8]], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_automaton_against_all_factors():
    for _ in range(40):
        sequences = [list(RNG.integers(0, 3, RNG.integers(1, 25))) for _ in range(3)]
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        automaton.close()
        counts = Counter(tuple(s[i : i + 4]) for s in sequences for i in range(len(s) - 3))
        for s in sequences:
            covered, spans = set(), automaton.spans(s, 4, 2)
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                covered |= set(range(a, b))
            assert covered == {j for i in range(len(s) - 3) if counts[tuple(s[i : i + 4])] > 1 for j in range(i, i + 4)}


@pytest.mark.parametrize("shard", [20_000, 1])
def test_substrings(docs, shard):
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs, 35, 8, shard).collect()}
    counts = Counter(tuple(words(t)[i : i + 35]) for t in TEXTS for i in range(len(words(t)) - 34))
    for i, text in enumerate(TEXTS):
        w = words(text)
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if counts[tuple(w[j : j + 35])] > 1:
                keep[j : j + 35] = [False] * 35
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()
        assert (got[i]["kept_text"], got[i]["n_words"], got[i]["n_removed"]) == (kept, len(w), len(w) - sum(keep))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard(docs):
    sets = [shingles(t) for t in TEXTS]
    parent = list(range(len(sets)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i in range(len(sets)) if find(i) == i}


def test_leaks(spark, docs):
    items = [(1, SHARED), (2, "two words"), (3, prose(30)), (4, None), (5, ""), (None, SHARED), (6, SHARED)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaking(docs, bench).collect()}
    holders = [i for i, t in enumerate(TEXTS) if t and SHARED in t.replace("\n", " ")]
    assert got == {(i, k) for i in holders for k in (1, 6)} | {(4, 2), (5, 2)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - len({d for d, _ in got})
    assert decontaminate.leaking(docs, bench.limit(0)).count() == 0


def test_mixing_budgets(docs):
    whole = mixing.Mix({"lang": {"en": 3}}, 1, 1, 1)  # the budget is all there is: every leaf is full
    rows = mixing.chosen(docs, whole).collect()
    assert sorted((r["doc_id"], r["tokens"], r["epoch"]) for r in rows) == [(i, len(words(t)), 0) for i, t in enumerate(TEXTS) if words(t)]
    assert mixing.mixed(docs, whole).columns == docs.columns and mixing.mixed(docs, whole).count() == len(rows)


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)]
    leaves = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, mixing.Mix({}, 1, 2, 1)).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}  # half of 2,010; b takes what a lacks, c keeps its half


@pytest.mark.parametrize("count", [1, 3, 16])
def test_shards(odd, count):
    rows = shards.sharded(odd, count).collect()
    assert len(rows) == odd.count()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) < count or max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    if count == 3:
        assert len({r["shard"] for r in rows if r["doc_id"] in (4, 5) and r["size"] == 10}) == 1


def test_tokens(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.with_token_counts(docs, path).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["text"] == text and got[i]["key"] == "k"


def test_token_files(docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, at = Tokenizer.from_file(path), 0
    manifest = token_ids.write_ids(docs, str(tmp_path / "ids"), path, 2, parts=3)
    got = {r["doc_id"]: r for r in token_ids.read_ids(manifest).collect()}
    crcs = {r["doc_id"]: r["ids_crc32"] for r in token_ids.read_digests(manifest).collect()}
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["ids"], got[i]["start"], got[i]["n_tokens"]) == (ids, at, len(ids))
        assert crcs[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31])
def test_packing(bits):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = RNG.integers(0, 1 << bits, n).astype(np.uint32)
        assert (token_ids.unpack(token_ids.pack(ids, bits), bits, n) == ids).all()


def test_neighbours(spark):
    vectors = [(i, [float(x) for x in RNG.normal(size=12)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(20)]
    bad = [(400, None), (401, []), (402, [0.0] * 12), (403, [1.0, None]), (404, [float("nan")] * 12), (405, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([*vectors, *bad], "vec_id long, embedding array<double>")
    rows = neighbours.search(df, F.col("vec_id") % 7 == 0, 5).collect()
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, asked = 0, [i for i, _ in vectors if i % 7 == 0]
    for i in asked:
        near = sorted(((-round(float(x[i] @ x[j]), 12), j) for j in range(len(x)) if j != i))[:5]
        got = [(r["vec_id"]) for r in sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank"])]
        found += len({j for _, j in near} & set(got))
        if i == 7:
            assert got == [300, 301, 302, 303, 304]
    assert found >= 0.9 * 5 * len(asked) and {r["query_id"] for r in rows} == set(asked)
    assert neighbours.search(df.limit(0), F.lit(True), 5).count() == 0


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for given in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
            model = module.fit(odd, given, label, F.lit(True))
            rows = module.score(odd, model).collect()
            assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert len({round(r["score"], 9) for r in rows if not (r["text"] or "").strip()}) == 1
        assert module.scored(empty, labels).count() == 0


def test_toxicity_finds_sentences(spark):
    rows = [(i, " ".join(f"{prose(9)}." for _ in range(4)) + (f" {prose(3)} vileword {prose(3)}! {prose(9)}." if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.col("doc_id") < 300)
    new = toxicity.score(docs, model).filter("doc_id >= 300").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in new)
    hits = toxicity.offending(docs.filter("doc_id >= 300"), model).collect()
    assert {r["doc_id"] for r in hits} == {i for i in range(300, 400) if i % 4 == 0}
    assert all("vileword" in r["sentence"] and dict(rows)[r["doc_id"]][r["start"] : r["stop"]] == r["sentence"] for r in hits)


def test_held_out_quality(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_empty_and_odd_tables(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    made = [
        jaccard.joined, jaccard.one_of_each, substrings.deduplicated, shards.sharded, mixing.mix_rows,
        lambda d: token_counts.counted(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: token_ids.written_ids(d, path),
    ]
    n = odd.count()
    for make in made:
        assert make(empty).count() == 0
    for make in (made[0], made[2], made[3], made[5], made[6]):
        assert make(odd).count() == n


def test_digest(docs):
    rows = {r["doc_id"]: r["kept_sha256"] for r in substrings.deduplicated(docs).collect()}
    assert rows[0] == hashlib.sha256(b"").hexdigest() and rows[4] == hashlib.sha256(b"two words").hexdigest()
