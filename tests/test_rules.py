"""Rules on boundary cases; each text is scored once, with all rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prosegauge import config, wording
from prosegauge.lexicons import Lexicons
from prosegauge.operators import lexical as L, measures as M
from prosegauge.plans import scoring
from prosegauge.plans.rules import default_rules

PAD = "the quick brown fox jumps over one lazy dog and then some more of it"
SIX = "the sky is blue and clear"


def bullets(n, mark="- x"):
    return "\n".join([mark] * n)


TEXTS = {
    "words": f"A Crucial and game-changing plan. Leverage crucial leveraged. {PAD}",
    "name_before": f"Kate Robust sang. {PAD}",
    "name_after": f"Robust Smith-Jones sang. {PAD}",
    "name_initial_after": f"Robust J. Smith sang. {PAD}",
    "name_newline": f"we met Kate\n Nestled by the lake. {PAD}",
    "not_a_name": f"in, Kate, Robust, as ever. {PAD}",
    "lower_next_to_name": f"Kate robust sang. {PAD}",
    "masked_words": f"`crucial` and ``pivotal`` {PAD}",
    "overlap": f"we need to adapt to different rooms and shall it marshall ideas {PAD}",
    "not_just": f"it is not just big, but also bold {PAD}",
    "cannot_just": f"we cannot just go, butter is here {PAD}",
    "headers2": f"**A:** one\n**B.** two\n{PAD}",
    "headers3": f"**A:** one\n**B.** two\n**C:** three\n{PAD}",
    "headers_adjacent": f"**A:** **B:** x and **C.** y {PAD}",
    "bullets5": PAD + "\n" + bullets(5),
    "bullets6": "\n".join([PAD] * 10) + "\n" + bullets(6) + "\n\n" + bullets(7),
    "bullets_split": "\n".join([PAD] * 20) + "\n" + bullets(5) + "\n\n" + bullets(5),
    "triads": " ".join(f"a{i}, b{i}, and c{i}." for i in range(7)) + PAD,
    "openers": f"Certainly, yes. Absolutely! uncertainly, no. We go absolutely far. {PAD}",
    "cutoff": f"As of my last cutoff and as of my knowledge cutoff and as of my cutoffs. I'm just a AI. {PAD}",
    "placeholders": f"[Insert name] [your] [YOUR town] [todo] [TODO: x] {PAD}",
    "dash_at_limit": "w " * 149 + "w —",
    "dash_over": "w " * 73 + "w — w —",
    "contrast6": " ".join(f"A{i}, not B{i}." for i in range(6)) + " " + PAD,
    "staged": f"It was not only fast but also quiet in the rain, yes. {PAD}",
    "bold_survivors": "we like **one** and **two** and **three** and **four** and **five** and **six** here " + PAD,
    "bold_excluded": f"**Start** of it. **Next** one. We paid **$40** and **12 km** and **a b c d e f** now.\n# h **x**\n> q **x**\n- i **x**\n{PAD}",
    "setup": f"This isn't a toy, it's a tool. {PAD}. This is not it; that's it. {PAD}",
    "colons": ("note: word " * 4 + "w " * 100),
    "pithy": "Fast, but fair. Small, yet big. One, and two. Slow, or not. " + PAD,
    "pithy_long": "One two three, but four five six. " + PAD,
    "bullet_share_at": bullets(2, "- x y z w v") + "\n" + "\n".join(["plain line of words"] * 3),
    "bullet_share_over": bullets(3, "- x y z w v") + "\n" + "\n".join(["plain line of words"] * 3),
    "quotes2": f"> a\n> b\n{PAD}",
    "quotes8": "\n".join(["> a"] * 8) + f"\n```\n> c\n```\n{PAD}",
    "bold_bullets": PAD + "\n- **A** x\n1. **B** y\n* **C** z",
    "dividers4": f"---\n***\n___\n-----\n{PAD}",
    "dividers3": f"---\n--- x\n***\n___\n{PAD}",
    "rhythm": " ".join(["one two three four."] * 5),
    "rhythm4": " ".join(["one two three four."] * 4),
    "copula": " ".join([SIX + "."] * 3 + ["one two three four five six is."] * 3),
    "copula_low": " ".join([SIX + "."] * 2 + ["one two three four five six is."] * 4),
    "extreme": "w " * 140 + ". " + PAD,
    "extreme139": "w " * 139 + ". " + PAD,
    "aphorism": f"{PAD}. {PAD}. {PAD}. In the end we choose it.",
    "aphorism_one": f"{PAD}. {PAD}. {PAD}. In the end nothing.",
    "balance": "\n\n".join(["a b c d e"] * 4),
    "balance_at": "\n\n".join(["a b c"] + ["a b c d e f g", "a b c d e f g h i j"] * 2),
    "short": "nine words are not enough to be crucial here",
    "ten": "ten words are just enough to be crucial here now",
    "clean": PAD,
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    return {r.doc_id: r for r in scoring.analyze(df).collect()}


def of(row, rule):
    return [h for h in row.hits if h.rule == rule]


COUNTS = {
    ("words", "slop_words"): 4, ("name_before", "slop_words"): 0, ("name_after", "slop_words"): 0,
    ("name_initial_after", "slop_words"): 0, ("name_newline", "slop_words"): 0,
    ("not_a_name", "slop_words"): 1, ("lower_next_to_name", "slop_words"): 1,
    ("masked_words", "slop_words"): 0, ("overlap", "slop_phrases"): 4, ("not_just", "slop_phrases"): 1,
    ("cannot_just", "slop_phrases"): 0, ("headers2", "structural"): 0, ("headers3", "structural"): 1,
    ("headers_adjacent", "structural"): 0, ("bullets5", "structural"): 0, ("bullets6", "structural"): 2,
    ("bullets_split", "structural"): 0, ("triads", "structural"): 5, ("openers", "tone"): 2,
    ("cutoff", "ai_disclosure"): 3, ("placeholders", "placeholder"): 4, ("dash_at_limit", "em_dash"): 0,
    ("dash_over", "em_dash"): 1, ("contrast6", "contrast_pairs"): 5, ("staged", "contrast_pairs"): 1,
    ("bold_survivors", "intrasentence_keyword_bold"): 6, ("bold_excluded", "intrasentence_keyword_bold"): 0,
    ("setup", "setup_resolution"): 2, ("colons", "colon_density"): 1, ("pithy", "pithy_fragment"): 4,
    ("pithy_long", "pithy_fragment"): 0, ("bullet_share_at", "bullet_density"): 0,
    ("bullet_share_over", "bullet_density"): 1, ("quotes2", "blockquote_density"): 0,
    ("quotes8", "blockquote_density"): 1, ("bold_bullets", "bold_bullet_list"): 1,
    ("dividers4", "horizontal_rules"): 1, ("dividers3", "horizontal_rules"): 0, ("rhythm", "rhythm"): 1,
    ("rhythm4", "rhythm"): 0, ("copula", "copula_chain"): 1, ("copula_low", "copula_chain"): 0,
    ("extreme", "extreme_sentence"): 1, ("extreme139", "extreme_sentence"): 0,
    ("aphorism", "closing_aphorism"): 1, ("aphorism_one", "closing_aphorism"): 0,
    ("balance", "paragraph_balance"): 1, ("balance_at", "paragraph_balance"): 0,
    ("short", "slop_words"): 0, ("ten", "slop_words"): 1,
}


@pytest.mark.parametrize("name,key", COUNTS)
def test_count(got, name, key):
    assert got[name].counts[key] == COUNTS[name, key]


def test_penalties_and_caps(got):
    # Every match is a hit; those beyond the cap do not weigh.
    for name, rule, found, scored in (
        ("bold_survivors", "intrasentence_keyword_bold", 6, 5), ("pithy", "pithy_fragment", 4, 3),
        ("contrast6", "contrast_pair", 6, 5),
    ):
        hits = of(got[name], rule)
        assert (len(hits), sum(h.scored for h in hits)) == (found, scored)
        assert [h.scored for h in hits] == [True] * scored + [False] * (found - scored)
        total = sum(h.penalty for h in got[name].hits if h.scored)
        assert got[name].total_penalty == total
    assert sum(h.scored for h in of(got["triads"], "structural")) == 5 < len(of(got["triads"], "structural"))
    assert of(got["quotes8"], "blockquote_density")[0].penalty == -12
    assert [h.penalty for h in of(got["bullets6"], "structural")] == [-3, -3]
    # Two setups: each weighs 3 * (1 + 2.5).
    row = got["setup"]
    extra = sum(abs(h.penalty) for h in row.hits if h.rule != "setup_resolution")
    assert row.weighted_sum == 2 * 3 * 3.5 + extra


def test_offsets_point_at_the_text(got):
    exact = ("slop_word", "slop_phrase", "weasel", "ai_disclosure", "placeholder", "contrast_pair",
             "intrasentence_keyword_bold", "setup_resolution", "pithy_fragment")
    seen = 0
    for name, row in got.items():
        for h in row.hits:
            if h.rule in exact:
                seen += 1
                assert TEXTS[name][h.start : h.end].lower() == h.match.lower(), (name, h)
    assert seen > 40


def test_short_text_is_clean(got):
    row = got["short"]
    assert (row.word_count, row.score, row.band, row.hits, row.advice) == (9, 100, "clean", [], [])
    assert got["ten"].word_count == 10 and got["ten"].score == 0


def say(key, *values, of=wording.ADVICE):
    return of[key] % values


ADVICE = {
    "words": [
        say("adjective", "crucial", wording.TIMES % 2, of=wording.WORD_ADVICE),
        say("adjective", "game-changing", "", of=wording.WORD_ADVICE),
        say("verb", "leverage", "", of=wording.WORD_ADVICE),
    ],
    "triads": [say("triads", 7)],
    "contrast6": [say("contrasts", 6)],
    "rhythm": [say("rhythm", "0.00", 4, 4, "4.0")],
    "bullet_share_over": [say("bullet_density", "50%")],
    "extreme": [say("extreme_sentence", 1, 140)],
    "bold_survivors": [say("keyword_bolds", 6)],
    "openers": [say("opener", "certainly")],
}


@pytest.mark.parametrize("name", ADVICE)
def test_advice(got, name):
    assert [line for line in got[name].advice if line in ADVICE[name]] == ADVICE[name]
    assert len(set(got[name].advice)) == len(got[name].advice)


def test_bands_and_score(spark):
    df = spark.createDataFrame([(s,) for s in (100, 80, 79, 60, 59, 40, 39, 20, 19, 0)], "s int")
    assert [r[0] for r in df.select(scoring.band_of(F.col("s"))).collect()] == [
        "clean", "clean", "light", "light", "moderate", "moderate", "heavy", "heavy", "saturated", "saturated",
    ]
    d = spark.createDataFrame([(0.0,), (10.0,), (1e9,)], "d double")
    assert [r[0] for r in d.select(scoring.score_of(F.col("d"))).collect()] == [100, 67, 0]


def test_guards(spark):
    rows = [(1, "w " * 300_000), (2, "w " * 250_000 + "w"), (3, " \n "), (4, "few words"), (5, PAD), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda most: {r.doc_id: (r.status, r.retryable, r.score) for r in scoring.scan(df, default_rules()[:1], most).collect()}
    expected = {
        1: ("ok", False, 100), 2: ("ok", False, 100), 3: ("no_text", True, None), 4: ("not_enough_text", True, None),
        5: ("ok", False, 100), 6: ("no_text", True, None),
    }
    assert found(None) == expected
    too_large = ("too_large", False, None)
    assert found(500_000) == expected | {1: too_large, 2: too_large}
    assert sorted(r.doc_id for r in scoring.within_limit(df, 500_000).collect()) == [3, 4, 5, 6]


def test_a_text_of_600_000_characters_gets_all_rules(spark):
    text = "\n".join(f"It is speed, not comfort, in row {i} of the long crucial list." for i in range(10_000))
    assert len(text) > 600_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = scoring.analyze(df).first()
    assert row.band == "saturated"
    for rule, word in (("contrast_pair", "speed, not comfort"), ("slop_word", "crucial")):
        hits = [h for h in row.hits if h.rule == rule]
        assert len(hits) == 10_000
        assert all(text[h.start : h.end] == word for h in (hits[0], hits[4321], hits[-1]))
        assert hits[-1].context.strip(".") in text.replace("\n", " ")
    assert sum(h.scored for h in row.hits if h.rule == "contrast_pair") == 5


def test_names_far_from_a_word(spark):
    """Whether a name stands next to a word does not depend on how far the name or its spaces reach."""
    from prosegauge.operators import lexical as L
    from prosegauge.operators.views import with_views

    long_name = "A" + "b" * 700
    texts = {
        "near": "We met Kate Robust here", "far space": "We met Kate" + " " * 700 + "Robust here",
        "far name": f"We met {long_name} Robust here", "no name": "we met" + " " * 700 + "Robust here",
        "half a name": f"we met x{long_name} Robust here", "after": "Robust" + " " * 600 + "Kate", "after lower": "Robust" + " " * 600 + "kate",
        "after long": f"Robust {long_name}", "after broken": f"Robust {long_name}-x",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = with_views(df).select("doc_id", L.word_spans(Lexicons()).alias("w")).collect()
    kept = {r.doc_id for r in rows if len(r.w)}
    assert kept == {"no name", "half a name", "after lower", "after broken"}


def test_phrases_are_looked_for_in_arrow_batches(spark):
    """One search finds which phrases a text holds, in their order; nothing else is looked for in it."""
    from prosegauge.operators import lexical as L

    phrases = ("of the", "é là", "the", "zz")
    texts = ["out of the of thé là", "é là the the", "", None, "OF THE", "😀of the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select(L.contained(F.col("text"), phrases).alias("c"), L.phrase_spans(F.col("text"), phrases).alias("s"))
    rows = found.collect()
    assert [r.c for r in rows] == [["of the", "é là", "the"], ["é là", "the"], [], [], [], ["of the", "the"]]
    brute = lambda t, p: [(t.find(p, 0), t.find(p, 0) + len(p))] if p in t else []
    assert [(x.start, x.end) for x in rows[0].s] == [y for p in phrases for y in brute(texts[0], p)]
    assert [(x.start, x.end, x.match) for x in rows[1].s] == [(0, 4, "é là"), (5, 8, "the"), (9, 12, "the")]
    assert [len(r.s) for r in rows] == [3, 3, 0, 0, 0, 2]
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("text", ["plain words\n\nand  more \n\t\n words", "", " \n\n ", "a `b c` d\n\n```\ne f\n```\ng", "a\ufeffb\x85c\n\u2003\nd"])
def test_words_of_a_document_are_those_of_its_masked_text(spark, text):
    from prosegauge.functions.text import n_words
    from prosegauge.operators.views import with_views

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = with_views(df).select("word_count", n_words(F.col("masked")).alias("n"), F.regexp_count("masked", F.lit("[\\P{IsWhite_Space}\\u0085&&[^\\ufeff]]+")).alias("plain")).first()
    assert row.word_count == row.n == row.plain


def test_rules_are_replaceable(spark):
    df = spark.createDataFrame([(1, f"zebra crossing here, crucial. {PAD}")], "doc_id long, text string")
    own = Lexicons(weasel_phrases=("zebra crossing",))
    tuned = config.Thresholds(weasel__penalty=-7)
    rules = [r for r in default_rules(tuned, own) if r.name == "weasel"]
    row = scoring.analyze(df, rules).first()
    assert [(h.rule, h.match, h.penalty) for h in row.hits] == [("weasel", "zebra crossing", -7)]
    assert dict(row.counts) == {"weasel": 1}


def brute_repeats(tokens, lo=4, hi=8, least=3):
    counts, first = Counter(), {}
    for n in range(lo, hi + 1):
        for i in range(len(tokens) - n + 1):
            g = tuple(tokens[i : i + n])
            counts[g] += 1
            first.setdefault(g, i)
    grams = {g: k for g, k in counts.items() if k >= least}

    def inside(a, b):
        return any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))

    kept = [
        g for g in grams
        if not any(len(b) > len(g) and grams[b] >= grams[g] and inside(g, b) for b in grams)
    ]
    kept.sort(key=lambda g: (-len(g), -grams[g], first[g]))
    return [(" ".join(g), len(g), grams[g], first[g]) for g in kept]


def test_repeats_against_brute_force(spark):
    rng = random.Random(7)
    docs = [[rng.choice("ab") for _ in range(n)] for n in (0, 3, 4, 12, 40, 90)]
    docs += [[rng.choice("abcdefgh") for _ in range(300)] for _ in range(6)]
    docs += [list("abcdefghij") * 5, list("aaaaaaaaaaaaaaaa")]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = df.select("doc_id", M.repeated_ngrams(4, 8, 3).alias("r")).collect()
    for row in rows:
        assert [tuple(g) for g in row.r] == brute_repeats(docs[row.doc_id]), row.doc_id


def test_repeats_are_numbered_once_in_arrow_batches(spark, monkeypatch):
    """One run over the tokens of a batch; nulls, empty texts and documents numbered in several parts come out whole."""
    monkeypatch.setattr(M, "REUSE_TOKENS", 500)
    rng = random.Random(11)
    docs = [None, "", "  ", "a b c d " * 3, "a b c d " * 2, "A, b. (c) d! " * 4]
    docs += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    got = df.select("doc_id", M.repeated_ngrams(4, 8, 3).alias("r"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for row in got.collect():
        tokens = [w.strip(",.()!").lower() for w in (docs[row.doc_id] or "").split()]
        assert [tuple(g) for g in row.r] == brute_repeats(tokens), row.doc_id


def test_words_are_looked_for_as_bytes(spark):
    words = ["delve", "edge", "cutting-edge", "vast"]
    texts = {
        "\u00e9 Delve, VAST edges edge": ([(2, 7, "Delve"), (9, 13, "VAST"), (20, 24, "edge")], True),
        "a Cutting-Edge \u0130 edge": ([(2, 14, "Cutting-Edge"), (17, 21, "edge")], True),
        "xdelve delve_ 1vast": ([], False),
        "\u00e9delve": ([(1, 6, "delve")], False),
        "": ([], False),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, x in df.select("text", L.whole_words(F.col("text"), words)).collect():
        assert ([tuple(s) for s in x.spans], x.token) == texts[text]


def test_a_word_between_letters_beyond_ascii_is_no_token(spark):
    """The document must hold a word as a token somewhere; then other places count too."""
    filler = "plain words stand here in a long enough row of them all day long and on and on"
    df = spark.createDataFrame([(1, f"\u00e9delve. {filler}"), (2, f"\u00e9delve. {filler} delve.")], "doc_id long, text string")
    got = {r.doc_id: r.n_slop_words for r in scoring.scored(df).collect()}
    assert got == {1: 0, 2: 2}


def test_ascii_tokens_are_those_of_the_pattern(spark, monkeypatch):
    """A letter beyond ASCII sends a text through the pattern, with the same grams."""
    monkeypatch.setattr(M, "REUSE_TOKENS", 4)
    odd = "(Read the small print) -- now\x1cand,\t[read]  the 'small' print; a_b--C READ\x0bthe\x0csmall\rprint!\n"
    texts = [odd, "", " . ", None, "one two three four", "four one two three four one two three " * 3, odd * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " \u00e9") for i, t in enumerate(texts) if t is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r[0]: r[1] for r in df.select("doc_id", M.repeated_ngrams(2, 8, 2)).collect()}
    assert got[3] == [] and got[6] and got[5]
    for i, text in enumerate(texts):
        if text is not None:
            assert got[i] == got[100 + i]
