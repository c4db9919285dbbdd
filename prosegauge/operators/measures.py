"""Detectors that measure a whole document: sizes, shares, runs, repeats."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import patterns as P
from prosegauge.functions.text import empty, let, n_matches, population_cv, trim_ws
from prosegauge.operators.views import collapse_tables, fence_breaks, ngram_tokens, sentence_array


def runs(codes: Column, letters: str, at_least: int) -> Column:
    """Lengths of the maximal runs of the given line letters."""
    return F.transform(
        F.regexp_extract_all(codes, F.lit(f"[{letters}]{{{at_least},}}"), F.lit(0)), F.length
    )


def quote_lines(codes: Column) -> Column:
    """Quote lines outside the regions opened and closed by code toggles."""
    return n_matches(F.regexp_replace(codes, "f[^f]*(?:f|\\z)", ""), "q")


def sentence_shape(min_sentences: int) -> Column:
    """Mean, CV, shortest and longest sentence, in words."""
    words = F.transform(F.col("sents"), lambda x: x["w"])
    return F.when(
        F.col("n_sents") >= min_sentences,
        let(
            words,
            lambda w: let(
                population_cv(w),
                lambda m: F.struct(
                    m["mean"].alias("mean"),
                    m["cv"].alias("cv"),
                    F.array_min(w).alias("shortest"),
                    F.array_max(w).alias("longest"),
                ),
            ),
        ),
    )


def em_dashes() -> Column:
    text = F.col("text")
    possible = F.contains(text, F.lit("\u2014")) | F.contains(text, F.lit(" -- "))
    return F.when(possible, n_matches(text, P.EM_DASH)).otherwise(F.when(text.isNotNull(), 0))


def copula_sentences(min_sentences: int) -> Column:
    """Sentences with a form of "be" among their first six words."""
    opening = lambda x: F.regexp_extract(x["s"], P.FIRST_SIX_WORDS, 1)
    return F.when(
        F.col("n_sents") >= min_sentences,
        F.size(F.filter(F.col("sents"), lambda x: opening(x).rlike(P.COPULA))),
    )


def extreme_sentences(min_words: int) -> Column:
    """Very long sentences as (n, w, s), numbered from one."""
    text = F.col("text")
    numbered = lambda sents: F.filter(
        F.transform(
            sents,
            lambda x, i: F.struct((i + 1).alias("n"), x["w"].alias("w"), trim_ws(x["s"]).alias("s")),
        ),
        lambda x: x["w"] >= min_words,
    )
    # Without fences and tables this view equals the plain sentences.
    rewritten = F.contains(text, F.lit("```")) | (
        F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))
    )
    return (
        F.when(rewritten, numbered(sentence_array(collapse_tables(fence_breaks(text)))))
        .when(F.exists("sents", lambda x: x["w"] >= min_words), numbered(F.col("sents")))
        .otherwise(empty("array<struct<n:int,w:int,s:string>>"))
    )


def closing_forms(min_sentences: int) -> Column:
    """The last sentence and how many generalising forms it matches."""

    def forms(last):
        total = F.lit(0)
        for pattern in P.APHORISMS:
            total = total + last.rlike(pattern).cast("int")
        return F.struct(last.alias("last"), total.alias("forms"))

    return F.when(
        F.col("n_sents") >= min_sentences,
        let(trim_ws(F.element_at(F.col("sents"), -1)["s"]), forms),
    )


# --- repeated phrases ------------------------------------------------------------
# Tokens that are numbered and sorted together, besides those of one document: what a worker holds does not grow with its batch.
REUSE_TOKENS = 1 << 18
REUSE = "array<struct<gram:string,n:int,count:int,first:int>>"


def repeated_ngrams(min_n: int, max_n: int, min_count: int) -> Column:
    """Repeated n-grams of a document as (gram, n, count, first).

    A gram counts every position.  It is dropped when a longer repeated gram
    holds it with the same count.  Ordered by n and count descending, then by
    first position.  The order and the containment rule are decisions of this
    library.

    Every step stays inside the row: a document's tokens are never exploded,
    because a shuffle of one row per token and size would dwarf the input.
    Arrow batches bring the tokens, and grams are numbered with arrays: a gram is the
    pair of the gram without its last token and that token, so equal numbers are equal
    texts.  A gram repeats only where the shorter one before it does, so the positions
    looked at become fewer with each size.  ASCII texts are cut into tokens there, too.
    """
    together = REUSE_TOKENS

    # Inside, so that workers get them with the column and need not find this package.
    def repeats(tokens):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = tokens.flatten().dictionary_encode()
        vocabulary, ids = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)

        at, gram = np.arange(len(ids)), doc
        levels = []
        for n in range(1, max_n + 1):
            inside = at + n <= ends[doc[at]]
            at, gram = at[inside], gram[inside]
            key = gram * max(len(vocabulary), 1) + ids[at + n - 1]
            _, first, gram, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            first, kept = at[first], count >= min_count
            if n > min_n:
                # Both halves of a repeated gram repeat; one of the same count says nothing more.
                _, shorter_at, shorter_gram, shorter_count, covered = levels[-1]
                for half in (first[kept], first[kept] + 1):
                    inner = shorter_gram[np.searchsorted(shorter_at, half)]
                    covered[inner[shorter_count[inner] == count[kept]]] = True
            if n >= min_n:
                levels.append((first, at, gram, count, ~kept))
            again = kept[gram]
            at, gram = at[again], gram[again]

        first = np.concatenate([x[0][~x[4]] for x in levels])
        count = np.concatenate([x[3][~x[4]] for x in levels])
        n = np.concatenate([np.full((~x[4]).sum(), min_n + k) for k, x in enumerate(levels)])
        order = np.lexsort((first, -count, -n, doc[first]))
        first, count, n = first[order], count[order], n[order]
        grams = [" ".join([vocabulary[k] for k in ids[f : f + m]]) for f, m in zip(first.tolist(), n.tolist(), strict=True)]
        found = pa.StructArray.from_arrays(
            [
                pa.array(grams, pa.string()), pa.array(n, pa.int32()), pa.array(count, pa.int32()),
                pa.array(first - (ends - sizes)[doc[first]], pa.int32()),
            ],
            ["gram", "n", "count", "first"],
        )
        each = np.bincount(doc[first], minlength=len(sizes))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), found)

    def tokens_of(texts):
        """Of ASCII texts: tokens between white space, from their first to their last word character."""
        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        if data is None or not len(texts):
            return pa.array([[]] * len(texts), pa.list_(pa.large_string()))
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        byte = np.frombuffer(data, np.uint8)[: at[-1]]
        space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        letter = (byte | 32) - 97 < 26
        in_word = np.flatnonzero(letter | (byte - 48 < 10) | (byte == 95))
        # A token ends at white space and where another text begins.
        space[at[:-1][at[:-1] < at[-1]]] = True
        run = np.cumsum(space, dtype=np.int32)[in_word]
        cut = np.flatnonzero(np.diff(run)) + 1
        first, last = (in_word[np.append(0, cut)], in_word[np.append(cut - 1, -1)]) if len(in_word) else (in_word, in_word)
        first, last = first[first >= at[0]], last[first >= at[0]]
        bounds = np.stack([first, last + 1], 1).ravel()
        pieces = pa.LargeStringArray.from_buffers(max(len(bounds) - 1, 0), pa.py_buffer(bounds), data)
        tokens = pieces.take(pa.array(np.arange(0, len(bounds), 2)))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at), pa.int32()), tokens)

    def measure(tokens):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // together)) + 1
        return pa.concat_arrays([repeats(tokens.slice(a, b - a)) for a, b in pairwise([0, *cuts.tolist(), len(tokens)])])

    def of_ascii(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (8 * together))) + 1
        return pa.concat_arrays([measure(tokens_of(texts.slice(a, b - a))) for a, b in pairwise([0, *cuts.tolist(), len(texts)])])

    text = F.col("text")
    ascii_only = F.octet_length(text) == F.length(text)
    found = F.when(ascii_only, F.arrow_udf(of_ascii, REUSE)(F.when(ascii_only, F.lower(text)))).otherwise(
        F.arrow_udf(measure, REUSE)(F.when(~ascii_only, ngram_tokens(text)))
    )
    return F.coalesce(found, empty(REUSE))
