"""The seeded corpus: every document of the table, with prose that trips rules.

The text of the test tables is invented, so most rules never match it.  Each
document keeps its whole text and gets a snippet appended, chosen by its id.
The same rule is written as a Spark expression and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.sources.tables import load_documents, parts_by_size

_LONG = "The committee met again " + "and then the members walked past the river to count boats " * 14

SNIPPETS = (
    # 0 words
    "The crucial result was robust. Our cutting-edge plan will leverage it, and a robust method helps.\n",
    # 1 a word inside a name
    "We met Kate Nestled Brown and Robust in Paris. The Landscape Review asked Nexus. A Pivotal day.\n",
    # 2 overlapping stock phrases
    "We learn to adapt to different rooms. In addition, it's worth noting that the key takeaway is small. On the other hand, we wait.\n",
    # 3 not just, but
    "It is not just a tool, but also a habit for us. It is not only cold, but wet. Nothing else, but dry.\n",
    # 4 bold labels
    "**Speed:** it runs fast.\n**Cost.** It is cheap.\n**Scope:** wide enough.\n",
    # 5 bullets
    "- one\n- two\n* three\n1. four\n2) five\n- six\n- seven\n",
    # 6 triads
    "Red, green, and blue. One, two, and three. Cats, dogs, and birds. Tea, milk, and salt. Oak, ash, and elm. Sun, moon, and stars.\n",
    # 7 tone
    "Certainly, we can go. Absolutely! Let me know if this helps, and feel free to ask. As mentioned, then something interesting happened.\n",
    # 8 weasel
    "Many believe it works. Studies show that some argue and research suggests otherwise.\n",
    # 9 disclosure
    "As an AI I cannot browse. As of my last cutoff it held. As of my knowledge cutoff too. I'm just an AI here.\n",
    # 10 placeholders
    "Dear [insert name here], see [URL of the page] and [TODO] and [Your company].\n",
    # 11 equal sentences with copulas
    "The sky is blue and clear. The grass is green and wet. The road is long and dry. The house was old and cold. The lake is deep and calm. The hill was steep and bare.\n",
    # 12 dashes
    "We went — slowly — north -- then east — and home — again — at last.\n",
    # 13 plain contrasts
    "It is speed, not comfort. Use paper, not plastic. We want depth, not width. They sell hope, not soap. Bring water, not wine. Write code, not prose. Take steps, not leaps.\n",
    # 14 staged contrasts
    "It is not merely a road but also a promise to the town. She was not only quick but careful, too.\n",
    # 15 keyword bold and its exclusions
    (
        "The **engine** turns and the **main gear** moves with **steel** and **oil** near **heat** and **noise** now.\n"
        "**Opening** words are fine. We saw **12 km** and **$40** there. A **very long bold phrase of many words** too. A **label:** text.\n"
        "# head **bold**\n> quote **bold**\n- item **bold**\n"
    ),
    # 16 setup and resolution
    "This isn't a toy, it's a tool. That is not a wall; that's a door. It's not cold, it's dry. They don't ask. They're done. We cannot stop: the real work waits. These are not maps, these are scars.\n",
    # 17 colons
    "note: alpha beta. key: value one. see https: stop. flag: true and other: null here. label: text again. more: words. site http: bare. # no\n# title: skipped here\nlast: item set. end: it.\n",
    # 18 pithy
    "Fast, but fair. Small, yet loud. Cheap, and cheerful. Slow, or not. Fast, but fair.\n",
    # 19 quotes
    "> one\n> two\n> three\n> four\n> five\n```\n> six\n> seven\n```\nplain line\n",
    # 20 bold-term bullets
    "- **One** first\n- **Two** second\n* **Three** third\n1. **Four** fourth\n",
    # 21 dividers and a table
    "---\n***\n___\n-----\n--- x\n---\n\n| a | b |\n| --- | :-: |\n| 1 | 2 |\n| 3 | 4 |\nafter the table.\n",
    # 22 repeated phrase
    "We read the small print now. He said read the small print now. They read the small print now. You read the small print now, again.\n",
    # 23 run-on
    _LONG.strip() + ".\n",
    # 24 aphorism and equal paragraphs
    (
        "One day the old clock stopped again here.\n\nTwo days the old clock stopped again here.\n\n"
        "Six days the old clock stopped again here.\n\nTen days the old clock stopped again here.\n\n"
        "In the end the true story is the one we make.\n"
    ),
    # 25 code
    (
        "Plain words stay. `crucial robust` and ``a ` pivotal`` here.\n```py\nleverage = 'tapestry'\n# note: seamless\n```\n"
        "Then `unclosed crucial word.\n  ````\ndelve ``` still\n````\nDone.\n"
    ),
)

# Every third document gets enough copies to reach the lower bands.
DENSE_EVERY = 3
DENSE_CHARS = 300


def reps_sql() -> str:
    return (
        f"CASE WHEN doc_id % {DENSE_EVERY} = 0 "
        f"THEN 2 + CAST(floor(length(text) / {DENSE_CHARS}) AS INTEGER) "
        "ELSE 1 + CAST(doc_id % 4 AS INTEGER) END"
    )


def with_snippets(df: DataFrame) -> DataFrame:
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    reps = F.when(
        F.col("doc_id") % DENSE_EVERY == 0,
        F.lit(2) + F.floor(F.length("text") / DENSE_CHARS).cast("int"),
    ).otherwise(F.lit(1) + (F.col("doc_id") % 4).cast("int"))
    return df.withColumn("text", F.concat("text", F.lit("\n\n"), F.repeat(snippet, reps)))


#: Bytes of the table of documents that one task takes.
DOCUMENT_BYTES = 4 << 20


def documents_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents of a folder of test tables, dealt out by the size of the table.

    Its files may be few and of one row group each, which would keep few cores busy.  All
    cores get equally many parts, so that none waits for a last round of a few.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = parts_by_size(spark, sf_dir, "documents", DOCUMENT_BYTES)
    return load_documents(spark, sf_dir, *columns, parts=cores * -(-parts // cores))


def seeded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_snippets(documents_of(spark, sf_dir, *columns))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def seeded_sql() -> str:
    """A CTE body giving (doc_id, text, lang, source) of the seeded corpus."""
    arms = " ".join(f"WHEN {k} THEN {quote(s)}" for k, s in enumerate(SNIPPETS))
    return (
        "SELECT doc_id, text || chr(10) || chr(10) || repeat(CASE doc_id % "
        f"{len(SNIPPETS)} {arms} END, {reps_sql()}) AS text, lang, source FROM documents"
    )
