"""Word and phrase lists, as data a caller can replace.

The lists are fixed values: results depend on every entry and on the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
ADJECTIVES = (
    "crucial", "groundbreaking", "pivotal", "paramount", "seamless",
    "holistic", "multifaceted", "meticulous", "profound", "comprehensive",
    "invaluable", "notable", "noteworthy", "game-changing", "revolutionary",
    "pioneering", "visionary", "formidable", "quintessential", "unparalleled",
    "stunning", "breathtaking", "captivating", "nestled", "robust",
    "innovative", "cutting-edge", "impactful", "foundational", "actionable",
    "collaborative", "societal", "impeccable", "stylistic",
)
VERBS = (
    "delve", "delves", "delved", "delving", "embark", "embrace", "elevate",
    "foster", "harness", "unleash", "unlock", "orchestrate", "streamline",
    "transcend", "navigate", "underscore", "showcase", "leverage", "ensuring",
    "highlighting", "emphasizing", "reflecting", "reshape",
)
NOUNS = (
    "landscape", "tapestry", "journey", "paradigm", "testament", "trajectory",
    "nexus", "symphony", "spectrum", "odyssey", "pinnacle", "realm",
    "intricacies", "ecosystem", "authenticity", "narrative", "perseverance",
)
HEDGES = (
    "significantly", "interestingly", "remarkably", "surprisingly",
    "fascinatingly", "subtly",
)
SYSTEM_NOUNS = (
    "ecosystem", "landscape", "nexus", "realm", "spectrum", "symphony", "tapestry",
)
TIMELINE_NOUNS = ("journey", "narrative", "odyssey", "trajectory")

# Fixed values.
STOCK_PHRASES = (
    "it's worth noting", "it's important to note", "this is where things get interesting",
    "here's the thing", "at the end of the day", "in today's fast-paced",
    "as technology continues to", "something shifted", "everything changed",
    "the answer? it's simpler than you think", "what makes this work is",
    "this is exactly", "let's break this down", "let's dive in",
    "in this post, we'll explore", "in this article, we'll", "let me know if",
    "would you like me to", "i hope this helps", "as mentioned earlier",
    "as i mentioned", "without further ado", "on the other hand", "in addition",
    "in summary", "in conclusion", "you might be wondering",
    "the obvious question is", "no discussion would be complete", "great question",
    "that's a great", "if you want, i can", "i can adapt this", "i can make this",
    "here are some options", "here are a few options", "would you prefer",
    "shall i", "if you'd like, i can", "i can also", "in other words",
    "put differently", "that is to say", "to put it simply", "to put it another way",
    "what this means is", "the takeaway is", "the bottom line is",
    "the key takeaway", "the key insight", "many moving parts",
    "on the same page", "long-term impact", "the results will follow",
    "small fixes add up", "what truly makes this work is",
    "the answer is straightforward", "the answer is simpler than it seems",
    "without overwhelming", "untethered from", "example scenario",
    "lens through which", "remains essential", "lived reality",
    "highlight the need for", "collaborate closely", "address this gap",
    "communicate openly", "can feel overwhelming", "work together to build",
    "effective communication", "great starting point", "deliberate choice",
    "providing clear", "can vary based on", "specific needs",
    "to adapt to different", "adapt to different", "dynamic environment",
    "build confidence", "we inhabit", "informed decision", "learned behavior",
    "strategic direction", "in contemporary", "these findings suggest",
    "these results suggest", "these metrics suggest", "these observations suggest",
    "these measurements suggest", "the practical implication is",
    "the practical consequence is", "it remains unclear",
    "does not necessarily imply", "note that this", "note that the",
    "making them available", "making it available",
)
INVITATIONS = (
    "as i mentioned", "as mentioned earlier", "feel free to",
    "here are a few options", "here are some options", "i can adapt this",
    "i can also", "i can make this", "i hope this helps", "if you'd like, i can",
    "if you want, i can", "let me know if", "shall i", "would you like me to",
    "would you prefer",
)
ANNOUNCEMENTS = (
    "everything changed", "something shifted",
    "the answer? it's simpler than you think", "this is where things get interesting",
)
TRANSITIONS = (
    "in addition", "in conclusion", "in other words", "in summary",
    "on the other hand", "put differently", "that is to say",
    "to put it another way", "to put it simply",
)
ASSISTANT_PHRASES = (
    "would you like", "let me know if", "as mentioned", "i hope this",
    "feel free to", "don't hesitate to",
)
FALSE_NARRATIVITY = (
    "then something interesting happened", "this is where things get interesting",
    "that's when everything changed",
)
WEASEL_PHRASES = (
    "some critics argue", "many believe", "experts suggest", "studies show",
    "some argue", "it is widely believed", "research suggests",
)
DISCLOSURES = (
    "as an ai", "as a language model", "i don't have personal", "i cannot browse",
    "up to my last training",
)


@dataclass(frozen=True)
class Lexicons:
    """Every list the lexical rules read.  Replace a field to re-target a rule."""

    adjectives: tuple = ADJECTIVES
    verbs: tuple = VERBS
    nouns: tuple = NOUNS
    hedges: tuple = HEDGES
    system_nouns: tuple = SYSTEM_NOUNS
    timeline_nouns: tuple = TIMELINE_NOUNS
    stock_phrases: tuple = STOCK_PHRASES
    invitations: tuple = INVITATIONS
    announcements: tuple = ANNOUNCEMENTS
    transitions: tuple = TRANSITIONS
    assistant_phrases: tuple = ASSISTANT_PHRASES
    false_narrativity: tuple = FALSE_NARRATIVITY
    weasel_phrases: tuple = WEASEL_PHRASES
    disclosures: tuple = DISCLOSURES

    @property
    def words(self) -> tuple:
        return self.adjectives + self.verbs + self.nouns + self.hedges

    @property
    def phrases(self) -> dict:
        """Detector name to its phrases, for the literal-phrase detectors."""
        return {
            "stock_phrase": self.stock_phrases,
            "assistant_phrase": self.assistant_phrases,
            "false_narrativity": self.false_narrativity,
            "weasel_phrase": self.weasel_phrases,
            "disclosure": self.disclosures,
        }

    def word_class(self, word: str) -> str:
        for name, members in (
            ("hedge", self.hedges),
            ("verb", self.verbs),
            ("system_noun", self.system_nouns),
            ("timeline_noun", self.timeline_nouns),
            ("adjective", self.adjectives),
        ):
            if word in members:
                return name
        return "other"

    def phrase_class(self, phrase: str) -> str:
        for name, members in (
            ("invitation", self.invitations),
            ("announcement", self.announcements),
            ("transition", self.transitions),
        ):
            if phrase in members:
                return name
        return "other"


DEFAULT = Lexicons()


def lexicon_rows(lexicons: Lexicons = DEFAULT) -> list[tuple]:
    rows = [("slop_word", w, lexicons.word_class(w), i) for i, w in enumerate(lexicons.words)]
    for detector, phrases in lexicons.phrases.items():
        rows += [(detector, p, lexicons.phrase_class(p), i) for i, p in enumerate(phrases)]
    return rows


def lexicon(spark: SparkSession, lexicons: Lexicons = DEFAULT) -> DataFrame:
    """The lists as a table (detector, phrase, class, phrase_order)."""
    return spark.createDataFrame(
        lexicon_rows(lexicons), "detector string, phrase string, class string, phrase_order int"
    )
