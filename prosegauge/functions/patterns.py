"""Java regular expressions used by the operators.

Everything is written so that Java agrees with the measured semantics: white
space and word boundaries are spelled out instead of using ``\\s`` and ``\\b``,
whose meaning differs between regex dialects, and end of input is ``\\z``.
"""

from __future__ import annotations

# White space is the Unicode property, plus the byte order mark,
# minus U+0085.  A property is one test per character; spelling the same set
# out as ranges is ten times slower.
_WS = "\\p{IsWhite_Space}\\ufeff"
SPACE = f"[{_WS}&&[^\\u0085]]"
# Visible ASCII comes first: it is tested fastest, and the property holds it too.
NON_SPACE = "[!-~[\\P{IsWhite_Space}\\u0085&&[^\\ufeff]]]"
# White space without the newline.
BLANKS = f"[{_WS}&&[^\\u0085\\n]]"
# Fixed value: a word character is a letter, a digit or an underscore.
WORD = "[\\p{L}\\p{N}_]"
# ASCII word boundaries, before and after a word.
LEFT = "(?<![A-Za-z0-9_])"
RIGHT = "(?![A-Za-z0-9_])"
# Any character except a line terminator.
ANY = "[^\\n\\r\\u2028\\u2029]"
LINE_START = "(?:\\A|(?<=[\\n\\r\\u2028\\u2029]))"

TRIM = f"\\A{SPACE}+|{SPACE}+\\z"


def escape(literal: str) -> str:
    """Quote a literal for use inside a Java pattern."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in literal)


def alternation(words) -> str:
    """One pattern matching any of ``words``, longest first at each position.

    Words sharing a prefix share that part of the pattern, so that the number
    of alternatives tried per character stays small for long word lists.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [escape(c) + render(child) for c, child in node.items() if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" in node:
            return f"(?:{body})?"
        return body

    return render(tree)


# --- code spans --------------------------------------------------------------
# A fence: an indent of at most three blanks, three or more backticks, then up
# to a closing line with at least as many, or the end of the text.
FENCE = (
    f"(?<=\\n|\\A)({BLANKS}{{0,3}})((`{{3,}})(?!`)[^\\n]*(?:\\n(?s:.*?)"
    f"(?:(?<=\\n) {{0,3}}\\3`*{BLANKS}*(?:\\n|\\z)|\\z)|\\z))"
)
# Group 1 is the indent (kept), group 2 the fence, group 4 an inline span.
CODE = FENCE + "|((?<!`)(`+)(?!`)[^\\n]*?(?<!`)\\5(?!`))"

# --- views -------------------------------------------------------------------
SENTENCE_END = "[.!?][\"'\\u201d\\u2019)\\]]*(?:" + SPACE + "|\\z)"
BULLET = f"\\A{SPACE}*(?:[-*]|[0-9]+[.)]){SPACE}"
BOLD_BULLET = f"\\A{SPACE}*(?:[-*]|[0-9]+[.)]){SPACE}+\\*\\*"
RULE_LINE = f"\\A{SPACE}*(?:---+|\\*\\*\\*+|___+){SPACE}*\\z"
HEADING = f"\\A{SPACE}*#"
CODE_TOGGLE = f"\\A{SPACE}*```"
BLANK = f"\\A{SPACE}*\\z"
# A line that may be anything else than plain text.
MARKED_LINE = f"\\A{SPACE}*(?:[-*_>`0-9]|\\z)"
OUTER_PIPES = "\\A\\|+|\\|+\\z"
TABLE_DELIMITER = f"\\A{SPACE}*:?-{{3,}}:?{SPACE}*(?:\\|{SPACE}*:?-{{3,}}:?{SPACE}*)+\\z"
PARAGRAPH_BREAK = f"\\n{SPACE}*\\n"
# Non-word characters at the edges of a white-space-delimited token.
_EDGE = f"[[^\\p{{L}}\\p{{N}}_{_WS}]\\u0085]"
TOKEN_EDGES = f"(?<={SPACE}|\\A){_EDGE}++|{_EDGE}++(?={SPACE}|\\z)"
# What such edges leave of a token that has a word character: from the first one to the last.
TOKEN_CORE = f"{WORD}(?:{NON_SPACE}*{WORD})?"
# Something in a table cell.
CELL_TEXT = f"[[^|{_WS}]\\u0085]"

# --- detectors ---------------------------------------------------------------
# The words and marks that the detectors look for, and how much may stand between them.
NOT_JUST = f"(?i)not (?:just|only) {ANY}{{1,40}}, but (?:also )?"
BOLD_HEADER = f"\\*\\*[^*]+[.:]\\*\\*{SPACE}+{NON_SPACE}"
TRIAD = f"(?i)(?<!{WORD}){WORD}++, {WORD}++, and {WORD}++"
OPENERS = {
    word: f"(?i)(?:{LINE_START}|[.!?]{SPACE}+){word}[,! ]" for word in ("certainly", "absolutely")
}
CUTOFF = f"(?i){LEFT}as of my (?:last |knowledge )?cutoff{RIGHT}"
JUST_AI = f"(?i){LEFT}i'm just an? ai{RIGHT}"
PLACEHOLDER = "(?i)\\[(?:(?:insert|describe|url|your) |todo)[^\\]]*\\]"
EM_DASH = "\\u2014| -- "
X_NOT_Y = f"(?<!{WORD}){WORD}++, not {WORD}++"
STAGED = (
    f"(?i){LEFT}not (?:only|just|merely){RIGHT}[^.!?\\n]{{1,80}}?{LEFT}but(?: also)?{RIGHT}"
    "[^.!?\\n,;:]{1,80}?(?=[,.;:!?\\n]|\\z)"
)
BOLD_SPAN = "\\*\\*[^*\\n]+?\\*\\*"
_SIGNS = "$%\\u20ac\\u00a3\\u00a5+\\-.,"
NUMERIC_BOLD = (
    f"\\A[{_SIGNS}{SPACE}]*[0-9][0-9{_SIGNS}{SPACE}]*[%a-zA-Z]{{0,4}}\\z"
)
EXCLUDED_LINE = f"\\A{SPACE}*(?:#|>|[-*]{SPACE}|[0-9]+[.)]{SPACE})"
# What precedes a span that opens a paragraph or a sentence.
OPENING_POSITION = "(?:\\A|[.!?]|(?:\\A|[\\n.!?])[ \\t\\r]*\\n)[ \\t\\r]*\\z"

_S = SPACE
# The words of the two setup-and-resolution forms.
_SUBJECTS = "this|that|these|those|it|they|we"
_NEGATED = (
    "isn't|aren't|wasn't|weren't|doesn't|don't|didn't|hasn't|haven't|won't|can't|couldn't|"
    f"shouldn't|(?:is|are|was|were|does|do|did|has|have|will|could|should){_S}+not|cannot"
)
_CONTRACTED = "it's|they're|that's|he's|she's|we're"
_RESOLUTIONS = (
    f"{_CONTRACTED}|it{_S}+is|they{_S}+are|that{_S}+is|this{_S}+is|these{_S}+are|those{_S}+are"
    f"|what's|what{_S}+is|the{_S}+real|the{_S}+actual|instead|rather"
)
_RESOLUTIONS_A = _RESOLUTIONS + f"|he{_S}+is|she{_S}+is|we{_S}+are"
SETUP_NEGATED = (
    f"(?i){LEFT}(?:{_SUBJECTS}){_S}+(?:{_NEGATED}){RIGHT}{ANY}{{0,80}}[.;:,]{_S}*(?:{_RESOLUTIONS_A})"
)
SETUP_NOT = (
    f"(?i){LEFT}(?:{_CONTRACTED}|this{_S}+is){_S}+not{RIGHT}{ANY}{{0,80}}[.;:,]{_S}*(?:{_RESOLUTIONS})"
)
NEGATION_TOKEN = f"n't|(?<!{WORD})(?:not|cannot)(?!{WORD})"

HEADING_LINES = f"(?<=\\n|\\A){SPACE}*#[^\\n]*"
ELABORATION_COLON = "(?<!http)(?<!https): (?!true|false|null)[a-z]"
PITHY_PIVOT = f"(?i),{SPACE}+(?:but|yet|and|not|or){RIGHT}"
FIRST_SIX_WORDS = f"\\A{SPACE}*((?:{NON_SPACE}++{SPACE}*+){{1,6}})"
COPULA = f"(?i){LEFT}(?:is|are|was|were){RIGHT}"
# The generalising forms of a closing sentence.
APHORISMS = (
    f"(?i)\\Asometimes{RIGHT}",
    f"(?i){LEFT}isn't{RIGHT}{ANY}{{1,40}}{LEFT}it's{RIGHT}",
    f"(?i){LEFT}not{RIGHT}{ANY}{{1,30}}{LEFT}it's{RIGHT}{ANY}{{1,40}}\\z",
    f"(?i)\\Athe (?:real|true|actual|biggest|greatest|most important){RIGHT}",
    f"(?i)\\A(?:in the end|ultimately|at the end of the day){RIGHT}",
    f"(?i){LEFT}we (?:bring|carry|create|make|build|choose){RIGHT}",
    "(?i)\\Athat's (?:the |what |where |why |how )",
    f"(?i)\\Ait (?:all )?(?:comes|boils) down to{RIGHT}",
)

# --- names -------------------------------------------------------------------
_NAME = "[A-Z][a-z]+(?:['-][A-Z][a-z]+)*"
NAME_BEFORE = f"(?<![\\p{{L}}'.-]){_NAME}{SPACE}*\\z"
NAME_AFTER = f"\\A{SPACE}*(?:{_NAME}|[A-Z]\\.)(?![\\p{{L}}'.-])"
# A piece of text in which a name could go on beyond the piece.
ALL_NAME_BEFORE = f"\\A[\\p{{L}}'.-]*{SPACE}*\\z"
ALL_NAME_AFTER = f"\\A{SPACE}*[\\p{{L}}'.-]*\\z"
