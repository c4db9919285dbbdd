"""Pre-tokens of public tokenizer files, split as their library splits them.

Words repeat, so encoding each distinct pre-token once is many times cheaper
than encoding texts.  That is exact only where a pre-token's tokens do not depend
on its surroundings and where the split below equals the library's.  Texts with
an added token's string or with a code point outside `PLAIN` are encoded whole
by the library instead.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer

# The patterns by which the two kinds of tokenizer files split a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Code points on which the library and the regular expressions here are tested to agree, alone and combined.
PLAIN = r"[^\x00-įı-ʯА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]"

#: The first code points, where most texts of Latin script stay, also in lower case; their classes can be written out, which matches faster.
LATIN = "\u017f"


def _written_out(pattern: str) -> re.Pattern:
    """The same pattern for texts up to `LATIN`, with Unicode classes as lists of characters."""
    members = lambda name: "".join(re.escape(c) for c in map(chr, range(ord(LATIN) + 1)) if regex.match(name, c))
    letter, number, space = (members(name) for name in (r"\p{L}", r"\p{N}", r"\s"))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    pattern = pattern.replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{number}]")
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def _byte_characters() -> dict[int, str]:
    """The character that byte-level files write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


class Splitter:
    """One tokenizer file: how to split a text, and the library's tokenizer."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"]
        if spec["normalizer"] is None and kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]:
            self.lower, pattern = False, BYTE_LEVEL_PATTERN
        elif kind["type"] == "Sequence" and kind["pretokenizers"][0].get("pattern") == {"Regex": WORD_PATTERN}:
            self.lower, pattern = True, WORD_PATTERN
        else:
            raise ValueError(f"{path}: no exact split is known for this kind of file")
        self.find, self.find_latin = regex.compile(pattern).findall, _written_out(pattern).findall
        odd = [PLAIN, *(regex.escape(t["content"]) for t in spec["added_tokens"])]
        self.odd = regex.compile("|".join(odd)).search
        self.beyond = re.compile("|".join([f"[^\\x00-{LATIN}]|\u0130", *(re.escape(t["content"]) for t in spec["added_tokens"])])).search
        self.tokenize = self.tokenizer.model.tokenize
        self.size = self.tokenizer.get_vocab_size()

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens that can be encoded one by one; None if the text must be encoded whole."""
        find = self.find_latin
        if self.beyond(text):
            if self.odd(text):
                return None
            find = self.find
        return find(text.lower() if self.lower else text)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens by the library's model, which takes bytes as characters."""
        tokenize = self.tokenize
        as_bytes = [p.encode().decode("latin-1").translate(_BYTE_CHARACTERS) for p in pieces]
        return [[t.id for t in tokenize(p)] for p in as_bytes]


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    """One per worker process and file."""
    return Splitter(path)
