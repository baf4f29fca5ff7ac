"""Frequent words by language, and a pattern that matches any of a list."""

from __future__ import annotations

import re

#: Common words, most frequent first.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "by", "this", "be", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
}


def any_of(words: list[str]) -> str:
    """A pattern for exactly these words that shares their beginnings, so that a matcher reads each letter once."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(x) + pattern(below) for x, below in sorted(node.items()) if x]
        if not ways:
            return ""
        body = "(?:" + "|".join(ways) + ")"
        return body + "?" if "" in node else body

    return pattern(tree)
