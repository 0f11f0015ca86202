"""Regular expressions built from job parameters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column

from listwright.functions.text import base_name

# Names of temporary files, and names that are always kept.
TEMP_PATTERNS = [
    "*.tmp", "*.temp", "*.bak", "*.old",
    "*.log.*", "*.pyc", "__pycache__",
    "*.swp", "*.swo", "~*", "*.cache",
]
PRESERVED_NAMES = [
    "README.md", "requirements.txt", ".gitignore", "setup.py", "config.json", "config.yaml",
]


def minimal_tokens(tokens: Iterable[str | None]) -> list[str]:
    """Tokens that contain no other token; for substring tests they decide alone."""
    wanted = {t.strip().lower() for t in tokens if t is not None} - {""}
    lengths = sorted({len(t) for t in wanted})

    def holds_another(token: str) -> bool:
        return any(
            token[i:i + n] in wanted
            for n in lengths
            if n < len(token)
            for i in range(len(token) - n + 1)
        )

    return sorted(t for t in wanted if not holds_another(t))


def trie_regex(tokens: Iterable[str]) -> str | None:
    """One pattern that finds any token, with common prefixes written once.

    A flat alternation is tried word by word at every position; this form leaves
    a position after the first character no token starts with.
    """
    trie: dict = {}
    for token in minimal_tokens(tokens):
        node = trie
        for char in token:
            node = node.setdefault(char, {})
    return _emit(trie) if trie else None


def _emit(node: dict) -> str:
    text = []
    while len(node) == 1:
        ((char, node),) = node.items()
        text.append(re.escape(char))
    if node:
        text.append("(?:" + "|".join(re.escape(char) + _emit(child) for char, child in node.items()) + ")")
    return "".join(text)


def glob_regex(pattern: str) -> str:
    """Java pattern for a shell glob, matched against the end of a path."""
    parts = []
    i = 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            parts.append("[^/]*")
        elif char == "?":
            parts.append("[^/]")
        elif close > 0:
            body = pattern[i + 1:close]
            negated = body.startswith("!")
            # Brackets and '&&' have a meaning of their own in Java classes.
            members = re.sub(r"([^\w-])", r"\\\1", body[negated:])
            parts.append("[" + "^" * negated + members + "]")
            i = close
        else:
            parts.append(re.escape(char))
        i += 1
    return "(?:^|/)" + "".join(parts) + "$"


def matches_patterns(path: Column, patterns: Iterable[str] = tuple(TEMP_PATTERNS)) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns))


def not_preserved(path: Column, names: Iterable[str] = tuple(PRESERVED_NAMES)) -> Column:
    return ~base_name(path).isin(list(names))
