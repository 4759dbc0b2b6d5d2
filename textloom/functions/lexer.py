"""Where comments and strings begin and end, line by line, for one pandas UDF.

A text is cut if it ends inside a comment or string, or if a line closes a comment that no line
opened. The scan jumps from one token that can change the state to the next by a compiled pattern
per language, so it costs one search per such token, not one step per character.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language -> (line comments, block comments, strings of one line, strings of many lines).
_C = (("/*", "*/"),)
SYNTAX = {
    "python": (("#",), (), ('"', "'"), ('"""', "'''")),
    "cpp": (("//",), _C, ('"', "'"), ()),
    "c": (("//",), _C, ('"', "'"), ()),
    "java": (("//",), _C, ('"', "'"), ('"""',)),
    "javascript": (("//",), _C, ('"', "'"), ("`",)),
    "typescript": (("//",), _C, ('"', "'"), ("`",)),
    "go": (("//",), _C, ('"', "'"), ("`",)),
    "rust": (("//",), _C, ('"', "'"), ()),
    "csharp": (("//",), _C, ('"', "'"), ('"""',)),
    "kotlin": (("//",), _C, ('"', "'"), ('"""',)),
    "php": (("//", "#"), _C, ('"', "'"), ()),
    "ruby": (("#",), (("=begin", "=end"),), ('"', "'", "`"), ()),
    "sql": (("--",), _C, ("'", '"'), ()),
    "html": ((), (("<!--", "-->"),), (), ()),
}


class Scanner:
    """One language's patterns: `code` finds the next token outside, `inside[quote]` the next in a string."""

    def __init__(self, language: str):
        comments, blocks, strings, texts = SYNTAX[language]
        self.close_of, self.open_of = dict(blocks), {b: a for a, b in blocks}
        kinds = [("text", texts), ("open", [a for a, _ in blocks]), ("close", [b for _, b in blocks]), ("comment", comments), ("string", strings)]
        self.code = re.compile("|".join(f"(?P<{kind}>{'|'.join(map(re.escape, words))})" for kind, words in kinds if words))
        self.inside = {q: re.compile(rf"\\|{re.escape(q)}") for q in (*strings, *texts)}

    def scan(self, lines: list[str]) -> tuple[list[bool], int]:
        """Whether each line, and the end, starts outside; and the number of stray closes."""
        outside, stray = [], 0
        until, many = None, False  # what ends the state, and whether it may span lines
        for line in lines:
            outside.append(until is None)
            at = 0
            while at < len(line):
                if until is None:
                    m = self.code.search(line, at)
                    if m is None or m.lastgroup == "comment":
                        break
                    at, token = m.end(), m[0]
                    if m.lastgroup == "close":
                        stray += line.rstrip().endswith(token) and self.open_of[token] not in line
                    elif m.lastgroup == "open":
                        until, many = self.close_of[token], True
                    else:
                        until, many = token, m.lastgroup == "text"
                elif until in self.inside:
                    m = self.inside[until].search(line, at)
                    if m is None:
                        break
                    at = m.end() + (m[0] == "\\")
                    until = until if m[0] == "\\" else None
                else:
                    found = line.find(until, at)
                    if found < 0:
                        break
                    at, until = found + len(until), None
            if not many:
                until = None
        outside.append(until is None)
        return outside, stray


def scanner(language: str | None) -> Scanner | None:
    return Scanner(language) if language in SYNTAX else None


def text_is_cut(text: str, found: Scanner | None) -> bool:
    if found is None:
        return False
    outside, stray = found.scan(text.splitlines())
    return stray > 0 or not outside[-1]


def is_cut(text: Column, language: Column) -> Column:
    """False for a null text and for a language without a syntax."""

    @F.pandas_udf("boolean")
    def cut(text: pd.Series, language: pd.Series) -> pd.Series:
        scanners = {x: scanner(x) for x in language.unique()}
        return pd.Series([bool(t) and text_is_cut(t, scanners[x]) for t, x in zip(text, language, strict=True)], dtype=bool)

    return cut(text, language)
