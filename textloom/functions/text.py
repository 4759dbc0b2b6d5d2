"""Line and character functions of a text column, as Catalyst expressions.

Lines end where Unicode says so; blank ones never count. Functions that look at lines take the
array of non-blank lines: select it once, then use it in a further select.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as Unicode (and Python's str) define them, in a syntax
#: that Java and RE2 share.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"

#: Fixed values of the quality rules.
COMMENT = r"^(//|#|/\*|\*|--|<!--|-->|\"\"\"|'''|;)"
LICENSE = r"(?i)copyright|spdx-license|licensed under|all rights reserved"
TEMPLATE = r"\{%|%\}|\{\{|\}\}|<%|%>"
HTML_TAG = rf"(^|[^\p{{L}}\p{{N}}_)\]])</?[a-zA-Z]({WORD}|-)*({SPACE}|[>/]|$)|<!"
EMBED_OPEN = r"(?i)<(script|style)\b"
EMBED_CLOSE = rf"(?i)</(script|style){SPACE}*>"


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_END), lambda x: x.rlike(NOT_SPACE))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def share(lines: Column, test) -> Column:
    """Share of the lines that pass; 0 without lines."""
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, test)) / F.size(lines)).otherwise(F.lit(0.0))


def non_ascii_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.length(text)).otherwise(F.lit(0.0))


def max_line(lines: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))


def is_comment(line: Column) -> Column:
    return strip(line).rlike(COMMENT)


def comment_ratio(lines: Column) -> Column:
    return share(lines, is_comment)


def template_fraction(lines: Column, front_matter: bool = False) -> Column:
    return share(lines, lambda x: x.rlike(TEMPLATE) | (strip(x) == "---") if front_matter else x.rlike(TEMPLATE))


def markup_share(lines: Column) -> Column:
    return share(lines, lambda x: x.rlike(HTML_TAG))


def low_signal(lines: Column, min_lines: int = 10, max_comments: float = 0.8) -> Column:
    """Too few lines, a license line, or mostly comments."""
    return (F.size(lines) < min_lines) | F.exists(lines, lambda x: x.rlike(LICENSE)) | (comment_ratio(lines) > max_comments)


def embedded_share(lines: Column) -> Column:
    """Share of lines in script or style blocks, tag lines included.

    The lines are folded with the state "inside a block"; the text may start inside one, which it
    does if a closing tag comes before any opening tag. A line's event is a close if the close
    comes after the open or there is no open.
    """
    opens, closes = (lambda x: x.rlike(EMBED_OPEN)), (lambda x: x.rlike(EMBED_CLOSE))
    first = lambda test: F.array_position(F.transform(lines, test), True)
    starts_inside = (first(closes) > 0) & ((first(opens) == 0) | (first(closes) < first(opens)))

    def step(state: Column, x: Column) -> Column:
        opened, closed = opens(x), closes(x)
        # of the two first matches, the close is later if it is still there after the first open
        ends = closed & (~opened | (F.regexp_instr(x, F.lit(EMBED_CLOSE)) > F.regexp_instr(x, F.lit(EMBED_OPEN))))
        inside = F.when(ends, F.lit(False)).when(opened, F.lit(True)).otherwise(state["inside"])
        return F.struct(inside.alias("inside"), (state["n"] + F.when(state["inside"] | opened, 1).otherwise(0)).alias("n"))

    start = F.struct(starts_inside.alias("inside"), F.lit(0).alias("n"))
    inside = F.aggregate(lines, start, step, lambda s: s["n"])
    return F.when(F.size(lines) > 0, inside / F.size(lines)).otherwise(F.lit(0.0))


def chars(text: Column) -> Column:
    """The text's code points, one by one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_ngrams(text: Column, sizes=(2, 3)) -> Column:
    """Distinct character n-grams; the code points are bound to a variable, so they are split once."""

    def grams(c: Column) -> Column:
        parts, last = [], c
        for n in range(1, max(sizes) + 1):
            if n > 1:
                shifted = F.slice(c, n, F.greatest(F.size(c), F.lit(1)))
                last = F.zip_with(last, shifted, lambda a, b: F.concat(a, b))
            if n in sizes:
                parts.append(F.filter(last, lambda x: x.isNotNull()))
        return F.array_distinct(F.concat(*parts))

    return F.get(F.transform(F.array(chars(text)), grams), F.lit(0))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def tokens(text: Column) -> Column:
    """Words and single other characters, as for shingles."""
    return F.regexp_extract_all(text, F.lit(rf"{WORD}+|(?!{WORD}){NOT_SPACE}"), F.lit(0))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k tokens, hashed to 32 bits; a shorter text is one shingle."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n <= k, F.array(F.array_join(t, " "))).otherwise(many)

    hashed = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    return F.array_distinct(F.transform(F.get(F.transform(F.array(tokens(text)), runs), F.lit(0)), hashed))


def show_term(term: Column) -> Column:
    """A term in quotes, with white space and quotes made visible."""
    out = F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, seen in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(seen))
    return F.concat(F.lit('"'), out, F.lit('"'))
