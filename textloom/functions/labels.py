"""Does a snippet's label agree with its path and content? Reasons against it, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .lexer import is_cut
from .paths import CPP_MARKERS, language_of_path

#: Strong evidence of another language than the labelled one, at the start of a line.
RED_FLAGS = {
    "python": r"(?m)^\s*(#include\b|package\s+[\w.]+;|public\s+class\b|<\?php|<html)",
    "javascript": r"(?m)^\s*(#include\b|package\s+[\w.]+;|<\?php)|:\s*(string|number|boolean)\b\s*[,;)=]",
    "cpp": r"(?m)^\s*(def\s+\w+.*:\s*$|import\s+java\.|package\s+[\w.]+;|fn\s+\w+\()",
    "java": r"(?m)^\s*(#include\b|def\s+\w+.*:\s*$|fn\s+\w+\(|func\s+\w+\(|using\s+System\b)",
    "rust": r"(?m)^\s*(#include\b|public\s+class\b|def\s+\w+.*:\s*$)",
    "go": r"(?m)^\s*(#include\b|public\s+class\b|def\s+\w+.*:\s*$)",
    "c": r"(?m)^\s*(def\s+\w+.*:\s*$|package\s+[\w.]+;)",
    "csharp": r"(?m)^\s*(#include\b|package\s+[\w.]+;|import\s+java\.|def\s+\w+.*:\s*$|fn\s+\w+\()",
    "typescript": r"(?m)^\s*(#include\b|package\s+[\w.]+;|<\?php|<\?xml|<TS\b)",
    "kotlin": r"(?m)^\s*(#include\b|<\?php|def\s+\w+.*:\s*$|fn\s+\w+\()",
    "php": r"(?m)^\s*(#include\b|package\s+[\w.]+;|def\s+\w+.*:\s*$)",
    "ruby": r"(?m)^\s*(package\s+[\w.]+;|public\s+class\b|<\?php|(int|void)\s+main\s*\()",
}
OBJC_MARKERS = r"(?m)^\s*(@(interface|implementation|protocol|property|end)\b|#import\b)"
SQL_WORDS = r"(?i)\b(select|insert|update|delete|create|alter|drop|with|from|where)\b"
#: Reasons and thresholds.
NUL, LONG_LINE, NON_ASCII = "binary: contains NUL", "minified or data: very long line", "mostly non-ASCII"
OTHER, MISSING, SPARSE = "content looks like another language", "expected markers missing", "too little markup"
EMBEDDED_CODE, EMBEDDED_MARKUP = "mostly embedded script/style", "mostly embedded markup"
CUT, TEMPLATES = "cut comment or string", "template-heavy"
MAX_LINE, MAX_NON_ASCII, MAX_EMBEDDED, MIN_MARKUP, MAX_TEMPLATES = 500, 0.30, 0.50, 0.20, 0.30


def check_labels(snippets: DataFrame, text: str = "text", language: str = "language", path: str = "path", source: str = "source", check_cut: bool = True) -> DataFrame:
    """Adds `reasons` (in order), `ok` (no reason) and `hard` (embedded code is the only reason).

    A null text is an empty one. Snippets of the source `wild` have no path to speak of.
    """
    body, lang = F.coalesce(F.col(text), F.lit("")), F.col(language)
    made = snippets.withColumn("lines_", T.non_blank_lines(body)).withColumn("cut_", is_cut(F.col(text), lang) if check_cut else F.lit(False))
    lines = F.col("lines_")
    implied = language_of_path(F.col(path), body)
    repr_ = lambda c: F.when(c.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    mismatch = F.concat(F.lit("extension implies "), repr_(implied), F.lit(", labelled "), repr_(lang))
    flagged = F.lit(False)
    for name, pattern in RED_FLAGS.items():
        flagged = flagged | ((lang == name) & body.rlike(pattern.replace("(?m)", "(?md)")))
    flagged = flagged | ((lang == "c") & (body.rlike(f"(?md){CPP_MARKERS}") | body.rlike(OBJC_MARKERS)))
    any_tag = F.exists(lines, lambda x: x.rlike(T.HTML_TAG))
    missing = ((lang == "html") & ~any_tag) | ((lang == "sql") & ~body.rlike(SQL_WORDS))
    code = T.embedded_share(lines) > MAX_EMBEDDED
    markup = T.markup_share(lines)
    content = (
        F.when(missing, MISSING)
        .when((lang == "html") & code, EMBEDDED_CODE)
        .when((lang == "html") & (markup < MIN_MARKUP), SPARSE)
        .when((lang == "php") & (markup > MAX_EMBEDDED), EMBEDDED_MARKUP)
    )
    heavy = F.when(lang == "html", T.template_fraction(lines, True)).when(lang == "sql", T.template_fraction(lines)) > MAX_TEMPLATES
    reasons = F.array(
        F.when(F.contains(body, F.lit("\0")), NUL),
        F.when(F.array_max(F.transform(F.split(body, T.LINE_END), F.length)) > MAX_LINE, LONG_LINE),
        F.when(T.non_ascii_share(body) > MAX_NON_ASCII, NON_ASCII),
        F.when((F.col(source) != "wild") & ~implied.eqNullSafe(lang), mismatch),
        F.when(flagged, OTHER),
        content,
        F.when(F.col("cut_"), CUT),
        F.when(heavy, TEMPLATES),
    )
    made = made.withColumn("reasons", F.array_compact(reasons)).drop("lines_", "cut_")
    hard = (F.size("reasons") > 0) & (F.size(F.array_except("reasons", F.array(F.lit(EMBEDDED_CODE), F.lit(EMBEDDED_MARKUP)))) == 0)
    return made.withColumn("ok", F.size("reasons") == 0).withColumn("hard", hard)


def drop_reasons(checked: DataFrame) -> DataFrame:
    """reason, n: over the snippets that are neither kept nor hard examples."""
    return checked.where("not ok and not hard").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def kept(checked: DataFrame) -> DataFrame:
    """fate (kept, hard or dropped) and n."""
    fate = F.when(F.col("ok"), "kept").when(F.col("hard"), "hard").otherwise("dropped")
    return checked.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def low_signal(text: Column) -> Column:
    return T.low_signal(T.non_blank_lines(text))
