"""What a file's path tells: its language, its role, whether to sample it, and its address."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension -> language.
EXTENSIONS = {
    "py": "python", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "java": "java",
    "js": "javascript", "mjs": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "sql": "sql",
    "html": "html", "htm": "html", "c": "c", "cs": "csharp", "ts": "typescript", "tsx": "typescript",
    "kt": "kotlin", "php": "php", "rb": "ruby",
}
#: Role -> pattern of a path; the first that fits holds.
TEST_DIR = r"(?i)(^|/)(tests?|__tests__|specs?|testing|testdata)/"
TEST_NAME = r"^(test_.*|.*_test\.\w+|.*Tests?\.\w+|.*\.(test|spec)\.\w+)$"
ROLES = (
    ("example", r"(?i)(^|/)(examples?|demos?|samples?|tutorials?|playground)/"),
    ("migration", r"(?i)(^|/)(migrations?|migrate)/"),
    ("docs", r"(?i)(^|/)(docs?|documentation)/"),
)
#: Fixed values of the file sampler.
SKIP_DIRS = (
    "vendor", "vendored", "node_modules", "third_party", "third-party", "thirdparty", "external", "deps", "dist",
    "build", "target", "out", "site-packages", "__pycache__", "generated", "gen", ".git", "obj", "bin",
)
SKIP_SUFFIXES = (
    ".min.js", ".min.css", ".pb.go", "_pb2.py", ".generated.cs", ".d.ts", ".g.cs", ".designer.cs", ".pb.cc", ".pb.h", "_pb.rb",
)
NOT_SAMPLED, ALSO_SAMPLED = ("jsx", "tsx"), {"c": ("h",), "cpp": ("h",)}
MIN_BYTES, MAX_BYTES = 400, 200_000
#: Constructs of C++ that C lacks; they decide the language of a header.
CPP_MARKERS = (
    r"\b(constexpr|nullptr|noexcept|typename|static_cast|dynamic_cast|reinterpret_cast|const_cast)\b"
    r"|\benum\s+(class|struct)\b"
    r"|^\s*(class|namespace)\s+\w+"
    r"|^\s*template\s*<"
    r"|^\s*using\s+(namespace\b|\w+\s*=)"
    r"|^\s*(public|private|protected)\s*:"
    r"|#include\s*<(c[a-z]+|iostream|vector|string|map|set|memory|algorithm|utility|thread|mutex|functional|optional|array)>"
    r"|^(?!\s*(//|\*|/\*)).*\b[A-Za-z_]\w*::[A-Za-z_~]"
)


def name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without its dot; empty if there is none. A leading dot makes no extension."""
    return F.lower(F.regexp_extract(name(path), r"[^.]\.([^.]+)$", 1))


def language_of_path(path: Column, text: Column | None = None) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(EXTENSIONS.items())))
    ext = extension(path)
    out = F.try_element_at(table, ext)
    if text is not None:
        out = F.when(ext == "h", F.when(text.rlike(f"(?md){CPP_MARKERS}"), "cpp").otherwise("c")).otherwise(out)
    return out


def file_role(path: Column, source: Column | None = None) -> Column:
    out = F.when(source == "wild", "wild") if source is not None else F.when(F.lit(False), "")
    out = out.when(path.rlike(TEST_DIR) | name(path).rlike(TEST_NAME), "test")
    for role, pattern in ROLES:
        out = out.when(path.rlike(pattern), role)
    return out.otherwise("source")


def is_candidate(path: Column, size: Column, language: str) -> Column:
    """Worth sampling: the language's extension, a sane size, not vendored, generated or minified."""
    wanted = [e for e, lang in EXTENSIONS.items() if lang == language and e not in NOT_SAMPLED]
    wanted += ALSO_SAMPLED.get(language, ())
    low = F.lower(path)
    parts = F.split(low, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.lit(False)
    for suffix in SKIP_SUFFIXES:
        skipped = skipped | low.endswith(suffix)
    return extension(path).isin(wanted) & size.between(MIN_BYTES, MAX_BYTES) & ~skipped & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS)))


def quoted(path: Column) -> Column:
    """Percent-quoting that keeps slashes and writes a space as %20."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def permalink(base: str, repo: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/"), repo, F.lit("/blob/"), commit, F.lit("/"), quoted(path), F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def bands(value: Column, minimum: int, edges=(200, 1000, 5000)) -> Column:
    """The label of the popularity band: lo..hi-1, or >=last; null below the minimum."""
    cuts = sorted({minimum, *(e for e in edges if e > minimum)})
    out = F.when(value >= cuts[-1], f">={cuts[-1]}")
    for lo, hi in reversed(list(zip(cuts, cuts[1:], strict=False))):
        out = out.when((value >= lo) & (value < hi), f"{lo}..{hi - 1}")
    return out
