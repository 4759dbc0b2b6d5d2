from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import labels, lexer, paths
from textloom.functions import text as T


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("a b\t c\r\n", "a b c"), ("", ""), (" x　", "x"), ("é  ü", "é ü")],
)
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("text")), text) == want


@pytest.mark.parametrize("text", ["a\nb\r\nc\rd\x0be", "x y\u0085z", "\n\n", "", "one"])
def test_non_blank_lines_are_those_of_python(spark, text):
    assert one(spark, T.non_blank_lines(F.col("text")), text) == [x for x in text.splitlines() if x.strip()]


def embedded(lines):
    """The definition, line by line."""
    import re

    opens = [re.search(r"<(script|style)\b", x, re.I) for x in lines]
    closes = [re.search(r"</(script|style)\s*>", x, re.I) for x in lines]
    first = lambda found: next((i for i, m in enumerate(found) if m), None)
    fo, fc = first(opens), first(closes)
    inside, n = fc is not None and (fo is None or fc < fo), 0
    for o, c in zip(opens, closes, strict=True):
        n += bool(inside or o)
        if c and (not o or c.start() > o.start()):
            inside = False
        elif o:
            inside = True
    return n / len(lines) if lines else 0.0


@pytest.mark.parametrize(
    "text",
    ["x\n</script>\ny\nz", "<script>\na\n</script>\nb", "<p>\n<style>a</style>\n<b>", "</style><script>\na\nb", "<script>\na", "plain", "", "<script>\n</script>"],
)
def test_embedded_share_equals_its_definition(spark, text):
    lines = [x for x in text.splitlines() if x.strip()]
    got = spark.createDataFrame([(text,)], "text string").select(T.non_blank_lines(F.col("text")).alias("l")).select(T.embedded_share(F.col("l")).alias("x")).first().x
    assert got == pytest.approx(embedded(lines))


def test_markup_needs_a_tag(spark):
    share = lambda t: spark.createDataFrame([(t,)], "text string").select(T.non_blank_lines(F.col("text")).alias("l")).select(T.markup_share(F.col("l")).alias("x")).first().x
    assert share("<div>\ni < elements\na<b and c\n</my-el>") == 0.5


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "a😀b", "aaaa", "ñé\nü"])
def test_char_ngrams_are_the_substrings(spark, text):
    want = {text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)}
    got = one(spark, T.char_ngrams(F.col("text")), text)
    assert set(got) == want and len(got) == len(want)


def test_short_text_is_one_shingle(spark):
    assert len(one(spark, T.shingles(F.col("text")), "a b c")) == 1
    assert len(one(spark, T.shingles(F.col("text")), "")) == 1
    assert len(one(spark, T.shingles(F.col("text")), "a b c d e f")) == 2


CUT = [
    ("x = 1 /* open", "java", True), ("a\nb */\nc", "java", True), ("/* a */ b", "java", False), ("r = /.*/;x", "javascript", False),
    ("s = \"/*\"", "java", False), ("'''open", "python", True), ("'one line\nnext", "python", False), ("`many\nlines`", "go", False),
    ("// /* not open", "cpp", False), ("<!-- a", "html", True), ("it's prose", "html", False), ("x /* y", "unknown", False), ("\"a\\\"b /*\"", "c", False),
]


@pytest.mark.parametrize("text, language, want", CUT)
def test_cut_comments_and_strings(text, language, want):
    assert lexer.text_is_cut(text, lexer.scanner(language)) is want


def test_is_cut_as_a_column(spark):
    rows = spark.createDataFrame([(t, g) for t, g, _ in CUT] + [(None, "java")], "t string, g string")
    assert [r.x for r in rows.select(lexer.is_cut(F.col("t"), F.col("g")).alias("x")).collect()] == [w for *_, w in CUT] + [False]


@pytest.mark.parametrize(
    "path, language, role",
    [
        ("src/a.PY", "python", "source"), ("tests/a.go", "go", "test"), ("a/test_b.py", "python", "test"), ("a/FooTest.java", "java", "test"),
        ("docs/x.html", "html", "docs"), ("db/migrations/1.sql", "sql", "migration"), ("demo/x.rs", "rust", "example"), (".js", None, "source"), ("README", None, "source"),
    ],
)
def test_paths(spark, path, language, role):
    row = spark.createDataFrame([(path,)], "p string").select(paths.language_of_path(F.col("p")).alias("l"), paths.file_role(F.col("p")).alias("r")).first()
    assert (row.l, row.r) == (language, role)


def test_headers_are_decided_by_content(spark):
    rows = spark.createDataFrame([("class Foo {};",), ("// see Foo::bar\nint x;",), ("std::vector<int> v;",)], "t string")
    got = [r.x for r in rows.select(paths.language_of_path(F.lit("a.h"), F.col("t")).alias("x")).collect()]
    assert got == ["cpp", "c", "cpp"]


def test_candidates_and_links(spark):
    rows = spark.createDataFrame([("src/a.py", 500), ("vendor/a.py", 500), ("a.py", 10), ("a.min.js", 900), ("B/Build/x.py", 500)], "p string, n int")
    assert [r.p for r in rows.where(paths.is_candidate(F.col("p"), F.col("n"), "python")).collect()] == ["src/a.py"]
    link = spark.range(1).select(paths.permalink("https://example.org/", F.lit("o/r"), F.lit("c"), F.lit("a b/ü.py"), F.lit(1), F.lit(2)).alias("x")).first().x
    assert link == "https://example.org/o/r/blob/c/a%20b/%C3%BC.py#L1-L2"


def test_label_reasons(spark):
    rows = [
        ("def f():\n    pass", "python", "a.py", "github"), ("#include <x>\n", "python", "a.py", "github"), ("SELECT 1", "sql", "a.sql", "github"), ("hello", "sql", "a.sql", "github"),
        ("<script>\nvar a\n</script>", "html", "a.html", "github"), ("x" * 501, "go", "b.go", "github"), ("x\0", "go", "b.rs", "github"), ("éééé", "go", "b.zz", "wild"),
        ("a\nb\nc\nd\ne\n<p>", "html", "a.htm", "github"), ("/* open", "c", "a.c", "github"), ("{% a %}\nselect", "sql", "q.sql", "github"),
    ]
    got = labels.check_labels(spark.createDataFrame(rows, "text string, language string, path string, source string")).collect()
    assert [r.reasons for r in got] == [
        [], [labels.OTHER], [], [labels.MISSING], [labels.EMBEDDED_CODE], [labels.LONG_LINE], [labels.NUL, "extension implies 'rust', labelled 'go'"],
        [labels.NON_ASCII], [labels.SPARSE], [labels.CUT], [labels.TEMPLATES],
    ]
    assert [r.hard for r in got] == [False] * 4 + [True] + [False] * 6
