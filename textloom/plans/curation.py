"""Queries on curation: composition, quality, labels, deduplication, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, paths
from ..functions import text as T
from ..operators import dedup, splits, windows
from ..sources.tables import relabelled, snippets_of
from . import sql
from .registry import query, table, texts

P = ("paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path, html, regexp_replace(html, '>\\s*<', '>\n<', 'g') AS text FROM pages)")
EXTENSION = "lower(regexp_extract(list_last(string_split(regexp_replace(path, '/+$', ''), '/')), '[^.]\\.([^.]+)$', 1))"


def page_snippets(spark, d):
    """pages as snippets of HTML: page_id, path (of the url), text (tags put on lines of their own)."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    return texts(spark, d, "pages").select("page_id", path.alias("path"), F.regexp_replace("html", r">\s*<", ">\n<").alias("text"))


def docs(spark, d):
    return snippets_of(texts(spark, d))


@query("lang_source_counts", "SELECT lang, source, count(*) AS snippets FROM documents GROUP BY ALL")
def lang_source_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("snippets"))


@query("composition", f"WITH {sql.SNIP}, {sql.split()} SELECT s.split, snip.language, count(*) AS snippets, count(DISTINCT snip.repo) AS repos FROM snip JOIN split s USING (repo) GROUP BY ALL")
def composition(spark, d):
    rows = docs(spark, d)
    assigned = splits.assign(rows, splits.stable_split(rows))
    return assigned.groupBy("split", "language").agg(F.count("*").alias("snippets"), F.countDistinct("repo").alias("repos"))


@query("merge_relabel", "SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN 'romance' ELSE lang END AS class FROM documents")
def merge_relabel(spark, d):
    return docs(spark, d).select("doc_id", relabelled(F.col("language"), {"es": "romance", "fr": "romance"}).alias("class"))


@query("languages_present", "SELECT lang AS language, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END::INT AS position FROM documents GROUP BY lang")
def languages_present(spark, d):
    from ..sources.tables import languages_present as present

    return present(docs(spark, d), ("en", "de", "fr", "es")).select("language", "position")


@query("uncovered_labels", "SELECT DISTINCT lang AS language FROM documents WHERE lang NOT IN ('en', 'de')")
def uncovered_labels(spark, d):
    from ..sources.tables import uncovered

    listed = spark.createDataFrame([("en",), ("de",)], "language string")
    return uncovered(docs(spark, d), listed)


@query("text_quality_metrics", f"""WITH l AS (SELECT doc_id, text, {sql.lines()} AS l FROM documents)
SELECT doc_id, len(l)::INT AS n_lines, COALESCE(list_max(list_transform(l, lambda x: length(x))), 0)::INT AS max_line,
       round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) ELSE 0 END, 6) AS non_ascii,
       round({sql.share("l", f"regexp_matches({sql.strip('x')}, {sql.q(T.COMMENT)})")}, 6) AS comment_ratio,
       round({sql.share("l", f"regexp_matches(x, {sql.q(T.TEMPLATE)})")}, 6) AS template_fraction,
       md5({sql.normalized()}) AS norm_md5 FROM l""")  # fmt: skip
def text_quality_metrics(spark, d):
    rows = texts(spark, d).select("doc_id", "text", T.non_blank_lines(F.col("text")).alias("l"))
    l = F.col("l")  # noqa: E741
    r = lambda c: F.round(c, 6)
    return rows.select(
        "doc_id", F.size(l).alias("n_lines"), T.max_line(l).alias("max_line"), r(T.non_ascii_share(F.col("text"))).alias("non_ascii"),
        r(T.comment_ratio(l)).alias("comment_ratio"), r(T.template_fraction(l)).alias("template_fraction"), F.md5(T.normalize(F.col("text"))).alias("norm_md5"),
    )


@query("low_signal_flags", f"""WITH l AS (SELECT doc_id, {sql.lines()} AS l FROM documents)
SELECT doc_id, len(l) < 10 OR len(list_filter(l, lambda x: regexp_matches(x, {sql.q(T.LICENSE)}))) > 0
       OR {sql.share("l", f"regexp_matches({sql.strip('x')}, {sql.q(T.COMMENT)})")} > 0.8 AS low_signal FROM l""")  # fmt: skip
def low_signal_flags(spark, d):
    rows = texts(spark, d).select("doc_id", T.non_blank_lines(F.col("text")).alias("l"))
    return rows.select("doc_id", T.low_signal(F.col("l")).alias("low_signal"))


@query("fixed_line_windows", r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, l, unnest(range(len(l) // 20)) AS k FROM l)
SELECT doc_id, (k * 20 + 1)::INT AS start_line, (k * 20 + 20)::INT AS end_line, md5(array_to_string(l[k * 20 + 1 : k * 20 + 20], chr(10)) || chr(10)) AS text_md5 FROM w""")  # fmt: skip
def fixed_line_windows(spark, d):
    cut = windows.fixed_windows(texts(spark, d), 20)
    return cut.select("doc_id", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("windows_lexed")
def windows_lexed(spark, d):
    """Windows of drawn lengths in pages, never inside a comment; the generator is Python's."""
    pages = page_snippets(spark, d).withColumn("language", F.lit("html"))
    return windows.line_windows(pages, "page_id", language_col="language", min_lines=5, max_lines=12, min_nonblank=3)


_MARKUP = sql.share("l", f"regexp_matches(x, {sql.q(T.HTML_TAG)})")


@query("page_markup_share", f"WITH {P}, l AS (SELECT page_id, {sql.lines()} AS l FROM paths) SELECT page_id, round({_MARKUP}, 6) AS share FROM l")
def page_markup_share(spark, d):
    rows = page_snippets(spark, d).select("page_id", T.non_blank_lines(F.col("text")).alias("l"))
    return rows.select("page_id", F.round(T.markup_share(F.col("l")), 6).alias("share"))


_OPEN, _CLOSE = sql.q(T.EMBED_OPEN), sql.q(T.EMBED_CLOSE)
_POS = lambda p: f"strpos(x, regexp_extract(x, {p}))"
EMBEDDED = f"""
ln AS (SELECT page_id, {sql.lines()} AS l FROM paths),
ev AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM ln),
e1 AS (SELECT page_id, i, regexp_matches(x, {_OPEN}) AS o, regexp_matches(x, {_CLOSE}) AS c, {_POS(_OPEN)} AS po, {_POS(_CLOSE)} AS pc FROM ev),
e2 AS (SELECT *, CASE WHEN c AND (NOT o OR pc > po) THEN 0 WHEN o THEN 1 END AS event FROM e1),
st AS (SELECT page_id, MIN(i) FILTER (c) AS fc, MIN(i) FILTER (o) AS fo FROM e2 GROUP BY page_id),
e3 AS (SELECT e2.*, COALESCE(last_value(event IGNORE NULLS) OVER (PARTITION BY e2.page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              CASE WHEN fc IS NOT NULL AND (fo IS NULL OR fc < fo) THEN 1 ELSE 0 END) AS inside FROM e2 JOIN st USING (page_id)),
emb AS (SELECT ln.page_id, CASE WHEN len(l) > 0 THEN (SELECT count(*) FROM e3 WHERE e3.page_id = ln.page_id AND (inside = 1 OR o)) / len(l) ELSE 0.0 END AS share FROM ln)"""


@query("page_embedded_share", f"WITH {P}, {EMBEDDED} SELECT page_id, round(share, 6) AS share FROM emb")
def page_embedded_share(spark, d):
    rows = page_snippets(spark, d).select("page_id", T.non_blank_lines(F.col("text")).alias("l"))
    return rows.select("page_id", F.round(T.embedded_share(F.col("l")), 6).alias("share"))


def checked_pages(spark, d, check_cut=False):
    rows = page_snippets(spark, d).withColumns({"language": F.lit("html"), "source": F.lit("github")})
    return labels.check_labels(rows, check_cut=check_cut)


LABELS = f"""
lab0 AS (SELECT p.*, {sql.lines("p.text")} AS l, string_split_regex(p.text, {sql.q(T.LINE_END)}) AS every, {EXTENSION} AS ext, emb.share FROM paths p JOIN emb USING (page_id)),
lab1 AS (SELECT page_id, list_filter([
    CASE WHEN contains(text, chr(0)) THEN {sql.q(labels.NUL)} END,
    CASE WHEN list_max(list_transform(every, lambda x: length(x))) > 500 THEN {sql.q(labels.LONG_LINE)} END,
    CASE WHEN length(text) > 0 AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) > 0.3 THEN {sql.q(labels.NON_ASCII)} END,
    CASE WHEN ext NOT IN ('html', 'htm') THEN 'extension implies None, labelled ''html''' END,
    CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, {sql.q(T.HTML_TAG)}))) = 0 THEN {sql.q(labels.MISSING)}
         WHEN share > 0.5 THEN {sql.q(labels.EMBEDDED_CODE)}
         WHEN {_MARKUP} < 0.2 THEN {sql.q(labels.SPARSE)} END,
    CASE WHEN {sql.share("l", f"(regexp_matches(x, {sql.q(T.TEMPLATE)}) OR {sql.strip('x')} = '---')")} > 0.3 THEN {sql.q(labels.TEMPLATES)} END
    ], lambda x: x IS NOT NULL) AS reasons FROM lab0),
lab AS (SELECT page_id, reasons, len(reasons) = 0 AS ok,
        len(reasons) > 0 AND len(list_filter(reasons, lambda x: x NOT IN ({sql.q(labels.EMBEDDED_CODE)}, {sql.q(labels.EMBEDDED_MARKUP)}))) = 0 AS hard FROM lab1)"""


@query("page_label_check", f"WITH {P}, {EMBEDDED}, {LABELS} SELECT page_id, array_to_string(reasons, '; ') AS reasons, ok, hard FROM lab")
def page_label_check(spark, d):
    return checked_pages(spark, d).select("page_id", F.array_join("reasons", "; ").alias("reasons"), "ok", "hard")


@query("label_drop_reasons", f"WITH {P}, {EMBEDDED}, {LABELS} SELECT unnest(reasons) AS reason, count(*) AS n FROM lab WHERE NOT ok AND NOT hard GROUP BY 1")
def label_drop_reasons(spark, d):
    return labels.drop_reasons(checked_pages(spark, d))


@query("label_fates", f"WITH {P}, {EMBEDDED}, {LABELS} SELECT CASE WHEN ok THEN 'kept' WHEN hard THEN 'hard' ELSE 'dropped' END AS fate, count(*) AS n FROM lab GROUP BY 1")
def label_fates(spark, d):
    return labels.kept(checked_pages(spark, d))


@query("page_label_check_lexed")
def page_label_check_lexed(spark, d):
    """With the comment lexer, which SQL can't express."""
    return checked_pages(spark, d, check_cut=True).select("page_id", F.array_join("reasons", "; ").alias("reasons"), "ok", "hard")


def _role_sql(path: str) -> str:
    name = f"list_last(string_split(regexp_replace({path}, '/+$', ''), '/'))"
    cases = " ".join(f"WHEN regexp_matches({path}, {sql.q(p)}) THEN '{r}'" for r, p in paths.ROLES)
    return f"CASE WHEN regexp_matches({path}, {sql.q(paths.TEST_DIR)}) OR regexp_matches({name}, {sql.q(paths.TEST_NAME)}) THEN 'test' {cases} ELSE 'source' END"


#: paths made from pages, so that every role and extension occurs
MADE = """made AS (SELECT page_id, (CASE page_id % 8 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'src/examples/' WHEN 3 THEN 'db/migrate/' WHEN 4 THEN 'vendor/' ELSE 'src/' END)
 || (CASE page_id % 3 WHEN 0 THEN 'test_' ELSE 'a b' END) || page_id::VARCHAR || (CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.HTML' WHEN 3 THEN '.rs' ELSE '' END) AS path,
 length(html) AS size FROM pages)"""


def made_paths(spark, d):
    k = lambda m, names, last: F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("page_id") % m).cast("int")), F.lit(last))
    folder = k(8, ["tests/", "docs/", "src/examples/", "db/migrate/", "vendor/"], "src/")
    name = F.when(F.col("page_id") % 3 == 0, "test_").otherwise("a b")
    suffix = k(5, [".py", ".min.js", ".HTML", ".rs"], "")
    return table(spark, d, "pages").select("page_id", F.concat(folder, name, F.col("page_id").cast("string"), suffix).alias("path"), F.length("html").cast("long").alias("size"))


@query("page_file_role", f"WITH {MADE} SELECT page_id, {_role_sql('path')} AS role FROM made")
def page_file_role(spark, d):
    return made_paths(spark, d).select("page_id", paths.file_role(F.col("path")).alias("role"))


@query("path_language", f"WITH {MADE} SELECT page_id, CASE {EXTENSION} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'html' THEN 'html' WHEN 'rs' THEN 'rust' END AS language FROM made")
def path_language(spark, d):
    return made_paths(spark, d).select("page_id", paths.language_of_path(F.col("path")).alias("language"))


@query("candidate_files", f"WITH {MADE} SELECT page_id, path FROM made WHERE {EXTENSION} = 'py' AND size BETWEEN 400 AND 200000 AND path NOT LIKE 'vendor/%'")
def candidate_files(spark, d):
    return made_paths(spark, d).where(paths.is_candidate(F.col("path"), F.col("size"), "python")).select("page_id", "path")


@query("permalinks", f"WITH {MADE} SELECT page_id, 'https://example.org/o/r/blob/c0ffee/' || replace(path, ' ', '%20') || '#L1-L' || size::VARCHAR AS link FROM made")
def permalinks(spark, d):
    rows = made_paths(spark, d)
    return rows.select("page_id", paths.permalink("https://example.org", F.lit("o/r"), F.lit("c0ffee"), F.col("path"), F.lit(1), F.col("size")).alias("link"))


@query("size_bands", "SELECT doc_id, CASE WHEN n_chars >= 5000 THEN '>=5000' WHEN n_chars >= 1000 THEN '1000..4999' WHEN n_chars >= 200 THEN '200..999' WHEN n_chars >= 50 THEN '50..199' END AS band FROM documents")
def size_bands(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.bands(F.col("n_chars"), 50).alias("band"))


@query("exact_dedup", f"WITH {sql.exact('documents')} SELECT doc_id FROM ex WHERE first")
def exact_dedup(spark, d):
    return dedup.exact_dedup(texts(spark, d)).select("doc_id")


_SETS = f"{sql.SNIP}, {sql.exact('snip')}, kept AS (SELECT doc_id, text FROM ex WHERE first), {sql.shingles('kept')}"


def sets(spark, d):
    rows = dedup.exact_dedup(texts(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", T.shingles(F.col("text")).alias("shingles"))


@query("shingle_counts", f"WITH {_SETS} SELECT doc_id, len(shingles)::INT AS n FROM sh")
def shingle_counts(spark, d):
    return sets(spark, d).select("doc_id", F.size("shingles").alias("n"))


_ITEMS = "it AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS h FROM sh)"
_PAIRS = f"""{_ITEMS}, cm AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb
 FROM it a JOIN it b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL), pairs AS (SELECT x, y, c / (na + nb - c) AS jaccard FROM cm WHERE c / (na + nb - c) >= 0.8)"""


@query("shingle_jaccard_pairs", f"WITH {_SETS}, {_PAIRS} SELECT x AS doc_x, y AS doc_y, round(jaccard, 6) AS jaccard FROM pairs")
def shingle_jaccard_pairs(spark, d):
    found = dedup.shared_shingle_pairs(sets(spark, d), 0.8)
    return found.select(F.col("x").alias("doc_x"), F.col("y").alias("doc_y"), F.round("jaccard", 6).alias("jaccard"))


@query("minhash_bands", f"WITH {_SETS}, {sql.bands('sh')} SELECT doc_id, band, key FROM bk")
def minhash_bands(spark, d):
    return dedup.band_keys(sets(spark, d))


_CAND = f"{_SETS}, {sql.bands('sh')}, cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM bk a JOIN bk b ON a.band = b.band AND a.key = b.key AND a.doc_id < b.doc_id)"


@query("lsh_candidates", f"WITH {_CAND} SELECT x AS doc_x, y AS doc_y FROM cand")
def lsh_candidates(spark, d):
    return dedup.candidate_pairs(dedup.band_keys(sets(spark, d))).select(F.col("x").alias("doc_x"), F.col("y").alias("doc_y"))


_VERIFIED = "pairs AS (SELECT c.x, c.y FROM cand c JOIN sh a ON a.doc_id = c.x JOIN sh b ON b.doc_id = c.y WHERE len(list_intersect(a.shingles, b.shingles)) / (len(a.shingles) + len(b.shingles) - len(list_intersect(a.shingles, b.shingles))) >= 0.8)"
_STATUS = f"WITH RECURSIVE {_CAND}, {_VERIFIED}, {sql.greedy('pairs')}, status AS (SELECT ex.doc_id, CASE WHEN NOT first THEN 'exact' WHEN gone.y IS NOT NULL THEN 'near' ELSE 'kept' END AS status FROM ex LEFT JOIN gone ON gone.y = ex.doc_id)"


@query("near_dup_greedy", f"{_STATUS} SELECT doc_id, status FROM status")
def near_dup_greedy(spark, d):
    return dedup.dedup_status(texts(spark, d).select("doc_id", "text"))


@query("dedup_stats", f"{_STATUS} SELECT count(*) AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'near') AS near, count(*) FILTER (status = 'kept') AS kept FROM status")
def dedup_stats(spark, d):
    return dedup.dedup_stats(dedup.dedup_status(texts(spark, d).select("doc_id", "text")))


@query("cross_set_dedup", """WITH t AS (SELECT 0 AS set_rank, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
""" + sql.exact("t", "set_rank, doc_id").replace("ex AS", "ex AS", 1) + " SELECT set_rank::INT AS set_rank, count(*) FILTER (NOT first) AS exact FROM ex GROUP BY ALL")  # fmt: skip
def cross_set_dedup(spark, d):
    parts = [table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")]
    return dedup.cross_status(parts).groupBy("set_rank").agg(F.count_if(F.col("status") == "exact").alias("exact"))


@query("benchmark_contamination", f"""WITH b AS (SELECT item_id AS doc_id, text FROM benchmark), {sql.shingles("b", "shb")}, {sql.shingles("documents", "shd")},
ib AS (SELECT doc_id AS item_id, len(shingles) AS n, unnest(shingles) AS h FROM shb), idd AS (SELECT doc_id, unnest(shingles) AS h FROM shd)
SELECT item_id, doc_id, round(count(*) / ANY_VALUE(n), 6) AS contained FROM ib JOIN idd USING (h) GROUP BY item_id, doc_id HAVING count(*) / ANY_VALUE(n) >= 0.8""")  # fmt: skip
def benchmark_contamination(spark, d):
    """Benchmark items whose shingles a document contains to eight tenths or more."""
    items = table(spark, d, "benchmark").select("item_id", T.shingles(F.col("text")).alias("s")).select("item_id", F.size("s").alias("n"), F.explode("s").alias("h"))
    held = texts(spark, d).select("doc_id", F.explode(T.shingles(F.col("text"))).alias("h"))
    counts = held.join(items, "h").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("c"))
    return counts.where(F.col("c") / F.col("n") >= 0.8).select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 6).alias("contained"))


@query("hash_unit", f"WITH {sql.SNIP} SELECT DISTINCT repo, {sql.unit('test', 'repo')} AS unit FROM snip")
def hash_unit(spark, d):
    return docs(spark, d).select("repo").distinct().withColumn("unit", splits.unit(splits.SALT, "test", F.col("repo")))


_SPLIT = f"WITH {sql.SNIP}, {sql.split()}"


@query("stable_group_split", f"{_SPLIT} SELECT repo, language, split, fold FROM split")
def stable_group_split(spark, d):
    return splits.stable_split(docs(spark, d))


@query("leakage_check", "SELECT 0::BIGINT AS shared")
def leakage_check(spark, d):
    rows = docs(spark, d)
    assigned = splits.assign(rows, splits.stable_split(rows))
    return splits.shared_repos(assigned.where("split = 'train'"), assigned.where("split = 'test'")).agg(F.count("*").alias("shared"))


@query("build_warnings", f"""{_SPLIT}, g AS (SELECT language, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM split GROUP BY language)
SELECT language, unnest(list_filter([CASE WHEN train = 0 THEN 'no train repos' WHEN train < 17 THEN 'few train repos' END, CASE WHEN test = 0 THEN 'no test data' END], lambda x: x IS NOT NULL)) AS warning FROM g""")  # fmt: skip
def build_warnings(spark, d):
    rows = docs(spark, d)
    return splits.warnings(splits.assign(rows, splits.stable_split(rows)), 17)


SALTS = [f"{splits.SALT}:repeat:{k}" for k in range(10)]


@query("repeated_splits", f"WITH {sql.SNIP}, {sql.split(SALTS, n_folds=2)} SELECT salt, repo, split FROM split")
def repeated_splits(spark, d):
    return splits.stable_split(docs(spark, d), n_folds=2, salts=SALTS).select("salt", "repo", "split")


@query("split_ratios", f"""WITH {sql.SNIP}, {sql.split(SALTS, n_folds=2)}, c AS (SELECT salt, count(*) FILTER (s.split = 'test') / count(*) FILTER (s.split = 'train') AS r FROM snip JOIN split s USING (repo) GROUP BY salt)
SELECT round(avg(r), 6) AS ratio, count(*) AS repeats FROM c""")  # fmt: skip
def split_ratios(spark, d):
    rows = docs(spark, d)
    split = splits.stable_split(rows, n_folds=2, salts=SALTS)
    counts = rows.join(split.drop("language"), "repo").groupBy("salt").agg((F.count_if(F.col("split") == "test") / F.count_if(F.col("split") == "train")).alias("r"))
    return counts.agg(F.round(F.avg("r"), 6).alias("ratio"), F.count("*").alias("repeats"))


@query("hard_placement", f"{_SPLIT}, w AS (SELECT DISTINCT source || ':' || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS repo FROM documents) SELECT COALESCE(s.split, 'neither') AS place, count(*) AS n FROM w LEFT JOIN split s USING (repo) GROUP BY 1")
def hard_placement(spark, d):
    rows = docs(spark, d)
    odd = table(spark, d, "documents").select(F.concat_ws(":", "source", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang"))).alias("repo")).distinct()
    return splits.place_counts(odd, splits.stable_split(rows))


@query("sample_per_language", f"WITH {sql.SNIP} SELECT language, row_number() OVER (PARTITION BY language ORDER BY {sql.unit('sample', 'doc_id::VARCHAR')}, doc_id)::INT AS rank, doc_id FROM snip QUALIFY rank <= 5")
def sample_per_language(spark, d):
    return splits.sample(docs(spark, d), 5).select("language", "rank", "doc_id")


@query("round_robin_interleave", f"""WITH {sql.SNIP}, g AS (SELECT repo, language, count(*) AS n FROM snip GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, repo) AS turn FROM g)
SELECT row_number() OVER (ORDER BY turn, language, repo)::INT AS position, repo FROM t QUALIFY position <= 30""")  # fmt: skip
def round_robin_interleave(spark, d):
    repos = docs(spark, d).groupBy("repo", "language").agg(F.count("*").alias("n"))
    return splits.round_robin(repos, "language", "repo", [F.desc("n"), F.col("repo")], 30)


@query("snippet_validity", "SELECT CASE WHEN trim(text) = '' THEN 'blank text' WHEN doc_id % 7 = 0 THEN 'unknown source' WHEN doc_id % 5 = 0 THEN 'bad lines' ELSE 'valid' END AS verdict, count(*) AS n FROM documents GROUP BY 1")
def snippet_validity(spark, d):
    from ..sources.tables import invalid

    rows = table(spark, d, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 7 == 0, "odd").otherwise("github").alias("source"), F.col("source").alias("repo"), F.lit("mit").alias("license"),
        F.lit(1).alias("start_line"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(9).alias("end_line"),
    )
    return rows.select(F.coalesce(invalid(), F.lit("valid")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))
