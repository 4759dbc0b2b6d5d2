"""DuckDB building blocks of the oracles: common table expressions over the driver's views."""

from __future__ import annotations

from ..functions import text as T
from ..operators.dedup import BANDS, PRIME, ROWS, coefficients
from ..operators.splits import SALT


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


SNIP = "snip AS (SELECT doc_id, text, lang AS language, source || ':' || lang AS repo FROM documents)"


def lines(text: str = "text") -> str:
    return f"list_filter(string_split_regex({text}, {q(T.LINE_END)}), lambda x: regexp_matches(x, {q(T.NOT_SPACE)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def share(lines_: str, test: str) -> str:
    return f"CASE WHEN len({lines_}) > 0 THEN len(list_filter({lines_}, lambda x: {test})) / len({lines_}) ELSE 0.0 END"


def normalized(text: str = "text") -> str:
    return f"trim(regexp_replace({text}, {q(T.SPACE + '+')}, ' ', 'g'))"


def unit(kind: str, key: str, salt: str = q(SALT)) -> str:
    return f"(('0x' || substr(sha256({salt} || ':{kind}:' || {key}), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0)"


def split(salts: list[str] | None = None, test_size: float = 0.2, n_folds: int = 5) -> str:
    """CTEs up to `split` (salt, repo, language, split, fold); needs `snip`."""
    values = ", ".join(f"({q(s)})" for s in salts or [SALT])
    return f"""
repo0 AS (SELECT repo, language, count(*) AS n FROM snip GROUP BY ALL),
repo1 AS (SELECT repo, language FROM repo0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) = 1),
sp0 AS (SELECT salt, repo, language, {unit("test", "repo", "salt")} AS u, {unit("fold", "repo", "salt")} AS v FROM repo1, (VALUES {values}) t(salt)),
sp1 AS (SELECT *, count(*) OVER (PARTITION BY salt, language) AS n, row_number() OVER (PARTITION BY salt, language ORDER BY u, repo) AS rk FROM sp0),
sp2 AS (SELECT *, CASE WHEN n > 1 THEN least(greatest(round_even(n * {test_size}, 0)::INT, 1), n - 1) ELSE round_even(n * {test_size}, 0)::INT END AS k FROM sp1),
split AS (SELECT salt, repo, language, CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS split,
                 CASE WHEN rk > k THEN ((row_number() OVER (PARTITION BY salt, language, rk <= k ORDER BY v, repo) - 1) * {n_folds} // (n - k))::INT END AS fold FROM sp2)"""


def ngrams(rows: str, name: str = "ng") -> str:
    """CTE of (doc_id, language, repo, term) from a relation of snippets."""
    return f"""
ch_{name} AS (SELECT doc_id, language, repo, regexp_extract_all(text, '(?s).') AS c FROM {rows}),
{name} AS (SELECT doc_id, language, repo, unnest(list_distinct(list_concat(
    list_transform(range(1, len(c)), lambda i: c[i] || c[i+1]),
    list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2])))) AS term FROM ch_{name})"""


def class_scores(ng: str, rows: str, min_df: int) -> str:
    """CTEs up to `cell` (term, language, df_c, df, n_c, n), absent cells included."""
    return f"""
dfc AS (SELECT term, language, count(*) AS df_c FROM {ng} GROUP BY ALL),
tot AS (SELECT term, SUM(df_c)::BIGINT AS df FROM dfc GROUP BY term HAVING SUM(df_c) >= {min_df}),
sz AS (SELECT language, count(*) AS n_c, (SUM(count(*)) OVER ())::BIGINT AS n FROM {rows} GROUP BY language),
cell AS (SELECT tot.term, sz.language, COALESCE(dfc.df_c, 0) AS df_c, tot.df, sz.n_c, sz.n
         FROM tot CROSS JOIN sz LEFT JOIN dfc ON dfc.term = tot.term AND dfc.language = sz.language)"""


def balanced(budget: int) -> str:
    """CTE `vocab` (feature_id, term, score) from `cell`."""
    return f"""
sc AS (SELECT term, language, round(df_c / n_c - CASE WHEN n > n_c THEN (df - df_c) / (n - n_c) ELSE 0.0 END, 9) AS score FROM cell),
trn AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY score DESC, term) AS turn FROM sc),
fst AS (SELECT term, turn, language, score FROM trn WHERE turn <= {budget} QUALIFY row_number() OVER (PARTITION BY term ORDER BY turn, language) = 1),
vocab AS (SELECT (row_number() OVER (ORDER BY turn, language) - 1)::INT AS feature_id, term, score FROM fst ORDER BY turn, language LIMIT {budget})"""


def naive_bayes(found: str, rows: str, by: str = "", ids: str = "SELECT feature_id FROM vocab", ids_on: str = "true") -> str:
    """CTEs up to `nb` (by, language, feature_id, log_p, log_q, log_prior) from present features and training rows.

    ids_on: which ids (v) belong to which sizes (s).
    """
    b = f"{by}, " if by else ""
    on = f"AND c.{by} = s.{by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
nbn AS (SELECT {b}language, count(*) AS n_c FROM {rows} GROUP BY ALL),
nbs AS (SELECT *, ln(n_c / SUM(n_c) OVER ({part})) AS log_prior FROM nbn),
nbc AS (SELECT {b}language, feature_id, count(*) AS df FROM {found} GROUP BY ALL),
nbp AS (SELECT {"s." + by + ", " if by else ""}s.language, v.feature_id, (COALESCE(c.df, 0) + 1) / (s.n_c + 2) AS p, s.log_prior
        FROM nbs s JOIN ({ids}) v ON {ids_on} LEFT JOIN nbc c ON c.language = s.language AND c.feature_id = v.feature_id {on}),
nb AS (SELECT {b}language, feature_id, ln(p) AS log_p, ln(1 - p) AS log_q, log_prior FROM nbp)"""


def fold_vocabulary(budget: int, min_df: int, n_folds: int) -> str:
    """CTE `vocab` (key, feature_id, term): the class-balanced ranking over the rows outside each fold, counted anew.

    From `ng`, `fold0` (seed, repo, fold) and `fitr` (key, doc_id, language), with key = seed * n_folds + fold.
    """
    return f"""
vrepo AS (SELECT repo, language, term, count(*) AS n FROM ng GROUP BY ALL),
vdf AS (SELECT f.seed * {n_folds} + o.k AS key, term, language, SUM(n)::BIGINT AS df_c FROM vrepo JOIN fold0 f USING (repo), range({n_folds}) o(k) WHERE f.fold <> o.k GROUP BY ALL),
vtot AS (SELECT key, term, SUM(df_c)::BIGINT AS df FROM vdf GROUP BY ALL HAVING SUM(df_c) >= {min_df}),
vsz AS (SELECT key, language, count(*) AS n_c, (SUM(count(*)) OVER (PARTITION BY key))::BIGINT AS n FROM fitr GROUP BY key, language),
vcell AS (SELECT t.key, t.term, z.language, COALESCE(d.df_c, 0) AS df_c, t.df, z.n_c, z.n FROM vtot t JOIN vsz z ON z.key = t.key
          LEFT JOIN vdf d ON d.key = t.key AND d.term = t.term AND d.language = z.language),
vsc AS (SELECT key, term, language, round(df_c / n_c - CASE WHEN n > n_c THEN (df - df_c) / (n - n_c) ELSE 0.0 END, 9) AS score FROM vcell),
vtrn AS (SELECT *, row_number() OVER (PARTITION BY key, language ORDER BY score DESC, term) AS turn FROM vsc QUALIFY turn <= {budget}),
vfst AS (SELECT key, term, turn, language FROM vtrn QUALIFY row_number() OVER (PARTITION BY key, term ORDER BY turn, language) = 1),
vocab AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY turn, language) - 1)::INT AS feature_id, term FROM vfst QUALIFY feature_id < {budget})"""


def nb_scores(found: str, rows: str, by: str = "") -> str:
    """CTEs up to `scored` (by, doc_id, label, class, score) and `pred`."""
    b, rb = (f"{by}, ", f"r.{by}, ") if by else ("", "")
    on = f"AND f.{by} = r.{by}" if by else ""
    m = f"AND m.{by} = f.{by}" if by else ""
    base = f"b.{by} = r.{by}" if by else "true"
    return f"""
bse AS (SELECT {b}language AS class, SUM(log_q) + ANY_VALUE(log_prior) AS base FROM nb GROUP BY ALL),
own AS (SELECT {"f." + by + ", " if by else ""}f.doc_id, m.language AS class, SUM(m.log_p - m.log_q) AS gain FROM {found} f JOIN nb m ON m.feature_id = f.feature_id {m} GROUP BY ALL),
scored AS (SELECT {rb}r.doc_id, r.language AS label, b.class, round(b.base + COALESCE(f.gain, 0), 6) AS score
           FROM {rows} r JOIN bse b ON {base} LEFT JOIN own f ON f.doc_id = r.doc_id AND f.class = b.class {on}),
pred AS (SELECT {b}doc_id, label, class AS pred FROM scored QUALIFY row_number() OVER (PARTITION BY {b}doc_id ORDER BY score DESC, class) = 1)"""


def shingles(rows: str, name: str = "sh", k: int = 5) -> str:
    """CTE of (doc_id, shingles) from a relation (doc_id, text)."""
    token = q(rf"{T.WORD}+|[^\p{{L}}\p{{N}}_{T.SPACE[1:-1]}]")
    return f"""
tk_{name} AS (SELECT doc_id, regexp_extract_all(text, {token}) AS t FROM {rows}),
{name} AS (SELECT doc_id, list_distinct(list_transform(CASE WHEN len(t) <= {k} THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - {k - 2}), lambda i: array_to_string(t[i:i+{k - 1}], ' ')) END,
    lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT)) AS shingles FROM tk_{name})"""


def bands(sets: str, name: str = "bk") -> str:
    """CTE of (doc_id, band, key) from (doc_id, shingles)."""
    pairs = ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in coefficients())
    return f"""
sg_{name} AS (SELECT doc_id, list_transform([{pairs}], lambda p: list_min(list_transform(shingles, lambda h: (h * p.a + p.b) % {PRIME}))) AS sig FROM {sets}),
{name} AS (SELECT doc_id, band::INT AS band, array_to_string(sig[band * {ROWS} + 1 : (band + 1) * {ROWS}], '-') AS key FROM sg_{name}, range({BANDS}) r(band))"""


def exact(rows: str, order: str = "doc_id") -> str:
    """CTE `ex` (…, first) from a relation with a text."""
    return f"ex AS (SELECT *, row_number() OVER (PARTITION BY sha1({normalized()}) ORDER BY {order}) = 1 AS first FROM {rows})"


def greedy(pairs: str) -> str:
    """CTE `gone` (y): rows removed by the greedy rule, in order; recursion over the rows that have pairs.

    A row's fate is decided after those of all earlier rows, so one step decides one row.
    """
    return f"""
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT x AS id FROM {pairs} UNION SELECT y FROM {pairs})),
links AS (SELECT b.i AS i, list(a.i) AS earlier, ANY_VALUE(b.id) AS id FROM {pairs} p JOIN nodes a ON a.id = p.x JOIN nodes b ON b.id = p.y GROUP BY b.i),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
         UNION ALL
         SELECT w.i + 1, CASE WHEN l.i IS NOT NULL AND len(list_intersect(l.earlier, w.kept)) > 0 THEN w.kept ELSE list_append(w.kept, w.i + 1) END
         FROM walk w LEFT JOIN links l ON l.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM nodes)),
gone AS (SELECT id AS y FROM nodes WHERE NOT list_contains((SELECT kept FROM walk ORDER BY i DESC LIMIT 1), i))"""
