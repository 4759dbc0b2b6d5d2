"""Queries that put operators together: dataset building, sinks, significance, Tsetlin machines out of fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clauses, corpus, curves, errors, metrics, tsetlin
from ..sources.tables import manifest
from . import sql
from .curation import _CAND, _VERIFIED, EMBEDDED, P, docs, page_snippets
from .inspection import _BASE, _SIGN, model, rows
from .modelling import TERMS, _both_sql, labelled_sets, two_models
from .registry import query, table

_BUILT = f"""WITH RECURSIVE all0 AS (SELECT * FROM documents), {_CAND}, {_VERIFIED}, {sql.greedy('pairs')},
stay AS (SELECT ex.doc_id FROM ex LEFT JOIN gone ON gone.y = ex.doc_id WHERE first AND gone.y IS NULL)"""
_SPLIT_STAY = sql.split().replace("FROM snip GROUP", "FROM snip SEMI JOIN stay USING (doc_id) GROUP")


@query("build_manifest", f"{_BUILT}, {_SPLIT_STAY} SELECT s.split, snip.language, count(*) AS n, count(DISTINCT snip.repo) AS repos FROM snip SEMI JOIN stay USING (doc_id) JOIN split s USING (repo) GROUP BY ALL")
def build_manifest(spark, d):
    """Deduplicate, split by repository, and count."""
    dataset, _ = corpus.build(docs(spark, d))
    m = manifest(dataset)
    return m.counts.join(m.repos, ["split", "language"])


@query("build_with_benchmark_as_wild")
def build_with_benchmark_as_wild(spark, d):
    """Benchmark passages as held-out wild rows: those that repeat a document go."""
    wild = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("language"), F.lit("wild").alias("repo"))
    dataset, _ = corpus.build(docs(spark, d), wild)
    return dataset.groupBy("split").agg(F.count("*").alias("n"))


@query("collect_snippets")
def collect_snippets(spark, d):
    """Windows of pages as files of their hosts, label-checked, with a cap for each host."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    files = page_snippets(spark, d).join(table(spark, d, "pages").select("page_id", host.alias("repo")), "page_id")
    files = files.select("repo", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), "text", F.lit("mit").alias("license"))
    return corpus.collect(files, 2, min_lines=4, max_lines=10, min_nonblank=3).select("repo", "path", "start_line", "end_line", "fate")


def _fired(spark, d):
    return clauses.fired(rows(spark, d), model(spark))


def _preds(spark, d):
    r = rows(spark, d)
    return clauses.predict(clauses.class_sums(r, model(spark))).join(r.select("doc_id", "label"), "doc_id")


_INTO = "hit AS (SELECT f.doc_id, f.clause_id, f.pos FROM fired f JOIN prd p USING (doc_id) WHERE p.pred = 'en' AND p.label <> 'en' AND f.class = 'en' AND f.weight > 0)"


@query("sink_pulling_rules", f"{_BASE}, {_INTO}, c AS (SELECT clause_id, count(*) AS n FROM hit GROUP BY clause_id) SELECT row_number() OVER (ORDER BY n DESC, clause_id)::INT AS rank, clause_id, n FROM c QUALIFY rank <= 10")
def sink_pulling_rules(spark, d):
    return errors.pulling_rules(_fired(spark, d), _preds(spark, d), "en")


@query("sink_pulling_terms", f"{_BASE}, {_INTO}, l AS (SELECT DISTINCT doc_id, unnest(pos) AS feature_id FROM hit), c AS (SELECT feature_id, count(*) AS n FROM l GROUP BY feature_id) SELECT row_number() OVER (ORDER BY n DESC, feature_id)::INT AS rank, feature_id, n FROM c QUALIFY rank <= 15")
def sink_pulling_terms(spark, d):
    return errors.pulling_terms(_fired(spark, d), _preds(spark, d), "en")


@query("generic_signatures", f"""{_BASE}, {_SIGN}, z AS (SELECT label, count(*) AS n_c, (SUM(count(*)) OVER ())::BIGINT AS n FROM rw GROUP BY label),
c AS (SELECT feature_id, language AS label, count(*) AS c FROM sm GROUP BY ALL), t AS (SELECT feature_id, SUM(c) AS t FROM c GROUP BY feature_id),
fd AS (SELECT s.class, round((COALESCE(t.t, 0) - COALESCE(c.c, 0)) / (n - n_c), 6) AS foreign_df FROM sg s JOIN z ON z.label = s.class LEFT JOIN c ON c.feature_id = s.feature_id AND c.label = s.class LEFT JOIN t ON t.feature_id = s.feature_id WHERE s.rank <= 3),
m AS (SELECT class, round(avg(foreign_df), 6) AS foreign_df FROM fd GROUP BY class) SELECT class, foreign_df, row_number() OVER (ORDER BY foreign_df DESC, class) = 1 AS highest FROM m""")  # fmt: skip
def generic_signatures(spark, d):
    r = rows(spark, d)
    found = r.select("label", F.explode("features").alias("feature_id"))
    return errors.generic_signatures(errors.signature_frequency(clauses.signatures(model(spark), 3), found, r))


@query("embedded_probe", f"""WITH {P}, {EMBEDDED}, vals AS (SELECT share AS v, page_id % 3 = 0 AS first, page_id % 3 AS errors, 3 AS seeds FROM emb),
rk AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM vals)
SELECT count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, SUM(r) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2 AS u,
 round(median(v) FILTER (first), 6) AS median_wrong, round(median(v) FILTER (NOT first), 6) AS median_right,
 round(COALESCE(SUM(errors) FILTER (v > 0.5) / SUM(seeds) FILTER (v > 0.5), 0.0), 6) AS rate_embedded, round(COALESCE(SUM(errors) FILTER (v <= 0.5) / SUM(seeds) FILTER (v <= 0.5), 0.0), 6) AS rate_rest FROM rk""")  # fmt: skip
def embedded_probe(spark, d):
    pages = page_snippets(spark, d).select("page_id", T.non_blank_lines(F.col("text")).alias("l"))
    k = (F.col("page_id") % 3).cast("int")
    return errors.embedded_probe(pages.select(T.embedded_share(F.col("l")).alias("share"), (k == 0).alias("wrong"), k.alias("errors"), F.lit(3).alias("seeds")))


@query("seed_aggregate", _both_sql("""SELECT * FROM (WITH lg AS (SELECT 'full' AS model, key // 5 AS seed, key % 5 AS fold, macro_f1 FROM fu UNION ALL SELECT 'small', key // 5, key % 5, macro_f1 FROM sl),
s AS (SELECT model, seed, avg(macro_f1) AS m FROM lg GROUP BY ALL), f AS (SELECT model, fold, avg(macro_f1) AS m FROM lg GROUP BY ALL),
a AS (SELECT model, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS seed_std FROM s GROUP BY model), b AS (SELECT model, round(stddev_pop(m), 6) AS fold_std FROM f GROUP BY model) SELECT * FROM a JOIN b USING (model))"""))  # fmt: skip
def seed_aggregate(spark, d):
    return metrics.seed_aggregate(two_models(spark, d))


@query("significance")
def significance(spark, d):
    scores = two_models(spark, d).select(F.lit("cv").alias("evaluation"), "model", (F.col("seed") * 5 + F.col("fold")).alias("split"), F.col("macro_f1").alias("value"))
    return metrics.significance(scores, "full", 0.25)


_TINY = tsetlin.Setting(n_clauses=6, T=6, s=3.0, epochs=2)


@query("tm_out_of_fold")
def tm_out_of_fold(spark, d):
    return tsetlin.out_of_fold(labelled_sets(spark, d).where("split = 'train'"), len(TERMS), {"tiny": _TINY}, (1,), 600)


@query("tm_formation")
def tm_formation(spark, d):
    """Per literal of the final model, the epoch from which its share has settled."""
    made = tsetlin.formation(labelled_sets(spark, d).where("split = 'train'"), len(TERMS), tsetlin.Setting(n_clauses=6, T=6, s=3.0, epochs=4), 1, 600)
    return curves.settled_epoch(made, ("class", "feature_id"))
