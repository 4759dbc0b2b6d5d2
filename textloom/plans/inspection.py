"""Queries on clause models, learning curves and errors, over a small fixed clause table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses, curves, errors, metrics
from ..streaming.scoring import present, score
from . import sql
from .curation import docs
from .modelling import _SMALL_F, OOF_TERMS, SEEDS, SMALL, TERMS, _oof_sql, oof, oof_models
from .registry import query

#: A model over the small vocabulary: clause_id, class_idx, class, weight, pos, neg. It has clauses of
#: every kind: for, against, of weight zero, empty, of negations alone, and copies.
CLAUSES = (
    (0, 0, "de", 3, [2, 3], [8]),
    (1, 0, "de", 2, [3], [0, 8]),
    (2, 0, "de", -2, [0, 1], [3]),
    (3, 0, "de", 5, [], []),
    (4, 1, "en", 4, [0, 1], []),
    (5, 1, "en", 1, [0], [7]),
    (6, 1, "en", -1, [3, 8], []),
    (7, 1, "en", 1, [0], [7]),
    (8, 2, "es", 3, [6, 7], [0, 3]),
    (9, 2, "es", 2, [], [0, 1, 2, 3, 4]),
    (10, 2, "es", 0, [8], []),
    (11, 3, "fr", 3, [4, 5], [0]),
    (12, 3, "fr", 2, [5, 8], [3]),
    (13, 3, "fr", -2, [0], []),
)
CLASSES = ("de", "en", "es", "fr")

_LIST = lambda x: f"[{', '.join(map(str, x))}]::INT[]"
_CL = "cl AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, '{c}', {w}, {_LIST(p)}, {_LIST(n)})" for i, k, c, w, p, n in CLAUSES) + ") t(clause_id, class_idx, class, weight, pos, neg))"
_BASE = f"""WITH {sql.SNIP}, {_SMALL_F}, {_CL}, fs AS (SELECT snip.doc_id, snip.language AS label, list(sm.feature_id) FILTER (sm.feature_id IS NOT NULL) AS f0 FROM snip LEFT JOIN sm USING (doc_id) GROUP BY ALL),
rw AS (SELECT doc_id, label, COALESCE(f0, []::INT[]) AS features FROM fs),
fired AS (SELECT rw.doc_id, rw.label, rw.features, cl.* FROM rw CROSS JOIN cl WHERE len(pos) + len(neg) > 0 AND len(list_filter(pos, lambda x: NOT list_contains(features, x))) = 0 AND NOT list_has_any(neg, features)),
cs AS (SELECT class_idx, class FROM cl GROUP BY ALL), vt AS (SELECT doc_id, class_idx, SUM(weight) AS v FROM fired GROUP BY ALL),
sums AS (SELECT rw.doc_id, rw.label, cs.class_idx, cs.class, COALESCE(vt.v, 0)::BIGINT AS votes FROM rw CROSS JOIN cs LEFT JOIN vt ON vt.doc_id = rw.doc_id AND vt.class_idx = cs.class_idx),
prd AS (SELECT doc_id, label, class AS pred FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, class_idx) = 1)"""  # fmt: skip


def model(spark):
    return clauses.model(spark, list(CLAUSES), len(TERMS))


def vocabulary(spark):
    return spark.createDataFrame(list(enumerate(TERMS)), "feature_id int, term string")


def rows(spark, d):
    return docs(spark, d).select("doc_id", F.col("language").alias("label"), present(F.col("text"), list(TERMS)).alias("features"))


@query("clause_fire", f"{_BASE} SELECT doc_id, clause_id FROM fired")
def clause_fire(spark, d):
    return clauses.fired(rows(spark, d), model(spark)).select("doc_id", "clause_id")


@query("clause_rules_match", f"{_BASE} SELECT doc_id, clause_id FROM fired WHERE false")
def clause_rules_match(spark, d):
    """Where two implementations of firing differ: nowhere."""
    r, m = rows(spark, d), model(spark)
    a, b = clauses.fired(r, m).select("doc_id", "clause_id"), clauses.by_joins(r, m)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("class_sums", f"{_BASE} SELECT doc_id, class_idx, class, votes FROM sums")
def class_sums(spark, d):
    return clauses.class_sums(rows(spark, d), model(spark))


@query("clause_predict", f"{_BASE} SELECT doc_id, pred FROM prd")
def clause_predict(spark, d):
    return clauses.predict(clauses.class_sums(rows(spark, d), model(spark)))


@query("clause_score_map", f"{_BASE} SELECT doc_id, pred FROM prd")
def clause_score_map(spark, d):
    """The streaming form, on a batch."""
    return score(docs(spark, d), list(CLAUSES), list(TERMS)).select("doc_id", "pred")


@query("explain", f"{_BASE}, r AS (SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id, class ORDER BY abs(weight) DESC, clause_id)::INT AS rank, clause_id, weight FROM fired WHERE weight <> 0) SELECT * FROM r WHERE rank <= 2")
def explain(spark, d):
    return clauses.explain(rows(spark, d), model(spark), 2)


_RULES = "rl AS (SELECT clause_id, class, CASE WHEN len(pos) + len(neg) > 0 THEN array_to_string(list_concat(list_transform(list_sort(pos), lambda i: 'has(\"' || tm.t[i + 1] || '\")'), list_transform(list_sort(neg), lambda i: 'NOT has(\"' || tm.t[i + 1] || '\")')), ' AND ') ELSE '(empty clause: never fires)' END AS rule FROM cl, (SELECT [" + ", ".join(map(sql.q, TERMS)) + "] AS t) tm)"


@query("rule_texts", f"WITH {_CL}, {_RULES} SELECT clause_id, class, rule FROM rl")
def rule_texts(spark, d):
    return clauses.rule_text(model(spark), vocabulary(spark))


@query("short_rules", f"WITH {_CL}, {_RULES}, p AS (SELECT clause_id, string_split(rule, ' AND ') AS p, rule FROM rl) SELECT clause_id, CASE WHEN len(p) > 2 THEN array_to_string(p[1:2], ' AND ') || ' AND ... (+' || (len(p) - 2)::VARCHAR || ' more)' ELSE rule END AS rule FROM p")
def short_rules(spark, d):
    return clauses.rule_text(model(spark), vocabulary(spark)).select("clause_id", clauses.short_rule(F.col("rule"), 2).alias("rule"))


_STATS = """hit AS (SELECT clause_id, count(*) FILTER (label = class) AS own, count(*) FILTER (label <> class) AS other FROM fired GROUP BY clause_id),
tot AS (SELECT label, count(*) AS own_total FROM rw GROUP BY label), al AS (SELECT count(*) AS n FROM rw),
stt AS (SELECT cl.*, COALESCE(own, 0) AS fires_own, COALESCE(other, 0) AS fires_other, COALESCE(own_total, 0) AS own_total, n FROM cl LEFT JOIN hit USING (clause_id) LEFT JOIN tot ON tot.label = cl.class CROSS JOIN al),
sta AS (SELECT *, len(pos) + len(neg) AS n_literals, CASE WHEN own_total > 0 THEN fires_own / own_total ELSE 0.0 END AS coverage, CASE WHEN n > own_total THEN fires_other / (n - own_total) ELSE 0.0 END AS false_fire_rate,
        CASE WHEN fires_own + fires_other > 0 THEN fires_own / (fires_own + fires_other) ELSE 0.0 END AS precision_ FROM stt)"""  # fmt: skip


def stats(spark, d):
    return clauses.clause_stats(rows(spark, d), model(spark))


@query("clause_stats", f"{_BASE}, {_STATS} SELECT clause_id, class, weight, n_literals::INT AS n_literals, fires_own, fires_other, round(coverage, 6) AS coverage, round(false_fire_rate, 6) AS false_fire_rate, round(precision_, 6) AS precision FROM sta")
def clause_stats(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return stats(spark, d).select("clause_id", "class", "weight", "n_literals", "fires_own", "fires_other", r("coverage"), r("false_fire_rate"), r("precision"))


@query("language_summary", f"""{_BASE}, {_STATS}, k AS (SELECT *, list_sort(pos)::VARCHAR || '|' || list_sort(neg)::VARCHAR AS key FROM sta),
dp AS (SELECT class, SUM(c - 1)::BIGINT AS duplicates FROM (SELECT class, key, count(*) AS c FROM k WHERE n_literals > 0 GROUP BY ALL) GROUP BY class),
dl AS (SELECT class, count(DISTINCT l) AS distinct_literals FROM (SELECT class, unnest(list_concat(list_transform(pos, lambda i: i + 1), list_transform(neg, lambda i: -(i + 1)))) AS l FROM k) GROUP BY class),
s AS (SELECT class, count(*) AS clauses, count(*) FILTER (weight > 0) AS "for", count(*) FILTER (weight < 0) AS against, count(*) FILTER (weight = 0) AS zero_weight, count(*) FILTER (n_literals = 0) AS empty,
 round(COALESCE(avg(n_literals) FILTER (n_literals > 0), 0), 6) AS mean_literals, COALESCE(median(n_literals) FILTER (n_literals > 0), 0) AS median_literals, MAX(n_literals)::INT AS max_literals,
 SUM(greatest(weight, 0))::BIGINT AS total_for, SUM(greatest(-weight, 0))::BIGINT AS total_against, count(*) FILTER (n_literals > 0 AND fires_own + fires_other <= 1) AS narrow FROM k GROUP BY class)
SELECT s.*, COALESCE(duplicates, 0) AS duplicates, COALESCE(distinct_literals, 0) AS distinct_literals FROM s LEFT JOIN dp USING (class) LEFT JOIN dl USING (class)""")  # fmt: skip
def language_summary(spark, d):
    return clauses.language_summary(model(spark), stats(spark, d))


_USAGE = """ch AS (SELECT * FROM cl WHERE weight > 0 AND len(pos) + len(neg) > 0), nc AS (SELECT class, count(*) AS n FROM ch GROUP BY class),
lt AS (SELECT class, unnest(pos) AS feature_id, false AS negated FROM ch UNION ALL SELECT class, unnest(neg), true FROM ch),
us AS (SELECT class, feature_id, negated, round(count(*) / ANY_VALUE(n), 6) AS usage FROM lt JOIN nc USING (class) GROUP BY class, feature_id, negated)"""
_SIGN = f"""{_USAGE}, u1 AS (SELECT class, feature_id, usage, (SUM(usage) OVER (PARTITION BY feature_id) - usage) / 3 AS rest FROM us WHERE NOT negated),
u2 AS (SELECT *, (usage + 0.01) / (rest + 0.01) AS lift0 FROM u1),
sg AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY round(usage * ln(lift0), 6) DESC, feature_id)::INT AS rank, feature_id, usage, round(lift0, 6) AS lift, round(usage * ln(lift0), 6) AS score FROM u2 WHERE usage > 0)"""


@query("literal_usage", f"WITH {_CL}, {_USAGE} SELECT * FROM us")
def literal_usage(spark, d):
    return clauses.literal_usage(model(spark))


@query("signatures", f"WITH {_CL}, {_SIGN} SELECT * FROM sg WHERE rank <= 10")
def signatures(spark, d):
    return clauses.signatures(model(spark))


@query("class_overlap", f"""WITH {_CL}, st AS (SELECT c.class, list(DISTINCT l.f) FILTER (l.f IS NOT NULL) AS s FROM (SELECT DISTINCT class FROM cl) c LEFT JOIN (SELECT class, unnest(pos) AS f FROM cl WHERE weight > 0) l USING (class) GROUP BY c.class)
SELECT a.class AS a, b.class AS b, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0.0 END, 6) AS jaccard FROM st a JOIN st b ON a.class <= b.class""")  # fmt: skip
def class_overlap(spark, d):
    return clauses.class_overlap(model(spark))


@query("top_clauses", f"{_BASE}, {_STATS} SELECT class, row_number() OVER (PARTITION BY class ORDER BY round(coverage * precision_, 9) DESC, weight DESC, clause_id)::INT AS rank, clause_id FROM sta WHERE weight > 0 AND n_literals > 0 QUALIFY rank <= 2")
def top_clauses(spark, d):
    return clauses.top_clauses(stats(spark, d), 2)


@query("signature_matrix", f"""WITH {_CL}, {_SIGN}, tp AS (SELECT feature_id, MIN(class) AS owner FROM sg WHERE rank <= 3 GROUP BY feature_id), k AS (SELECT DISTINCT class FROM cl)
SELECT tp.feature_id, owner, k.class, COALESCE(us.usage, 0.0) AS usage FROM tp CROSS JOIN k LEFT JOIN us ON us.class = k.class AND us.feature_id = tp.feature_id AND NOT us.negated""")  # fmt: skip
def signature_matrix(spark, d):
    return clauses.signature_matrix(model(spark))


#: The same model without every third clause, as another seed's.
_CL2 = "cl AS (SELECT * FROM c0 WHERE clause_id % 3 <> 2)"


@query("seed_stability", f"""WITH a AS (WITH {_CL}, {_SIGN} SELECT class, rank, feature_id, score FROM sg WHERE rank <= 3), b AS (WITH {_CL.replace('cl AS', 'c0 AS', 1)}, {_CL2}, {_SIGN} SELECT class, feature_id, score FROM sg WHERE rank <= 3),
n AS (SELECT class, count(*) AS n FROM a GROUP BY class), j AS (SELECT class, count(*) AS shared FROM a JOIN b USING (class, feature_id) GROUP BY class)
SELECT n.class, round(COALESCE(shared, 0) / n.n, 6) AS overlap FROM n LEFT JOIN j USING (class)""")  # fmt: skip
def seed_stability(spark, d):
    mine = clauses.signatures(model(spark), 3).withColumnRenamed("feature_id", "term")
    theirs = clauses.signatures(model(spark).where("clause_id % 3 <> 2"), 3).withColumnRenamed("feature_id", "term")
    return clauses.seed_stability(mine, theirs).select("class", "overlap")


@query("signature_document_frequency", f"""{_BASE}, {_SIGN}, z AS (SELECT label, count(*) AS n_c, (SUM(count(*)) OVER ())::BIGINT AS n FROM rw GROUP BY label),
c AS (SELECT feature_id, language AS label, count(*) AS c FROM sm GROUP BY ALL), t AS (SELECT feature_id, SUM(c) AS t FROM c GROUP BY feature_id)
SELECT s.class, s.feature_id, round(COALESCE(c.c, 0) / n_c, 6) AS own_df, round((COALESCE(t.t, 0) - COALESCE(c.c, 0)) / (n - n_c), 6) AS foreign_df
FROM sg s JOIN z ON z.label = s.class LEFT JOIN c ON c.feature_id = s.feature_id AND c.label = s.class LEFT JOIN t ON t.feature_id = s.feature_id WHERE s.rank <= 3""")  # fmt: skip
def signature_document_frequency(spark, d):
    r = rows(spark, d)
    found = r.select("label", F.explode("features").alias("feature_id"))
    return errors.signature_frequency(clauses.signatures(model(spark), 3), found, r)


#: A learning curve made from the tables: the share of documents up to each epoch that hold a term.
_CURVE = "cv AS (SELECT (e + 1)::INT AS epoch, round(0.5 + 0.4 * e / (e + 5.0) + 0.05 * sin(e * 1.7), 6) AS value FROM range(40) t(e))"


def made_curve(spark):
    e = F.col("id")
    return spark.range(40).select((e + 1).cast("int").alias("epoch"), F.round(0.5 + 0.4 * e / (e + 5.0) + 0.05 * F.sin(e * 1.7), 6).alias("value"))


_SMOOTH = "nn AS (SELECT *, least(4, epoch - 1, 40 - epoch) AS r FROM cv), smo AS (SELECT a.epoch, round(avg(b.value), 6) AS smooth FROM nn a JOIN cv b ON abs(a.epoch - b.epoch) <= a.r GROUP BY a.epoch)"


@query("learning_curve_smooth", f"WITH {_CURVE}, {_SMOOTH} SELECT epoch, smooth FROM smo")
def learning_curve_smooth(spark, d):
    return curves.smoothed(made_curve(spark), 9).select("epoch", "smooth")


@query("chosen_epochs", f"WITH {_CURVE}, {_SMOOTH} SELECT 'plateau' AS rule, MIN(epoch)::INT AS epoch FROM smo WHERE smooth >= (SELECT MAX(smooth) FROM smo) - 0.01 UNION ALL SELECT 'max', MIN(epoch)::INT FROM smo WHERE smooth = (SELECT MAX(smooth) FROM smo)")
def chosen_epochs(spark, d):
    smooth = curves.smoothed(made_curve(spark), 9).withColumn("rule", F.explode(F.array(F.lit("plateau"), F.lit("max"))))
    out = [curves.chosen_epoch(smooth.where(F.col("rule") == r), 0.01, r, ("rule",)) for r in ("plateau", "max")]
    return out[0].unionByName(out[1])


_SHARES = "sh AS (SELECT s::INT AS series, (e + 1)::INT AS epoch, CASE WHEN s = 3 THEN 0.0 ELSE round(abs(sin((e + 1) * (s + 1) * 0.7)) * (e + 1) / 20.0, 6) END AS share FROM range(4) a(s), range(20) b(e))"


@query("settled_epoch", f"WITH {_SHARES}, l AS (SELECT series, arg_max(share, epoch) AS last FROM sh GROUP BY series) SELECT series, CASE WHEN ANY_VALUE(last) > 0 THEN COALESCE(MAX(epoch) FILTER (share < last / 2) + 1, 1) END::INT AS settled FROM sh JOIN l USING (series) GROUP BY series")
def settled_epoch(spark, d):
    s, e = F.col("s"), F.col("id") + 1
    shares = spark.range(20).withColumn("s", F.explode(F.array(*map(F.lit, range(4)))))
    value = F.when(s == 3, 0.0).otherwise(F.round(F.abs(F.sin(e * (s + 1) * 0.7)) * e / 20.0, 6))
    return curves.settled_epoch(shares.select(s.alias("series"), e.cast("int").alias("epoch"), value.alias("share")), ("series",))


_OOF = _oof_sql(OOF_TERMS)


def oof_long(spark, d):
    """doc_id, label, model, seed, pred of two models: the full one for every seed, the small one for one."""
    both = oof_models(spark, d, (OOF_TERMS, SMALL)).where("model = 0 or seed = 0")
    return both.select("doc_id", "label", F.when(F.col("model") == 0, "full").otherwise("small").alias("model"), "seed", "pred")


_LONG = f"WITH lg AS (SELECT doc_id, label, 'full' AS model, seed, pred FROM ({_OOF} SELECT * FROM oof) UNION ALL SELECT doc_id, label, 'small', seed, pred FROM ({_oof_sql(SMALL)} SELECT * FROM oof) WHERE seed = 0)"


@query("model_views", f"{_LONG} SELECT model, label, pred, count(*) AS n FROM lg GROUP BY ALL")
def model_views(spark, d):
    return errors.model_views(oof_long(spark, d))


@query("confusable_pairs", f"""{_LONG}, s AS (SELECT model, count(DISTINCT seed) AS k FROM lg GROUP BY model),
w AS (SELECT model, least(label, pred) AS a, greatest(label, pred) AS b, label FROM lg WHERE label <> pred)
SELECT w.model, a, b, round(count(*) FILTER (label = a) / ANY_VALUE(k), 6) AS a_as_b, round(count(*) FILTER (label = b) / ANY_VALUE(k), 6) AS b_as_a, round(count(*) / ANY_VALUE(k), 6) AS total FROM w JOIN s USING (model) GROUP BY w.model, a, b""")  # fmt: skip
def confusable_pairs(spark, d):
    return errors.confusable_pairs(oof_long(spark, d))


@query("top_confusions", f"{_OOF} SELECT label, pred, count(*) AS n FROM oof WHERE label <> pred GROUP BY ALL ORDER BY n DESC, label DESC, pred DESC LIMIT 5")
def top_confusions(spark, d):
    return metrics.top_confusions(oof(spark, d), 5)


@query("seed_agreement", f"{_OOF}, w AS (SELECT doc_id, count(*) FILTER (label <> pred) AS wrong FROM oof GROUP BY doc_id) SELECT wrong, count(*) AS n FROM w GROUP BY wrong")
def seed_agreement(spark, d):
    return errors.seed_agreement(oof(spark, d))


@query("hard_rows", f"{_OOF}, w AS (SELECT doc_id, count(*) FILTER (label <> pred) AS wrong FROM oof GROUP BY doc_id) SELECT doc_id, CASE WHEN wrong = {SEEDS} THEN 'hard' ELSE 'sometimes' END AS kind FROM w WHERE wrong > 0")
def hard_rows(spark, d):
    return errors.hardness(oof(spark, d))


_MAJ = "mj AS (SELECT doc_id, label, pred FROM (SELECT doc_id, label, pred, count(*) AS n FROM oof GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pred) = 1)"


@query("majority_vote", f"{_OOF}, {_MAJ} SELECT * FROM mj")
def majority_vote(spark, d):
    return errors.majority_vote(oof(spark, d))


_COUNTS = "count(*) FILTER (a <> label AND b = label) AS only_a_wrong, count(*) FILTER (a = label AND b <> label) AS only_b_wrong, count(*) FILTER (a <> label AND b <> label) AS both_wrong"


@query("mcnemar", f"""{_LONG}, bs AS (SELECT doc_id, pred AS b FROM lg WHERE model = 'small'), mv AS (SELECT doc_id, label, pred FROM (SELECT doc_id, label, pred, count(*) AS n FROM lg WHERE model = 'full' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pred) = 1),
pp AS (SELECT seed::VARCHAR AS seed, doc_id, label, pred AS a FROM lg WHERE model = 'full' UNION ALL SELECT 'majority', doc_id, label, pred FROM mv), c AS (SELECT seed, {_COUNTS} FROM pp JOIN bs USING (doc_id) GROUP BY seed),
n AS (SELECT *, only_a_wrong + only_b_wrong AS n, least(only_a_wrong, only_b_wrong) AS k FROM c)
SELECT seed, only_a_wrong, only_b_wrong, both_wrong, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END + 1e-9, 6) AS p FROM n""")  # fmt: skip
def mcnemar(spark, d):
    rows_ = oof_long(spark, d)
    return errors.agreement(rows_.where("model = 'full'"), rows_.where("model = 'small'"))


_FLOW = "k AS (SELECT label AS class FROM lg UNION SELECT pred FROM lg), g AS (SELECT m.model, k.class, count(w.doc_id) AS n FROM (SELECT DISTINCT model FROM lg) m CROSS JOIN k LEFT JOIN lg w ON w.model = m.model AND w.pred = k.class AND w.label <> w.pred GROUP BY m.model, k.class), fl AS (SELECT model, class, n, round(CASE WHEN SUM(n) OVER (PARTITION BY model) > 0 THEN n / SUM(n) OVER (PARTITION BY model) ELSE 0.0 END, 6) AS share FROM g)"


@query("inflow", f"{_LONG}, {_FLOW} SELECT model, class, n, share FROM fl")
def inflow(spark, d):
    return errors.inflow(oof_long(spark, d)).select("model", "class", "n", "share")


@query("top_receiver", f"{_LONG}, {_FLOW} SELECT model, class FROM fl QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, class) = 1")
def top_receiver(spark, d):
    return errors.top_receiver(errors.inflow(oof_long(spark, d)))


@query("sink_share", f"""{_LONG}, {_FLOW}, s AS (SELECT class AS sink FROM fl WHERE model = 'full' ORDER BY n DESC, class LIMIT 1)
SELECT sink, MAX(share) FILTER (model = 'full') AS share, round(1 / ((SELECT count(DISTINCT class) FROM fl) - 1), 6) AS chance,
 MAX(share) FILTER (model = 'full') > round(1 / ((SELECT count(DISTINCT class) FROM fl) - 1), 6) AND MAX(share) FILTER (model = 'full') > MAX(share) FILTER (model <> 'full') AS supported FROM fl JOIN s ON fl.class = s.sink GROUP BY sink""")  # fmt: skip
def sink_share(spark, d):
    return errors.sink_share(errors.inflow(oof_long(spark, d)), "full")


@query("foreign_votes", f"""{_BASE}, z AS (SELECT label, count(*) AS own, (SUM(count(*)) OVER ())::BIGINT AS n FROM rw GROUP BY label),
v AS (SELECT class, SUM(greatest(weight, 0)) AS f, SUM(greatest(-weight, 0)) AS g FROM fired WHERE label <> class GROUP BY class)
SELECT label AS class, round(COALESCE(f, 0) / (n - own), 6) AS "for", round(COALESCE(g, 0) / (n - own), 6) AS against, round((COALESCE(f, 0) - COALESCE(g, 0)) / (n - own), 6) AS sum FROM z LEFT JOIN v ON v.class = z.label""")  # fmt: skip
def foreign_votes(spark, d):
    r = rows(spark, d)
    return errors.foreign_votes(clauses.fired(r, model(spark)).select("doc_id", "label", "class", "weight"), r)


@query("win_margins", f"{_BASE} SELECT p.doc_id, p.pred = 'en' AS into_sink, w.votes - h.votes AS margin FROM prd p JOIN sums w ON w.doc_id = p.doc_id AND w.class = p.pred JOIN sums h ON h.doc_id = p.doc_id AND h.class = p.label WHERE p.label <> p.pred")
def win_margins(spark, d):
    r = rows(spark, d)
    sums = clauses.class_sums(r, model(spark))
    preds = clauses.predict(sums).join(r.select("doc_id", "label"), "doc_id")
    return errors.narrow_wins(sums, preds, F.lit("en"))


_RANK = "rk AS (SELECT v, first, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS c FROM vals)"


@query("rank_sum_u", f"""WITH vals AS (SELECT n_chars AS v, lang = 'de' AS first FROM documents), {_RANK}
SELECT count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, SUM(r) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2 AS u FROM rk""")  # fmt: skip
def rank_sum_u(spark, d):
    from .registry import table

    out = metrics.rank_sum(table(spark, d, "documents").select("n_chars", "lang"), "n_chars", F.col("lang") == "de")
    return out.select("n1", "n2", "u")


@query("rank_sum_p")
def rank_sum_p(spark, d):
    """With z and p, which need the normal distribution."""
    from .registry import table

    return metrics.rank_sum(table(spark, d, "documents").select("n_chars", "lang"), "n_chars", F.col("lang") == "de")


@query("spearman_rho", """WITH v AS (SELECT n_chars AS a, len(string_split(text, chr(10))) AS b FROM documents),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v) SELECT round(corr(ra, rb), 6) AS rho FROM r""")  # fmt: skip
def spearman_rho(spark, d):
    from .registry import table

    values = table(spark, d, "documents").select(F.col("n_chars").alias("a"), F.size(F.split("text", "\n")).alias("b"))
    return metrics.spearman(values, "a", "b")


@query("size_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, count(*) AS n FROM documents GROUP BY lang")
def size_percentiles(spark, d):
    from .registry import table

    return metrics.percentiles(table(spark, d, "documents"), "n_chars", ("lang",))


@query("run_consistency", f"{_OOF}, k AS (SELECT seed, fold, count(*) FILTER (label = pred) / count(*) AS acc FROM oof GROUP BY ALL) SELECT count(*) AS compared, 0.0::DOUBLE AS max_abs_diff, true AS matches FROM k")
def run_consistency(spark, d):
    """The same run twice: fold accuracies agree."""
    acc = oof(spark, d).groupBy("seed", "fold").agg((F.count_if(F.col("label") == F.col("pred")) / F.count("*")).alias("acc"))
    return metrics.consistency(acc, acc.select("*"), ["seed", "fold"], "acc")


@query("study_grid", "SELECT DISTINCT s AS selection, n::INT AS n_features, w AS words FROM (VALUES ('frequency'), ('chi2'), ('class_balanced')) a(s), (VALUES (100), (250), (100)) b(n), (VALUES (true), (false)) c(w)")
def study_grid(spark, d):
    from ..operators.studies import grid

    return grid(spark, {"selection": ["frequency", "chi2", "class_balanced"], "n_features": [100, 250, 100], "words": [True, False]})
