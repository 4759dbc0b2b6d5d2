"""Queries on features, models and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, baselines, dedup, features, metrics, naive_bayes, splits, tsetlin
from ..streaming.scoring import present
from . import sql
from .curation import _SPLIT, docs
from .registry import query, table

M, MIN_DF = 100, 2
SETTINGS = features.Settings(n_features=M, min_df=MIN_DF)

_NG = f"WITH {sql.SNIP}, {sql.ngrams('snip')}"


def long_terms(spark, d):
    return features.terms(docs(spark, d))


@query("ngram_doc_freq", f"{_NG} SELECT term, language, count(*) AS df FROM ng GROUP BY ALL HAVING count(*) >= 5")
def ngram_doc_freq(spark, d):
    return features.document_frequency(long_terms(spark, d).drop("doc_id", "repo"), 5, ("language",)).select("term", "language", "df")


@query("word_doc_freq", "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM documents) SELECT word, count(*) AS df FROM w GROUP BY word HAVING count(*) >= 3")
def word_doc_freq(spark, d):
    words = docs(spark, d).select(F.explode(T.identifiers(F.col("text"))).alias("term"))
    return features.document_frequency(words, 3).withColumnRenamed("term", "word")


@query("vocab_frequency", f"{_NG}, v AS (SELECT term, count(*) AS df FROM ng GROUP BY term HAVING count(*) >= 2) SELECT (row_number() OVER (ORDER BY df DESC, term) - 1)::INT AS rank, term, df::DOUBLE AS score FROM v QUALIFY rank < {M}")
def vocab_frequency(spark, d):
    return features.rank_frequency(features.class_counts(long_terms(spark, d)), docs(spark, d), M, MIN_DF)


@query("vocab_chi2", f"""{_NG}, {sql.class_scores('ng', 'snip', MIN_DF)}, s AS (SELECT term, round(SUM(df_c * df_c * n / n_c / df) - ANY_VALUE(df), 6) AS score FROM cell GROUP BY term)
SELECT (row_number() OVER (ORDER BY score DESC, term) - 1)::INT AS rank, term, score FROM s QUALIFY rank < {M}""")  # fmt: skip
def vocab_chi2(spark, d):
    return features.rank_chi2(features.class_counts(long_terms(spark, d)), docs(spark, d), M, MIN_DF)


@query("vocab_class_balanced", f"{_NG}, {sql.class_scores('ng', 'snip', MIN_DF)}, {sql.balanced(M)} SELECT feature_id AS rank, term, score FROM vocab")
def vocab_class_balanced(spark, d):
    return features.rank_class_balanced(features.class_counts(long_terms(spark, d)), docs(spark, d), M, MIN_DF)


@query("vocab_delimiters", f"""{_NG}, base AS (SELECT t.i::INT AS feature_id, t.term FROM (VALUES {", ".join(f"({i}, {sql.q(t)})" for i, t in enumerate(features.DELIMITERS))}) t(i, term)),
v AS (SELECT term, count(*) AS df FROM ng WHERE term NOT IN (SELECT term FROM base) GROUP BY term HAVING count(*) >= 2),
r AS (SELECT (row_number() OVER (ORDER BY df DESC, term) + 17)::INT AS feature_id, term FROM v QUALIFY feature_id < 40) SELECT * FROM base UNION ALL SELECT * FROM r""")  # fmt: skip
def vocab_delimiters(spark, d):
    return features.vocabulary(docs(spark, d), features.Settings(n_features=40, delimiters=True, selection="frequency"))


_TRAIN = f"{_SPLIT}, train AS (SELECT snip.*, s.fold FROM snip JOIN split s USING (repo) WHERE s.split = 'train'), test AS (SELECT snip.* FROM snip JOIN split s USING (repo) WHERE s.split = 'test')"
_VOCAB = f"{_TRAIN}, {sql.ngrams('train', 'ngt')}, {sql.class_scores('ngt', 'train', MIN_DF)}, {sql.balanced(M)}"
_FOUND = "ft AS (SELECT g.doc_id, g.language, v.feature_id FROM ngt g JOIN vocab v USING (term))"
_TEST = f"{sql.ngrams('test', 'nge')}, fe AS (SELECT g.doc_id, g.language, v.feature_id FROM nge g JOIN vocab v USING (term))"


def split_rows(spark, d):
    """(train with folds, test), each with doc_id, text, language, repo."""
    rows = docs(spark, d)
    assigned = splits.assign(rows, splits.stable_split(rows))
    return assigned.where("split = 'train'").drop("split"), assigned.where("split = 'test'").drop("split", "fold")


def binarizer(train, counts=None):
    """The vocabulary is a setting's worth of terms, so it is fitted once and kept on the driver."""
    return features.Binarizer(SETTINGS).fit(train.select("doc_id", "text", "language", "repo"), counts)


def nb_model(spark, d):
    """The training texts are exploded once: vocabulary and model come from the same class counts."""
    train, test = split_rows(spark, d)
    counts = features.class_counts(features.terms(train.select("doc_id", "text", "language"))).persist()
    b = binarizer(train, counts)
    vocab = b.vocabulary(spark)
    df = counts.join(F.broadcast(vocab), "term").select("language", "feature_id", F.col("df_c").alias("df"))
    return b, vocab, naive_bayes.fit_counts(df, train, vocab), train, test


def nb_predictions(spark, d):
    _, vocab, model, _, test = nb_model(spark, d)
    found = features.presence(test.select("doc_id", "text"), vocab)
    return naive_bayes.predict(naive_bayes.scores(model, found, test))


@query("feature_presence", f"WITH {_VOCAB[5:]}, {_TEST} SELECT doc_id, feature_id FROM fe")
def feature_presence(spark, d):
    train, test = split_rows(spark, d)
    return features.presence(test.select("doc_id", "text"), binarizer(train).vocabulary(spark)).select("doc_id", "feature_id")


@query("features_present", f"WITH {_VOCAB[5:]}, {_TEST} SELECT test.doc_id, count(feature_id)::INT AS n FROM test LEFT JOIN fe USING (doc_id) GROUP BY test.doc_id")
def features_present(spark, d):
    train, test = split_rows(spark, d)
    return binarizer(train).transform(test).select("doc_id", F.size("features").alias("n"))


@query("literal_counts", f"WITH {_VOCAB[5:]}, {_TEST}, c AS (SELECT test.doc_id, count(feature_id) AS n, COALESCE(SUM(feature_id), 0)::BIGINT AS s FROM test LEFT JOIN fe USING (doc_id) GROUP BY test.doc_id) SELECT doc_id, {M}::INT AS n, (s + ({M} * ({M} - 1) / 2 - s) + ({M} - n) * {M})::BIGINT AS total FROM c")
def literal_counts(spark, d):
    train, test = split_rows(spark, d)
    lits = binarizer(train).transform(test).select("doc_id", features.literals(F.col("features"), M).alias("l"))
    return lits.select("doc_id", F.size("l").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_NB = f"WITH {_VOCAB[5:]}, {_FOUND}, {sql.naive_bayes('ft', 'train')}"
_PRED = f"{_NB}, {_TEST}, {sql.nb_scores('fe', 'test')}"


@query("nb_train", f"{_NB} SELECT language, feature_id, round(log_p, 6) AS log_p, round(log_q, 6) AS log_q, round(log_prior, 6) AS log_prior FROM nb")
def nb_train(spark, d):
    model = nb_model(spark, d)[2]
    return model.select("language", "feature_id", *(F.round(c, 6).alias(c) for c in ("log_p", "log_q", "log_prior")))


@query("nb_predict", f"{_PRED} SELECT doc_id, label, pred FROM pred")
def nb_predict(spark, d):
    return nb_predictions(spark, d)


@query("confusion", f"{_PRED} SELECT label, pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(nb_predictions(spark, d))


def _per_class(pred: str, by: str = "") -> str:
    b, on = (f"{by}, ", f"AND c.{by} = p.{by}") if by else ("", "")
    return f"""
cls AS (SELECT {b}label AS class FROM {pred} UNION SELECT {b}pred FROM {pred}),
pc AS (SELECT {"c." + by + ", " if by else ""}c.class, count(*) FILTER (p.label = c.class AND p.pred = c.class) AS tp, count(*) FILTER (p.label <> c.class AND p.pred = c.class) AS fp,
       count(*) FILTER (p.label = c.class AND p.pred <> c.class) AS fn FROM cls c JOIN {pred} p ON (p.label = c.class OR p.pred = c.class) {on} GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM pc),
mac AS (SELECT {b}round(avg(f1) FILTER (tp + fn > 0), 6) AS macro_f1, round(SUM(tp) / SUM(tp + fn), 6) AS accuracy, SUM(tp + fn)::BIGINT AS n FROM f1 {"GROUP BY " + by if by else ""})"""


@query("per_class_f1", f"{_PRED}, {_per_class('pred')} SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(f1, 6) AS f1 FROM f1")
def per_class_f1(spark, d):
    return metrics.per_class(nb_predictions(spark, d)).withColumn("f1", F.round("f1", 6))


@query("macro_f1", f"{_PRED}, {_per_class('pred')} SELECT macro_f1, accuracy, n FROM mac")
def macro_f1(spark, d):
    return metrics.macro_f1(nb_predictions(spark, d))


#: A small fixed vocabulary, so that models over many folds and salts are cheap.
TERMS = ("th", "he", "ch", "ei", "le", "ou", "de", "la", "qu", "en")
SMALL = 5  # the second model sees the first terms only
_SMALL_F = "sm AS (SELECT doc_id, language, repo, unnest(list_filter([" + ", ".join(f"CASE WHEN contains(text, {sql.q(t)}) THEN {i} END" for i, t in enumerate(TERMS)) + "], lambda x: x IS NOT NULL)) AS feature_id FROM snip)"
SEEDS = 3
_SEEDS = ", ".join(f"({k}, {sql.q(f'{splits.SALT}:seed:{k}')})" for k in range(SEEDS))
_FOLDS = f"fold0 AS (SELECT DISTINCT k AS seed, repo, floor({sql.unit('fold', 'repo', 'salt')} * 5)::INT AS fold FROM snip, (VALUES {_SEEDS}) t(k, salt))"


#: Terms of the vocabulary that out-of-fold models choose from the rows outside each fold; the second model takes the first few.
OOF_TERMS = 40


def _oof_sql(n_terms: int) -> str:
    """Out-of-fold predictions of naive Bayes for each seed: `pred` (key, doc_id, label, pred), key = seed * 5 + fold."""
    return f"""WITH {sql.SNIP}, {sql.ngrams('snip')}, {_FOLDS},
asg AS (SELECT snip.*, seed, seed * 5 + fold AS key, fold FROM snip JOIN fold0 USING (repo)),
fitr AS (SELECT a.doc_id, a.language, a.seed * 5 + o.k AS key FROM asg a, range(5) o(k) WHERE a.fold <> o.k),
{sql.fold_vocabulary(n_terms, MIN_DF, 5)},
fitf AS (SELECT r.key, r.language, r.doc_id, v.feature_id FROM ng g JOIN vocab v USING (term) JOIN fitr r ON r.doc_id = g.doc_id AND r.key = v.key),
tstf AS (SELECT a.key, a.doc_id, v.feature_id FROM ng g JOIN vocab v USING (term) JOIN asg a ON a.doc_id = g.doc_id AND a.key = v.key),
{sql.naive_bayes('fitf', 'fitr', 'key', 'SELECT key AS of, feature_id FROM vocab', 'v.of = s.key')}, {sql.nb_scores('tstf', 'asg', 'key')},
oof AS (SELECT (key // 5)::INT AS seed, (key % 5)::INT AS fold, doc_id, label, pred FROM pred)"""


def seed_folds(rows):
    salts = F.array(*(F.struct(F.lit(k).alias("seed"), F.lit(f"{splits.SALT}:seed:{k}").alias("salt")) for k in range(SEEDS)))
    repos = rows.select("repo").distinct().withColumn("s", F.explode(salts))
    return repos.select("repo", "s.seed", _fold(F.col("s.salt")).alias("fold"))


def _fold(salt):
    return F.floor(splits.unit(salt, "fold", F.col("repo")) * 5).cast("int")


def fold_vocabulary(rows, folds, n_terms=OOF_TERMS, counts=None, sizes=None):
    """seed, fold, feature_id, term: chosen from the rows outside each fold alone. The texts are read once for all.

    counts, sizes: the rows' terms and numbers by repository, if they are at hand.
    """
    by = ("seed", "fold")
    counts = dedup._checkpointed(features.repo_counts(rows)) if counts is None else counts
    own = counts.join(folds, "repo").groupBy(*by, "term", "language").agg(F.sum("n").alias("df_c"))
    fit_rows, _ = naive_bayes.held_out((repo_sizes(rows) if sizes is None else sizes).join(folds, "repo"), 5)
    ranked = features.rank_class_balanced(features.held_out_counts(own, 5, ("seed",)), fit_rows, n_terms, MIN_DF, by)
    return ranked.select(*by, F.col("rank").alias("feature_id"), "term")


def repo_sizes(rows):
    return rows.groupBy("repo", "language").agg(F.count("*").alias("n_rows"))


def _oof_scores(spark, d, sizes):
    """(doc_id, label, folds, scores; the classes) for vocabularies of several sizes.

    The texts are read twice: for the counts by repository, from which all vocabularies and models
    come, and for the scores. A smaller vocabulary is the beginning of a larger one.
    """
    rows = docs(spark, d).select("doc_id", "language", "repo", "text")
    sizes_ = dedup._checkpointed(repo_sizes(rows))
    counts, folds, by = dedup._checkpointed(features.repo_counts(rows)), dedup._checkpointed(seed_folds(sizes_)), ("seed", "fold")
    # folds x terms rows, all settings: chosen once and kept on the driver
    vocab = fold_vocabulary(rows, folds, max(sizes), counts, sizes_).collect()
    table_ = spark.createDataFrame(vocab, "seed int, fold int, feature_id int, term string")
    found = counts.join(F.broadcast(table_.select("term").distinct()), "term").join(folds, "repo").groupBy(*by, "term", "language").agg(F.sum("n").alias("df_c"))
    df = features.held_out_counts(found, 5, ("seed",)).join(F.broadcast(table_), [*by, "term"])
    fit_rows, _ = naive_bayes.held_out(sizes_.join(folds, "repo"), 5)
    model = naive_bayes.fit_counts(df.select(*by, "language", "feature_id", F.col("df_c").alias("df")), fit_rows, table_, by).collect()
    salts = [F.lit(f"{splits.SALT}:seed:{k}") for k in range(SEEDS)]
    asked = rows.select("doc_id", F.col("language").alias("label"), F.array(*map(_fold, salts)).alias("folds"), "text")
    return naive_bayes.out_of_fold(asked, model, vocab, sizes, 5, SEEDS)


def _oof_parts(n_sizes, n_classes, column):
    """One struct for each size and seed, with its share of a column of scores, or its prediction."""
    part = lambda k: F.slice(column, k * n_classes + 1, n_classes) if n_classes else F.get(column, F.lit(k))
    return F.array(*(F.struct(F.lit(k // SEEDS).alias("model"), F.lit(k % SEEDS).alias("seed"), F.get("folds", F.lit(k % SEEDS)).alias("fold"), part(k).alias("x")) for k in range(n_sizes * SEEDS)))


def oof_models(spark, d, sizes):
    """model (place in sizes), seed, fold, doc_id, label, pred of naive Bayes on vocabularies of these sizes, all from one look at the texts."""
    wide, classes = _oof_scores(spark, d, sizes)
    names = F.array(*map(F.lit, classes))
    # the best class, the first by name if tied
    cell = lambda s, c: F.when(s.isNotNull(), F.struct((-F.round(s, 6)).alias("s"), c.alias("class")))
    best = lambda p: F.array_min(F.filter(F.zip_with(p["x"], names, cell), lambda x: x.isNotNull()))["class"]
    preds = dedup._checkpointed(wide.select("doc_id", "label", "folds", F.transform(_oof_parts(len(sizes), len(classes), "scores"), best).alias("preds")))
    long = preds.select("doc_id", "label", F.explode(_oof_parts(len(sizes), 0, "preds")).alias("p")).where("p.x is not null")
    return long.select("p.model", "p.seed", "p.fold", "doc_id", "label", F.col("p.x").alias("pred"))


def oof(spark, d, n_terms=OOF_TERMS, scores=False):
    """seed, fold, doc_id, label, pred by naive Bayes on a vocabulary, both fitted on the other folds (or the class scores)."""
    if not scores:
        return oof_models(spark, d, (n_terms,)).drop("model")
    wide, classes = _oof_scores(spark, d, (n_terms,))
    long = wide.select("doc_id", "label", F.explode(_oof_parts(1, len(classes), "scores")).alias("p"))
    cells = F.arrays_zip(F.array(*map(F.lit, classes)).alias("class"), F.col("p.x").alias("score"))
    long = long.select("p.seed", "p.fold", "doc_id", "label", F.explode(cells).alias("c"))
    return long.select("seed", "fold", "doc_id", "label", "c.class", F.round("c.score", 6).alias("score")).where("score is not null")


@query("fold_vocabulary", f"{_oof_sql(OOF_TERMS)} SELECT (key // 5)::INT AS seed, (key % 5)::INT AS fold, feature_id, term FROM vocab")
def fold_vocabularies(spark, d):
    rows = docs(spark, d)
    return fold_vocabulary(rows, seed_folds(rows))


@query("nb_oof_cv", f"{_oof_sql(OOF_TERMS)} SELECT seed, fold, doc_id, label, pred FROM oof")
def nb_oof_cv(spark, d):
    return oof(spark, d)


_FOLD_F1 = f"{_oof_sql(OOF_TERMS)}, kf AS (SELECT seed * 5 + fold AS key, label, pred FROM oof), {_per_class('kf', 'key')}"


@query("cv_fold_f1", f"{_FOLD_F1} SELECT (key // 5)::INT AS seed, (key % 5)::INT AS fold, macro_f1, accuracy, n FROM mac")
def cv_fold_f1(spark, d):
    return metrics.macro_f1(oof(spark, d), ("seed", "fold"))


@query("cv_summary", f"{_FOLD_F1} SELECT (key // 5)::INT AS seed, round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS pstd, min(macro_f1) AS min, max(macro_f1) AS max FROM mac GROUP BY 1")
def cv_summary(spark, d):
    return metrics.spread(cv_fold_f1(spark, d), ("seed",), "macro_f1")


@query("best_by_cv", f"{_FOLD_F1}, s AS (SELECT (key // 5)::INT AS seed, round(avg(macro_f1), 6) AS mean FROM mac GROUP BY 1) SELECT seed, mean FROM s ORDER BY mean DESC, seed LIMIT 1")
def best_by_cv(spark, d):
    return metrics.best(cv_summary(spark, d), "mean", "seed").select("seed", "mean")


@query("canonical_seed", f"{_FOLD_F1}, s AS (SELECT (key // 5)::INT AS seed, round(avg(macro_f1), 6) AS cv_mean FROM mac GROUP BY 1) SELECT seed, cv_mean FROM s QUALIFY row_number() OVER (ORDER BY cv_mean, seed) = (count(*) OVER () - 1) // 2 + 1")
def canonical_seed(spark, d):
    return metrics.canonical_seed(cv_summary(spark, d).select("seed", F.col("mean").alias("cv_mean")))


def two_models(spark, d):
    """model, seed, fold, macro_f1 of the full and the small vocabulary."""
    scored = metrics.macro_f1(oof_models(spark, d, (OOF_TERMS, SMALL)), ("model", "seed", "fold"))
    return scored.withColumn("model", F.when(F.col("model") == 0, "full").otherwise("small"))


def _both_sql(tail: str) -> str:
    """Macro-F1 by key of both models as `fu` and `sl`, from two copies of the same CTEs."""
    full = f"({_FOLD_F1} SELECT key, macro_f1 FROM mac)"
    small = f"({_oof_sql(SMALL)}, kf AS (SELECT seed * 5 + fold AS key, label, pred FROM oof), {_per_class('kf', 'key')} SELECT key, macro_f1 FROM mac)"
    return f"WITH fu AS {full}, sl AS {small}, df AS (SELECT key, sl.macro_f1 - fu.macro_f1 AS delta FROM fu JOIN sl USING (key)) {tail}"


@query("paired_delta", _both_sql("SELECT 'small' AS model, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS pstd FROM df"))
def paired_delta(spark, d):
    scores = two_models(spark, d).withColumn("fold", F.col("seed") * 5 + F.col("fold"))
    return metrics.paired_delta(scores, "full")


def deltas(spark, d):
    m = two_models(spark, d)
    f = m.where("model = 'full'").select("seed", "fold", F.col("macro_f1").alias("f"))
    return m.where("model = 'small'").join(f, ["seed", "fold"]).withColumn("delta", F.col("macro_f1") - F.col("f")).withColumn("model", F.lit("small"))


@query("corrected_t_stat", _both_sql("""SELECT 'small' AS model, round(avg(delta), 6) AS mean, round(sqrt((1 / count(*) + 0.25) * var_samp(delta)), 6) AS se,
 round(avg(delta) / sqrt((1 / count(*) + 0.25) * var_samp(delta)), 5) AS t, count(*) - 1 AS df, count(*) AS n_splits FROM df"""))  # fmt: skip
def corrected_t_stat(spark, d):
    out = metrics.corrected_t(deltas(spark, d), ("model",), "delta", 0.25)
    return out.select("model", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"), "df", "n_splits")


@query("corrected_t_test")
def corrected_t_test(spark, d):
    """With p and the confidence interval, which need the t distribution."""
    return metrics.corrected_t(deltas(spark, d), ("model",), "delta", 0.25)


@query("confident_learning", f"""{_oof_sql(OOF_TERMS)}, one AS (SELECT doc_id, label, class, score FROM scored WHERE key // 5 = 0),
e AS (SELECT *, exp(score - MAX(score) OVER (PARTITION BY doc_id)) AS e FROM one), pr AS (SELECT doc_id, label, class, e / SUM(e) OVER (PARTITION BY doc_id) AS p FROM e),
lm AS (SELECT class, avg(p) AS lim FROM pr WHERE label = class GROUP BY class),
rc AS (SELECT pr.* FROM pr JOIN lm USING (class) WHERE round(p, 9) >= round(lim, 9)),
bs AS (SELECT doc_id, label, class, p FROM rc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, class) = 1)
SELECT b.doc_id, b.label AS given, b.class AS suggested FROM bs b WHERE b.label <> b.class""")  # fmt: skip
def confident_learning(spark, d):
    probs = naive_bayes.probabilities(oof(spark, d, scores=True).where("seed = 0").drop("seed", "fold"))
    return audit.label_issues(audit.confident_learning(probs)).select("doc_id", "given", "suggested")


@query("confident_joint", f"""{_oof_sql(OOF_TERMS)}, one AS (SELECT doc_id, label, class, score FROM scored WHERE key // 5 = 0),
e AS (SELECT *, exp(score - MAX(score) OVER (PARTITION BY doc_id)) AS e FROM one), pr AS (SELECT doc_id, label, class, e / SUM(e) OVER (PARTITION BY doc_id) AS p FROM e),
lm AS (SELECT class, avg(p) AS lim FROM pr WHERE label = class GROUP BY class),
rc AS (SELECT pr.* FROM pr JOIN lm USING (class) WHERE round(p, 9) >= round(lim, 9)),
bs AS (SELECT doc_id, label, class, p FROM rc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, class) = 1)
SELECT label AS given, class AS suggested, count(*) AS n FROM bs GROUP BY ALL""")  # fmt: skip
def confident_joint(spark, d):
    probs = naive_bayes.probabilities(oof(spark, d, scores=True).where("seed = 0").drop("seed", "fold"))
    return audit.joint_counts(audit.confident_learning(probs))


@query("shortcut_probe", f"""WITH {_VOCAB[5:]}, {_FOUND}, {sql.naive_bayes('ft', 'train')},
lo AS (SELECT language AS class, feature_id, round(log_p - avg(log_p) OVER (PARTITION BY feature_id), 6) AS weight FROM nb),
tp AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY weight DESC, feature_id)::INT AS rank FROM lo WHERE weight > 0 QUALIFY rank <= 5),
h AS (SELECT t.class, t.feature_id, f.doc_id, f.language, tr.repo FROM tp t JOIN ft f USING (feature_id) JOIN train tr USING (doc_id)),
c AS (SELECT class, feature_id, count(*) FILTER (language = class) AS snippets, count(DISTINCT repo) FILTER (language = class) AS repos, count(*) FILTER (language <> class) AS other FROM h GROUP BY ALL),
z AS (SELECT language AS class, count(*) AS n_c, (SUM(count(*)) OVER ())::BIGINT AS n FROM train GROUP BY language)
SELECT class, rank, feature_id, snippets, repos, round(other / (n - n_c), 6) AS other_share, repos < 15 AS suspect FROM tp JOIN c USING (class, feature_id) JOIN z USING (class)""")  # fmt: skip
def shortcut_probe(spark, d):
    _, vocab, model, train, _ = nb_model(spark, d)
    mean = F.avg("log_p").over(Window.partitionBy("feature_id"))
    weights = model.select(F.col("language").alias("class"), "feature_id", F.round(F.col("log_p") - mean, 6).alias("weight"))
    found = features.presence(train.select("doc_id", "text", "language", "repo"), vocab)
    return audit.shortcut_probe(weights, found, train, 5, 15)


_ROLE = "CASE doc_id % 4 WHEN 0 THEN 'test' ELSE 'source' END"
_STATS = f"""{sql.SNIP}, ln AS (SELECT doc_id, language, repo, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, {sql.lines()} AS l, text, {_ROLE} AS role FROM snip),
mt AS (SELECT *, {sql.share('l', f"regexp_matches({sql.strip('x')}, {sql.q(T.COMMENT)})")} AS comments, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) ELSE 0 END AS foreign_ FROM ln),
rp AS (SELECT language, repo, count(*) AS n FROM mt GROUP BY ALL), tr AS (SELECT language, repo AS top_repo, n AS top_n, count(*) OVER (PARTITION BY language) AS repos FROM rp QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, repo) = 1),
st AS (SELECT language, count(*) AS snippets, round(median(n_lines), 6) AS median_lines, round(median(n_chars), 6) AS median_chars, round(median(comments), 6) AS median_comments,
       round(avg(foreign_), 6) AS mean_non_ascii, count(*) FILTER (role = 'test') AS tests FROM mt GROUP BY language),
stats AS (SELECT st.*, tr.repos, tr.top_repo, round(tr.top_n / st.snippets, 6) AS top_share FROM st JOIN tr USING (language))"""  # fmt: skip


def stats(spark, d):
    rows = docs(spark, d).withColumn("role", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("source"))
    return audit.language_stats(rows)


@query("language_audit", f"WITH {_STATS} SELECT * FROM stats")
def language_audit(spark, d):
    return stats(spark, d)


@query("audit_flags", f"""WITH {_STATS} SELECT language, unnest(list_filter([CASE WHEN top_share > 0.1 THEN 'one repo dominates' END, CASE WHEN tests / snippets > 0.4 THEN 'mostly test files' END,
 CASE WHEN median_comments > 0.4 THEN 'mostly comments' END, CASE WHEN snippets < 0.6 * (SELECT MAX(snippets) FROM stats) THEN 'class imbalance' END], lambda x: x IS NOT NULL)) AS flag FROM stats""")  # fmt: skip
def audit_flags(spark, d):
    return audit.flags(stats(spark, d))


@query("quality_nb_f1", f"""WITH {sql.SNIP}, {_SMALL_F}, lb AS (SELECT s.doc_id, s.repo, l.quality::VARCHAR AS language FROM snip s JOIN labels l USING (doc_id)),
fitr AS (SELECT * FROM lb WHERE doc_id % 5 <> 0), tst AS (SELECT * FROM lb WHERE doc_id % 5 = 0),
fitf AS (SELECT r.language, r.doc_id, sm.feature_id FROM fitr r JOIN sm USING (doc_id)), tstf AS (SELECT t.doc_id, sm.feature_id FROM tst t JOIN sm USING (doc_id)),
{sql.naive_bayes('fitf', 'fitr', '', f'SELECT range::INT AS feature_id FROM range({len(TERMS)})')}, {sql.nb_scores('tstf', 'tst')} SELECT doc_id, label, pred FROM pred""")  # fmt: skip
def quality_nb_f1(spark, d):
    """Naive Bayes for another label: the quality of a document."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("language"))
    rows = docs(spark, d).select("doc_id", present(F.col("text"), list(TERMS)).alias("features")).join(labels, "doc_id")
    fit_rows, test_rows = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    vocab = spark.range(len(TERMS)).select(F.col("id").cast("int").alias("feature_id"))
    model = naive_bayes.fit(fit_rows.withColumn("feature_id", F.explode("features")), fit_rows, vocab)
    return naive_bayes.predict(naive_bayes.scores(model, test_rows.withColumn("feature_id", F.explode("features")), test_rows))


def labelled_sets(spark, d):
    """doc_id, label, features (of the small vocabulary), split, fold."""
    rows = docs(spark, d)
    assigned = splits.assign(rows, splits.stable_split(rows))
    return assigned.select("doc_id", F.col("language").alias("label"), present(F.col("text"), list(TERMS)).alias("features"), "split", "fold")


@query("tm_train_predict")
def tm_train_predict(spark, d):
    """A Tsetlin machine for each of two seeds, and its predictions on the test split."""
    from ..operators import clauses

    rows = labelled_sets(spark, d)
    models = tsetlin.train(rows.where("split = 'train'"), len(TERMS), {"small": tsetlin.Setting(n_clauses=10, T=8, s=3.0, epochs=3)}, (1, 2), max_rows=1500).persist()
    test, out = rows.where("split = 'test'"), None
    for seed in (1, 2):
        pred = clauses.predict(clauses.class_sums(test, models.where(F.col("seed") == seed).drop("setting", "seed", "fold")))
        pred = pred.join(test.select("doc_id", "label"), "doc_id").withColumn("seed", F.lit(seed))
        out = pred if out is None else out.unionByName(pred)
    return out


@query("tm_learning_curve")
def tm_learning_curve(spark, d):
    rows = labelled_sets(spark, d).where("split = 'train'")
    return tsetlin.curve(rows, len(TERMS), tsetlin.Setting(n_clauses=6, T=6, s=3.0, epochs=3), (1,), max_rows=800)


def _baseline(kind):
    @query(f"baseline_{kind}")
    def run(spark, d):
        rows = labelled_sets(spark, d)
        return baselines.fit_predict(rows.where("split = 'train'"), rows.where("split = 'test'"), len(TERMS), kind)

    return run


for _kind in baselines.KINDS:
    _baseline(_kind)
