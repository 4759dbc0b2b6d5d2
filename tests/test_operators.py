from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import baselines, clauses, curves, dedup, errors, features, metrics, splits, studies, tsetlin, windows
from textloom.plans.inspection import CLAUSES
from textloom.sources import tables
from textloom.streaming.scoring import score


def body(word, n=60):
    return " ".join(f"{word}{i}" for i in range(n))


def test_dedup_keeps_the_first_and_is_not_transitive(spark):
    base = [f"w{i}" for i in range(200)]
    a, b, c = list(base), list(base), list(base)
    b[0:8] = [f"x{i}" for i in range(8)]
    c[0:16] = [f"x{i}" for i in range(8)] + [f"y{i}" for i in range(8)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, body("z")), (5, body("z").replace(" ", "\n ")), (6, body("q"))]
    got = {r.doc_id: r.status for r in dedup.dedup_status(spark.createDataFrame(rows, "doc_id long, text string"), exhaustive=True).collect()}
    assert got[1] == "kept" and got[2] == "near" and got[5] == "exact" and got[6] == "kept"
    j = lambda x, y: len(set(zip(x, x[1:], x[2:], x[3:], x[4:], strict=False)) & set(zip(y, y[1:], y[2:], y[3:], y[4:], strict=False)))
    similar = j(a, c) / (2 * 196 - j(a, c)) >= 0.8
    assert got[3] == ("near" if similar else "kept")


def greedy(n, pairs):
    kept, gone = set(), set()
    for i in range(n):
        (gone if any((k, i) in pairs for k in kept) else kept).add(i)
    return gone


def test_greedy_rounds_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    n = 60
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.06}
    got = dedup.greedy_removals(spark.createDataFrame(sorted(pairs), "x long, y long"))
    assert {r.y for r in got.collect()} == greedy(n, pairs)
    assert dedup.greedy_removals(spark.createDataFrame([], "x long, y long")).count() == 0


def test_shingle_sets_of_workers_are_those_of_the_column_function(spark):
    from textloom.functions.text import shingles
    from textloom.operators.alike import shingle_set

    texts = ["", " ", "a", "a b c d e", "a_b-c d.e, f\u00a0g \x1fh\u2028i \x85j", "na\u00efve \u65e5\u672c\u8a9e \u0967\u0968 \u00bd \U0001d54f \U0001f600 e\u0301 x y z", "a a a a a a a a", "tab\tnew\r\nline one two three four five"]
    got = {r.text: sorted(r.h) for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", shingles(F.col("text")).alias("h")).collect()}
    assert got == {t: shingle_set(t).tolist() for t in texts}


def test_dedup_within_classes_of_one_least_shingle_equals_the_rule_on_all_pairs(spark):
    from textloom.operators import alike

    rng, texts = random.Random(3), []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = [*enumerate([*texts, None, "", " ", texts[0] + " "]), (10**6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = dedup.exact_status(df)
    sets = marked.where("first").select("doc_id", dedup.shingles(F.col("text")).alias("shingles"))
    pairs = {(r.x, r.y) for r in dedup.verified_pairs(dedup.candidate_pairs(dedup.band_keys(sets)), sets, 0.8).collect()}
    gone = {r.y for r in dedup.greedy_removals(spark.createDataFrame(sorted(pairs), "x long, y long")).collect()}
    expected = {r.doc_id: "exact" if not r.first else "near" if r.doc_id in gone else "kept" for r in marked.collect()}
    assert len(gone) > 30 and len(pairs) > 3 * len(gone)
    assert {r.doc_id: r.status for r in dedup.dedup_status(df).collect()} == expected
    held = alike.Kept()
    held.add([alike.shingle_set(t) for t in texts[:50]])
    assert all((i, i) in held.candidates(held.sets, 0.8) for i in range(50))


def test_dedup_makes_no_table_of_pairs(spark, monkeypatch):
    """A class of n texts alike used to give n * n / 2 pairs, and every shingle was written several times."""
    monkeypatch.delattr(dedup, "candidate_pairs")
    rows = [(i, body("z", 200) + f" end{i}") for i in range(400)]
    got = [r.status for r in dedup.dedup_status(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == "kept" and got.count("near") > 390  # a last shingle may be the least of all


def test_dedup_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        dedup.dedup_status(spark.createDataFrame([], "doc_id long, text string"), 0)


def grid(spark, repos, per=3, languages=("a", "b")):
    rows = [(i, g, f"{g}{r}") for g in languages for r in range(repos) for i in range(per)]
    return spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(rows)], "doc_id long, language string, repo string")


@pytest.mark.parametrize("repos, test", [(1, 0), (2, 1), (8, 2), (10, 2), (13, 3)])
def test_split_sizes(spark, repos, test):
    split = splits.stable_split(grid(spark, repos))
    counts = {(r.language, r.split): r.n for r in split.groupBy("language", "split").agg(F.count("*").alias("n")).collect()}
    assert counts.get(("a", "test"), 0) == test and counts[("a", "train")] == repos - test
    folds = sorted(r.fold for r in split.where("split = 'train' and language = 'a'").collect())
    assert folds == sorted(i * 5 // (repos - test) for i in range(repos - test))


def test_split_does_not_leak_and_survives_a_new_language(spark):
    rows = grid(spark, 10)
    split = splits.stable_split(rows)
    assigned = splits.assign(rows, split)
    assert splits.shared_repos(assigned.where("split = 'train'"), assigned.where("split = 'test'")).count() == 0
    assert assigned.count() == rows.count()
    more = splits.stable_split(grid(spark, 10, languages=("a", "b", "c")))
    assert set(map(tuple, split.collect())) <= set(map(tuple, more.collect()))


def test_split_arguments_are_checked(spark):
    for bad in ({"test_size": 0.5}, {"n_folds": 1}):
        with pytest.raises(ValueError):
            splits.stable_split(grid(spark, 2), **bad)


def test_vocabulary_selections(spark):
    rows = [(0, "xaqq", "x"), (1, "xaqq", "x"), (2, "qqzz", "x"), (3, "ybqq", "y"), (4, "ybqq", "y"), (5, "qqzz", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string")
    pick = lambda how, n: [r.term for r in features.vocabulary(docs, features.Settings(n, (2,), selection=how, min_df=1)).orderBy("feature_id").collect()]
    assert pick("frequency", 1) == ["qq"]
    for how in ("chi2", "class_balanced"):
        assert {"xa", "yb"} <= set(pick(how, 4)) and "qq" not in pick(how, 4)
    assert [r.term for r in features.vocabulary(docs, features.Settings(20, (2,), True, "frequency", 1)).orderBy("feature_id").limit(18).collect()] == list(features.DELIMITERS)
    with pytest.raises(ValueError):
        features.vocabulary(docs, features.Settings(selection="best"))


def round_robin(cells, budget):
    orders = {c: sorted((t for t in cells), key=lambda t: (-cells[t][c], t)) for c in (0, 1, 2)}
    out = []
    for turn in range(len(cells)):
        for c in (0, 1, 2):
            if len(out) == budget:
                return out
            if orders[c][turn] not in out:
                out.append(orders[c][turn])
    return out


def test_class_balanced_equals_the_round_robin(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))), rng.choice("xyz")) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, language string")
    got = [r.term for r in features.rank_class_balanced(features.class_counts(features.terms(rows, (2,))), rows, 12).orderBy("rank").collect()]
    has = lambda t, c: sum(t in text for _, text, g in docs if g == c)
    sizes = {c: sum(g == c for *_, g in docs) for c in "xyz"}
    terms = {text[i : i + 2] for _, text, _ in docs for i in range(len(text) - 1)}
    cells = {t: [round(has(t, c) / sizes[c] - sum(has(t, o) for o in "xyz" if o != c) / (40 - sizes[c]), 9) for c in "xyz"] for t in terms}
    assert got == round_robin(cells, 12)


def test_binarizer_equals_the_definition_and_round_trips(spark):
    docs = spark.createDataFrame([(0, "ab; ::", "x"), (1, "", "y"), (2, "b", "y"), (3, "a😀b\t", "x")], "doc_id long, text string, language string")
    b = features.Binarizer(features.Settings(30, (2, 3), True, "frequency", 1)).fit(docs)
    again = features.Binarizer.from_dict(b.to_dict())
    for r, text in zip(again.transform(docs).orderBy("doc_id").collect(), ["ab; ::", "", "b", "a😀b\t"], strict=True):
        assert r.features == [i for i, t in enumerate(b.terms) if t in text]


def fires(features_, pos, neg):
    return bool(pos or neg) and set(pos) <= set(features_) and not set(neg) & set(features_)


def test_clauses(spark):
    rows = [(0, "de", [2, 3]), (1, "en", []), (2, "fr", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]), (3, "es", [6, 7])]
    df = spark.createDataFrame(rows, "doc_id long, label string, features array<int>")
    model = clauses.model(spark, list(CLAUSES), 10)
    got = {(r.doc_id, r.clause_id) for r in clauses.fired(df, model).collect()}
    assert got == {(d, c[0]) for d, _, f in rows for c in CLAUSES if fires(f, c[4], c[5])}
    assert (1, 9) in got and not any(c == 3 for _, c in got)
    sums = clauses.class_sums(df, model)
    assert {(r.doc_id, r["class"]): r.votes for r in sums.collect()}[(1, "de")] == 0
    assert {r.doc_id: r.pred for r in clauses.predict(sums).collect()}[1] == "es"
    empty = clauses.class_sums(df.limit(0), model)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        clauses.model(spark, [(0, 0, "x", 1, [10], [])], 10)
    with pytest.raises(ValueError):
        clauses.model(spark, [CLAUSES[0], CLAUSES[0]], 10)


def test_tied_votes_go_to_the_first_class(spark):
    model = clauses.model(spark, [(0, 0, "a", 1, [0], []), (1, 1, "b", 1, [0], [])], 1)
    df = spark.createDataFrame([(0, [0]), (1, [])], "doc_id long, features array<int>")
    assert {r.pred for r in clauses.predict(clauses.class_sums(df, model)).collect()} == {"a"}


def test_model_file(spark, tmp_path):
    vocab = spark.createDataFrame([(i, c) for i, c in enumerate("abcdefghij")], "feature_id int, term string")
    clauses.save(clauses.model(spark, list(CLAUSES), 10), vocab, f"{tmp_path}/m.json", {"seed": 1})
    model, terms, meta = clauses.load(spark, f"{tmp_path}/m.json")
    assert sorted(map(tuple, model.collect())) == sorted(CLAUSES) and terms.count() == 10 and meta == {"seed": 1}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        clauses.load(spark, f"{tmp_path}/bad.json")


def test_macro_f1_leaves_out_classes_without_true_rows(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, pred string")
    f1 = {r["class"]: r.f1 for r in metrics.per_class(pred).collect()}
    assert f1 == {"a": pytest.approx(0.5), "b": 0.0, "c": 0.0}
    assert metrics.macro_f1(pred).first().macro_f1 == 0.25


def test_t_distribution():
    assert metrics.t_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert metrics.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert metrics.t_sf(0, 3) == pytest.approx(0.5)


@pytest.mark.parametrize("diffs, t, p", [([0.0, 0.0], 0.0, 1.0), ([0.5, 0.5], float("inf"), 0.0)])
def test_t_without_variance(spark, diffs, t, p):
    row = metrics.corrected_t(spark.createDataFrame([("m", x) for x in diffs], "model string, x double"), ("model",), "x", 0.25).first()
    assert row.t == t and row.p == pytest.approx(p)


def test_mcnemar_is_exact(spark):
    pairs = [("t", "t", "f")] * 2 + [("t", "f", "t")] * 9 + [("t", "f", "f")]
    row = metrics.mcnemar(spark.createDataFrame(pairs, "label string, a string, b string")).first()
    assert (row.only_a_wrong, row.only_b_wrong, row.both_wrong) == (9, 2, 1) and row.p == pytest.approx(0.06543, abs=1e-5)


def test_rank_sum_by_pairs(spark):
    a, b = [1, 2, 2, 5], [2, 3, 9]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    rows = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v int, first boolean")
    assert metrics.rank_sum(rows, "v", F.col("first")).first().u == u


def test_canonical_seed_is_the_lower_median(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.5), (4, 0.9)], "seed int, cv_mean double")
    assert metrics.canonical_seed(rows).first().seed == 3


def moving(values, window):
    out = []
    for i in range(len(values)):
        r = min(window // 2, i, len(values) - 1 - i)
        out.append(sum(values[i - r : i + r + 1]) / (2 * r + 1))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12), st.sampled_from([1, 3, 5]))
def test_smoothing_shrinks_evenly(spark, values, window):
    rows = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "epoch int, value double")
    got = [r.smooth for r in curves.smoothed(rows, window).orderBy("epoch").collect()]
    assert got == pytest.approx(moving(values, window), abs=2e-6)


@pytest.mark.parametrize("shares, want", [([0.1, 0.9, 0.2, 0.6], 4), ([0.5, 0.5], 1), ([0.5, 0.0], None), ([0.9, 0.1, 0.8], 3)])
def test_settled_epoch(spark, shares, want):
    rows = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(shares)], "k int, epoch int, share double")
    assert curves.settled_epoch(rows, ("k",)).first().settled == want


def test_majority_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([(0, "x", "m", s, p) for s, p in enumerate(["b", "a"])], "doc_id long, label string, model string, seed int, pred string")
    assert errors.majority_vote(rows).first().pred == "a"
    assert {r.wrong: r.n for r in errors.seed_agreement(rows).collect()} == {2: 1}


def test_windows_never_start_inside_comments(spark):
    text = "\n".join(["int a;", "/* one", "two", "three */", "int b;"] * 20)
    rows = spark.createDataFrame([(1, text, "java"), (2, None, "java"), (3, "short", None)], "doc_id long, text string, lang string")
    cut = windows.line_windows(rows, language_col="lang", min_lines=4, max_lines=9, min_nonblank=1).collect()
    assert cut and all(not w.text.startswith(("two", "three")) for w in cut)
    ends = [(w.start_line, w.end_line) for w in cut]
    assert all(4 <= b - a + 1 <= 9 for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
    with pytest.raises(ValueError):
        windows.line_windows(rows, min_lines=0)


def test_fixed_windows_leave_out_the_rest(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\nc\nd\ne\n"), (2, "a"), (3, "")], "doc_id long, text string")
    got = [(w.doc_id, w.start_line, w.end_line, w.text) for w in windows.fixed_windows(rows, 2).collect()]
    assert got == [(1, 1, 2, "a\nb\n"), (1, 3, 4, "c\nd\n")]


def test_tsetlin_machine_learns_xor(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b, c = (rng.random() < 0.5 for _ in range(3))
        rows.append((i, "odd" if a != b else "even", [k for k, v in enumerate((a, b, c)) if v], None))
    df = spark.createDataFrame(rows, "doc_id long, label string, features array<int>, fold int")
    made = tsetlin.train(df, 3, {"xor": tsetlin.Setting(n_clauses=10, T=10, s=3.0, epochs=25)}, (1,)).drop("setting", "seed", "fold").persist()
    pred = clauses.predict(clauses.class_sums(df, made)).join(df, "doc_id")
    assert pred.where("pred = label").count() >= 295
    assert made.count() == 20
    with pytest.raises(ValueError):
        tsetlin.Setting(n_clauses=3)
    with pytest.raises(ValueError):
        tsetlin.Machine(tsetlin.Setting(), 3, 2, 0)


@pytest.mark.parametrize("kind", baselines.KINDS)
def test_baselines_learn_a_plain_rule(spark, kind):
    rows = [(i, "a" if i % 2 else "b", [0, 2] if i % 2 else [1, 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label string, features array<int>")
    assert baselines.fit_predict(df, df, 3, kind).where("pred = label").count() == 40


def test_streaming_score_equals_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cheese de la mer"), (2, ""), (3, None), (4, "ein reich"), (5, "que la de")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    terms = list(("th", "he", "ch", "ei", "le", "ou", "de", "la", "qu", "en"))
    stream = score(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), list(CLAUSES), terms)
    q = stream.select("doc_id", "pred").writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.pred for r in spark.table("scored").collect()}
    assert got == {r.doc_id: r.pred for r in score(docs, list(CLAUSES), terms).collect()}
    assert set(got) == {1, 2, 3, 4, 5}


def snippet(text="x", language="python", source="github", repo="o/r", license="mit", start=1, end=2):
    return (text, language, source, repo, "c0", "a.py", license, start, end)


def test_snippets_round_trip_and_reject_labels(spark, tmp_path):
    rows = spark.createDataFrame([snippet(), snippet("y\nü", "go")], tables.SNIPPET)
    assert tables.save_snippets(rows, f"{tmp_path}/deep/a.jsonl") == 2
    (tmp_path / "deep" / "more").mkdir()
    for part in (tmp_path / "deep" / "a.jsonl").glob("part-*.json"):
        (tmp_path / "deep" / "more" / f"{part.stem}.jsonl").write_text(part.read_text() + "\n\n")
    back = tables.load_snippets(spark, f"{tmp_path}/deep/more")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="unknown language go"):
        tables.load_snippets(spark, f"{tmp_path}/deep/more", ("python",)).collect()
    assert tables.load_snippets(spark, f"{tmp_path}/none", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_snippets(spark, f"{tmp_path}/none")


def test_invalid_snippets(spark):
    rows = [snippet(), snippet(" "), snippet(source="x"), snippet(repo=""), snippet(license=None), snippet(start=3), snippet(start=None)]
    got = [r.x for r in spark.createDataFrame(rows, tables.SNIPPET).select(tables.invalid().alias("x")).collect()]
    assert got == [None, "blank text", "unknown source", "no repo", "no license", "bad lines", "bad lines"]


def test_dataset_folder(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "r1"), ("test", "b", "r2")], "split string, language string, repo string")
    tables.save_dataset(rows, f"{tmp_path}/d")
    assert tables.load_dataset(spark, f"{tmp_path}/d").count() == 2
    assert {(r.split, r.repos) for r in tables.manifest(rows).repos.collect()} == {("train", 1), ("test", 1)}
    tables.save_dataset(rows.where("split = 'test'"), f"{tmp_path}/e")
    with pytest.raises(FileNotFoundError):
        tables.load_dataset(spark, f"{tmp_path}/e")


def test_languages_and_merges():
    assert tables.resolve_languages("auto", {"go", "python"}) == ("python", "go")
    assert tables.resolve_languages("go, python", {"go", "python"}) == ("python", "go")
    for bad in ("nope", "rust", ""):
        with pytest.raises(ValueError):
            tables.resolve_languages(bad, {"go"})
    assert tables.merge_plan(["js_ts"], {"javascript", "typescript"})[0] == {"javascript": "js_ts", "typescript": "js_ts"}
    mapping, notes = tables.merge_plan(["js_ts"], {"javascript"})
    assert mapping == {} and len(notes) == 1
    with pytest.raises(ValueError):
        tables.merge_plan(["x"], set())


def test_strict_settings(spark):
    assert studies.strict(tsetlin.Setting, {"s": 5, "epochs": 2}).s == 5
    for bad in ({"nope": 1}, {"epochs": "2"}, {"weighted": 1}, {"epochs": True}):
        with pytest.raises(ValueError):
            studies.strict(tsetlin.Setting, bad)
    assert studies.grid(spark, {"a": [1, 2, 1], "b": ["x"]}).count() == 2
    assert studies.unique_settings([1, 2], [2, 3]) == [1, 2, 3]
    with pytest.raises(ValueError):
        studies.choose({"a": []}, ["b"])
    assert tables.config_hash(tsetlin.Setting()) == tables.config_hash(tsetlin.Setting())


def test_round_robin_counts_a_key_once(spark):
    rows = spark.createDataFrame([("a", "k1", 3), ("a", "k2", 2), ("b", "k1", 9), ("b", "k3", 1)], "band string, key string, n int")
    got = [r.key for r in splits.round_robin(rows, "band", "key", [F.desc("n")], 3).orderBy("position").collect()]
    assert got == ["k1", "k2", "k3"]


def test_learning_curve_scores_whole_folds(spark):
    """The rows fitted are bounded; the F1 is that of a plain evaluation of the same machine on all rows of the fold."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], sorted(set(rng.choice(6, 3).tolist()) | {6 + i % 2 if rng.random() < 0.8 else 7 - i % 2}), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, label string, features array<int>, fold int")
    setting = tsetlin.Setting(n_clauses=6, T=6, s=3.0, epochs=3)
    got = {(r.fold, r.epoch): r for r in tsetlin.curve(df, 8, setting, (1,)).collect()}
    bounded = tsetlin.curve(df, 8, setting, (1,), max_rows=60).collect()
    assert len(bounded) == 9
    for out in range(3):
        fit, test = [r for r in rows if r[3] != out], [r for r in rows if r[3] == out]
        x, y = tsetlin.matrix([r[2] for r in fit], 8), np.array(["ab".index(r[1]) for r in fit])
        machine, z, true = tsetlin.Machine(setting, 8, 2, 1), tsetlin.matrix([r[2] for r in test], 8), np.array(["ab".index(r[1]) for r in test])
        for e in range(1, 4):
            machine.epoch(x, y)
            inc = machine.included()
            votes = np.stack([(((~z).astype(int) @ inc[c].T.astype(int) == 0) & inc[c].any(axis=1)) @ (machine.weight[c] * machine.sign) for c in (0, 1)], axis=1)
            pred = votes.argmax(axis=1)
            f1 = np.mean([2 * ((true == c) & (pred == c)).sum() / max(1, (true == c).sum() + (pred == c).sum()) for c in (0, 1)])
            assert got[out, e].val_f1 == pytest.approx(f1) and got[out, e].included == inc.sum()


def test_counts_by_repository_are_those_of_the_exploded_terms(spark, monkeypatch):
    from textloom.operators import grams

    rng = random.Random(2)
    many = "".join(chr(0x4E00 + i) for i in range(20000))  # more characters than ids have room for
    texts = [None, "", "a", "ab", "aba", "\0\0a", "a\0", "\U0001f600\U0001f601 x\u00e9\u0301", many, "abc" * 50, "\u00e9" * 3]
    texts += ["".join(rng.choice("abc \n\u00e4\u65e5") for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [many[:9000], many[8000:], many[500:600]]
    rows = [(t, rng.choice("pq"), rng.choice(["x", "y", None])) for t in texts]
    df = spark.createDataFrame(rows, "text string, repo string, language string")
    expected = {(r.repo, r.language, r.term): r.n for r in features.terms(df).groupBy("repo", "language", "term").agg(F.count("*").alias("n")).collect()}
    assert {(r.repo, r.language, r.term): r.n for r in features.repo_counts(df).collect()} == expected
    monkeypatch.setattr(grams, "SLICE", 50)
    monkeypatch.setattr(grams, "HELD", 100)
    parts = [r for b in grams.count_batches(df.coalesce(1).toArrow().to_batches(max_chunksize=20)) for r in b.to_pylist()]
    total = {}
    for r in parts:
        key = (r["repo"], r["language"], r["term"])
        total[key] = total.get(key, 0) + r["n"]
    assert total == expected


def test_both_models_come_from_two_looks_at_the_texts(spark, sf_dir, monkeypatch):
    """Each model used to explode the n-grams of all texts three times; the smaller one is a part of the larger one."""
    from textloom.plans import modelling

    monkeypatch.setattr(features, "terms", None)
    looks, counted = [], features.repo_counts
    monkeypatch.setattr(features, "repo_counts", lambda rows: looks.append(1) or counted(rows))
    both = modelling.oof_models(spark, sf_dir, (modelling.OOF_TERMS, modelling.SMALL))
    small = modelling.oof(spark, sf_dir, modelling.SMALL)
    assert len(looks) == 2
    names = ["seed", "fold", "doc_id", "label", "pred"]
    assert sorted(map(tuple, both.where("model = 1").select(names).collect())) == sorted(map(tuple, small.select(names).collect()))


def test_fold_vocabulary_never_sees_held_out_text(spark):
    from textloom.plans.modelling import fold_vocabulary

    rows = [(i, f"repo{i}", "a" if i % 2 else "b", ("common" if i % 2 else "other") + f"mark{i}") for i in range(10)]
    rows += [(100 + i, "repo3", "a", "zqzqzq") for i in range(5)]  # only in one repository
    docs = spark.createDataFrame(rows, "doc_id long, repo string, language string, text string")
    folds = spark.createDataFrame([(f"repo{i}", 0, i % 5) for i in range(10)], "repo string, seed int, fold int")
    found = fold_vocabulary(docs, folds, 200).collect()
    assert {r.fold for r in found if "zq" in r.term} == {0, 1, 2, 4}  # repo3 is held out in fold 3
    for fold in range(5):
        ids = sorted(r.feature_id for r in found if r.fold == fold)
        assert ids == list(range(len(ids)))


def test_held_out_counts_are_those_of_the_other_folds(spark):
    inside = [(0, 0, "t", "a", 2), (0, 1, "t", "a", 3), (0, 1, "u", "a", 4), (1, 0, "t", "a", 5)]
    counts = spark.createDataFrame(inside, "seed int, fold int, term string, language string, df_c long")
    got = {(r.seed, r.fold, r.term): r.df_c for r in features.held_out_counts(counts, 3, ("seed",)).collect()}
    assert got == {(0, 0, "t"): 3, (0, 1, "t"): 2, (0, 2, "t"): 5, (0, 0, "u"): 4, (0, 2, "u"): 4, (1, 1, "t"): 5, (1, 2, "t"): 5}
