from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import corpus, splits, tsetlin


def code(name, n=30):
    return "\n".join(f"def {name}_{i}(a):\n    return a + {i}" for i in range(n))


def test_build_keeps_sets_apart_and_drops_repeats(spark):
    page = "<script>\n" + "\n".join(f"var a{i} = {i};" for i in range(20)) + "\n</script>\n<p>x</p>"
    rows = [(i, code(f"f{i}"), "python", f"r{i % 6}", f"a{i}.py", "github") for i in range(18)]
    rows += [(50, code("f3"), "python", "r9", "b.py", "github"), (51, page, "html", "h1", "x.html", "github"), (52, "hello", "sql", "s1", "x.sql", "github")]
    names = "doc_id long, text string, language string, repo string, path string, source string"
    wild = spark.createDataFrame([(1, code("f5"), "python", "w", "", "wild"), (2, code("w2"), "python", "w", "", "wild")], names)
    dataset, reasons = corpus.build(spark.createDataFrame(rows, names), wild, check=True)
    got = dataset.select("doc_id", "split", "repo").collect()
    by_split = {s: {r.doc_id for r in got if r.split == s} for s in ("train", "test", "wild", "hard")}
    assert by_split["wild"] == {2} and by_split["hard"] == {51}
    assert by_split["train"] | by_split["test"] == set(range(18))
    assert {r.reason: r.n for r in reasons.collect()} == {"expected markers missing": 1}
    repos = lambda s: {r.repo for r in got if r.split == s}
    assert not repos("train") & repos("test")
    assert dataset.where("split in ('wild', 'hard') and fold is not null").count() == 0


def test_hard_rows_never_change_the_split(spark):
    rows = [(i, code(f"f{i}"), "python", f"r{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string, repo string")
    wild = df.where("doc_id < 3").withColumn("text", F.concat("text", F.lit("\nend")))
    plain, _ = corpus.build(df)
    more, _ = corpus.build(df, wild)
    pick = lambda x: {(r.doc_id, r.split, r.fold) for r in x.where("split in ('train', 'test')").collect()}
    assert pick(plain) == pick(more)


def test_collect_caps_repositories_and_sets_hard_windows_aside(spark):
    good = "\n".join(f"<div class=a{i}>text</div>" for i in range(40))
    hard = "<script>\n" + "\n".join(f"x{i}();" for i in range(30))
    files = [("r1", f"p{i}.html", "html", good + str(i), "mit") for i in range(9)] + [("r2", "h.html", "html", hard, "mit"), ("r3", "a.html", "html", "short", "mit")]
    got = corpus.collect(spark.createDataFrame(files, "repo string, path string, language string, text string, license string"), 2, min_nonblank=5).collect()
    assert sum(r.repo == "r1" and r.fate == "kept" for r in got) == 2
    assert {r.repo for r in got if r.fate == "hard"} <= {"r2"} and not any(r.repo == "r3" for r in got)
    assert len({(r.repo, r.path) for r in got if r.fate == "kept"}) == sum(r.fate == "kept" for r in got)


def test_samples_and_repeated_splits_are_deterministic(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", f"r{i % 9}") for i in range(60)], "doc_id long, language string, repo string")
    once = {(r.language, r.rank, r.doc_id) for r in splits.sample(rows, 4).collect()}
    assert once == {(r.language, r.rank, r.doc_id) for r in splits.sample(rows.repartition(5), 4).collect()} and len(once) == 8
    split = splits.stable_split(rows, salts=["x", "y"])
    assert split.where("salt = 'x'").count() == split.where("salt = 'y'").count() == 9


def test_out_of_fold_votes_are_those_of_the_model_without_the_fold(spark):
    rows = [(i, "a" if i % 2 else "b", [0, 2] if i % 2 else [1], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label string, features array<int>, fold int")
    got = tsetlin.out_of_fold(df, 3, {"s": tsetlin.Setting(n_clauses=6, T=5, s=3.0, epochs=8)}).collect()
    assert len(got) == 120 and sum(r.pred == r.label for r in got) >= 116
    assert all(r.votes_for >= 0 and r.votes_against >= 0 for r in got)
