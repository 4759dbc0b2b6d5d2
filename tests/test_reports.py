from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import resources
from textloom.sources import reports, tables


def test_sidecars_round_floats_and_are_equal_byte_by_byte(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3), ("b", float("nan"))], "k string, v double")
    for name in ("x", "y"):
        reports.write_json({"rows": df, "n": 2, "inf": float("inf")}, f"{tmp_path}/{name}.json", "textloom.test/1")
    data = json.loads((tmp_path / "x.json").read_text())
    assert data == {"schema": "textloom.test/1", "n": 2, "inf": None, "rows": [{"k": "a", "v": 0.333333}, {"k": "b", "v": None}]}
    assert (tmp_path / "x.json").read_bytes() == (tmp_path / "y.json").read_bytes()


def test_markdown_and_fences(spark):
    df = spark.createDataFrame([("a|b\nc", 0.5), (None, 2.0)], "k string, v double")
    assert reports.markdown(df) == "| k | v |\n| --- | --- |\n| a\\|b c | 0.5 |\n|  | 2 |\n"
    assert reports.fence("x") == "```" and reports.fence("a ```` b ` c") == "`````"


def test_explanation_text(spark):
    df = spark.range(1).select(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(2), F.lit("c"), F.lit(-1)).alias("votes"), F.array(F.struct(F.lit("b").alias("class"), F.lit(7).alias("clause_id"), F.lit(2).alias("weight"), F.lit('has("x")').alias("rule"))).alias("s"))
    text = df.select(reports.explanation(F.lit("a"), F.col("votes"), F.col("s")).alias("x")).first().x
    assert text == 'prediction: a\n\nvotes:\n  a 2\n  b 2\n  c -1\n\nstrongest clauses:\n  +2 #7 b: has("x")'


def test_measuring(spark):
    out = resources.throughput(spark.range(1000), 1000, 2)
    assert out["rows_per_s"] > 0 and out["ms_per_row"] > 0 and out["peak_mb"] > 1


def test_cli(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "macro_f1" in capsys.readouterr().out
    assert cli.main(["run", "nope", "--tables", sf_dir]) == 2
    assert cli.main(["run", "lang_source_counts", "--tables", sf_dir, "--out", f"{tmp_path}/o"]) == 0
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    assert cli.main(["run", "composition", "--tables", sf_dir]) == 0 and "| split |" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run"])


def test_cli_builds_a_dataset(spark, tmp_path, capsys):
    rows = [(f"def f{i}():\n    return {i}\n" * 12, "python", "github", f"r{i % 5}", "c", f"a{i}.py", "mit", 1, 24) for i in range(15)]
    tables.save_snippets(spark.createDataFrame(rows, tables.SNIPPET), f"{tmp_path}/raw")
    (tmp_path / "in").mkdir()
    for k, part in enumerate((tmp_path / "raw").glob("part-*.json")):
        (tmp_path / "in" / f"{k}.jsonl").write_text(part.read_text())
    assert cli.main(["build", "--snippets", f"{tmp_path}/in", "--out", f"{tmp_path}/out"]) == 0
    kept = tables.load_dataset(spark, f"{tmp_path}/out")
    assert kept.where("split = 'test'").count() > 0 and "| split | language | n |" in capsys.readouterr().out
