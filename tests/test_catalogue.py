from __future__ import annotations

import subprocess
import sys

import pytest
from compare import assert_same
from conftest import ROOT

from textloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_flagship(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert 0 < row.macro_f1 <= 1


def test_the_rest_does_not_import_the_llm_subpackage():
    code = "import sys, textloom.plans.catalogue; sys.exit(any(m.startswith('textloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
