"""Every registered query with an SQL text, against DuckDB on the middle data set."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import oracle
from loadweave.catalog import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip(f"{SF} is not there")
    return oracle.duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_sql(spark, con, name):
    problems, rows, _ = oracle.compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert not problems and (rows or name in {"only_in_load"})


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_runs(spark, con, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("missing", ["xxhash", "corpus_pipeline", "loadweave.llm"])
def test_entry_without_an_optional_part(missing):
    code = (f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; from loadweave.catalog import QUERIES; "
            "assert QUERIES.keys() <= e.queries().keys(); assert e.oracle_sql().keys() <= e.queries().keys()")
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_seeded_sample_is_repeatable(spark, con):
    a, b = (QUERIES["seeded_sample"](spark, SF).collect() for _ in range(2))
    assert a == b and len(a) == 20
