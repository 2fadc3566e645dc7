"""Registered queries against their SQL counterparts on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from statewave.plans.oracles import ORACLES
from statewave.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def tools():
    spec = importlib.util.spec_from_file_location("check_queries", ROOT / "tools" / "check_queries.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    con = duckdb.connect()
    for name in module.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return module, con


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tools, name):
    module, con = tools
    result = module.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok") and "types" not in result, result


def test_candidates_make_no_record_of_a_value(spark):
    plan = QUERIES["split_candidates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Expand" not in plan
