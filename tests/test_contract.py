import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract  # noqa: E402
from verify import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
# The rest runs the same way at a larger scale through tools/verify.py.
QUICK = [
    "change_type_counts",
    "client_tenure",
    "training_table",
    "cohort_report",
    "report_usage",
    "admin_tenure",
    "common_assessments",
    "tenant_gather",
    "roc_points",
    "threshold_sweep",
    "enn_undersample",
]


@pytest.fixture(scope="module")
def oracle():
    base = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        base.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["hs_change_type", "change_type_order", "account_months"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, oracle, name):
    df = contract.queries()[name](spark, SF)
    cursor = oracle.execute(contract.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
