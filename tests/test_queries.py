"""A cross-section of registered queries against their SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "load_scan", "weather_scan", "price_features", "threshold_signals", "rules_backtest", "rules_summary",
    "residual_histogram", "duration_curve", "aligned_profits", "profit_endpoints", "strategy_ladder", "schedule_checks",
    "weather_scan_by_heading", "linear_permutation", "context_scaled_by_earlier_days",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    verdict, rows = check.compare(spark, check.database(FOLDER), FOLDER, name)
    assert (verdict, rows > 0) == ("match", True)


def test_every_sql_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_corpus_operators():
    code = "import sys; sys.modules['tidewatt.llm'] = None; import __spark_entry__ as e; assert 'price_features' in e.queries() and not any(n.startswith('op1') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True)
