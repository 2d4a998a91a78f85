"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check)."""

from __future__ import annotations

import os

import pytest

from churnscope.catalog import QUERIES
from conftest import DATA_ROOT

SF = os.path.join(DATA_ROOT, "sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_all_queries_match_oracle(spark):
    from tools.oracle_check import check

    report = check(spark, SF, list(QUERIES))
    bad = {k: v for k, v in report.items() if not v.get("value_match")}
    assert not bad, bad
