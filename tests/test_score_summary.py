"""The flagship query reads no quantile that it does not return."""

import __spark_entry__  # noqa: F401  registers the queries

from tidegauge.operators import metrics
from tidegauge.plans.registry import QUERIES


def test_dropped_quantiles_are_not_computed(spark, monkeypatch):
    def unwanted(*args):
        raise AssertionError("quantiles that the query does not return")

    monkeypatch.setattr(metrics, "score_distribution", unwanted)
    rows = QUERIES["series_score_summary"](spark, "/root/testdata/sf0.001")
    assert "test_normal_q99" not in rows.columns and rows.count() > 0
