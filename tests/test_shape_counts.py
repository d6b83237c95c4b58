"""The likelihood search reads counted values, whatever their number of rows."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import modelling


@pytest.mark.parametrize("family", list(modelling.SHAPES))
def test_repeated_values_are_counted_not_read_again(spark, monkeypatch, family):
    held = []
    written = modelling.staged
    monkeypatch.setattr(modelling, "staged", lambda df, name="stage": held.append((name, written(df, name))) or held[-1][1])
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 40 / 8.0).alias("x"))
    rows = rows.unionByName(spark.range(2).select(F.col("id").alias("k"), F.lit(None).cast("double").alias("x")))
    got = {r["k"]: r for r in modelling.fit_shape(rows, ["k"], "x", family).collect()}
    once = {r["k"]: r for r in modelling.fit_shape(rows.distinct(), ["k"], "x", family).collect()}
    sizes = [df.count() for name, df in held if name == "errors"]
    assert sizes == [40, 40]
    for k in (0, 1):
        assert (got[k]["n"], once[k]["n"]) == (2000, 20)
        assert got[k]["log_likelihood"] == pytest.approx(100 * once[k]["log_likelihood"], rel=1e-6)
        assert got[k]["scale"] == pytest.approx(once[k]["scale"], rel=1e-6)
