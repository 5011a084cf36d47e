"""The bootstrap of all orders against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import plans
from tallyforge.operators import agreement as A

SF = "/root/testdata/sf0.01"


def test_interval_is_that_of_all_orders(spark):
    x = np.array([float(r[0]) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_totalprice").collect()])
    rng = np.random.default_rng(3)
    lo, hi = np.percentile([x[rng.integers(0, len(x), len(x))].mean() for _ in range(2000)], [2.5, 97.5])
    got = plans.QUERIES["m03_bootstrap"](spark, SF).first()
    assert got["valid"] == got["attempted"] == 200
    assert float(got["lo"]) < x.mean() < float(got["hi"])
    assert float(got["hi"]) - float(got["lo"]) == pytest.approx(hi - lo, rel=0.25)


def test_poisson_weights(spark):
    """Replicates of equal values have that mean, and weights are Poisson(1): the means of 0/1 values scatter as they should."""
    d = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("x"))
    got = A.poisson_bootstrap(d, "id", "x", 300, 1)
    m = np.array([r["mean"] for r in got.collect()])
    assert len(m) == 300 and abs(m.mean() - 0.5) < 0.005 and m.std() == pytest.approx(0.5 / np.sqrt(2000), rel=0.15)
    again = {r["replicate"]: r["mean"] for r in A.poisson_bootstrap(d.repartition(7), "id", "x", 300, 1).collect()}
    assert again == {r["replicate"]: r["mean"] for r in got.collect()}
