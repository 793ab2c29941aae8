"""Narrow networks as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.catalog.encoding import small_network
from flowgauge.operators.mlp import Layer, forward, mlp_columns


def test_narrow_networks_are_written_out(spark):
    stack = small_network().parts["encoder"]
    dim = stack[0].weight.shape[0]
    points = np.random.default_rng(1).normal(size=(50, dim))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(50, None), (51, [0.5] * (dim - 1)), (52, [0.5] * (dim + 1))]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    found = df.select("i", mlp_columns(F.col("x"), stack).alias("z"))
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString().lower().replace("zipwith", "zip_with")
    got = [r.z for r in found.orderBy("i").collect()]
    assert np.allclose(np.array(got[:50]), forward(points, stack)[-1], atol=1e-12)
    # what vectors without a value give is what functions of whole arrays give
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("flowgauge.operators.mlp.WRITTEN_OUT", 0)
        arrays = [r.z for r in df.select("i", mlp_columns(F.col("x"), stack).alias("z")).orderBy("i").collect()]
    assert got == arrays


def test_wide_networks_stay_functions_of_arrays(spark):
    layer = Layer(np.ones((40, 2)), np.zeros(2), "tanh")
    df = spark.createDataFrame([([0.01] * 40,)], "x array<double>")
    found = df.select(mlp_columns(F.col("x"), [layer]).alias("z"))
    assert np.allclose(found.first().z, np.tanh(0.4))
