import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import warp


def image(spark, a):
    rows = [(k, 0, k // a.shape[1], k % a.shape[1], float(v)) for k, v in enumerate(a.ravel())]
    return spark.createDataFrame(rows, "node_id long, z int, y int, x int, value double"), (1, *a.shape)


def test_box_beyond_the_source_is_shifted_and_filled(spark):
    a = np.arange(12.0).reshape(3, 4)
    px, shape = image(spark, a)
    one = [(1, 0, 0), (0, 1, 1), (0, 0, 1)]
    rows = warp.affine_box(px, one, shape, (slice(1, 4), slice(0, 3)), 1, 99.0, (0, 50)).orderBy("target").collect()
    assert [r["target"] for r in rows] == list(range(9))
    assert [r["value"] for r in rows] == [5, 6, 7, 9, 10, 11, 50, 50, 50]
    whole = warp.affine_box(px, one[:2], shape).orderBy("target").collect()
    assert [r["value"] for r in whole] == [1, 2, 3, 0, 5, 6, 7, 0, 9, 10, 11, 0]
    assert warp.affine_box(px, one, shape, (slice(2, 2), slice(None))).count() == 0


def test_wrong_boxes_and_matrices(spark):
    px, shape = image(spark, np.zeros((2, 2)))
    good = [(1, 0, 0), (0, 1, 0)]
    for box in ((slice(0, 1),), (slice(-1, 1), slice(None)), (slice(2, 1), slice(None)), (slice(0, 2, 2), slice(None))):
        with pytest.raises(ValueError):
            warp.affine_box(px, good, shape, box)
    for matrix in (good[:1], [*good, (0, 0, 2)], [(1, 0), (0, 1)]):
        with pytest.raises(ValueError):
            warp.affine_box(px, matrix, shape)


def test_rounding_and_clamping(spark):
    values = [0.5, 1.5, -0.5, -1.5, 2.49, 300.0, -300.0, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r[0] for r in df.orderBy("k").select(warp.to_integers(F.col("v"), -128, 127)).collect()]
    assert got == [1, 2, -1, -2, 2, 127, -128, -128, 127, -128]
    wide = df.where("k = 8").select(warp.to_integers(F.col("v"), -(2**63), 2**63 - 1)).first()[0]
    assert wide == 2**63 - 1


def test_taps_outside_are_spread(spark):
    """All outside: as one key they would be one task's, and they meet no pixel."""
    data = spark.range(4).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("value"))
    away = spark.range(50).select(F.col("id").alias("target"), F.lit(0.0).alias("cz"), F.lit(90.0).alias("cy"), F.lit(90.0).alias("cx"))
    assert {r["value"] for r in warp.map_coordinates(data, away, (1, 2, 2), 1, -1.0).collect()} == {-1.0}
    keys = {r["k"] for r in away.select(warp.no_pixel(F.col("target")).alias("k")).collect()}
    assert len(keys) == 50 and max(keys) < 0
