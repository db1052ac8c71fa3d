from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from timberline.functions import scalar
from timberline.functions.losses import Logistic, Square


@pytest.mark.parametrize(("f", "y", "loss", "z", "w"), [(0, 1, 0.693147, 1.0, 1.0), (0.5, 1, 0.313262, 0.537883, 0.786448), (0.5, -1, 1.313262, -1.462117, 0.786448), (-2, 1, 4.01815, 1.964028, 0.070651), (-400, 1, 800, 2, 0)])
def test_logistic_terms(spark, f, y, loss, z, w):
    t = Logistic().terms(F.lit(float(y)), F.lit(float(f)))
    r = spark.range(1).select(*(v.alias(k) for k, v in t.items())).first()
    assert (r["l"], r["z"], r["w"]) == pytest.approx((loss, z, w), abs=1e-5)


def test_square_terms(spark):
    r = spark.range(1).select(*(v.alias(k) for k, v in Square().terms(F.lit(3.0), F.lit(1.0)).items())).first()
    assert (r["z"], r["l"], r["w"]) == (2.0, 4.0, 1.0)


def test_widths(spark):
    n = [1, 2, 3, 4, 5, 255, 256, 257, 65536, 65537]
    df = spark.createDataFrame([(x,) for x in n], "n int").select(scalar.bit_width(F.col("n")).alias("w")).collect()
    assert [r["w"] for r in df] == [1, 1, 2, 2, 3, 8, 8, 9, 16, 17]


def test_durations(spark):
    df = spark.createDataFrame([("1.2h",), ("90s",), ("2d",), ("5m",), ("7",), ("soon",), ("",)], "t string").select(scalar.duration_seconds(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in df] == [4320.0, 90.0, 172800.0, 300.0, 7.0, None, None]


def test_log_loss_is_infinite_when_certain_and_wrong(spark):
    r = spark.range(1).select(scalar.binary_log_loss(F.lit(1.0), F.lit(False)).alias("a"), scalar.binary_log_loss(F.lit(0.25), F.lit(True)).alias("b")).first()
    assert r["a"] == math.inf
    assert r["b"] == pytest.approx(-math.log(0.25))


def test_smoother_columns(spark):
    theta, rinv = scalar.updated_smoother(F.lit(0.1), F.lit(1.0), F.lit(0.05), 0.9)
    assert spark.range(1).select(theta.alias("t")).first()["t"] == pytest.approx(0.073684, abs=1e-6)
