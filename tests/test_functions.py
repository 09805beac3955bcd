"""Column helpers against the pandas semantics they replace."""

import math

import numpy as np

from pyspark.sql import functions as F

from workrisk.functions import (clip, dirty_to_double, null_max, risk_category, safe_div, tech_stratum)


def test_dirty_numbers(spark):  # M1
    df = spark.createDataFrame([("1,234",), ("*",), ("#",), ("",), ("12.5",), (None,)], "v string")
    got = [r[0] for r in df.select(dirty_to_double("v")).collect()]
    assert got == [1234.0, None, None, None, 12.5, None]


def test_safe_div_zero(spark):  # M2
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 1.5]


def test_clip_keeps_null(spark):  # M3
    df = spark.createDataFrame([(None,), (150.0,), (-3.0,), (42.0,)], "x double")
    assert [r[0] for r in df.select(clip("x", 0, 100)).collect()] == [None, 100.0, 0.0, 42.0]


def test_null_max(spark):  # M4
    df = spark.createDataFrame([(None, 0.5), (0.2, 0.7)], "a double, b double")
    assert [r[0] for r in df.select(null_max("a", "b")).collect()] == [None, 0.7]


def test_risk_bands(spark):  # P9 edges
    vals = [None, 80.0, 79.99, 60.0, 40.0, 20.0, 19.9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(risk_category("x")).collect()]
    assert got == ["Unknown", "Very High", "High", "High", "Moderate", "Low", "Very Low"]


def test_strata(spark):  # P21 edges
    df = spark.createDataFrame([(0.1165,), (0.1166,), (0.1558,), (0.1559,), (None,)], "x double")
    got = [r[0] for r in df.select(tech_stratum("x")).collect()]
    assert got == ["Low-Tech", "Medium-Tech", "Medium-Tech", "High-Tech", "High-Tech"]


def test_bround_half_even(spark):  # M8
    df = spark.createDataFrame([(2.25,), (2.35,), (54.05,), (-0.05,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 1)).collect()]
    # pandas/numpy ``.round(1)`` semantics (not Python's ``round``)
    assert got == [float(np.round(x, 1)) for x in (2.25, 2.35, 54.05, -0.05)]
    assert not any(math.isnan(g) for g in got)
