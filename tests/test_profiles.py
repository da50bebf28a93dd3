"""Weighted means of a user over plays, whose sums are one row."""

from __future__ import annotations

import math

from cadenza.operators import scoring
from cadenza.plans import profiles
from pyspark.sql import functions as F

ROWS = [("a", 900_000_000, 0.5, 100.0, None, 0.2), ("a", 1_000_000_000, 0.1, 60.0, None, None), ("b", 1_009_000_000, 0.9, 80.0, 0.3, 0.4)]


def plays(spark):
    return spark.createDataFrame(ROWS, "user_id string, last_played_at long, satisfaction double, bpm double, energy double, valence double")


def first_is_spread(df):
    """No row is copied before it is summed up."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate" in plan and plan.rindex("Generate") < plan.index("Aggregate")


def test_means_at_scales(spark):
    made = profiles.at_scales(plays(spark))
    assert first_is_spread(made)
    got = {(r.user_id, r.feature): r["mean"] for r in made.filter(F.col("scale") == list(profiles.SCALES)[-1]).collect()}
    assert got["b", "bpm"] == 80.0 and got["b", "energy"] == 0.3 and got["a", "energy"] is None and 60 <= got["a", "bpm"] <= 100


def test_weighted_stats_leave_nulls_out(spark):
    made = scoring.weighted_stats(plays(spark), ["bpm", "energy", "valence"], F.col("satisfaction"))
    assert first_is_spread(made)
    got = {(r.user_id, r.feature): (r["mean"], r.deviation) for r in made.collect()}
    mean = (0.5 * 100 + 0.1 * 60) / 0.6
    assert math.isclose(got["a", "bpm"][0], mean) and math.isclose(got["a", "bpm"][1], math.sqrt((0.5 * 100**2 + 0.1 * 60**2) / 0.6 - mean**2))
    assert got["a", "valence"] == (0.2, 0.0) and ("a", "energy") not in got
