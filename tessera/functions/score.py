"""Scores and bands of strategies and turns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scorer's normalisers, weights, limits and thresholds.
WORDS, MILLIS, DOLLARS = 120.0, 15000.0, 0.001
LATENCY_WEIGHT, COST_WEIGHT, STRUCTURED_LATENCY, REPEATED_FAILURE, STRUCTURED_BONUS = 0.5, 0.5, 0.3, -0.5, 0.5
LEAST_SCORE, MOST_SCORE, IDLE_TURNS, COOLDOWN = -3.0, 3.0, 3, 2
RELIABILITY = (("unreliable", 20), ("low_content", 50), ("ok_weak", 120))
MIN_RUNS, PROMOTE_SUCCESS, PROMOTE_DELTA, DEAD_SUCCESS, DEAD_DELTA, PROMOTE_CONFIDENCE = 8, 0.70, 0.0, 0.25, -0.15, 0.50
POLICY_HALF_LIFE_S = 7 * 86400.0


def capped(x: Column, most: float) -> Column:
    """x as a share of ``most``, 1 at the most; null counts as 0."""
    return F.least(F.coalesce(x, F.lit(0.0)) / F.lit(most), F.lit(1.0))


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding of the decimal value, which ties in binary don't disturb."""
    return F.round(x.cast("decimal(24,12)"), places).cast("double")


def reliability(words: Column) -> Column:
    out = F.lit("ok_strong")
    for name, below in reversed(RELIABILITY):
        out = F.when(words < below, name).otherwise(out)
    return out


def delta(words: Column, millis: Column, dollars: Column, structured: Column, failures: Column) -> Column:
    quality = F.when(structured, F.lit(1.0)).otherwise(capped(words.cast("double"), WORDS))
    latency = capped(millis, MILLIS) * F.when(structured, F.lit(STRUCTURED_LATENCY)).otherwise(F.lit(1.0))
    cost = F.when(structured, F.lit(0.0)).otherwise(capped(dollars, DOLLARS))
    repeated = F.when(failures >= 2, F.lit(REPEATED_FAILURE)).otherwise(F.lit(0.0))
    total = quality - F.lit(LATENCY_WEIGHT) * latency - F.lit(COST_WEIGHT) * cost + repeated
    return F.round(total.cast("decimal(18,9)"), 3).cast("double")


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(MOST_SCORE), score))


def confidence(success: Column, runs: Column, millis: Column, dollars: Column) -> Column:
    """Success, less for few runs and for slow or costly ones."""
    sample = F.least(F.sqrt(runs.cast("double")) / F.sqrt(F.lit(2.0 * MIN_RUNS)), F.lit(1.0))
    return F.round(success * sample * (F.lit(1.0) / (F.lit(1.0) + capped(millis, MILLIS) + capped(dollars, DOLLARS))), 3)


def decayed(value: Column, age_s: Column, scale_s: float = POLICY_HALF_LIFE_S) -> Column:
    return F.round(value * F.exp(-age_s / F.lit(scale_s)), 3)


def band(score: Column) -> Column:
    return F.when(score <= -2.0, "very_low").when(score < 0.0, "low").otherwise("neutral")


def band_reliability(score: Column) -> Column:
    return F.when(score <= -2.0, "unreliable").when(score < 0.0, "low_content").otherwise("ok")


def exploration(score: Column) -> Column:
    return F.when(F.abs(score) < 0.5, F.lit(0.20)).when(score <= -2.0, F.lit(0.05)).otherwise(F.lit(0.10))


def policy_temperature(score: Column, default: float = 0.4) -> Column:
    return F.when(F.abs(score) < 0.5, F.lit(0.6)).when(score <= -2.0, F.lit(0.2)).otherwise(F.lit(default))
