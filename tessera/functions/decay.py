"""The four decay formulas, tiers and priorities. They differ on purpose and are named apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a kind of memory has lost half of its score; fixed values.
HALF_LIFE_DAYS = {"fact": 30.0, "preference": 90.0, "decision": 60.0, "episodic": 7.0, "procedural": 180.0}


def ebbinghaus(initial: Column, rate: Column, days: Column) -> Column:
    """initial · e^(-rate · days), within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), initial * F.exp(-rate * days)))


def half_life_score(confidence: Column, days: Column, half_life: Column, access_count: Column, active: Column | None = None) -> Column:
    """confidence · 2^(-days/half life) · (1 + .1 ln(accesses + 1)); 0 if inactive."""
    score = confidence * F.pow(F.lit(2.0), -days / half_life) * (1 + 0.1 * F.ln(access_count + F.lit(1)))
    return score if active is None else F.when(active, score).otherwise(0.0)


def periodic(value: Column, days: Column, every: Column) -> Column:
    """A tenth off for each whole period, not below .1."""
    return F.greatest(F.lit(0.1), value * F.pow(F.lit(0.9), F.floor(days / every)))


def weekly(confidence: Column, rate: Column, days: Column) -> Column:
    """``rate`` off for each whole week, not below .05."""
    return F.greatest(F.lit(0.05), confidence - rate * F.floor(days / 7))


def tier(retention: Column) -> Column:
    return F.when(retention >= 0.9, "working").when(retention >= 0.7, "episodic").when(retention >= 0.5, "semantic").when(retention >= 0.3, "procedural").otherwise("archived")


def frequency_multiplier(access_count: Column) -> Column:
    return F.when(access_count >= 50, 0.5).when(access_count >= 20, 0.7).when(access_count >= 5, 0.85).otherwise(1.0)


def eviction_priority(retention: Column, access_count: Column, days: Column, latest: Column) -> Column:
    """.4 retention + .3 min(accesses/100, 1) + .3 e^(-.1 days) + .1 if latest, at most 1."""
    return F.least(F.lit(1.0), 0.4 * retention + 0.3 * F.least(access_count / F.lit(100.0), F.lit(1.0)) + 0.3 * F.exp(-0.1 * days) + F.when(latest, 0.1).otherwise(0.0))


def forget_verdict(expired: Column, retention: Column, access_count: Column, days: Column, least: float = 0.1, untouched_days: int = 90) -> Column:
    """The first reason that holds: expired, low_retention, never_accessed; else keep."""
    return F.when(expired, "expired").when(retention < least, "low_retention").when((access_count == 0) & (days > untouched_days), "never_accessed").otherwise("keep")


def working_memory_score(importance: Column, recency: Column, access_count: Column) -> Column:
    return 0.5 * importance + 0.3 * recency + 0.2 * F.log2(access_count + F.lit(1)) / 10
