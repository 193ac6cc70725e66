"""Scores of memories: decay, staleness, reinforcement, final rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.model import DAY, NOW, weight


def clean_stability(s: Column) -> Column:
    """Between 0.05 and 100 days; 1 where missing, not a number, or not above 0."""
    return F.when(s.isNull() | F.isnan(s) | (s <= 0), 1.0).otherwise(F.least(F.greatest(s, F.lit(0.05)), F.lit(100.0)))


def retention(last_access: Column, stability: Column, now: float = NOW) -> Column:
    """exp(-days / stability); 1 for a memory that was never accessed."""
    days = F.greatest((F.lit(now) - last_access) / DAY, F.lit(0.0))
    return F.when(last_access.isNull(), 1.0).otherwise(F.exp(-days / clean_stability(stability)))


def recency(at: Column, tau: float = 30.0, now: float = NOW) -> Column:
    return F.when(at.isNull(), 0.0).otherwise(F.exp(-F.greatest((F.lit(now) - at) / DAY, F.lit(0.0)) / tau))


def staleness(valid_to: Column, recorded: Column, now: float = NOW, known: float | None = None, window: float = 7.0) -> Column:
    """1 after the validity ends, a linear ramp in its last days; 0 while the end is not yet known."""
    known = now if known is None else known
    left = (valid_to - F.lit(now)) / DAY
    ramp = F.when(left <= 0, 1.0).when(left >= window, 0.0).otherwise(1.0 - left / window)
    return F.when(valid_to.isNull() | (recorded.isNotNull() & (recorded > known)), 0.0).otherwise(ramp)


def reinforced(stability: Column, n: Column, boost: Column, alpha: float = 1.0) -> Column:
    """Stability after the event that follows n others."""
    s = clean_stability(stability)
    return F.least(F.lit(100.0), s + (alpha * F.least(s, F.lit(1.0)) + boost) * F.log1p(1.0 / (n + 1)))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """x between the extremes; flat values give 1, those that are no finite number give null."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, None).when(high - low < 1e-12, 1.0).otherwise((x - low) / (high - low))


def final_score(r: Column, semantic: Column, lexical: Column, graph: Column, importance: Column, confidence: Column, stale: Column) -> Column:
    return weight("r") * r + weight("s") * semantic + weight("l") * lexical + weight("g") * graph + weight("i") * importance * confidence - weight("x") * stale


def proactive(importance: Column, r: Column, confidence: Column, fresh: Column, stale: Column) -> Column:
    return weight("i") * importance * r * confidence + weight("c") * fresh + weight("r") * r - weight("x") * stale
