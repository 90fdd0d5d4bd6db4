"""Ranking formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranking:
    """Weights; the defaults are fixed values."""

    importance_weight: float = 1.0
    location_bias: float = 0.6
    location_bias_scale_km: float = 20.0
    exact_match_boost: float = 1.6
    prefix_match_boost: float = 1.25
    city_echo_penalty: float = 0.5


def proximity(metres: Column, r: Ranking = Ranking()) -> Column:
    bias = min(1.0, max(0.0, r.location_bias))
    return F.lit(1.0 - bias) + bias * F.exp(-metres / max(1.0, r.location_bias_scale_km * 1000))


def combined(text: Column, importance: Column, metres: Column, r: Ranking = Ranking()) -> Column:
    """Text score, raised by importance, lowered by distance (null: no focus)."""
    clamped = F.least(F.greatest(importance, F.lit(0.0)), F.lit(1.0))
    return text * (1.0 + r.importance_weight * clamped) * F.coalesce(proximity(metres, r), F.lit(1.0))


def name_match(query: Column, name: Column, last_is_prefix: Column, r: Ranking = Ranking()) -> Column:
    """How well a tokenised name matches: as a whole, up to its last word's end, or at its start."""
    n, m = F.size(query), F.size(name)
    head = F.slice(query, 1, F.greatest(n - 1, F.lit(0))) == F.slice(name, 1, F.greatest(n - 1, F.lit(0)))
    last, there = F.element_at(query, -1), F.get(name, n - 1)
    begins = last_is_prefix & there.startswith(last)
    nearly = (r.exact_match_boost + r.prefix_match_boost) / 2
    return (
        F.when(F.coalesce((n == 0) | (m == 0), F.lit(True)), 1.0).when(query == name, r.exact_match_boost)
        .when((n <= m) & head & begins & (n == m), nearly).when((n <= m) & head & (begins | (there == last)), r.prefix_match_boost).otherwise(1.0)
    )


def city_echo(query: Column, name_words: Column, context: Column, last_is_prefix: Column, r: Ranking = Ranking()) -> Column:
    """The penalty where a name matches query words that are all of its own address, and not all of the query."""
    numbered = F.transform(query, lambda t, i: F.struct(t.alias("t"), (last_is_prefix & (i + 1 == F.size(query))).alias("p")))
    hit = lambda q, words: F.exists(words, lambda w: (w == q["t"]) | (q["p"] & w.startswith(q["t"])))
    named = F.filter(numbered, lambda q: hit(q, name_words))
    echo = (F.size(named) > 0) & (F.size(named) < F.size(query)) & F.forall(named, lambda q: hit(q, context))
    return F.when(F.coalesce(echo, F.lit(False)), r.city_echo_penalty).otherwise(1.0)
