"""Math functions (M rows). Missing numbers are null, never 0 and never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import checked

# Gain, graded relevance and code of the four labels.
GAINS = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}
QRELS = {"E": 100, "S": 10, "C": 1, "I": 0}
CODES = {"E": 3, "S": 2, "C": 1, "I": 0}


def mapped(label: Column, table: dict) -> Column:
    """A label's value; an unknown label raises."""
    c = None
    for k, v in table.items():
        c = F.when(label == k, F.lit(v)) if c is None else c.when(label == k, F.lit(v))
    return c.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


#: Spark's log2 is a quotient of two logarithms and may be off in the last digit, which decides at the edge of a stratum; up to this rank the nearest doubles are told.
EXACT_RANKS = 256


def log2_discount(rank: Column) -> Column:
    """log2(rank + 1), rank an integer from 1."""
    told = F.array(*[F.lit(math.log2(r + 1)) for r in range(1, EXACT_RANKS + 1)])
    return F.coalesce(F.get(told, (rank - 1).cast("int")), F.log2(rank + 1))


def dcg_term(gain: Column, rank: Column) -> Column:
    """M1: gain / log2(rank + 1)."""
    return gain / log2_discount(rank)


def dot(a: Column, b: Column) -> Column:
    """M2: inner product in index order; vectors of different width raise, a missing one gives null."""
    value = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull(), checked(F.size(a) == F.size(b), value, "vectors differ in width"))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """M3: unit length, the norm at least `floor`."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(floor)))


def zscore(c: Column, mean: Column, std: Column) -> Column:
    """M5: null stays null."""
    return (c - mean) / std


def blend(text: Column, image: Column, weight: Column) -> Column:
    """M6: weight on text, the rest on image; text alone where the image is missing. A weight outside 0..1 raises."""
    mixed = F.when(image.isNotNull(), weight * text + (1 - weight) * image).otherwise(text)
    return checked((weight >= 0) & (weight <= 1), mixed, "weight must be in 0..1")


def or_last(score: Column) -> Column:
    """M7: an unscored pair still takes a rank, behind all scored ones."""
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float("-inf")))


def coverage(query: Column, field: Column) -> Column:
    """M8: share of the query's terms in the field; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, field)) / F.size(query))


def match_share(query: Column, field: Column) -> Column:
    """M9: share of the field's terms that the query names; null for an empty field."""
    return F.try_divide(F.size(F.array_intersect(query, field)), F.size(field))


def number(c: Column) -> Column:
    """A double, null where it isn't one."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def sigmoid(z: Column) -> Column:
    """Stable for either sign."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def yes_probability(top: Column, yes: str = "yes", no: str = "no") -> Column:
    """Struct of P(yes) from top log-probabilities and whether a missing answer was given the lowest of them."""
    floor = F.array_min(F.map_values(top))
    y, n = F.try_element_at(top, F.lit(yes)), F.try_element_at(top, F.lit(no))
    return F.struct(sigmoid(F.coalesce(y, floor) - F.coalesce(n, floor)).alias("p"), (y.isNull() | n.isNull()).alias("imputed"))


def expected_gain(probabilities: Column) -> Column:
    """Sum of class probabilities, in order I C S E, times their gains."""
    gains = F.array(*[F.lit(GAINS[k]) for k in ("I", "C", "S", "E")])
    return F.aggregate(F.zip_with(probabilities, gains, lambda p, g: p * g), F.lit(0.0), lambda s, x: s + x)


def teacher_share(student: Column, base: Column, teacher: Column) -> Column:
    """Share of the teacher's gain over the base; a teacher no better than the base raises."""
    return checked(teacher > base, (student - base) / (teacher - base), "the teacher doesn't beat the base")


def token_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Dollars for tokens at prices a million; null where unpriced."""
    return (prompt * prompt_price + completion * completion_price) / 1e6


def hosting_cost(rate_per_s: Column, dollars_per_hour: Column) -> Column:
    """Dollars for a thousand queries of a host that serves rate_per_s."""
    return F.try_divide(dollars_per_hour, rate_per_s * 3600) * 1000


def trusted_latency(ms: Column, called: Column, n: Column, share: float = 0.9) -> Column:
    """A latency only if enough windows were really called."""
    return F.when(called >= share * n, ms)


def poisson_gap(u: Column, rate: float) -> Column:
    """Time to the next arrival from a uniform draw."""
    return -F.log(u) / rate


def load_seconds(rate: Column) -> Column:
    """How long a load level is held."""
    return F.greatest(F.lit(60.0), 150.0 / rate)


def soft_target(c: Column) -> Column:
    """A target in 0..1; others raise."""
    return checked((c >= 0) & (c <= 1), c, "target outside 0..1")
