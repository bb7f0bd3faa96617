"""Column expressions of the scoring model. All are native, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, an approximation of erf within 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_cdf(x) -> Column:
    """The standard normal distribution function."""
    z = F.abs(col(x)) / math.sqrt(2)
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(col(x) >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def normal_pdf(x) -> Column:
    return F.exp(-col(x) * col(x) / 2) / math.sqrt(2 * math.pi)


def occurrences(text, piece) -> Column:
    """How often ``piece`` stands in ``text``, without overlaps; null with either."""
    t, p = col(text), col(piece)
    return ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")


def risk_status(genotype="genotype", allele="risk_allele") -> Column:
    """2 for exactly two risk alleles, 1 for any other number above none, 0 for none."""
    n = occurrences(genotype, allele)
    return F.when(n == 2, 2).when(n > 0, 1).when(n == 0, 0)


def status_category(status="risk_status") -> Column:
    return F.when(col(status) <= 1, "good").when(col(status).isNotNull(), "bad")


def genotype_probability(status="risk_status", p="risk_allele_frequency", hardy_weinberg: bool = False) -> Column:
    """p*q for one risk allele, q*q for none, p*p for two, null without a status. ``hardy_weinberg`` doubles the first, an
    extension."""
    p, q = col(p), 1 - col(p)
    one = 2 * p * q if hardy_weinberg else p * q
    return F.when(col(status) == 1, one).when(col(status) == 0, q * q).when(col(status) == 2, p * p)


def population_score(is_or="is_or", p="risk_allele_frequency", effect="odds_ratio", direction="trait_direction") -> Column:
    p, effect, direction = col(p), col(effect), col(direction)
    log = F.when(effect > 0, F.ln(effect))
    return F.when(col(is_or), p * 2 * log).when(~col(is_or) & (direction == "decrease"), -p * 2 * effect).when(~col(is_or) & (direction == "increase"), p * 2 * effect)


def signed_effect(is_or="is_or", effect="odds_ratio", direction="trait_direction") -> Column:
    return F.when(~col(is_or) & (col(direction) == "decrease"), -col(effect)).otherwise(col(effect))


def final_risk(is_or="is_or", effect="odds_ratio", status="risk_status", population="population_score") -> Column:
    """Log odds (0 where there's no logarithm) or the signed effect, times the status, less the population's score."""
    log = F.when(col(effect) > 0, F.ln(col(effect))).otherwise(0.0)
    return F.when(col(is_or), log).otherwise(col(effect)) * col(status) - col(population)


def log_risk(effect="odds_ratio", status="risk_status", population="population_score") -> Column:
    """The plain form: always the logarithm of the effect; null where there's none."""
    return F.when(col(effect) > 0, F.ln(col(effect))) * col(status) - col(population)


def rsid_of(number) -> Column:
    """The identifier of a variant that is given by its number alone."""
    return F.concat(F.lit("rs"), col(number).cast("string"))


def allele_after_dash(text) -> Column:
    """What follows the first dash; null if nothing does."""
    return F.nullif(F.regexp_extract(col(text), "-(.*)", 1), F.lit(""))


def exact_sum(c) -> Column:
    """An aggregate: the sum of doubles, the same in any order of the rows, so that a sum near zero has a sign of its own
    and not that of rounding. Whole numbers of 2^-20 and, of the rests, of 2^-62 are summed apart, which holds the bits of
    4 million numbers a group; numbers from 2^20 on, and what is no number, are summed plainly."""
    x = col(c)
    small = F.abs(x) < 2.0**20
    high = F.rint(x * 2.0**20)
    low = F.rint((x - high / 2.0**20) * 2.0**62)
    parts = [F.coalesce(F.sum(F.when(small, part).cast("long")), F.lit(0)) * unit for part, unit in ((high, 2.0**-20), (low, 2.0**-62))]
    return F.when(F.count(x) > 0, parts[0] + parts[1] + F.coalesce(F.sum(F.when(~small, x)), F.lit(0.0)))


def distinct_csv(c) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col(c))), ",")


def mapped(c, table: dict[str, str], default=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(c))
    return F.coalesce(found, col(c) if default is None else F.lit(default))
