"""Risk and priority scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .paths import is_test, round3


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def risk(affected: Column, files: Column, breaks: Column, packages: Column, all_packages: Column, untested: Column, boundary: Column) -> Column:
    """Weighted change risk between 0 and 1, before rounding."""
    w = fixed.RISK_WEIGHTS
    x = w["files"] * _ratio(affected, files) + w["api"] * F.least(breaks / fixed.BREAKS_AT_FULL, F.lit(1.0)) + w["packages"] * _ratio(packages, all_packages)
    x = x + w["tests"] * _ratio(untested, affected) + w["boundary"] * F.least(F.greatest(boundary, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def risk_score(x: Column) -> Column:
    return round3(x)


def risk_category(x: Column) -> Column:
    out = F
    for most, name in fixed.RISK_LEVELS:
        out = out.when(x < most, name)
    return out.otherwise(fixed.TOP_LEVEL)


def boundary_proximity(breaks: Column, public: Column) -> Column:
    return F.when(public > 0, F.least(breaks / F.greatest(public, F.lit(1)), F.lit(1.0))).otherwise(F.lit(0.0))


def boundary_risk(breaks: Column) -> Column:
    return F.when(breaks <= 0, "none").when(breaks < 2, "low").when(breaks < 5, "medium").otherwise("high")


def fast_risk(direct: Column) -> Column:
    """Category from the number of direct dependents alone."""
    out = F
    for most, name in fixed.FAST_LEVELS:
        out = out.when(direct <= most, name)
    return out.otherwise(fixed.TOP_LEVEL)



def priority(depth: int, mechanism: str, path: Column, boost: Column | float = 1.0, include_tests: bool = False) -> Column:
    base = F.lit(1.0 / (1 + depth)) * fixed.PRIORITY_WEIGHTS[mechanism] * boost
    return base if include_tests else base * F.when(is_test(path), fixed.TEST_PENALTY).otherwise(1.0)


def reference_boost(count: Column) -> Column:
    return 1 + 0.3 * F.least(F.lit(1.0), count / 5)
