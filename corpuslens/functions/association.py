"""Association measures of a 2x2 table, as column expressions: joint count k, marginals a and b, total n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chi-square critical values of one degree of freedom at 5, 1 and 0.1 percent (fixed values).
CRITICAL = (3.84, 6.63, 10.83)


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _proper(k, a, b, n) -> Column:
    return (_c(k) > 0) & (_c(a) > 0) & (_c(b) > 0) & (_c(n) > 0)


def pmi(k, a, b, n) -> Column:
    """log2 of how much oftener the two meet than by chance; 0 for a degenerate table."""
    return F.when(_proper(k, a, b, n), F.log2(_c(k) * _c(n) / (_c(a) * _c(b)))).otherwise(0.0)


def _term(observed: Column, expected: Column) -> Column:
    return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(0.0)


def g2(k, a, b, n) -> Column:
    """Log-likelihood ratio with the sign of the association; 0 for a degenerate table."""
    k, a, b, n = _c(k), _c(a), _c(b), _c(n)
    cells = [(k, a * b / n), (a - k, a * (n - b) / n), (b - k, (n - a) * b / n), (n - a - b + k, (n - a) * (n - b) / n)]
    value = F.greatest(F.lit(0.0), 2 * sum((_term(o, e) for o, e in cells), F.lit(0.0)))
    return F.when(_proper(k, a, b, n), F.when(k < a * b / n, -value).otherwise(value)).otherwise(0.0)


def log_dice(k, a, b) -> Column:
    """14 + log2 of the Dice coefficient; at most 14, independent of corpus size; 0 for a degenerate table."""
    return F.when((_c(k) > 0) & (_c(a) > 0) & (_c(b) > 0), 14 + F.log2(2 * _c(k) / (_c(a) + _c(b)))).otherwise(0.0)


def tier(ll) -> Column:
    """How many of the critical values the log-likelihood ratio reaches: 0 to 3."""
    return sum((F.when(F.abs(_c(ll)) >= c, 1).otherwise(0) for c in CRITICAL), F.lit(0))


def association(k, a, b, n) -> Column:
    ll = g2(k, a, b, n)
    return F.struct(pmi(k, a, b, n).alias("pmi"), ll.alias("ll"), log_dice(k, a, b).alias("log_dice"), tier(ll).alias("tier"))


def rarity_weight(count) -> Column:
    """A weight that falls with frequency: 1 / log2(count + 2), a count below 1 being 1."""
    return 1 / F.log2(F.greatest(_c(count), F.lit(1.0)) + 2)
