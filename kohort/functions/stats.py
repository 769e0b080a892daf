"""Tail probabilities for test statistics.

Spark SQL has neither ``erf`` nor the incomplete gamma function.  Two
implementations of the same method: plain Python for values computed on
the driver (model summaries, a log-rank solve) and Spark SQL expression
text (higher-order functions) for p-values of test tables, which stay in
the JVM.
"""

from __future__ import annotations

import math


Z975 = 1.959963984540054  # standard normal 97.5% quantile


def _tail_functions():
    """Build the tail functions as closures.  Functions created here are
    shipped to Python workers by value, so tasks that use them do not need
    this package installed on the executors."""
    import math

    def gammaincc(a: float, x: float) -> float:
        """Regularised upper incomplete gamma Q(a, x): series below a+1,
        Lentz continued fraction above (standard numerical method)."""
        if x is None or a is None or (isinstance(x, float) and math.isnan(x)):
            return float("nan")
        if x <= 0:
            return 1.0
        lg = math.lgamma(a)
        if x < a + 1.0:
            term = 1.0 / a
            s = term
            ap = a
            while math.isfinite(s):
                ap += 1.0
                term *= x / ap
                s += term
                if abs(term) < abs(s) * 1e-16:
                    break
            p = s * math.exp(-x + a * math.log(x) - lg)
            return max(0.0, 1.0 - p)
        tiny = 1e-300
        b = x + 1.0 - a
        c = 1.0 / tiny
        d = 1.0 / b
        h = d
        i = 0
        while math.isfinite(h):
            i += 1
            an = -i * (i - a)
            b += 2.0
            d = an * d + b
            if abs(d) < tiny:
                d = tiny
            c = b + an / c
            if abs(c) < tiny:
                c = tiny
            d = 1.0 / d
            delta = d * c
            h *= delta
            if abs(delta - 1.0) < 4e-16:
                break
        return math.exp(-x + a * math.log(x) - lg) * h

    def chi2_sf(x: float, df: float) -> float:
        """P(X >= x) for a chi-square with ``df`` degrees of freedom."""
        if x is None or df is None or df <= 0:
            return float("nan")
        return gammaincc(df / 2.0, x / 2.0)

    def norm_sf2(z: float) -> float:
        """Two-sided normal tail P(|Z| >= |z|)."""
        return math.erfc(abs(z) / math.sqrt(2.0))

    return gammaincc, chi2_sf, norm_sf2


gammaincc, chi2_sf, norm_sf2 = _tail_functions()


# --- the same tail probabilities as JVM expressions ---------------------------
# Written as Spark SQL text over higher-order functions, so a test table's
# p-values are computed where the table lives, with no Python worker.

def lgamma_sql(z: str) -> str:
    """log Gamma(z) for z > 0: Stirling series after shifting by 10
    (truncation error below 1e-15)."""
    w = f"(({z}) + 10D)"
    shift = " + ".join(f"ln(({z}) + {k}D)" for k in range(10))
    return (f"(({w} - 0.5D) * ln({w}) - {w} + 0.9189385332046728D + 1D / (12D * {w})"
            f" - 1D / (360D * pow({w}, 3)) + 1D / (1260D * pow({w}, 5)) - 1D / (1680D * pow({w}, 7))"
            f" + 1D / (1188D * pow({w}, 9)) - 691D / (360360D * pow({w}, 11)) - ({shift}))")


def gammaincc_sql(a: str, x: str) -> str:
    """Regularised upper incomplete gamma Q(a, x): series below a+1,
    Lentz continued fraction above (as :func:`gammaincc`).  Both need the
    more terms the larger a and x are, in proportion to the root of the
    larger.  Lambda variables carry unlikely names so they never shadow a
    column."""
    terms = f"CAST(ceil(60D + 10D * sqrt(greatest({a}, {x}))) AS INT)"
    pref = f"exp(-({x}) + ({a}) * ln({x}) - {lgamma_sql(a)})"
    series = (f"aggregate(sequence(1, {terms}), named_struct('t', 1D / ({a}), 's', 1D / ({a})), "
              f"(kq_acc, kq_k) -> named_struct('t', kq_acc.t * ({x}) / (({a}) + kq_k), "
              f"'s', kq_acc.s + kq_acc.t * ({x}) / (({a}) + kq_k)), kq_acc -> kq_acc.s)")
    an = f"(-kq_i * (kq_i - ({a})))"
    dd = f"(CASE WHEN abs({an} * kq_acc.d + kq_acc.b + 2D) < 1e-300D THEN 1e-300D ELSE {an} * kq_acc.d + kq_acc.b + 2D END)"
    cc = f"(CASE WHEN abs(kq_acc.b + 2D + {an} / kq_acc.c) < 1e-300D THEN 1e-300D ELSE kq_acc.b + 2D + {an} / kq_acc.c END)"
    b0 = f"(({x}) + 1D - ({a}))"
    cf = (f"aggregate(sequence(1, {terms}), named_struct('b', {b0}, 'c', 1e300D, 'd', 1D / {b0}, 'h', 1D / {b0}), "
          f"(kq_acc, kq_i) -> named_struct('b', kq_acc.b + 2D, 'c', {cc}, 'd', 1D / {dd}, "
          f"'h', kq_acc.h * (1D / {dd}) * {cc}), kq_acc -> kq_acc.h)")
    return (f"CASE WHEN ({x}) IS NULL OR ({a}) IS NULL OR isnan({x}) THEN CAST(NULL AS DOUBLE) "
            f"WHEN ({x}) <= 0D THEN 1D "
            f"WHEN ({x}) < ({a}) + 1D THEN greatest(0D, 1D - {pref} * {series}) "
            f"ELSE {pref} * {cf} END")


def chi2_sf_sql(x: str, df: str) -> str:
    """P(X >= x) for chi-square with ``df`` degrees of freedom (NULL if df <= 0)."""
    return (f"CASE WHEN ({df}) IS NULL OR ({df}) <= 0 THEN CAST(NULL AS DOUBLE) "
            f"ELSE {gammaincc_sql(f'(CAST({df} AS DOUBLE) / 2D)', f'(CAST({x} AS DOUBLE) / 2D)')} END")


def norm_sf2_sql(z: str) -> str:
    """Two-sided normal tail P(|Z| >= |z|) = Q(1/2, z^2/2)."""
    return gammaincc_sql("0.5D", f"(CAST({z} AS DOUBLE) * CAST({z} AS DOUBLE) / 2D)")
