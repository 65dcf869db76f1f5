"""SQL text builders for the oracle: rounding, normal CDF, t tail, Wilson."""

from __future__ import annotations

import math
from statistics import NormalDist

# --- fixed values: Hart (1968) normal-CDF coefficients (same published constants as the library)
_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
        112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
        296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _decimal(expr: str) -> str:
    # the shortest decimal form of a double, as text
    return f"TRY_CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,12))"


def R(expr: str, dp: int) -> str:
    """Half-up rounding on the decimal value (as Postgres ``ROUND(numeric)``)."""
    return f"coalesce(CAST(ROUND({_decimal(expr)}, {dp}) AS DOUBLE), CAST(({expr}) AS DOUBLE))"


def RE(expr: str, dp: int) -> str:
    """Banker's rounding (pandas ``round``)."""
    return f"coalesce(CAST(round_even({_decimal(expr)}, {dp}) AS DOUBLE), CAST(({expr}) AS DOUBLE))"


def SUM(expr: str) -> str:
    """Exact sum of decimal data held as doubles."""
    return f"CAST(SUM(CAST(({expr}) AS DECIMAL(28,6))) AS DOUBLE)"


def AVG(expr: str) -> str:
    return f"({SUM(expr)} / NULLIF(COUNT({expr}), 0))"


def DIV(a: str, b: str) -> str:
    return f"(CAST(({a}) AS DOUBLE) / NULLIF(CAST(({b}) AS DOUBLE), 0))"


def _horner(x: str, cs) -> str:
    s = repr(cs[0])
    for c in cs[1:]:
        s = f"({s}) * {x} + {c!r}"
    return s


def PHI(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-{a} * {a} / 2.0)"
    small = f"{e} * ({_horner(a, _NUM)}) / ({_horner(a, _DEN)})"
    cf = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({a} + {k} / {cf})"
    large = f"{e} / {cf} / 2.506628274631"
    lower = f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {small} ELSE {large} END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) > 0 THEN 1.0 - {lower} ELSE {lower} END)"


def ZQ(p: float) -> str:
    return repr(NormalDist().inv_cdf(p))


def _simpson(nu: str, a: str, b: str, n: int = 2000) -> str:
    h = f"(({b}) - ({a})) / {float(n)}"
    w = f"(CASE WHEN i = 0 OR i = {n} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return (f"((SELECT SUM({w} * pow(cos(({a}) + i * {h}), ({nu}) - 1.0)) "
            f"FROM range(0, {n + 1}) AS rr(i)) * {h} / 3.0)")


def T_SF(t: str, nu: str) -> str:
    """P(T > t): same Simpson construction as the library (theta substitution)."""
    tmax = f"least({math.pi / 2!r}, 12.0 / sqrt(greatest(({nu}) - 1.0, 1e-12)))"
    tt = f"least(atan(abs({t}) / sqrt({nu})), {tmax})"
    upper = f"(0.5 - {_simpson(nu, '0.0', tt)} / (2.0 * {_simpson(nu, '0.0', tmax)}))"
    return f"(CASE WHEN ({t}) IS NULL OR ({nu}) IS NULL THEN NULL WHEN ({t}) >= 0 THEN {upper} ELSE 1.0 - {upper} END)"


def WILSON(s: str, n: str, alpha: float = 0.05) -> tuple[str, str]:
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p = f"(CAST({s} AS DOUBLE) / {n})"
    denom = f"(1.0 + {z * z!r} / {n})"
    centre = f"(({p} + {z * z!r} / (2.0 * {n})) / {denom})"
    half = f"(({z!r} / {denom}) * sqrt({p} * (1.0 - {p}) / {n} + {z * z!r} / (4.0 * {n} * {n})))"
    return f"({centre} - {half})", f"({centre} + {half})"
