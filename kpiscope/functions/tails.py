"""Tail probabilities as SQL expressions, so that p-values and intervals stay in the plan.

Arguments are SQL texts of doubles (or numbers), results Columns; the ``*_sql`` forms give the text. Text is parsed
once by the engine, which for expressions of this size is much faster than to build them by calls.

Continued fractions and series are evaluated backwards from a depth that the parameters set, which
makes each a fold of one number over a sequence. Unknown or impossible arguments give null.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = str | float | int


def bound(name: str, values: dict[str, Text], body: str) -> str:
    """``body`` with ``name.key`` for each of the values, which are evaluated once."""
    fields = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def lgamma_sql(z: Text) -> str:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, brought back by the product."""
    product = " * ".join(f"(g.z + {k})" for k in range(8))
    r = "(1 / ((g.z + 8) * (g.z + 8)))"
    series = f"(1D/12 - {r} * (1D/360 - {r} * (1D/1260 - {r} * (1D/1680 - {r} * (1D/1188 - {r} * 691D/360360))))) / (g.z + 8)"
    return bound("g", {"z": z}, f"((g.z + 7.5D) * ln(g.z + 8) - (g.z + 8) + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({product}))")


def betainc_sql(a: Text, b: Text, x: Text) -> str:
    """The regularised incomplete beta function, for a, b > 0 and 0 <= x <= 1."""
    even = "floor(j / 2) * (w.q - floor(j / 2)) * w.y / ((w.p + 2 * floor(j / 2) - 1) * (w.p + 2 * floor(j / 2)))"
    odd = "-(w.p + floor(j / 2)) * (w.p + w.q + floor(j / 2)) * w.y / ((w.p + 2 * floor(j / 2)) * (w.p + 2 * floor(j / 2) + 1))"
    fraction = f"aggregate(sequence(CAST(60 + 8 * sqrt(greatest(w.p, w.q)) AS INT), 1, -1), 1D, (v, j) -> 1 + (CASE WHEN j % 2 = 0 THEN {even} ELSE {odd} END) / v)"
    front = f"exp({lgamma_sql('w.p + w.q')} - {lgamma_sql('w.p')} - {lgamma_sql('w.q')} + w.p * ln(w.y) + w.q * log1p(-w.y)) / w.p"
    swap = "u.x > (u.a + 1) / (u.a + u.b + 2)"
    inside = bound("w", {"p": f"if({swap}, u.b, u.a)", "q": f"if({swap}, u.a, u.b)", "y": f"if({swap}, 1 - u.x, u.x)"}, f"({front} / {fraction})")
    return bound("u", {"a": a, "b": b, "x": x}, f"(CASE WHEN u.x <= 0 THEN 0D WHEN u.x >= 1 THEN 1D WHEN u.a > 0 AND u.b > 0 THEN if({swap}, 1 - {inside}, {inside}) END)")


def gamma_q_sql(a: Text, x: Text) -> str:
    """The regularised upper incomplete gamma function, for a > 0 and x >= 0."""
    scale = f"exp(u.a * ln(u.x) - u.x - {lgamma_sql('u.a')})"
    low = "aggregate(sequence(CAST(80 + 12 * sqrt(u.a) AS INT), 1, -1), 1D, (v, k) -> 1 + u.x / (u.a + k) * v)"
    # x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...)), where all of it is positive.
    tail = "aggregate(sequence(CAST(60 + 12 * sqrt(u.a) AS INT), 1, -1), 1e300D, (v, k) -> u.x + 2 * k - 1 - u.a - k * (k - u.a) / v)"
    return bound("u", {"a": a, "x": x}, f"(CASE WHEN u.x <= 0 THEN 1D WHEN u.a > 0 THEN if(u.x < u.a + 1, greatest(1 - {low} * {scale} / u.a, 0D), {scale} / {tail}) END)")


def t_sf2_sql(t: Text, dof: Text) -> str:
    body = betainc_sql("s.d / 2", 0.5, "s.d / (s.d + s.t * s.t)")
    return bound("s", {"t": t, "d": dof}, f"(CASE WHEN s.d > 0 THEN {body} END)")


def t_quantile_sql(dof: Text, level: float = 0.95) -> str:
    ln_c = f"{lgamma_sql('(h.d + 1) / 2')} - {lgamma_sql('h.d / 2')} - 0.5D * ln(h.d * pi())"
    density = "exp(c.c - (c.d + 1) / 2 * log1p(r * r / c.d))"
    step = f"r + ({t_sf2_sql('r', 'c.d')} - {1 - level!r}D) / (2 * {density})"
    fold = f"aggregate(sequence(1, 14), {NormalDist().inv_cdf((1 + level) / 2)!r}D, (r, i) -> {step})"
    return bound("h", {"d": dof}, f"(CASE WHEN h.d > 0 THEN {bound('c', {'c': ln_c, 'd': 'h.d'}, fold)} END)")


def lgamma(z: Text) -> Column:
    return F.expr(lgamma_sql(z))


def betainc(a: Text, b: Text, x: Text) -> Column:
    return F.expr(betainc_sql(a, b, x))


def gamma_q(a: Text, x: Text) -> Column:
    return F.expr(gamma_q_sql(a, x))


def chi2_sf(x: Text, dof: Text) -> Column:
    """P(X > x) of a chi-squared variable."""
    return F.expr(gamma_q_sql(f"({dof}) / 2D", f"({x}) / 2D"))


def normal_sf2(z: Text) -> Column:
    """Two-sided tail of the standard normal."""
    return F.expr(gamma_q_sql(0.5, f"({z}) * ({z}) / 2D"))


def t_sf2(t: Text, dof: Text) -> Column:
    """Two-sided tail of Student's t; null without degrees of freedom."""
    return F.expr(t_sf2_sql(t, dof))


def t_quantile(dof: Text, level: float = 0.95) -> Column:
    """The t with ``level`` of the probability within it on both sides. Newton steps from the normal's
    quantile, below the root of a convex function, rise to it."""
    return F.expr(t_quantile_sql(dof, level))
