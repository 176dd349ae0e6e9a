"""Scalar formulas as SQL text that Spark and other engines read alike.

Each function takes SQL expressions (doubles unless said otherwise) and returns
one.  They stay in generated JVM code; nothing here runs Python on rows.
"""

from __future__ import annotations

#: Margins are held within these bounds while training.
MARGIN = 10.0
#: exp() of a margin is held to this.
MOST_RATE = 1e15


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def logit(p: str) -> str:
    held = f"greatest(0.0000001, least(0.9999999, {p}))"
    return f"ln({held} / (1.0 - {held}))"


def positive(y: str) -> str:
    """Condition: a binary label counts as positive over a half."""
    return f"({y} > 0.5)"


def as_binary(y: str) -> str:
    return f"CASE WHEN {positive(y)} THEN 1.0 ELSE 0.0 END"


def weight(y: str, scale: float) -> str:
    return f"CASE WHEN {positive(y)} THEN CAST({scale!r} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"


def logistic(p: str, y: str, scale: float = 1.0) -> tuple[str, str]:
    """Gradient and hessian; the floor binds 1 - p alone."""
    w = weight(y, scale)
    return f"({w}) * ({p} - {y})", f"({w}) * {p} * greatest(1.0 - {p}, 0.000001)"


def rate(f: str) -> str:
    return f"least(exp({f}), CAST(1e15 AS DOUBLE))"


def poisson(f: str, y: str) -> tuple[str, str]:
    return f"({rate(f)} - {y})", f"greatest({rate(f)}, 0.000001)"


def squared(f: str, y: str) -> tuple[str, str]:
    return f"({f} - {y})", "CAST(1.0 AS DOUBLE)"


def huber(f: str, y: str, delta: str) -> tuple[str, str]:
    """Beyond delta the gradient has constant size and the hessian is zero."""
    r = f"({f} - {y})"
    return f"CASE WHEN abs({r}) <= {delta} THEN {r} ELSE {delta} * sign({r}) END", f"CASE WHEN abs({r}) <= {delta} THEN 1.0 ELSE 0.0 END"


def entropy(pos: str, total: str) -> str:
    """Binary entropy in bits of a share known to four digits (rounded down); 0 at either end."""
    p = f"(floor({pos} / {total} * 10000.0) / 10000.0)"
    inside = f"{total} >= 0.000000001 AND {pos} / {total} >= 0.0001 AND {p} < 1.0"
    return f"CASE WHEN {inside} THEN -{p} * log2({p}) - (1.0 - {p}) * log2(1.0 - {p}) ELSE 0.0 END"


def gain(gl: str, hl: str, g: str, h: str, lam: float, gamma: float) -> str:
    """Second-order gain of a split, from the left sums and the totals."""
    side = lambda a, b: f"({a}) * ({a}) / (({b}) + {lam!r})"
    return f"(0.5 * ({side(gl, hl)} + {side(f'{g} - {gl}', f'{h} - {hl}')} - {side(g, h)}) - {gamma!r})"


def leaf(g: str, h: str, lam: float) -> str:
    return f"CASE WHEN ({h}) + {lam!r} = 0.0 THEN 0.0 ELSE -({g}) / (({h}) + {lam!r}) END"


def clamp(x: str, bound: float = MARGIN) -> str:
    return f"greatest({-bound!r}, least({bound!r}, {x}))"


def vulnerability(p: str, y: str, pos_ratio: str) -> str:
    """Confidence times error, heavier for a rare class, at most 1."""
    w = f"CASE WHEN {positive(y)} THEN least(5.0, least(1000.0, 1.0 / {pos_ratio}) / 100.0) ELSE 1.0 END"
    return f"least(1.0, 2.0 * abs({p} - 0.5) * abs({y} - {p}) * ({w}))"


def drift_kind(h: str) -> str:
    return f"CASE WHEN {h} > 2.5 THEN 'systemic' WHEN {h} < 1.5 THEN 'localized' ELSE 'feature_shift' END"


def drift_score(h: str, acf: str, het: str, rmse: str) -> str:
    return f"(0.4 * least({h} / 3.5, 1.0) + 0.3 * abs({acf}) + 0.3 * least({het} / {rmse}, 1.0))"


def tree_count(score: str, temporal: str, variance: str, rows: str, complexity: str, degradation: str) -> str:
    """New trees for an adaptation, from 60 to 120.

    Fixed values: base 120 over a combined score of 0.7, else 90 over a temporal
    part of 0.5, else 80 over a variance part of 0.6, else 40; factors by buffer
    size (2000, 15000), complexity (2.5, 1.2) and degradation (1.5, 1.0, 0.3)."""
    base = f"CASE WHEN {score} > 0.7 THEN 120.0 WHEN {temporal} > 0.5 THEN 90.0 WHEN {variance} > 0.6 THEN 80.0 ELSE 40.0 END"
    size = f"CASE WHEN {rows} < 2000 THEN 0.8 WHEN {rows} > 15000 THEN 1.2 ELSE 1.0 END"
    hard = f"CASE WHEN {complexity} > 2.5 THEN 1.3 WHEN {complexity} > 1.2 THEN 1.0 ELSE 0.8 END"
    bad = f"CASE WHEN {degradation} > 1.5 THEN 1.3 WHEN {degradation} > 1.0 THEN 1.15 WHEN {degradation} < 0.3 THEN 0.9 ELSE 1.0 END"
    return f"CAST(greatest(60.0, least(120.0, floor(CAST(({base}) * ({size}) * ({hard}) * ({bad}) AS DOUBLE)))) AS INT)"
