"""Bounded least-squares blend of model predictions.

min ||P w - y||^2  subject to  0 <= w_i <= 1.

The data pass is one aggregate: the Gram matrix P'P (k x k), P'y and y'y,
summed with partial aggregation.  The k-dimensional box-constrained problem
is then solved exactly on the driver by enumerating active sets (each weight
at its lower bound, upper bound or free; 3^k candidates, k <= 10): the free
weights solve the reduced normal equations, infeasible candidates are
discarded and the feasible one with the least objective is the optimum of
this convex problem.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, preds: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(P'P, P'y, y'y, n) over rows where y and every prediction are present."""
    preds = list(preds)
    ok = F.col(y).isNotNull()
    for p in preds:
        ok = ok & F.col(p).isNotNull()
    d = df.where(ok)
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}")
            for i, a in enumerate(preds) for j, b in enumerate(preds) if j >= i]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"b_{i}") for i, a in enumerate(preds)]
    aggs += [F.sum(F.col(y) * F.col(y)).alias("c"), F.count(F.lit(1)).alias("n")]
    row = d.agg(*aggs).first()
    k = len(preds)
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    b = np.array([row[f"b_{i}"] or 0.0 for i in range(k)])
    return g, b, float(row["c"] or 0.0), int(row["n"])


def solve_box_ls(g: np.ndarray, b: np.ndarray, c: float = 0.0, lb: float = 0.0, ub: float = 1.0,
                 tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Exact minimiser of w'Gw - 2b'w + c over lb <= w <= ub (G positive semi-definite)."""
    k = len(b)
    if k > 10:
        raise ValueError("active-set enumeration is meant for at most 10 models")
    best, best_obj = None, np.inf
    for state in itertools.product((0, 1, 2), repeat=k):      # 0 = lb, 1 = ub, 2 = free
        w = np.array([lb if s == 0 else ub if s == 1 else 0.0 for s in state])
        free = [i for i, s in enumerate(state) if s == 2]
        if free:
            fixed = [i for i, s in enumerate(state) if s != 2]
            a = g[np.ix_(free, free)]
            r = b[free] - (g[np.ix_(free, fixed)] @ w[fixed] if fixed else 0.0)
            try:
                w_free = np.linalg.solve(a, r)
            except np.linalg.LinAlgError:
                continue
            if np.any(w_free < lb - tol) or np.any(w_free > ub + tol):
                continue
            w[free] = np.clip(w_free, lb, ub)
        obj = float(w @ g @ w - 2 * b @ w + c)
        if obj < best_obj - 1e-12 * max(1.0, abs(best_obj) if np.isfinite(best_obj) else 1.0):
            best, best_obj = w, obj
    return best, best_obj


def kkt_residual(g: np.ndarray, b: np.ndarray, w: np.ndarray, lb: float = 0.0, ub: float = 1.0) -> float:
    """Largest violation of the optimality conditions (0 at the optimum)."""
    grad = 2 * (g @ w - b)
    viol = []
    for gi, wi in zip(grad, w):
        if wi <= lb + 1e-12:
            viol.append(max(0.0, -gi))
        elif wi >= ub - 1e-12:
            viol.append(max(0.0, gi))
        else:
            viol.append(abs(gi))
    scale = max(1.0, float(np.abs(2 * b).max()))
    return max(viol) / scale


def fit_blend(df: DataFrame, preds: Sequence[str], y: str, lb: float = 0.0, ub: float = 1.0) -> dict[str, float]:
    g, b, c, _ = gram(df, preds, y)
    w, _ = solve_box_ls(g, b, c, lb, ub)
    return {p: float(x) for p, x in zip(preds, w)}


def apply_blend(tables: dict[str, DataFrame], weights: dict[str, float], key: str = "flight_id",
                pred: str = "tow", out: str = "tow") -> DataFrame:
    """Inner-join the per-model prediction tables on ``key`` and blend them."""
    names = list(tables)
    j = None
    for name in names:
        t = tables[name].select(key, F.col(pred).alias(f"{pred}_{name}"))
        j = t if j is None else j.join(t, key)
    blended = sum((F.col(f"{pred}_{n}") * F.lit(weights[n]) for n in names[1:]),
                  F.col(f"{pred}_{names[0]}") * F.lit(weights[names[0]]))
    return j.select(key, blended.alias(out))
