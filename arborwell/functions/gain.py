"""Gain and weight of gradient pairs, as columns. p: GBDTParams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GBDTParams


def soft(g: Column, alpha: float) -> Column:
    """g drawn towards 0 by alpha."""
    return g if alpha == 0 else F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def weight(g: Column, h: Column, p: GBDTParams) -> Column:
    w = -soft(g, p.reg_alpha) / (h + p.lam)
    if p.max_leaf_weight:
        w = F.greatest(F.least(w, F.lit(p.max_leaf_weight)), F.lit(-p.max_leaf_weight))
    return F.when((h >= p.min_child_weight) & (g != 0), w).otherwise(0.0)


def gain(g: Column, h: Column, p: GBDTParams) -> Column:
    if p.max_leaf_weight == 0:
        s = soft(g, p.reg_alpha)
        v = s * s / (h + p.lam)
    else:
        w = weight(g, h, p)
        v = -2.0 * (g * w + 0.5 * (h + p.lam) * w * w + (p.reg_alpha * F.abs(w) if p.reg_alpha else F.lit(0.0)))
    return F.when((h >= p.min_child_weight) & (g != 0), v).otherwise(0.0)


def satisfies(hs: list[Column], p: GBDTParams) -> Column:
    """Enough Hessian for a node: the value for one output, the product for several."""
    if p.min_child_weight == 0:
        return F.lit(True)
    product = hs[0]
    for h in hs[1:]:
        product = product * h
    return product >= p.min_child_weight


def gain_of(gs: list[Column], hs: list[Column], p: GBDTParams) -> Column:
    """Gain of a node with one or several outputs (mean over outputs)."""
    if len(gs) == 1:
        return gain(gs[0], hs[0], p)
    total, small = F.lit(0.0), F.lit(True)
    for g, h in zip(gs, hs, strict=True):
        s = soft(g, p.reg_alpha)
        total = total + s * s / (h + p.lam)
        small = small & (F.abs(g) <= 1e-8)
    return F.when(satisfies(hs, p) & ~small, total / float(len(gs))).otherwise(0.0)
