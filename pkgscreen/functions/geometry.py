"""SQL expression builders over line boxes (``a`` and ``b`` name two lines)."""

from __future__ import annotations


def centre_distance(a: str, b: str) -> str:
    dist = (f"sqrt(pow(({a}.x_min + {a}.x_max) / 2.0D - ({b}.x_min + {b}.x_max) / 2.0D, 2)"
            f" + pow(({a}.y_min + {a}.y_max) / 2.0D - ({b}.y_min + {b}.y_max) / 2.0D, 2))")
    return f"coalesce({dist}, double('Infinity'))"


def vertical_overlap(a: str, b: str) -> str:
    """Shared height over the shorter height; 0 when a box is missing."""
    shared = f"least({a}.y_max, {b}.y_max) - greatest({a}.y_min, {b}.y_min)"
    shorter = f"least(greatest(1, {a}.y_max - {a}.y_min), greatest(1, {b}.y_max - {b}.y_min))"
    missing = f"({a}.y_min IS NULL OR {b}.y_min IS NULL)"
    return f"CASE WHEN {missing} THEN 0.0D ELSE greatest(0.0D, ({shared}) / CAST({shorter} AS DOUBLE)) END"


def gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> str:
    return f"greatest(0, greatest({lo_a}, {lo_b}) - least({hi_a}, {hi_b}))"


def area(x0: str = "x_min", y0: str = "y_min", x1: str = "x_max", y1: str = "y_max") -> str:
    return f"(greatest(1, {y1} - {y0}) * greatest(1, {x1} - {x0}))"
