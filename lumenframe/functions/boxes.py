"""Box geometry as Column expressions. A box is four columns x1, y1, x2, y2; arguments are SQL prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def _overlap(a: str, b: str, plus: int) -> tuple[str, str]:
    w = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1) + {plus})"
    h = f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1) + {plus})"
    return w, h


def _area(a: str, plus: int) -> str:
    return f"(({a}x2 - {a}x1 + {plus}) * ({a}y2 - {a}y1 + {plus}))"


def iou_sql(a: str, b: str, mode: str) -> str:
    """Intersection over union.

    augment: one pixel is added to the overlap but not to areas, and empty boxes give 0;
    eval: one pixel is added throughout; nms: as eval, if the areas exceed the overlap;
    exact: no pixel is added.
    """
    plus = 0 if mode == "exact" else 1
    own = 0 if mode in ("augment", "exact") else 1
    w, h = _overlap(a, b, plus)
    areas = f"({_area(a, own)} + {_area(b, own)})"
    met = f"{w} > 0 AND {h} > 0"
    if mode == "augment":
        met += f" AND {_area(a, 0)} > 0 AND {_area(b, 0)} > 0"
    if mode != "eval":
        met += f" AND {areas} > {w} * {h}"
    return f"CASE WHEN {met} THEN CAST({w} * {h} AS DOUBLE) / ({areas} - {w} * {h}) ELSE 0.0D END"


def iou(a: str, b: str, mode: str = "eval") -> Column:
    return F.expr(iou_sql(a, b, mode))


def min_side(least: int) -> Column:
    return F.expr(f"x2 - x1 >= {least} AND y2 - y1 >= {least}")


def sane(width: int, height: int, side: int = 16, ratio: float = 0.2) -> Column:
    """In the image, not small, and neither side below a share of the other."""
    return F.expr(f"x1 >= 0 AND y1 >= 0 AND x2 <= {width} AND y2 <= {height} AND x2 - x1 >= {side} AND y2 - y1 >= {side} AND x2 - x1 >= {ratio} * (y2 - y1) AND y2 - y1 >= {ratio} * (x2 - x1)")


def clamped(width: int, height: int) -> dict[str, Column]:
    top = {"x1": width, "y1": height, "x2": width, "y2": height}
    return {c: F.greatest(F.lit(0), F.least(F.col(c), F.lit(m - 1))).alias(c) for c, m in top.items()}


def rescaled(ratio_x: float, ratio_y: float | None = None) -> dict[str, Column]:
    """Coordinates of a resized image in the original, rounded half up."""
    r = {"x": ratio_x, "y": ratio_x if ratio_y is None else ratio_y}
    return {c: F.floor(F.col(c) / F.lit(r[c[0]]) + 0.5).cast("int") for c in SIDES}


def decoded(width: int, height: int) -> dict[str, Column]:
    """Corners of a box moved by its deltas dx, dy, dw, dh and clipped to the image, truncated."""
    out = {}
    for axis, size, low, high in (("x", width, "x1", "x2"), ("y", height, "y1", "y2")):
        d, s = ("dx", "dw") if axis == "x" else ("dy", "dh")
        side = f"({high} - {low} + 1.0D)"
        centre, half = f"({low} + 0.5D * {side} + {side} * {d})", f"0.5D * {side} * exp({s})"
        for name, sign in ((low, "-"), (high, "+")):
            out[name] = F.expr(f"CAST(greatest(least({centre} {sign} {half}, {size - 1}.0D), 0.0D) AS INT)")
    return out


def corners_from_size(x: str, y: str, w: str, h: str) -> dict[str, Column]:
    return {"x1": F.col(x), "y1": F.col(y), "x2": F.col(x) + F.col(w), "y2": F.col(y) + F.col(h)}
