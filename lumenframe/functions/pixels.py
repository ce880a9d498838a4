"""Pixel arithmetic on integer columns b, g, r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey_shift() -> Column:
    return F.expr("shiftright(r * 38 + g * 75 + b * 15, 7)")


def grey_percent() -> Column:
    return F.expr("(r * 30 + g * 59 + b * 11 + 50) div 100")


def rgb565() -> Column:
    return F.expr("shiftleft(shiftright(r, 3), 11) | shiftleft(shiftright(g, 2), 5) | shiftright(b, 3)")


def unpack565(c: str) -> dict[str, Column]:
    return {"r": F.expr(f"shiftleft(shiftright({c}, 11) & 31, 3)"), "g": F.expr(f"shiftleft(shiftright({c}, 5) & 63, 2)"), "b": F.expr(f"shiftleft({c} & 31, 3)")}


def skin_rgb() -> Column:
    """Red stands out under even light, or all channels are bright and blue is the least under side light."""
    even = "r > 95 AND g > 40 AND b > 20 AND r - b > 15 AND r - g > 15"
    side = "r > 200 AND g > 210 AND b > 170 AND abs(r - b) <= 15 AND b < least(r, g)"
    return F.expr(f"({even}) OR ({side})")


def rgba4444(a: int = 255) -> Column:
    return F.expr(f"shiftleft(shiftright(r, 4), 12) | shiftleft(shiftright(g, 4), 8) | shiftleft(shiftright(b, 4), 4) | {a >> 4}")


def unpack4444(c: str) -> dict[str, Column]:
    return {k: F.expr(f"shiftleft(shiftright({c}, {s}) & 15, 4)") for k, s in (("r", 12), ("g", 8), ("b", 4), ("a", 0))}


def rgba8888(a: int = 255) -> Column:
    return F.expr(f"shiftleft({a}L, 24) | shiftleft(CAST(r AS BIGINT), 16) | shiftleft(g, 8) | b")


def unpack8888(c: str) -> dict[str, Column]:
    return {k: F.expr(f"shiftright({c}, {s}) & 255") for k, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))}


def skin_rg() -> Column:
    """Between two parabolas of the plane of red and green shares, and away from white."""
    # Coefficients of the parabolas.
    up, down = "(-1.8423D * q * q + 1.5294D * q + 0.0422D)", "(-0.7279D * q * q + 0.6066D * q + 0.1766D)"
    text = f"p < {up} AND p > {down} AND (q - 0.33D) * (q - 0.33D) + (p - 0.33D) * (p - 0.33D) > 0.004D"
    share = lambda c: f"coalesce(try_divide(CAST({c} AS DOUBLE), r + g + b), 0.0D)"
    return F.expr(text.replace("q", share("r")).replace("p ", share("g") + " ").replace("(p", "(" + share("g")))


def ycrcb() -> dict[str, Column]:
    """Luma and the red and blue differences, in the usual 14-bit integer arithmetic."""
    y = "shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)"
    return {"luma": F.expr(y), "cr": F.expr(f"shiftright((r - {y}) * 11682 + shiftleft(128, 14) + 8192, 14)"), "cb": F.expr(f"shiftright((b - {y}) * 9241 + shiftleft(128, 14) + 8192, 14)")}


def skin_ycrcb() -> Column:
    c = ycrcb()
    return c["cr"].between(133, 173) & c["cb"].between(77, 127)


def hue() -> Column:
    """Hue in degrees, 0 for greys; red wins ties over green, and green over blue."""
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    d = f"CAST({top} - {low} AS DOUBLE)"
    raw = f"CASE WHEN {top} = {low} THEN 0.0D WHEN r = {top} THEN 60.0D * (g - b) / {d} WHEN g = {top} THEN 120.0D + 60.0D * (b - r) / {d} ELSE 240.0D + 60.0D * (r - g) / {d} END"
    return F.expr(f"CASE WHEN {raw} < 0 THEN {raw} + 360.0D ELSE {raw} END")


def skin_hsv() -> Column:
    """Half of the hue, rounded, between 7 and 29."""
    return (F.floor(hue() / 2 + 0.5) % 180).between(7, 29)


def hsl_bin() -> Column:
    """One of 16 x 4 x 4 bins of hue, saturation and lightness."""
    top, low = F.expr("greatest(r, g, b) / 255.0D"), F.expr("least(r, g, b) / 255.0D")
    light = (top + low) / 2
    room = F.when(light <= 0.5, top + low).otherwise(2 - top - low)
    s = F.coalesce((top - low) / F.nullif(room, F.lit(0.0)), F.lit(0.0))
    part = lambda x, n: F.least(F.floor(x * n).cast("int"), F.lit(n - 1))
    return part(hue() / 360, 16) * 16 + part(s, 4) * 4 + part(light, 4)


def lab() -> dict[str, Column]:
    """Lightness and the two opponents, the latter shifted by 128."""
    # The public matrix from RGB to XYZ, and the white point.
    x = (0.412453 * F.col("r") + 0.357580 * F.col("g") + 0.180423 * F.col("b")) / (255.0 * 0.950456)
    y = (0.212671 * F.col("r") + 0.715160 * F.col("g") + 0.072169 * F.col("b")) / 255.0
    z = (0.019334 * F.col("r") + 0.119193 * F.col("g") + 0.950227 * F.col("b")) / (255.0 * 1.088754)
    f = lambda v: F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16.0 / 116.0)
    return {"l": F.when(y > 0.008856, 116.0 * F.pow(y, F.lit(1 / 3)) - 16.0).otherwise(903.3 * y), "a": 500.0 * (f(x) - f(y)) + 128.0, "bb": 200.0 * (f(y) - f(z)) + 128.0}
