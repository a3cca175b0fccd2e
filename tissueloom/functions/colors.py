"""Colours as ``#RRGGBB`` strings: lighter, darker, transparent, and palettes."""

from __future__ import annotations

import colorsys
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: reference white (u', v') and the sRGB transfer curve ---------------------------
WHITE_U, WHITE_V = 0.1978398, 0.4683363
XYZ_TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))
# -------------------------------------------------------------------------------------------------


def _channels(color: Column) -> list[Column]:
    return [F.conv(F.substring(color, at, 2), 16, 10).cast("double") for at in (2, 4, 6)]


def _hex(levels: list[Column]) -> Column:
    """Levels in 0..255, rounded half up."""
    whole = [F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("long") for x in levels]
    return F.concat(F.lit("#"), *(F.lpad(F.hex(x), 2, "0") for x in whole))


def lighten(color: Column, factor: float = 0.5) -> Column:
    """Towards white by a share of the way."""
    if not 0 <= factor <= 1:
        raise ValueError("factor lies in 0..1")
    return _hex([x + (255 - x) * factor for x in _channels(color)])


def darken(color: Column, factor: float = 1.4) -> Column:
    """Each channel over the factor."""
    return _hex([x / factor for x in _channels(color)])


def transparent(color: Column, percent: float = 50) -> Column:
    """With an alpha channel behind: ``#RRGGBBAA``."""
    alpha = math.floor((100 - percent) * 255 / 100 + 0.5)
    return F.concat(F.upper(color), F.lit(f"{alpha:02X}"))


def hue_palette(n: int) -> list[str]:
    """n colours of equal lightness (65) and chroma (100), hues spread from 15 degrees on."""
    out = []
    for k in range(n):
        hue = math.radians(15 + 360 * k / n)
        light, chroma = 65.0, 100.0
        y = ((light + 16) / 116) ** 3
        u, v = chroma * math.cos(hue) / (13 * light) + WHITE_U, chroma * math.sin(hue) / (13 * light) + WHITE_V
        x = 9 * y * u / (4 * v)
        z = -x / 3 - 5 * y + 3 * y / v
        levels = []
        for row in XYZ_TO_RGB:
            c = row[0] * x + row[1] * y + row[2] * z
            c = 1.055 * c ** (1 / 2.4) - 0.055 if c > 0.00304 else 12.92 * c
            levels.append(math.floor(min(max(c, 0), 1) * 255 + 0.5))
        out.append("#{:02X}{:02X}{:02X}".format(*levels))
    return out


def rainbow(n: int, s: float = 1.0, v: float = 1.0) -> list[str]:
    """n colours of the hue circle from red on."""
    return ["#{:02X}{:02X}{:02X}".format(*(math.floor(c * 255 + 0.5) for c in colorsys.hsv_to_rgb(k / n, s, v))) for k in range(n)]


def factor_colors(df: DataFrame, column: str, least: int = 1, palette: list[str] | None = None, other: str = "#D3D3D3") -> DataFrame:
    """Adds the colour of each value, in the values' order; values of fewer than ``least`` rows and nulls take ``other``.

    Without a palette the colours are a rainbow of as many as there are values (a dimension: they reach the driver).
    """
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    values = [r[column] for r in sizes.select(column).orderBy(column).collect()]
    colours = palette or rainbow(len(values))
    table = df.sparkSession.createDataFrame(list(zip(values, colours, strict=False)), f"`{column}` {dict(df.dtypes)[column]}, color string")
    return df.join(table, column, "left").withColumn("color", F.coalesce("color", F.lit(other)))
