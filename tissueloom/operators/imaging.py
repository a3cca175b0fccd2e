"""Slide images: tiles, thresholds, cell regions, stain unmixing. Tiles are the unit of work."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import concave_hull, connected_regions, nnls, otsu

# --- fixed values: stain colours by antibody (RGB, 0..255) of the two immunofluorescence panels --
IHC1 = {"CD11b": (0, 0, 255), "CD11c": (0, 255, 0), "CD8": (255, 255, 0), "PanCK": (255, 0, 0), "Dapi": (200, 200, 200)}
IHC2 = {"CD3": (0, 255, 0), "CD4": (255, 255, 0), "CD20": (255, 0, 0), "CD45": (0, 255, 255), "CD68": (255, 0, 255), "Dapi": (0, 0, 255)}
# ---------------------------------------------------------------------------------------------------


def max_levels(width: Column, height: Column) -> Column:
    """Halvings down to one pixel, at least 1."""
    return F.greatest(F.ceil(F.log2(F.greatest(width, height).cast("double"))), F.lit(1)).cast("int")


def tile_bounds(tiles: DataFrame, width: int, height: int, size: int, overlap: int) -> DataFrame:
    """Adds left, top, w, h (pixels of the tile's own level) to tiles (level, col, row)."""
    top = max(1, math.ceil(math.log2(max(width, height, 2))))
    scale = F.pow(F.lit(2.0), F.lit(top) - F.col("level"))
    full_w, full_h = F.ceil(F.lit(width) / scale), F.ceil(F.lit(height) / scale)
    left = F.greatest(F.col("col") * size - F.when(F.col("col") > 0, overlap).otherwise(0), F.lit(0))
    up = F.greatest(F.col("row") * size - F.when(F.col("row") > 0, overlap).otherwise(0), F.lit(0))
    right, down = F.least((F.col("col") + 1) * size + overlap, full_w), F.least((F.col("row") + 1) * size + overlap, full_h)
    return tiles.withColumns({"left": left.cast("long"), "top": up.cast("long"), "w": (right - left).cast("long"), "h": (down - up).cast("long")})


def drop_blank(tiles: DataFrame) -> DataFrame:
    """Without tiles whose pixels are all alike (``pixels``: array of levels)."""
    return tiles.where(F.array_min("pixels") != F.array_max("pixels"))


def channels(pixels: DataFrame) -> DataFrame:
    """Packed 0xRRGGBB to r, g, b."""
    rgb = F.col("rgb").cast("long")
    return pixels.withColumns({"r": F.shiftright(rgb, 16).bitwiseAND(255), "g": F.shiftright(rgb, 8).bitwiseAND(255), "b": rgb.bitwiseAND(255)})


def flip(pixels: DataFrame, column: str = "level") -> DataFrame:
    return pixels.withColumn(column, 255 - F.col(column))


def global_scale(tiles: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Pixels of each channel mapped from the range over all its tiles onto [low, high]."""
    span = tiles.groupBy("channel").agg(F.min(F.array_min("pixels")).alias("_lo"), F.max(F.array_max("pixels")).alias("_hi"))
    share = lambda p: F.coalesce(F.try_divide(p - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return tiles.join(F.broadcast(span), "channel").withColumn("pixels", F.transform("pixels", lambda p: share(p) * (high - low) + low)).drop("_lo", "_hi")


def histogram(tiles: DataFrame) -> DataFrame:
    """256 bins over all tiles, by the levels' floor."""
    return tiles.select(F.explode("pixels").alias("p")).groupBy(F.floor(F.least(F.greatest("p", F.lit(0)), F.lit(255))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu_threshold(tiles: DataFrame) -> int:
    """One threshold for all tiles; 256 counts reach the driver."""
    h = np.zeros(256)
    for r in histogram(tiles).collect():
        h[r["bin"]] = r["n"]
    return otsu(h)


CELLS = "tile_id string, label long, x double, y double, physical_x double, physical_y double, area double, ratio double, points long, r1 double, r2 double, theta double, weight double, scan_x array<double>, scan_y array<double>"


def scan_cells(tiles: DataFrame, threshold: float, dark: bool = True, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Connected regions of each tile (tile_id, left, top, w, pixels) as cells with their shape.

    ``dark``: cells are at or below the threshold. Angle and radii come from the region's second
    moments, the weight is the mean level over 255, the polygon the region's concave hull.
    """

    def run(frames):
        for frame in frames:
            out = []
            for t in frame.itertuples():
                img = np.asarray(t.pixels, float).reshape(-1, int(t.w))
                label = connected_regions(img <= threshold if dark else img > threshold)
                place = np.flatnonzero(label.ravel())
                place = place[np.argsort(label.ravel()[place], kind="stable")]
                each = np.split(place, np.cumsum(np.bincount(label.ravel()[place])[1:])[:-1]) if len(place) else []
                for k, own in enumerate(each, 1):
                    ys, xs = np.divmod(own, img.shape[1])
                    cov = np.cov(np.c_[xs, ys].T) if len(xs) > 1 else np.zeros((2, 2))
                    val, vec = np.linalg.eigh(cov)
                    r1, r2 = 2 * math.sqrt(max(val[1], 0)) + 0.5, 2 * math.sqrt(max(val[0], 0)) + 0.5
                    box = (np.ptp(xs) + 1) * (np.ptp(ys) + 1)
                    hull = concave_hull(np.c_[xs, ys])
                    theta = math.atan2(vec[1, 1], vec[0, 1]) % math.pi
                    x, y = xs.mean(), ys.mean()
                    out.append((t.tile_id, k, x, y, x + t.left + offset[0], y + t.top + offset[1], float(box), len(xs) / box, len(xs), r1, r2, theta, img[ys, xs].mean() / 255, hull[:, 0].astype(float), hull[:, 1].astype(float)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CELLS.split(", ")])

    return tiles.select("tile_id", "left", "top", "w", "pixels").mapInPandas(run, CELLS)


def shape_points(cells: DataFrame, physical: bool = False) -> DataFrame:
    """Polygon points in the tile's coordinates, or the slide's."""
    dx, dy = (F.col("physical_x") - F.col("x"), F.col("physical_y") - F.col("y")) if physical else (F.lit(0.0), F.lit(0.0))
    return cells.select("tile_id", "label", F.posexplode(F.arrays_zip("scan_x", "scan_y")).alias("k", "p"), dx.alias("dx"), dy.alias("dy")).select("tile_id", "label", "k", (F.col("p.scan_x") + F.col("dx")).alias("x"), (F.col("p.scan_y") + F.col("dy")).alias("y"))


def split_large(cells: DataFrame, radius: float) -> DataFrame:
    """Cells of more than the mean points, as parts around a jittered grid of the given radius; others stay.

    The jitter is a hash of the cell and grid place, so results do not depend on partitions.
    """
    mean = cells.agg(F.avg("points").alias("_m"))
    marked = cells.join(F.broadcast(mean)).withColumn("_large", F.col("points") > F.col("_m")).drop("_m")
    n = F.greatest(F.ceil(F.sqrt(F.col("area")) / (2 * radius)), F.lit(1)).cast("int")
    jitter = lambda k: (F.pmod(F.xxhash64("tile_id", "label", "i", "j", F.lit(k)), F.lit(1000)) / 1000.0 - 0.5) * radius / 2
    parts = marked.where("_large").withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c, k, s: F.col(c) + (F.col(k) - (F.col("_n") - 1) / 2) * 2 * radius + jitter(s)
    split = parts.withColumns({"physical_x": at("physical_x", "i", 1), "physical_y": at("physical_y", "j", 2), "points": (F.col("points") / (F.col("_n") ** 2)).cast("long"), "area": F.col("area") / F.col("_n") ** 2})
    return marked.where("not _large").drop("_large").unionByName(split.select(*cells.columns))


def unmix(pixels: DataFrame, panel: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Per pixel (r, g, b) the non-negative amount of each stain: adds a column for each antibody."""
    names = list(panel)
    a = np.array([panel[n] for n in names], float).T / 255

    def run(frames):
        for f in frames:
            rgb = f[["r", "g", "b"]].to_numpy(float) / 255
            known, inverse = np.unique(rgb, axis=0, return_inverse=True)
            got = np.array([nnls(a, v) for v in known]).reshape(-1, len(names))[inverse.ravel()]
            yield f.assign(**{n: got[:, k] for k, n in enumerate(names)})

    schema = ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes) + "".join(f", `{n}` double" for n in names)
    return pixels.mapInPandas(run, schema)


def unmixed_tiles(pixels: DataFrame, panel: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Each antibody's own layer in long form: (tile_id, x, y, antibody, level)."""
    got = unmix(pixels, panel)
    return got.select("tile_id", "x", "y", F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in panel)), F.array(*panel))).alias("antibody", "level"))


def cell_stains(cells: DataFrame, pixels: DataFrame, panel: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Mean stain of each antibody over a cell's pixels: (cell, antibody map). cells: (cell, tile_id, x, y) pixels."""
    got = unmix(cells.join(pixels, ["tile_id", "x", "y"]), panel)
    means = got.groupBy("cell").agg(*(F.avg(n).alias(n) for n in panel))
    return means.select("cell", F.map_from_arrays(F.array(*(F.lit(n) for n in panel)), F.array(*panel)).alias("antibody"))
