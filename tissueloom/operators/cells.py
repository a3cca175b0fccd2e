"""Cells: identity, filters, geometry, neighbourhoods, matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import two_sided
from ..sources.staging import stored


def cell_guid(tile: str = "tile", px: str = "px", py: str = "py") -> Column:
    """md5 of ``tile-px-py``, coordinates rounded half to even."""
    return F.md5(F.concat_ws("-", F.col(tile).cast("string"), F.bround(px).cast("long").cast("string"), F.bround(py).cast("long").cast("string")))


def antibody(cells: DataFrame, name: str, wrap: bool = False) -> DataFrame:
    """One antibody's signal (0 where absent): as a column, or with ``wrap`` in place of weight."""
    signal = F.coalesce(F.try_element_at("antibody", F.lit(name)), F.lit(0.0))
    return cells.withColumn("weight" if wrap else "signal", signal)


def antibody_names(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(F.map_keys("antibody")).alias("name")).distinct()


def any_signal(cells: DataFrame) -> DataFrame:
    """Without cells all of whose antibodies are 0 or below."""
    return cells.where(F.exists(F.map_values("antibody"), lambda v: v > 0))


def filter_noise(cells: DataFrame, noise: float = 0.25) -> DataFrame:
    """Without cells of few points (up to the rounded quantile) and without area or weight."""
    cut = cells.agg(F.bround(F.percentile("points", F.lit(noise))).cast("long").alias("_cut"))
    good = lambda c: ~F.isnan(c) & (F.col(c) > 0)
    return cells.join(F.broadcast(cut)).where((F.col("points") > F.col("_cut")) & good("area") & good("weight")).drop("_cut")


def transform_points(df: DataFrame, theta: float, t: tuple[float, float], s: tuple[float, float], x: str = "px", y: str = "py") -> DataFrame:
    """Scale, then rotate, then translate."""
    sx, sy = F.col(x) * s[0], F.col(y) * s[1]
    c, n = math.cos(theta), math.sin(theta)
    return df.withColumns({x: sx * c - sy * n + t[0], y: sx * n + sy * c + t[1]})


def tabular(cells: DataFrame, antibodies: list[str]) -> DataFrame:
    """Scalar columns, and one column for each antibody (0 where absent)."""
    scalar = [c for c, kind in cells.dtypes if not kind.startswith(("map", "array", "struct"))]
    return cells.select(*scalar, *(F.coalesce(F.try_element_at("antibody", F.lit(a)), F.lit(0.0)).alias(a) for a in antibodies))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting; a point level with an edge's top counts as in its span."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 == y2:
            continue
        crosses = (y > min(y1, y2)) & (y <= max(y1, y2)) & (x <= max(x1, x2))
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crosses = crosses & ((F.lit(x1 == x2)) | (x <= at))
        inside = inside != crosses
    return inside


def label_cells(cells: DataFrame, regions: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Adds the label of the last region that holds the cell (null in none)."""
    label = F.lit(None).cast("string")
    for name, polygon in regions.items():
        label = F.when(in_polygon(F.col("px"), F.col("py"), polygon), name).otherwise(label)
    return cells.withColumn("region", label)


def export_labelled(cells: DataFrame, label: str = "region") -> DataFrame:
    """Labelled cells, coordinates from the smallest ones on."""
    kept = cells.where(F.col(label).isNotNull() & (F.col(label) != ""))
    low = kept.agg(F.min("px").alias("_x"), F.min("py").alias("_y"))
    return kept.join(F.broadcast(low)).withColumns({"px": F.col("px") - F.col("_x"), "py": F.col("py") - F.col("_y")}).drop("_x", "_y")


def range_pairs(a: DataFrame, b: DataFrame, radius: float, x: str = "px", y: str = "py", key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within a radius, by grid buckets: id_a, id_b, distance, and the columns ``keep`` of ``b``.

    Each point of ``b`` goes to its own bucket and the eight around it; pairs meet on equal
    buckets only, and every pair once. Both sides are shuffled: the planner's size of a compressed
    file knows nothing of the nine buckets, and would broadcast a table that the driver can't hold.
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(F.col(key).alias("id_a"), F.col(x).alias("_xa"), F.col(y).alias("_ya"), bucket(x).alias("_bx"), bucket(y).alias("_by"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    right = b.select(F.col(key).alias("id_b"), F.col(x).alias("_xb"), F.col(y).alias("_yb"), bucket(x).alias("_ox"), bucket(y).alias("_oy"), near.alias("_d"), *keep)
    right = right.select("id_b", *keep, "_xb", "_yb", (F.col("_ox") + F.col("_d.i")).alias("_bx"), (F.col("_oy") + F.col("_d.j")).alias("_by"))
    d = F.sqrt((F.col("_xa") - F.col("_xb")) ** 2 + (F.col("_ya") - F.col("_yb")) ** 2)
    return left.join(right.hint("merge"), ["_bx", "_by"]).withColumn("distance", d).where(F.col("distance") <= radius).select("id_a", "id_b", "distance", *keep)


def median_radius(cells: DataFrame) -> DataFrame:
    """Median of the mean of r1 and r2, at least 5."""
    return cells.agg(F.greatest(F.median((F.col("r1") + F.col("r2")) / 2), F.lit(5.0)).alias("radius"))


def neighbourhood(cells: DataFrame, radius: float, k: int) -> DataFrame:
    """Per cell: neighbours within the radius (the nearest k), their share of k, and mean distance."""
    pairs = range_pairs(cells, cells, radius).where("id_a <> id_b")
    kept = pairs.withColumn("_r", F.row_number().over(W.partitionBy("id_a").orderBy("distance", "id_b"))).where(F.col("_r") <= k)
    stats = kept.groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("neighbours"), F.avg("distance").alias("mean_distance"))
    return cells.join(stats, "id", "left").withColumns({"neighbours": F.coalesce("neighbours", F.lit(0)), "density": F.coalesce("neighbours", F.lit(0)) / k, "mean_distance": F.coalesce("mean_distance", F.lit(0.0))})


def cell_moran(cells: DataFrame, radius: float, k: int = 16) -> DataFrame:
    """Per cell Moran's I of ``ratio`` over itself and its nearest within the radius (k in all), weights 1 / distance.

    Returns id, neighbours (itself included), density = neighbours / k, mean_distance, moran, p (two-sided,
    normal, randomisation variance). Where there is no I (equal ratios, a lone cell) it is the table's
    smallest, where there is no variance p is 1; pairs at one place have no weight.
    """
    near = range_pairs(cells, cells, radius, keep=("px", "py", "ratio"))
    kept = near.withColumn("_r", F.row_number().over(W.partitionBy("id_a").orderBy("distance", "id_b"))).where(F.col("_r") <= k)
    rows = kept.groupBy(F.col("id_a").alias("id")).agg(F.sort_array(F.collect_list(F.struct("distance", "id_b", "px", "py", "ratio"))).alias("near"))
    flat = rows.select("id", *(F.col(f"near.{c}").alias(c) for c in ("distance", "px", "py", "ratio")))

    def run(frames):
        for f in frames:
            out = []
            for i, d, px, py, ratio in zip(f["id"], f["distance"], f["px"], f["py"], f["ratio"], strict=True):
                out.append((i, len(d), len(d) / k, float(np.mean(d)), *_moran(np.asarray(ratio, float), np.asarray(px, float), np.asarray(py, float))))
            yield pd.DataFrame(out, columns=["id", "neighbours", "density", "mean_distance", "moran", "z"])

    found = stored(flat.mapInPandas(run, "id long, neighbours int, density double, mean_distance double, moran double, z double"), "cell-moran")
    clean = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
    least = found.agg(F.coalesce(F.min(clean("moran")), F.lit(0.0)).alias("_m"))
    p = F.coalesce(two_sided(clean("z")), F.lit(1.0))
    return found.join(F.broadcast(least)).select("id", "neighbours", "density", "mean_distance", F.coalesce(clean("moran"), F.col("_m")).alias("moran"), p.alias("p"))


def _moran(x: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[float, float]:
    """Moran's I with weights 1 / distance, and its z value; NaN where there is none."""
    n = len(x)
    d = np.hypot(px[:, None] - px, py[:, None] - py)
    w = np.divide(1, d, out=np.zeros_like(d), where=d > 0)
    c, total = x - x.mean(), w.sum()
    square = (c**2).sum()
    if square < 1e-20 or total == 0:
        return math.nan, math.nan
    moran = n * (c @ w @ c) / (total * square)
    if n < 4:
        return moran, math.nan
    expected = -1 / (n - 1)
    s1, s2, s3 = ((2 * w) ** 2).sum() / 2, ((2 * w.sum(1)) ** 2).sum(), n * (c**4).sum() / square**2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * total**2) - s3 * ((n * n - n) * s1 - 2 * n * s2 + 6 * total**2)) / ((n - 1) * (n - 2) * (n - 3) * total**2) - expected**2
    return moran, (moran - expected) / math.sqrt(var) if var > 0 else math.nan


def similarity(a: str, b: str, column: str) -> Column:
    p, q = F.col(f"{a}.{column}"), F.col(f"{b}.{column}")
    return 1 - F.abs(p - q) / (F.greatest(p, q) + 0.001)


def morphology(a: str = "a", b: str = "b") -> Column:
    """.3 area + .3 ratio + .2 density + .2 weight."""
    return 0.3 * similarity(a, b, "area") + 0.3 * similarity(a, b, "ratio") + 0.2 * similarity(a, b, "density") + 0.2 * similarity(a, b, "weight")


def match_candidates(a: DataFrame, b: DataFrame, max_distance: float, k: int = 16, w_distance: float = 0.7, w_morph: float = 0.3) -> DataFrame:
    """Each cell's k nearest of the other slice within the distance, scored."""
    near = range_pairs(a, b, max_distance)
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("id_a").orderBy("distance", "id_b"))).where(F.col("_r") <= k).drop("_r")
    shape = ("id", "area", "ratio", "density", "weight")
    scored = near.join(a.select(F.col("id").alias("id_a"), F.struct(*shape).alias("a")), "id_a").join(b.select(F.col("id").alias("id_b"), F.struct(*shape).alias("b")), "id_b")
    score = w_distance * F.greatest(F.lit(0.0), 1 - F.col("distance") / max_distance) + w_morph * F.col("morphology")
    return scored.withColumn("morphology", morphology()).withColumn("score", score).select("id_a", "id_b", "distance", "morphology", "score")


def greedy_matches(candidates: DataFrame, least: float = 0.3, stage=stored) -> DataFrame:
    """One-to-one matches by falling score (ties: smallest ids), in rounds of mutual bests.

    A pair that is best for both its cells is what the greedy scan would take next; each round
    takes all such pairs and drops their cells. ``stage`` cuts the lineage between rounds (by default, by storing).
    """
    left, out = stage(candidates.where(F.col("score") > least)), None
    best = lambda key, other: F.max_by(other, F.struct("score", -F.col("id_a"), -F.col("id_b"))).alias(other)
    while not left.isEmpty():
        by_a = left.groupBy("id_a").agg(best("id_a", "id_b"))
        by_b = left.groupBy("id_b").agg(best("id_b", "id_a"))
        taken = stage(left.join(by_a, ["id_a", "id_b"], "left_semi").join(by_b, ["id_a", "id_b"], "left_semi"))
        out = taken if out is None else out.unionByName(taken)
        left = stage(left.join(taken.select("id_a"), "id_a", "left_anti").join(taken.select("id_b"), "id_b", "left_anti"))
    return out if out is not None else left


def match_statistics(matches: DataFrame) -> DataFrame:
    return matches.agg(F.countDistinct("id_a").alias("n_a"), F.countDistinct("id_b").alias("n_b"), F.avg("distance").alias("mean_distance"), F.avg("score").alias("mean_score"))


def line_shape(points: DataFrame) -> DataFrame:
    """Per cell the least-squares line's angle in [0, pi), its length over the x range and the farthest point's distance.

    points: (cell, x, y). Cells with one x have an upright line.
    """
    fit = points.groupBy("cell").agg(F.regr_slope("y", "x").alias("k"), F.regr_intercept("y", "x").alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("y").alias("ylo"), F.max("y").alias("yhi"), F.avg("x").alias("mx"))
    upright = F.col("k").isNull()
    far = F.when(upright, F.abs(F.col("x") - F.col("mx"))).otherwise(F.abs(F.col("k") * F.col("x") - F.col("y") + F.col("b")) / F.sqrt(F.col("k") ** 2 + 1))
    joined = points.join(fit, "cell").groupBy("cell").agg(F.max(far).alias("r2"), *(F.first(c).alias(c) for c in ("k", "lo", "hi", "ylo", "yhi")))
    angle = F.when(F.col("k").isNull(), math.pi / 2).otherwise(F.atan("k") + F.when(F.col("k") < 0, math.pi).otherwise(0.0))
    length = F.when(F.col("k").isNull(), F.col("yhi") - F.col("ylo")).otherwise((F.col("hi") - F.col("lo")) * F.sqrt(1 + F.col("k") ** 2))
    return joined.select("cell", angle.alias("theta"), length.alias("r1"), "r2")


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """Rows of the most frequent value (ties: smallest)."""
    top = df.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(1).select(column)
    return df.join(F.broadcast(top), column, "left_semi")


def tag_union(**slices: DataFrame) -> DataFrame:
    """Slices one below the other with a class column."""
    out = None
    for name, df in slices.items():
        tagged = df.withColumn("class", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
