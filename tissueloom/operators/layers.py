"""Spot layers: aggregates per spot, rasters, and the frames behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def layer(m: DataFrame, spots: DataFrame, aggregate: Column) -> DataFrame:
    """Any aggregate of a spot's values, at the spot's place: spot_id, x, y, scale."""
    return m.groupBy("spot_id").agg(aggregate.alias("scale")).join(spots, "spot_id").select("spot_id", "x", "y", "scale")


def missing_spots(m: DataFrame, spots: DataFrame) -> DataFrame:
    """Spots of the matrix without a place; must be empty before layers are made."""
    return m.select("spot_id").distinct().join(spots, "spot_id", "left_anti")


def bounds(spots: DataFrame) -> DataFrame:
    """One row: offset and dimension of the layer."""
    return spots.agg(F.min("x").alias("offset_x"), F.min("y").alias("offset_y"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))


def relabel(m: DataFrame, spots: DataFrame) -> DataFrame:
    """Spot ids as ``x,y``."""
    return m.join(spots, "spot_id").select(F.concat_ws(",", F.col("x").cast("long").cast("string"), F.col("y").cast("long").cast("string")).alias("label"), "gene_id", "value")


def join_places(data: DataFrame, other: DataFrame, key: str = "xy") -> DataFrame:
    """All rows of ``data`` with what ``other`` holds under the same ``x,y`` label (nulls where it holds nothing)."""
    return data.join(other, key, "left")


def parse_label(df: DataFrame, column: str = "label") -> DataFrame:
    """``x,y`` back to two numbers; other strings give nulls."""
    parts = F.split(column, ",")
    return df.withColumn("x", F.get(parts, F.lit(0)).try_cast("double")).withColumn("y", F.get(parts, F.lit(1)).try_cast("double"))


def gene_layer(m: DataFrame, spots: DataFrame, gene: str) -> DataFrame:
    return m.where(F.col("gene_id") == gene).join(spots, "spot_id").select("x", "y", "value")


def pixels(spots: DataFrame, flag: str = "flag") -> DataFrame:
    return spots.select("x", "y", F.col(flag).alias("flag"))


def pitch(spots: DataFrame, column: str = "x", top: int = 10) -> DataFrame:
    """Spot pitch: the mean of the ``top`` largest steps between sorted coordinates, of equal ones too (0).

    Steps above 0 are those between distinct coordinates, which are few (a grid's rows or
    columns), so one window may order them; the other steps are counted.
    """
    steps = spots.select(column).distinct().withColumn("step", F.col(column) - F.lag(column).over(W.orderBy(column)))
    largest = steps.where("step is not null").orderBy(F.desc("step")).limit(top).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("_s"))
    n = spots.agg(F.count(column).alias("_n"))
    return largest.join(n).select(F.try_divide("_s", F.least(F.lit(top), F.col("_n") - 1)).alias("pitch"))


def scale_spots(spots: DataFrame, step: float) -> DataFrame:
    """Grid coordinates: over the pitch, rounded half to even."""
    return spots.withColumns({c: F.bround(F.col(c) / step).cast("long") for c in ("x", "y")})


def levels(df: DataFrame, value: str, n: int) -> DataFrame:
    """Adds ``level`` in 0..n-1: the value mapped linearly from its range."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(F.broadcast(span)).withColumn("level", F.floor(share * (n - 1)).cast("int")).drop("_lo", "_hi")


def overlay(*frames: DataFrame) -> DataFrame:
    """Of several layers of pixels (x, y, level), the highest level at each place."""
    out = frames[0].select("x", "y", "level")
    for f in frames[1:]:
        out = out.unionByName(f.select("x", "y", "level"))
    return out.groupBy("x", "y").agg(F.max("level").alias("level"))


def raster_density(points: DataFrame, grid: float) -> DataFrame:
    """Points per cell of a square grid from the smallest coordinates on."""
    low = points.agg(F.min("px").alias("_x"), F.min("py").alias("_y"))
    cell = lambda c, lo: F.floor((F.col(c) - F.col(lo)) / grid).cast("long")
    return points.join(F.broadcast(low)).groupBy(cell("px", "_x").alias("gx"), cell("py", "_y").alias("gy")).agg(F.count("*").alias("n"))


def raster_mean(points: DataFrame, grid: float, value: str, *channel: str) -> DataFrame:
    """Mean value per grid cell and channel; empty cells have no row (they read as 0)."""
    low = points.agg(F.min("px").alias("_x"), F.min("py").alias("_y"))
    cell = lambda c, lo: F.floor((F.col(c) - F.col(lo)) / grid).cast("long")
    return points.join(F.broadcast(low)).groupBy(cell("px", "_x").alias("gx"), cell("py", "_y").alias("gy"), *channel).agg(F.avg(value).alias("mean"))


def raster_sum(points: DataFrame, grid: float, value: str) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / grid).cast("long").alias("gx"), F.floor(F.col("y") / grid).cast("long").alias("gy")).agg(F.sum(value).alias("total"))


def patch_spots(cells: DataFrame, size: float, kind: str) -> DataFrame:
    """Cells as square patches, without those on the border lines: patch, cell type, count, and the patch's number of types."""
    low = cells.agg(F.min("px").alias("_x"), F.min("py").alias("_y"))
    gx, gy = (F.col("px") - F.col("_x")) / size, (F.col("py") - F.col("_y")) / size
    inside = cells.join(F.broadcast(low)).where((gx > F.floor(gx)) & (gy > F.floor(gy)))
    counted = inside.groupBy(F.floor(gx).cast("long").alias("gx"), F.floor(gy).cast("long").alias("gy"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    types = counted.groupBy("gx", "gy").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_cells"))
    return counted.join(types, ["gx", "gy"])


def annotations(df: DataFrame, label: str, palette: list[str]) -> DataFrame:
    """Adds the colour of each label: labels in order take the palette in turn.

    The labels are a dimension; it is numbered on its own and joined back.
    """
    names = df.select(label).distinct().withColumn("_k", F.row_number().over(W.orderBy(label)) - 1)
    colours = F.array(*(F.lit(c) for c in palette))
    return df.join(names.withColumn("color", F.get(colours, F.pmod("_k", F.lit(len(palette))).cast("int"))).drop("_k"), label)


def spatial_map(obs: DataFrame, classes: DataFrame, use_annotation: bool | None = None) -> DataFrame:
    """Cluster index to label and colour: annotation colours where there are any, else cluster colours."""
    own = F.coalesce("annotation_color", "cluster_color") if use_annotation is None else F.col("annotation_color" if use_annotation else "cluster_color")
    return obs.join(classes, "cluster").select("cell_id", "label", own.alias("color"))


def embedding_columns(df: DataFrame, vec: str, n: int, prefix: str) -> DataFrame:
    """The first n components of an array column as columns."""
    return df.select(*(c for c in df.columns if c != vec), *(F.get(vec, F.lit(k)).alias(f"{prefix}{k + 1}") for k in range(n)))


def remainder(theta: DataFrame, members: list) -> DataFrame:
    """Per pixel the members' shares, and what they leave of 1."""
    return theta.groupBy("pixel").agg(*(F.sum(F.when(F.col("topic") == m, F.col("p")).otherwise(0.0)).alias(f"t{k}") for k, m in enumerate(members)), (1 - F.sum(F.when(F.col("topic").isin(members), F.col("p")).otherwise(0.0))).alias("other"))


def velocity(points: DataFrame, scale: float = 1.0) -> DataFrame:
    """Arrows of a velocity plot: where each begins and ends, and its class."""
    return points.select("x", "y", (F.col("x") + scale * F.col("vx")).alias("x_end"), (F.col("y") + scale * F.col("vy")).alias("y_end"), "class")


def pie_slices(theta: DataFrame, spots: DataFrame) -> DataFrame:
    """Slices of each spot's pie, in topic order: the angles where they begin and end (turns)."""
    w = W.partitionBy("pixel").orderBy("topic").rowsBetween(W.unboundedPreceding, 0)
    cut = theta.withColumn("stop", F.sum("p").over(w))
    return cut.join(spots.select(F.col("spot_id").alias("pixel"), "x", "y"), "pixel").select("pixel", "x", "y", "topic", (F.col("stop") - F.col("p")).alias("start"), "stop")
