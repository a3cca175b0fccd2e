"""Queries of spot layers and the frames behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as L
from ..operators import matrix as M
from . import views as V
from .catalog import query

ES = {"e": V.EXPR, "s": V.SPOTS}
R = lambda c, d=6: F.round(c, d)


@query("sum_layer", V.with_views("select spot_id, x, y, sum(value) as total from e join s using (spot_id) group by all", **ES))
def sum_layer(spark, sf_dir):
    return L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), F.sum("value")).withColumnRenamed("scale", "total")


@query("max_layer", V.with_views("select spot_id, x, y, max(value) as scale from e join s using (spot_id) group by all", **ES))
def max_layer(spark, sf_dir):
    return L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), F.max("value"))


@query("custom_layer", V.with_views("select spot_id, x, y, round(stddev_pop(value), 6) as scale from e join s using (spot_id) group by all", **ES))
def custom_layer(spark, sf_dir):
    return L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), R(F.stddev_pop("value")))


@query("layer_bounds", V.with_views("select min(x) as offset_x, min(y) as offset_y, max(x) - min(x) as width, max(y) - min(y) as height from s", s=V.SPOTS))
def layer_bounds(spark, sf_dir):
    return L.bounds(V.spots(spark, sf_dir))


@query("missing_spots", V.with_views("select distinct spot_id from e where spot_id not in (select spot_id from s where x <> 3)", **ES))
def missing_spots(spark, sf_dir):
    return L.missing_spots(V.expr(spark, sf_dir), V.spots(spark, sf_dir).where("x <> 3"))


@query("relabel_spots", V.with_views("select x::bigint || ',' || y::bigint as label, gene_id, value from e join s using (spot_id)", **ES))
def relabel_spots(spark, sf_dir):
    return L.relabel(V.expr(spark, sf_dir), V.spots(spark, sf_dir))


@query("parse_labels", V.with_views("select distinct x::bigint || ',' || y::bigint as label, x, y from s", s=V.SPOTS))
def parse_labels(spark, sf_dir):
    labels = V.spots(spark, sf_dir).select(F.concat_ws(",", F.col("x").cast("long").cast("string"), F.col("y").cast("long").cast("string")).alias("label")).distinct()
    return L.parse_label(labels)


@query("gene_layer", V.with_views("select x, y, value from e join s using (spot_id) where gene_id = 'Brand#7'", **ES))
def gene_layer(spark, sf_dir):
    return L.gene_layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), "Brand#7")


@query("spot_pixels", "select cast(s_suppkey % 10 as double) as x, cast(s_suppkey // 10 as double) as y, s_nationkey % 2 as flag from supplier")
def spot_pixels(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), (F.col("s_nationkey") % 2).alias("in_tissue"))
    return L.pixels(V.spots(spark, sf_dir).join(s, "spot_id"), "in_tissue")


@query("spot_pitch", "with c as (select p_size::double as x from part union all select 1000.0 + n_nationkey * n_nationkey from nation), d as (select x - lag(x) over (order by x) as step from c) select round(avg(step), 6) as pitch from (select step from d where step is not null order by step desc limit 40)")
def spot_pitch(spark, sf_dir):
    x = V.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"))
    far = V.table(spark, sf_dir, "nation").select((1000.0 + F.col("n_nationkey") * F.col("n_nationkey")).alias("x"))
    return L.pitch(x.unionByName(far), top=40).select(R("pitch").alias("pitch"))


@query("scale_spots", V.with_views("select spot_id, cast(round_even(x / 2.0, 0) as bigint) as x, cast(round_even(y / 2.0, 0) as bigint) as y from s", s=V.SPOTS))
def scale_spots(spark, sf_dir):
    return L.scale_spots(V.spots(spark, sf_dir), 2.0)


@query("layer_levels", V.with_views(", t as (select spot_id, x, y, sum(value) as scale from e join s using (spot_id) group by all), b as (select min(scale) lo, max(scale) hi from t) select spot_id, x, y, scale, cast(floor((scale - lo) / (hi - lo) * 19) as int) as level from t, b", **ES))
def layer_levels(spark, sf_dir):
    return L.levels(L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), F.sum("value")), "scale", 20)


OVER = ", g as (select gene_id, x, y, value from e join s using (spot_id)), a as (select x, y, value from g where gene_id = 'Brand#7'), b as (select x, y, value from g where gene_id = 'Brand#9'), "


@query("overlay_layers", V.with_views(OVER + "la as (select x, y, cast(floor((value - lo) / (hi - lo) * 9) as int) as level from a, (select min(value) lo, max(value) hi from a)), lb as (select x, y, cast(floor((value - lo) / (hi - lo) * 9) as int) as level from b, (select min(value) lo, max(value) hi from b)) select x, y, max(level) as level from (from la union all from lb) group by all", **ES))
def overlay_layers(spark, sf_dir):
    e, s = V.expr(spark, sf_dir), V.spots(spark, sf_dir)
    return L.overlay(*(L.levels(L.gene_layer(e, s, g), "value", 10) for g in ("Brand#7", "Brand#9")))


@query("raster_density", V.with_views("select cast(floor((px - (select min(px) from c)) / 7) as bigint) as gx, cast(floor((py - (select min(py) from c)) / 7) as bigint) as gy, count(*) as n from c group by all", c=V.CELLS))
def raster_density(spark, sf_dir):
    return L.raster_density(V.cells(spark, sf_dir), 7)


@query("raster_mean", V.with_views("select cast(floor(px / 5) as bigint) as gx, cast(floor(py / 5) as bigint) as gy, tile, round(avg(weight), 6) as mean from c group by all", c=V.CELLS))
def raster_mean(spark, sf_dir):
    return L.raster_mean(V.cells(spark, sf_dir), 5, "weight", "tile").withColumn("mean", R("mean"))


@query("raster_sum", V.with_views(", t as (select x, y, sum(value) as scale from e join s using (spot_id) group by all) select cast(floor(x / 3) as bigint) as gx, cast(floor(y / 3) as bigint) as gy, sum(scale) as total from t group by all", **ES))
def raster_sum(spark, sf_dir):
    return L.raster_sum(L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), F.sum("value")), 3, "scale")


@query("patch_spots", V.with_views(", i as (select cast(floor(px / 6) as bigint) gx, cast(floor(py / 6) as bigint) gy, tile as kind from c where px / 6 > floor(px / 6) and py / 6 > floor(py / 6)), n as (select gx, gy, kind, count(*) n from i group by all) select gx, gy, kind, n, count(*) over (partition by gx, gy) as n_types, cast(sum(n) over (partition by gx, gy) as bigint) as n_cells from n", c=V.CELLS))
def patch_spots(spark, sf_dir):
    return L.patch_spots(V.cells(spark, sf_dir), 6, "tile")


PALETTE = ["#1b9e77", "#d95f02", "#7570b3", "#e7298a"]


@query("spatial_annotations", V.with_views(", k as (select tile, row_number() over (order by tile) - 1 as k from (select distinct tile from c)) select tile, id, px, py, [" + ", ".join(f"'{p}'" for p in PALETTE) + "][(k % 4) + 1] as color from c join k using (tile)", c=V.CELLS))
def spatial_annotations(spark, sf_dir):
    return L.annotations(V.cells(spark, sf_dir).select("tile", "id", "px", "py"), "tile", PALETTE)


@query("spatial_map", "select c_custkey as cell_id, n_name as label, case when n_regionkey < 2 then 'a' || n_regionkey else 'c' || n_nationkey end as color from customer join nation on c_nationkey = n_nationkey")
def spatial_map(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    classes = n.select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("label"), F.when(F.col("n_regionkey") < 2, F.concat(F.lit("a"), F.col("n_regionkey"))).alias("annotation_color"), F.concat(F.lit("c"), F.col("n_nationkey")).alias("cluster_color"))
    return L.spatial_map(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("cluster")), classes)


for _n, _k, _p in (("pca_annotation", 5, "pc"), ("umap_annotation", 2, "axis")):

    @query(_n, V.with_views("select id, label, " + ", ".join(f"round(vec[{k + 1}], 6) as {_p}{k + 1}" for k in range(_k)) + " from v", v=V.VECS))
    def _embedding(spark, sf_dir, k=_k, p=_p):
        out = L.embedding_columns(V.vecs(spark, sf_dir), "vec", k, p)
        return out.select("id", "label", *(R(f"{p}{j + 1}").alias(f"{p}{j + 1}") for j in range(k)))


@query("topic_remainder", V.with_views(", l as (select spot_id, sum(value) lib from e group by 1) select spot_id as pixel, round(sum(case when gene_id = 'Brand#1' then value / lib else 0 end), 6) as t0, round(sum(case when gene_id = 'Brand#2' then value / lib else 0 end), 6) as t1, round(1 - sum(case when gene_id in ('Brand#1', 'Brand#2') then value / lib else 0 end), 6) as other from e join l using (spot_id) group by 1", e=V.EXPR))
def topic_remainder(spark, sf_dir):
    theta = M.library_share(V.expr(spark, sf_dir)).select(F.col("spot_id").alias("pixel"), F.col("gene_id").alias("topic"), F.col("value").alias("p"))
    return L.remainder(theta, ["Brand#1", "Brand#2"]).select("pixel", R("t0").alias("t0"), R("t1").alias("t1"), R("other").alias("other"))


@query("velocity_arrows", V.with_views("select px as x, py as y, px + 2 * (area - 25) as x_end, py + 2 * ratio as y_end, tile as class from c", c=V.CELLS))
def velocity_arrows(spark, sf_dir):
    c = V.cells(spark, sf_dir).select(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("area") - 25).alias("vx"), F.col("ratio").alias("vy"), F.col("tile").alias("class"))
    return L.velocity(c, 2.0)


@query("pie_slices", V.with_views(", l as (select spot_id, sum(value) lib from e group by 1), t as (select spot_id as pixel, gene_id as topic, value / lib as p from e join l using (spot_id)), w as (select *, sum(p) over (partition by pixel order by topic rows unbounded preceding) as stop from t) select pixel, x, y, topic, round(stop - p, 6) as start, round(stop, 6) as stop from w join s on spot_id = pixel", **ES))
def pie_slices(spark, sf_dir):
    theta = M.library_share(V.expr(spark, sf_dir)).select(F.col("spot_id").alias("pixel"), F.col("gene_id").alias("topic"), F.col("value").alias("p"))
    out = L.pie_slices(theta, V.spots(spark, sf_dir))
    return out.withColumns({"start": R("start"), "stop": R("stop")})


HEX = lambda f: "'#' || " + " || ".join(f"printf('%02X', cast(floor(least(greatest({f.format(x=c)}, 0), 255) + 0.5) as bigint))" for c in ("r", "g", "b"))


@query("color_shades", f"with p as (select p_partkey as id, ((p_partkey * 7919) % 16777216) >> 16 as r, (((p_partkey * 7919) % 16777216) >> 8) & 255 as g, ((p_partkey * 7919) % 16777216) & 255 as b from part) select id, {HEX('({x} + (255 - {x}) * 0.25)')} as light, {HEX('({x} / 1.4)')} as dark, {HEX('{x}')} || 'BF' as clear from p")
def color_shades(spark, sf_dir):
    from ..functions import colors

    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")).alias("c"))
    return p.select("id", colors.lighten(F.col("c"), 0.25).alias("light"), colors.darken(F.col("c")).alias("dark"), colors.transparent(F.col("c"), 25).alias("clear"))


@query("factor_colors", "with v(label, color) as (values ('AUTOMOBILE', '#FF0000'), ('BUILDING', '#CCFF00'), ('FURNITURE', '#00FF66'), ('HOUSEHOLD', '#0066FF'), ('MACHINERY', '#CC00FF')) select c_custkey as id, coalesce(color, '#D3D3D3') as color from customer left join v on c_mktsegment = label")
def factor_colors(spark, sf_dir):
    from ..functions import colors

    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return colors.factor_colors(c, "label").select("id", "color")


@query("join_places", V.with_views(", d as (select x::bigint || ',' || y::bigint as xy, spot_id from s), o as (select x::bigint || ',' || y::bigint as xy, sum(value) as total from e join s using (spot_id) where spot_id % 3 = 0 group by 1) select xy, spot_id, total from d left join o using (xy)", **ES))
def join_places(spark, sf_dir):
    spots = V.spots(spark, sf_dir)
    label = F.concat_ws(",", F.col("x").cast("long").cast("string"), F.col("y").cast("long").cast("string"))
    totals = V.expr(spark, sf_dir).where("spot_id % 3 = 0").join(spots, "spot_id").groupBy(label.alias("xy")).agg(F.sum("value").alias("total"))
    return L.join_places(spots.select(label.alias("xy"), "spot_id"), totals)
