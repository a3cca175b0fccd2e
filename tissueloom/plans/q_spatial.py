"""Queries of spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import two_sided_sql
from ..operators import spatial as S
from . import views as V
from .catalog import query

ES = {"e": V.EXPR, "s": V.SPOTS}
R = lambda c, d=6: F.round(c, d)
DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
WEIGHTS = f"p as (select a.spot_id i, b.spot_id j from s a join s b on a.spot_id <> b.spot_id and {DIST} <= 1.5), w as (select i, j, 1.0::double / count(*) over (partition by i) as w from p)"


@query("distance_weights", V.with_views(f", {WEIGHTS} select i, j, round(w, 6) as w from w", s=V.SPOTS))
def distance_weights(spark, sf_dir):
    return S.distance_weights(V.spots(spark, sf_dir), 1.5).withColumn("w", R("w"))


@query("knn_weights", V.with_views(f", d as (select a.spot_id i, b.spot_id j, row_number() over (partition by a.spot_id order by {DIST}, b.spot_id) r from s a join s b on a.spot_id <> b.spot_id) select i, j, 0.25::double as w from d where r <= 4", s=V.SPOTS))
def knn_weights(spark, sf_dir):
    return S.knn_weights(V.spots(spark, sf_dir), 4)


SUMS = (
    "f as (select coalesce(a.w, 0) + coalesce(b.w, 0) as bt, a.w from w a full join w b on a.i = b.j and a.j = b.i), s01 as (select sum(w) s0, sum(bt ** 2) / 2 s1 from f), "
    "en as (select v, sum(w) t from (select i as v, w from w union all select j, w from w) group by 1), s2 as (select sum(t ** 2) s2 from en), z as (select * from s01, s2)"
)


@query("weight_sums", V.with_views(f", {WEIGHTS}, {SUMS} select round(s0, 6) as s0, round(s1, 6) as s1, round(s2, 6) as s2 from z", s=V.SPOTS))
def weight_sums(spark, sf_dir):
    return S.weight_sums(S.distance_weights(V.spots(spark, sf_dir), 1.5)).select(R("s0").alias("s0"), R("s1").alias("s1"), R("s2").alias("s2"))


AUTO = (
    f"{WEIGHTS}, {SUMS}, m as (select gene_id, avg(value) mu, count(*)::double n from e group by 1), d as (select gene_id, spot_id, value - mu as d from e join m using (gene_id)), "
    "q as (select gene_id, sum(d ** 2) m2, sum(d ** 4) m4 from d group by 1), c as (select x.gene_id, sum(w * x.d * y.d) ia, sum(w * (x.d - y.d) ** 2) ca from w join d x on x.spot_id = i join d y on y.spot_id = j and x.gene_id = y.gene_id group by 1), "
    "t as (select gene_id, n, s0, s1, s2, m2, n / s0 * ia / m2 as moran, (n - 1) / (2 * s0) * ca / m2 as geary, -1 / (n - 1) as e, n * m4 / m2 ** 2 as b2 from m join q using (gene_id) join c using (gene_id), z), "
    "v as (select *, (n * ((n ** 2 - 3 * n + 3) * s1 - n * s2 + 3 * s0 ** 2) - b2 * ((n ** 2 - n) * s1 - 2 * n * s2 + 6 * s0 ** 2)) / ((n - 1) * (n - 2) * (n - 3) * s0 ** 2) - e ** 2 as vi, ((2 * s1 + s2) * (n - 1) - 4 * s0 ** 2) / (2 * (n + 1) * s0 ** 2) as vc from t), "
    "o as (select gene_id, moran, (moran - e) / sqrt(vi) as mz, geary, (1 - geary) / sqrt(vc) as gz from v)"
)


@query("moran_geary", V.with_views(f", {AUTO} select gene_id, round(moran, 6) as moran, round(mz, 6) as moran_z, round({two_sided_sql('mz')}, 6) as moran_p, round(geary, 6) as geary, round(gz, 6) as geary_z, round({two_sided_sql('gz')}, 6) as geary_p from o", **ES))
def moran_geary(spark, sf_dir):
    out = S.autocorrelation(V.expr(spark, sf_dir), S.distance_weights(V.spots(spark, sf_dir), 1.5))
    return out.select("gene_id", *(R(c).alias(c) for c in ("moran", "moran_z", "moran_p", "geary", "geary_z", "geary_p")))


SIDES = "sd as (select v, sum(r) r, sum(c) c from (select i as v, w as r, 0.0 as c from w union all select j, 0.0, w from w) group by 1), t12 as (select sum((r + c) ** 2) / 2 t1, sum((r - c) ** 2) t2 from sd), vs as (select gene_id, moran, e, abs((n ** 3 - 3 * n ** 2 + 3 * n - n * t1 + 3 * s0 ** 2 - n * t2) / ((n - 1) * (n - 2) * (n - 3) * s0 ** 2) - e ** 2) as vi from t, t12), os as (select gene_id, (moran - e) / sqrt(vi) as mz from vs)"


@query("moran_sides", V.with_views(f", {AUTO}, {SIDES} select gene_id, round(mz, 6) as moran_z, round({two_sided_sql('mz')}, 6) as moran_p from os", **ES))
def moran_sides(spark, sf_dir):
    out = S.autocorrelation(V.expr(spark, sf_dir), S.distance_weights(V.spots(spark, sf_dir), 1.5), "sides")
    return out.select("gene_id", R("moran_z").alias("moran_z"), R("moran_p").alias("moran_p"))


@query("spatial_ranking", V.with_views(f", {AUTO} select gene_id, round(moran, 6) as moran from o order by o.moran desc, gene_id limit 10", **ES))
def spatial_ranking(spark, sf_dir):
    out = S.autocorrelation(V.expr(spark, sf_dir), S.distance_weights(V.spots(spark, sf_dir), 1.5))
    return out.orderBy(F.desc("moran"), "gene_id").limit(10).select("gene_id", R("moran").alias("moran"))


@query("getis_ord", V.with_views(f", {WEIGHTS}, a as (select i, j, w from w union all select spot_id, spot_id, 1.0 from s), u as (select i, sum(w) w, sum(w ** 2) w2 from a group by 1), m as (select gene_id, avg(value) mu, stddev_pop(value) sd, count(*) n from e group by 1), l as (select gene_id, i, sum(w * value) t from a join e on spot_id = j group by all) select gene_id, i as spot_id, round((t - mu * w) / (sd * sqrt((n * w2 - w ** 2) / (n - 1))), 6) as gi from l join u using (i) join m using (gene_id)", **ES))
def getis_ord(spark, sf_dir):
    return S.getis_ord(V.expr(spark, sf_dir), S.distance_weights(V.spots(spark, sf_dir), 1.5)).withColumn("gi", R("gi"))


PAIRS = f"p as (select a.spot_id i, b.spot_id j, {DIST} as d from s a join s b on a.spot_id < b.spot_id)"


@query("median_pair_distance", V.with_views(f", {PAIRS} select round(d, 9) as median from (select d, row_number() over (order by d) - 1 as r, count(*) over () n from p) where r = n // 2", s=V.SPOTS))
def median_pair_distance(spark, sf_dir):
    return spark.createDataFrame([(S.median_gap(V.spots(spark, sf_dir)),)], "median double").select(R("median", 9).alias("median"))


VARIO = f"{PAIRS}, w as (select max(d) / 10 as w from p), l as (select i, j, d, cast(least(floor(d / w), 9) as int) as lag from p, w), g as (select x.gene_id, lag, avg(d) as distance, avg((x.value - y.value) ** 2 / 2) as gamma, count(*) as n_pairs from l join e x on x.spot_id = i join e y on y.spot_id = j and x.gene_id = y.gene_id group by all)"


@query("variogram", V.with_views(f", {VARIO} select gene_id, lag, round(distance, 6) as distance, round(gamma, 4) as gamma, n_pairs from g", **ES))
def variogram(spark, sf_dir):
    out = S.dense_variogram(V.expr(spark, sf_dir), V.spots(spark, sf_dir))
    return out.select("gene_id", "lag", R("distance").alias("distance"), R("gamma", 4).alias("gamma"), "n_pairs")


@query("variogram_pairs", V.with_views(f", {PAIRS.replace(' from s a', ' from s a').replace('a.spot_id < b.spot_id)', f'a.spot_id < b.spot_id and {DIST} <= 3)')}, w as (select max(d) / 10 as w from p), l as (select i, j, d, cast(least(floor(d / w), 9) as int) as lag from p, w) select x.gene_id, lag, round(avg(d), 6) as distance, round(avg((x.value - y.value) ** 2 / 2), 4) as gamma, count(*) as n_pairs from l join e x on x.spot_id = i join e y on y.spot_id = j and x.gene_id = y.gene_id group by all", **ES))
def variogram_pairs(spark, sf_dir):
    """Of pairs within a radius, as for more spots than a task holds."""
    near = S.range_pairs(V.spots(spark, sf_dir), V.spots(spark, sf_dir), 3.0, "x", "y", "spot_id").where("id_a < id_b")
    out = S.variogram(V.expr(spark, sf_dir), near.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.col("distance").alias("d")))
    return out.select("gene_id", "lag", R("distance").alias("distance"), R("gamma", 4).alias("gamma"), "n_pairs")


VALUES = lambda name, values: f"{name}(k, v) as (values {', '.join(f'({k}, {v}::double)' for k, v in enumerate(values))})"
FIT = (
    f"{VARIO}, {VALUES('gn', S.NUGGETS)}, {VALUES('gs', S.SILLS)}, {VALUES('gr', S.REACHES)}, t as (select gene_id, arg_min(gamma, lag) * 0.5 as n0, max(gamma) as s0, max(distance) * 0.5 as r0 from g group by 1), "
    "c as (select gene_id, gn.k * 25 + gs.k * 5 + gr.k as k, n0 * gn.v as nugget, s0 * gs.v as sill, r0 * gr.v as reach from t, gn, gs, gr), "
    "e2 as (select gene_id, k, nugget, sill, reach, sum((gamma - (nugget + (sill - nugget) * case when distance >= reach then 1 else 1.5 * (distance / reach) - 0.5 * (distance / reach) * (distance / reach) * (distance / reach) end)) ** 2 order by lag) as sse from g join c using (gene_id) group by all), "
    "r as (select *, row_number() over (partition by gene_id order by round(sse, 6), k) as r from e2), fit as (select gene_id, cast(k as int) as k, greatest(0, nugget) as nugget, greatest(nugget + 0.0001, sill) as sill, greatest(0.0001, reach) as reach from r where r = 1)"
)


@query("variogram_fit", V.with_views(f", {FIT} select gene_id, k, round(nugget, 4) as nugget, round(sill, 4) as sill, round(reach, 4) as reach from fit", **ES))
def variogram_fit(spark, sf_dir):
    v = S.dense_variogram(V.expr(spark, sf_dir), V.spots(spark, sf_dir))
    return S.fit_variogram(v).select("gene_id", "k", R("nugget", 4).alias("nugget"), R("sill", 4).alias("sill"), R("reach", 4).alias("reach"))


def _krige(spark, sf_dir, dx, dy):
    m, spots = V.expr(spark, sf_dir), V.spots(spark, sf_dir)
    targets = spots.select(F.col("spot_id").alias("target_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return S.krige(m, spots, targets, S.fit_variogram(S.dense_variogram(m, spots)))


@query("kriging")
def kriging(spark, sf_dir):
    return _krige(spark, sf_dir, 0.5, 0.25)


# at a measured place kriging gives the measured value, with the nugget as its variance
@query("kriging_at_spots", V.with_views(f", {FIT} select gene_id, spot_id as target_id, round(value, 2) as value, round(nugget, 1) as variance from e join fit using (gene_id)", **ES))
def kriging_at_spots(spark, sf_dir):
    return _krige(spark, sf_dir, 0.0, 0.0).select("gene_id", "target_id", R("value", 2).alias("value"), R("variance", 1).alias("variance"))


@query("gene_cross_moran", V.with_views(", d as (select spot_id, gene_id, value - (select avg(value) from e) as d from e), c as (select a.spot_id, sum(a.d * b.d) s from d a join d b on a.spot_id = b.spot_id and a.gene_id <> b.gene_id group by 1), q as (select spot_id, sum(d ** 2) q, count(*) n from d group by 1) select spot_id, round(n * s / (n * (n - 1) * q), 6) as moran from c join q using (spot_id)", e=V.EXPR))
def gene_cross_moran(spark, sf_dir):
    return S.gene_cross_moran(V.expr(spark, sf_dir)).withColumn("moran", R("moran"))


for _kind, _sql in (("se", "exp(-(d ** 2) / 8)"), ("periodic", "exp(-(sin(pi() * d / 2.0) ** 2) / 8)"), ("linear", "1 + (xi * xj + yi * yj) / 4")):

    @query(f"kernel_{_kind}", V.with_views(f", p as (select a.spot_id i, b.spot_id j, a.x xi, a.y yi, b.x xj, b.y yj, {DIST} as d from s a join s b on a.spot_id < b.spot_id) select i, j, round({_sql}, 6) as k from p", s=V.SPOTS))
    def _kernel(spark, sf_dir, kind=_kind):
        return S.kernel(kind, S.spot_pairs(V.spots(spark, sf_dir)), 2.0).select("i", "j", R("k").alias("k"))


for _m in ("ward", "medoids"):

    @query(f"st_clusters_{_m}")
    def _clusters(spark, sf_dir, method=_m):
        return S.st_clusters(V.expr(spark, sf_dir), V.spots(spark, sf_dir), 4, method=method)


@query("full_analysis")
def full_analysis(spark, sf_dir):
    """Each gene's statistics and kriged mean, beside the clusters of spots, of the whole analysis."""
    spots = V.spots(spark, sf_dir)
    grid = spots.select(F.col("spot_id").alias("target_id"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    out = S.full_analysis(V.expr(spark, sf_dir), spots, 4, grid, variance=False)
    surface = out["surfaces"].groupBy("gene_id").agg(F.avg("value").alias("surface_mean"))
    return out["stats"].join(surface, "gene_id").join(out["clusters"].agg(F.countDistinct("cluster").alias("n_clusters")))


LOG2 = "lib as (select spot_id, greatest(sum(value), 1) as t from raw group by 1), e as (select gene_id, spot_id, log2(value / t * 1e6 + 1) as value from raw join lib using (spot_id))"
MEDIAN = f"md as (select d as median from (select {DIST} as d, row_number() over (order by {DIST}) - 1 as r, count(*) over () as n from s a join s b on a.spot_id < b.spot_id) where r = n // 2)"


@query("full_statistics", V.with_views(f", {LOG2}, {MEDIAN}, {AUTO.replace('<= 1.5)', '<= (select median from md) + 1e-12)')} select gene_id, round(moran, 6) as moran, round(geary, 6) as geary from o", raw=V.EXPR, s=V.SPOTS))
def full_statistics(spark, sf_dir):
    from ..operators.matrix import log2_cpm

    spots = V.spots(spark, sf_dir)
    reach = S.median_gap(spots) + 1e-12
    return S.spatial_statistics(log2_cpm(V.expr(spark, sf_dir)), spots, reach).select("gene_id", R("moran").alias("moran"), R("geary").alias("geary"))
