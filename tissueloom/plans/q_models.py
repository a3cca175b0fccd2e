"""Queries of models, alignment, imaging and mapper."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import generative as G
from ..operators import gp, imaging, mapper
from ..operators import neighbors as N
from ..operators import topics as T
from . import views as V
from .catalog import query

R = lambda c, d=6: F.round(c, d)
HOLES, BOUNDS = {"e": V.EXPR_HOLES}, (0.05, 0.95)


# ---- topics ---------------------------------------------------------------------------------------
def _corpus(spark, sf_dir):
    return T.corpus(V.expr_holes(spark, sf_dir), *BOUNDS)


@query(
    "spot_corpus",
    V.with_views(
        ", t as (select count(distinct spot_id) n from e), p as (select gene_id, count(*) filter (value > 0) k from e group by 1), f as (select gene_id, spot_id, value from e semi join (select gene_id from p, t where not ((n - k) / n >= 0.95 or k / n >= 0.95)) using (gene_id)), "
        "d as (select g.gene_id, s.spot_id, coalesce(f.value, 0) as value from (select distinct gene_id from f) g cross join (select distinct spot_id from f) s left join f using (gene_id, spot_id)), "
        "u as (select gene_id, spot_id, case when value <= 1 then 0 else ln(value) end as v from d), r as (select gene_id, min(v) lo, max(v) hi from u group by 1) "
        "select spot_id as pixel, gene_id as term, cast(round_even((v - lo) / (case when hi = lo then 1 else hi - lo end) * 9 + 1, 0) as bigint) as n from u join r using (gene_id)",
        **HOLES,
    ),
)
def spot_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir)


def _lda(spark, sf_dir, k=4):
    return T.fit_lda(_corpus(spark, sf_dir), k, rounds=20)


@query("lda_theta")
def lda_theta(spark, sf_dir):
    return _lda(spark, sf_dir)[1]


@query("lda_top_genes")
def lda_top_genes(spark, sf_dir):
    return T.top_terms(_lda(spark, sf_dir)[2], 10)


@query("lda_many_k")
def lda_many_k(spark, sf_dir):
    return T.fit_many(_corpus(spark, sf_dir), list(range(2, 10)), rounds=20)


@query("deconv_spatial")
def deconv_spatial(spark, sf_dir):
    return T.deconv_spatial(V.expr_holes(spark, sf_dir), 4, rounds=20)["classes"]


BETA = "b as (select cast(substr(gene_id, 7, 1) as int) as topic, gene_id as gene, sum(value) / 10000 as p from e group by all)"


def _beta(spark, sf_dir):
    return V.expr(spark, sf_dir).groupBy(F.substring("gene_id", 7, 1).cast("int").alias("topic"), F.col("gene_id").alias("gene")).agg((F.sum("value") / 10000).alias("p"))


@query("topic_single_cells", V.with_views(f", {BETA} select spot_id, 'class_' || topic || '.' || gene as id, round(value * p, 4) as value from e join b on gene_id = gene", e=V.EXPR))
def topic_single_cells(spark, sf_dir):
    return T.single_cells(V.expr(spark, sf_dir), _beta(spark, sf_dir)).withColumn("value", R("value", 4))


THETA = "th as (select spot_id as pixel, cast(substr(gene_id, 7, 1) as int) as topic, sum(value) as p from e group by all), mt as (select pixel, topic from (select *, row_number() over (partition by pixel order by p desc, topic) r from th) where r = 1)"


def _theta(spark, sf_dir):
    return V.expr(spark, sf_dir).groupBy(F.col("spot_id").alias("pixel"), F.substring("gene_id", 7, 1).cast("int").alias("topic")).agg(F.sum("value").alias("p"))


@query("main_topic", V.with_views(f", {THETA} select pixel, topic from mt", e=V.EXPR))
def main_topic(spark, sf_dir):
    return T.main_topic(_theta(spark, sf_dir))


@query("topic_deconvolve", V.with_views(f", {BETA}, {THETA} select mt.pixel, mt.topic, gene, round(coalesce(h.value, 0) * b.p, 4) as value from mt join b using (topic) left join h on h.spot_id = mt.pixel and h.gene_id = gene", e=V.EXPR, h=V.EXPR_HOLES))
def topic_deconvolve(spark, sf_dir):
    return T.deconvolve(V.expr_holes(spark, sf_dir), _theta(spark, sf_dir), _beta(spark, sf_dir)).withColumn("value", R("value", 4))


@query("topic_correlations", V.with_views(", p as (select spot_id % 5 as k, gene_id as item, avg(value) p from e group by all) select x.k as a, y.k as b, round(corr(x.p, y.p), 6) as r from p x join p y using (item) group by all", e=V.EXPR))
def topic_correlations(spark, sf_dir):
    p = V.expr(spark, sf_dir).groupBy((F.col("spot_id") % 5).alias("key"), F.col("gene_id").alias("item")).agg(F.avg("value").alias("p"))
    return T.correlations(p, p).withColumn("r", R("r"))


KEYS = range(0, 10, 2)
PERMUTED = " cross join ".join(f"(select b as b{k}, r as r{k} from c where a = {k}) c{k}" for k in KEYS)
TOTAL, DIFFERENT = " + ".join(f"r{k}" for k in KEYS), " and ".join(f"b{i} <> b{j}" for i in KEYS for j in KEYS if i < j)


@query("topic_pairs", V.with_views(f", p as (select spot_id % 10 as k, gene_id as item, avg(value) as p from e group by all), c as (select x.k as a, y.k as b, corr(x.p, y.p) as r from p x join p y using (item) where x.k % 2 = 0 and y.k % 2 = 1 group by all), best as (select * from {PERMUTED} where {DIFFERENT} order by {TOTAL} desc limit 1) " + " union all ".join(f"select {k}::bigint as a, b{k} as b, round(r{k}, 6) as r from best" for k in KEYS), e=V.EXPR))
def topic_pairs(spark, sf_dir):
    e = V.expr(spark, sf_dir)
    side = lambda r: e.where(F.col("spot_id") % 2 == r).groupBy((F.col("spot_id") % 10).alias("key"), F.col("gene_id").alias("item")).agg(F.avg("value").alias("p"))
    return T.paired(T.correlations(side(0), side(1))).withColumn("r", R("r"))


@query("cluster_topics")
def cluster_topics(spark, sf_dir):
    beta = V.expr(spark, sf_dir).groupBy((F.col("spot_id") % 8).cast("int").alias("topic"), F.col("gene_id").alias("gene")).agg(F.avg("value").alias("p"))
    return T.cluster_topics(beta, 3)


@query("nmf")
def nmf(spark, sf_dir):
    return T.nmf(V.expr_holes(spark, sf_dir), 4, rounds=8)[1]


@query("type_shares", "with c as (select p_partkey // 25 as patch, p_type as kind, count(*) n from part group by all) select patch, kind, round(n / sum(n) over (partition by patch), 6) as share from c")
def type_shares(spark, sf_dir):
    c = V.table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 25 as patch"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return T.share_of_types(c).withColumn("share", R("share"))


for _k, _by in (("sd", "stddev_samp(l_quantity)"), ("mean", "avg(l_quantity)"), ("maxmin", "(max(l_quantity) - min(l_quantity))"), ("iq", "(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25))")):

    @query(f"nrmse_{_k}", f"select round(sqrt(avg((l_quantity - l_extendedprice / 1000) ** 2)) / {_by}, 3) as nrmse from lineitem")
    def _nrmse(spark, sf_dir, kind=_k):
        d = V.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("o"), (F.col("l_extendedprice") / 1000).alias("p"))
        return T.nrmse(d, "o", "p", kind)


# ---- Gaussian processes -----------------------------------------------------------------------------
@query("spatial_genes")
def spatial_genes(spark, sf_dir):
    return gp.spatial_genes(V.expr(spark, sf_dir), V.spots(spark, sf_dir), n_lengths=5)


@query("pattern_clusters")
def pattern_clusters(spark, sf_dir):
    return gp.pattern_clusters(V.expr(spark, sf_dir), V.spots(spark, sf_dir), 3)[0]


# ---- generative ----------------------------------------------------------------------------------------
def _timed(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    return v.select("id", "vec", (F.col("label") / F.lit(9.0)).alias("t"))


@query("cvae_reconstruction")
def cvae_reconstruction(spark, sf_dir):
    d = _timed(spark, sf_dir)
    return G.evaluate(G.reconstruct(d, G.train_cvae(d, 8)[0]))


@query("cvae_embedding")
def cvae_embedding(spark, sf_dir):
    d = _timed(spark, sf_dir)
    return G.embed(d, G.train_cvae(d, 8)[0])


@query("time_interpolation")
def time_interpolation(spark, sf_dir):
    d = _timed(spark, sf_dir)
    return G.interpolate(d, G.train_cvae(d, 8)[0], 0.05)


@query("diffusion_states")
def diffusion_states(spark, sf_dir):
    d = _timed(spark, sf_dir)
    return G.predict_states(spark.range(5).select("id", (F.col("id") / 4).alias("t")), G.train_diffusion(d, steps=20)[0], 8)


@query("reconstruction_error", "with l as (select cast(l_linenumber as int) as gene, l_quantity x, l_extendedprice / 1000 y from lineitem) select gene, round(avg((x - y) ** 2), 4) as mse, round(1 - avg((x - y) ** 2) / var_pop(x), 4) as r2 from l group by 1")
def reconstruction_error(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem")
    # one gene at a place of an array: others are null and leave the averages alone
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(k == F.col("l_linenumber"), c))
    out = G.evaluate(line.select(at(F.col("l_quantity")).alias("vec"), at(F.col("l_extendedprice") / 1000).alias("rebuilt")))
    n = line.select(F.col("l_linenumber").cast("int").alias("gene")).distinct()
    return out.join(n, "gene", "left_semi").select("gene", R("mse", 4).alias("mse"), R("r2", 4).alias("r2"))


@query("time_scaling", "select event_id, round((value - (select min(value) from events)) / ((select max(value) from events) - (select min(value) from events)), 6) as t from events")
def time_scaling(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("t"))
    return G.scale_time(e).withColumn("t", R("t"))


@query("nearest_times", "with s as (select distinct l_quantity as t from lineitem where l_quantity::bigint % 7 = 0), g as (select i / 2.0 as t from range(14, 98) r(i)) select g.t::double as t, max(case when s.t <= g.t then s.t end) as before, min(case when s.t >= g.t then s.t end) as after from g, s group by 1")
def nearest_times(spark, sf_dir):
    times = V.table(spark, sf_dir, "lineitem").where("bigint(l_quantity) % 7 = 0").select(F.col("l_quantity").alias("t")).distinct()
    return G.nearest_times(spark.range(14, 98).select((F.col("id") / 2).alias("t")), times)


BETAS = {"linear": "1e-4 + i * ((0.02 - 1e-4) / 99)", "cosine": "least(0.999, 1 - cos(((i + 1) / 101.0 + 0.008) / 1.008 * pi() / 2) ** 2 / cos((i / 101.0 + 0.008) / 1.008 * pi() / 2) ** 2)"}
for _s, _b in BETAS.items():

    @query(f"noise_schedule_{_s}", f"with b as (select i + 1 as step, {_b} as beta from range(0, 100) r(i)), a as (select step, beta, exp(sum(ln(1 - beta)) over (order by step)) as bar from b), p as (select *, lag(bar) over (order by step) as before from a) select step, round(beta, 8) as beta, round(bar, 8) as alpha_bar, round(case when before is null then beta else beta * (1 - before) / (1 - bar) end, 8) as posterior_variance from p")
    def _schedule(spark, sf_dir, kind=_s):
        return G.schedule(spark, 100, kind).select("step", *(R(c, 8).alias(c) for c in ("beta", "alpha_bar", "posterior_variance")))


@query("time_embedding", "select event_id, round(sin(value), 6) as s0, round(cos(value * exp(-ln(10000) * 3 / 3)), 6) as c3 from events")
def time_embedding(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", G.time_embedding_columns(F.col("value"), 8).alias("v"))
    return e.select("event_id", R(F.get("v", F.lit(0))).alias("s0"), R(F.get("v", F.lit(7))).alias("c3"))


DRAW = lambda *k: "(('0x' || substr(md5(concat_ws('-', " + ", ".join(k) + ", '42')), 1, 8))::bigint / 4294967296.0::double)"


@query(
    "synthetic_cells",
    f"with c as (select i as cell, i / 99.0::double as condition from range(0, 100) r(i)), g as (select j::int as gene, 5 + 10 * {DRAW('j', chr(39) + 'b' + chr(39))} as base, 2 + 5 * {DRAW('j', chr(39) + 'a' + chr(39))} as amp, 0.5 + 2 * {DRAW('j', chr(39) + 'f' + chr(39))} as freq, 2 * pi() * {DRAW('j', chr(39) + 'p' + chr(39))} as phase from range(0, 10) r(j)), "
    f"s as (select cell, condition, gene, base, case gene % 3 when 0 then amp * sin(2 * pi() * freq * condition + phase) when 1 then amp * (2 * condition - 1) else amp * exp(-((condition - 0.5) ** 2) / 0.08) end as signal, sqrt(-2 * ln({DRAW('gene', 'cell', chr(39) + 'x' + chr(39))} + 1e-12)) * cos(2 * pi() * {DRAW('gene', 'cell', chr(39) + 'y' + chr(39))}) as normal from c, g) "
    "select cell, round(condition, 6) as condition, gene, round(greatest(base + signal + normal * 0.1 * base, 0), 6) as value from s",
)
def synthetic_cells(spark, sf_dir):
    return G.synthetic_cells(spark, 100, 10).select("cell", R("condition").alias("condition"), "gene", R("value").alias("value"))


@query("activations", "select event_id, greatest(value - 50, 0) as relu, case when value > 50 then value - 50 else 0.01 * (value - 50) end as leaky, round(1 / (1 + exp(-(value - 50) / 10)), 6) as sigmoid from events")
def activations(spark, sf_dir):
    x = F.col("value") - 50
    z = x / 10
    stable = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return V.table(spark, sf_dir, "events").select("event_id", F.greatest(x, F.lit(0.0)).alias("relu"), F.when(x > 0, x).otherwise(0.01 * x).alias("leaky"), R(stable).alias("sigmoid"))


# ---- alignment ----------------------------------------------------------------------------------------------
def _point_pairs(spark, sf_dir):
    return V.cells(spark, sf_dir).select("id", F.col("px").alias("xa"), F.col("py").alias("ya"), (F.col("py") * -1.3 + F.col("area") / 50 + 4).alias("xb"), (F.col("px") * 1.3 - F.col("ratio") - 2).alias("yb"))


PP = "p as (select id, px as xa, py as ya, py * -1.3 + area / 50 + 4 as xb, px * 1.3 - ratio - 2 as yb from c)"


@query(
    "procrustes",
    V.with_views(
        f", {PP}, m as (select avg(xa) a, avg(ya) b, avg(xb) c, avg(yb) d from p), z as (select xa - a x, ya - b y, xb - c u, yb - d v from p, m), s as (select sum(x * u + y * v) dot, sum(x * v - y * u) crs, sum(x * x + y * y) va, sum(u * u + v * v) vb from z), "
        "t as (select atan2(crs, dot) as th, sqrt(dot ** 2 + crs ** 2) / va as sc, * from s) select round(th, 6) as theta, round(sc, 6) as scale, round(c - sc * (cos(th) * a - sin(th) * b), 4) as tx, round(d - sc * (sin(th) * a + cos(th) * b), 4) as ty, round(vb - (dot ** 2 + crs ** 2) / va, 2) as ss, round(sqrt(dot ** 2 + crs ** 2) / sqrt(va * vb), 6) as correlation from t, m",
        c=V.CELLS,
    ),
)
def procrustes(spark, sf_dir):
    out = A.procrustes(_point_pairs(spark, sf_dir))
    return out.select(R("theta").alias("theta"), R("scale").alias("scale"), R("tx", 4).alias("tx"), R("ty", 4).alias("ty"), R("ss", 2).alias("ss"), R("correlation").alias("correlation"))


WRAP = lambda x: f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


@query(
    "rotation_angle",
    V.with_views(
        f", {PP}, m as (select avg(xa) a, avg(ya) b, avg(xb) c, avg(yb) d from p), z as (select xa - a x, ya - b y, xb - c u, yb - d v from p, m), d as (select median({WRAP('atan2(v, u) - atan2(y, x)')}) as median, atan2(sum(x * v - y * u), sum(x * u + y * v)) as theta from z) "
        f"select round(case when abs({WRAP('median - theta')}) > pi() / 2 then theta else median end, 6) as angle from d",
        c=V.CELLS,
    ),
)
def rotation_angle(spark, sf_dir):
    return A.rotation_angle(_point_pairs(spark, sf_dir)).select(R("angle").alias("angle"))


@query("optimal_matches")
def optimal_matches(spark, sf_dir):
    """Suppliers' spots against the nations' places on a grid five wide."""
    a = V.spots(spark, sf_dir).select(F.col("spot_id").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    b = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 5 * 2.1).cast("double").alias("px"), F.expr("cast(n_nationkey div 5 as double) * 1.9").alias("py"))
    return A.optimal_matches(a, b)


@query("ransac")
def ransac(spark, sf_dir):
    return A.ransac(_point_pairs(spark, sf_dir), threshold=1.0)


@query("slide_alignment")
def slide_alignment(spark, sf_dir):
    c = V.cells(spark, sf_dir).select("px", "py", F.col("area").alias("intensity"))
    p, r = A.register_slides(c, c, cells=12, rounds=4, starts=2)
    return spark.createDataFrame([(*p.values(), r)], "theta double, tx double, ty double, sx double, sy double, correlation double")


# ---- imaging -----------------------------------------------------------------------------------------------
def _tiles(spark, sf_dir):
    """Parts as images one pixel wide, a pixel for each line."""
    line = V.table(spark, sf_dir, "lineitem")
    order = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity")))
    g = line.groupBy("l_partkey").agg(F.transform(order, lambda s: s["l_quantity"] * 5).alias("p"))
    return g.select(F.col("l_partkey").cast("string").alias("tile_id"), (F.col("l_partkey") % 6).cast("int").alias("channel"), F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1).alias("w"), F.col("p").alias("pixels"))


TILES = "g as (select l_partkey, list(l_quantity * 5 order by l_orderkey, l_linenumber, l_quantity) as p from lineitem group by 1), t as (select l_partkey::varchar as tile_id, cast(l_partkey % 6 as int) as channel, p from g)"


@query("tile_histogram", f"with {TILES}, u as (select unnest(p) v from t) select cast(floor(v) as int) as bin, count(*) as n from u group by 1")
def tile_histogram(spark, sf_dir):
    return imaging.histogram(_tiles(spark, sf_dir))


@query("global_scale", f"with {TILES}, u as (select tile_id, channel, unnest(p) v, generate_subscripts(p, 1) - 1 as k from t), r as (select channel, min(v) lo, max(v) hi from u group by 1) select tile_id, cast(k as int) as k, round((v - lo) / (hi - lo) * 255, 6) as v from u join r using (channel)")
def global_scale(spark, sf_dir):
    out = imaging.global_scale(_tiles(spark, sf_dir))
    return out.select("tile_id", F.posexplode("pixels").alias("k", "v")).withColumn("v", R("v"))


@query("scan_cells")
def scan_cells(spark, sf_dir):
    t = imaging.drop_blank(_tiles(spark, sf_dir))
    return imaging.split_large(imaging.scan_cells(t, imaging.otsu_threshold(t)), 1.0).drop("scan_x", "scan_y")


OTSU = (
    "h as (select cast(floor(v) as int) as bin, count(*) as n from u group by 1), b as (select bin, sum(n) over (order by bin) as w, sum(bin * n) over (order by bin) as m, sum(n) over () as wt, sum(bin * n) over () as mt from h), "
    "o as (select bin as t from b where w < wt order by round((mt::double * w - m::double * wt) ** 2 / (w * (wt - w)::double), 6) desc, bin limit 1)"
)


@query(
    "scan_regions",
    f"with {TILES}, u as (select l_partkey, tile_id, unnest(p) as v, generate_subscripts(p, 1) - 1 as y from t join g using (p)), {OTSU}, "
    "f as (select * from (select tile_id, v, y, min(v) over (partition by tile_id) as lo, max(v) over (partition by tile_id) as hi from u)), k as (select *, y - row_number() over (partition by tile_id order by y) as run from f, o where lo <> hi and v <= t) "
    "select tile_id, row_number() over (partition by tile_id order by min(y)) as label, round(avg(y), 6) as y, count(*) as points, round(avg(v) / 255, 6) as weight from k group by tile_id, run",
)
def scan_regions(spark, sf_dir):
    """The connected regions, before large ones are split."""
    t = imaging.drop_blank(_tiles(spark, sf_dir))
    return imaging.scan_cells(t, imaging.otsu_threshold(_tiles(spark, sf_dir))).select("tile_id", "label", R("y").alias("y"), "points", R("weight").alias("weight"))


@query("tile_bounds", "with t as (select 9 as level, i % 3 as col, i // 3 as row from range(0, 9) r(i)), u as (select level, col, row, greatest(col * 128 - case when col > 0 then 2 else 0 end, 0) as l, greatest(row * 128 - case when row > 0 then 2 else 0 end, 0) as t, least((col + 1) * 128 + 2, ceil(700 / 2.0)) as r, least((row + 1) * 128 + 2, ceil(500 / 2.0)) as b from t) select cast(col as bigint) as col, cast(row as bigint) as row, cast(l as bigint) as \"left\", cast(t as bigint) as top, cast(r - l as bigint) as w, cast(b - t as bigint) as h from u")
def tile_bounds(spark, sf_dir):
    t = spark.range(9).select(F.lit(9).alias("level"), (F.col("id") % 3).alias("col"), F.expr("id div 3 as row"))
    return imaging.tile_bounds(t, 700, 500, 128, 2).drop("level")


@query("rgb_channels", "select p_partkey as id, ((p_partkey * 7919) % 16777216) >> 16 as r, (((p_partkey * 7919) % 16777216) >> 8) & 255 as g, ((p_partkey * 7919) % 16777216) & 255 as b from part")
def rgb_channels(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 16777216).alias("rgb"))
    return imaging.channels(p).drop("rgb")


STAINS = {"hematoxylin": (166, 183, 59), "eosin": (18, 253, 28), "dab": (69, 145, 199)}


def _stain_sql():
    """Least squares on each subset of the three stains, with the constants worked out; the best non-negative one counts."""
    import numpy as np
    from itertools import combinations

    a = np.array(list(STAINS.values()), float).T / 255
    rows = []
    for n, chosen in enumerate(c for k in range(4) for c in combinations(range(3), k)):
        part = np.zeros((3, 3))
        if chosen:
            part[list(chosen)] = np.linalg.pinv(a[:, chosen])
        rows.append("(" + ", ".join([str(n), *(f"{float(v)!r}::double" for v in part.ravel())]) + ")")
    names = ", ".join(f"c{i}{j}" for i in range(3) for j in range(3))
    x = [f"c{i}0 * r + c{i}1 * g + c{i}2 * b" for i in range(3)]
    left = " + ".join(f"({c} - ({' + '.join(f'{float(a[k, i])!r}::double * x{i}' for i in range(3))})) ** 2" for k, c in enumerate("rgb"))
    return (
        f"with p as (select p_partkey as id, ((((p_partkey * 7919) % 16777216) >> 16) / 255.0)::double as r, (((((p_partkey * 7919) % 16777216) >> 8) & 255) / 255.0)::double as g, ((((p_partkey * 7919) % 16777216) & 255) / 255.0)::double as b from part), "
        f"w(n, {names}) as (values {', '.join(rows)}), s as (select id, n, r, g, b, {', '.join(f'{v} as x{i}' for i, v in enumerate(x))} from p, w), k as (select *, row_number() over (partition by id order by round({left}, 12), n) as best from s where x0 >= -1e-12 and x1 >= -1e-12 and x2 >= -1e-12) "
        "select id, " + ", ".join(f"round(x{i}, 5) as {n}" for i, n in enumerate(STAINS)) + " from k where best = 1"
    )


@query("stain_unmix", _stain_sql())
def stain_unmix(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 16777216).alias("rgb"))
    return imaging.unmix(imaging.channels(p).drop("rgb"), STAINS).select("id", *(R(n, 5).alias(n) for n in STAINS))


@query("ihc_unmix")
def ihc_unmix(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 16777216).alias("rgb"))
    return imaging.unmix(imaging.channels(p).drop("rgb"), imaging.IHC1)


# ---- mapper ------------------------------------------------------------------------------------------------
@query("mapper")
def mapper_graph(spark, sf_dir):
    return mapper.mapper(V.vecs(spark, sf_dir).select("id", "vec"), 6)[1]


@query("mapper_mds")
def mapper_mds(spark, sf_dir):
    """Nodes along the scaling lens of the label means."""
    v = V.vecs(spark, sf_dir)
    return mapper.mapper(N.centroids(v.withColumn("label", F.col("id") % 40)), 3, lens="mds", dist="correlation")[0]


@query("mapper_spectral")
def mapper_spectral(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    return mapper.mapper(N.centroids(v.withColumn("label", F.col("id") % 40)), 3, lens="neighbor")[0]


PATCHES = (
    "l as (select id, vec[1] as x, vec[2] as y from v), q as (select {q} from l), p as (select k, {ax} as a, {bx} as b, {ay} as c, {by} as d from q, range(0, 5) r(k)) "
    "select id, cast(i.k * 5 + j.k as int) as patch from l, p i, p j where x > i.a - 0.5 * (i.b - i.a) and x < i.b + 0.5 * (i.b - i.a) and y > j.c - 0.5 * (j.d - j.c) and y < j.d + 0.5 * (j.d - j.c)"
)
WIDE = {f"{e}{c}": f"l{c} + (h{c} - l{c}) * {k} / 5" for c in "xy" for e, k in (("a", "k"), ("b", "(k + 1)"))}
POSTS = {f"{e}{c}": f"q{c}[k + {o}]" for c in "xy" for e, o in (("a", 1), ("b", 2))}


def _cover(kind):
    def run(spark, sf_dir):
        v = V.vecs(spark, sf_dir).select("id", "vec", F.slice("vec", 1, 2).alias("lens"))
        return mapper.cover(v, 5, 0.5, kind).select("id", "patch")

    return run


query("mapper_cover", V.with_views(", " + PATCHES.format(q="min(x) lx, max(x) hx, min(y) ly, max(y) hy", **WIDE), v=V.VECS))(_cover("width"))
query("mapper_cover_posts", V.with_views(", " + PATCHES.format(q="quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) qx, quantile_cont(y, [0, 0.2, 0.4, 0.6, 0.8, 1]) qy", **POSTS), v=V.VECS))(_cover("percentile"))


@query("slide_render", V.with_views("select cast(floor((px - (select min(px) from c)) / 4) as bigint) as gx, cast(floor((py - (select min(py) from c)) / 4) as bigint) as gy, round(avg(area), 6) as mean from c group by all", c=V.CELLS))
def slide_render(spark, sf_dir):
    from ..sources.writers import render_slide

    p = V.cells(spark, sf_dir).select("px", "py", F.lit("dapi").alias("channel"), F.col("area").alias("intensity"))
    return render_slide(p, "dapi", 4.0).withColumn("mean", R("mean"))




def _solutions():
    """Of each subset of three profiles the least-squares parts, as SQL over the products g.. of profiles and h. with the spot."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    out = []
    for i in range(3):
        out.append([f"h{i} / {g(i, i)}" if k == i else "0.0" for k in range(3)])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        det = f"({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)})"
        part = {i: f"(h{i} * {g(j, j)} - h{j} * {g(i, j)}) / {det}", j: f"(h{j} * {g(i, i)} - h{i} * {g(i, j)}) / {det}"}
        out.append([part.get(k, "0.0") for k in range(3)])
    minor = lambda r, c: "({} * {} - {} * {})".format(g(*(x[0] for x in (r, c))), g(*(x[1] for x in (r, c))), g(r[0], c[1]), g(r[1], c[0]))
    rest = {k: [x for x in range(3) if x != k] for k in range(3)}
    cof = lambda i, j: f"({'-' if (i + j) % 2 else ''}1.0) * {minor(rest[i], rest[j])}"
    det = "(" + " + ".join(f"{g(0, j)} * {cof(0, j)}" for j in range(3)) + ")"
    out.append(["(" + " + ".join(f"h{j} * {cof(j, k)}" for j in range(3)) + f") / {det}" for k in range(3)])
    return " union all ".join(f"select spot_id, bb, h0, h1, h2, {n} as n, {x} as x0, {y} as x1, {z} as x2 from q" for n, (x, y, z) in enumerate(out))


THREE = "p as (select cast(spot_id % 3 as int) as kind, gene_id, avg(value) as p from e group by all), w as (select gene_id, max(p) filter (kind = 0) as p0, max(p) filter (kind = 1) as p1, max(p) filter (kind = 2) as p2 from p group by 1)"
GRAM = ", ".join(f"sum(p{i} * p{j}) as g{i}{j}" for i in range(3) for j in range(i, 3))


@query(
    "reference_shares",
    V.with_views(
        f", {THREE}, g as (select {GRAM} from w), h as (select spot_id, sum(value * value) as bb, sum(value * p0) as h0, sum(value * p1) as h1, sum(value * p2) as h2 from e join w using (gene_id) group by 1), q as (select * from h, g), s as ({_solutions()}), "
        "b as (select *, bb - x0 * h0 - x1 * h1 - x2 * h2 as f, row_number() over (partition by spot_id order by bb - x0 * h0 - x1 * h1 - x2 * h2, n) as r from s where x0 >= 0 and x1 >= 0 and x2 >= 0), u as (select * from b where r = 1) "
        + " union all ".join(f"select spot_id, '{k}' as kind, round(x{k} / (x0 + x1 + x2), 5) as share, round(f / bb, 5) as residual from u" for k in range(3)),
        e=V.EXPR,
    ),
)
def reference_shares(spark, sf_dir):
    profiles = V.expr(spark, sf_dir).groupBy((F.col("spot_id") % 3).cast("string").alias("kind"), "gene_id").agg(F.avg("value").alias("p"))
    return T.reference_shares(V.expr(spark, sf_dir), profiles).select("spot_id", "kind", R("share", 5).alias("share"), R("residual", 5).alias("residual"))
