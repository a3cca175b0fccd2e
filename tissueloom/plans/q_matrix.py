"""Queries of the matrix family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix as M
from . import views as V
from .catalog import query

E, H = {"e": V.EXPR}, {"e": V.EXPR_HOLES}
R = lambda c, d=6: F.round(c, d)


def _long(df, name="value", digits=6):
    return df.select("gene_id", "spot_id", R(F.col(name), digits).alias(name))


def _register(name, body, op, views=None, digits=6):
    source = V.expr if views is None else V.expr_holes

    @query(name, V.with_views(body, **(views or E)))
    def run(spark, sf_dir):
        return _long(op(source(spark, sf_dir)), digits=digits)


LIB = "l as (select spot_id, sum(value) as lib from e group by 1)"
_register("log2_cpm", f", {LIB} select gene_id, spot_id, round(log2(value / greatest(lib, 1) * 1e6 + 1), 6) as value from e join l using (spot_id)", M.log2_cpm)
_register("log10_cpm", f", {LIB} select gene_id, spot_id, round(log10(value / lib * 1e6 + 1), 6) as value from e join l using (spot_id)", M.log10_cpm)
_register("log1p_scaled", f", {LIB} select gene_id, spot_id, round(ln(1 + value / lib * 1e4), 6) as value from e join l using (spot_id)", M.log1p_scaled)
_register("library_share", f", {LIB} select gene_id, spot_id, round(value / lib, 6) as value from e join l using (spot_id)", M.library_share)
_register("standardize_genes", ", s as (select gene_id, avg(value) mu, stddev_pop(value) sd from e group by 1) select gene_id, spot_id, round((value - mu) / (case when sd < 1e-8 then 1 else sd end), 6) as value from e join s using (gene_id)", M.standardize)
_register("scale_genes_01", ", s as (select gene_id, min(value) lo, max(value) hi from e group by 1) select gene_id, spot_id, round((value - lo) / (case when hi = lo then 1 else hi - lo end), 6) as value from e join s using (gene_id)", M.scale_range)
_register("winsorize", ", s as (select gene_id, quantile_cont(value, 0.05) lo, quantile_cont(value, 0.95) hi from e group by 1) select gene_id, spot_id, round(least(greatest(value, lo), hi), 6) as value from e join s using (gene_id)", M.winsorize)
_register("relative_median", ", s as (select gene_id, median(value) m from e group by 1) select gene_id, spot_id, round(value / m, 6) as value from e join s using (gene_id)", M.relative_median)
_register("inverse_log", f", {LIB} select gene_id, spot_id, round(greatest(value / lib * 1e4, 0), 2) as value from e join l using (spot_id)", lambda m: M.inverse_log(M.log1p_scaled(m), clamp=True), digits=2)

DENSE = "d as (select g.gene_id, s.spot_id, coalesce(e.value, 0) as value from (select distinct gene_id from e) g cross join (select distinct spot_id from e) s left join e using (gene_id, spot_id))"
UNI = f"{DENSE}, u as (select gene_id, spot_id, case when value <= 1 then 0 else ln(value) end as v from d), r as (select gene_id, min(v) lo, max(v) hi from u group by 1), w as (select gene_id, spot_id, (v - lo) / (case when hi = lo then 1 else hi - lo end) * 9 + 1 as value from u join r using (gene_id))"
_register("densify", f", {DENSE} select gene_id, spot_id, value from d", M.densify, H)
_register("unify_levels", f", {UNI} select gene_id, spot_id, round(value, 6) as value from w", lambda m: M.unify(M.densify(m)), H)


@query("term_counts", V.with_views(f", {UNI} select spot_id, gene_id, cast(round_even(value, 0) as bigint) as n from w where round_even(value, 0) > 0", **H))
def term_counts(spark, sf_dir):
    return M.term_counts(M.unify(M.densify(V.expr_holes(spark, sf_dir))))


N = "t as (select count(distinct spot_id) n from e), p as (select gene_id, count(*) filter (value > 0) k from e group by 1)"
_register("gene_filter", f", {N} select gene_id, spot_id, value from e semi join (select gene_id from p, t where not ((n - k) / n >= 1 - 0.5 or k / n >= 0.6)) using (gene_id)", lambda m: M.gene_filter(m, 0.5, 0.6), H)
_register("presence_filter", f", {N} select gene_id, spot_id, value from e semi join (select gene_id from p, t where k < n * 0.58 and k > n * 0.52) using (gene_id)", lambda m: M.presence_filter(m, 0.58, 0.52), H)
_register(
    "clean_counts",
    ", a as (select e.* from e semi join (select spot_id from e group by 1 having sum(value) > 600) using (spot_id)), b as (select a.* from a semi join (select gene_id from a group by 1 having sum(value) > 1500) using (gene_id)) "
    "select gene_id, spot_id, value from b semi join (select gene_id from b group by 1 having count(*) filter (value > 0) > 20) using (gene_id)",
    lambda m: M.clean_counts(m, 600, None, 1500, 20),
    H,
)
_register("drop_top_expressed", ", t as (select gene_id from e group by 1 order by sum(value) desc, gene_id limit 5) select gene_id, spot_id, value from e anti join t using (gene_id)", lambda m: M.drop_top_expressed(m, 5))
_register("drop_matching_genes", " select gene_id, spot_id, value from e where not regexp_matches(gene_id, '#1[0-9]$')", lambda m: M.drop_matching(m, "#1[0-9]$"))


@query("gene_variances", V.with_views("select gene_id, round(avg(value), 4) as mean, round(var_samp(value), 4) as var_samp, round(var_pop(value), 4) as var_pop from e group by 1", **E))
def gene_variances(spark, sf_dir):
    return M.variances(V.expr(spark, sf_dir)).select("gene_id", R("mean", 4).alias("mean"), R("var_samp", 4).alias("var_samp"), R("var_pop", 4).alias("var_pop"))


for _name, _kind in (("top_variable_genes", "var_samp"), ("highly_variable_genes", "var_pop")):

    @query(_name, V.with_views(f"select gene_id, round({_kind}(value), 4) as variance from e group by 1 order by {_kind}(value) desc, gene_id limit 8", **E))
    def _top(spark, sf_dir, kind=_kind):
        return M.top_variable(V.expr(spark, sf_dir), 8, kind).select("gene_id", R("variance", 4).alias("variance"))


OD = "v as (select gene_id, ln(avg(value)) lm, ln(var_samp(value)) lv from e group by 1), f as (select regr_slope(lv, lm) a, regr_intercept(lv, lm) b from v), o as (select gene_id, lv - a * lm - b as residual from v, f)"


@query("overdispersion", V.with_views(f", {OD} select gene_id, round(residual, 6) as residual from o", **H))
def overdispersion(spark, sf_dir):
    return M.overdispersed(V.expr_holes(spark, sf_dir)).select("gene_id", R("residual").alias("residual"))


@query("overdispersed_genes")
def overdispersed_genes(spark, sf_dir):
    return M.overdispersed_genes(V.expr_holes(spark, sf_dir))


@query("overdispersed_line", V.with_views(f", {OD} select gene_id, round(residual, 6) as residual from o", **H))
def overdispersed_line(spark, sf_dir):
    """With so many knots that the trend is a line."""
    return M.overdispersed_genes(V.expr_holes(spark, sf_dir), knots=20).select("gene_id", R("residual").alias("residual"))


@query("restrict_corpus", V.with_views(f", {OD} select gene_id, spot_id, value from e semi join (select gene_id from o where residual > 0 order by residual desc, gene_id limit 6) using (gene_id)", **H))
def restrict_corpus(spark, sf_dir):
    return M.restrict_corpus(V.expr_holes(spark, sf_dir), 1.01, 0.05, 6).select("gene_id", "spot_id", "value")


@query("gene_mad", V.with_views("select gene_id, round(mad(value), 6) as mad from e group by 1", **E))
def gene_mad(spark, sf_dir):
    return M.mad(V.expr(spark, sf_dir)).select("gene_id", R("mad").alias("mad"))


@query("top_genes_per_spot", V.with_views("select spot_id, gene_id, value, cast(r as int) as rank from (select *, row_number() over (partition by spot_id order by value desc, gene_id) r from e) where r <= 3", **E))
def top_genes_per_spot(spark, sf_dir):
    return M.top_per(V.expr(spark, sf_dir), "spot_id", "gene_id", 3).select("spot_id", "gene_id", "value", "rank")


THETA = f"{LIB}, theta as (select spot_id as pixel, gene_id as topic, value / lib as p from e join l using (spot_id))"


def _theta(spark, sf_dir):
    return M.library_share(V.expr(spark, sf_dir)).select(F.col("spot_id").alias("pixel"), F.col("gene_id").alias("topic"), F.col("value").alias("p"))


@query("filter_theta", V.with_views(f", {THETA}, c as (select pixel, topic, case when p < 0.045 then 0 else p end as p from theta), o as (select pixel, topic, coalesce(p / nullif(sum(p) over (partition by pixel), 0), 0) as p from c) select pixel, topic, round(p, 6) as p from o semi join (select topic from o group by 1 having sum(p) > 0) using (topic)", **E))
def filter_theta(spark, sf_dir):
    return M.filter_shares(_theta(spark, sf_dir), 0.045).select("pixel", "topic", R("p").alias("p"))


@query("reduce_theta", V.with_views(f", {THETA}, k as (select pixel, topic, p from (select *, rank() over (partition by pixel order by p desc) r from theta) where r <= 3) select pixel, topic, round(p / sum(p) over (partition by pixel), 6) as p from k", **E))
def reduce_theta(spark, sf_dir):
    # equal sums give equal shares on both sides, so ranks agree
    return M.reduce_shares(_theta(spark, sf_dir)).select("pixel", "topic", R("p").alias("p"))


@query("expressed_in_cluster", V.with_views(", c as (select s_suppkey as spot_id, s_nationkey as cluster from supplier), n as (select cluster, count(*) n from c group by 1) select cluster, gene_id, round(count(*) / max(n), 6) as share from e join c using (spot_id) join n using (cluster) where value > 0 group by all having count(*) / max(n) > 0.5", **H))
def expressed_in_cluster(spark, sf_dir):
    clusters = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("cluster"))
    return M.expressed_in(V.expr_holes(spark, sf_dir), clusters, 0.5).select("cluster", "gene_id", R("share").alias("share"))


@query(
    "bootstrap_means",
    V.with_views(
        ", s as (select spot_id, row_number() over (order by spot_id) - 1 as pos from (select distinct spot_id from e)), n as (select count(*) n from s), "
        "d as (select b.bag, cast(cast(('0x' || substr(md5(b.bag || '-' || k.k || '-1'), 1, 8)) as bigint) % n as bigint) as pos from n, range(0, 32) b(bag), range(0, 100000) k(k) where k.k < greatest(n // 5, 1)) "
        "select cast(bag as int) as bag, gene_id, round(avg(value), 6) as mean from d join s using (pos) join e using (spot_id) group by all",
        **E,
    ),
)
def bootstrap_means(spark, sf_dir):
    return M.bootstrap_means(V.expr(spark, sf_dir)).select("bag", "gene_id", R("mean").alias("mean"))


@query("transpose", V.with_views("select spot_id as gene_id, gene_id as spot_id, value from e", **E))
def transpose(spark, sf_dir):
    return M.transpose(V.expr(spark, sf_dir)).select("gene_id", "spot_id", "value")


@query("csr_rows", V.with_views("select spot_id as row, gene_id as col, value from e", **H))
def csr_rows(spark, sf_dir):
    packed = V.expr_holes(spark, sf_dir).groupBy(F.col("spot_id").alias("row")).agg(F.array_sort(F.collect_list(F.struct("gene_id", "value"))).alias("c"))
    packed = packed.select("row", F.lit(0).alias("start"), F.size("c").alias("stop"), F.col("c.gene_id").alias("indices"), F.col("c.value").alias("data"))
    return M.csr_rows(packed)


@query("combine_topics", V.with_views(", c as (select distinct gene_id as topic, cast(substr(gene_id, 7, 1) as int) as cluster from e) select cluster, spot_id as item, round(avg(value), 6) as p from e join c on gene_id = topic group by all", **E))
def combine_topics(spark, sf_dir):
    e = V.expr(spark, sf_dir)
    clusters = e.select(F.col("gene_id").alias("topic"), F.substring("gene_id", 7, 1).cast("int").alias("cluster")).distinct()
    beta = e.select(F.col("gene_id").alias("topic"), F.col("spot_id").alias("item"), F.col("value").alias("p"))
    return M.combine_topics(beta, clusters).select("cluster", "item", R("p").alias("p"))


@query("rare_topics", V.with_views(f", {THETA}, k as (select cast(pixel % 3 as bigint) as k, topic, avg(p) m from theta group by all) select k, count(*) filter (m < 0.04) as n_rare from k group by 1", **E))
def rare_topics(spark, sf_dir):
    return M.rare_topics(_theta(spark, sf_dir).withColumn("k", F.col("pixel") % 3), 0.04)


@query("knee", "with c as (select l_quantity as x, sum(l_extendedprice) / 1e6 as p from lineitem group by 1), d as (select x, lead(p) over (order by x) + lag(p) over (order by x) - 2 * p as bend from c) select x, round(bend, 6) as bend from d where bend is not null order by d.bend desc, x limit 1")
def knee(spark, sf_dir):
    curve = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg((F.sum("l_extendedprice") / 1e6).alias("p"))
    return M.second_difference_knee(curve).select("x", R("bend").alias("bend"))


@query(
    "preprocess",
    V.with_views(
        ", a as (select e.* from e semi join (select spot_id from e group by 1 having sum(value) > 100) using (spot_id)), t as (select gene_id from a group by 1 order by sum(value) desc, gene_id limit 2), b as (select * from a anti join t using (gene_id)), "
        "c as (select * from b where not regexp_matches(gene_id, '#1$')), n as (select count(distinct spot_id) n from c), k as (select gene_id, count(*) filter (value > 0) k from c group by 1), d as (select c.* from c semi join (select gene_id from k, n where k < n * 0.9 and k > n * 0.1) using (gene_id)) "
        "select gene_id, spot_id, value from d semi join (select spot_id from d group by 1 having sum(value) > 0) using (spot_id)",
        **H,
    ),
)
def preprocess(spark, sf_dir):
    return M.preprocess(V.expr_holes(spark, sf_dir), min_lib=100, drop_top=2, drop_pattern="#1$", above=0.9, below=0.1).select("gene_id", "spot_id", "value")
