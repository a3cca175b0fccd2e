"""Queries of the knowledge base family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import knowledge as K
from . import views as V
from .catalog import query

C = {"c": V.CALLS}


def _sql(body):
    return V.with_views(body, **C)


@query("tissue_background", _sql("select tissue, count(distinct gene) as n_genes, string_agg(distinct gene::varchar, ',' order by gene::varchar) as genes from c where expression = 'present' group by 1"))
def tissue_background(spark, sf_dir):
    out = K.tissue_background(V.calls(spark, sf_dir))
    return out.select("tissue", "n_genes", F.array_join(F.array_sort(F.transform("genes", lambda g: g.cast("string"))), ",").alias("genes"))


for _n, _c in (("development_stages", "stage"), ("anatomical_ids", "tissue")):

    @query(_n, _sql(f"select {_c}, count(*) as cluster_size from c group by 1"))
    def _counts(spark, sf_dir, column=_c):
        return K.call_counts(V.calls(spark, sf_dir), column)


@query("gene_dimension", _sql("select row_number() over (order by gene) as idx, gene as id, gene::varchar as name from (select distinct gene from c)"))
def gene_dimension(spark, sf_dir):
    return K.dimension(V.calls(spark, sf_dir), "gene")


ENCODE = (
    "g as (select gene, row_number() over (order by gene) gene_idx from (select distinct gene from c)), t as (select tissue, row_number() over (order by tissue) anatomical_idx from (select distinct tissue from c)), "
    "s as (select stage, row_number() over (order by stage) developmental_idx from (select distinct stage from c))"
)


@query("encode_calls", _sql(f", {ENCODE} select gene_idx, anatomical_idx, developmental_idx, cast(case when quality = 'gold quality' then 0 else 1 end as tinyint) as quality, expression = 'present' as expression, rank as expression_rank from c join g using (gene) join t using (tissue) join s using (stage)"))
def encode_calls(spark, sf_dir):
    return K.encode_calls(V.calls(spark, sf_dir))["fact"]


@query("decode_calls", _sql("select gene, tissue, stage, quality, expression, rank from c"))
def decode_calls(spark, sf_dir):
    return K.decode_calls(K.encode_calls(V.calls(spark, sf_dir)))


@query("rank_matrix", _sql(", k as (select gene, tissue || '-' || stage as sample, min(rank) as r from c where expression <> 'absent' group by all) select gene, sample, round(r / sum(r) over (partition by sample), 9) as value from k"))
def rank_matrix(spark, sf_dir):
    return K.rank_matrix(V.calls(spark, sf_dir)).select("gene", "sample", F.round("value", 9).alias("value"))


STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("call_pivot", _sql("select tissue, " + ", ".join(f"count(*) filter (stage = '{s}') as s{k}" for k, s in enumerate(STAGES)) + " from c group by 1"))
def call_pivot(spark, sf_dir):
    n = V.calls(spark, sf_dir).groupBy("tissue", "stage").agg(F.count("*").alias("n"))
    return K.pivot_matrix(n, "tissue", "stage", "n", STAGES).withColumnsRenamed({s: f"s{k}" for k, s in enumerate(STAGES)})


def _enrich_sql(where):
    return _sql(
        f", gs as (select distinct gene from c where gene % 37 = 5), z as (select (select count(distinct gene) from c) as bg, (select count(*) from gs) as n), "
        f"per as (select stage, tissue, count(distinct gene) as k, count(distinct gene) filter (gene % 37 = 5) as h from c where {where} group by all having h > 0), "
        "terms as (select stage, tissue, k, h, bg, n, exp(lgamma(k + 1.0) - lgamma(i + 1.0) - lgamma(k - i + 1.0) + lgamma(bg - k + 1.0) - lgamma(n - i + 1.0) - lgamma(bg - k - (n - i) + 1.0) - (lgamma(bg + 1.0) - lgamma(n + 1.0) - lgamma(bg - n + 1.0))) as q "
        "from per, z, range(0, 100000) r(i) where i >= h and i <= least(k, n) and i >= n + k - bg), "
        "p as (select stage, tissue, k as cluster_size, h as hits, bg as background, n as input_size, least(1, sum(q)) as p from terms group by all), "
        "r as (select *, row_number() over (partition by stage order by p) as r, count(*) over (partition by stage) as m from p) "
        "select stage, tissue, cluster_size, hits, background, input_size, round(p, 6) as p, round(least(1, min(p * m / r) over (partition by stage order by r desc rows unbounded preceding)), 6) as fdr from r"
    )


for _n, _w, _p in (("enrichment", "true", False), ("enrichment_present", "expression = 'present'", True)):

    @query(_n, _enrich_sql(_w))
    def _enrich(spark, sf_dir, present=_p):
        calls = V.calls(spark, sf_dir)
        out = K.enrichment(calls, calls.where("gene % 37 = 5").select("gene"), present_only=present)
        return out.select("stage", "tissue", "cluster_size", "hits", "background", "input_size", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@query("stage_hits", _sql("select stage, count(distinct gene) as hits from c where gene % 37 = 5 group by 1"))
def stage_hits(spark, sf_dir):
    calls = V.calls(spark, sf_dir)
    return K.hits_of(calls, calls.where("gene % 37 = 5"), "stage")


@query("gene_set_intersection", _sql("select distinct gene from c where tissue = 3 and stage = '2-HIGH' intersect select distinct gene from c where gene % 5 = 0"))
def gene_set_intersection(spark, sf_dir):
    calls = V.calls(spark, sf_dir)
    return calls.where("tissue = 3 and stage = '2-HIGH'").select("gene").intersect(calls.where("gene % 5 = 0").select("gene"))


@query("metabolomics_mapping", "select distinct p_type as set_id, l_suppkey % 50 as id from part join lineitem on p_partkey = l_partkey where l_quantity > 49")
def metabolomics_mapping(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    proteins = line.groupBy(F.col("l_partkey").alias("name")).agg(F.collect_list(F.col("l_suppkey") % 50).alias("ids"))
    sets = V.table(spark, sf_dir, "part").select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("name"))
    return K.map_background(sets, K.catalyst_mapping(proteins))


@query("split_index", "select p_partkey as key, unnest(string_split(p_name || ' ; ' || p_type, ' ; ')) as id from part")
def split_index(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(" ; ", "p_name", "p_type").alias("ids"))
    return K.split_index(p, "key", "ids")


@query(
    "benjamini_hochberg",
    "with p as (select p_partkey as id, p_brand as grp, (p_partkey * 7919 % 10007) / 10007.0::double as p from part), r as (select *, row_number() over (partition by grp order by p) r, count(*) over (partition by grp) n from p) "
    "select id, grp, round(least(1, min(p * n / r) over (partition by grp order by r desc rows unbounded preceding)), 6) as fdr from r",
)
def benjamini_hochberg(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), (F.col("p_partkey") * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    return S.benjamini_hochberg(p, "p", "grp").select("id", "grp", F.round("fdr", 6).alias("fdr"))


@query("normal_p", f"select p_partkey as id, round({S.two_sided_sql('((p_size - 25) / 10.0::double)')}, 6) as p from part")
def normal_p(spark, sf_dir):
    z = (F.col("p_size") - 25) / F.lit(10.0)
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(S.two_sided(z), 6).alias("p"))


@query("chi2_p", "select event_id, round(1 - (1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-v * v)), 6) as p from (select event_id, sqrt(value / 20) as v, 1 / (1 + 0.3275911 * sqrt(value / 20)) as t from events where value >= 0)")
def chi2_p(spark, sf_dir):
    """Chi-square's upper tail with one degree of freedom."""
    from ..functions.stats import chi2_sf_1

    return V.table(spark, sf_dir, "events").where("value >= 0").select("event_id", F.round(chi2_sf_1(F.col("value") / 10), 6).alias("p"))
