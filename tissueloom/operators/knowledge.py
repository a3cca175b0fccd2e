"""Expression-call knowledge base: dictionary encoding, backgrounds, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.stats import benjamini_hochberg, hypergeometric_sf

COLUMNS = {"gene": "gene", "tissue": "anatomical", "stage": "developmental"}


def dimension(calls: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Distinct ids of a column numbered from 1 by id, with a name (the smallest one where it varies).

    Ids are numbered within ranges of a sorted order, so that one task never numbers them all.
    """
    ids = calls.groupBy(F.col(column).alias("id")).agg(F.min(name or column).cast("string").alias("name")).where("id is not null")
    return numbered(ids, "id", out="idx").select("idx", "id", "name")


def encode_calls(calls: DataFrame) -> dict[str, DataFrame]:
    """Star schema of calls: a fact table of indices and three dimensions.

    Any quality other than gold counts as silver (1); expression is whether it reads ``present``.
    """
    dims = {name: dimension(calls, column) for column, name in COLUMNS.items()}
    fact = calls
    for column, name in COLUMNS.items():
        fact = fact.join(dims[name].select(F.col("idx").alias(f"{name}_idx"), F.col("id").alias(column)), column)
    fact = fact.select(*(f"{n}_idx" for n in COLUMNS.values()), F.when(F.col("quality") == "gold quality", 0).otherwise(1).cast("byte").alias("quality"), (F.col("expression") == "present").alias("expression"), F.col("rank").alias("expression_rank"))
    return {"fact": fact, **dims}


def decode_calls(tables: dict[str, DataFrame]) -> DataFrame:
    fact = tables["fact"]
    for column, name in COLUMNS.items():
        fact = fact.join(tables[name].select(F.col("idx").alias(f"{name}_idx"), F.col("id").alias(column)), f"{name}_idx")
    quality = F.when(F.col("quality") == 0, "gold quality").otherwise("silver quality")
    return fact.select(*COLUMNS, quality.alias("quality"), F.when(F.col("expression"), "present").otherwise("absent").alias("expression"), F.col("expression_rank").alias("rank"))


def tissue_background(calls: DataFrame) -> DataFrame:
    """Genes with a present call in each tissue: tissue, n_genes, genes (sorted)."""
    pairs = calls.where("expression = 'present'").select("tissue", "gene").distinct()
    return pairs.groupBy("tissue").agg(F.count("*").alias("n_genes"), F.sort_array(F.collect_list("gene")).alias("genes"))


def call_counts(calls: DataFrame, column: str) -> DataFrame:
    """Calls of each stage or tissue."""
    return calls.groupBy(column).agg(F.count("*").alias("cluster_size"))


def rank_matrix(calls: DataFrame, strict: bool = False) -> DataFrame:
    """Gene x sample ranks of non-absent calls, each sample scaled to sum 1.

    Long form: gene, sample (``tissue-stage``), value. A gene that repeats in a sample keeps its
    smallest rank, or with ``strict`` raises when the rows are read.
    """
    kept = calls.where("expression <> 'absent'").withColumn("sample", F.concat_ws("-", F.col("tissue").cast("string"), "stage"))
    cell = kept.groupBy("gene", "sample").agg(F.min("rank").alias("rank"), F.count("*").alias("_n"))
    if strict:
        cell = cell.withColumn("rank", F.when(F.col("_n") > 1, F.raise_error(F.lit("a gene repeats in a sample"))).otherwise(F.col("rank")))
    total = cell.groupBy("sample").agg(F.sum("rank").alias("_t"))
    return cell.join(total, "sample").select("gene", "sample", F.try_divide("rank", "_t").alias("value"))


def pivot_matrix(long: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Wide form with the stated columns; absent cells are 0."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0)


def enrichment(calls: DataFrame, genes: DataFrame, stages: list | None = None, present_only: bool = False) -> DataFrame:
    """Over-representation of a gene set in the tissues of each stage.

    ``genes``: one column ``gene``. Background: all genes of ``calls``. A tissue's genes are those
    with a call (of either polarity, unless ``present_only``); p is the hypergeometric upper
    tail, corrected over the tissues of a stage. Tissues without a hit are left out.
    """
    genes = genes.select("gene").distinct().join(calls.select("gene").distinct(), "gene", "left_semi")
    sizes = calls.agg(F.countDistinct("gene").alias("background")).join(genes.agg(F.count("*").alias("input_size")))
    own = calls.where("expression = 'present'") if present_only else calls
    own = own.where(F.col("stage").isin(stages)) if stages else own
    pairs = own.select("stage", "tissue", "gene").distinct()
    hit = pairs.join(genes.withColumn("_hit", F.lit(1)), "gene", "left")
    per = hit.groupBy("stage", "tissue").agg(F.count("*").alias("cluster_size"), F.count("_hit").alias("hits"), F.sort_array(F.collect_list(F.when(F.col("_hit") == 1, F.col("gene")))).alias("hit_genes"))
    per = per.where("hits > 0").join(F.broadcast(sizes))
    return benjamini_hochberg(per.withColumn("p", hypergeometric_sf("hits", "input_size", "cluster_size", "background")), "p", "stage")


def hits_of(calls: DataFrame, genes: DataFrame, column: str = "tissue") -> DataFrame:
    """Distinct genes of the set with a call, per tissue or stage."""
    return calls.join(genes.select("gene").distinct(), "gene", "left_semi").groupBy(column).agg(F.countDistinct("gene").alias("hits"))


def catalyst_mapping(proteins: DataFrame) -> DataFrame:
    """(name, ids array) -> distinct (name, id)."""
    return proteins.select("name", F.explode("ids").alias("id")).distinct()


def map_background(sets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gene sets (set_id, name) as sets of mapped ids; sets that map to nothing go."""
    return sets.join(mapping, "name").select("set_id", "id").distinct()


def split_index(df: DataFrame, key: str, ids: str) -> DataFrame:
    """``;``-separated ids exploded into (id, key); empty ids go."""
    return df.select(key, F.explode(F.split(ids, r"\s*;\s*")).alias("id")).where("id <> ''")
