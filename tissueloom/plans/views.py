"""The driver's tables seen as expression matrices, spots, calls, cells and vectors.

Each view exists twice: as a DataFrame and as the DuckDB SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expr(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """Dense matrix: gene = part brand, spot = supplier, value = summed quantity."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem")
    line = (line.where(where) if where else line).select("l_partkey", "l_suppkey", "l_quantity")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("gene_id"), F.col("l_suppkey").alias("spot_id")).agg(F.sum("l_quantity").alias("value"))


HOLES = "l_quantity > 45 and l_returnflag = 'R'"


def expr_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix with missing (zero) pairs."""
    return expr(spark, sf_dir, HOLES)


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots on a grid ten wide."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), F.expr("cast(s_suppkey div 10 as double)").alias("y"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression calls: gene, tissue, stage, quality, expression, rank."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("l_partkey").alias("gene"),
        (F.col("l_suppkey") % 20).alias("tissue"),
        F.col("o_orderpriority").alias("stage"),
        F.when(F.col("l_returnflag") == "A", "gold quality").otherwise("silver quality").alias("quality"),
        F.when(F.col("l_linestatus") == "F", "present").otherwise("absent").alias("expression"),
        F.col("l_extendedprice").alias("rank"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on a plane forty wide, with shape measures."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("tile"),
        (F.col("p_partkey") % 40).cast("double").alias("px"),
        F.expr("cast(p_partkey div 40 as double)").alias("py"),
        F.col("p_size").cast("double").alias("area"),
        ((F.col("p_size") % 10 + 1) / F.lit(10.0)).alias("ratio"),
        (F.col("p_size") % 7 / F.lit(7.0)).alias("density"),
        (F.col("p_retailprice") / 1000).alias("weight"),
        F.col("p_size").cast("long").alias("points"),
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


EXPR = "select p_brand as gene_id, l_suppkey as spot_id, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by all"
EXPR_HOLES = f"select p_brand as gene_id, l_suppkey as spot_id, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey where {HOLES} group by all"
SPOTS = "select s_suppkey as spot_id, cast(s_suppkey % 10 as double) as x, cast(s_suppkey // 10 as double) as y from supplier"
CALLS = (
    "select l_partkey as gene, l_suppkey % 20 as tissue, o_orderpriority as stage, case when l_returnflag = 'A' then 'gold quality' else 'silver quality' end as quality, "
    "case when l_linestatus = 'F' then 'present' else 'absent' end as expression, l_extendedprice as rank from lineitem join orders on l_orderkey = o_orderkey"
)
CELLS = (
    "select p_partkey as id, p_brand as tile, cast(p_partkey % 40 as double) as px, cast(p_partkey // 40 as double) as py, cast(p_size as double) as area, "
    "(p_size % 10 + 1) / 10.0::double as ratio, (p_size % 7) / 7.0::double as density, p_retailprice / 1000 as weight, cast(p_size as bigint) as points from part"
)
VECS = "select vec_id as id, cast(embedding as double[]) as vec, label from embeddings"


def with_views(body: str, **views: str) -> str:
    """``body`` behind one CTE for each named view."""
    return "with " + ", ".join(f"{k} as ({v})" for k, v in views.items()) + " " + body
