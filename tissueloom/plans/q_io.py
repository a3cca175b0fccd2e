"""Queries that go through readers, writers and streams: what was written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import imaging
from ..operators import knowledge as K
from ..operators import layers as L
from ..sources import readers, writers
from ..sources.staging import steps_folder, stored
from ..streaming import calls as streams
from . import views as V
from .catalog import query

R = lambda c, d=6: F.round(c, d)


def folder(spark, name):
    return f"{steps_folder(spark)}/io-{name}-{uuid.uuid4().hex}"


@query("molecule_counts", "select user_id as barcode_idx, case event_type when 'view' then 0 when 'click' then 1 else 2 end as feature_idx, count(*) as count from events group by all")
def molecule_counts(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return readers.molecule_counts(e.select(F.col("user_id").alias("barcode_idx"), kind.alias("feature_idx"), F.lit(1).cast("long").alias("count")))


@query("cells_csv", V.with_views("select tile as tile_id, round(px, 6) as x, round(py, 6) as y, round(area, 6) as area, round(ratio, 6) as ratio, round(weight * 2, 6) as CD3 from c", c=V.CELLS))
def cells_csv(spark, sf_dir):
    path = folder(spark, "cells")
    V.cells(spark, sf_dir).select(F.col("tile").alias("tile_id"), F.col("px").alias("x"), F.col("py").alias("y"), "area", "ratio", (F.col("weight") * 2).alias("CD3")).write.csv(path, header=True)
    got = C.antibody(readers.read_cells(spark, path), "CD3")
    return got.select("tile_id", *(R(c).alias(c) for c in ("x", "y", "area", "ratio")), R("signal").alias("CD3"))


def _call_file(spark, sf_dir):
    path = folder(spark, "calls")
    c = V.calls(spark, sf_dir)
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    s = lambda x: F.col(x).cast("string")
    out = c.select(
        s("gene").alias("Gene ID"), q(F.concat(F.lit("g"), s("gene"))).alias("Gene name"), s("tissue").alias("Anatomical entity ID"), q(F.concat(F.lit("t"), s("tissue"))).alias("Anatomical entity name"),
        s("stage").alias("Developmental stage ID"), q(s("stage")).alias("Developmental stage name"), F.lit("any").alias("Sex"), F.lit("wild").alias("Strain"), s("expression").alias("Expression"), s("quality").alias("Call quality"),
        F.lit("0.01").alias("FDR"), F.lit("99.5").alias("Expression score"), s("rank").alias("Expression rank"), F.lit("yes").alias("Including observed data"), F.lit("3").alias("Self observation count"),
        F.lit("4").alias("Descendant observation count"), *(F.lit(str(k)).alias(f"RNA-Seq {n}") for k, n in enumerate(("data", "call quality", "FDR", "expression score", "expression rank"))),
    )
    out.write.csv(path, sep="\t", header=True, quote="\0")
    return path


@query("parse_calls", V.with_views("select gene::varchar as gene, 'g' || gene as gene_name, tissue::varchar as tissue, stage, expression, quality, round(rank, 6) as rank from c where quality = 'gold quality'", c=V.CALLS))
def parse_calls(spark, sf_dir):
    got = readers.read_calls(spark, _call_file(spark, sf_dir), "gold quality")
    return got.select("gene", "gene_name", "tissue", "stage", "expression", "quality", R("rank").alias("rank"))


@query("parse_calls_advanced", V.with_views("select gene::varchar as gene_id, sex, self_observation_count, evidence from (select *, 'any' as sex, 3 as self_observation_count, '4' as evidence from c)", c=V.CALLS))
def parse_calls_advanced(spark, sf_dir):
    got = readers.read_calls_advanced(spark, _call_file(spark, sf_dir))
    return got.select("gene_id", "sex", "self_observation_count", F.col("rna_seq.expression_rank").alias("evidence"))


@query("spots_csv", "select 's' || s_suppkey as barcode, cast(s_nationkey % 2 as int) as flag, cast(s_suppkey % 10 as int) as x, cast(s_suppkey // 10 as int) as y from supplier")
def spots_csv(spark, sf_dir):
    path = folder(spark, "spots")
    s = V.table(spark, sf_dir, "supplier")
    s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("b"), F.col("s_nationkey") % 2, F.col("s_suppkey") * 3, F.col("s_suppkey") * 2, F.col("s_suppkey") % 10, F.expr("s_suppkey div 10")).write.csv(path)
    return readers.read_spots(spark, path).select("barcode", "flag", "x", "y")


@query("mtx_folder", V.with_views("select gene_id, 's' || spot_id as spot_id, value from e", e=V.EXPR))
def mtx_folder(spark, sf_dir):
    path = folder(spark, "mtx")
    e = V.expr(spark, sf_dir)
    genes = K.dimension(e, "gene_id")
    spots = K.dimension(e, "spot_id")
    one = lambda df, name: df.coalesce(1).write.text(f"{path}/{name}")
    one(genes.orderBy("idx").select(F.concat_ws("\t", "id", "name", F.lit("Gene Expression"))), "features.tsv")
    one(spots.orderBy("idx").select(F.concat(F.lit("s"), F.col("id"))), "barcodes.tsv")
    body = e.join(genes.select(F.col("id").alias("gene_id"), F.col("idx").alias("i")), "gene_id").join(spots.select(F.col("id").alias("spot_id"), F.col("idx").alias("j")), "spot_id")
    lines = body.select(F.lit(2).alias("k"), F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("l"))
    sizes = genes.agg(F.count("*").alias("g")).join(spots.agg(F.count("*").alias("s"))).join(body.agg(F.count("*").alias("n")))
    title = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general")], "k int, l string")
    head = title.unionByName(sizes.select(F.lit(1).alias("k"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("g", "s", "n"))).alias("l")))
    one(head.unionByName(lines).repartition(1).sortWithinPartitions("k").select("l"), "matrix.mtx")
    return readers.read_mtx(spark, path).select("gene_id", "spot_id", "value")


@query("raid_round_trip", V.with_views("select gene_id, spot_id, value, x, y from e join s using (spot_id)", e=V.EXPR, s=V.SPOTS))
def raid_round_trip(spark, sf_dir):
    path = folder(spark, "raid")
    writers.write_raid(V.expr(spark, sf_dir), V.spots(spark, sf_dir), path)
    m, s = readers.read_raid(spark, path)
    return m.join(s, "spot_id").select("gene_id", "spot_id", "value", "x", "y")


@query("layer_round_trip", V.with_views(", l as (select spot_id, x, y, sum(value) as scale from e join s using (spot_id) group by all) select spot_id, scale, (select count(*) from l) as spots from l", e=V.EXPR, s=V.SPOTS))
def layer_round_trip(spark, sf_dir):
    path = folder(spark, "layer")
    writers.write_layer(L.layer(V.expr(spark, sf_dir), V.spots(spark, sf_dir), F.sum("value")), path)
    layer, meta = readers.read_layer(spark, path)
    return layer.join(F.broadcast(meta)).select("spot_id", "scale", "spots")


@query("pack_round_trip", V.with_views("select gene, tissue, stage, quality, expression, rank from c where stage = '2-HIGH'", c=V.CALLS))
def pack_round_trip(spark, sf_dir):
    path = folder(spark, "pack")
    writers.write_pack(V.calls(spark, sf_dir), path)
    pack = readers.read_pack(spark, path)
    pack["developmental"] = pack["developmental"].where("id = '2-HIGH'")
    return K.decode_calls(pack)


@query("slots_round_trip", V.with_views("select spot_id, count(*) as n_genes from e group by 1", e=V.EXPR_HOLES))
def slots_round_trip(spark, sf_dir):
    path = folder(spark, "slots")
    writers.write_slots({"X": V.expr_holes(spark, sf_dir), "obs": V.spots(spark, sf_dir)}, path)
    return readers.read_slots(spark, path)["X"].groupBy("spot_id").agg(F.count("*").alias("n_genes"))


@query("tsv_table", "select n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey")
def tsv_table(spark, sf_dir):
    path = folder(spark, "table")
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("region")).write.csv(path, sep="\t", header=True)
    return readers.read_table(spark, path)


@query("whitespace_matrix", V.with_views("select gene_id as row, 'p' || spot_id as \"column\", value from e", e=V.EXPR))
def whitespace_matrix(spark, sf_dir):
    path = folder(spark, "matrix")
    rows = stored(V.expr(spark, sf_dir).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("spot_id", "value"))).alias("c")), "matrix-rows")
    body = rows.select(F.lit(1).alias("k"), F.concat_ws("  ", F.col("gene_id"), F.array_join(F.transform("c", lambda s: s["value"].cast("string")), " ")).alias("l"))
    head = rows.select(F.lit(0).alias("k"), F.array_join(F.transform("c", lambda s: F.concat(F.lit("p"), s["spot_id"].cast("string"))), " ").alias("l")).limit(1)
    head.unionByName(body).repartition(1).sortWithinPartitions("k").select("l").write.text(path)
    return readers.read_whitespace_matrix(spark, path)


@query("dzi_image", "select 'jpg' as format, 2 as overlap, 254 as tile_size, 7000 as width, 5000 as height")
def dzi_image(spark, sf_dir):
    path = folder(spark, "dzi")
    xml = '<?xml version="1.0"?><Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="jpg" Overlap="2" TileSize="254"><Size Width="7000" Height="5000"/></Image>'
    spark.createDataFrame([(xml,)], "x string").coalesce(1).write.text(path)
    return readers.read_dzi(spark, path)


@query("max_dzi_level", "select cast(max(s_nationkey) as int) as max_level from supplier")
def max_dzi_level(spark, sf_dir):
    """Suppliers as tiles, their nations as levels."""
    s = V.table(spark, sf_dir, "supplier")
    return readers.max_level(s.select(F.format_string("/pack/slide_files/%d/%d_0.jpg", "s_nationkey", "s_suppkey").alias("path")))


@query("tile_files", "select l_suppkey::varchar as tile_id, count(*) as pixels from lineitem group by 1")
def tile_files(spark, sf_dir):
    path = folder(spark, "tiles")
    n = V.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("int").alias("n"))
    px = n.select(F.concat(F.col("l_suppkey").cast("string"), F.lit("_0")).alias("tile_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"), F.lit(0).alias("y"), F.lit("dapi").alias("antibody"), F.lit(0.5).alias("level"))
    writers.write_tiles(px, path).count()
    got = readers.decode_bitmaps(readers.read_tiles(spark, f"{path}/dapi", "bmp"))
    return got.select(F.col("col").cast("string").alias("tile_id"), F.size("pixels").cast("long").alias("pixels"))


@query("unmixed_tiles")
def unmixed_tiles(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("tile_id"), (F.col("p_partkey") % 20).alias("x"), F.expr("p_partkey div 20 as y"), (F.col("p_partkey") * 7919 % 16777216).alias("rgb"))
    return imaging.unmixed_tiles(imaging.channels(p).drop("rgb"), imaging.IHC2)


@query("sparql_bindings", "select n_name as gene, n_regionkey::varchar as stage from nation")
def sparql_bindings(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    v = lambda c: F.struct(F.lit("literal").alias("type"), c.cast("string").alias("value"))
    j = n.select(F.to_json(F.struct(F.struct(F.array(F.struct(v(F.col("n_name")).alias("gene"), v(F.col("n_regionkey")).alias("stage"))).alias("bindings")).alias("results"))).alias("json"))
    return readers.parse_sparql(j, "json", ["gene", "stage"])


@query("dgc_matrix", V.with_views("select gene_id, spot_id, value from e", e=V.EXPR_HOLES))
def dgc_matrix(spark, sf_dir):
    e = V.expr_holes(spark, sf_dir)
    cols = e.groupBy("spot_id").agg(F.array_sort(F.collect_list(F.struct("gene_id", "value"))).alias("c")).orderBy("spot_id").toPandas()
    genes = sorted({r["gene_id"] for c in cols["c"] for r in c})
    at = {g: k for k, g in enumerate(genes)}
    i, x, p = [], [], [0]
    for c in cols["c"]:
        i += [at[r["gene_id"]] for r in c]
        x += [float(r["value"]) for r in c]
        p.append(len(i))
    one = spark.createDataFrame([(i, p, x, genes, cols["spot_id"].tolist())], "i array<int>, p array<int>, x array<double>, rows array<string>, cols array<long>")
    return readers.expand_dgc(one)


@query("labelled_csv", V.with_views("select id, 'left' as region, px - (select min(px) from c where px < 20) as px from c where px < 20", c=V.CELLS))
def labelled_csv(spark, sf_dir):
    path = folder(spark, "labelled")
    cells = V.cells(spark, sf_dir).withColumn("region", F.when(F.col("px") < 20, "left"))
    writers.write_labelled(cells, path)
    return spark.read.csv(path, header=True).select(F.col("id").cast("long"), "region", F.col("px").cast("double"))


# ---- streams ------------------------------------------------------------------------------------------
@query("call_stream", V.with_views("select gene::varchar as gene, tissue::varchar as tissue, stage, expression, quality, round(rank, 6) as rank from c where quality = 'silver quality'", c=V.CALLS))
def call_stream(spark, sf_dir):
    path = folder(spark, "stream")
    job = streams.append_calls(streams.call_stream(spark, _call_file(spark, sf_dir), "silver quality"), f"{path}/out", f"{path}/state")
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("rank", R("rank"))


@query("stream_stage_counts", V.with_views("select stage, count(*) as cluster_size from c group by 1", c=V.CALLS))
def stream_stage_counts(spark, sf_dir):
    path = folder(spark, "counts")
    streams.running_counts(streams.call_stream(spark, _call_file(spark, sf_dir)), path, folder(spark, "state")).awaitTermination()
    return streams.latest_counts(spark, path)


@query("windowed_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_events(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("ts", "event_type", "value")
    out = streams.windowed_events(e.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", R("total", 4).alias("total"))
