"""Readers: cells, calls, spots, matrices, knowledge base packs, slide images, 10x files."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# --- fixed values: the columns of a cell table, and of call tables -----------------------------
CELL_COLUMNS = {
    "tile_id": "string", "label": "string", "x": "double", "y": "double", "physical_x": "double", "physical_y": "double", "area": "double", "ratio": "double",
    "size": "int", "r1": "double", "r2": "double", "theta": "double", "weight": "double", "density": "double", "mean_distance": "double", "moran-I": "double", "p-value": "double",
}
CALL_COLUMNS = ["gene_id", "gene_name", "anatomical_id", "anatomical_name", "stage_id", "stage_name", "sex", "strain", "expression", "call_quality", "fdr", "expression_score", "expression_rank"]
CALL_HEADERS = [
    "Gene ID", '"Gene name"', "Anatomical entity ID", '"Anatomical entity name"', "Developmental stage ID", '"Developmental stage name"', "Sex", "Strain", "Expression", "Call quality", "FDR",
    "Expression score", "Expression rank", "Including observed data", "Self observation count", "Descendant observation count",
]
EVIDENCE = {"Affymetrix": "affymetrix", "EST": "est", "In situ": "in_situ", "RNA-Seq": "rna_seq", "single-cell RNA-Seq": "sc_rna_seq"}
EVIDENCE_FIELDS = ["data", "call_quality", "fdr", "expression_score", "expression_rank"]
# ------------------------------------------------------------------------------------------------


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell table CSV; every column that is not one of the known ones becomes a key of ``antibody``."""
    raw = spark.read.csv(path, header=True)
    known = [F.col(_q(c)).try_cast(CELL_COLUMNS[c]).alias(c) for c in raw.columns if c in CELL_COLUMNS]
    extra = [c for c in raw.columns if c not in CELL_COLUMNS and c.strip()]
    stains = F.map_from_arrays(F.array(*(F.lit(c) for c in extra)), F.array(*(F.coalesce(F.col(_q(c)).try_cast("double"), F.lit(0.0)) for c in extra))) if extra else F.create_map().cast("map<string,double>")
    return raw.select(*known, stains.alias("antibody"))


def unquoted(c):
    return F.trim(F.regexp_replace(F.trim(c), r'^"|"$', ""))


def read_calls(spark: SparkSession, path: str, quality: str = "*") -> DataFrame:
    """Simple call table: thirteen columns by position, a header line; sex, strain and FDR are not read.

    Columns are named as the operators of the knowledge base take them, with names beside ids.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="\0", enforceSchema=True, schema=", ".join(f"{c} string" for c in CALL_COLUMNS))
    out = raw.select(
        unquoted("gene_id").alias("gene"), unquoted("gene_name").alias("gene_name"), unquoted("anatomical_id").alias("tissue"), unquoted("anatomical_name").alias("tissue_name"),
        unquoted("stage_id").alias("stage"), unquoted("stage_name").alias("stage_name"), unquoted("expression").alias("expression"), unquoted("call_quality").alias("quality"),
        F.col("expression_score").try_cast("double").alias("score"), F.col("expression_rank").try_cast("double").alias("rank"),
    )
    return out if quality == "*" else out.where(F.col("quality") == quality)


def read_calls_advanced(spark: SparkSession, path: str) -> DataFrame:
    """Advanced call table, columns found by header: sixteen scalars and five evidence structs of five columns each."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="\0")
    plain = {c.strip().strip('"').lower(): c for c in raw.columns}
    missing = [h for h in CALL_HEADERS if h.strip('"').lower() not in plain]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    name = lambda h: h.strip('"').lower().replace(" ", "_")
    out = [unquoted(F.col(_q(plain[h.strip('"').lower()]))).alias(name(h)) for h in CALL_HEADERS]
    for head, alias in EVIDENCE.items():
        at = next((k for k, c in enumerate(raw.columns) if c.strip().strip('"').lower() == f"{head} data".lower()), None)
        if at is not None:
            out.append(F.struct(*(F.col(_q(raw.columns[at + k])).alias(f) for k, f in enumerate(EVIDENCE_FIELDS))).alias(alias))
    numeric = {"expression_score": "double", "expression_rank": "double", "self_observation_count": "int", "descendant_observation_count": "int"}
    df = raw.select(*out)
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in numeric.items()})


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Tissue positions CSV without a header."""
    return spark.read.csv(path, schema="barcode string, flag int, px int, py int, x int, y int")


def read_mtx(spark: SparkSession, folder: str) -> DataFrame:
    """MatrixMarket folder (matrix.mtx, features.tsv, barcodes.tsv) as long rows (gene_id, gene_name, spot_id, value)."""

    def numbered(name, columns):
        lines = spark.read.option("wholetext", False).text(f"{folder}/{name}")
        # lines keep their order within a file's partitions; numbers are offset by the partitions before
        rdd = lines.rdd.zipWithIndex().map(lambda r: (r[1] + 1, *r[0][0].split("\t")[: len(columns)]))
        return spark.createDataFrame(rdd, "k long, " + ", ".join(f"{c} string" for c in columns))

    cells = spark.read.text(f"{folder}/matrix.mtx").where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    entries = cells.select(F.get(parts, F.lit(0)).cast("long").alias("i"), F.get(parts, F.lit(1)).cast("long").alias("j"), F.get(parts, F.lit(2)).try_cast("double").alias("value"), F.monotonically_increasing_id().alias("_n"))
    first = entries.agg(F.min("_n").alias("_n"))  # the size line
    entries = entries.join(F.broadcast(first), "_n", "left_anti")
    genes, barcodes = numbered("features.tsv", ["gene_id", "gene_name"]), numbered("barcodes.tsv", ["spot_id"])
    return entries.join(genes.withColumnRenamed("k", "i"), "i").join(barcodes.withColumnRenamed("k", "j"), "j").select("gene_id", "gene_name", "spot_id", "value")


def read_pack(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A stored star schema of calls."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("fact", "gene", "anatomical", "developmental")}


def read_layer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A stored layer and its one-row metadata."""
    return spark.read.parquet(f"{folder}/layer"), spark.read.parquet(f"{folder}/meta")


def read_raid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A stored matrix and its spots."""
    return spark.read.parquet(f"{folder}/expr"), spark.read.parquet(f"{folder}/spots")


def read_slots(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A stored annotated matrix: X, obs, var, uns and embeddings, as far as the folder has them."""
    from .staging import exists

    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("X", "obs", "var", "uns", "obsm_pca", "obsm_umap", "obsm_spatial") if exists(spark, f"{folder}/{n}")}


def read_dzi(spark: SparkSession, path: str) -> DataFrame:
    """Deep-zoom metadata: format, overlap, tile size, width and height."""
    xml = spark.read.option("wholetext", True).text(path).select(F.regexp_replace("value", r'\sxmlns="[^"]*"', "").alias("x"))
    at = lambda p, kind: F.xpath_string("x", F.lit(p)).try_cast(kind)
    return xml.select(at("/Image/@Format", "string").alias("format"), at("/Image/@Overlap", "int").alias("overlap"), at("/Image/@TileSize", "int").alias("tile_size"), at("/Image/Size/@Width", "int").alias("width"), at("/Image/Size/@Height", "int").alias("height"))


def read_tiles(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """Tile files named ``col_row.ext``: path, col, row, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    stem = F.regexp_extract("path", r"([0-9]+)_([0-9]+)\.[^/]*$", 0)
    return files.select("path", F.regexp_extract("path", r"([0-9]+)_[0-9]+\.[^/]*$", 1).try_cast("int").alias("col"), F.regexp_extract("path", r"_([0-9]+)\.[^/]*$", 1).try_cast("int").alias("row"), "content").where(stem != "")


def decode_bitmaps(tiles: DataFrame) -> DataFrame:
    """Uncompressed 24-bit bitmaps to (col, row, w, h, pixels: packed 0xRRGGBB from the top left)."""

    def run(batches):
        for b in batches:
            cols, rows, ws, hs, px = [], [], [], [], []
            for c, r, data in zip(b.column("col").to_pylist(), b.column("row").to_pylist(), b.column("content").to_pylist(), strict=True):
                if data[:2] != b"BM" or int.from_bytes(data[28:30], "little") != 24:
                    raise ValueError("not an uncompressed 24-bit bitmap")
                at, w, h = int.from_bytes(data[10:14], "little"), int.from_bytes(data[18:22], "little", signed=True), int.from_bytes(data[22:26], "little", signed=True)
                stride = -(-w * 3 // 4) * 4
                raw = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3).astype(np.int64)
                raw = raw[::-1] if h > 0 else raw
                cols.append(c), rows.append(r), ws.append(w), hs.append(abs(h)), px.append((raw[..., 2] * 65536 + raw[..., 1] * 256 + raw[..., 0]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), pa.array(rows, pa.int32()), pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(px, pa.list_(pa.int64()))], names=["col", "row", "w", "h", "pixels"])

    return tiles.select("col", "row", "content").mapInArrow(run, "col int, row int, w int, h int, pixels array<long>")


def max_level(paths: DataFrame, column: str = "path") -> DataFrame:
    """The largest number among the folder names of paths."""
    folder = F.regexp_extract(column, r"([0-9]+)/[^/]*$", 1).try_cast("int")
    return paths.agg(F.max(folder).alias("max_level"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def read_whitespace_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table whose header has a row's names but the first column: long rows (row, column, value)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = F.split(F.trim(F.lit(lines.first()[0])), r"\s+")
    parts = F.split(F.trim("value"), r"\s+")
    # the parts are columns below the generator: beside it a line would be split again for each of its values
    body = lines.select(parts.alias("p")).where(F.size("p") == F.size(head) + 1).select(F.get("p", F.lit(0)).alias("row"), F.slice("p", 2, F.size("p") - 1).alias("vs"))
    body = body.select("row", F.posexplode("vs").alias("k", "v"))
    return body.select("row", F.get(head, F.col("k")).alias("column"), F.col("v").try_cast("double").alias("value"))


def parse_sparql(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """SPARQL JSON results to one row a binding."""
    binding = ", ".join(f"`{n}`: struct<type: string, value: string>" for n in names)
    got = df.select(F.explode(F.from_json(column, f"struct<results: struct<bindings: array<struct<{binding}>>>>")["results"]["bindings"]).alias("b"))
    return got.select(*(F.col(f"b.{n}.value").alias(n) for n in names))


def molecule_counts(molecules: DataFrame) -> DataFrame:
    """Summed counts of (barcode_idx, feature_idx)."""
    return molecules.groupBy("barcode_idx", "feature_idx").agg(F.sum("count").alias("count"))


def bson_documents(data: bytes) -> list[dict]:
    """The documents of a BSON file: what write_cells_bson writes, and 32-bit integers and dates as numbers."""
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        out.append(_bson_fields(data[at + 4 : at + size - 1]))
        at += size
    return out


def _bson_fields(body: bytes) -> dict:
    out, at = {}, 0
    while at < len(body):
        kind, stop = body[at], body.index(b"\0", at + 1)
        name, at = body[at + 1 : stop].decode(), stop + 1
        if kind in (1, 16, 18, 9):
            code, width = {1: ("<d", 8), 16: ("<i", 4), 18: ("<q", 8), 9: ("<q", 8)}[kind]
            out[name] = struct.unpack_from(code, body, at)[0]
        elif kind == 2:
            width = 4 + struct.unpack_from("<i", body, at)[0]
            out[name] = body[at + 4 : at + width - 1].decode()
        elif kind in (3, 4):
            width = struct.unpack_from("<i", body, at)[0]
            inner = _bson_fields(body[at + 4 : at + width - 1])
            out[name] = list(inner.values()) if kind == 4 else inner
        elif kind == 8:
            width, out[name] = 1, bool(body[at])
        elif kind == 10:
            width, out[name] = 0, None
        else:
            raise ValueError(f"BSON type {kind}")
        at += width
    return out


def read_cells_bson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cells of BSON files (a path or glob) as rows of a schema; a file is read by one task, absent fields are null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(frames):
        for f in frames:
            for content in f["content"]:
                docs = bson_documents(bytes(content))
                for k in range(0, len(docs), 10_000):
                    yield pd.DataFrame([{n: d.get(n) for n in names} for d in docs[k : k + 10_000]], columns=names)

    return files.mapInPandas(run, schema)


def as_vector(a) -> np.ndarray:
    """Any rank, row by row."""
    return np.asarray(a).reshape(-1)


def as_matrix(a) -> np.ndarray:
    """One dimension as one column, two as they are; others raise."""
    a = np.asarray(a)
    if a.ndim == 1:
        return a.reshape(-1, 1)
    if a.ndim != 2:
        raise ValueError(f"rank {a.ndim} is no matrix")
    return a


# ---- 10x HDF5 -------------------------------------------------------------------------------------
class _Range(InputPartition):
    def __init__(self, value):
        super().__init__(value)


class TenxReader(DataSourceReader):
    """Plans chunks of a molecule file, or slices of a feature-slice file; each task reads its own."""

    def __init__(self, options):
        self.path, self.kind, self.chunk = options["path"], options.get("kind", "molecules"), int(options.get("chunk", 4_000_000))

    def partitions(self):
        import h5py  # an optional library: without it these files cannot be read

        with h5py.File(self.path) as f:
            if self.kind == "slices":
                return [_Range(name) for name in sorted(f["feature_slices"])]
            n = len(f["barcode_idx"])
            if not n == len(f["feature_idx"]) == len(f["count"]):
                raise ValueError("the three arrays differ in length")
            return [_Range((k, min(k + self.chunk, n))) for k in range(0, n, self.chunk)] or [_Range((0, 0))]

    def read(self, partition):
        import h5py

        with h5py.File(self.path) as f:
            if self.kind == "slices":
                g = f["feature_slices"][partition.value]
                cols = [g["row"][:], g["col"][:], g["data"][:]]
                yield pa.RecordBatch.from_arrays([pa.array([partition.value] * len(cols[0])), *(pa.array(c.astype("int64")) for c in cols)], names=["slice", "row", "col", "value"])
            else:
                lo, hi = partition.value
                yield pa.RecordBatch.from_arrays([pa.array(f[k][lo:hi].astype("int64")) for k in ("barcode_idx", "feature_idx", "count")], names=["barcode_idx", "feature_idx", "count"])


class TenxSource(DataSource):
    """``spark.read.format("tenx_h5").option("kind", "molecules" or "slices").load(path)``."""

    @classmethod
    def name(cls):
        return "tenx_h5"

    def schema(self):
        return "slice string, row long, col long, value long" if self.options.get("kind") == "slices" else "barcode_idx long, feature_idx long, count long"

    def reader(self, schema):
        return TenxReader(self.options)


def tenx_kind(path: str) -> str:
    """Whether a file holds feature slices or molecules."""
    import h5py

    with h5py.File(path) as f:
        if "feature_slices" in f:
            return "slices"
        if "molecule_info" in f or "barcode_idx" in f:
            return "molecules"
    raise ValueError("neither feature slices nor molecules")


def expand_dgc(x: DataFrame) -> DataFrame:
    """A column-compressed matrix (one row: i, p, x, rows, cols) to long rows (gene_id, spot_id, value), zero pairs left out."""
    col = x.select(F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("j", "start"), "*").withColumn("stop", F.get("p", F.col("j") + 1))
    k = col.where("stop > start").select("j", F.explode(F.sequence("start", F.col("stop") - 1)).alias("k"), "i", "x", "rows", "cols")
    return k.select(F.get("rows", F.get("i", F.col("k"))).alias("gene_id"), F.get("cols", F.col("j")).alias("spot_id"), F.get("x", F.col("k")).alias("value"))


def reshape_embedding(flat: list[float], n_stdev: int | None) -> np.ndarray:
    """A flat embedding by columns; its width is the number of deviations, else 2."""
    width = n_stdev or 2
    if len(flat) % width:
        raise ValueError("the vector's length is no multiple of its width")
    return np.asarray(flat, float).reshape(width, math.ceil(len(flat) / width)).T
