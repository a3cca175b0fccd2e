"""Writers: stored forms of layers, matrices, packs, cells and models."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import layers as L
from ..operators.knowledge import encode_calls


def write_cells(cells: DataFrame, path: str, kind: str = "parquet") -> None:
    """Cells as parquet, or ``json`` lines."""
    writer = cells.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.parquet(path)


def write_cell_table(cells: DataFrame, antibodies: list[str], path: str) -> None:
    """Scalar columns and one column for each antibody, as CSV."""
    C.tabular(cells, antibodies).write.mode("overwrite").csv(path, header=True)


def write_layer(layer: DataFrame, folder: str) -> None:
    """A layer, and its offset, size and number of spots beside it."""
    layer.write.mode("overwrite").parquet(f"{folder}/layer")
    L.bounds(layer).join(layer.agg(F.count("*").alias("spots"))).write.mode("overwrite").parquet(f"{folder}/meta")


def write_raid(m: DataFrame, spots: DataFrame, folder: str) -> None:
    """A matrix whose spots all have places; spots without one raise before anything is written."""
    lost = L.missing_spots(m, spots).limit(5).collect()
    if lost:
        raise ValueError(f"spots without a place: {[r[0] for r in lost]}")
    m.write.mode("overwrite").parquet(f"{folder}/expr")
    spots.write.mode("overwrite").parquet(f"{folder}/spots")


def write_pack(calls: DataFrame, folder: str) -> None:
    """Calls as a star schema; the fact table is partitioned by stage, so that a stage is read alone."""
    tables = encode_calls(calls)
    tables["fact"].write.mode("overwrite").partitionBy("developmental_idx").parquet(f"{folder}/fact")
    for name in ("gene", "anatomical", "developmental"):
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def write_slots(slots: dict[str, DataFrame], folder: str) -> None:
    for name, df in slots.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_deconvolution(result: dict[str, DataFrame], folder: str) -> None:
    """Model as JSON (topic -> gene -> share), the rest as CSV."""
    beta = result["beta"].groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("gene", "p"))).alias("genes"))
    beta.write.mode("overwrite").json(f"{folder}/model")
    for name in ("theta", "single_cells", "deconvolved"):
        result[name].write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def write_labelled(cells: DataFrame, path: str, label: str = "region") -> None:
    C.export_labelled(cells, label).write.mode("overwrite").csv(path, header=True)


def bitmap(levels: np.ndarray) -> bytes:
    """A 24-bit bitmap of grey levels (h x w) or colours (h x w x 3)."""
    img = np.asarray(levels).clip(0, 255).astype(np.uint8)
    img = np.repeat(img[..., None], 3, 2) if img.ndim == 2 else img
    h, w = img.shape[:2]
    stride = -(-w * 3 // 4) * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : w * 3] = img[::-1, :, ::-1].reshape(h, w * 3)
    n = lambda x, k=4: int(x).to_bytes(k, "little")
    head = b"BM" + n(54 + body.size) + n(0) + n(54) + n(40) + n(w) + n(h) + n(1, 2) + n(24, 2) + n(0) + n(body.size) + n(2835) + n(2835) + n(0) + n(0)
    return head + body.tobytes()


def write_tiles(layers: DataFrame, folder: str) -> DataFrame:
    """One bitmap for each (tile_id, antibody) of long pixels (tile_id, x, y, antibody, level): what was written.

    Each task writes its tiles under names of its attempt and then renames them, so a repeated
    attempt leaves the same files. ``folder`` is one that all executors share.
    """

    def run(frame):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        tile, name = str(frame["tile_id"].iloc[0]), str(frame["antibody"].iloc[0])
        img = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1))
        img[frame["y"].astype(int), frame["x"].astype(int)] = frame["level"] * 255
        store.create_dir(f"{base}/{name}", recursive=True)
        part = f"{base}/{name}/.{tile}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(part) as f:
            f.write(bitmap(img))
        store.move(part, f"{base}/{name}/{tile}.bmp")
        return pd.DataFrame({"tile_id": [tile], "antibody": [name], "path": [f"{base}/{name}/{tile}.bmp"]})

    return layers.groupBy("tile_id", "antibody").applyInPandas(run, "tile_id string, antibody string, path string")


def render_slide(points: DataFrame, channel: str | None = None, grid: float = 1.0) -> DataFrame:
    """The raster behind a slide's picture: one channel's mean, or the mean over channels."""
    chosen = points.where(F.col("channel") == channel) if channel is not None else points
    return L.raster_mean(chosen, grid, "intensity")


def bson_document(row: dict) -> bytes:
    """One BSON document: numbers, strings, booleans, nulls, lists and maps."""
    body = b"".join(_bson_element(str(k), v) for k, v in row.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _bson_element(name: str, v) -> bytes:
    head = name.encode() + b"\0"
    if v is None:
        return b"\x0a" + head
    if isinstance(v, bool):
        return b"\x08" + head + bytes([v])
    if isinstance(v, int):
        return b"\x12" + head + struct.pack("<q", v)
    if isinstance(v, float):
        return b"\x01" + head + struct.pack("<d", v)
    if isinstance(v, dict):
        return b"\x03" + head + bson_document(v)
    if isinstance(v, (list, tuple)):
        return b"\x04" + head + bson_document(dict(enumerate(v)))
    text = str(v).encode()
    return b"\x02" + head + struct.pack("<i", len(text) + 1) + text + b"\0"


def write_cells_bson(cells: DataFrame, folder: str) -> DataFrame:
    """Cells as files of BSON documents, one file a partition: (path, documents) of what was written.

    A file is written under its attempt's name and then renamed by its partition, so a repeated
    attempt leaves the same files. ``folder`` is one that all executors share.
    """
    columns = cells.columns

    def run(frames):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        task, n = TaskContext.get(), 0
        store.create_dir(base, recursive=True)
        part, path = f"{base}/.part-{task.partitionId()}-{task.taskAttemptId()}", f"{base}/part-{task.partitionId():05d}.bson"
        with store.open_output_stream(part) as f:
            for frame in frames:
                for row in frame.to_dict("records"):
                    f.write(bson_document({c: _plain(row[c]) for c in columns}))
                    n += 1
        store.move(part, path)
        yield pd.DataFrame({"path": [path], "documents": [n]})

    return cells.mapInPandas(run, "path string, documents long")


def _plain(v):
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return None if isinstance(v, float) and v != v else v


def save_model(model, path: str) -> None:
    """A network's weights as an npz file (a driver-side path)."""
    np.savez(path, **model.arrays())
