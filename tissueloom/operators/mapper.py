"""Mapper: a graph of overlapping clusters along a lens of two coordinates."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pca_lens(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, vec, lens array): the first components, each signed so that its largest loading is positive."""
    with_features = vectors.withColumn("_f", array_to_vector("vec"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(with_features)
    pc = model.pc.toArray()
    sign = np.sign(pc[np.abs(pc).argmax(0), np.arange(k)])
    lens = F.transform(F.arrays_zip(vector_to_array("_p").alias("p"), F.array(*(F.lit(float(s)) for s in sign)).alias("s")), lambda z: z["p"] * z["s"])
    return model.transform(with_features).select("id", "vec", lens.alias("lens"))


#: Most rows whose pairwise distances the driver holds, for the lenses that need them all.
LENS_ROWS = 5000


def distance_lens(vectors: DataFrame, kind: str = "mds", dist: str = "euclidean", k: int = 2, max_rows: int = LENS_ROWS) -> DataFrame:
    """(id, vec, lens array) from all pairwise distances, euclidean or 1 - correlation; on the driver, for bounded tables.

    ``mds``: least squares on the distances (stress majorisation from the classical solution).
    ``neighbor``: the first nontrivial eigenvectors of the normalised Laplacian of the graph that
    links each row to the tenth of the rows that are nearest by their rows of distances.
    """
    rows = vectors.select("id", "vec").orderBy("id").limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: use the PCA lens")
    x = np.stack(rows["vec"].to_numpy()).astype(float)
    if dist == "correlation":
        x = x - x.mean(1, keepdims=True)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = np.maximum(1 - x @ x.T, 0)
    elif dist == "euclidean":
        d = _all_gaps(x)
    else:
        raise ValueError(dist)
    lens = _least_squares_scaling(d, k) if kind == "mds" else _spectral(d, k)
    made = vectors.sparkSession.createDataFrame(pd.DataFrame({"id": rows["id"], "lens": lens.tolist()}), "id long, lens array<double>")
    return vectors.select("id", "vec").join(made, "id")


def _all_gaps(x: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign)


def _least_squares_scaling(d: np.ndarray, k: int, rounds: int = 300, tol: float = 1e-6) -> np.ndarray:
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, u = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    y = _signed(u[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0)))
    last = np.inf
    for _ in range(rounds):
        now = _all_gaps(y)
        stress = ((now - d) ** 2).sum() / 2
        if last - stress <= tol * max(stress, 1e-300):
            break
        last = stress
        ratio = -np.divide(d, now, out=np.zeros_like(d), where=now > 1e-12)
        np.fill_diagonal(ratio, 0)
        np.fill_diagonal(ratio, -ratio.sum(1))
        y = ratio @ y / n
    return y


def _spectral(d: np.ndarray, k: int) -> np.ndarray:
    n = len(d)
    near = np.argsort(_all_gaps(d), axis=1, kind="stable")[:, : max(1, n // 10)]
    link = np.zeros((n, n))
    link[np.arange(n)[:, None], near] = 1
    link = (link + link.T) / 2
    np.fill_diagonal(link, 0)
    root = np.sqrt(np.maximum(link.sum(1), 1e-300))
    _, u = np.linalg.eigh(np.eye(n) - link / root[:, None] / root)
    return _signed(u[:, 1 : k + 1] / root[:, None])


def cover(lensed: DataFrame, n: int = 10, gain: float = 0.5, kind: str = "percentile") -> DataFrame:
    """(id, vec, patch): n x n patches of the first two lens coordinates, ``patch`` = row * n + column.

    A coordinate is cut at its percentiles, or in equal widths; each part is extended by ``gain``
    times its width at either end, and bounds are strict. A lens of one coordinate gives n patches.
    """
    out = lensed.select("id", "vec", F.get("lens", F.lit(0)).alias("_l0"), F.coalesce(F.get("lens", F.lit(1)), F.lit(0.0)).alias("_l1"))
    if kind == "percentile":
        shares = F.array(*(F.lit(k / n) for k in range(n + 1)))
        posts = out.agg(*(F.percentile(f"_l{c}", shares).alias(f"_q{c}") for c in (0, 1)))
    else:
        posts = out.agg(*(F.array(*(F.min(f"_l{c}") + (F.max(f"_l{c}") - F.min(f"_l{c}")) * k / n for k in range(n + 1))).alias(f"_q{c}") for c in (0, 1)))

    def parts(c: int) -> Column:
        q, x = F.col(f"_q{c}"), F.col(f"_l{c}")
        spill = lambda k: gain * (F.get(q, k + 1) - F.get(q, k))
        inside = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (x > F.get(q, k) - spill(k)) & (x < F.get(q, k + 1) + spill(k)))
        # a lens of one coordinate has no width in the other
        return inside if c == 0 else F.when(F.get(q, F.lit(0)) == F.get(q, F.lit(n)), F.array(F.lit(0))).otherwise(inside)

    out = out.join(F.broadcast(posts)).withColumn("_i", F.explode(parts(0))).withColumn("_j", F.explode(parts(1)))
    return out.select("id", "vec", (F.col("_i") * n + F.col("_j")).cast("int").alias("patch"))


#: Rows of a patch that are compared at a time.
STRIP = 1 << 15


def _strips(n: int) -> list[slice]:
    return [slice(a, min(a + STRIP, n)) for a in range(0, n, STRIP)]


def _means(x: np.ndarray, label: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Mean of each label's rows; not a number where there are none."""
    total = np.zeros((len(ks), x.shape[1]))
    for own in _strips(len(x)):
        for i, k in enumerate(ks):
            total[i] += x[own][label[own] == k].sum(0)
    with np.errstate(invalid="ignore"):
        return total / np.array([(label == k).sum() for k in ks])[:, None]


def davies_bouldin(x: np.ndarray, label: np.ndarray) -> float:
    ks = np.unique(label)
    if len(ks) < 2:
        return float("inf")
    c = _means(x, label, ks)
    gap = np.concatenate([np.linalg.norm(x[own] - c[np.searchsorted(ks, label[own])], axis=1) for own in _strips(len(x))])
    s = np.array([gap[label == k].mean() for k in ks])
    d = np.linalg.norm(c[:, None] - c[None], axis=2)
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s[None]) / np.maximum(d, 1e-300)).max(1).mean())


def separation(labelled: DataFrame) -> DataFrame:
    """The Davies-Bouldin index of labelled vectors (id, vec, label), for tables of any size: one row."""
    from .neighbors import centroids

    centre = centroids(labelled).select(F.col("id").alias("label"), F.col("vec").alias("_c"))
    gap = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    spread = labelled.join(centre, "label").groupBy("label").agg(F.avg(gap(F.col("vec"), F.col("_c"))).alias("_s")).join(centre, "label")
    a, b = (spread.select(F.col("label").alias(f"_{x}"), F.col("_s").alias(f"_s{x}"), F.col("_c").alias(f"_c{x}")) for x in "ab")
    met = a.join(b, F.col("_a") != F.col("_b"))  # labels are few
    worst = met.groupBy("_a").agg(F.max((F.col("_sa") + F.col("_sb")) / gap(F.col("_ca"), F.col("_cb"))).alias("_r"))
    return worst.agg(F.avg("_r").alias("davies_bouldin"))


def k_means(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Lloyd's rounds from the point nearest the mean and then the farthest ones. Rows may lie in a file; they are read in strips."""
    strips = _strips(len(x))
    far = lambda p: np.concatenate([((x[own] - p) ** 2).sum(1) for own in strips])
    centers = [x[np.argmin(far(_means(x, np.zeros(len(x)), np.zeros(1))[0]))]]
    least = far(centers[0])
    while len(centers) < k:
        centers.append(x[np.argmax(least)])
        least = np.minimum(least, far(centers[-1]))
    c = np.array(centers)
    for _ in range(rounds):
        label = np.concatenate([np.stack([((x[own] - p) ** 2).sum(1) for p in c], 1).argmin(1) for own in strips])
        new = _means(x, label, np.arange(k))
        new = np.where(np.isnan(new), c, new)
        if np.allclose(new, c):
            break
        c = new
    return label


#: Bytes of a patch's vectors beyond which they lie in a file of the task, and tasks that the patches are dealt to.
PATCH_BYTES, PATCH_TASKS = 64 << 20, 128


class _Patch:
    """Ids and vectors of one patch, as they come."""

    def __init__(self):
        self.ids, self.parts, self.held, self.file, self.dim = [], [], 0, None, 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids), self.parts.append(x)
        self.held, self.dim = self.held + x.nbytes, x.shape[1]
        if self.held > PATCH_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts, self.held = [], 0

    def clusters(self, patch: int, k_max: int):
        ids = np.concatenate(self.ids)
        if self.file:
            for part in self.parts:
                self.file.write(part.tobytes())
            self.file.flush()
            x = np.memmap(self.file, float, "r", shape=(len(ids), self.dim))
        else:
            x = np.concatenate(self.parts)
        best = np.zeros(len(x), int)
        score = np.inf
        for k in range(2, min(k_max, len(x) - 1) + 1):
            label = k_means(x, k)
            s = davies_bouldin(x, label)
            if s < score:
                best, score = label, s
        if self.file:
            self.file.close()
        names = np.array([f"{patch}-{c}" for c in range(max(k_max, 1))], object)
        for own in _strips(len(ids)):
            yield pd.DataFrame({"patch": patch, "node": names[best[own]], "id": ids[own]})


def patch_clusters(covered: DataFrame, k_max: int = 4) -> DataFrame:
    """(patch, node, id): each patch clustered by k-means, k of least Davies-Bouldin index.

    A task reads a patch in id order; a large one (PATCH_BYTES) lies in a file of the task.
    """

    def run(frames):
        patch, held = None, None
        for frame in frames:
            for own, some in frame.groupby("patch", sort=False):
                if own != patch:
                    if held:
                        yield from held.clusters(patch, k_max)
                    patch, held = int(own), _Patch()
                held.add(some["id"].to_numpy(), np.stack(some["vec"].to_numpy()).astype(float))
        if held:
            yield from held.clusters(patch, k_max)

    dealt = covered.select("patch", "id", "vec").repartition(PATCH_TASKS, "patch").sortWithinPartitions("patch", "id")
    return dealt.mapInPandas(run, "patch int, node string, id long")


def overlap_graph(nodes: DataFrame) -> DataFrame:
    """Edges between nodes of neighbouring patches that share members: (src, dst, shared).

    A member lies in few patches, so a member's nodes pair up among themselves only.
    """
    a, b = nodes.select("id", F.col("node").alias("src")), nodes.select("id", F.col("node").alias("dst"))
    return a.join(b, "id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def prune_singletons(nodes: DataFrame) -> DataFrame:
    """Without nodes of one member."""
    return nodes.join(nodes.groupBy("node").agg(F.count("*").alias("_n")).where("_n > 1").select("node"), "node", "left_semi")


def mapper(vectors: DataFrame, n: int = 10, gain: float = 0.5, k_max: int = 4, lens: str = "pca", dist: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole construction. Lenses: ``pca``, ``mds``, ``neighbor`` (see distance_lens)."""
    lensed = pca_lens(vectors, 2) if lens == "pca" else distance_lens(vectors, lens, dist)
    nodes = prune_singletons(patch_clusters(cover(lensed, n, gain), k_max))
    return nodes, overlap_graph(nodes)
