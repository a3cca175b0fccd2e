"""Spot deconvolution: corpus, topic models, projections, factorisation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import best_assignment
from ..functions.ranking import numbered
from ..sources.staging import stored
from . import matrix as M

#: Most terms of a corpus: topic profiles of that many terms are held on the driver.
MAX_TERMS = 200_000


def corpus(m: DataFrame, p_min: float = 0.05, p_max: float = 0.95, filters: bool = True, unify: float = 10, log: bool = True) -> DataFrame:
    """Bag of words (pixel, term, n): rare and ubiquitous genes out, levels unified, counts rounded."""
    m = M.gene_filter(m, p_min, p_max) if filters else m
    return M.term_counts(M.unify(M.densify(m), unify, log)).select(F.col("spot_id").alias("pixel"), F.col("gene_id").alias("term"), "n")


#: Cells of count vectors that one batch holds.
VECTOR_CELLS = 1 << 20


def term_vectors(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Count vectors per pixel, stored (a fit reads them each round), and the vocabulary in their order."""
    terms = numbered(docs.select("term").distinct(), "term", out="k")
    names = [r["term"] for r in terms.orderBy("k").limit(MAX_TERMS + 1).collect()]
    if len(names) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    size = len(names)
    met = docs.where("n <> 0").join(terms, "term").groupBy("pixel").agg(F.collect_list((F.col("k") - 1).cast("int")).alias("k"), F.collect_list(F.col("n").cast("double")).alias("n"))
    rows = docs.select("pixel").distinct().join(met, "pixel", "left")

    def fill(frames):
        for frame in frames:
            step = max(1, VECTOR_CELLS // max(1, size))
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step]
                v = np.zeros((len(part), size))
                for i, (k, n) in enumerate(zip(part["k"], part["n"], strict=True)):
                    if k is not None:
                        v[i, k] = n
                yield pd.DataFrame({"pixel": part["pixel"].to_numpy(), "v": list(v)})

    kind = dict(docs.dtypes)["pixel"]
    vectors = stored(rows.mapInPandas(fill, f"pixel {kind}, v array<double>"), "term-vectors")
    return vectors.select("pixel", array_to_vector("v").alias("features")), names


def fit_lda(docs: DataFrame, k: int, alpha: float = 2.0, beta: float = 0.5, rounds: int = 50, seed: int = 42, vectors: tuple[DataFrame, list[str]] | None = None):
    """(model, theta (pixel, topic, p), beta (topic, gene, p)) by online variational Bayes; topics count from 1.

    ``vectors``: what term_vectors gave, where several fits share it.
    """
    vectors, terms = vectors or term_vectors(docs)
    model = LDA(k=k, docConcentration=[alpha] * k, topicConcentration=beta, maxIter=rounds, optimizer="online", subsamplingRate=1.0, seed=seed).fit(vectors)
    theta = model.transform(vectors).select("pixel", F.posexplode(vector_to_array("topicDistribution")).alias("t", "p")).select("pixel", (F.col("t") + 1).alias("topic"), "p")
    profile = model.topicsMatrix().toArray().T
    profile = profile / profile.sum(1, keepdims=True)
    rows = pd.DataFrame({"topic": np.repeat(np.arange(1, k + 1), len(terms)), "gene": terms * k, "p": profile.ravel()})
    return model, theta, docs.sparkSession.createDataFrame(rows, "topic int, gene string, p double")


#: Fits that run side by side: each is a sequence of small jobs.
FITS = 4


def fit_many(docs: DataFrame, ks: list[int], **how) -> DataFrame:
    """One row per k: log perplexity and topics of mean share below .05. All fits read one stored table of vectors."""
    shared = term_vectors(docs)

    def row(k):
        model, theta, _ = fit_lda(docs, k, vectors=shared, **how)
        rare = M.rare_topics(theta.withColumn("k", F.lit(k))).first()["n_rare"]
        return k, float(model.logPerplexity(shared[0])), int(rare)

    with ThreadPoolExecutor(FITS) as pool:
        rows = list(pool.map(row, ks))
    return docs.sparkSession.createDataFrame(rows, "k int, log_perplexity double, n_rare int")


def best_k(fits: DataFrame, rule: str = "min") -> int:
    """The k of least perplexity, at the knee, or the largest without rare topics."""
    if rule == "knee":
        return int(M.second_difference_knee(fits.select(F.col("k").alias("x"), F.col("log_perplexity").alias("p"))).first()["x"])
    if rule == "rare":
        row = fits.where("n_rare = 0").agg(F.max("k").alias("k")).first()
        return int(row["k"] or fits.agg(F.min("k").alias("k")).first()["k"])
    return int(fits.orderBy("log_perplexity", "k").first()["k"])


def top_terms(beta: DataFrame, n: int = 25) -> DataFrame:
    return M.top_per(beta, "topic", "gene", n, "p")


def main_topic(theta: DataFrame) -> DataFrame:
    """Each pixel's topic of largest share (ties: the first)."""
    return theta.groupBy("pixel").agg(F.max_by("topic", F.struct("p", -F.col("topic"))).alias("topic"))


def single_cells(m: DataFrame, beta: DataFrame, prefix: str = "class") -> DataFrame:
    """Expression of each topic's part: value * p under the id ``prefix_topic.gene``."""
    met = m.join(beta.select(F.col("gene").alias("gene_id"), "topic", "p"), "gene_id")
    return met.select("spot_id", F.concat(F.lit(prefix + "_"), F.col("topic").cast("string"), F.lit("."), F.col("gene_id")).alias("id"), (F.col("value") * F.col("p")).alias("value"))


def deconvolve(m: DataFrame, theta: DataFrame, beta: DataFrame) -> DataFrame:
    """Each pixel's expression of its main topic's genes, absent ones 0: (pixel, topic, gene, value)."""
    part = main_topic(theta).join(beta.where("p > 0").select("topic", "gene", "p"), "topic")
    own = m.select(F.col("spot_id").alias("pixel"), F.col("gene_id").alias("gene"), "value")
    return part.join(own, ["pixel", "gene"], "left").select("pixel", "topic", "gene", (F.coalesce("value", F.lit(0.0)) * F.col("p")).alias("value"))


def correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation of every profile of a (key, item, p) with every one of b over shared items."""
    met = a.select(F.col("key").alias("a"), "item", F.col("p").alias("_x")).join(b.select(F.col("key").alias("b"), "item", F.col("p").alias("_y")), "item")
    return met.groupBy("a", "b").agg(F.corr("_x", "_y").alias("r"))


def paired(corr: DataFrame) -> DataFrame:
    """One-to-one pairs of keys of largest total correlation (profiles are few: solved on the driver)."""
    table = corr.toPandas().pivot(index="a", columns="b", values="r").fillna(-1.0)
    pairs = best_assignment(table.to_numpy())
    return corr.sparkSession.createDataFrame([(table.index[i].item(), table.columns[j].item(), float(table.iloc[i, j])) for i, j in pairs], "a long, b long, r double")


def cluster_topics(beta: DataFrame, k: int) -> DataFrame:
    """Topics in k clusters by Ward's rule on 1 - correlation."""
    from .spatial import ward_labels

    profile = beta.select(F.col("topic").alias("key"), F.col("gene").alias("item"), "p")
    table = correlations(profile, profile).toPandas().pivot(index="a", columns="b", values="r").sort_index(axis=0).sort_index(axis=1)
    labels = ward_labels(1 - table.to_numpy(), k)
    return beta.sparkSession.createDataFrame([(int(t), int(c)) for t, c in zip(table.index, labels, strict=True)], "topic int, cluster int")


def nmf(m: DataFrame, k: int = 9, rounds: int = 30, inner: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors: weights (spot_id, w array) and profiles (component, gene_id, h).

    Each round every spot fits its own weights to the profiles (multiplicative updates), and the
    sums of w v and w w over all spots update the profiles; only these sums, of a size that the
    genes and components set, reach the driver.
    """
    genes = [r["gene_id"] for r in m.select("gene_id").distinct().orderBy("gene_id").limit(MAX_TERMS + 1).collect()]
    if len(genes) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} genes")
    at = {g: i for i, g in enumerate(genes)}
    rows = stored(m.groupBy("spot_id").agg(F.collect_list("gene_id").alias("g"), F.collect_list("value").alias("v")), "nmf-rows")
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (k, len(genes)))

    def weights(frame, h):
        v = np.zeros((len(frame), len(genes)))
        for i, (g, x) in enumerate(zip(frame["g"], frame["v"], strict=True)):
            v[i, [at[a] for a in g]] = x
        w = np.full((len(frame), h.shape[0]), max(v.mean(), 1e-9))
        for _ in range(inner):
            w *= (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        return v, w

    for _ in range(rounds):

        def sums(frames, h=h):
            wv, ww = np.zeros_like(h), np.zeros((h.shape[0], h.shape[0]))
            for frame in frames:
                v, w = weights(frame, h)
                wv, ww = wv + w.T @ v, ww + w.T @ w
            yield pd.DataFrame({"wv": [wv.ravel()], "ww": [ww.ravel()]})

        parts = rows.mapInPandas(sums, "wv array<double>, ww array<double>")
        add = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()  # noqa: B023, E731
        h = h * add("wv").reshape(h.shape) / np.maximum(add("ww").reshape(k, k) @ h, 1e-12)

    def final(frames, h=h):
        for frame in frames:
            yield pd.DataFrame({"spot_id": frame["spot_id"], "w": list(weights(frame, h)[1])})

    out = rows.mapInPandas(final, "spot_id long, w array<double>")
    profile = pd.DataFrame({"component": np.repeat(np.arange(1, k + 1), len(genes)), "gene_id": genes * k, "h": h.ravel()})
    return out, m.sparkSession.createDataFrame(profile, "component int, gene_id string, h double")


def deconv_spatial(m: DataFrame, k: int, top: int = 25, **how) -> dict[str, DataFrame]:
    """Corpus, fit, top genes, single-cell parts and each pixel's class, in one go."""
    _, theta, beta = fit_lda(corpus(m), k, **how)
    best = top_terms(beta, top).select("topic", "gene", "p")
    return {"theta": theta, "beta": best, "single_cells": single_cells(m, best), "deconvolved": deconvolve(m, theta, best), "classes": main_topic(theta)}


def share_of_types(counts: DataFrame) -> DataFrame:
    """Row proportions of a (patch, kind, n) contingency table."""
    total = counts.groupBy("patch").agg(F.sum("n").alias("_t"))
    return counts.join(total, "patch").select("patch", "kind", (F.col("n") / F.col("_t")).alias("share"))


def nrmse(df: DataFrame, obs: str, pred: str, kind: str = "sd") -> DataFrame:
    """Root mean squared error over the observations' sd, mean, range or interquartile range; 3 digits."""
    rmse = F.sqrt(F.avg((F.col(obs) - F.col(pred)) ** 2))
    by = {"sd": F.stddev_samp(obs), "mean": F.avg(obs), "maxmin": F.max(obs) - F.min(obs), "iq": F.percentile(obs, F.lit(0.75)) - F.percentile(obs, F.lit(0.25))}[kind]
    return df.agg(F.round(F.try_divide(rmse, by), 3).alias("nrmse"))




#: Most reference profiles that a deconvolution holds in every task.
MAX_PROFILES = 1000


def reference_shares(m: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each spot as non-negative parts of reference profiles (kind, gene_id, p): (spot_id, kind, share, residual).

    Genes that a spot or a profile lacks are 0; shares sum to 1 unless all are 0.
    """
    from ..functions.numeric import nnls

    table = profiles.toPandas().pivot(index="gene_id", columns="kind", values="p").fillna(0.0).sort_index()
    if table.shape[1] > MAX_PROFILES or table.shape[0] > MAX_TERMS:
        raise ValueError("too many reference profiles or genes")
    at, kinds, a = {g: i for i, g in enumerate(table.index)}, [str(k) for k in table.columns], table.to_numpy(float)
    known = m.join(F.broadcast(profiles.select("gene_id").distinct()), "gene_id", "left_semi")
    rows = known.groupBy("spot_id").agg(F.collect_list("gene_id").alias("g"), F.collect_list("value").alias("v"))

    def run(frames):
        for f in frames:
            out = []
            for spot, g, v in zip(f["spot_id"], f["g"], f["v"], strict=True):
                b = np.zeros(len(at))
                b[[at[x] for x in g]] = v
                x = nnls(a, b)
                left = float(((b - a @ x) ** 2).sum() / max((b**2).sum(), 1e-300))
                out += [(spot, k, s, left) for k, s in zip(kinds, x / (x.sum() or 1.0), strict=True)]
            yield pd.DataFrame(out, columns=["spot_id", "kind", "share", "residual"])

    return rows.mapInPandas(run, "spot_id long, kind string, share double, residual double")
