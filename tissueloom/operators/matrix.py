"""Matrix operators on long frames (gene_id, spot_id, value); absent pairs are zeros.

Statistics of a gene or a spot are aggregated (with partial sums) and joined back, so that a
gene with very many spots never has to fit one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranking import numbered
from ..functions.stats import benjamini_hochberg, chi2_isf, incomplete_beta
from ..sources.staging import stored


def _joined(m: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    return m.join(m.groupBy(key).agg(*aggregates), key)


def library_share(m: DataFrame, by: str = "spot_id") -> DataFrame:
    """Each value over its spot's total (0 where the total is 0)."""
    return _joined(m, by, F.sum("value").alias("_lib")).withColumn("value", F.when(F.col("_lib") == 0, 0.0).otherwise(F.try_divide("value", "_lib"))).drop("_lib")


def log2_cpm(m: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """log2(counts per million + pseudo); a library below 1 counts as 1."""
    lib = F.greatest("_lib", F.lit(1.0))
    return _joined(m, "spot_id", F.sum("value").alias("_lib")).withColumn("value", F.log2(F.col("value") / lib * 1e6 + pseudo)).drop("_lib")


def log10_cpm(m: DataFrame) -> DataFrame:
    """log10(counts per million + 1)."""
    return _joined(m, "spot_id", F.sum("value").alias("_lib")).withColumn("value", F.log10(F.coalesce(F.try_divide("value", "_lib"), F.lit(0.0)) * 1e6 + 1)).drop("_lib")


def log1p_scaled(m: DataFrame, scale: float = 1e4, empty: str = "one") -> DataFrame:
    """ln(1 + value / library * scale). An empty library counts as 1, or with ``empty='zero'`` makes the row 0."""
    bad = F.col("_lib") <= 0
    lib = F.when(bad, 1.0).otherwise(F.col("_lib"))
    value = F.log1p(F.col("value") / lib * scale)
    return _joined(m, "spot_id", F.sum("value").alias("_lib")).withColumn("value", F.when(bad, 0.0).otherwise(value) if empty == "zero" else value).drop("_lib")


def standardize(m: DataFrame, by: str = "gene_id") -> DataFrame:
    """z values with the population deviation; a deviation below 1e-8 counts as 1."""
    sd = F.when(F.col("_sd") < 1e-8, 1.0).otherwise(F.col("_sd"))
    return _joined(m, by, F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd")).withColumn("value", (F.col("value") - F.col("_mu")) / sd).drop("_mu", "_sd")


def destandardize(z: DataFrame, stats: DataFrame, by: str = "gene_id") -> DataFrame:
    """Back from z values with ``stats`` (key, mu, sd)."""
    sd = F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))
    return z.join(stats, by).withColumn("value", F.col("value") * sd + F.col("mu")).drop("mu", "sd")


def inverse_log(m: DataFrame, clamp: bool = False) -> DataFrame:
    """exp(value) - 1, with ``clamp`` never below 0."""
    value = F.expm1("value")
    return m.withColumn("value", F.greatest(value, F.lit(0.0)) if clamp else value)


def scale_range(m: DataFrame, by: str = "gene_id", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values of a key mapped linearly onto [low, high]; a constant key maps to low."""
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return _joined(m, by, F.min("value").alias("_lo"), F.max("value").alias("_hi")).withColumn("value", (F.col("value") - F.col("_lo")) / span * (high - low) + low).drop("_lo", "_hi")


def densify(m: DataFrame) -> DataFrame:
    """All gene x spot pairs, absent ones 0.

    The genes (a dimension: one array in one row) go to the spots, so that pairs are made where
    the spots are and no key gathers them.
    """
    genes = m.agg(F.sort_array(F.collect_set("gene_id")).alias("_g"))
    every = m.select("spot_id").distinct().join(F.broadcast(genes)).select(F.explode("_g").alias("gene_id"), "spot_id")
    return every.join(m, ["gene_id", "spot_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unify(m: DataFrame, levels: float = 10.0, log: bool = True) -> DataFrame:
    """Document levels of a dense matrix: logs (values up to 1 are 0), then each gene onto [1, levels]."""
    value = F.when(F.col("value") <= 1, 0.0).otherwise(F.log("value")) if log else F.col("value")
    return scale_range(m.withColumn("value", value), "gene_id", 1.0, levels)


def term_counts(levels: DataFrame) -> DataFrame:
    """Bag of words of unified levels: a gene occurs as often as its level, rounded half to even."""
    return levels.select("spot_id", "gene_id", F.bround("value").cast("long").alias("n")).where("n > 0")


def winsorize(m: DataFrame, q: float = 0.05, by: str = "gene_id") -> DataFrame:
    """Values clamped to their key's q and 1 - q quantiles (interpolated)."""
    stats = (F.percentile("value", F.lit(q)).alias("_lo"), F.percentile("value", F.lit(1 - q)).alias("_hi"))
    return _joined(m, by, *stats).withColumn("value", F.least(F.greatest("value", "_lo"), "_hi")).drop("_lo", "_hi")


def detection(m: DataFrame) -> DataFrame:
    """Per gene: spots with a value above 0, and all spots of the matrix."""
    total = m.agg(F.countDistinct("spot_id").alias("n_spots"))
    return m.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("detected"), F.sum("value").alias("total")).join(F.broadcast(total))


def gene_filter(m: DataFrame, p_min: float = 0.05, p_max: float = 0.95) -> DataFrame:
    """Without genes whose zero share is at least 1 - p_min or whose detected share is at least p_max."""
    d = detection(m)
    bad = ((F.col("n_spots") - F.col("detected")) / F.col("n_spots") >= 1 - p_min) | (F.col("detected") / F.col("n_spots") >= p_max)
    return m.join(d.where(~bad).select("gene_id"), "gene_id", "left_semi")


def presence_filter(m: DataFrame, above: float = 1.0, below: float = 0.05) -> DataFrame:
    """Without genes in at least ``above`` or at most ``below`` of the spots."""
    d = detection(m)
    return m.join(d.where((F.col("detected") < F.col("n_spots") * above) & (F.col("detected") > F.col("n_spots") * below)).select("gene_id"), "gene_id", "left_semi")


def clean_counts(m: DataFrame, min_lib: float = 1, max_lib: float | None = None, min_reads: float = 1, min_detected: int = 1) -> DataFrame:
    """Spots by library size, then genes by reads, then genes by detections; all bounds are strict."""
    lib = m.groupBy("spot_id").agg(F.sum("value").alias("_n")).where(F.col("_n") > min_lib)
    lib = lib.where(F.col("_n") < max_lib) if max_lib is not None else lib
    m = m.join(lib.select("spot_id"), "spot_id", "left_semi")
    m = m.join(m.groupBy("gene_id").agg(F.sum("value").alias("_n")).where(F.col("_n") > min_reads).select("gene_id"), "gene_id", "left_semi")
    return m.join(m.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("_n")).where(F.col("_n") > min_detected).select("gene_id"), "gene_id", "left_semi")


def drop_top_expressed(m: DataFrame, n: int) -> DataFrame:
    """Without the n genes of largest totals (ties: first gene id)."""
    top = m.groupBy("gene_id").agg(F.sum("value").alias("_t")).orderBy(F.desc("_t"), "gene_id").limit(n)
    return m.join(top, "gene_id", "left_anti")


def drop_matching(m: DataFrame, pattern: str) -> DataFrame:
    """Without genes whose id matches a regular expression."""
    return m.where(~F.col("gene_id").rlike(pattern))


def variances(m: DataFrame) -> DataFrame:
    """Per gene mean, sample and population variance over stored pairs."""
    return m.groupBy("gene_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var_samp"), F.var_pop("value").alias("var_pop"))


def top_variable(m: DataFrame, n: int, kind: str = "var_samp") -> DataFrame:
    """The n genes of largest variance (ties: first gene id)."""
    return variances(m).orderBy(F.desc(kind), "gene_id").limit(n).select("gene_id", F.col(kind).alias("variance"))


def overdispersed(m: DataFrame) -> DataFrame:
    """Log variance against log mean by least squares over genes; the residual ranks overdispersion.

    Genes without a positive mean and variance take no part.
    """
    v = variances(m).where("mean > 0 and var_samp > 0").select("gene_id", F.log("mean").alias("lm"), F.log("var_samp").alias("lv"))
    fit = v.agg(F.regr_slope("lv", "lm").alias("slope"), F.regr_intercept("lv", "lm").alias("intercept"))
    return v.join(F.broadcast(fit)).select("gene_id", "lm", "lv", (F.col("lv") - F.col("slope") * F.col("lm") - F.col("intercept")).alias("residual"))


def _spline_parts(x: Column, knots: list[float]) -> list[Column]:
    """A natural cubic spline's basis: 1, x, and one part for each inner knot."""
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))
    last = knots[-1]
    part = lambda k: (cube(k) - cube(last)) / (last - k)
    return [F.lit(1.0), x, *(part(k) - part(knots[-2]) for k in knots[:-2])]


def _spline_penalty(knots: list[float]) -> np.ndarray:
    """Integrals of products of the basis' second derivatives, which are linear between knots."""
    at = np.array(knots)
    bend = lambda k, x: 6 * (np.maximum(x - k, 0) - np.maximum(x - at[-1], 0)) / (at[-1] - k)
    second = lambda x: np.stack([np.zeros_like(x), np.zeros_like(x), *(bend(k, x) - bend(at[-2], x) for k in at[:-2])])
    lo, hi = at[:-1], at[1:]
    ends = [second(lo), second((lo + hi) / 2), second(hi)]
    return sum(w * np.einsum("ik,jk,k->ij", e, e, hi - lo) / 6 for w, e in zip((1, 4, 1), ends, strict=True))  # Simpson's rule is exact here


def overdispersed_genes(m: DataFrame, knots: int = 5, alpha: float = 0.05, adjusted: bool = True, least: float = 1e-3, most: float = 1e3) -> DataFrame:
    """Genes whose variance lies above the trend of log variance over log mean, with scale factors.

    The trend is a natural cubic spline of ``knots`` quantile knots, smoothed by generalised
    cross-validation; a line where there are under 1.5 genes a knot. All of the fit follows from
    sums over genes of the basis' products. Returns lm, lv, residual, p (F test of exp(residual) with
    as many degrees as spots), fdr, qv (chi-square quantile of p over the genes), ``scale`` = sqrt(qv
    within bounds / variance), and ``selected``. Genes without a positive mean and variance take no part.
    """
    v = stored(variances(m).where("mean > 0 and var_samp > 0").select("gene_id", F.log("mean").alias("lm"), F.log("var_samp").alias("lv")), "variances")
    n_obs = m.select("spot_id").distinct().count()
    n_genes = m.select("gene_id").distinct().count()
    about = v.agg(F.count("*").alias("n"), F.min("lm").alias("lo"), F.max("lm").alias("hi"), F.percentile("lm", F.array(*(F.lit(k / (knots - 1)) for k in range(knots)))).alias("q")).first()
    out = "gene_id string, lm double, lv double, residual double, p double, fdr double, qv double, scale double, selected boolean"
    if not about["n"]:
        return m.sparkSession.createDataFrame([], out)
    span = (about["hi"] - about["lo"]) or 1.0
    x = (F.col("lm") - about["lo"]) / span
    places = sorted({(q - about["lo"]) / span for q in about["q"]})
    curved = about["n"] >= 1.5 * knots and len(places) > 2
    parts = _spline_parts(x, places) if curved else [F.lit(1.0), x]
    size = len(parts)
    sums = v.agg(*(F.sum(parts[i] * parts[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)), *(F.sum(p * F.col("lv")).alias(f"h{i}") for i, p in enumerate(parts)), F.sum(F.col("lv") ** 2).alias("yy")).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    right = np.array([sums[f"h{i}"] for i in range(size)])
    penalty = _spline_penalty(places) if curved else np.zeros((size, size))
    best = None
    for weight in np.r_[np.geomspace(1e-8, 1e4, 61) * about["n"]] if curved else [0.0]:
        solve = np.linalg.pinv(gram + weight * penalty)
        b = solve @ right
        left = max(sums["yy"] - 2 * b @ right + b @ gram @ b, 0.0)
        free = about["n"] - np.trace(solve @ gram)
        score = left / free**2 if free > 1e-9 else math.inf
        if best is None or score < best[0]:
            best = (score, b)
    trend = sum((p * float(c) for p, c in zip(parts, best[1], strict=True)), F.lit(0.0))

    @F.pandas_udf("double")
    def tail(residual: pd.Series) -> pd.Series:
        return pd.Series(incomplete_beta(np.full(len(residual), n_obs / 2), n_obs / 2, 1 / (1 + np.exp(residual.to_numpy(float)))))

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series([chi2_isf(max(x, 1e-300), max(1, n_genes - 1)) / n_genes for x in p])

    fit = v.withColumn("residual", F.col("lv") - trend).withColumn("p", tail("residual"))
    fit = benjamini_hochberg(fit, "p").withColumn("qv", quantile("p"))
    scale = F.sqrt(F.greatest(F.lit(least), F.least(F.lit(most), F.col("qv"))) / F.exp("lv"))
    return fit.withColumn("scale", scale).withColumn("selected", F.col("fdr" if adjusted else "p") < alpha).select(*(c.split()[0] for c in out.split(", ")))


def restrict_corpus(m: DataFrame, above: float = 1.0, below: float = 0.05, n_top: int = 1000) -> DataFrame:
    """Presence bounds, then the n_top most overdispersed genes."""
    kept = presence_filter(m, above, below)
    top = overdispersed(kept).where("residual > 0").orderBy(F.desc("residual"), "gene_id").limit(n_top)
    return kept.join(top.select("gene_id"), "gene_id", "left_semi")


def mad(m: DataFrame) -> DataFrame:
    """Median absolute deviation of each gene."""
    med = _joined(m, "gene_id", F.median("value").alias("_m"))
    return med.groupBy("gene_id").agg(F.median(F.abs(F.col("value") - F.col("_m"))).alias("mad"))


def relative_median(m: DataFrame) -> DataFrame:
    """Values over their gene's median (null where it is 0)."""
    return _joined(m, "gene_id", F.median("value").alias("_m")).withColumn("value", F.try_divide("value", "_m")).drop("_m")


def top_per(m: DataFrame, key: str, item: str, n: int, score: str = "value") -> DataFrame:
    """The n items of largest score of each key, with their rank (ties: first item)."""
    # the best of each item first, so that a partial sort of the window's rank filter applies
    w = W.partitionBy(key).orderBy(F.desc(score), item)
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def filter_shares(theta: DataFrame, below: float = 0.05) -> DataFrame:
    """theta (pixel, topic, p): shares below a bound are 0, rows sum to 1 again, empty topics go."""
    cut = theta.withColumn("p", F.when(F.col("p") < below, 0.0).otherwise(F.col("p")))
    total = cut.groupBy("pixel").agg(F.sum("p").alias("_t"))
    out = cut.join(total, "pixel").withColumn("p", F.coalesce(F.try_divide("p", "_t"), F.lit(0.0))).drop("_t")
    return out.join(out.groupBy("topic").agg(F.sum("p").alias("_s")).where("_s > 0").select("topic"), "topic", "left_semi")


def reduce_shares(theta: DataFrame, top: int = 3) -> DataFrame:
    """Of each pixel the shares not below its ``top``-th largest (ties stay), renormalised."""
    w = W.partitionBy("pixel").orderBy(F.desc("p"))
    kept = theta.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= top).drop("_r")
    return kept.join(kept.groupBy("pixel").agg(F.sum("p").alias("_t")), "pixel").withColumn("p", F.coalesce(F.try_divide("p", "_t"), F.lit(0.0))).drop("_t")


def expressed_in(m: DataFrame, clusters: DataFrame, q: float = 0.2) -> DataFrame:
    """Genes whose non-zero share among a cluster's spots exceeds q: cluster, gene_id, share."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    hit = m.where("value > 0").join(clusters, "spot_id").groupBy("cluster", "gene_id").agg(F.count("*").alias("_hit"))
    return hit.join(sizes, "cluster").select("cluster", "gene_id", (F.col("_hit") / F.col("_n")).alias("share")).where(F.col("share") > q)


def hash_draw(*parts: Column) -> Column:
    """A number of 32 bits that depends on nothing but the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")


def bootstrap_means(m: DataFrame, n_samples: int = 32, seed: int = 1) -> DataFrame:
    """Bags of a fifth of the spots, drawn with replacement: the mean of each gene in each bag."""
    spots = numbered(m.select("spot_id").distinct(), "spot_id", out="pos").withColumn("pos", F.col("pos") - 1)
    n = spots.agg(F.count("*").alias("n"))
    draws = n.select(F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("bag"), "n").select("bag", "n", F.explode(F.sequence(F.lit(0), F.greatest((F.col("n") / 5).cast("long"), F.lit(1)) - 1)).alias("k"))
    draws = draws.select("bag", (hash_draw(F.col("bag").cast("string"), F.col("k").cast("string"), F.lit(str(seed))) % F.col("n")).alias("pos"))
    return draws.join(spots, "pos").join(m, "spot_id").groupBy("bag", "gene_id").agg(F.avg("value").alias("mean"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("spot_id").alias("gene_id"), F.col("gene_id").alias("spot_id"), "value")


def csr_rows(indptr: DataFrame) -> DataFrame:
    """CSR pointers (row, start, stop, indices, data) to long rows (row, col, value)."""
    ranges = F.when(F.col("stop") > F.col("start"), F.sequence("start", F.col("stop") - 1)).otherwise(F.array().cast("array<int>"))
    return indptr.select("row", F.explode(ranges).alias("k"), "indices", "data").select("row", F.get("indices", F.col("k")).alias("col"), F.get("data", F.col("k")).alias("value"))


def combine_topics(beta: DataFrame, clusters: DataFrame, kind: str = "mean") -> DataFrame:
    """Topics of one cluster as one: ``mean`` of profiles or ``sum`` of shares. beta: (topic, item, p)."""
    agg = F.avg("p") if kind == "mean" else F.sum("p")
    return beta.join(clusters, "topic").groupBy("cluster", "item").agg(agg.alias("p"))


def rare_topics(theta: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per fitted k: topics whose mean share is below the threshold. theta: (k, pixel, topic, p)."""
    return theta.groupBy("k", "topic").agg(F.avg("p").alias("_m")).groupBy("k").agg(F.count_if(F.col("_m") < threshold).alias("n_rare"))


def second_difference_knee(curve: DataFrame) -> DataFrame:
    """The x at which p[i+1] + p[i-1] - 2 p[i] is largest (ties: first x). curve: (x, p), one row a model."""
    w = W.orderBy("x")
    d = curve.withColumn("bend", F.lead("p").over(w) + F.lag("p").over(w) - 2 * F.col("p")).where("bend is not null")
    return d.orderBy(F.desc("bend"), "x").limit(1).select("x", "bend")


def preprocess(m: DataFrame, genes: DataFrame | None = None, min_lib: float = 1, min_reads: float = 1, min_detected: int = 1, drop_top: int = 0, drop_pattern: str | None = None, above: float = 1.0, below: float = 0.05, n_top: int | None = None) -> DataFrame:
    """Chosen genes, clean counts, without the most expressed, without a pattern, within presence bounds, overdispersed.

    Spots that end without a count go; each step sees what the one before left.
    """
    if genes is not None:
        m = m.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    m = clean_counts(m, min_lib, None, min_reads, min_detected)
    m = drop_top_expressed(m, drop_top) if drop_top else m
    m = drop_matching(m, drop_pattern) if drop_pattern else m
    m = restrict_corpus(m, above, below, n_top) if n_top else presence_filter(m, above, below)
    return m.join(m.groupBy("spot_id").agg(F.sum("value").alias("_n")).where("_n > 0").select("spot_id"), "spot_id", "left_semi")
