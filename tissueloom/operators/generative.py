"""Generative models of expression: a conditional autoencoder over time, and conditional diffusion.

Networks are small numpy ones, trained on the driver from a bounded sample of rows; scoring runs
over all rows in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .matrix import hash_draw

#: Most rows that a model is fitted on.
MAX_TRAINING_ROWS = 50_000


def training_rows(df: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> pd.DataFrame:
    """(id, vec, t) rows, at most ``max_rows`` of them, chosen by the ids' hash."""
    return df.select("id", "vec", "t").orderBy(F.xxhash64("id"), "id").limit(max_rows).toPandas().sort_values("id")


class Dense:
    """A layer with Adam: linear, with optional layer norm and ReLU."""

    def __init__(self, rng, n_in: int, n_out: int, norm: bool = True, relu: bool = True):
        self.p = {"w": rng.normal(0, math.sqrt(2 / n_in), (n_in, n_out)), "b": np.zeros(n_out)}
        if norm:
            self.p |= {"g": np.ones(n_out), "h": np.zeros(n_out)}
        self.norm, self.relu = norm, relu
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.grad: dict[str, np.ndarray] = {}

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x = x
        z = x @ self.p["w"] + self.p["b"]
        if self.norm:
            self.sd = np.sqrt(z.var(1, keepdims=True) + 1e-5)
            self.hat = (z - z.mean(1, keepdims=True)) / self.sd
            z = self.hat * self.p["g"] + self.p["h"]
        self.out = z
        return np.maximum(z, 0) if self.relu else z

    def backward(self, d: np.ndarray) -> np.ndarray:
        if self.relu:
            d = d * (self.out > 0)
        if self.norm:
            self.grad["g"], self.grad["h"] = (d * self.hat).sum(0), d.sum(0)
            e = d * self.p["g"]
            d = (e - e.mean(1, keepdims=True) - self.hat * (e * self.hat).mean(1, keepdims=True)) / self.sd
        self.grad["w"], self.grad["b"] = self.x.T @ d, d.sum(0)
        return d @ self.p["w"].T

    def step(self, rate: float, t: int) -> None:
        """One Adam step; t counts steps, not tensors."""
        for k, g in self.grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**t)) / (np.sqrt(self.v[k] / (1 - 0.999**t)) + 1e-8)


def hidden_sizes(dim: int) -> tuple[int, int]:
    return (512, 256) if dim >= 256 else (max(128, dim), max(64, dim // 2))


def weights_of(model) -> dict[str, np.ndarray]:
    """A network's weights by layer and name, for np.savez."""
    return {f"{k}.{n}": v for k, layer in enumerate(model.all_layers()) for n, v in layer.p.items()}


def with_weights(model, arrays):
    """The network with stored weights in place of its own; shapes must be the same."""
    layers = model.all_layers()
    for name in list(arrays):
        k, n = name.split(".")
        value = np.asarray(arrays[name])
        if value.shape != layers[int(k)].p[n].shape:
            raise ValueError(f"weights {name} have another shape")
        layers[int(k)].p[n] = value
    return model


class Cvae:
    """Conditional variational autoencoder: (vec, t in 0..1) -> latent -> vec."""

    def __init__(self, dim: int, latent: int = 16, seed: int = 42, hidden: tuple[int, int] | None = None):
        rng = np.random.default_rng(seed)
        a, b = hidden or hidden_sizes(dim)
        self.enc = [Dense(rng, dim + 1, a), Dense(rng, a, b)]
        self.mu, self.logvar = Dense(rng, b, latent, False, False), Dense(rng, b, latent, False, False)
        self.dec = [Dense(rng, latent + 1, b), Dense(rng, b, a), Dense(rng, a, dim, False, False)]
        self.rng, self.latent, self.t = rng, latent, 0

    def encode(self, x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.c_[x, t]
        for layer in self.enc:
            h = layer.forward(h)
        return self.mu.forward(h), np.clip(self.logvar.forward(h), -10, 10)

    def decode(self, z: np.ndarray, t: np.ndarray) -> np.ndarray:
        h = np.c_[z, t]
        for layer in self.dec:
            h = layer.forward(h)
        return h

    def train_batch(self, x: np.ndarray, t: np.ndarray, rate: float, beta: float) -> float:
        mu, lv = self.encode(x, t)
        noise = self.rng.normal(size=mu.shape)
        sd = np.exp(lv / 2)
        out = self.decode(mu + sd * noise, t)
        n = len(x)
        loss = ((out - x) ** 2).sum() / n + beta * -0.5 * (1 + lv - mu**2 - np.exp(lv)).sum() / n
        d = 2 * (out - x) / n
        for layer in reversed(self.dec):
            d = layer.backward(d)
        dz = d[:, : self.latent]
        h = self.mu.backward(dz + beta * mu / n) + self.logvar.backward(dz * noise * sd / 2 + beta * (np.exp(lv) - 1) / 2 / n)
        for layer in reversed(self.enc):
            h = layer.backward(h)
        self.t += 1
        for layer in (*self.enc, self.mu, self.logvar, *self.dec):
            layer.step(rate, self.t)
        return float(loss)

    def fit(self, x: np.ndarray, t: np.ndarray, epochs: int = 100, batch: int = 128, rate: float = 1e-3, beta: float = 0.1) -> list[float]:
        losses = []
        for e in range(epochs):
            order, total = self.rng.permutation(len(x)), 0.0
            for k in range(0, len(x), batch):
                i = order[k : k + batch]
                total += self.train_batch(x[i], t[i], rate * 0.95 ** (e // 10), beta) * len(i)
            losses.append(total / len(x))
        return losses

    def all_layers(self) -> list[Dense]:
        return [*self.enc, self.mu, self.logvar, *self.dec]

    def arrays(self) -> dict[str, np.ndarray]:
        return weights_of(self)

    def load(self, arrays) -> Cvae:
        return with_weights(self, arrays)


def scale_time(df: DataFrame, column: str = "t") -> DataFrame:
    """Times onto 0..1; one time maps to 0."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(span)).withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def unscale_time(t: Column, lo: float, hi: float) -> Column:
    return t * (hi - lo) + lo


def train_cvae(df: DataFrame, latent: int = 16, epochs: int = 30, seed: int = 42, max_rows: int = MAX_TRAINING_ROWS) -> tuple[Cvae, list[float]]:
    rows = training_rows(df, max_rows)
    x = np.stack(rows["vec"].to_numpy()).astype(float)
    model = Cvae(x.shape[1], latent, seed, (64, 32) if x.shape[1] < 256 else None)
    return model, model.fit(x, rows["t"].to_numpy(float), epochs)


def embed(df: DataFrame, model: Cvae) -> DataFrame:
    """Latent means of all rows: (id, z)."""

    def run(frames):
        for f in frames:
            mu, _ = model.encode(np.stack(f["vec"].to_numpy()).astype(float), f["t"].to_numpy(float))
            yield pd.DataFrame({"id": f["id"], "z": list(mu)})

    return df.select("id", "vec", "t").mapInPandas(run, "id long, z array<double>")


def reconstruct(df: DataFrame, model: Cvae) -> DataFrame:
    """(id, vec, rebuilt) of all rows."""

    def run(frames):
        for f in frames:
            x, t = np.stack(f["vec"].to_numpy()).astype(float), f["t"].to_numpy(float)
            yield pd.DataFrame({"id": f["id"], "vec": f["vec"], "rebuilt": list(model.decode(model.encode(x, t)[0], t))})

    return df.select("id", "vec", "t").mapInPandas(run, "id long, vec array<double>, rebuilt array<double>")


def evaluate(rebuilt: DataFrame) -> DataFrame:
    """Per gene of (vec, rebuilt): mean squared error, and R squared (0 for a constant gene)."""
    long = rebuilt.select(F.posexplode(F.arrays_zip("vec", "rebuilt")).alias("gene", "v")).select("gene", F.col("v.vec").alias("x"), F.col("v.rebuilt").alias("y"))
    stats = long.groupBy("gene").agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("mse"), F.var_pop("x").alias("_v"))
    return stats.select("gene", "mse", F.coalesce(1 - F.try_divide("mse", "_v"), F.lit(0.0)).alias("r2"))


def nearest_times(grid: DataFrame, times: DataFrame) -> DataFrame:
    """For each grid time the nearest sampled time at or before it, and at or after it.

    Sampled times are few distinct labels, so one window may order them with the grid.
    """
    every = grid.select("t", F.lit(None).cast("double").alias("_s")).unionByName(times.select("t", F.col("t").alias("_s")))
    w = W.orderBy("t", F.col("_s").isNull())
    back = W.orderBy(F.desc("t"), F.col("_s").isNull())
    out = every.withColumn("before", F.last("_s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.last("_s", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    return out.where("_s is null").select("t", "before", "after")


def time_grid(spark, lo: float, hi: float, step: float) -> DataFrame:
    n = int(math.floor((hi - lo) / step + 1e-9)) + 1
    return spark.range(n).select((F.lit(lo) + F.col("id") * step).alias("t"))


def interpolate(df: DataFrame, model: Cvae, step: float, strategy: str = "both", per_time: int = 10, seed: int = 1) -> DataFrame:
    """Rows between sampled times: (t, source, vec). df: (id, vec, t), t in 0..1.

    Grid times that were sampled are left out. From the ``before`` or ``after`` time, or ``both``, ``per_time`` rows
    (by the ids' hash) are encoded at their own time and decoded at the grid's; ``latent`` pairs
    them by rank and mixes their latents by the time between.
    """
    spark = df.sparkSession
    lo, hi = df.agg(F.min("t"), F.max("t")).first()
    times = df.select("t").distinct()
    grid = nearest_times(time_grid(spark, lo, hi, step), times).where("before < t and after > t")
    ranked = df.withColumn("k", F.row_number().over(W.partitionBy("t").orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id"))).where(F.col("k") <= per_time)
    of = lambda side: grid.join(ranked.select(F.col("t").alias(side), "id", "vec", "k"), side)
    if strategy == "latent":
        a, b = of("before").select("t", "before", "after", "k", "id", F.col("vec").alias("va")), of("after").select("t", "k", F.col("vec").alias("vb"))
        pairs = a.join(b, ["t", "k"])

        def mix(frames):
            for f in frames:
                ta, tb, t = (f[c].to_numpy(float) for c in ("before", "after", "t"))
                za, zb = model.encode(np.stack(f["va"]).astype(float), ta)[0], model.encode(np.stack(f["vb"]).astype(float), tb)[0]
                share = ((t - ta) / np.maximum(tb - ta, 1e-12))[:, None]
                yield pd.DataFrame({"t": t, "source": "latent", "vec": list(model.decode(za * (1 - share) + zb * share, t))})

        return pairs.mapInPandas(mix, "t double, source string, vec array<double>")
    sides = {"before": ["before"], "after": ["after"], "both": ["before", "after"]}[strategy]
    rows = None
    for side in sides:
        part = of(side).select("t", F.col(side).alias("own"), "vec", F.lit(side).alias("source"))
        rows = part if rows is None else rows.unionByName(part)

    def shift(frames):
        for f in frames:
            z = model.encode(np.stack(f["vec"]).astype(float), f["own"].to_numpy(float))[0]
            yield pd.DataFrame({"t": f["t"], "source": f["source"], "vec": list(model.decode(z, f["t"].to_numpy(float)))})

    return rows.mapInPandas(shift, "t double, source string, vec array<double>")


# ---- diffusion ------------------------------------------------------------------------------------------
def noise_schedule(steps: int, kind: str = "linear") -> pd.DataFrame:
    """beta, alpha, alpha_bar and posterior sigma of each step (from 1)."""
    t = np.arange(1, steps + 1)
    if kind == "linear":
        beta = np.linspace(1e-4, 0.02, steps)
    elif kind == "cosine":
        f = lambda x: np.cos((x / (steps + 1) + 0.008) / 1.008 * math.pi / 2) ** 2
        beta = np.clip(1 - f(t) / f(t - 1), 0, 0.999)
    else:
        raise ValueError(kind)
    bar = np.cumprod(1 - beta)
    before = np.r_[1.0, bar[:-1]]
    return pd.DataFrame({"step": t, "beta": beta, "alpha": 1 - beta, "alpha_bar": bar, "sigma": np.sqrt(beta * (1 - before) / (1 - bar))})


def schedule(spark, steps: int, kind: str = "linear") -> DataFrame:
    """The schedule as a frame (a row a step): beta, alpha_bar by a running sum of logarithms, posterior variance (the first step's is its beta)."""
    f = lambda t: F.pow(F.cos((t / F.lit(steps + 1) + 0.008) / 1.008 * (math.pi / 2)), F.lit(2.0))
    if kind == "linear":
        beta = F.lit(1e-4) + (F.col("id") * ((0.02 - 1e-4) / max(steps - 1, 1)))
    elif kind == "cosine":
        beta = F.least(F.lit(0.999), 1 - f(F.col("id") + 1) / f(F.col("id")))
    else:
        raise ValueError(kind)
    w = W.orderBy("step")
    bar = F.exp(F.sum(F.log(1 - F.col("beta"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = spark.range(steps).select((F.col("id") + 1).alias("step"), beta.alias("beta")).withColumn("alpha_bar", bar)
    before = F.lag("alpha_bar").over(w)
    return out.withColumn("posterior_variance", F.when(before.isNull(), F.col("beta")).otherwise(F.col("beta") * (1 - before) / (1 - F.col("alpha_bar"))))


def time_embedding(t: np.ndarray, dim: int) -> np.ndarray:
    """Sinusoids of geometric frequencies: sines, then cosines."""
    half = dim // 2
    freq = np.exp(-math.log(10000) * np.arange(half) / max(half - 1, 1))
    return np.c_[np.sin(t[:, None] * freq), np.cos(t[:, None] * freq)]


def time_embedding_columns(t: Column, dim: int) -> Column:
    half = dim // 2
    angle = lambda k: t * F.exp(-math.log(10000) * k / max(half - 1, 1))
    k = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(k, lambda i: F.sin(angle(i))), F.transform(k, lambda i: F.cos(angle(i))))


class Diffusion:
    """Denoising diffusion of vectors under a scalar condition: a network of four layers guesses the noise."""

    def __init__(self, dim: int, steps: int = 100, kind: str = "cosine", width: int = 64, embed: int = 16, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.layers = [Dense(rng, dim + embed + 1, width, False), Dense(rng, width, width, False), Dense(rng, width, width, False), Dense(rng, width, dim, False, False)]
        self.noise, self.dim, self.steps, self.embed, self.rng, self.t = noise_schedule(steps, kind), dim, steps, embed, rng, 0

    def all_layers(self) -> list[Dense]:
        return self.layers

    def arrays(self) -> dict[str, np.ndarray]:
        return weights_of(self)

    def load(self, arrays) -> Diffusion:
        return with_weights(self, arrays)

    def guess(self, x: np.ndarray, step: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = np.c_[x, time_embedding(step.astype(float), self.embed), c]
        for layer in self.layers:
            h = layer.forward(h)
        return h

    def noised(self, x: np.ndarray, step: np.ndarray, eps: np.ndarray) -> np.ndarray:
        bar = self.noise["alpha_bar"].to_numpy()[step - 1][:, None]
        return np.sqrt(bar) * x + np.sqrt(1 - bar) * eps

    def fit(self, x: np.ndarray, c: np.ndarray, epochs: int = 50, batch: int = 128, rate: float = 1e-3) -> list[float]:
        losses = []
        for _ in range(epochs):
            order, total = self.rng.permutation(len(x)), 0.0
            for k in range(0, len(x), batch):
                i = order[k : k + batch]
                step, eps = self.rng.integers(1, self.steps + 1, len(i)), self.rng.normal(size=(len(i), self.dim))
                err = self.guess(self.noised(x[i], step, eps), step, c[i]) - eps
                d = 2 * err / err.size
                for layer in reversed(self.layers):
                    d = layer.backward(d)
                self.t += 1
                for layer in self.layers:
                    layer.step(rate, self.t)
                total += float((err**2).mean()) * len(i)
            losses.append(total / len(x))
        return losses

    def sample(self, c: np.ndarray, seed: int = 1) -> np.ndarray:
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(len(c), self.dim))
        for row in self.noise.iloc[::-1].itertuples():
            eps = self.guess(x, np.full(len(c), row.step), c)
            x = (x - row.beta / math.sqrt(1 - row.alpha_bar) * eps) / math.sqrt(row.alpha)
            if row.step > 1:
                x += row.sigma * rng.normal(size=x.shape)
        return x


def train_diffusion(df: DataFrame, steps: int = 50, epochs: int = 40, seed: int = 42, max_rows: int = MAX_TRAINING_ROWS) -> tuple[Diffusion, list[float]]:
    rows = training_rows(df, max_rows)
    x = np.stack(rows["vec"].to_numpy()).astype(float)
    model = Diffusion(x.shape[1], steps, seed=seed)
    return model, model.fit(x, rows["t"].to_numpy(float), epochs)


def predict_states(conditions: DataFrame, model: Diffusion, n_samples: int = 16) -> DataFrame:
    """Mean and population deviation of samples under each condition: conditions (id, t) -> (id, mean, sd)."""

    def run(frames):
        for f in frames:
            out = []
            for i, t in zip(f["id"], f["t"], strict=True):
                x = model.sample(np.full(n_samples, float(t)), seed=int(i) + 1)
                out.append((i, x.mean(0), x.std(0)))
            yield pd.DataFrame(out, columns=["id", "mean", "sd"])

    return conditions.select("id", "t").mapInPandas(run, "id long, mean array<double>, sd array<double>")


def synthetic_cells(spark, n_cells: int = 800, n_genes: int = 20, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Cells along a condition in 0..1 whose genes follow sine, line or bump: (cell, condition, gene, value).

    Parameters and noise come from hashes of (gene, cell, seed), so partitions do not matter.
    """
    u = lambda *k: hash_draw(*(x.cast("string") for x in k), F.lit(str(seed))) / float(1 << 32)
    cells = spark.range(n_cells).select(F.col("id").alias("cell"), (F.col("id") / max(n_cells - 1, 1)).alias("condition"))
    g = F.col("gene")
    long = cells.withColumn("gene", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))))
    base, amp, freq, phase = 5 + 10 * u(g, F.lit("b")), 2 + 5 * u(g, F.lit("a")), 0.5 + 2 * u(g, F.lit("f")), 2 * math.pi * u(g, F.lit("p"))
    c = F.col("condition")
    signal = F.when(g % 3 == 0, amp * F.sin(2 * math.pi * freq * c + phase)).when(g % 3 == 1, amp * (2 * c - 1)).otherwise(amp * F.exp(-((c - 0.5) ** 2) / 0.08))
    normal = F.sqrt(-2 * F.log(u(g, F.col("cell"), F.lit("x")) + 1e-12)) * F.cos(2 * math.pi * u(g, F.col("cell"), F.lit("y")))
    return long.select("cell", "condition", "gene", F.greatest(base + signal + normal * noise * base, F.lit(0.0)).alias("value"))
