"""Groups of vectors: hashed controls, mixtures, hierarchies, graph communities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.vectors import unit
from recallspark.session import stash


def random_groups(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A control: groups by the hash of the id."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return rows.select(key, F.pmod(number, F.lit(k)).cast("int").alias("group_id"))


def project(rows: DataFrame, vector: str = "embedding", share: float = 0.95) -> DataFrame:
    """``x``: as many principal components as hold ``share`` of the variance, up to the dimension."""
    data = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    most = data.select(F.size(vector).alias("d")).first().d
    model = PCA(k=most, inputCol="_v", outputCol="_p").fit(data)
    held = np.cumsum(np.array(model.explainedVariance))
    keep = int(max(min(2, most), min(most, np.searchsorted(held, share) + 1)))
    return model.transform(data).withColumn("x", F.slice(vector_to_array("_p"), 1, keep)).drop("_v", "_p")


class Mixture:
    """A diagonal Gaussian mixture; E and M steps are one distributed pass each round."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> None:
        self.weights, self.means, self.variances = weights, means, variances

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the squares taken apart, so that no array of rows x components x dimensions exists
        d = (x * x) @ (1 / self.variances).T - 2 * x @ (self.means / self.variances).T
        d = d + (self.means**2 / self.variances + np.log(2 * np.pi * self.variances)).sum(1)
        log = np.log(self.weights + 1e-12) - 0.5 * d
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return np.exp(log - total[:, None]), total


def _start(sample: np.ndarray, k: int, seed: int) -> Mixture:
    """Means spread over a sample, each drawn by its distance from those before."""
    rng = np.random.default_rng(seed)
    means = [sample[rng.integers(len(sample))]]
    d = np.full(len(sample), np.inf)
    while len(means) < k:
        d = np.minimum(d, ((sample - means[-1]) ** 2).sum(1))
        means.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() else sample[rng.integers(len(sample))])
    return Mixture(np.full(k, 1 / k), np.array(means), np.tile(sample.var(0) + 1e-3, (k, 1)))


def fit_mixtures(rows: DataFrame, wanted: list[tuple[int, int]], rounds: int = 8, tol: float = 1e-4, starts: list[np.ndarray] | None = None) -> list[tuple[Mixture, float]]:
    """Mixture and log-likelihood of column ``x`` for each wanted (k, seed).

    All are fitted in the same passes. Starting means come from a sample of at most
    50 rows a component; what comes to the driver is bounded by the components.
    """
    spark = rows.sparkSession
    n, most = rows.count(), max(k for k, _ in wanted)
    share = min(1.0, 100 * most / max(n, 1))
    sample = np.array([r.x for r in rows.select("x").sample(share, 0).limit(50 * most).collect()] or [r.x for r in rows.select("x").limit(most).collect()])
    models = [_start(sample, k, seed) for k, seed in wanted]
    for model, means in zip(models, starts or []):
        model.means = np.asarray(means, float)
    likelihood, running = [-np.inf] * len(models), set(range(len(models)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast({m: models[m] for m in running})

        def step(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums: dict[int, list] = {}
            for frame in frames:
                x = np.array(frame["x"].tolist())
                for m, model in shared.value.items():
                    p, total = model.posterior(x)
                    new = [p.sum(0), p.T @ x, p.T @ (x * x), total.sum()]
                    sums[m] = [a + b for a, b in zip(sums[m], new)] if m in sums else new
            for m, (mass, s, q, total) in sums.items():
                k = len(mass)
                yield pd.DataFrame({"m": m, "j": range(k), "n": mass, "s": s.tolist(), "q": q.tolist(), "l": [total, *[0.0] * (k - 1)]})

        parts = rows.select("x").mapInPandas(step, "m int, j int, n double, s array<double>, q array<double>, l double")
        added = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(sample.shape[1])]).alias(c)
        found = parts.groupBy("m", "j").agg(F.sum("n").alias("n"), added("s"), added("q"), F.sum("l").alias("l")).toPandas()
        for m, sums in found.sort_values(["m", "j"]).groupby("m"):
            mass = sums["n"].to_numpy() + 1e-9
            means = np.array(sums["s"].tolist()) / mass[:, None]
            variances = np.maximum(np.array(sums["q"].tolist()) / mass[:, None] - means**2, 1e-6)
            models[m] = Mixture(mass / mass.sum(), means, variances)
            now = float(sums["l"].sum())
            if abs(now - likelihood[m]) < tol * max(abs(now), 1.0):
                running.discard(m)
            likelihood[m] = now
        if not running:
            break
    return list(zip(models, likelihood))


def fit_from(rows: DataFrame, means: np.ndarray, rounds: int = 8) -> Mixture:
    """A mixture whose components start at given means."""
    return fit_mixtures(rows, [(len(means), 0)], rounds, starts=[means])[0][0]


def select_mixture(rows: DataFrame, ks: Sequence[int] | None = None, seeds: Sequence[int] = (0, 1, 2)) -> Mixture:
    """Of 1 to min(60, n / 10) components the number with the lowest Bayesian information criterion, averaged over seeds."""
    n = rows.count()
    ks = [k for k in ks if k <= n] if ks else range(1, max(1, min(60, n // 10)) + 1)
    wanted = [(k, seed) for k in ks for seed in seeds]
    fitted = fit_mixtures(rows, wanted)
    bics: dict[int, list[float]] = {}
    for (k, _), (model, likelihood) in zip(wanted, fitted):
        d = model.means.shape[1]
        bics.setdefault(k, []).append((2 * k * d + k - 1) * np.log(max(n, 2)) - 2 * likelihood)
    best = min(bics, key=lambda k: (np.mean(bics[k]), k))
    return max((f for (k, _), f in zip(wanted, fitted) if k == best), key=lambda f: f[1])[0]


def soft_groups(rows: DataFrame, model: Mixture, key: str) -> DataFrame:
    """Memberships: each row joins its exp(entropy) most likely groups, rounded half to even."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p, _ = shared.value.posterior(np.array(frame["x"].tolist()))
            entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
            many = np.clip(np.rint(np.exp(entropy)), 1, p.shape[1]).astype(int)
            order = np.argsort(-p, axis=1, kind="stable")
            ids, groups = [], []
            for i, key_ in enumerate(frame[key]):
                ids += [key_] * many[i]
                groups += order[i, : many[i]].tolist()
            yield pd.DataFrame({key: ids, "group_id": groups})

    return rows.select(key, "x").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, group_id int")


def mutual_neighbours(rows: DataFrame, key: str, vector: str = "embedding", k: int | None = None, block: int = 2048) -> DataFrame:
    """``key``, other, sim: pairs (key < other) each among the other's ``k`` nearest of all rows.

    ``k`` is floor(log2 n) unless given. Exact: every pair of hashed blocks is one
    product of two small matrices that gives ``k`` rows a vector, so no list of
    pairs exists; the arithmetic is quadratic in the rows. Ties fall to the smaller id.
    """
    u = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), unit(F.col(vector)).alias("u"))
    n = u.count()
    k = k or max(2, max(2, n).bit_length() - 1)
    blocks = -(-n // block) or 1
    u = u.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        ids, others = asked["id"].to_numpy(), held["id"].to_numpy()
        sim = np.round(np.array(asked["u"].tolist()) @ np.array(held["u"].tolist()).T, 9)
        sim[ids[:, None] == others] = -np.inf
        least = np.partition(sim, -min(k, len(others)), axis=1)[:, -min(k, len(others))]
        at, to = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        order = np.lexsort((others[to], -sim[at, to], at))
        at, to = at[order], to[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        at, to = at[kept], to[kept]
        return pd.DataFrame({"id": ids[at], "other": others[to], "sim": sim[at, to]})

    kind = dict(u.dtypes)["id"]
    asked = u.select("id", "u", F.col("own").alias("a"), every.alias("b"))
    held = u.select("id", "u", every.alias("a"), F.col("own").alias("b"))
    found = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInPandas(best, f"id {kind}, other {kind}, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    near = stash(found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"), "near")
    back = near.select(F.col("other").alias("id"), F.col("id").alias("other"))
    return near.join(back, ["id", "other"], "left_semi").where((F.col("id") < F.col("other")) & (F.col("sim") > 0)).withColumnRenamed("id", key)


def hierarchical_groups(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Divisive hierarchy cut at ``k`` leaves."""
    data = rows.withColumn("features", array_to_vector(F.col("x")))
    return BisectingKMeans(k=k, seed=seed).fit(data).transform(data).select(key, F.col("prediction").alias("group_id"))


def spectral_groups(edges: DataFrame, k: int) -> DataFrame:
    """Power-iteration clustering of a similarity graph (src, dst, weight)."""
    model = PowerIterationClustering(k=k, maxIter=20, weightCol="weight")
    return model.assignClusters(edges).select("id", F.col("cluster").alias("group_id"))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Communities by weighted label propagation: id, group_id (its smallest member's label).

    ``edges``: src, dst, weight, each pair once. Ties take the smaller label.
    """
    both = stash(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "edges")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, both.dst == labels.id).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max_by(F.struct("label"), F.struct(F.round("w", 9), -F.col("label"))).alias("b"))
        labels = stash(best.select(F.col("src").alias("id"), F.col("b.label").alias("label")), "labels")
    return labels.select("id", F.col("label").alias("group_id"))
