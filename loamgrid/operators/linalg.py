"""Linear algebra on landmark-sized arrays (driver), and leverage of cells from one Gram matrix (Spark)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import elbow


#: Features up to which a sample's Gram matrix is made.
GRAM = 256


@dataclass
class PCA:
    center: np.ndarray
    scale: np.ndarray
    rotation: np.ndarray
    d: np.ndarray
    coord: np.ndarray

    @property
    def sdev(self) -> np.ndarray:
        return self.d / np.sqrt(max(1, len(self.coord) - 1))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale @ self.rotation


def pca(x: np.ndarray, k: int = 30, scale: bool = True) -> PCA:
    """Principal components of rows; signs are fixed so that the largest loading of each is positive."""
    center = x.mean(0)
    sd = x.std(0, ddof=1) if scale and len(x) > 1 else np.ones(x.shape[1])
    sd = np.where(sd > 0, sd, 1.0)
    u, d, vt = np.linalg.svd((x - center) / sd, full_matrices=False)
    k = min(k, int((d > 1e-9 * max(d[0], 1e-300)).sum())) or 1
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
    return PCA(center, sd, (vt[:k] * sign[:, None]).T, d[:k], u[:, :k] * d[:k] * sign)


def reconstructed(model: PCA) -> tuple[np.ndarray, np.ndarray]:
    """(scaled, expression) of the rows that the model was made of, from its components alone: standardised anew, and in the units of the data."""
    z = model.coord @ model.rotation.T
    sd = z.std(0, ddof=1) if len(z) > 1 else np.ones(z.shape[1])
    return (z - z.mean(0)) / np.where(sd > 0, sd, 1.0), z * model.scale + model.center


def vectors(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """Rows as a dense array: of features, or of places (at) and values (x)."""
    if "features" in pdf:
        return np.stack(pdf["features"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width))
    out = np.zeros((len(pdf), width))
    size = pdf["at"].map(len).to_numpy()
    out[np.repeat(np.arange(len(pdf)), size), np.concatenate([np.zeros(0, int), *pdf["at"]]).astype(int)] = np.concatenate([np.zeros(0), *pdf["x"]])
    return out


class LogCounts:
    """Rows of counts (at, x: all features of a cell) as dense arrays of log2(count / (total / mean) + 1) of chosen features.

    place: the column of each feature, or -1, for all cells or by sample; mean: of totals, for all cells or by sample.
    """

    def __init__(self, place: np.ndarray | dict, mean: float | dict, width: int):
        self.place, self.mean, self.width = place, mean, width

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), self.width))
        row, at, value = logged(pdf, self.mean)
        if isinstance(self.place, dict):
            col = np.full(len(at), -1)
            sample = pdf["sample_id"].to_numpy()
            for s in set(sample.tolist()):
                own = (sample == s)[row]
                col[own] = self.place[s][at[own]]
        else:
            col = self.place[at]
        kept = col >= 0
        out[row[kept], col[kept]] = value[kept]
        return out


def logged(pdf: pd.DataFrame, mean: float | dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, normalised log value) of rows of counts."""
    row = np.repeat(np.arange(len(pdf)), pdf["at"].map(len).to_numpy(int))
    at, x = np.concatenate([np.zeros(0, int), *pdf["at"]]).astype(int), np.concatenate([np.zeros(0), *pdf["x"]])
    m = np.array([mean[s] for s in pdf["sample_id"].tolist()], float) if isinstance(mean, dict) else np.full(len(pdf), float(mean))
    total = np.bincount(row, x, len(pdf))
    return row, at, np.log2(x / (total / m)[row] + 1)


def count_moments(rows: DataFrame, mean: dict, features: int) -> DataFrame:
    """(sample_id, feature, n, mean, variance) of normalised log values of rows of counts, absent zeros included: one pass, partial sums in each task."""
    held = rows.sparkSession.sparkContext.broadcast(mean)
    kind = f"sample_id {rows.schema['sample_id'].dataType.simpleString()}"

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            pdf = pdf[pdf["at"].map(len) > 0]
            for s, own in pdf.groupby("sample_id"):
                _, at, v = logged(own, held.value)
                k, a, q = sums.get(s, (0, np.zeros(features), np.zeros(features)))
                sums[s] = k + len(own), a + np.bincount(at, v, features), q + np.bincount(at, v * v, features)
        for s, (k, a, q) in sums.items():
            some = np.flatnonzero(a)
            yield pd.DataFrame({"sample_id": s, "feature": np.r_[some, -1], "s": np.r_[a[some], k], "q": np.r_[q[some], 0.0]})  # feature -1 counts the cells

    flat = rows.select("sample_id", "at", "x").mapInPandas(run, f"{kind}, feature int, s double, q double").groupBy("sample_id", "feature").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.max(F.when(F.col("feature") == -1, F.col("s"))).over(Window.partitionBy("sample_id"))  # a sample's features
    var = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    return flat.withColumn("n", n).where("feature >= 0").select("sample_id", "feature", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("mean"), var.alias("variance"))


def _columns(cells: DataFrame) -> list[str]:
    return ["features"] if "features" in cells.columns else ["at", "x"]


def _sums(cells: DataFrame, of, dense, step: int = 2000) -> dict:
    """By sample the sum of of(rows, sample), a flat array: partial sums of each partition, added up by position in a shuffle."""
    kind = f"sample_id {cells.schema['sample_id'].dataType.simpleString()}"

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                x = dense(part)
                for s, at in part.groupby("sample_id").indices.items():
                    v = of(x[at], s)
                    held[s] = held[s] + v if s in held else v
        yield pd.DataFrame([{"sample_id": s, "v": v} for s, v in held.items()], columns=["sample_id", "v"])

    flat = cells.select("sample_id", *_columns(cells)).mapInPandas(run, f"{kind}, v array<double>").select("sample_id", F.posexplode("v").alias("i", "v"))
    whole = flat.groupBy("sample_id", "i").agg(F.sum("v").alias("v")).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))
    return {r.sample_id: np.array(r.v) for r in whole.select("sample_id", F.col("v.v").alias("v")).toLocalIterator()}  # one array a sample


def leverage(cells: DataFrame, components: int | None = None, width: int | None = None, rounds: int = 8, seed: int = 123, dense=None) -> DataFrame:
    """(sample_id, cell_id, weight): each cell's statistical leverage within its sample, after centring and scaling.

    Up to ``GRAM`` features one pass sums n, x and x x' for each sample (features squared in size, whatever the number of cells), and one
    map scores the cells. With components, only that many leading directions count. Of more features x x' is never made: the
    leading directions come from ``rounds`` passes of a block power iteration, whose sums are features x components.
    cells: with features, or with at and x (then ``width`` is the number of features). dense: makes arrays of rows, ``vectors`` by default.
    """
    p = width if width is not None else len(cells.select("features").first()[0])
    dense = dense or (lambda pdf: vectors(pdf, p))
    kind = f"sample_id {cells.schema['sample_id'].dataType.simpleString()}"
    if p <= GRAM:
        sums = _sums(cells, lambda x, _: np.r_[len(x), x.sum(0), (x.T @ x).ravel()], dense)
    else:
        sums = _sums(cells, lambda x, _: np.r_[len(x), x.sum(0), (x * x).sum(0)], dense)
    models = {}
    for s, v in sums.items():
        n, mean = v[0], v[1 : 1 + p] / v[0]
        square = np.diag(v[1 + p :].reshape(p, p)) if p <= GRAM else v[1 + p :]
        var = square - n * mean * mean
        sd = np.sqrt(np.maximum(var / max(1, n - 1), 0))
        sd = np.where(sd > 1e-12, sd, 1.0)
        if p <= GRAM:
            cov = (v[1 + p :].reshape(p, p) - n * np.outer(mean, mean)) / np.outer(sd, sd)
            values, axes = np.linalg.eigh(cov)
            keep = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-300))[::-1][: components or p]
            models[s] = mean, sd, axes[:, keep] / np.sqrt(values[keep])
        else:
            models[s] = mean, sd, None
    if p > GRAM:
        if components is None:
            raise ValueError(f"of over {GRAM} features say how many components count")
        models = _leading(cells, models, p, components, rounds, seed, dense)
    held = cells.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                weight, x = np.zeros(len(part)), dense(part)
                for s, at in part.groupby("sample_id").indices.items():
                    mean, sd, axes = held.value[s]
                    weight[at] = ((((x[at] - mean) / sd) @ axes) ** 2).sum(1)
                yield pd.DataFrame({"sample_id": part["sample_id"], "cell_id": part["cell_id"], "weight": weight})

    return cells.select("sample_id", "cell_id", *_columns(cells)).mapInPandas(score, f"{kind}, cell_id {cells.schema['cell_id'].dataType.simpleString()}, weight double")


def _leading(cells: DataFrame, models: dict, p: int, components: int, rounds: int, seed: int, dense) -> dict:
    """models with the leading axes of each sample, over the root of their eigenvalues."""
    k = min(p, components + 10)
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, k)))[0]
    axes = {s: start for s in models}
    for step in range(rounds):
        held = cells.sparkSession.sparkContext.broadcast({s: (m, sd, axes[s]) for s, (m, sd, _) in models.items()})

        def of(x, s, held=held):
            mean, sd, q = held.value[s]
            z = (x - mean) / sd
            return (z.T @ (z @ q)).ravel()

        made = {s: v.reshape(p, k) for s, v in _sums(cells, of, dense).items()}
        held.destroy()
        if step + 1 < rounds:
            axes = {s: np.linalg.qr(v)[0] for s, v in made.items()}
    out = {}
    for s, (mean, sd, _) in models.items():
        values, turn = np.linalg.eigh((axes[s].T @ made[s] + made[s].T @ axes[s]) / 2)
        keep = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-300))[::-1][:components]
        out[s] = mean, sd, axes[s] @ turn[:, keep] / np.sqrt(values[keep])
    return out


def projected_leverage(cells: DataFrame, model: PCA, dense=None) -> DataFrame:
    """(sample_id, cell_id, weight): the sum of squared scores on landmark components, each over its singular value. A pure map."""
    kind = f"sample_id {cells.schema['sample_id'].dataType.simpleString()}, cell_id {cells.schema['cell_id'].dataType.simpleString()}"
    held = cells.sparkSession.sparkContext.broadcast((model.center, model.scale, model.rotation / model.d))
    width = len(model.center)
    dense = dense or (lambda pdf: vectors(pdf, width))

    def score(batches):
        center, scale, axes = held.value
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                yield pd.DataFrame({"sample_id": part["sample_id"], "cell_id": part["cell_id"], "weight": ((((dense(part) - center) / scale) @ axes) ** 2).sum(1)})

    return cells.select("sample_id", "cell_id", *_columns(cells)).mapInPandas(score, f"{kind}, weight double")


def laplacian_eigenmap(w: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, eigenvalues) of the normalised Laplacian of a symmetric graph; the elbow of the spectrum sets how many."""
    a = ((w > 0) | (w.T > 0)).astype(float)
    np.fill_diagonal(a, 0)
    d = np.maximum(a.sum(1), 1e-12)
    a *= -1 / np.sqrt(d)[:, None]  # in place: landmarks squared is the largest array on the driver
    a *= 1 / np.sqrt(d)
    a[np.diag_indices(len(a))] += 1
    values, vectors = np.linalg.eigh(a)
    keep = np.flatnonzero(values > 1e-6)[: max(2, min(most, len(a) - 1))]
    values, vectors = values[keep], vectors[:, keep]
    k = len(values)
    if k >= 4 and np.ptp(values) > 1e-12:
        k = int(np.clip(elbow(values, descending=False) + 1, 2, most))
    coord = vectors[:, :k] / np.sqrt(d)[:, None]
    return coord / np.linalg.norm(coord, axis=0), values[:k]


def diffusion_map(x: np.ndarray, k: int = 20) -> np.ndarray:
    """Coordinates of rows by a Gaussian-free cosine kernel: eigenvectors times the root of eigenvalues."""
    y = x - x.mean(0)
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    kernel = (y @ y.T + 1) / 2
    d = kernel.sum(1)
    values, vectors = np.linalg.eigh(kernel / np.sqrt(np.outer(d, d)))
    order = np.argsort(-values)[1 : k + 1]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def batch_corrected(z: np.ndarray, batch: np.ndarray, clusters: int | None = None, rounds: int = 10, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, seed: int = 123) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Soft k-means with a diversity penalty, then a ridge regression of batch within clusters: (corrected, memberships, centroids)."""
    n = len(z)
    k = clusters or int(max(20, min(round(n / 30), 100)))
    k = min(k, n)
    levels = sorted(set(batch.tolist()))
    phi = np.array([[b == x for x in levels] for b in batch.tolist()], float)
    share = phi.mean(0)
    rng = np.random.default_rng(seed)
    out = z.copy()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    y = unit(z)[rng.choice(n, k, replace=False)]
    r = np.full((n, k), 1 / k)
    for _ in range(rounds):
        for _ in range(10):
            logit = -2 * (1 - unit(out) @ y.T) / sigma
            seen, due = phi.T @ r, np.outer(share, r.sum(0))
            logit += theta * (phi @ np.log((due + 1) / (seen + 1)))
            logit -= logit.max(1, keepdims=True)
            r = np.exp(logit)
            r /= r.sum(1, keepdims=True)
            y = unit(r.T @ unit(out))
        design = np.c_[np.ones(n), phi]
        new = z.copy()
        for c in range(k):
            wd = design * r[:, [c]]
            beta = np.linalg.solve(wd.T @ design + ridge * np.diag(np.r_[0, np.ones(len(levels))]) + 1e-9 * np.eye(1 + len(levels)), wd.T @ z)
            beta[0] = 0
            new -= wd @ beta
        if np.abs(new - out).max() < 1e-4 * np.abs(z).max():
            out = new
            break
        out = new
    return out, r, y


def memberships(z: np.ndarray, centroids: np.ndarray, sigma: float = 0.1) -> np.ndarray:
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    logit = -2 * (1 - unit @ centroids.T) / sigma
    r = np.exp(logit - logit.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True)


def query_betas(sums: dict[str, tuple[np.ndarray, np.ndarray]], reference: np.ndarray, reference_memberships: np.ndarray, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Shifts of each batch by cluster (clusters x dimensions), from its sums of memberships and of membership-weighted rows.

    The reference enters through the same two sums, so neither its rows nor the query's are needed together.
    """
    levels = sorted(sums)
    size, mass = reference_memberships.sum(0), reference_memberships.T @ reference
    out = {b: np.zeros_like(mass) for b in levels}
    for c in range(len(size)):
        n = np.array([sums[b][0][c] for b in levels])
        zs = np.array([sums[b][1][c] for b in levels])
        left = np.zeros((1 + len(levels),) * 2)
        left[0, 0], left[0, 1:], left[1:, 0] = n.sum() + size[c] + 1e-9, n, n
        left[1:, 1:] = np.diag(n + ridge)
        beta = np.linalg.solve(left, np.vstack([zs.sum(0) + mass[c], zs]))
        for i, b in enumerate(levels):
            out[b][c] = beta[1 + i]
    return out
