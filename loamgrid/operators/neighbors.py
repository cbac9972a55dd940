"""Nearest neighbours and graphs. Landmarks (at most 5000) are broadcast; cells stream by in Arrow batches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linalg import vectors

MOST_LANDMARKS = 50_000
#: Distances of cells to landmarks that a task holds at once.
SQUARE = 1 << 23


def nearest(x: np.ndarray, reference: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the k nearest reference rows, nearest first, ties by position."""
    k = min(k, len(reference))
    square = (x * x).sum(1)[:, None] + (reference * reference).sum(1) - 2 * x @ reference.T
    rough = np.argpartition(square, min(k + 4, len(reference)) - 1, axis=1)[:, : k + 5] if len(reference) > k + 5 else np.tile(np.arange(len(reference)), (len(x), 1))
    exact = np.sqrt(((x[:, None, :] - reference[rough]) ** 2).sum(2))
    order = np.lexsort((rough, exact), axis=1)[:, :k]
    return np.take_along_axis(rough, order, 1), np.take_along_axis(exact, order, 1)


def smooth_weights(dist: np.ndarray, rounds: int = 64, sigma: float | None = None) -> np.ndarray:
    """Fuzzy memberships: exp(-(d - rho) / sigma), rho the nearest positive distance, sigma given or such that they add up to log2 k."""
    k = dist.shape[1]
    positive = np.where(dist > 0, dist, np.inf).min(1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    gap = np.maximum(dist - rho[:, None], 0)
    if sigma is not None:
        return np.exp(-gap / sigma)
    low, high = np.full(len(dist), 1e-12), np.full(len(dist), np.inf)
    sigma = np.ones(len(dist))
    for _ in range(rounds):
        over = np.exp(-gap / sigma[:, None]).sum(1) > np.log2(k) if k > 1 else np.zeros(len(dist), bool)
        high = np.where(over, sigma, high)
        low = np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
        sigma = np.minimum(sigma, 1e12)
    return np.exp(-gap / np.maximum(sigma, 1e-3 * dist.mean(1) + 1e-12)[:, None])


def cell_neighbors(cells: DataFrame, landmarks: DataFrame, k: int = 20, transform=None, by_sample=None, nested: bool = False, sigma: float | None = None) -> DataFrame:
    """(sample_id, cell_id, rank, lm_id, dist, weight): the k nearest landmarks of each cell. nested: a row a cell, with arrays lm_ids, dists, weights.

    cells: with features, or with at and x (see ``cells.sparse_cells``). landmarks: (lm_id, features), broadcast; over 50,000 (counted) by blocks, a pass over the cells each.
    transform: applied to arrays on both sides. by_sample: applied instead to cells, with their samples. sigma: a fixed width of the weights.
    """
    rows = landmarks.select("lm_id", "features").limit(MOST_LANDMARKS + 1).collect()  # one more than the bound tells that there are more
    if len(rows) > MOST_LANDMARKS:
        return _by_blocks(cells, landmarks, -(-2 * landmarks.count() // MOST_LANDMARKS), k, transform, by_sample, nested, sigma)
    rows.sort(key=lambda r: r.lm_id)
    ids, reference = np.array([r.lm_id for r in rows]), np.array([r.features for r in rows], float)
    place = transform or (lambda x: x)
    return placed_neighbors(cells, ids, place(reference), landmarks.schema["lm_id"].dataType.simpleString(), k, by_sample or (lambda x, _: place(x)), reference.shape[1], nested, sigma)


def _by_blocks(cells: DataFrame, landmarks: DataFrame, blocks: int, k: int, transform, by_sample, nested: bool, sigma: float | None) -> DataFrame:
    """As ``cell_neighbors`` for more landmarks than may be broadcast: a pass for each block of them, the nearest k of all passes, weights from these."""
    block = F.pmod(F.xxhash64("lm_id"), F.lit(blocks))
    found = [cell_neighbors(cells, landmarks.where(block == b), k, transform, by_sample).drop("weight", "rank") for b in range(blocks)]
    first = F.row_number().over(Window.partitionBy("sample_id", "cell_id").orderBy("dist", "lm_id"))
    kept = reduce(DataFrame.unionByName, found).withColumn("rank", first).where(F.col("rank") <= k)
    near = kept.groupBy("sample_id", "cell_id").agg(F.sort_array(F.collect_list(F.struct("rank", "lm_id", "dist"))).alias("e"))  # k of each cell
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def weighted(batches):
        for pdf in batches:
            yield pdf.assign(weights=list(smooth_weights(np.stack(pdf["dists"].to_numpy()), sigma=sigma)) if len(pdf) else [])

    made = near.select("sample_id", "cell_id", F.col("e.lm_id").alias("lm_ids"), F.col("e.dist").alias("dists"))
    edges = made.mapInPandas(weighted, f"sample_id {kinds['sample_id']}, cell_id {kinds['cell_id']}, lm_ids array<{kinds['lm_id']}>, dists array<double>, weights array<double>")
    return edges if nested else exploded(edges)


def placed_neighbors(cells: DataFrame, ids: np.ndarray, reference: np.ndarray, id_type: str, k: int, place, width: int, nested: bool = False, sigma: float | None = None, dense=None) -> DataFrame:
    """As ``cell_neighbors``, with landmarks that are arrays already. place: coordinates of rows of ``width`` features, given their samples; dense: makes these of rows."""
    if len(ids) > MOST_LANDMARKS:
        raise ValueError("too many landmarks to broadcast")
    held = cells.sparkSession.sparkContext.broadcast((ids, reference))
    step = max(1, min(2000, SQUARE // max(1, len(ids))))
    dense = dense or (lambda pdf: vectors(pdf, width))

    def run(batches):
        ids, ref = held.value
        for pdf in batches:
            for a in range(0, len(pdf), step):
                own = pdf.iloc[a : a + step]
                at, dist = nearest(place(dense(own), own["sample_id"].to_numpy()), ref, k)
                weight = smooth_weights(dist, sigma=sigma)
                if nested:
                    yield pd.DataFrame({"sample_id": own["sample_id"], "cell_id": own["cell_id"], "lm_ids": list(ids[at]), "dists": list(dist), "weights": list(weight)})
                    continue
                n, kk = at.shape
                yield pd.DataFrame({"sample_id": np.repeat(own["sample_id"].to_numpy(), kk), "cell_id": np.repeat(own["cell_id"].to_numpy(), kk), "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), n), "lm_id": ids[at].ravel(), "dist": dist.ravel(), "weight": weight.ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = f"sample_id {kinds['sample_id']}, cell_id {kinds['cell_id']}, " + (f"lm_ids array<{id_type}>, dists array<double>, weights array<double>" if nested else f"rank int, lm_id {id_type}, dist double, weight double")
    return cells.select("sample_id", "cell_id", *(["features"] if "features" in cells.columns else ["at", "x"])).mapInPandas(run, schema)


def exploded(edges: DataFrame) -> DataFrame:
    """Nested edges as a row for each: (sample_id, cell_id, rank, lm_id, dist, weight)."""
    zipped = F.posexplode(F.arrays_zip("lm_ids", "dists", "weights")).alias("rank", "e")
    return edges.select("sample_id", "cell_id", zipped).select("sample_id", "cell_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.lm_ids").alias("lm_id"), F.col("e.dists").alias("dist"), F.col("e.weights").alias("weight"))


def shared_neighbors(nn: DataFrame, k: int, prune: float = 1 / 15) -> DataFrame:
    """(src, dst, weight): Jaccard index of the neighbour sets of landmarks that share a neighbour, above prune. nn: (src, dst), k for each src."""
    a, b = nn.select(F.col("src").alias("src"), "dst"), nn.select(F.col("src").alias("other"), "dst")
    common = a.join(b, "dst").groupBy("src", F.col("other").alias("dst")).agg(F.count("*").alias("c"))
    return common.select("src", "dst", (F.col("c") / (2 * k - F.col("c"))).alias("weight")).where(F.col("weight") > prune)


def fuzzy_union(at: np.ndarray, weight: np.ndarray, n: int, prune: float = 0.0) -> np.ndarray:
    """Symmetric landmark graph: a + b - ab of the directed memberships."""
    w = np.zeros((n, n), np.float32)
    w[np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()] = weight.ravel()
    np.fill_diagonal(w, 0)
    product = w * w.T
    w = w + w.T
    w -= product
    w[w <= prune] = 0
    return w


def jaccard(at: np.ndarray, prune: float = 1 / 15) -> np.ndarray:
    """Dense form of ``shared_neighbors``: at has the neighbours of each of n landmarks."""
    n, k = at.shape
    adjacent = np.zeros((n, n), np.float32)
    adjacent[np.repeat(np.arange(n), k), at.ravel()] = 1
    common = adjacent @ adjacent.T
    common /= 2 * k - common
    common[common <= prune] = 0
    return common


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): each edge's share of its source's weight. Sources are landmarks, so a window of one is small."""
    return edges.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("p"))


def smoothness(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(component, sk): 1 for scores that are constant along edges, 0 for the roughest. edges symmetric; scores: (lm_id, component, score)."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("d"))
    s = scores.join(degree.withColumnRenamed("src", "lm_id"), "lm_id").withColumn("x", F.col("score") / F.sqrt("d"))
    pair = edges.join(s.select(F.col("lm_id").alias("src"), "component", F.col("x").alias("xa")), "src").join(s.select(F.col("lm_id").alias("dst"), "component", F.col("x").alias("xb")), ["dst", "component"])
    rough = pair.groupBy("component").agg(F.sum(F.col("weight") * F.pow(F.col("xa") - F.col("xb"), 2)).alias("r"))
    norm = scores.groupBy("component").agg(F.sum(F.col("score") * F.col("score")).alias("q"))
    ratio = F.col("r") / 2 / F.col("q")
    return rough.join(norm, "component").select("component", (1 - F.least(F.greatest(ratio, F.lit(0.0)), F.lit(2.0)) / 2).alias("sk"))
