"""Checks of results: permutation tests, discoveries, integration quality."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import mcc
from .models import moderated, ols


def discoveries(results: DataFrame, cut: float = 0.1) -> DataFrame:
    """(model, n_sig, min_q). results: (model, q)."""
    return results.groupBy("model").agg(F.sum((F.col("q") <= cut).cast("long")).alias("n_sig"), F.min("q").alias("min_q"))


def permuted_labels(group: list, batch: list) -> list[tuple]:
    """All reassignments of group within batch, the observed one left out."""
    levels = sorted(set(batch))
    at = {b: [i for i, x in enumerate(batch) if x == b] for b in levels}
    options = [sorted(set(itertools.permutations([group[i] for i in at[b]]))) for b in levels]
    out = []
    for choice in itertools.product(*options):
        new = list(group)
        for b, own in zip(levels, choice, strict=True):
            for i, v in zip(at[b], own, strict=True):
                new[i] = v
        if new != list(group):
            out.append(tuple(new))
    return out


def permutation_test(spark, y: np.ndarray, group: list, batch: list, truth: np.ndarray | None = None, cut: float = 0.1) -> DataFrame:
    """(perm, n_sig, min_q, mcc): refits of each reassignment, dealt over the cluster; y is small and broadcast."""
    perms = permuted_labels(group, batch)
    held = spark.sparkContext.broadcast((y, [tuple(group), *perms], list(batch), truth))

    def run(batches):
        import pandas as pd

        y, perms, batch, truth = held.value
        levels = sorted(set(batch))
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                first = sorted(set(perms[i]))[0]
                x = np.stack([np.ones(len(batch)), *([b == v for b in batch] for v in levels[1:]), [g != first for g in perms[i]]], 1).astype(float)
                q = moderated(ols(y, x)).q[:, -1]
                rows.append((i, int((q <= cut).sum()), float(np.nanmin(q)), mcc(truth, q <= cut) if truth is not None else None))
            yield pd.DataFrame(rows, columns=["perm", "n_sig", "min_q", "mcc"])

    return spark.range(len(perms) + 1).mapInPandas(run, "perm long, n_sig long, min_q double, mcc double")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "said").agg(F.count("*").alias("n"))


def binary_mcc(pairs: DataFrame) -> DataFrame:
    """(mcc): of boolean columns truth and said."""
    s = lambda a, b: F.sum((F.col("truth").eqNullSafe(a) & F.col("said").eqNullSafe(b)).cast("double"))
    n = pairs.agg(s(True, True).alias("tp"), s(False, False).alias("tn"), s(False, True).alias("fp"), s(True, False).alias("fn"))
    low = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return n.select(F.when(low > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / low).otherwise(0.0).alias("mcc"))


def majority_label(nn: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, label): of most neighbours, ties to the smallest label. nn: (src, dst); labels: (id, label)."""
    votes = nn.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "label"))).where("r = 1").select("src", "label")


def batch_entropy(nn: DataFrame, batches: DataFrame) -> DataFrame:
    """(src, entropy): of the neighbours' batches, in bits."""
    n = nn.join(batches.withColumnRenamed("id", "dst"), "dst").groupBy("src", "batch").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    return p.groupBy("src").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def batch_chi_square(nn: DataFrame, batches: DataFrame) -> DataFrame:
    """(src, chi2): of the neighbours' batches against their overall shares, absent batches included."""
    total = batches.agg(F.count("*").alias("N"))
    share = batches.groupBy("batch").agg(F.count("*").alias("c")).crossJoin(total).select("batch", (F.col("c") / F.col("N")).alias("share"))
    k = nn.groupBy("src").agg(F.count("*").alias("k"))
    seen = nn.join(batches.withColumnRenamed("id", "dst"), "dst").groupBy("src", "batch").agg(F.count("*").alias("n"))
    grid = k.crossJoin(F.broadcast(share))  # the result's terms: landmarks x batches
    due = F.col("k") * F.col("share")
    return grid.join(seen, ["src", "batch"], "left").groupBy("src").agg(F.sum(F.pow(F.coalesce("n", F.lit(0)) - due, 2) / due).alias("chi2"))


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette width of rows."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    names = sorted(set(label.tolist()))
    own = np.array([[v == n for n in names] for v in label.tolist()], float)
    size = own.sum(0)
    mean = d @ own / np.maximum(size, 1)
    mine = own.argmax(1)
    a = mean[np.arange(len(x)), mine] * size[mine] / np.maximum(size[mine] - 1, 1)
    b = np.where(own > 0, np.inf, mean).min(1)
    return float(np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def graph_connectivity(edges: set[tuple[int, int]], label: dict[int, str]) -> float:
    """Mean share of each label's nodes in its largest connected part."""
    shares = []
    for name in sorted(set(label.values())):
        own = [i for i, v in label.items() if v == name]
        root = {i: i for i in own}

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in edges:
            if a in root and b in root:
                root[find(a)] = find(b)
        sizes: dict[int, int] = {}
        for i in own:
            sizes[find(i)] = sizes.get(find(i), 0) + 1
        shares.append(max(sizes.values()) / len(own))
    return float(np.mean(shares))
