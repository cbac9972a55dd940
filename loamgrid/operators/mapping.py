"""What follows from the cell-to-landmark edges: density, labels, composition, pseudobulk, subsets, marker summaries.

edges: (sample_id, cell_id, lm_id, weight). All of these are aggregations with map-side partial sums; only
landmark- and sample-sized tables are broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LOW_CONFIDENCE, log_norm, percent

CELL = ["sample_id", "cell_id"]


def density(edges: DataFrame, landmarks: DataFrame, samples: DataFrame) -> DataFrame:
    """(lm_id, sample_id, raw, norm, log_norm) for all landmarks and samples, zeros kept. samples: (sample_id, n_cells)."""
    raw = edges.groupBy("lm_id", "sample_id").agg(F.sum("weight").alias("raw"))
    mean = samples.agg(F.avg("n_cells").alias("mean_cells"))
    size = samples.crossJoin(F.broadcast(mean)).select("sample_id", (F.col("n_cells") / F.col("mean_cells")).alias("size_factor"))  # mean is one row
    grid = landmarks.select("lm_id").crossJoin(F.broadcast(size))  # the result itself: landmarks x samples
    full = grid.join(raw, ["lm_id", "sample_id"], "left").select("lm_id", "sample_id", F.coalesce("raw", F.lit(0.0)).alias("raw"), (F.coalesce("raw", F.lit(0.0)) / F.col("size_factor")).alias("norm"))
    return full.withColumn("log_norm", log_norm(F.col("norm")))


def fuzzy_votes(edges: DataFrame, annot: DataFrame) -> DataFrame:
    """(sample_id, cell_id, label, vote, tie): weights by label. annot: (lm_id, label)."""
    return edges.join(F.broadcast(annot), "lm_id").groupBy(*CELL, "label").agg(F.sum("weight").alias("vote"), F.min("lm_id").alias("tie"))


def neighbor_votes(nn: DataFrame, annot: DataFrame) -> DataFrame:
    """As fuzzy_votes, each neighbour one vote. nn: (sample_id, cell_id, rank, lm_id)."""
    return nn.join(F.broadcast(annot), "lm_id").groupBy(*CELL, "label").agg(F.count("*").cast("double").alias("vote"), F.min("rank").alias("tie"))


def transferred(votes: DataFrame, cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sample_id, cell_id, label, confidence): the label of most votes; below threshold, or without votes, low confidence.

    Ties go to the smallest landmark or rank, then to the label.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share")
    total = F.sum("vote").over(Window.partitionBy(*CELL))
    first = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("confidence"), "tie", "label"))
    best = votes.withColumn("confidence", F.col("vote") / total).withColumn("rank", first).where("rank = 1")
    out = cells.select(*CELL).join(best.select(*CELL, "label", "confidence"), CELL, "left")
    return out.select(*CELL, F.when(F.col("confidence") >= threshold, F.col("label")).otherwise(LOW_CONFIDENCE).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def reference_labels(cells: DataFrame, reference: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(sample_id, cell_id, label, confidence): votes of the k nearest rows of a labelled reference (lm_id, features, label), of any size."""
    from .neighbors import cell_neighbors

    return transferred(neighbor_votes(cell_neighbors(cells, reference, k), reference.select("lm_id", "label")), cells, threshold)


def expanded(landmarks: DataFrame, samples: DataFrame) -> DataFrame:
    """Each landmark with the columns of its sample. samples: a row a sample."""
    return landmarks.select("lm_id", "sample_id").join(F.broadcast(samples), "sample_id")


def composition(labels: DataFrame) -> DataFrame:
    """(sample_id, label, count, perc) for all samples and labels, zeros kept. labels: (sample_id, cell_id, label)."""
    counts = labels.groupBy("sample_id", "label").agg(F.count("*").alias("count"))
    grid = counts.select("sample_id").distinct().crossJoin(F.broadcast(counts.select("label").distinct()))  # the result itself
    full = grid.join(counts, ["sample_id", "label"], "left").na.fill(0, ["count"])
    return full.withColumn("perc", percent(F.col("count"), "sample_id"))


def composition_wide(labels: DataFrame, names: list[str] | None = None) -> DataFrame:
    return labels.groupBy("sample_id").pivot("label", sorted(names) if names else None).count().na.fill(0)


def pseudobulk(assay: DataFrame, weights: DataFrame, counts: bool = True) -> DataFrame:
    """(sample_id, feature, value): weighted sums of cells, over the weights' sum; for counts times the number of weighted cells.

    weights: (sample_id, cell_id, weight), all cells that take part.
    """
    w = weights.groupBy(*CELL).agg(F.sum("weight").alias("weight"))
    size = w.groupBy("sample_id").agg(F.sum("weight").alias("total"), F.sum((F.col("weight") > 0).cast("long")).alias("n"))
    sums = assay.join(w, CELL).groupBy("sample_id", "feature").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    value = F.when(F.col("total") > 0, F.col("s") / F.col("total") * (F.col("n") if counts else 1)).otherwise(0.0)
    return sums.join(F.broadcast(size), "sample_id").select("sample_id", "feature", value.alias("value"))


def outlier_samples(weights: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(sample_id, n, outlier): whether a sample has less than ratio of the mean number of cells."""
    n = weights.groupBy("sample_id").agg(F.countDistinct("cell_id").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("m")))).select("sample_id", "n", (F.col("n") / F.col("m") < ratio).alias("outlier"))  # one row


def chosen_cells(cells: DataFrame, labels: DataFrame | None = None, names: list[str] | None = None, edges: DataFrame | None = None, landmarks: list[int] | None = None, threshold: float = 0.5) -> DataFrame:
    """Cells of the named labels, or those that a set of landmarks claims with confidence, or all."""
    if names is not None:
        known = {r.label for r in labels.select("label").distinct().collect()}
        if missing := set(names) - known:
            raise ValueError(f"no such label: {sorted(missing)}")
        return cells.join(labels.where(F.col("label").isin(*names)).select(*CELL), CELL, "left_semi")
    if landmarks is not None:
        side = edges.withColumn("label", F.when(F.col("lm_id").isin(*landmarks), "in").otherwise("out"))
        votes = side.groupBy(*CELL, "label").agg(F.sum("weight").alias("vote"), F.min("lm_id").alias("tie"))
        return cells.join(transferred(votes, cells, threshold).where("label = 'in'").select(*CELL), CELL, "left_semi")
    return cells


def marker_summary(assay: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """(feature, sample_id, label, count, perc): cells positive or negative for each feature (label "pos." or "neg." and the cell's), zeros kept.

    Positive cells are counted from the assay, negative ones are the label's others: no row is made for a cell and a feature that it lacks.
    """
    total = labels.groupBy("sample_id", "label").agg(F.count("*").alias("n"))
    names = labels.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(features)], "feature string")
    hits = assay.where(F.col("feature").isin(*features) & (F.col("value") > 0)).select(*CELL, "feature").distinct()
    hits = hits.join(labels.select(*CELL, "label"), CELL).groupBy("feature", "sample_id", "label").agg(F.count("*").alias("pos"))
    both = total.crossJoin(F.broadcast(names)).join(hits, ["feature", "sample_id", "label"], "left").na.fill(0, ["pos"])  # samples x labels x features, as the result
    counts = both.select("feature", "sample_id", F.explode(F.array(F.struct(F.concat(F.lit("pos."), "label").alias("label"), F.col("pos").alias("count")), F.struct(F.concat(F.lit("neg."), "label").alias("label"), (F.col("n") - F.col("pos")).alias("count")))).alias("c")).select("feature", "sample_id", "c.*").where("count > 0")
    grid = counts.select("sample_id").distinct().crossJoin(F.broadcast(counts.select("feature", "label").distinct()))  # the result itself
    return grid.join(counts, ["feature", "sample_id", "label"], "left").na.fill(0, ["count"]).withColumn("perc", percent(F.col("count"), "feature", "sample_id"))


def nearest_landmark_cells(nn: DataFrame, landmarks: list[int]) -> DataFrame:
    return nn.where((F.col("rank") == 1) & F.col("lm_id").isin(*landmarks)).select(*CELL)


def median_expression(assay: DataFrame, labels: DataFrame, zeros: bool = False) -> DataFrame:
    """(label, feature, median) over the cells that have a value, or with ``zeros`` over all cells of the label: absent zeros weigh by their number."""
    held = assay.join(labels.select(*CELL, "label"), CELL)
    if not zeros:
        return held.groupBy("label", "feature").agg(F.median("value").alias("median"))
    counted = held.groupBy("label", "feature", "value").agg(F.count("*").alias("k"))
    grid = labels.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(assay.select("feature").distinct()))  # the result's rows
    absent = grid.join(counted.groupBy("label", "feature").agg(F.sum("k").alias("seen")), ["label", "feature"], "left").select("label", "feature", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("seen", F.lit(0))).alias("k"))
    return counted.unionByName(absent.where("k > 0")).groupBy("label", "feature").agg(F.percentile("value", 0.5, F.col("k")).alias("median"))


def voted(edges: DataFrame, annot: dict[int, str], threshold: float = 0.5) -> DataFrame:
    """(sample_id, cell_id, label, confidence) as ``transferred`` of ``fuzzy_votes``, a map over cells with all their edges in one row.

    edges: (sample_id, cell_id, lm_ids, weights); annot: the label of each landmark (landmark-sized, broadcast).
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share")
    ids = np.array(sorted(annot))
    names = sorted(set(annot.values()))
    held = edges.sparkSession.sparkContext.broadcast((ids, np.array([names.index(annot[i]) for i in ids.tolist()], int), names))

    def run(batches):
        ids, label, names = held.value
        k = len(names)
        for whole in batches:
            for start in range(0, len(whole), 2000):
                pdf = whole.iloc[start : start + 2000]
                n, size = len(pdf), pdf["lm_ids"].map(len).to_numpy(int)
                flat = np.concatenate([np.zeros(0, ids.dtype), *pdf["lm_ids"]])
                weight = np.concatenate([np.zeros(0), *pdf["weights"]])
                row, at = np.repeat(np.arange(n), size), np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
                known = ids[at] == flat if len(ids) else np.zeros(len(flat), bool)
                row, weight, flat, kind = row[known], weight[known], flat[known], label[at[known]]
                votes = np.bincount(row * k + kind, weight, n * k).reshape(n, k)
                first = np.full(n * k, np.iinfo(np.int64).max)
                np.minimum.at(first, row * k + kind, flat)
                share = votes / np.maximum(votes.sum(1, keepdims=True), 1e-300)
                order = np.lexsort((np.tile(np.arange(k), (n, 1)), first.reshape(n, k), -share), axis=1)[:, 0] if k else np.zeros(n, int)
                best = share[np.arange(n), order] if k else np.zeros(n)
                said = [names[o] if b >= threshold and b > 0 else LOW_CONFIDENCE for o, b in zip(order.tolist(), best.tolist(), strict=True)]
                yield pd.DataFrame({"sample_id": pdf["sample_id"], "cell_id": pdf["cell_id"], "label": said, "confidence": best})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return edges.select(*CELL, "lm_ids", "weights").mapInPandas(run, f"sample_id {kinds['sample_id']}, cell_id {kinds['cell_id']}, label string, confidence double")
