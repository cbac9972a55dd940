"""Differential expression of pseudobulks. Sums over cells are Spark aggregates; what is left, features x samples, is modelled on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import mapping, models


@dataclass
class Result:
    """A fit by feature; what was left out of it; the fit by set of features."""

    fit: models.Fit
    features: list[str]
    samples: list
    design: np.ndarray
    dropped_samples: list = field(default_factory=list)
    dropped_features: list[str] = field(default_factory=list)
    sets: models.Fit | None = None
    set_names: list[str] = field(default_factory=list)

    def table(self, spark, term: int) -> DataFrame:
        """(feature, coef, t, p, q) of one coefficient."""
        f = self.fit
        return spark.createDataFrame([(n, *(float(x[i, term]) for x in (f.coef, f.t, f.p, f.q))) for i, n in enumerate(self.features)], "feature string, coef double, t double, p double, q double")


def mode(design: bool, labels: bool, landmarks: bool, against: bool, against_landmarks: bool) -> str:
    """design: over samples; marker: cells against other cells of the same samples."""
    if labels and landmarks or against and against_landmarks:
        raise ValueError("cells are chosen by labels or by landmarks, not by both")
    if design and (against or against_landmarks):
        raise ValueError("a design compares samples, cells to compare with compare cells: give one of them")
    if design:
        return "design"
    if not (labels or landmarks):
        raise ValueError("a design is needed, or cells to be compared with others")
    return "marker"


def matrix(assay: DataFrame, weights: DataFrame, names: list, counts: bool) -> tuple[np.ndarray, list[str]]:
    """(features x samples, features) of pseudobulks; what a sample does not have is 0."""
    pdf = mapping.pseudobulk(assay, weights, counts).toPandas()
    wide = pdf.pivot(index="feature", columns="sample_id", values="value").reindex(columns=names).fillna(0.0).sort_index()
    return wide.to_numpy(), [str(f) for f in wide.index]


def fitted(y: np.ndarray, features: list[str], samples: list, design: np.ndarray, contrasts, block, counts: bool, sets: dict[str, list[str]] | None) -> Result:
    """Counts: features with enough of them, trimmed-mean factors, precision weights; else the values as they are. Moderated t either way."""
    kept = models.expressed(y, design) if counts else np.ones(len(y), bool)
    if not kept.any():
        raise ValueError("no feature has enough counts")
    y, own, out = y[kept], [f for f, k in zip(features, kept, strict=True) if k], [f for f, k in zip(features, kept, strict=True) if not k]
    weights = None
    if counts:
        y, weights = models.voom(y, design)
    fit = models.fitted(y, design, contrasts, block, weights)
    result = Result(fit, own, samples, design, [], out)
    if sets:
        at = {f: i for i, f in enumerate(own)}
        index = {n: np.array([at[f] for f in fs if f in at], int) for n, fs in sets.items()}
        result.set_names = [n for n, i in index.items() if 0 < len(i) < len(own)]
        if result.set_names:
            result.sets = models.fitted(models.set_scores(y, [index[n] for n in result.set_names]), design, contrasts, block)
    return result


def _outliers(weights: DataFrame, names: list) -> list:
    few = {r.sample_id: r.outlier for r in mapping.outlier_samples(weights).collect()}  # a row a sample
    return [s for s in names if few.get(s, True)]


def design_mode(assay: DataFrame, weights: DataFrame, names: list, design: np.ndarray, contrasts=None, block=None, counts: bool = True, sets=None) -> Result:
    """design: a row for each of names. Samples with under a tenth of the mean number of chosen cells are left out, and columns that are then empty."""
    design = models.checked_design(design, len(names))
    out = _outliers(weights, names)
    keep = [i for i, s in enumerate(names) if s not in out]
    used = (design[keep] != 0).any(0)
    if contrasts is not None and (np.asarray(contrasts)[~used] != 0).any():
        raise ValueError("a contrast needs samples that have too few cells")
    contrasts = None if contrasts is None else np.asarray(contrasts, float)[used]
    y, features = matrix(assay, weights, names, counts)
    result = fitted(y[:, keep], features, [names[i] for i in keep], models.used_columns(design[keep]), contrasts, [block[i] for i in keep] if block is not None else None, counts, sets)
    result.dropped_samples = out
    return result


def marker_mode(assay: DataFrame, one: DataFrame, two: DataFrame, names: list, counts: bool = True, sets=None) -> Result:
    """Two pseudobulks a sample, of the cells in one and of those in two; the design is the group and the sample. The first coefficient is one over two."""
    out = sorted({*_outliers(one, names), *_outliers(two, names)}, key=names.index)
    kept = [s for s in names if s not in out]
    if len(kept) < 2:
        raise ValueError("markers take two samples at least with enough cells on both sides")
    a, fa = matrix(assay, one, kept, counts)
    b, fb = matrix(assay, two, kept, counts)
    features = sorted({*fa, *fb})
    y = np.zeros((len(features), 2 * len(kept)))
    y[[features.index(f) for f in fa], : len(kept)] = a
    y[[features.index(f) for f in fb], len(kept) :] = b
    k = len(kept)
    design = np.c_[np.r_[np.ones(k), np.zeros(k)], np.vstack([np.eye(k), np.eye(k)])]
    result = fitted(y, features, [(s, g) for g in ("one", "two") for s in kept], design, np.eye(k + 1)[:, :1], None, counts, sets)
    result.dropped_samples = out
    return result
