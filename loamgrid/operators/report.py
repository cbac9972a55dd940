"""The data behind each figure, as tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LOW_CONFIDENCE, log_norm


def significance(coef: Column, q: Column, more: str = "more abundant", less: str = "less abundant", cut: float = 0.1) -> Column:
    return F.when((q <= cut) & (coef > 0), more).when((q <= cut) & (coef < 0), less).otherwise("not sig.")


def coordinates(embed: DataFrame, x: int, y: int, feature: DataFrame) -> DataFrame:
    """(lm_id, x, y, feature): landmark components or layout with a feature. embed: (lm_id, coord)."""
    return embed.select("lm_id", F.col("coord")[x].alias("x"), F.col("coord")[y].alias("y")).join(feature, "lm_id")


def beeswarm(fit: DataFrame, annot: DataFrame, composition: DataFrame, q: str = "q", cut: float = 0.1) -> DataFrame:
    """(lm_id, coef, q, sig, label, mean_perc). fit: (lm_id, coef, q)."""
    mean = composition.where(F.col("label") != LOW_CONFIDENCE).groupBy("label").agg(F.avg("perc").alias("mean_perc"))
    return fit.join(annot, "lm_id").join(mean, "label", "left").select("lm_id", "coef", F.col(q).alias("q"), significance(F.col("coef"), F.col(q), cut=cut).alias("sig"), "label", "mean_perc")


def marker_pair(cells: DataFrame, x: int, y: int, bins: int = 128) -> DataFrame:
    """(bx, by, n): a grid of two markers, within three standard deviations below and six above their means."""
    two = cells.select(F.col("features")[x].cast("double").alias("x"), F.col("features")[y].cast("double").alias("y"))
    gate = two.agg(*[f for c in "xy" for f in ((F.avg(c) - 3 * F.stddev_samp(c)).alias(f"l{c}"), (F.avg(c) + 6 * F.stddev_samp(c)).alias(f"h{c}"))])
    kept = two.crossJoin(F.broadcast(gate)).where("x between lx and hx and y between ly and hy")  # gate is one row
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"l{c}")) / (F.col(f"h{c}") - F.col(f"l{c}")) * bins), F.lit(bins - 1)).cast("int")
    return kept.groupBy(at("x").alias("bx"), at("y").alias("by")).agg(F.count("*").alias("n"))


def sample_embedding(embed: DataFrame, samples: DataFrame) -> DataFrame:
    return embed.join(samples, "sample_id")


def coefficient_table(coef: DataFrame, q: DataFrame, on: list[str], cut: float = 0.1, more: str = "higher", less: str = "lower") -> DataFrame:
    """coef and adjusted p by unit and term, full outer, with significance."""
    return coef.join(q, on, "full").withColumn("sig", significance(F.col("coef"), F.col("q"), more, less, cut))


def percentages(composition: DataFrame, samples: DataFrame, labels: list[str] | None = None) -> DataFrame:
    kept = composition.where(F.col("label") != LOW_CONFIDENCE)
    return (kept.where(F.col("label").isin(*labels)) if labels else kept).join(samples, "sample_id")


def densities(density: DataFrame, samples: DataFrame, annot: DataFrame) -> DataFrame:
    return density.select("lm_id", "sample_id", log_norm(F.col("norm")).alias("log_norm")).join(samples, "sample_id").join(annot, "lm_id")


def heatmap(medians: DataFrame) -> DataFrame:
    """(label, feature, median, z): medians standardised by feature."""
    w = Window.partitionBy("feature")
    return medians.withColumn("z", (F.col("median") - F.avg("median").over(w)) / F.stddev_samp("median").over(w))


def extreme_loadings(loadings: DataFrame, n: int = 10) -> DataFrame:
    """The n largest: half positive (rounded up), half negative, by component. loadings: (component, feature, loading)."""
    up = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("loading"), "feature"))
    down = F.row_number().over(Window.partitionBy("component").orderBy("loading", "feature"))
    ranked = loadings.withColumn("up", up).withColumn("down", down)
    return ranked.where(((F.col("loading") > 0) & (F.col("up") <= (n + 1) // 2)) | ((F.col("loading") < 0) & (F.col("down") <= n // 2))).drop("up", "down")


def ordered(landmarks: DataFrame, *by: str) -> DataFrame:
    """Landmarks with their place when sorted by columns (ascending; a leading minus: descending), then by id."""
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in by]
    return landmarks.withColumn("place", F.row_number().over(Window.orderBy(*keys, "lm_id")))


def program_heatmap(expr: DataFrame, loadings: DataFrame, landmarks: DataFrame, score: str, n: int = 20) -> DataFrame:
    """(feature, lm_id, place, value): expression of the extreme features, centred by feature, landmarks in order of a score."""
    top = extreme_loadings(loadings, n).select("feature").distinct()
    w = Window.partitionBy("feature")
    rows = expr.join(F.broadcast(top), "feature").join(ordered(landmarks, score).select("lm_id", "place"), "lm_id")
    return rows.select("feature", "lm_id", "place", (F.col("value") - F.avg("value").over(w)).alias("value"))


def scatter(table: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    return table.select(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(color).alias("color")] if color else []))
