"""Relational operators over cells: all scale with the number of cells and stay in the DataFrame API.

Tables: assay (sample_id, cell_id, feature, value; zeros absent), cells (sample_id, cell_id, features
array<double>), cell_meta (cell_id, ...). Cell ids need only be unique within their sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EXCLUDED, sampling_key

CELL = ["sample_id", "cell_id"]


def samples(cells: DataFrame, least: int = 10) -> DataFrame:
    """sample_id, n_cells, log10_n_cells of samples with at least ``least`` cells."""
    return cells.groupBy("sample_id").agg(F.countDistinct("cell_id").alias("n_cells")).where(F.col("n_cells") >= least).withColumn("log10_n_cells", F.log10("n_cells"))


def of_large_samples(cells: DataFrame, least: int = 10) -> DataFrame:
    return cells.join(samples(cells, least).select("sample_id"), "sample_id", "left_semi")


def matched(assay: DataFrame, meta: DataFrame, on: str | list[str] = "cell_id") -> tuple[DataFrame, DataFrame]:
    """assay with meta's columns, and the cells of either side that have no partner. on: what names a cell; its sample too where ids repeat across samples."""
    on = [on] if isinstance(on, str) else list(on)
    left, right = assay.select(*on).distinct(), meta.select(*on).distinct()
    lost = left.join(right, on, "left_anti").withColumn("side", F.lit("assay")).unionByName(right.join(left, on, "left_anti").withColumn("side", F.lit("meta")))
    return assay.join(meta, on), lost


def single_layer_samples(layers: DataFrame) -> DataFrame:
    """Samples that break the rule of one layer for each sample; empty if all keep it. layers: (sample_id, layer)."""
    return layers.groupBy("sample_id").agg(F.countDistinct("layer").alias("layers")).where("layers > 1")


def common_features(layers: DataFrame) -> DataFrame:
    """feature: those that all layers have. layers: (layer, feature)."""
    n = layers.agg(F.countDistinct("layer").alias("n"))
    return layers.groupBy("feature").agg(F.countDistinct("layer").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("feature")


def sample_level_columns(meta: DataFrame, sample: str = "sample_id") -> list[str]:
    """Columns with one value in every sample; null counts as a value."""
    names = [c for c in meta.columns if c != sample]
    if not names:
        return []
    one = meta.groupBy(sample).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) == 1).alias(c) for c in names])
    row = one.agg(*[F.bool_and(c).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def sample_table(meta: DataFrame, sample: str = "sample_id") -> DataFrame:
    return meta.select(sample, *sample_level_columns(meta, sample)).distinct()


def annotation_columns(meta: DataFrame, sample: str = "sample_id", cell: str = "cell_id") -> list[str]:
    """Text columns that can label cells: more than one value, fewer than cells, and more than one in some sample (nulls aside)."""
    names = [f.name for f in meta.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (sample, cell, "ids")]
    if not names:
        return []
    row = meta.agg(F.count("*").alias("__n"), *[F.count_distinct(c).alias(c) for c in names]).first()
    inside = meta.groupBy(sample).agg(*[(F.count_distinct(c) > 1).alias(c) for c in names]).agg(*[F.bool_or(c).alias(c) for c in names]).first()
    return [c for c in names if 1 < row[c] < row["__n"] and inside[c]]


def long_form(cells: DataFrame) -> DataFrame:
    """cells as (sample_id, cell_id, feature, value), features named by their position."""
    return cells.select(*CELL, F.posexplode("features").alias("feature", "value"))


def totals(assay: DataFrame) -> DataFrame:
    return assay.groupBy(*CELL).agg(F.sum("value").alias("total"))


def normalised(assay: DataFrame, mean_total: float | None = None, with_cells: bool = False) -> DataFrame:
    """value / (cell total / mean total): of the cell's sample, or the given one (that of the landmarks).

    Totals come from a window over cells, so the assay is dealt by cell once; the samples' means are added up from the same rows.
    with_cells: n_cells, the number of the sample's cells, is kept.
    """
    cell = Window.partitionBy(*CELL)
    sized = assay.select(*CELL, "feature", "value", F.sum("value").over(cell).alias("total"), F.count("*").over(cell).alias("rows"))
    if mean_total is not None:
        return sized.select(*CELL, "feature", (F.col("value") / (F.col("total") / F.lit(float(mean_total)))).alias("value"))
    mean = sized.groupBy("sample_id").agg(F.sum("value").alias("all"), F.round(F.sum(1 / F.col("rows"))).cast("long").alias("n_cells"), F.count("feature").alias("named"))
    # the condition holds for all samples with a named feature; it has both branches read the same columns, so that Spark deals the assay once
    mean = F.broadcast(mean.where("named > 0 or n_cells > 0").select("sample_id", (F.col("all") / F.col("n_cells")).alias("mean_total"), "n_cells"))  # one row a sample
    return sized.join(mean, "sample_id").select(*CELL, "feature", (F.col("value") / (F.col("total") / F.col("mean_total"))).alias("value"), *(["n_cells"] if with_cells else []))


def log2p1(assay: DataFrame) -> DataFrame:
    return assay.withColumn("value", F.log2(F.col("value") + 1))


def missing_features(assay: DataFrame, names: list[str]) -> list[str]:
    """Those of names that the assay does not have."""
    return sorted(set(names) - {r.feature for r in assay.where(F.col("feature").isin(*names)).select("feature").distinct().collect()}) if names else []  # at most as many as names


def sparse_cells(cells: DataFrame, assay: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, cell_id, at, x): of each cell the places and values of chosen features. features: (feature, at), with sample_id if each sample has its own.

    Cells without any value have empty arrays. The assay is dealt by cell, as ``normalised`` leaves it.
    """
    on = ["sample_id", "feature"] if "sample_id" in features.columns else ["feature"]
    held = assay.join(features, on).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "value"))).alias("v"))  # at most as many as features
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return cells.select(*CELL).join(held, CELL, "left").select(*CELL, F.coalesce(F.col("v.at"), none("int")).alias("at"), F.coalesce(F.col("v.value"), none("double")).alias("x"))


def without_excluded(assay: DataFrame, force_in: list[str] = (), pattern: str = EXCLUDED) -> DataFrame:
    """Without features of the pattern, but for those forced in."""
    return assay.where(~F.col("feature").rlike(pattern) | F.col("feature").isin(*force_in))


def feature_moments(assay: DataFrame, by: list[str] = ("sample_id",), cells: int | None = None) -> DataFrame:
    """mean, variance and sd of each feature over all cells of a group, absent zeros included.

    The number of cells is the given one (of all), that of the assay's column n_cells (of each sample, see ``normalised``), or is counted.
    """
    by = list(by)
    sums = [F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")]
    if "n_cells" in assay.columns and by == ["sample_id"]:
        out = assay.groupBy(*by, "feature").agg(*sums, F.max("n_cells").alias("n"))
    elif cells is not None and not by:
        out = assay.groupBy("feature").agg(*sums, F.lit(cells).cast("long").alias("n"))
    else:
        n = assay.select(*dict.fromkeys([*by, *CELL])).distinct().groupBy(*by).agg(F.count("*").alias("n")) if by else assay.select(*CELL).distinct().agg(F.count("*").alias("n"))
        grouped = assay.groupBy(*by, "feature").agg(*sums)
        out = grouped.join(n, by) if by else grouped.crossJoin(F.broadcast(n))  # one row
    var = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    return out.select(*by, "feature", "n", (F.col("s") / F.col("n")).alias("mean"), var.alias("variance"), F.sqrt(var).alias("sd"))


def most_variable(moments: DataFrame, k: int = 5000, by: list[str] = ("sample_id",), force_in: list[str] = ()) -> DataFrame:
    """The k features of largest variance in each group (ties by name), forced ones first."""
    forced = F.col("feature").isin(*force_in) if force_in else F.lit(False)
    w = Window.partitionBy(*by).orderBy(forced.desc(), F.desc("variance"), "feature") if by else Window.orderBy(forced.desc(), F.desc("variance"), "feature")
    return moments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def standardised(assay: DataFrame, moments: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sd by feature; features without spread are left out.

    Absent zeros, whose score is -mean / sd, are given for ``cells`` (those of landmarks: the result is cells x features); else they stay absent.
    """
    told = moments.where("sd > 0").select("feature", "mean", "sd")
    if cells is not None:
        grid = cells.select(*CELL).distinct().crossJoin(told)  # the result itself
        joined = grid.join(assay, [*CELL, "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    else:
        joined = assay.join(told, "feature")
    return joined.select(*CELL, "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def quotas(sizes: DataFrame, share: float = 0.1, most: int = 5000) -> DataFrame:
    """sample_id, n_cells, quota: landmarks to take of each sample."""
    all_ = sizes.agg(F.least(F.sum("n_cells") * share, F.lit(float(most))).alias("target"), F.count("*").alias("k"))
    return sizes.crossJoin(F.broadcast(all_)).select("sample_id", "n_cells", F.least(F.ceil(F.col("n_cells") * share), F.ceil(F.col("target") / F.col("k"))).cast("long").alias("quota"))  # all_ is one row


def weighted_sample(weights: DataFrame, quota: DataFrame, seed: int = 123) -> DataFrame:
    """Of each sample its quota of cells, without replacement, in proportion to weight. weights: (sample_id, cell_id, weight)."""
    key = weights.withColumn("key", sampling_key(seed, F.col("weight"), F.col("sample_id"), F.col("cell_id"))).where("key is not null")
    w = Window.partitionBy("sample_id").orderBy("key", "cell_id")
    most = quota.agg(F.max("quota")).first()[0] or 0
    ranked = key.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)  # a bound for the window's early limit
    return ranked.join(F.broadcast(quota.select("sample_id", "quota")), "sample_id").where("rank <= quota").drop("quota")


def detected(assay: DataFrame, cells: int, share: float = 0.005) -> DataFrame:
    """Features above zero in more than share of the cells."""
    return assay.where("value > 0").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > share * cells)
