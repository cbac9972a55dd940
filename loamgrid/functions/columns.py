"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

LOW_CONFIDENCE = "..low.confidence.."
#: Fixed pattern of receptor, mitochondrial and ribosomal genes.
EXCLUDED = r"(?i)^TR[ABDG][VDJ]\d|^IG[KHL][VDJ]\d|^MT-|^RP[SL]\d{1,2}[AXYL]?L?\d?$|^RPLP[012]$|^RPSA$"


def u01(seed: int, *ids: Column) -> Column:
    """A uniform number in (0, 1) that depends on seed and ids alone: the same on any partitioning."""
    said = F.md5(F.concat_ws("_", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))
    return (F.conv(F.substring(said, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def sampling_key(seed: int, weight: Column, *ids: Column) -> Column:
    """Exponential key: the n smallest are a weighted sample of n without replacement. No weight, no chance."""
    return F.when(weight > 0, -F.log(u01(seed, *ids)) / weight)


def log_norm(norm: Column) -> Column:
    return F.log2(norm + 0.5)


def arcsinh(x: Column, cofactor: float = 5.0) -> Column:
    return F.asinh(x / cofactor)


def percent(x: Column, *by: str) -> Column:
    return 100 * x / F.sum(x).over(Window.partitionBy(*by))


def average_rank(value: str, *by: str) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def cluster_label(number: Column, width: int) -> Column:
    return F.concat(F.lit("cluster."), F.lpad(number.cast("string"), width, "0"))
