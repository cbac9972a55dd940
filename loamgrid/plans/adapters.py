"""Roles of the shared tables: an order is a cell, its customer's nation the sample, a brand a feature; a vector is a cell with 64 markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views in DuckDB's SQL, to go before a query.
VIEWS = """
WITH cell AS (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, c_nationkey AS sample_id, o_orderstatus AS status, o_orderpriority AS priority, n_regionkey AS region
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
assay AS (SELECT sample_id, cell_id, p_brand AS feature, sum(l_quantity) AS value
          FROM lineitem JOIN cell ON CAST(l_orderkey AS VARCHAR) = cell_id JOIN part ON l_partkey = p_partkey GROUP BY ALL),
vec AS (SELECT CAST(vec_id % 10 AS INTEGER) AS sample_id, vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label AS VARCHAR) AS label FROM embeddings),
vkey AS (SELECT *, -ln((CAST('0x' || substr(md5('123_' || sample_id || '_' || cell_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS key FROM vec),
vquota AS (SELECT sample_id, least(ceil(count(*) * 0.1), ceil(least(sum(count(*)) OVER () * 0.1, 5000.0) / count(*) OVER ())) AS quota FROM vec GROUP BY 1),
lm AS (SELECT sample_id, cell_id, features, label, key, r FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY key, cell_id) AS r FROM vkey) JOIN vquota USING (sample_id) WHERE r <= quota)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    nations = t("nation").select("n_nationkey", "n_regionkey")  # one row a nation
    cells = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return cells.select(F.col("o_orderkey").cast("string").alias("cell_id"), F.col("c_nationkey").alias("sample_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("n_regionkey").alias("region"))


def order_assay(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("cell_id"), "l_partkey", "l_quantity").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy("cell_id", F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return counts.join(order_cells(spark, sf).select("cell_id", "sample_id"), "cell_id").select("sample_id", "cell_id", "feature", "value")


def vector_cells(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.select((F.col("vec_id") % 10).cast("int").alias("sample_id"), F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("string").alias("label"))


def vector_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight landmarks: of every sample its quota of cells (a tenth, 5000 in all at most), by md5 keys, so that DuckDB picks the same."""
    from ..operators.cells import quotas, samples, weighted_sample

    cells = vector_cells(spark, sf)
    chosen = weighted_sample(cells.select("sample_id", "cell_id", F.lit(1.0).alias("weight")), quotas(samples(cells, 1)))
    out = cells.join(F.broadcast(chosen.select("cell_id")), "cell_id").select(F.col("cell_id").alias("lm_id"), "sample_id", "features", "label")
    return spark.createDataFrame(out.collect(), out.schema)  # landmarks, made once
