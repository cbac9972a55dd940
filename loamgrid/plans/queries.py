"""Queries over the shared tables, each with DuckDB SQL for the same rows (results rounded where sums of floats meet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import cells as C
from ..operators import annotate, linalg, mapping, models, neighbors, report, validate
from ..sources import store
from .adapters import order_assay, order_cells, vector_cells, vector_landmarks
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

def _r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


_NEAREST = """, pair AS (SELECT v.sample_id, v.cell_id, l.cell_id AS lm_id, l.label AS lm_label, list_distance(v.features, l.features) AS dist FROM vec v, lm l),
nn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, lm_id) AS rank FROM pair QUALIFY rank <= 10),
n AS (SELECT sample_id, count(*) AS n FROM vec GROUP BY 1),
dens AS (SELECT g.lm_id, g.sample_id, coalesce(c, 0) AS raw, coalesce(c, 0) / (n.n / (SELECT avg(n) FROM n)) AS norm
         FROM (SELECT lm.cell_id AS lm_id, n.sample_id FROM lm, n) g JOIN n USING (sample_id)
         LEFT JOIN (SELECT lm_id, sample_id, CAST(count(*) AS DOUBLE) AS c FROM nn WHERE rank = 1 GROUP BY 1, 2) USING (lm_id, sample_id))
"""


def _nn(spark: SparkSession, sf: str, k: int = 10, lm: DataFrame | None = None) -> DataFrame:
    return neighbors.cell_neighbors(vector_cells(spark, sf), vector_landmarks(spark, sf) if lm is None else lm, k)


def _density(spark: SparkSession, sf: str) -> DataFrame:
    cells = vector_cells(spark, sf)
    lm = vector_landmarks(spark, sf)
    hard = _nn(spark, sf, 1, lm).select("sample_id", "cell_id", "lm_id", F.lit(1.0).alias("weight"))
    return mapping.density(hard, lm, C.samples(cells, 1))


@query(_NEAREST + "SELECT lm_id, sample_id, raw, round(norm, 6) AS norm, round(log2(norm + 0.5), 6) AS log_norm FROM dens")
def density(spark: SparkSession, sf: str) -> DataFrame:
    """J4 with one neighbour, A1, M7, M8."""
    return _density(spark, sf).select("lm_id", "sample_id", "raw", _r("norm").alias("norm"), _r("log_norm").alias("log_norm"))


@query(_NEAREST + "SELECT lm_id, round(avg(log2(norm + 0.5)) FILTER (sample_id % 2 = 1) - avg(log2(norm + 0.5)) FILTER (sample_id % 2 = 0), 6) + 0.0 AS coef FROM dens GROUP BY 1")
def density_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a two-group contrast of log density by landmark (least squares: a difference of means)."""
    side = F.col("sample_id") % 2
    return _density(spark, sf).groupBy("lm_id").agg(_r(F.avg(F.when(side == 1, F.col("log_norm"))) - F.avg(F.when(side == 0, F.col("log_norm")))).alias("coef"))


@query(_NEAREST + "SELECT cell_id, rank, lm_id, round(dist, 6) AS dist FROM nn")
def nearest_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Exact neighbours of every cell."""
    return _nn(spark, sf).select("cell_id", F.col("rank").cast("long").alias("rank"), "lm_id", _r("dist").alias("dist"))


@query(_NEAREST + """, v AS (SELECT cell_id, lm_label AS label, count(*) / 10.0 AS confidence, min(rank) AS tie FROM nn GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY confidence DESC, tie, label) = 1)
SELECT cell_id, CASE WHEN confidence >= 0.5 THEN label ELSE '..low.confidence..' END AS label, CAST(confidence AS DOUBLE) AS confidence FROM b""")
def neighbor_label_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """N13 by votes of neighbours, W3."""
    lm = vector_landmarks(spark, sf)
    return mapping.transferred(mapping.neighbor_votes(_nn(spark, sf, lm=lm), lm.select("lm_id", "label")), vector_cells(spark, sf)).select("cell_id", "label", "confidence")


@query(_NEAREST + """, w AS (SELECT cell_id, sample_id, lm_id, lm_label, exp(-dist) AS w FROM nn),
v AS (SELECT sample_id, cell_id, lm_label AS label, sum(w) / sum(sum(w)) OVER (PARTITION BY cell_id) AS confidence, min(lm_id) AS tie FROM w GROUP BY 1, 2, 3),
b AS (SELECT sample_id, cell_id, CASE WHEN confidence >= 0.3 THEN label ELSE '..low.confidence..' END AS label FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY confidence DESC, tie, label) = 1),
c AS (SELECT sample_id, label, count(*) AS count FROM b GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT sample_id FROM c), (SELECT DISTINCT label FROM c))
SELECT sample_id, label, coalesce(count, 0) AS count, round(100.0 * coalesce(count, 0) / sum(coalesce(count, 0)) OVER (PARTITION BY sample_id), 6) AS perc FROM g LEFT JOIN c USING (sample_id, label)""")
def fuzzy_composition(spark: SparkSession, sf: str) -> DataFrame:
    """N13 by weights (a fixed kernel, so that SQL can follow), A2, M9, N11."""
    lm = vector_landmarks(spark, sf)
    edges = _nn(spark, sf, lm=lm).withColumn("weight", F.exp(-F.col("dist")))
    labels = mapping.transferred(mapping.fuzzy_votes(edges, lm.select("lm_id", "label")), vector_cells(spark, sf), 0.3)
    return mapping.composition(labels).select("sample_id", "label", "count", _r("perc").alias("perc"))


_GRAPH = """, d AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.features, b.features) AS dist FROM lm a, lm b),
g AS (SELECT src, dst FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 10),
j AS (SELECT a.src, b.src AS dst, count(*) / (20.0 - count(*)) AS weight FROM g a JOIN g b USING (dst) GROUP BY 1, 2 HAVING count(*) / (20.0 - count(*)) > 1.0 / 15)
"""


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    lm = vector_landmarks(spark, sf)
    return neighbors.cell_neighbors(lm.withColumnRenamed("lm_id", "cell_id"), lm, 10).select(F.col("cell_id").alias("src"), F.col("lm_id").alias("dst"))


@query(_GRAPH + "SELECT src, dst, round(CAST(weight AS DOUBLE), 6) AS weight FROM j")
def shared_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """N6, N7, P11."""
    return neighbors.shared_neighbors(_graph(spark, sf), 10).select("src", "dst", _r("weight").alias("weight"))


@query(_GRAPH + """, s AS (SELECT cell_id AS lm_id, u.k AS component, features[u.k] AS score FROM lm, (SELECT unnest([1, 2, 3]) AS k) u),
deg AS (SELECT src, sum(weight) AS d FROM j GROUP BY 1),
x AS (SELECT lm_id, component, score / sqrt(d) AS x FROM s JOIN deg ON src = lm_id),
r AS (SELECT a.component, sum(weight * power(a.x - b.x, 2)) / 2 AS r FROM j JOIN x a ON a.lm_id = src JOIN x b ON b.lm_id = dst AND b.component = a.component GROUP BY 1),
q AS (SELECT component, sum(score * score) AS q FROM s GROUP BY 1)
SELECT CAST(component AS INTEGER) AS component, round(1 - least(greatest(r / q, 0), 2) / 2, 6) AS sk FROM r JOIN q USING (component)""")
def graph_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    """N28."""
    scores = vector_landmarks(spark, sf).select("lm_id", F.posexplode(F.slice("features", 1, 3)).alias("component", "score")).withColumn("component", F.col("component") + 1)
    return neighbors.smoothness(neighbors.shared_neighbors(_graph(spark, sf), 10), scores).select("component", _r("sk").alias("sk"))


@query("SELECT sample_id, cell_id FROM lm")
def weighted_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling by md5 keys."""
    return vector_landmarks(spark, sf).select("sample_id", F.col("lm_id").alias("cell_id"))


@query("""SELECT sample_id, count(DISTINCT cell_id) AS n_cells, CAST(least(ceil(count(DISTINCT cell_id) * 0.1), ceil(least(sum(count(DISTINCT cell_id)) OVER () * 0.1, 5000.0) / count(*) OVER ())) AS BIGINT) AS quota FROM cell GROUP BY 1 HAVING count(DISTINCT cell_id) >= 10""")
def landmark_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """SC18, P1."""
    return C.quotas(C.samples(order_cells(spark, sf)))


@query("""SELECT 'region' AS "column" FROM (SELECT 1) WHERE (SELECT bool_and(k = 1) FROM (SELECT count(DISTINCT region) + max(CASE WHEN region IS NULL THEN 1 ELSE 0 END) AS k FROM cell GROUP BY sample_id))
UNION ALL SELECT 'status' FROM (SELECT 1) WHERE (SELECT bool_and(k = 1) FROM (SELECT count(DISTINCT status) + max(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS k FROM cell GROUP BY sample_id))""")
def sample_level_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P4."""
    found = C.sample_level_columns(order_cells(spark, sf).drop("cell_id", "priority"))
    return spark.createDataFrame([(c,) for c in found], "`column` string")


@query("SELECT sample_id, any_value(region) AS region FROM cell GROUP BY 1")
def sample_table(spark: SparkSession, sf: str) -> DataFrame:
    """SC13, A10."""
    return C.sample_table(order_cells(spark, sf).drop("cell_id"))


_TOTAL = ", t AS (SELECT sample_id, cell_id, sum(value) AS total FROM assay GROUP BY 1, 2), m AS (SELECT sample_id, avg(total) AS mean_total FROM t GROUP BY 1), nv AS (SELECT a.sample_id, a.cell_id, feature, value / (total / mean_total) AS value FROM assay a JOIN t USING (sample_id, cell_id) JOIN m USING (sample_id))\n"


@query(_TOTAL + "SELECT sample_id, cell_id, feature, round(log2(value + 1), 6) AS value FROM nv")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M3."""
    return C.log2p1(C.normalised(order_assay(spark, sf))).withColumn("value", _r("value"))


@query(_TOTAL + """, v AS (SELECT sample_id, feature, sum(log2(value + 1)) AS s, sum(log2(value + 1) * log2(value + 1)) AS q FROM nv GROUP BY 1, 2),
k AS (SELECT sample_id, count(DISTINCT cell_id) AS n FROM nv GROUP BY 1), z AS (SELECT sample_id, feature, s / n AS mean, greatest((q - s * s / n) / (n - 1), 0) AS variance FROM v JOIN k USING (sample_id))
SELECT sample_id, feature, round(mean, 6) AS mean, round(variance, 6) AS variance, row_number() OVER (PARTITION BY sample_id ORDER BY variance DESC, feature) AS rank FROM z QUALIFY rank <= 10""")
def most_variable(spark: SparkSession, sf: str) -> DataFrame:
    """Implicit zeros count."""
    top = C.most_variable(C.feature_moments(C.log2p1(C.normalised(order_assay(spark, sf)))), 10)
    return top.select("sample_id", "feature", _r("mean").alias("mean"), _r("variance").alias("variance"), F.col("rank").cast("long").alias("rank"))


@query(""", w AS (SELECT sample_id, cell_id, CAST(length(priority) AS DOUBLE) AS w FROM cell), z AS (SELECT sample_id, sum(w) AS total, count(*) FILTER (w > 0) AS n FROM w GROUP BY 1)
SELECT sample_id, feature, round(sum(value * w) / any_value(total) * any_value(n), 6) AS value FROM assay JOIN w USING (sample_id, cell_id) JOIN z USING (sample_id) GROUP BY 1, 2""")
def pseudobulk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    weights = order_cells(spark, sf).select("sample_id", "cell_id", F.length("priority").cast("double").alias("weight"))
    return mapping.pseudobulk(order_assay(spark, sf), weights).withColumn("value", _r("value"))


@query(""", l AS (SELECT sample_id, cell_id, i AS feature, features[i] AS value, CAST(label AS DOUBLE) + 1 AS w FROM vec, (SELECT unnest(range(1, 65)) AS i))
SELECT sample_id, CAST(feature - 1 AS INTEGER) AS feature, round(sum(value * w) / sum(w), 6) + 0.0 AS value FROM l GROUP BY 1, 2""")
def pseudobulk_markers(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    cells = vector_cells(spark, sf)
    weights = cells.select("sample_id", "cell_id", (F.col("label").cast("double") + 1).alias("weight"))
    return mapping.pseudobulk(C.long_form(cells), weights, counts=False).withColumn("value", _r("value"))


@query("SELECT sample_id, count(*) AS n, count(*) / avg(count(*)) OVER () < 0.1 AS outlier FROM cell GROUP BY 1")
def outlier_samples(spark: SparkSession, sf: str) -> DataFrame:
    """P8."""
    return mapping.outlier_samples(order_cells(spark, sf).withColumn("weight", F.lit(1.0)))


@query(""", f AS (SELECT DISTINCT feature FROM assay), u AS (SELECT f.feature, sample_id, CASE WHEN a.value > 0 THEN 'pos.' ELSE 'neg.' END || status AS label FROM cell CROSS JOIN f LEFT JOIN assay a USING (sample_id, cell_id, feature)),
c AS (SELECT feature, sample_id, label, count(*) AS count FROM u GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT sample_id FROM c), (SELECT DISTINCT feature, label FROM c))
SELECT feature, sample_id, label, coalesce(count, 0) AS count, round(100.0 * coalesce(count, 0) / sum(coalesce(count, 0)) OVER (PARTITION BY feature, sample_id), 6) AS perc FROM g LEFT JOIN c USING (feature, sample_id, label)""")
def marker_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with and without each chosen feature."""
    assay = order_assay(spark, sf)
    names = sorted(r.feature for r in assay.select("feature").distinct().collect())
    labels = order_cells(spark, sf).select("sample_id", "cell_id", F.col("status").alias("label"))
    return mapping.marker_summary(assay, labels, names).select("feature", "sample_id", "label", "count", _r("perc").alias("perc"))


@query("SELECT status AS label, feature, median(value) AS median FROM assay JOIN cell USING (sample_id, cell_id) GROUP BY 1, 2")
def median_expression(spark: SparkSession, sf: str) -> DataFrame:
    """A6, R10."""
    return mapping.median_expression(order_assay(spark, sf), order_cells(spark, sf).select("sample_id", "cell_id", F.col("status").alias("label")))


@query("SELECT feature, count(*) AS n FROM assay WHERE value > 0 GROUP BY 1 HAVING count(*) > 0.005 * (SELECT count(*) FROM cell)")
def detected_features(spark: SparkSession, sf: str) -> DataFrame:
    """P3."""
    return C.detected(order_assay(spark, sf), order_cells(spark, sf).count())


_P = ", p AS (SELECT feature AS unit, sample_id AS term, (CAST('0x' || substr(md5('7_' || feature || '_' || sample_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS p, 1 / log10(count(*) + 1) AS w FROM assay GROUP BY 1, 2)\n"


@query(_P + """, c AS (SELECT unit, term, p, sum(w) OVER (PARTITION BY term) * p / sum(w) OVER (PARTITION BY term ORDER BY p, unit) AS a FROM p)
SELECT unit, term, round(least(1.0, min(a) OVER (PARTITION BY term ORDER BY p, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM c""")
def weighted_fdr(spark: SparkSession, sf: str) -> DataFrame:
    """Density-weighted Benjamini-Hochberg for each term, as the models do it."""
    p = order_assay(spark, sf).groupBy(F.col("feature").alias("unit"), F.col("sample_id").alias("term")).agg(F.count("*").cast("double").alias("norm_sum")).withColumn("p", X.u01(7, F.col("unit"), F.col("term")))
    return models.density_adjusted(p).select("unit", "term", _r("q").alias("q"))


@query("SELECT sample_id, cell_id, feature, rank() OVER (PARTITION BY sample_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, feature, value) - 1) / 2.0 AS rank FROM assay")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """W5, N30."""
    return order_assay(spark, sf).select("sample_id", "cell_id", "feature", X.average_rank("value", "sample_id", "feature").alias("rank"))


@query(_TOTAL + """, z AS (SELECT sample_id, feature, avg(log2(value + 1)) AS s FROM nv GROUP BY 1, 2), c AS (SELECT sample_id AS component, feature, round(s - avg(s) OVER (PARTITION BY sample_id), 9) AS loading FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY loading DESC, feature) AS up, row_number() OVER (PARTITION BY component ORDER BY loading, feature) AS down FROM c)
SELECT component, feature, round(loading, 6) + 0.0 AS loading FROM r WHERE (loading > 0 AND up <= 3) OR (loading < 0 AND down <= 2)""")
def extreme_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """T5, W4."""
    mean = C.log2p1(C.normalised(order_assay(spark, sf))).groupBy(F.col("sample_id").alias("component"), "feature").agg(F.avg("value").alias("s"))
    loadings = mean.select("component", "feature", F.round(F.col("s") - F.avg("s").over(Window.partitionBy("component")), 9).alias("loading"))
    return report.extreme_loadings(loadings, 5).select("component", "feature", _r("loading").alias("loading"))


@query(_NEAREST + "SELECT cell_id AS src, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT nn.cell_id, vec.label, count(*) / 10.0 AS p FROM nn JOIN vec ON vec.cell_id = nn.lm_id GROUP BY 1, 2) GROUP BY 1")
def batch_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Mixing of labels among neighbours."""
    batches = vector_cells(spark, sf).select(F.col("cell_id").alias("id"), F.col("label").alias("batch"))
    nn = _nn(spark, sf).select(F.col("cell_id").alias("src"), F.col("lm_id").alias("dst"))
    return validate.batch_entropy(nn, batches).select("src", _r("entropy").alias("entropy"))


@query(_NEAREST + """, b AS (SELECT label, count(*) / (SELECT count(*) FROM vec)::DOUBLE AS share FROM vec GROUP BY 1), s AS (SELECT nn.cell_id, vec.label, count(*) AS n FROM nn JOIN vec ON vec.cell_id = nn.lm_id GROUP BY 1, 2)
SELECT v.cell_id AS src, round(sum(power(coalesce(n, 0) - 10 * share, 2) / (10 * share)), 6) AS chi2 FROM vec v CROSS JOIN b LEFT JOIN s ON s.cell_id = v.cell_id AND s.label = b.label GROUP BY 1""")
def batch_chi_square(spark: SparkSession, sf: str) -> DataFrame:
    """kBET's statistic."""
    batches = vector_cells(spark, sf).select(F.col("cell_id").alias("id"), F.col("label").alias("batch"))
    nn = _nn(spark, sf).select(F.col("cell_id").alias("src"), F.col("lm_id").alias("dst"))
    return validate.batch_chi_square(nn, batches).select("src", _r("chi2").alias("chi2"))


@query("""SELECT CASE WHEN low > 0 THEN round((tp * tn - fp * fn) / sqrt(low), 6) ELSE 0 END AS mcc FROM (SELECT *, (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS low FROM (SELECT
CAST(count(*) FILTER (t AND s) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND NOT s) AS DOUBLE) AS tn, CAST(count(*) FILTER (NOT t AND s) AS DOUBLE) AS fp, CAST(count(*) FILTER (t AND NOT s) AS DOUBLE) AS fn FROM (SELECT status = 'F' AS t, priority < '3' AS s FROM cell)))""")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """X3."""
    pairs = order_cells(spark, sf).select((F.col("status") == "F").alias("truth"), (F.col("priority") < "3").alias("said"))
    return validate.binary_mcc(pairs).select(_r("mcc").alias("mcc"))


@query("SELECT sample_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in "FOP") + " FROM cell GROUP BY 1")
def composition_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A2 as a wide table."""
    return mapping.composition_wide(order_cells(spark, sf).select("sample_id", "cell_id", F.col("status").alias("label")), ["F", "O", "P"])


@query(""", t AS (SELECT features[1] AS x, features[2] AS y FROM vec), g AS (SELECT avg(x) - 3 * stddev_samp(x) AS lx, avg(x) + 6 * stddev_samp(x) AS hx, avg(y) - 3 * stddev_samp(y) AS ly, avg(y) + 6 * stddev_samp(y) AS hy FROM t)
SELECT CAST(least(floor((x - lx) / (hx - lx) * 16), 15) AS INTEGER) AS bx, CAST(least(floor((y - ly) / (hy - ly) * 16), 15) AS INTEGER) AS by, count(*) AS n FROM t, g WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy GROUP BY 1, 2""")
def marker_grid(spark: SparkSession, sf: str) -> DataFrame:
    """R4, P12."""
    return report.marker_pair(vector_cells(spark, sf), 0, 1, 16)


@query(None)
def landmark_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over vectors; (sample_id, component, value) of the sample embedding. Tests hold its invariants."""
    from .pipeline import Analysis, Config

    cells = vector_cells(spark, sf).select("sample_id", "cell_id", "features")
    run = Analysis(cells, cells.select("sample_id").distinct(), Config(components=10)).run()
    rows = [(int(s), k, float(v)) for s, coord in zip(run.sample_names, run.sample_pca.coord, strict=True) for k, v in enumerate(coord)]
    return spark.createDataFrame(rows, "sample_id int, component int, value double")


@query("SELECT DISTINCT cell_id, 'assay' AS side FROM assay WHERE cell_id NOT IN (SELECT cell_id FROM cell WHERE status <> 'P') UNION ALL SELECT cell_id, 'meta' FROM cell WHERE status <> 'P' AND cell_id NOT IN (SELECT cell_id FROM assay)")
def unmatched_cells(spark: SparkSession, sf: str) -> DataFrame:
    """P2, SC9: ids of either side without a partner."""
    return C.matched(order_assay(spark, sf), order_cells(spark, sf).where("status <> 'P'").select("cell_id", "status"))[1]


@query("SELECT feature FROM assay JOIN cell USING (sample_id, cell_id) GROUP BY 1 HAVING count(DISTINCT region) = (SELECT count(DISTINCT region) FROM cell WHERE cell_id IN (SELECT cell_id FROM assay))")
def common_features(spark: SparkSession, sf: str) -> DataFrame:
    """SC12: features that all layers have."""
    layer = order_cells(spark, sf).select("cell_id", F.col("region").alias("layer"))
    return C.common_features(order_assay(spark, sf).join(layer, "cell_id").select("layer", "feature"))


@query("SELECT sample_id, count(DISTINCT status) AS layers FROM cell GROUP BY 1 HAVING count(DISTINCT status) > 1")
def split_samples(spark: SparkSession, sf: str) -> DataFrame:
    """SC12: samples in more than one layer."""
    return C.single_layer_samples(order_cells(spark, sf).select("sample_id", F.col("status").alias("layer")))


@query("SELECT sample_id, cell_id FROM cell WHERE sample_id IN (SELECT sample_id FROM cell GROUP BY 1 HAVING count(DISTINCT cell_id) >= 60)")
def large_samples(spark: SparkSession, sf: str) -> DataFrame:
    """P1 with a larger bound."""
    return C.of_large_samples(order_cells(spark, sf), 60).select("sample_id", "cell_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM (SELECT 1) WHERE (SELECT count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) < count(*) FROM cell) AND (SELECT bool_or(k > 1) FROM (SELECT count(DISTINCT {c}) AS k FROM cell GROUP BY sample_id))" for c in ("status", "priority")))
def annotation_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that can label cells."""
    return spark.createDataFrame([(c,) for c in C.annotation_columns(order_cells(spark, sf))], "`column` string")


@query("SELECT sample_id, cell_id FROM cell WHERE status IN ('F', 'P')")
def cells_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P6 by labels."""
    cells = order_cells(spark, sf)
    labels = cells.select("sample_id", "cell_id", F.col("status").alias("label"))
    return mapping.chosen_cells(cells.select("sample_id", "cell_id"), labels, ["F", "P"])


@query(_NEAREST + ", v AS (SELECT sample_id, cell_id, sum(exp(-dist)) FILTER (lm_id % 2 = 0) / sum(exp(-dist)) AS inside FROM nn GROUP BY 1, 2) SELECT sample_id, cell_id FROM v WHERE inside > 0.5")
def cells_of_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """P6 by a set of landmarks: cells whose weights lie mostly inside."""
    chosen = [r.lm_id for r in vector_landmarks(spark, sf).where("lm_id % 2 = 0").select("lm_id").collect()]  # landmarks
    edges = _nn(spark, sf).withColumn("weight", F.exp(-F.col("dist")))
    return mapping.chosen_cells(vector_cells(spark, sf).select("sample_id", "cell_id"), edges=edges, landmarks=chosen)


@query("""SELECT sample_id, n_cells, CAST(least(ceil(n_cells * 0.1), ceil(least(sum(n_cells) OVER () * 0.1, 5000.0) / count(*) OVER ())) AS BIGINT) AS quota
FROM (SELECT sample_id, count(DISTINCT cell_id) AS n_cells FROM cell WHERE status = 'F' GROUP BY 1 HAVING count(DISTINCT cell_id) >= 20)""")
def subset_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas anew for the cells of a label, small samples dropped."""
    cells = order_cells(spark, sf)
    kept = mapping.chosen_cells(cells.select("sample_id", "cell_id"), cells.select("sample_id", "cell_id", F.col("status").alias("label")), ["F"])
    return C.quotas(C.samples(kept, 20))


@query(_TOTAL + """, l AS (SELECT sample_id, cell_id, feature, log2(value + 1) AS value FROM nv), n AS (SELECT count(DISTINCT cell_id) AS n FROM l),
mo AS (SELECT feature, sum(value) / any_value(n) AS mean, sqrt(greatest((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1), 0)) AS sd FROM l, n GROUP BY 1)
SELECT sample_id, cell_id, feature, round((value - mean) / sd, 6) + 0.0 AS value FROM l JOIN mo USING (feature) WHERE sd > 0""")
def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """M4: scores of the values by feature, over all cells."""
    assay = C.log2p1(C.normalised(order_assay(spark, sf)))
    return C.standardised(assay, C.feature_moments(assay, [])).withColumn("value", _r("value"))


@query(", t AS (SELECT sample_id, cell_id, sum(value) AS total FROM assay GROUP BY 1, 2) SELECT sample_id, cell_id, feature, round(value / (total / 30.0), 6) AS value FROM assay JOIN t USING (sample_id, cell_id)")
def landmark_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """M2: by a given mean total, as the map does with that of the landmarks."""
    return C.normalised(order_assay(spark, sf), 30.0).withColumn("value", _r("value"))


#: Feature names for M5, of several gene families.
_FAMILY = ("RPS", "MT-ND", "ACTB", "trbv", "RPLP")


@query("WITH f AS (SELECT DISTINCT [" + ", ".join(f"'{f}'" for f in _FAMILY) + "][p_partkey % 5 + 1] || CAST(p_partkey % 130 AS VARCHAR) AS feature FROM part) SELECT feature FROM f WHERE feature = 'RPS25' OR NOT regexp_matches(feature, '" + X.EXCLUDED + "')", views=False)
def features_kept(spark: SparkSession, sf: str) -> DataFrame:
    """M5, M6: without receptor, mitochondrial and ribosomal names, but for a forced one."""
    key = F.col("p_partkey")
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.array(*[F.lit(f) for f in _FAMILY])[(key % 5).cast("int")], (key % 130).cast("string")).alias("feature")).distinct()
    return C.without_excluded(names, ["RPS25"])


@query("SELECT cell_id, CAST(i - 1 AS INTEGER) AS feature, round(asinh(features[i] / 5.0), 6) + 0.0 AS value FROM vec, (SELECT unnest(range(1, 65)) AS i)")
def arcsinh(spark: SparkSession, sf: str) -> DataFrame:
    """M13."""
    return C.long_form(vector_cells(spark, sf)).select("cell_id", "feature", _r(X.arcsinh(F.col("value"))).alias("value"))


_SHARES = """, c AS (SELECT sample_id, label, count(*) AS count FROM vec GROUP BY 1, 2), gr AS (SELECT * FROM (SELECT DISTINCT sample_id FROM vec), (SELECT DISTINCT label FROM vec)),
comp AS (SELECT sample_id, label, coalesce(count, 0) AS count, 100.0 * coalesce(count, 0) / sum(coalesce(count, 0)) OVER (PARTITION BY sample_id) AS perc FROM gr LEFT JOIN c USING (sample_id, label))
"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return vector_cells(spark, sf).select("sample_id", F.when(F.col("sample_id") % 2 == 1, "odd").otherwise("even").alias("side")).distinct()


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.composition(vector_cells(spark, sf).select("sample_id", "cell_id", "label"))


@query(_SHARES + "SELECT sample_id, label, CASE sample_id % 2 WHEN 1 THEN 'odd' ELSE 'even' END AS side, count, round(perc, 6) AS perc, round(log2(perc + 0.5), 6) + 0.0 AS log_perc FROM comp WHERE label IN ('1', '2', '3')")
def percentages(spark: SparkSession, sf: str) -> DataFrame:
    """Percents of chosen labels with the samples' columns."""
    out = report.percentages(_shares(spark, sf), _samples(spark, sf), ["1", "2", "3"])
    return out.select("sample_id", "label", "side", "count", _r("perc").alias("perc"), _r(X.log_norm(F.col("perc"))).alias("log_perc"))


@query(_NEAREST + "SELECT lm_id, d.sample_id, CASE d.sample_id % 2 WHEN 1 THEN 'odd' ELSE 'even' END AS side, label, round(log2(norm + 0.5), 6) + 0.0 AS log_norm FROM dens d JOIN lm ON lm.cell_id = lm_id")
def density_table(spark: SparkSession, sf: str) -> DataFrame:
    """Density with the samples' columns and the landmarks' labels."""
    out = report.densities(_density(spark, sf), _samples(spark, sf), vector_landmarks(spark, sf).select("lm_id", "label"))
    return out.select("lm_id", "sample_id", "side", "label", _r("log_norm").alias("log_norm"))


_HASHED = "(CAST('0x' || substr(md5('{seed}_' || {ids}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


@query(_NEAREST + _SHARES.replace(", c AS", ", cc AS").replace("JOIN c ", "JOIN cc ") + ", f AS (SELECT lm_id, avg(log2(norm + 0.5)) FILTER (sample_id % 2 = 1) - avg(log2(norm + 0.5)) FILTER (sample_id % 2 = 0) AS coef, " + _HASHED.format(seed=9, ids="lm_id") + """ AS q FROM dens GROUP BY 1),
mean AS (SELECT label, avg(perc) AS mean_perc FROM comp GROUP BY 1)
SELECT lm_id, round(coef, 6) + 0.0 AS coef, round(q, 6) AS q, CASE WHEN q <= 0.3 AND round(coef, 6) > 0 THEN 'more abundant' WHEN q <= 0.3 AND round(coef, 6) < 0 THEN 'less abundant' ELSE 'not sig.' END AS sig, lm.label, round(mean_perc, 6) AS mean_perc
FROM f JOIN lm ON lm.cell_id = lm_id JOIN mean ON mean.label = lm.label""")
def beeswarm(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients by landmark with significance, label and mean percent."""
    fit = density_contrast(spark, sf).withColumn("q", X.u01(9, F.col("lm_id")))
    out = report.beeswarm(fit, vector_landmarks(spark, sf).select("lm_id", "label"), _shares(spark, sf), cut=0.3)
    return out.select("lm_id", "coef", _r("q").alias("q"), "sig", "label", _r("mean_perc").alias("mean_perc"))


@query(", m AS (SELECT feature, status AS term, round(avg(value) - 25, 6) + 0.0 AS coef FROM assay JOIN cell USING (sample_id, cell_id) WHERE status <> 'P' GROUP BY 1, 2), q AS (SELECT DISTINCT feature, status AS term, round(" + _HASHED.format(seed=11, ids="feature || '_' || status") + """, 6) AS q FROM assay JOIN cell USING (sample_id, cell_id) WHERE status <> 'O')
SELECT feature, term, coef, q, CASE WHEN q <= 0.5 AND coef > 0 THEN 'higher' WHEN q <= 0.5 AND coef < 0 THEN 'lower' ELSE 'not sig.' END AS sig FROM m FULL JOIN q USING (feature, term)""")
def coefficient_table(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients and adjusted p by unit and term, full outer."""
    both = order_assay(spark, sf).join(order_cells(spark, sf).select("cell_id", F.col("status").alias("term")), "cell_id")
    coef = both.where("term <> 'P'").groupBy("feature", "term").agg(_r(F.avg("value") - 25).alias("coef"))
    q = both.where("term <> 'O'").select("feature", "term").distinct().withColumn("q", _r(X.u01(11, F.col("feature"), F.col("term"))))
    return report.coefficient_table(coef, q, ["feature", "term"], 0.5).select("feature", "term", "coef", "q", "sig")


@query(", m AS (SELECT status AS label, feature, median(value) AS median FROM assay JOIN cell USING (sample_id, cell_id) GROUP BY 1, 2), s AS (SELECT *, stddev_samp(median) OVER (PARTITION BY feature) AS sd, avg(median) OVER (PARTITION BY feature) AS mean FROM m) SELECT label, feature, median, round((median - mean) / sd, 6) + 0.0 AS z FROM s WHERE sd > 0")
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Medians standardised by feature, where they differ."""
    spread = F.stddev_samp("median").over(Window.partitionBy("feature"))
    medians = median_expression(spark, sf).withColumn("sd", spread).where("sd > 0").drop("sd")
    return report.heatmap(medians).withColumn("z", _r("z"))


@query("SELECT cell_id AS lm_id, label, row_number() OVER (ORDER BY label, features[1] DESC, cell_id) AS place, round(features[1], 6) + 0.0 AS x, round(features[2], 6) + 0.0 AS y FROM lm")
def landmark_order(spark: SparkSession, sf: str) -> DataFrame:
    """Landmarks by several keys, with two coordinates and a feature."""
    lm = vector_landmarks(spark, sf)
    at = report.coordinates(lm.withColumnRenamed("features", "coord").select("lm_id", "coord"), 0, 1, lm.select("lm_id", "label"))
    return report.ordered(at, "label", "-x").select("lm_id", "label", F.col("place").cast("long").alias("place"), _r("x").alias("x"), _r("y").alias("y"))


@query(", f AS (SELECT label, dense_rank() OVER (ORDER BY min(cell_id)) AS number FROM lm GROUP BY 1) SELECT lm.cell_id AS lm_id, 'cluster.' || lpad(CAST(number AS VARCHAR), 2, '0') AS cluster FROM lm JOIN f USING (label)")
def cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    """Labels renumbered by first appearance."""
    return annotate.numbered(vector_landmarks(spark, sf).select("lm_id", "label")).select("lm_id", X.cluster_label(F.col("number"), 2).alias("cluster"))


@query("SELECT cell_id AS lm_id, CASE WHEN label < '5' THEN 'low' ELSE 'high' END AS label FROM lm")
def cell_types(spark: SparkSession, sf: str) -> DataFrame:
    """Landmarks take their cells' labels, then the type of each."""
    cells = vector_cells(spark, sf)
    lm = vector_landmarks(spark, sf).select("lm_id", "sample_id", F.col("lm_id").alias("cell_id"))
    annot = annotate.from_cells(lm, cells.select("sample_id", "cell_id", "label"))
    known = sorted(r.label for r in annot.select("label").distinct().collect())  # labels: ten
    types = {"low": [k for k in known if k < "5"], "high": [k for k in known if k >= "5"]}
    return annotate.from_clusters(annot, types)


@query(_NEAREST + """, m AS (SELECT cell_id, lm_label AS said FROM (SELECT cell_id, lm_label, count(*) AS n FROM nn GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, lm_label) = 1)
SELECT label AS truth, said, count(*) AS n FROM m JOIN vec USING (cell_id) GROUP BY 1, 2""")
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against the majority among neighbours."""
    lm = vector_landmarks(spark, sf)
    labels = lm.select(F.col("lm_id").alias("id"), "label")
    said = validate.majority_label(_nn(spark, sf, lm=lm).select(F.col("cell_id").alias("src"), F.col("lm_id").alias("dst")), labels)
    truth = vector_cells(spark, sf).select(F.col("cell_id").alias("src"), F.col("label").alias("truth"))
    return validate.confusion(truth.join(said.withColumnRenamed("label", "said"), "src"))


@query(_P + "SELECT term AS model, CAST(count(*) FILTER (p <= 0.1) AS BIGINT) AS n_sig, round(min(p), 9) AS min_q FROM p GROUP BY 1")
def discoveries(spark: SparkSession, sf: str) -> DataFrame:
    """X2."""
    p = order_assay(spark, sf).select("feature", F.col("sample_id").alias("model")).distinct().withColumn("q", X.u01(7, F.col("feature"), F.col("model")))
    return validate.discoveries(p).select("model", "n_sig", _r("min_q", 9).alias("min_q"))


@query("SELECT sample_id, min(CAST(cell_id AS BIGINT)) AS first FROM cell GROUP BY 1")
def sample_order(spark: SparkSession, sf: str) -> DataFrame:
    """SC7: samples by first appearance."""
    return store.sample_order(order_cells(spark, sf).withColumn("cell_ord", F.col("cell_id").cast("long")))


@query("SELECT vec_id AS cell_id, CASE WHEN label % 4 = 0 THEN NULL ELSE 'type' || CAST(label % 4 AS VARCHAR) END AS value FROM embeddings", views=False)
def decoded_labels(spark: SparkSession, sf: str) -> DataFrame:
    """SC4: dictionary codes, below zero null."""
    codes = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), (F.col("label") % 4 - 1).alias("code"))
    return store.decoded(codes, spark.createDataFrame([(k, f"type{k + 1}") for k in range(3)], "code int, value string")).select("cell_id", "value")


@query(_NEAREST + "SELECT sample_id, cell_id FROM nn WHERE rank = 1 AND lm_id IN (SELECT min(cell_id) FROM lm GROUP BY sample_id)")
def cells_nearest_to(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose nearest landmark is a chosen one."""
    chosen = [r.first for r in vector_landmarks(spark, sf).groupBy("sample_id").agg(F.min("lm_id").alias("first")).collect()]  # one a sample
    return mapping.nearest_landmark_cells(_nn(spark, sf), chosen)


@query(_GRAPH + ", deg AS (SELECT src, sum(weight) AS d FROM j GROUP BY 1) SELECT src, dst, round(CAST(weight / d AS DOUBLE), 6) AS p FROM j JOIN deg USING (src)")
def random_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Transition shares of the landmark graph."""
    edges = neighbors.shared_neighbors(_graph(spark, sf), 10)
    return neighbors.transitions(edges).select("src", "dst", _r("p").alias("p"))


@query(None)
def cell_leverage(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, cell_id, weight), leverage of each cell within its sample. Tests hold it against the hat matrix."""
    return linalg.leverage(vector_cells(spark, sf).select("sample_id", "cell_id", "features"))
