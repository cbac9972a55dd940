"""Queries of the numerical operators: each calls the operator itself, and its SQL is the closed form of a case small enough to have one."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..functions import columns as X
from ..operators import cells as C
from ..operators import cluster, expression, linalg, mapping, models, neighbors, report, validate
from ..sources import store
from .adapters import order_assay, order_cells, table, vector_cells, vector_landmarks
from .queries import _GRAPH, _HASHED, _NEAREST, _P, _SHARES, _density, _graph, _nn, _r, _samples, _shares
from .registry import query

_MARKS = ", mark AS (SELECT sample_id, cell_id, CAST(label AS DOUBLE) + 1 AS w, CAST(i - 1 AS VARCHAR) AS feature, features[i] AS value FROM vec, (SELECT unnest(range(1, 65)) AS i))\n"
_Y = _NEAREST + ", y AS (SELECT lm_id, sample_id, sample_id % 2 AS g, log2(norm + 0.5) AS y FROM dens)"


def _matrix(spark: SparkSession, sf: str) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(log density, sums of norm, landmarks, samples)."""
    pdf = _density(spark, sf).toPandas()  # landmarks x samples
    wide = pdf.pivot(index="lm_id", columns="sample_id", values="log_norm").sort_index(axis=1)
    return wide.to_numpy(), pdf.groupby("lm_id")["norm"].sum().reindex(wide.index).to_numpy(), [int(i) for i in wide.index], [int(s) for s in wide.columns]


def _landmark_array(spark: SparkSession, sf: str) -> tuple[np.ndarray, list, list]:
    rows = vector_landmarks(spark, sf).orderBy("lm_id").collect()  # landmarks
    return np.array([r.features for r in rows], float), [int(r.lm_id) for r in rows], [r.label for r in rows]


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else int(v) if isinstance(v, np.integer) else v for v in r) for r in rows], schema)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits).alias(c) if c in names else c for c in df.columns])


# models of density


@query(_Y + """, m AS (SELECT lm_id, avg(y) FILTER (g = 1) AS m1, avg(y) FILTER (g = 0) AS m0, var_pop(y) FILTER (g = 1) * count(*) FILTER (g = 1) + var_pop(y) FILTER (g = 0) * count(*) FILTER (g = 0) AS ss, count(*) AS n, 1.0 / count(*) FILTER (g = 1) + 1.0 / count(*) FILTER (g = 0) AS h FROM y GROUP BY 1),
s AS (SELECT lm_id, m1 - m0 AS coef, sqrt(ss / (n - 2) * h) AS se FROM m)
SELECT lm_id, round(coef, 6) + 0.0 AS coef, round(se, 6) + 0.0 AS se, CASE WHEN se > 1e-6 THEN round(coef / se, 5) + 0.0 ELSE 0.0 END AS t FROM s""")
def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of log density on two groups, by landmark."""
    y, _, lm, names = _matrix(spark, sf)
    fit = models.ols(y, np.c_[np.ones(len(names)), [s % 2 for s in names]])
    return _frame(spark, [(i, round(float(c), 6) + 0.0, round(float(e), 6) + 0.0, round(float(c / e), 5) + 0.0 if e > 1e-6 else 0.0) for i, c, e in zip(lm, fit.coef[:, 1], fit.se[:, 1], strict=True)], "lm_id long, coef double, se double, t double")


def _digamma(x: str) -> str:
    return f"(ln({x} + 50) - 0.5 / ({x} + 50) - 1 / (12 * power({x} + 50, 2)) + 1 / (120 * power({x} + 50, 4)) - list_sum(list_transform(range(0, 50), lambda k: 1 / ({x} + k))))"


def _trigamma(x: str) -> str:
    return f"(1 / ({x} + 50) + 0.5 / power({x} + 50, 2) + 1 / (6 * power({x} + 50, 3)) - 1 / (30 * power({x} + 50, 5)) + list_sum(list_transform(range(0, 50), lambda k: 1 / power({x} + k, 2))))"


_PRIOR = _Y + """, m AS (SELECT lm_id, avg(y) FILTER (g = 1) - avg(y) FILTER (g = 0) AS coef, (var_pop(y) FILTER (g = 1) * count(*) FILTER (g = 1) + var_pop(y) FILTER (g = 0) * count(*) FILTER (g = 0)) / (count(*) - 2) AS s2, count(*) - 2.0 AS df, 1.0 / count(*) FILTER (g = 1) + 1.0 / count(*) FILTER (g = 0) AS h FROM y GROUP BY 1),
md AS (SELECT greatest(median(s2), 1e-300) * 1e-12 AS floor FROM m), z AS (SELECT lm_id, df, ln(greatest(s2, floor)) AS z FROM m, md), qz AS (SELECT quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.9) AS hi FROM z),
e AS (SELECT df, least(greatest(z, lo), hi) - """ + _digamma("(df / 2)") + """ + ln(df / 2) AS e FROM z, qz), pr AS (SELECT any_value(df) AS df, avg(e) AS mean, var_samp(e) - """ + _trigamma("(any_value(df) / 2)") + """ AS spread, count(*) AS units FROM e),
bi AS (SELECT -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, spread, 0 AS i FROM pr UNION ALL SELECT CASE WHEN """ + _trigamma("exp((lo + hi) / 2)") + """ > spread THEN (lo + hi) / 2 ELSE lo END, CASE WHEN """ + _trigamma("exp((lo + hi) / 2)") + """ > spread THEN hi ELSE (lo + hi) / 2 END, spread, i + 1 FROM bi WHERE i < 90),
d AS (SELECT exp((lo + hi) / 2) AS half FROM bi WHERE i = 90), prior AS (SELECT spread > 0 AS finite, CASE WHEN spread > 0 THEN 2 * half END AS d0, CASE WHEN spread > 0 THEN exp(mean + """ + _digamma("half") + """ - ln(half)) ELSE exp(mean) END AS s0, df, units FROM pr, d),
post AS (SELECT lm_id, coef, h, CASE WHEN finite THEN (d0 * s0 + m.df * s2) / (d0 + m.df) ELSE s0 END AS v, CASE WHEN finite THEN least(m.df + d0, m.df * units) ELSE m.df * units END AS nu FROM m, prior),
st AS (SELECT lm_id, coef, v, nu, abs(coef / sqrt(v * h)) AS t FROM post),
pv AS (SELECT lm_id, coef, v, nu, t, 1 - 2 * t / 2000 / 3 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(t * i / 2000, 2) / nu, -(nu + 1) / 2))) AS p FROM st)
"""


@query(_PRIOR + """, w AS (SELECT lm_id, 1 / log10(sum(norm) + 1) AS w FROM dens GROUP BY 1), a AS (SELECT lm_id, coef, p, count(*) OVER () * p / row_number() OVER (ORDER BY p, lm_id) AS a, sum(w) OVER () * p / sum(w) OVER (ORDER BY p, lm_id ROWS UNBOUNDED PRECEDING) AS b FROM pv JOIN w USING (lm_id))
SELECT lm_id, round(coef, 6) + 0.0 AS coef, round(p, 6) AS p, round(least(1.0, min(a) OVER (ORDER BY p, lm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, round(least(1.0, min(b) OVER (ORDER BY p, lm_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS weighted_q FROM a""")
def moderated_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Moderated models of landmark density, their p, q and density-weighted q. SQL bisects the prior and sums the t density."""
    y, norm, lm, names = _matrix(spark, sf)
    fit = models.fitted(y, np.c_[np.ones(len(names)), [s % 2 for s in names]])
    q = models.density_q(fit.p[:, 1], norm)
    return _rounded(_frame(spark, list(zip(lm, fit.coef[:, 1], fit.p[:, 1], fit.q[:, 1], q, strict=True)), "lm_id long, coef double, p double, q double, weighted_q double"), "coef", "p", "q", "weighted_q")


@query(_PRIOR + "SELECT lm_id, round(v, 6) AS variance, round(nu, 4) AS df, round(t, 5) AS t FROM pv")
def moderated_variances(spark: SparkSession, sf: str) -> DataFrame:
    """Variances drawn to the prior, total degrees of freedom and t by landmark."""
    y, _, lm, names = _matrix(spark, sf)
    fit = models.fitted(y, np.c_[np.ones(len(names)), [s % 2 for s in names]])
    return _frame(spark, [(i, round(float(v), 6), round(float(fit.df_total), 4), round(abs(float(t)), 5)) for i, v, t in zip(lm, fit.s2_post, fit.t[:, 1], strict=True)], "lm_id long, variance double, df double, t double")


@query(_Y + """, r AS (SELECT lm_id, y, g - (avg(g) OVER w + covar_pop(g, sample_id) OVER w / var_pop(sample_id) OVER w * (sample_id - avg(sample_id) OVER w)) AS r FROM y WINDOW w AS (PARTITION BY lm_id))
SELECT lm_id, round(sum(r * y) / sum(r * r), 6) + 0.0 AS coef FROM r GROUP BY 1""")
def adjusted_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """The group's coefficient beside a numeric covariate, as a contrast of a design of three columns."""
    y, _, lm, names = _matrix(spark, sf)
    x, _ = models.model_matrix([s % 2 for s in names], [float(s) for s in names])
    fit = models.fitted(y, x, np.array([[0.0], [1.0], [0.0]]))
    return _rounded(_frame(spark, list(zip(lm, fit.coef[:, 0], strict=True)), "lm_id long, coef double"), "coef")


@query(_Y + """, z AS (SELECT lm_id, sample_id, g, y - avg(y) OVER (PARTITION BY lm_id) AS y FROM y), d AS (SELECT lm_id, avg(y) FILTER (g = 1) - avg(y) FILTER (g = 0) AS d FROM z GROUP BY 1),
norm AS (SELECT sqrt(sum(d * d)) AS norm FROM d)
SELECT sample_id, round(sum(y * d) / any_value(norm), 6) + 0.0 AS coord FROM z JOIN d USING (lm_id), norm GROUP BY 1""")
def contrast_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Samples along one contrast; of two groups, along the difference of their means."""
    y, _, _, names = _matrix(spark, sf)
    g = np.array([s % 2 for s in names], float)
    e = models.contrast_embedding(y, np.c_[np.ones(len(g)), g], np.array([0.0, 1.0]))
    turn = 1.0 if e.coord[g == 1, 0].mean() > 0 else -1.0
    return _rounded(_frame(spark, list(zip(names, turn * e.coord[:, 0], strict=True)), "sample_id int, coord double"), "coord")


@query(_Y + """, z AS (SELECT lm_id, sample_id, y - avg(y) OVER (PARTITION BY lm_id) AS y FROM y), k AS (SELECT a.sample_id AS s, b.sample_id AS o, sum(a.y * b.y) AS k FROM z a JOIN z b USING (lm_id) GROUP BY 1, 2)
SELECT s AS sample_id, o AS other, round(k, 5) + 0.0 AS product FROM k""")
def sample_components(spark: SparkSession, sf: str) -> DataFrame:
    """Products of samples in all components, which are those of their centred densities."""
    y, _, _, names = _matrix(spark, sf)
    coord = models.sample_pca(y, len(names)).coord
    k = coord @ coord.T
    return _frame(spark, [(s, o, round(float(k[i, j]), 5) + 0.0) for i, s in enumerate(names) for j, o in enumerate(names)], "sample_id int, other int, product double")


@query(_SHARES + """, y AS (SELECT label, sample_id % 2 AS g, log2(perc + 0.5) AS y FROM comp)
SELECT label, round(avg(y) FILTER (g = 1) - avg(y) FILTER (g = 0), 6) + 0.0 AS coef FROM y GROUP BY 1""")
def composition_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """N18 on composition: log percents of labels by group."""
    pdf = _shares(spark, sf).select("label", "sample_id", X.log_norm(F.col("perc")).alias("y")).toPandas()  # labels x samples
    wide = pdf.pivot(index="label", columns="sample_id", values="y").sort_index(axis=1)
    fit = models.fitted(wide.to_numpy(), np.c_[np.ones(wide.shape[1]), [s % 2 for s in wide.columns]])
    return _rounded(_frame(spark, list(zip(wide.index, fit.coef[:, 1], strict=True)), "label string, coef double"), "coef")


# expression


@query(_MARKS + """, m AS (SELECT sample_id, feature, sum(value * w) / sum(w) AS v FROM mark GROUP BY 1, 2)
SELECT feature, round(avg(v) FILTER (sample_id % 2 = 1) - avg(v) FILTER (sample_id % 2 = 0), 6) + 0.0 AS coef FROM m GROUP BY 1""")
def pseudobulk_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """N20 with a design: weighted means of markers by sample, two groups of samples."""
    cells = vector_cells(spark, sf)
    weights = cells.select("sample_id", "cell_id", (F.col("label").cast("double") + 1).alias("weight"))
    values = C.long_form(cells).withColumn("feature", F.col("feature").cast("string"))
    got = expression.design_mode(values, weights, list(range(10)), np.c_[np.ones(10), np.arange(10) % 2], np.array([[0.0], [1.0]]), counts=False)
    return _rounded(got.table(spark, 0).select("feature", "coef"), "coef")


@query(_MARKS + """, m AS (SELECT sample_id, feature, avg(value) FILTER (w <= 5) AS a, avg(value) FILTER (w > 5) AS b FROM mark GROUP BY 1, 2)
SELECT feature, round(avg(a - b), 6) + 0.0 AS coef FROM m GROUP BY 1""")
def marker_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """N20 with markers: cells of some labels against the others in the same samples."""
    cells = vector_cells(spark, sf)
    values = C.long_form(cells).withColumn("feature", F.col("feature").cast("string"))
    side = lambda cond: cells.where(cond).select("sample_id", "cell_id", F.lit(1.0).alias("weight"))
    low = F.col("label").cast("int") < 5
    return _rounded(expression.marker_mode(values, side(low), side(~low), list(range(10)), counts=False).table(spark, 0).select("feature", "coef"), "coef")


@query(""", pb AS (SELECT sample_id, feature, sum(value) AS v FROM assay WHERE sample_id < 10 GROUP BY 1, 2), lib AS (SELECT sample_id, sum(v) AS lib FROM pb GROUP BY 1),
cut AS (SELECT 10 / median(lib) * 1e6 AS cut FROM lib), f AS (SELECT feature, count(*) FILTER (v / lib * 1e6 >= cut) AS k, sum(v) AS total FROM pb JOIN lib USING (sample_id), cut GROUP BY 1)
SELECT feature FROM f WHERE k >= 5 AND total >= 15""")
def expressed_features(spark: SparkSession, sf: str) -> DataFrame:
    """N20's filter of counts: features with enough a million in as many samples as the smaller group has."""
    assay = order_assay(spark, sf).where("sample_id < 10")
    y, names = expression.matrix(assay, assay.select("sample_id", "cell_id").distinct().withColumn("weight", F.lit(1.0)), list(range(10)), True)
    kept = models.expressed(y, np.c_[np.ones(10), np.arange(10) % 2])
    return _frame(spark, [(n,) for n, k in zip(names, kept, strict=True) if k], "feature string")


@query(""", pb AS (SELECT sample_id, feature, CAST(sum(value) AS DOUBLE) AS v FROM assay WHERE sample_id < 10 GROUP BY 1, 2), tot AS (SELECT sample_id, sum(v) AS total FROM pb GROUP BY 1),
up AS (SELECT sample_id, quantile_cont(v / total, 0.75) AS u FROM pb JOIN tot USING (sample_id) WHERE v > 0 GROUP BY 1), ref AS (SELECT sample_id AS ref FROM up ORDER BY round(abs(u - (SELECT avg(u) FROM up)), 12), sample_id LIMIT 1),
ab AS (SELECT a.sample_id, a.feature, a.v / ta.total AS a, b.v / tb.total AS b, (ta.total - a.v) / ta.total / a.v + (tb.total - b.v) / tb.total / b.v AS iw FROM ref JOIN pb b ON b.sample_id = ref JOIN tot tb ON tb.sample_id = ref JOIN pb a ON a.feature = b.feature AND a.sample_id <> ref JOIN tot ta ON ta.sample_id = a.sample_id WHERE a.v > 0 AND b.v > 0),
me AS (SELECT sample_id, log2(a / b) AS m, log2(a * b) / 2 AS e, 1 / iw AS w FROM ab), rk AS (SELECT sample_id, m, w, count(*) OVER s AS n, rank() OVER (PARTITION BY sample_id ORDER BY round(m, 12)) + (count(*) OVER (PARTITION BY sample_id, round(m, 12)) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY sample_id ORDER BY round(e, 12)) + (count(*) OVER (PARTITION BY sample_id, round(e, 12)) - 1) / 2.0 AS ra FROM me WINDOW s AS (PARTITION BY sample_id)),
f AS (SELECT sample_id, power(2, sum(w * m) / sum(w)) AS f FROM rk WHERE n >= 3 AND rm >= floor(n * 0.3) + 1 AND rm <= n - floor(n * 0.3) AND ra >= floor(n * 0.05) + 1 AND ra <= n - floor(n * 0.05) GROUP BY 1), whole AS (SELECT sample_id, coalesce(f, 1.0) AS f FROM tot LEFT JOIN f USING (sample_id))
SELECT sample_id, round(f / exp(avg(ln(f)) OVER ()), 6) AS factor FROM whole""")
def size_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed means of log ratios, of ten samples' pseudobulk counts."""
    assay = order_assay(spark, sf).where("sample_id < 10")
    y, _ = expression.matrix(assay, assay.select("sample_id", "cell_id").distinct().withColumn("weight", F.lit(1.0)), list(range(10)), True)
    return _rounded(_frame(spark, list(enumerate(models.tmm(y))), "sample_id int, factor double"), "factor")


# landmarks and components


@query(""", t AS (SELECT sample_id, cell_id, features[1] - avg(features[1]) OVER w AS a, features[2] - avg(features[2]) OVER w AS b FROM vec WINDOW w AS (PARTITION BY sample_id)),
m AS (SELECT sample_id, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM t GROUP BY 1)
SELECT sample_id, cell_id, round((a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab), 6) AS weight FROM t JOIN m USING (sample_id)""")
def leverage_of_two(spark: SparkSession, sf: str) -> DataFrame:
    """Leverage within samples, of two features in closed form."""
    cells = vector_cells(spark, sf).select("sample_id", "cell_id", F.slice("features", 1, 2).alias("features"))
    return _rounded(linalg.leverage(cells), "weight")


@query(""", s AS (SELECT sample_id, cell_id, -ln(""" + _HASHED.format(seed=123, ids="sample_id || '_' || cell_id") + """) / (CAST(label AS DOUBLE) + 1) AS key FROM vec)
SELECT sample_id, cell_id FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY key, cell_id) <= 3 + sample_id""")
def unequal_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sampling, with weights and quotas that differ."""
    cells = vector_cells(spark, sf).select("sample_id", "cell_id", (F.col("label").cast("double") + 1).alias("weight"))
    quota = cells.select("sample_id").distinct().withColumn("quota", (F.col("sample_id") + 3).cast("long"))
    return C.weighted_sample(cells, quota).select("sample_id", "cell_id")


_TWO = """, s AS (SELECT avg(features[1]) AS m1, avg(features[2]) AS m2, stddev_samp(features[1]) AS s1, stddev_samp(features[2]) AS s2, corr(features[1], features[2]) AS r, count(*) AS n FROM lm)
"""


@query(_TWO + """, z AS (SELECT cell_id, (features[1] - m1) / s1 AS a, (features[2] - m2) / s2 AS b, r FROM vec, s), p AS (SELECT cell_id, (a + b) / sqrt(2) AS plus, (a - b) / sqrt(2) AS minus, r FROM z)
SELECT cell_id, round(abs(CASE WHEN r >= 0 THEN plus ELSE minus END), 6) AS first, round(abs(CASE WHEN r >= 0 THEN minus ELSE plus END), 6) AS second FROM p""")
def projected_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the landmarks, of two features in closed form, and all cells in them (signs aside)."""
    x, *_ = _landmark_array(spark, sf)
    model = linalg.pca(x[:, :2], 2)

    def run(batches):
        for pdf in batches:
            z = np.abs(model.project(linalg.vectors(pdf, 2)))
            yield pdf.assign(first=z[:, 0], second=z[:, 1])[["cell_id", "first", "second"]]

    cells = vector_cells(spark, sf).select("cell_id", F.slice("features", 1, 2).alias("features"))
    return _rounded(cells.mapInPandas(run, "cell_id long, first double, second double"), "first", "second")


@query(_TWO + """, z AS (SELECT cell_id, ((features[1] - m1) / s1 + sign(s.r) * (features[2] - m2) / s2) / 2 AS z, sign(s.r) AS sg, m1, m2, s1, s2 FROM lm, s)
SELECT cell_id AS lm_id, round(z * s1 + m1, 6) + 0.0 AS first, round(sg * z * s2 + m2, 6) + 0.0 AS second FROM z""")
def reconstructed_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Expression of the landmarks from their first component, of two features in closed form."""
    x, ids, _ = _landmark_array(spark, sf)
    _, expr = linalg.reconstructed(linalg.pca(x[:, :2], 1))
    return _rounded(_frame(spark, list(zip(ids, expr[:, 0], expr[:, 1], strict=True)), "lm_id long, first double, second double"), "first", "second")


@query(_TWO + """SELECT CAST(k AS INTEGER) AS component, round(sqrt(1 + (CASE k WHEN 0 THEN 1 ELSE -1 END) * abs(r)), 6) AS sdev FROM s, (SELECT unnest([0, 1]) AS k)""")
def component_deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Standard deviations of the landmarks' components, of two features in closed form."""
    x, *_ = _landmark_array(spark, sf)
    return _rounded(_frame(spark, list(enumerate(linalg.pca(x[:, :2], 2).sdev)), "component int, sdev double"), "sdev")


@query(_TWO + """, w AS (SELECT sample_id, cell_id, (features[1] - m1) / s1 AS a, (features[2] - m2) / s2 AS b, r, n FROM vec, s)
SELECT sample_id, cell_id, round((power(a + b, 2) / 2 / (1 + r) + power(a - b, 2) / 2 / (1 - r)) / (n - 1), 6) AS weight FROM w""")
def projected_leverage(spark: SparkSession, sf: str) -> DataFrame:
    """N1's second pass: leverage of all cells on the landmarks' components, of two features in closed form."""
    x, *_ = _landmark_array(spark, sf)
    cells = vector_cells(spark, sf).select("sample_id", "cell_id", F.slice("features", 1, 2).alias("features"))
    return _rounded(linalg.projected_leverage(cells, linalg.pca(x[:, :2], 2)), "weight")


@query(""", c AS (SELECT sample_id AS c, features AS f FROM lm WHERE r = 1), l AS (SELECT v.cell_id, c.c, -2 * (1 - list_cosine_similarity(v.features, c.f)) / 0.1 AS l FROM vec v, c),
e AS (SELECT cell_id, c, exp(l - max(l) OVER (PARTITION BY cell_id)) AS e FROM l)
SELECT cell_id, CAST(c AS INTEGER) AS centroid, round(e / sum(e) OVER (PARTITION BY cell_id), 6) AS share FROM e""")
def soft_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of cells in centroids, by the cosine."""
    keyed = vector_cells(spark, sf).withColumn("key", X.sampling_key(123, F.lit(1.0), F.col("sample_id"), F.col("cell_id")))
    first = sorted(keyed.groupBy("sample_id").agg(F.min(F.struct("key", "cell_id", "features")).alias("m")).collect(), key=lambda r: r.sample_id)  # a row a sample
    y = np.array([r.m.features for r in first], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)

    def run(batches):
        for pdf in batches:
            r = linalg.memberships(linalg.vectors(pdf, y.shape[1]), y)
            yield pdf.assign(share=list(r))[["cell_id", "share"]]

    out = vector_cells(spark, sf).select("cell_id", "features").mapInPandas(run, "cell_id long, share array<double>")
    return _rounded(out.select("cell_id", F.posexplode("share").alias("centroid", "share")), "share")


@query(_NEAREST.replace("QUALIFY rank <= 10", "QUALIFY rank <= 6") + """, g AS (SELECT cell_id, rank, lm_id, dist, greatest(dist - coalesce(min(CASE WHEN dist > 0 THEN dist END) OVER (PARTITION BY cell_id), 0), 0) AS gap, avg(dist) OVER (PARTITION BY cell_id) AS mean FROM nn),
l AS (SELECT cell_id, list(gap) AS gaps, any_value(mean) AS mean FROM g GROUP BY 1),
b AS (SELECT cell_id, gaps, mean, 0.0::DOUBLE AS lo, 4096.0::DOUBLE AS hi, 0 AS i FROM l
      UNION ALL SELECT cell_id, gaps, mean, CASE WHEN list_sum(list_transform(gaps, lambda x: exp(-x / ((lo + hi) / 2)))) > log2(6) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN list_sum(list_transform(gaps, lambda x: exp(-x / ((lo + hi) / 2)))) > log2(6) THEN (lo + hi) / 2 ELSE hi END, i + 1 FROM b WHERE i < 70)
SELECT cell_id, lm_id, round(exp(-gap / greatest((lo + hi) / 2, 1e-3 * b.mean + 1e-12)), 5) AS weight FROM b JOIN g USING (cell_id) WHERE i = 70""")
def fuzzy_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of each cell's six nearest landmarks, that add up to log2 6."""
    return _rounded(_nn(spark, sf, 6).select("cell_id", "lm_id", "weight"), "weight", digits=5)


@query(_NEAREST + """, w AS (SELECT lm_id, sample_id, sum(exp(-dist)) AS raw FROM nn GROUP BY 1, 2), g AS (SELECT lm.cell_id AS lm_id, n.sample_id, n.n / (SELECT avg(n) FROM n) AS size FROM lm, n)
SELECT lm_id, sample_id, round(coalesce(raw, 0), 6) AS raw, round(coalesce(raw, 0) / size, 6) AS norm FROM g LEFT JOIN w USING (lm_id, sample_id)""")
def weighted_density(spark: SparkSession, sf: str) -> DataFrame:
    """A1: sums of weights (a fixed kernel) over samples and landmarks, by size factor."""
    lm = vector_landmarks(spark, sf)
    edges = _nn(spark, sf, lm=lm).withColumn("weight", F.exp(-F.col("dist")))
    out = mapping.density(edges, lm, C.samples(vector_cells(spark, sf), 1))
    return _rounded(out.select("lm_id", "sample_id", "raw", "norm"), "raw", "norm")


@query(_NEAREST + """, v AS (SELECT sample_id, cell_id, lm_label AS label, sum(exp(-dist)) / sum(sum(exp(-dist))) OVER (PARTITION BY cell_id) AS confidence, min(lm_id) AS tie FROM nn GROUP BY 1, 2, 3)
SELECT sample_id, cell_id, CASE WHEN confidence >= 0.4 THEN label ELSE '..low.confidence..' END AS label, round(confidence, 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY confidence DESC, tie, label) = 1""")
def voted_labels(spark: SparkSession, sf: str) -> DataFrame:
    """N13 as the analysis does it: votes of a cell's nested edges, in a map."""
    lm = vector_landmarks(spark, sf)
    nested = neighbors.cell_neighbors(vector_cells(spark, sf), lm, 10, nested=True)
    kernel = nested.withColumn("weights", F.transform("dists", lambda d: F.exp(-d)))
    annot = {r.lm_id: r.label for r in lm.collect()}  # landmarks
    return _rounded(mapping.voted(kernel, annot, 0.4), "confidence")


@query(""", ref AS (SELECT cell_id AS lm_id, features, label FROM vec WHERE cell_id % 3 = 0), q AS (SELECT sample_id, cell_id, features FROM vec WHERE cell_id % 3 <> 0),
k AS (SELECT q.sample_id, q.cell_id, ref.label, list_distance(q.features, ref.features) AS d, lm_id FROM q, ref QUALIFY row_number() OVER (PARTITION BY q.cell_id ORDER BY d, lm_id) <= 7),
k2 AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, lm_id) AS rank FROM k), v AS (SELECT sample_id, cell_id, label, count(*) / 7.0 AS confidence, min(rank) AS tie FROM k2 GROUP BY 1, 2, 3)
SELECT sample_id, cell_id, CASE WHEN confidence >= 0.5 THEN label ELSE '..low.confidence..' END AS label, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY confidence DESC, tie, label) = 1""")
def reference_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels from the seven nearest rows of a labelled reference."""
    cells = vector_cells(spark, sf)
    reference = cells.where("cell_id % 3 = 0").select(F.col("cell_id").alias("lm_id"), "features", "label")
    return _rounded(mapping.reference_labels(cells.where("cell_id % 3 <> 0"), reference, 7), "confidence")


@query(", n AS (SELECT sample_id, count(*) AS n_cells FROM vec GROUP BY 1) SELECT lm.cell_id AS lm_id, sample_id, n_cells FROM lm JOIN n USING (sample_id)")
def landmark_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Landmarks with the columns of their samples."""
    return mapping.expanded(vector_landmarks(spark, sf), C.samples(vector_cells(spark, sf), 1).select("sample_id", "n_cells"))


# graphs and programs


@query(_GRAPH + """, c AS (SELECT label, count(*) AS n FROM lm GROUP BY 1), w AS (SELECT a.label, b.label AS other, sum(weight) AS w FROM j JOIN lm a ON a.cell_id = src JOIN lm b ON b.cell_id = dst GROUP BY 1, 2)
SELECT a.label, b.label AS other, round(CAST(coalesce(w, 0) / (a.n * b.n) AS DOUBLE), 6) AS mean FROM c a CROSS JOIN c b LEFT JOIN w ON w.label = a.label AND w.other = b.label""")
def cluster_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean weight between the landmarks of each two labels."""
    _, ids, labels = _landmark_array(spark, sf)
    names = sorted(set(labels))
    place = {i: k for k, i in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in neighbors.shared_neighbors(_graph(spark, sf), 10).collect():  # edges of landmarks
        w[place[r.src], place[r.dst]] = r.weight
    m = cluster.connectivity(w, np.array([names.index(v) for v in labels]))
    return _frame(spark, [(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names)], "label string, other string, mean double")


@query(", f AS (SELECT label, dense_rank() OVER (ORDER BY min(cell_id)) AS number FROM lm GROUP BY 1) SELECT lm.cell_id AS lm_id, 'cluster.' || lpad(CAST(number AS VARCHAR), 2, '0') AS cluster FROM lm JOIN f USING (label)")
def communities_of_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a graph whose parts are not linked are its parts, named by first appearance."""
    _, ids, labels = _landmark_array(spark, sf)
    w = np.equal.outer(labels, labels).astype(float)
    found = cluster.absorbed(w, cluster.communities(w, 0.8, seed=1), 0)
    return _frame(spark, list(zip(ids, cluster.named(found), strict=True)), "lm_id long, cluster string")


_SCORE = ", t AS (SELECT cell_id, features, features[1] + features[2] + features[3] AS t FROM lm), ft AS (SELECT cell_id, i, features[i] AS x, t FROM t, (SELECT unnest(range(1, 65)) AS i))\n"


@query(_SCORE + "SELECT CAST(i - 1 AS INTEGER) AS feature, round(corr(x, t), 6) + 0.0 AS pearson, round(regr_slope(x, t), 6) + 0.0 AS slope FROM ft GROUP BY 1")
def feature_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of features on a score of the landmarks."""
    x, *_ = _landmark_array(spark, sf)
    t = x[:, :3].sum(1)
    return _rounded(_frame(spark, list(zip(range(x.shape[1]), models.feature_loadings(x, t), models.feature_loadings(x, t, "ols"), strict=True)), "feature int, pearson double, slope double"), "pearson", "slope")


@query(_SCORE + """, r AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY round(x, 1)) + (count(*) OVER (PARTITION BY i, round(x, 1)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY i ORDER BY t) + (count(*) OVER (PARTITION BY i, t) - 1) / 2.0 AS b FROM ft)
SELECT CAST(i - 1 AS INTEGER) AS feature, round(corr(a, b), 6) + 0.0 AS loading FROM r GROUP BY 1""")
def rank_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations, ties shared."""
    lm = vector_landmarks(spark, sf).select("lm_id", F.transform("features", lambda v: F.round(v, 1)).alias("tied"), "features").orderBy("lm_id").collect()  # landmarks
    x, t = np.array([r.tied for r in lm], float), np.array([sum(r.features[:3]) for r in lm])
    return _rounded(_frame(spark, list(enumerate(models.feature_loadings(x, t, "spearman"))), "feature int, loading double"), "loading")


_PLS = _Y + _GRAPH + """, e AS (SELECT lm_id, avg(y) FILTER (g = 1) - avg(y) FILTER (g = 0) AS e FROM y GROUP BY 1), yc AS (SELECT lm_id, e - avg(e) OVER () AS yc FROM e),
deg AS (SELECT src, sum(weight) AS d FROM j GROUP BY 1), p AS (SELECT src, dst, weight / d AS p FROM j JOIN deg USING (src)),
v AS (SELECT dst AS lm_id, sum(p * yc) AS v FROM p JOIN yc ON lm_id = src GROUP BY 1),
x AS (SELECT cell_id AS lm_id, i, features[i] - avg(features[i]) OVER (PARTITION BY i) AS x FROM lm, (SELECT unnest(range(1, 65)) AS i)),
w AS (SELECT i, sum(x * yc * v) AS w FROM x JOIN yc USING (lm_id) JOIN v USING (lm_id) GROUP BY 1), u AS (SELECT i, w / sqrt(sum(w * w) OVER ()) AS w FROM w),
s AS (SELECT lm_id, any_value(yc) * sum(x * w) AS s FROM x JOIN u USING (i) JOIN yc USING (lm_id) GROUP BY 1),
ps AS (SELECT src AS lm_id, sum(p * s) AS t FROM p JOIN s ON s.lm_id = dst GROUP BY 1), t0 AS (SELECT lm_id, t - avg(t) OVER () AS t FROM ps),
sg AS (SELECT CASE WHEN sum(t * yc) < 0 THEN -1 ELSE 1 END AS sg FROM t0 JOIN yc USING (lm_id)), t AS (SELECT lm_id, t * sg AS t FROM t0, sg)
"""


def _programs(spark: SparkSession, sf: str) -> tuple[models.Pls, list]:
    y, _, lm, names = _matrix(spark, sf)
    x, ids, _ = _landmark_array(spark, sf)
    g = np.array(names) % 2 == 1
    place = {i: k for k, i in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in neighbors.shared_neighbors(_graph(spark, sf), 10).collect():  # edges of landmarks
        w[place[r.src], place[r.dst]] = r.weight
    effect = (y[:, g].mean(1) - y[:, ~g].mean(1))[[lm.index(i) for i in ids]]
    return models.graph_pls(models.random_walk(w), effect, x, 1, w_graph=w), ids


@query(_PLS + "SELECT lm_id, round(t, 5) + 0.0 AS score FROM t")
def program_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The first feature program along a group's effect, on features diffused along the landmark graph."""
    made, ids = _programs(spark, sf)
    return _rounded(_frame(spark, list(zip(ids, made.scores[:, 0], strict=True)), "lm_id long, score double"), "score", digits=5)


@query(_PLS + """, z AS (SELECT lm_id, t, t / sqrt(d) AS z FROM t JOIN deg ON src = lm_id), q AS (SELECT sum(j.weight * a.z * b.z) AS q FROM j JOIN z a ON a.lm_id = j.src JOIN z b ON b.lm_id = j.dst), l AS (SELECT (sum(t * t) - any_value(q)) / sum(t * t) AS l FROM z, q)
SELECT 0 AS component, round(1 - least(greatest(l, 0), 2) / 2, 5) AS smoothness FROM l""")
def program_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    """N28 of the program's scores, R11."""
    made, ids = _programs(spark, sf)
    return _rounded(made.diagnostics(spark, made.scores[:, 0]).select("component", "smoothness"), "smoothness", digits=5)


@query(""", r AS (SELECT CAST(sample_id % 3 AS INTEGER) AS k, i, avg(features[i]) AS rot FROM lm, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
c AS (SELECT cell_id AS lm_id, k, features[k + 1] AS c FROM lm, (SELECT unnest([0, 1, 2]) AS k)), top AS (SELECT lm_id, k, sign(c) AS s FROM c QUALIFY row_number() OVER (PARTITION BY lm_id ORDER BY abs(c) DESC, k) = 1)
SELECT lm_id, CAST(row_number() OVER (PARTITION BY lm_id ORDER BY s * round(rot, 9) DESC, i) AS BIGINT) AS rank, CAST(i - 1 AS INTEGER) AS feature FROM top JOIN r USING (k) QUALIFY rank <= 4""")
def dominant_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features of each landmark's leading component."""
    rows = vector_landmarks(spark, sf).orderBy("lm_id").collect()  # landmarks
    x = np.array([r.features for r in rows], float)
    of = np.array([r.sample_id % 3 for r in rows])
    rotation = np.stack([np.round([x[of == k, f].mean() for f in range(x.shape[1])], 9) for k in range(3)], 1)
    found = models.dominant_features(rotation, x[:, :3], list(range(x.shape[1])), 4)
    return _frame(spark, [(int(r.lm_id), k + 1, f) for r, own in zip(rows, found, strict=True) for k, f in enumerate(own)], "lm_id long, rank long, feature int")


@query(""", b AS (SELECT sample_id, feature, CAST(sum(value) AS DOUBLE) AS v FROM assay GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, feature) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM b),
d AS (SELECT a.sample_id, b.feature, a.k, c.v - 2 * b.v + a.v AS d FROM o a JOIN o b ON b.sample_id = a.sample_id AND b.k = a.k + 1 JOIN o c ON c.sample_id = a.sample_id AND c.k = a.k + 2 WHERE a.n >= 4)
SELECT sample_id, feature FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d DESC, k) = 1""")
def elbows(spark: SparkSession, sf: str) -> DataFrame:
    """Where the sorted totals of each sample's features bend most."""
    totals = order_assay(spark, sf).groupBy("sample_id", "feature").agg(F.sum("value").cast("double").alias("v"))

    def run(pdf):
        pdf = pdf.sort_values(["v", "feature"], ascending=[False, True])
        if len(pdf) < 4 or pdf["v"].max() == pdf["v"].min():
            return pdf[["sample_id", "feature"]].iloc[:0]
        return pdf[["sample_id", "feature"]].iloc[[special.elbow(pdf["v"].to_numpy(), smooth=False, descending=True)]]

    return totals.groupBy("sample_id").applyInPandas(run, "sample_id int, feature string")  # a group is one sample's features


# genes


_CHOSEN = """, okey AS (SELECT sample_id, cell_id, -ln(""" + _HASHED.format(seed=123, ids="sample_id || '_' || cell_id") + """) AS key FROM cell), olm AS (SELECT sample_id, cell_id FROM okey QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY key, cell_id) <= 5),
own AS (SELECT a.* FROM assay a JOIN olm USING (sample_id, cell_id)), ot AS (SELECT sample_id, cell_id, sum(value) AS total FROM own GROUP BY 1, 2), om AS (SELECT avg(total) AS mean, count(*) AS n FROM ot),
ov AS (SELECT sample_id, cell_id, feature, log2(value / (total / mean) + 1) AS value FROM own JOIN ot USING (sample_id, cell_id), om),
omo AS (SELECT feature, any_value(n) AS n, sum(value) / any_value(n) AS mean, greatest((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1), 0) AS variance FROM ov, om GROUP BY 1)
"""


def _chosen(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Normalised values of five orders of each nation, and their number."""
    cells = order_cells(spark, sf).select("sample_id", "cell_id", F.lit(1.0).alias("weight"))
    quota = cells.select("sample_id").distinct().withColumn("quota", F.lit(5).cast("long"))
    own = order_assay(spark, sf).join(F.broadcast(C.weighted_sample(cells, quota).select("sample_id", "cell_id")), ["sample_id", "cell_id"])  # five a sample
    total = C.totals(own).agg(F.avg("total").alias("mean"), F.count("*").alias("n")).first()
    return C.log2p1(C.normalised(own, total["mean"])), total["n"]


@query(_CHOSEN + "SELECT feature, round(variance, 6) AS variance, CAST(row_number() OVER (ORDER BY round(variance, 9) DESC, feature) AS BIGINT) AS rank FROM omo QUALIFY rank <= 8")
def variable_over_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """The features that vary most over all landmarks."""
    values, n = _chosen(spark, sf)
    moments = C.feature_moments(values, [], n).withColumn("variance", F.round("variance", 9))
    return C.most_variable(moments, 8, []).select("feature", _r("variance").alias("variance"), F.col("rank").cast("long").alias("rank"))


@query(_CHOSEN + """SELECT sample_id, cell_id, feature, round((coalesce(v.value, 0) - mean) / sqrt(variance), 6) + 0.0 AS value FROM (SELECT DISTINCT sample_id, cell_id FROM ov) CROSS JOIN omo LEFT JOIN ov v USING (sample_id, cell_id, feature) WHERE variance > 0""")
def landmark_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M4 over landmarks: standard scores of all features, absent zeros too."""
    values, n = _chosen(spark, sf)
    return _rounded(C.standardised(values, C.feature_moments(values, [], n), values.select("sample_id", "cell_id")), "value")


_TYPES = ", ty AS (SELECT sample_id, cell_id, p_type AS feature, sum(l_quantity) AS value FROM lineitem JOIN cell ON CAST(l_orderkey AS VARCHAR) = cell_id JOIN part ON l_partkey = p_partkey GROUP BY ALL)\n"


@query(_TYPES + """SELECT status AS label, f.feature, median(coalesce(value, 0)) AS median FROM cell CROSS JOIN (SELECT DISTINCT feature FROM ty) f LEFT JOIN ty USING (sample_id, cell_id, feature) GROUP BY 1, 2""")
def median_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Medians over all cells of a label, absent zeros too."""
    cells = order_cells(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("cell_id"), "l_partkey", "l_quantity").join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    assay = lines.groupBy("cell_id", F.col("p_type").alias("feature")).agg(F.sum("l_quantity").alias("value")).join(cells.select("sample_id", "cell_id"), "cell_id")
    return mapping.median_expression(assay, cells.select("sample_id", "cell_id", F.col("status").alias("label")), zeros=True)


@query("""SELECT sample_id, count(DISTINCT cell_id) AS n_cells, CAST(least(ceil(count(DISTINCT cell_id) * 0.1), ceil(least(sum(count(DISTINCT cell_id)) OVER () * 0.1, 200.0) / count(*) OVER ())) AS BIGINT) AS n_landmarks, count(DISTINCT cell_id) AS labelled
FROM assay GROUP BY 1 HAVING count(DISTINCT cell_id) >= 10""")
def landmark_analysis_counts(spark: SparkSession, sf: str) -> DataFrame:
    """N1, N33 from counts to labels: (sample_id, n_cells, n_landmarks, labelled); all cells are mapped, landmarks keep their quotas."""
    from .pipeline import Analysis, Config

    assay = store.workspace(spark).write(order_assay(spark, sf), "counts")  # read in several passes
    run = Analysis(None, assay.select("sample_id").distinct(), Config(components=5, most_landmarks=200, variable=20, neighbors=10), assay=assay).run()
    taken = _frame(spark, [(s, run.lm_sample.count(s)) for s in sorted(set(run.lm_sample))], "sample_id int, n_landmarks long")
    return run.sizes.select("sample_id", "n_cells").join(taken, "sample_id").join(run.clustering_labels.groupBy("sample_id").agg(F.count("*").alias("labelled")), "sample_id")


# checks


_SIL = ", q AS (SELECT a.cell_id, a.label, b.label AS other, sum(list_distance(a.features, b.features)) AS d, count(*) AS n FROM lm a, lm b GROUP BY 1, 2, 3), s AS (SELECT cell_id, max(CASE WHEN label = other AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM q GROUP BY 1)\n"


@query(_SIL + "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS width FROM s")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Mean silhouette width of the landmarks' labels."""
    x, _, labels = _landmark_array(spark, sf)
    return _rounded(_frame(spark, [(validate.silhouette(x, np.array(labels)),)], "width double"), "width")


@query(_GRAPH + """, e AS (SELECT src, dst FROM g JOIN lm a ON a.cell_id = src JOIN lm b ON b.cell_id = dst WHERE a.label = b.label UNION SELECT dst, src FROM g JOIN lm a ON a.cell_id = src JOIN lm b ON b.cell_id = dst WHERE a.label = b.label),
reach AS (SELECT cell_id AS a, cell_id AS b FROM lm UNION SELECT a, dst FROM reach JOIN e ON src = b), part AS (SELECT a, min(b) AS root FROM reach GROUP BY 1), size AS (SELECT label, root, count(*) AS n FROM part JOIN lm ON cell_id = a GROUP BY 1, 2)
SELECT round(avg(share), 6) AS connected FROM (SELECT max(n) / sum(n)::DOUBLE AS share FROM size GROUP BY label)""")
def connected_share(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each label's landmarks in its largest connected part, on average."""
    _, ids, labels = _landmark_array(spark, sf)
    edges = {(int(r.src), int(r.dst)) for r in _graph(spark, sf).collect()}  # edges of landmarks
    return _rounded(_frame(spark, [(validate.graph_connectivity(edges, dict(zip(ids, labels, strict=True))),)], "connected double"), "connected")


@query(_NEAREST + """, m AS (SELECT label AS t, lm_label AS s FROM nn JOIN vec USING (cell_id) WHERE rank = 1), nm AS (SELECT count(*)::DOUBLE AS n, sum((t = s)::INTEGER)::DOUBLE AS c FROM m),
pt AS (SELECT t AS k, count(*)::DOUBLE AS t FROM m GROUP BY 1), ps AS (SELECT s AS k, count(*)::DOUBLE AS s FROM m GROUP BY 1), b AS (SELECT sum(coalesce(t, 0) * coalesce(s, 0)) AS ts, sum(coalesce(t, 0) * coalesce(t, 0)) AS tt, sum(coalesce(s, 0) * coalesce(s, 0)) AS ss FROM pt FULL JOIN ps USING (k))
SELECT round((n * c - ts) / sqrt((n * n - tt) * (n * n - ss)), 6) AS mcc FROM nm, b""")
def multiclass_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """X3 of many classes: cells' labels against those of their nearest landmarks."""
    lm = vector_landmarks(spark, sf)
    said = _nn(spark, sf, 1, lm).join(lm.select("lm_id", F.col("label").alias("said")), "lm_id")
    pdf = said.join(vector_cells(spark, sf).select("cell_id", "label"), "cell_id").groupBy("label", "said").agg(F.count("*").alias("n")).toPandas()  # pairs of labels
    return _rounded(_frame(spark, [(special.mcc(np.repeat(pdf["label"], pdf["n"]), np.repeat(pdf["said"], pdf["n"])),)], "mcc double"), "mcc")


_PERMUTED = """, y AS (SELECT i AS unit, sample_id, avg(features[i]) AS y FROM vec, (SELECT unnest(range(1, 65)) AS i) WHERE sample_id < 6 GROUP BY 1, 2), pm AS (SELECT a || b AS perm FROM (SELECT unnest(['011', '101', '110']) AS a), (SELECT unnest(['001', '010', '100']) AS b)),
g AS (SELECT perm, unit, y - avg(y) OVER w AS y, CAST(substr(perm, sample_id + 1, 1) AS DOUBLE) - avg(CAST(substr(perm, sample_id + 1, 1) AS DOUBLE)) OVER w AS r FROM pm, y WINDOW w AS (PARTITION BY perm, unit, sample_id // 3)),
m AS (SELECT perm, unit, sum(r * y) / sum(r * r) AS coef, (sum(y * y) - power(sum(r * y), 2) / sum(r * r)) / (count(*) - 3) AS s2, count(*) - 3.0 AS df, 1 / sum(r * r) AS h FROM g GROUP BY 1, 2),
md AS (SELECT perm, greatest(median(s2), 1e-300) * 1e-12 AS floor FROM m GROUP BY 1), z AS (SELECT perm, df, ln(greatest(s2, floor)) AS z FROM m JOIN md USING (perm)), qz AS (SELECT perm, quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.9) AS hi FROM z GROUP BY 1),
e AS (SELECT perm, df, least(greatest(z, lo), hi) - """ + _digamma("(df / 2)") + """ + ln(df / 2) AS e FROM z JOIN qz USING (perm)), pr AS (SELECT perm, any_value(df) AS df, avg(e) AS mean, var_samp(e) - """ + _trigamma("(any_value(df) / 2)") + """ AS spread, count(*) AS units FROM e GROUP BY 1),
bi AS (SELECT perm, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, spread, 0 AS i FROM pr UNION ALL SELECT perm, CASE WHEN """ + _trigamma("exp((lo + hi) / 2)") + """ > spread THEN (lo + hi) / 2 ELSE lo END, CASE WHEN """ + _trigamma("exp((lo + hi) / 2)") + """ > spread THEN hi ELSE (lo + hi) / 2 END, spread, i + 1 FROM bi WHERE i < 90),
d AS (SELECT perm, exp((lo + hi) / 2) AS half FROM bi WHERE i = 90), prior AS (SELECT perm, spread > 0 AS finite, CASE WHEN spread > 0 THEN 2 * half END AS d0, CASE WHEN spread > 0 THEN exp(mean + """ + _digamma("half") + """ - ln(half)) ELSE exp(mean) END AS s0, units FROM pr JOIN d USING (perm)),
post AS (SELECT perm, unit, abs(coef) / sqrt(h * CASE WHEN finite THEN (d0 * s0 + df * s2) / (d0 + df) ELSE s0 END) AS t, CASE WHEN finite THEN least(df + d0, df * units) ELSE df * units END AS nu FROM m JOIN prior USING (perm)),
pv AS (SELECT perm, unit, 1 - 2 * t / 2000 / 3 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(t * i / 2000, 2) / nu, -(nu + 1) / 2))) AS p FROM post),
a AS (SELECT perm, unit, p, count(*) OVER (PARTITION BY perm) * p / row_number() OVER (PARTITION BY perm ORDER BY p, unit) AS a FROM pv), q AS (SELECT perm, least(1.0, min(a) OVER (PARTITION BY perm ORDER BY p, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM a)
"""


@query(_PERMUTED + "SELECT perm, count(*) FILTER (q <= 0.9) AS n_sig, round(min(q), 6) AS min_q FROM q GROUP BY 1")
def permutations(spark: SparkSession, sf: str) -> DataFrame:
    """Refits of all reassignments of groups within batches, the observed one too."""
    means = vector_cells(spark, sf).where("sample_id < 6").select("sample_id", F.posexplode("features").alias("unit", "y")).groupBy("unit", "sample_id").agg(F.avg("y").alias("y")).toPandas()  # features x samples
    y = means.pivot(index="unit", columns="sample_id", values="y").sort_index().sort_index(axis=1).to_numpy()
    group, batch = [0, 1, 1, 0, 0, 1], [0, 0, 0, 1, 1, 1]
    said = ["".join(map(str, g)) for g in (tuple(group), *validate.permuted_labels(group, batch))]
    names = _frame(spark, list(enumerate(said)), "id long, name string")
    got = validate.permutation_test(spark, y, group, batch, cut=0.9).join(F.broadcast(names), F.col("perm") == F.col("id"))  # a row a permutation
    return _rounded(got.select(F.col("name").alias("perm"), "n_sig", "min_q"), "min_q")


# samples, stores and simulations


@query("SELECT sample_id, cell_id FROM vec WHERE label < '6' AND sample_id IN (SELECT sample_id FROM vec WHERE label < '6' GROUP BY 1 HAVING count(*) >= 12)")
def subset_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of an analysis of some labels, small samples dropped."""
    from .pipeline import Analysis, Config

    cells = vector_cells(spark, sf)
    run = Analysis(cells.select("sample_id", "cell_id", "features"), cells.select("sample_id").distinct(), Config(least_cells=12)).setup()
    return run.subset(cells.where("label < '6'"), {"labels": "below 6"}).cells.select("sample_id", "cell_id")


@query("""WITH n AS (SELECT n_nationkey AS sample_id, r_name, n_nationkey % 2 AS g FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT sample_id, term, value FROM (SELECT sample_id, '(Intercept)' AS term, 1.0::DOUBLE AS value FROM n UNION ALL SELECT sample_id, l.r_name, (n.r_name = l.r_name)::INTEGER::DOUBLE FROM n, (SELECT DISTINCT r_name FROM n WHERE r_name > (SELECT min(r_name) FROM n)) l UNION ALL SELECT sample_id, 'x1', g::DOUBLE FROM n)""", views=False)
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A treatment-coded design of a factor and a number, empty columns dropped."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # a row a sample
    x, names = models.model_matrix([r.r_name for r in rows], [r.n_nationkey % 2 for r in rows])
    x = models.used_columns(np.c_[x, np.zeros(len(rows))])
    return _frame(spark, [(r.n_nationkey, names[j], float(x[i, j])) for i, r in enumerate(rows) for j in range(x.shape[1])], "sample_id int, term string, value double")


@query("SELECT cell_id, label FROM vec WHERE sample_id = 3")
def stored_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SK1 to SK4, SC2: a table kept by sample, checked, and one sample of it read."""
    kept = store.workspace(spark)
    kept.write(vector_cells(spark, sf), "cells", ["sample_id"])
    kept.validate()
    return kept.read("cells", 3).select("cell_id", "label")


@query("SELECT sample_id, cell_id, round(features[3], 6) AS a, round(features[1], 6) AS b, round(features[2], 6) AS c FROM vec WHERE sample_id IN (SELECT sample_id FROM vec GROUP BY 1 HAVING count(*) >= 10)")
def loaded_cells(spark: SparkSession, sf: str) -> DataFrame:
    """SC1, SC11: cells of a file with a column for each marker, chosen markers in order."""
    kept = store.workspace(spark)
    wide = vector_cells(spark, sf).select("sample_id", "cell_id", *[F.col("features")[i].alias(f"m{i}") for i in range(5)])
    wide.write.parquet(f"{kept.path}/wide")
    got = store.load_cells(spark, f"{kept.path}/wide", ["m2", "m0", "m1"])
    return got.select("sample_id", "cell_id", *[_r(F.col("features")[i]).alias(n) for i, n in enumerate("abc")])


@query("SELECT sample_id, cell_id, feature, value FROM assay JOIN cell USING (sample_id, cell_id) WHERE status = 'F' AND sample_id IN (SELECT sample_id FROM assay JOIN cell USING (sample_id, cell_id) WHERE status = 'F' GROUP BY 1 HAVING count(DISTINCT cell_id) >= 10)")
def loaded_assay(spark: SparkSession, sf: str) -> DataFrame:
    """SC5, SC8, SC9: the first file there is, matched with the cells' columns, small samples dropped."""
    kept = store.workspace(spark)
    order_assay(spark, sf).write.parquet(f"{kept.path}/counts")
    got, _ = store.load_assay(spark, [f"{kept.path}/none", f"{kept.path}/counts"], order_cells(spark, sf).where("status = 'F'").select("sample_id", "cell_id", "status"))
    return got


@query("SELECT cell_id AS lm_id, label AS types, 'cluster.' || label AS clusters, label AS active FROM lm")
def exported_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SK7: the rows of an export, a column for each labelling."""
    lm = vector_landmarks(spark, sf)
    solutions = {"types": lm.select("lm_id", "label"), "clusters": lm.select("lm_id", F.concat(F.lit("cluster."), "label").alias("label"))}
    return store.export(store.workspace(spark), _density(spark, sf), solutions, "types", _samples(spark, sf)).read("rows")


def _u(seed: int, ids: str = "id") -> str:
    return _HASHED.format(seed=seed, ids=ids)


def _noise(m: int) -> str:
    return f"sqrt(-2 * ln({_u(42 + 10 * m)})) * cos(2 * 3.141592653589793 * {_u(43 + 10 * m)}) * 0.5"


@query("WITH i AS (SELECT range AS id, CAST(range // 15 AS INTEGER) AS s FROM range(180)), p AS (SELECT *, [0.005, 0.05, 0.5][s // 4 + 1] AS setting, s // 2 % 2 AS g, s % 2 AS b FROM i), t AS (SELECT *, " + _u(42) + " < setting * CASE g WHEN 1 THEN 0.5 ELSE 1.0 END AS hit FROM p)\nSELECT 'sample' || lpad(CAST(s AS VARCHAR), 2, '0') AS sample_id, 'cell' || id AS cell_id, CASE WHEN hit THEN 'target' ELSE 'other' END AS cell_type, CASE g WHEN 1 THEN 'depleted' ELSE 'control' END AS treatment, 'batch' || (b + 1) AS batch, round(CASE WHEN hit THEN 2.0 ELSE 0.0 END + " + _noise(0) + " + b * 0.2, 6) AS first, round(" + _noise(4) + " + b * 0.2, 6) AS last FROM t", views=False)
def simulated_abundance(spark: SparkSession, sf: str) -> DataFrame:
    """SC14: simulated cells of which a target population is rarer in one group."""
    out = store.simulate_abundance(spark, cells=15, per_group=2)
    return out.select("sample_id", "cell_id", "cell_type", "treatment", "batch", _r(F.col("features")[0]).alias("first"), _r(F.col("features")[4]).alias("last"))


@query("WITH i AS (SELECT range AS id, CAST(range // 40 AS INTEGER) AS s FROM range(480)), p AS (SELECT *, [0.5, 1.0, 2.0][s // 4 + 1] AS shift, s // 2 % 2 AS g, " + _u(42) + " < 0.05 AS hit FROM i)\nSELECT 'sample' || lpad(CAST(s AS VARCHAR), 2, '0') AS sample_id, 'cell' || id AS cell_id, CASE WHEN hit THEN 'target' ELSE 'other' END AS cell_type, CASE g WHEN 1 THEN 'activated' ELSE 'control' END AS treatment, round(CASE WHEN hit AND g = 1 THEN shift * 0.5 ELSE 0.0 END + " + _noise(1) + ", 6) AS second FROM p", views=False)
def simulated_expression(spark: SparkSession, sf: str) -> DataFrame:
    """SC15: simulated cells of which a target population shifts in one marker."""
    out = store.simulate_expression(spark, cells=40, per_group=2)
    return out.select("sample_id", "cell_id", "cell_type", "treatment", _r(F.col("features")[1]).alias("second"))


@query("WITH i AS (SELECT range AS id, CAST(floor(" + _u(1, "range") + " * 10) AS INTEGER) AS stage, " + _u(2, "range") + " AS u, 'R' || CAST(floor(" + _u(3, "range") + " * 3) + 1 AS INTEGER) AS replicate FROM range(1000))\nSELECT 'cell' || id AS cell_id, stage, replicate, CASE WHEN u < [" + ", ".join(str(x) for x in store.STAGES) + "][stage + 1] THEN 'A' ELSE 'B' END || '_' || replicate AS sample_id FROM i", views=False)
def trajectory_cells(spark: SparkSession, sf: str) -> DataFrame:
    """SC16: cells along a path, at each stage of which one condition has its own share."""
    return store.trajectory_cells(spark, 1000).select("cell_id", "stage", "replicate", "sample_id")


# reports


@query(_P + """, b AS (SELECT unit, term, p, count(*) OVER (PARTITION BY term) * p / row_number() OVER (PARTITION BY term ORDER BY p, unit) AS a FROM p),
lam AS (SELECT term, median(share) AS pi0 FROM (SELECT term, l, count(*) FILTER (p >= 0.1 + 0.05 * l) / count(*)::DOUBLE / (1 - (0.1 + 0.05 * l)) AS share FROM p, (SELECT unnest(range(0, 15)) AS l) GROUP BY 1, 2) GROUP BY 1)
SELECT unit, term, round(least(1.0, least(greatest(pi0, 0), 1) * least(1.0, min(a) OVER (PARTITION BY term ORDER BY p, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) AS q FROM b JOIN lam USING (term)""")
def null_share_q(spark: SparkSession, sf: str) -> DataFrame:
    """N19's middle case: q-values with the share of true nulls."""
    p = order_assay(spark, sf).select(F.col("feature").alias("unit"), F.col("sample_id").alias("term")).distinct().withColumn("p", X.u01(7, F.col("unit"), F.col("term")))
    out = p.groupBy("term").applyInPandas(lambda pdf: pdf.assign(q=special.storey(pdf["p"].to_numpy())), "unit string, term int, p double, q double")  # a term's units: features
    return _rounded(out.select("unit", "term", "q"), "q")


@query(", e AS (SELECT sample_id, avg(features[1]) AS a, avg(features[2]) AS b FROM vec GROUP BY 1) SELECT sample_id, CASE sample_id % 2 WHEN 1 THEN 'odd' ELSE 'even' END AS side, round(a, 6) + 0.0 AS x, round(b, 6) + 0.0 AS y FROM e")
def sample_plot(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of samples with their columns, as a scatter."""
    embed = vector_cells(spark, sf).groupBy("sample_id").agg(F.avg(F.col("features")[0]).alias("a"), F.avg(F.col("features")[1]).alias("b"))
    joined = report.sample_embedding(embed, _samples(spark, sf))
    return _rounded(joined.select("sample_id", "side").join(report.scatter(joined, "a", "b", "sample_id"), F.col("color") == F.col("sample_id")).drop("color"), "x", "y")


@query(""", l AS (SELECT CAST(i - 1 AS INTEGER) AS feature, round(avg(features[i]), 9) AS loading FROM lm, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY loading DESC, feature) AS up, row_number() OVER (ORDER BY loading, feature) AS down FROM l),
top AS (SELECT feature FROM k WHERE (loading > 0 AND up <= 3) OR (loading < 0 AND down <= 3)), o AS (SELECT cell_id AS lm_id, features, row_number() OVER (ORDER BY features[1], cell_id) AS place FROM lm)
SELECT feature, lm_id, place, round(features[feature + 1] - avg(features[feature + 1]) OVER (PARTITION BY feature), 6) + 0.0 AS value FROM o CROSS JOIN top""")
def program_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """The extreme features of a program over landmarks in the order of a score."""
    lm = vector_landmarks(spark, sf)
    expr = lm.select("lm_id", F.posexplode("features").alias("feature", "value"))
    loadings = expr.groupBy("feature").agg(F.round(F.avg("value"), 9).alias("loading")).withColumn("component", F.lit(0))
    out = report.program_heatmap(expr, loadings, lm.select("lm_id", F.col("features")[0].alias("score")), "score", 6)
    return _rounded(out.withColumn("place", F.col("place").cast("long")), "value")


@query(", n AS (SELECT count(*) AS n FROM vec) SELECT sample_id, count(*) AS n_cells, any_value(n) AS total FROM vec, n GROUP BY 1")
def converted_once(spark: SparkSession, sf: str) -> DataFrame:
    """SC10: a table is converted once, then what was kept is read."""
    kept = store.workspace(spark)
    first = kept.cached("cells", lambda: vector_cells(spark, sf))
    again = kept.cached("cells", lambda: first.limit(0))
    return again.groupBy("sample_id").agg(F.count("*").alias("n_cells")).crossJoin(F.broadcast(first.agg(F.count("*").alias("total"))))  # one row


@query("SELECT 'cells' AS name, count(*) AS rows FROM vec UNION ALL SELECT 'samples', count(DISTINCT sample_id) FROM vec")
def stored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """SK5: the tables that are kept, one of them written twice, and their rows."""
    kept = store.workspace(spark)
    cells = vector_cells(spark, sf)
    kept.write(cells.limit(1), "cells")
    kept.write(cells, "cells")
    kept.write(cells.select("sample_id").distinct(), "samples")
    return _frame(spark, [(t["name"], t["rows"]) for t in kept.info()], "name string, rows long")


@query("SELECT 'label' AS name, cell_id AS lm_id, label FROM lm")
def imported_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The text columns that can label cells become labellings of the landmarks."""
    from ..operators import annotate

    meta = vector_cells(spark, sf).select("sample_id", "cell_id", "label", F.concat(F.lit("s"), "sample_id").alias("batch"), F.concat(F.lit("c"), "cell_id").alias("barcode"))
    lm = vector_landmarks(spark, sf).select("lm_id", "sample_id", F.col("lm_id").alias("cell_id"))
    made = [t.select(F.lit(name).alias("name"), "lm_id", "label") for name, t in annotate.imported(lm, meta).items()]
    return reduce(DataFrame.unionByName, made)
