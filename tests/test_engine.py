import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loamgrid.functions.columns import LOW_CONFIDENCE
from loamgrid.operators import annotate, cells as C, linalg, mapping, validate
from loamgrid.plans import numeric, queries  # noqa: F401  (both register their queries)
from loamgrid.plans.pipeline import Analysis, Config
from loamgrid.plans.registry import ORACLES
from loamgrid.sources.store import Store, checked_cells, simulate_abundance

SF = "/root/testdata/sf0.001"
NAMES = list(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert cols == sorted(names)
    rows = sorted(tuple(repr(r[c]) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(repr(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fuzzy_votes_golden(spark):
    edges = spark.createDataFrame([("s", str(i), lm, w) for i, ws in enumerate([[0.8, 0.2], [0.4, 0.6], [0.49, 0.51]]) for lm, w in enumerate(ws)], "sample_id string, cell_id string, lm_id int, weight double")
    annot = spark.createDataFrame([(0, "A"), (1, "B"), (2, "B")], "lm_id int, label string")
    cells = edges.select("sample_id", "cell_id").distinct()
    got = lambda thr: [r.label for r in mapping.transferred(mapping.fuzzy_votes(edges, annot), cells, thr).orderBy("cell_id").collect()]
    assert got(0.6) == ["A", "B", LOW_CONFIDENCE]
    assert got(0.0) == ["A", "B", "B"]
    assert got(1.0) == [LOW_CONFIDENCE] * 3
    with pytest.raises(ValueError):
        got(1.5)


def test_cells_without_edges_have_low_confidence(spark):
    cells = spark.createDataFrame([("s", "a")], "sample_id string, cell_id string")
    none = spark.createDataFrame([], "sample_id string, cell_id string, label string, vote double, tie int")
    assert mapping.transferred(none, cells).first().label == LOW_CONFIDENCE


def test_sample_columns_count_nulls(spark):
    meta = spark.createDataFrame([("s1", "x", "u"), ("s1", None, "u"), ("s2", "y", None), ("s2", "y", None)], "sample_id string, a string, b string")
    assert C.sample_level_columns(meta) == ["b"]


def test_annotation_columns(spark):
    rows = [(f"s{i % 2}", f"c{i}", "T" if i % 3 else "B", f"s{i % 2}", "human", float(i)) for i in range(12)]
    meta = spark.createDataFrame(rows, "sample_id string, cell_id string, l1 string, batch string, species string, depth double")
    assert C.annotation_columns(meta) == ["l1"]


def test_celltypes_must_cover(spark):
    annot = spark.createDataFrame([(0, "c1"), (1, "c2")], "lm_id int, label string")
    assert annotate.from_clusters(annot, {"T": ["c1"], "B": ["c2"]}).count() == 2
    with pytest.raises(ValueError):
        annotate.from_clusters(annot, {"T": ["c1"]})


def test_pipeline_invariants(spark):
    cells = simulate_abundance(spark, cells=120, per_group=2, shares=(0.3,))
    meta = cells.select("sample_id", "treatment", "batch").distinct()
    run = Analysis(cells.select("sample_id", "cell_id", "features"), meta, Config(neighbors=10)).run()
    log, norm, names = run.matrix()
    assert log.shape == (len(run.lm_raw), 4) == norm.shape
    assert np.allclose(log, np.log2(norm + 0.5)) and (norm >= 0).all() and (norm.sum(0) > 0).all()
    perc = run.clustering_composition.groupBy("sample_id").agg(F.sum("perc").alias("p")).toPandas()["p"]
    assert np.allclose(perc, 100, atol=1e-8)
    assert run.edges.groupBy("sample_id", "cell_id").count().agg(F.max("count")).first()[0] == 10
    again = Analysis(cells.select("sample_id", "cell_id", "features").orderBy(F.desc("cell_id")), meta, Config(neighbors=10)).setup().landmarks()
    assert again.lm_cell == run.lm_cell  # whatever the order of cells
    fit = run.lm_fit(np.c_[np.ones(4), [0, 0, 1, 1]])
    assert fit.p.shape == (len(log), 2)
    part = run.subset(run.clustering_labels.where(F.col("label") != LOW_CONFIDENCE), {"by": "label"})
    assert part.provenance == [{"by": "label"}] and part.cells.count() <= cells.count()


def test_pipeline_with_batches(spark):
    cells = simulate_abundance(spark, cells=100, per_group=2, shares=(0.3,))
    meta = cells.select("sample_id", "batch").distinct()
    run = Analysis(cells.select("sample_id", "cell_id", "features"), meta, Config(neighbors=10, batch="batch")).run()
    assert np.isfinite(run.matrix()[0]).all()


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, x int")
    assert store.write(df, "t", ["sample_id"]).count() == 2
    assert store.read("t", "a").count() == 1
    store.validate()
    assert store.info()[0]["rows"] == 2
    with pytest.raises(FileNotFoundError):
        store.read("missing")
    store.cleanup()
    assert store.names() == []


def test_unknown_markers_get_hints(spark):
    wide = spark.createDataFrame([("s", "c", 1.0, 2.0, 3.0)], "sample_id string, cell_id string, CD3 double, CD4 double, CD8 double")
    assert checked_cells(wide).count() == 1
    with pytest.raises(ValueError, match="CD3"):
        checked_cells(wide, ["CD3", "CD4", "CD33"])


def test_permutation_test_counts(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(40, 8))
    y[:5, 4:] += 8
    truth = np.arange(40) < 5
    got = validate.permutation_test(spark, y, ["A"] * 4 + ["B"] * 4, [1, 1, 2, 2, 1, 1, 2, 2], truth).toPandas().set_index("perm")
    assert len(got) == 36 and got.loc[0, "n_sig"] >= 5 and got.loc[0, "mcc"] > 0.8


def test_leverage_is_the_diagonal_of_the_hat_matrix(spark):
    rng = np.random.default_rng(3)
    x = {s: rng.normal(size=(30, 4)) * [1, 5, 0.1, 2] + k for k, s in enumerate("ab")}
    cells = spark.createDataFrame([(s, i, row.tolist()) for s, m in x.items() for i, row in enumerate(m)], "sample_id string, cell_id int, features array<double>")
    got = {(r.sample_id, r.cell_id): r.weight for r in linalg.leverage(cells).collect()}
    for s, m in x.items():
        z = m - m.mean(0)
        hat = np.diag(z @ np.linalg.inv(z.T @ z) @ z.T)
        assert np.allclose([got[s, i] for i in range(30)], hat)
