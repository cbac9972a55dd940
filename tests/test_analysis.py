"""The analysis end to end, and the numerical operators that no SQL follows, against planted structure, invariants and plain forms."""

import warnings

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions.special import bh, storey
from loamgrid.operators import cells as C, cluster, expression, layout, linalg, mapping, models, neighbors, report
from loamgrid.plans.pipeline import Analysis, Config, analysis_of
from loamgrid.sources import store


def blobs(spark, samples=6, cells=60, seed=3):
    """Cells of two groups of three samples; the second blob is rarer in the second group. Two labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(samples):
        for i in range(cells):
            second = rng.random() < (0.2 if s % 2 else 0.6)
            rows.append((f"s{s}", f"c{i}", [float(v) for v in rng.normal(4.0 * second, 0.5, 5)], "two" if second else "one"))
    return spark.createDataFrame(rows, "sample_id string, cell_id string, features array<double>, label string")


def counts(spark, samples=4, cells=40, genes=60, seed=5):
    """Counts of two kinds of cells: half of the genes are high in one kind, the others in the other. Ids repeat across samples."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(samples):
        for i in range(cells):
            kind = rng.random() < (0.7 if s % 2 else 0.3)
            mean = np.where((np.arange(genes) < genes // 2) == kind, 8.0, 1.0)
            rows += [(f"s{s}", f"c{i}", ("MT-ND1" if g == 0 else f"gene{g:02d}"), float(v)) for g, v in enumerate(rng.poisson(mean)) if v]
    return spark.createDataFrame(rows, "sample_id string, cell_id string, feature string, value double")


@pytest.fixture(scope="module")
def run(spark):
    cells = blobs(spark).cache()
    samples = cells.select("sample_id").distinct().withColumn("group", F.when(F.col("sample_id").isin("s1", "s3", "s5"), "b").otherwise("a"))
    made = Analysis(cells.select("sample_id", "cell_id", "features"), samples, Config(components=4, neighbors=8, share=0.2, resolution=30.0)).run()
    lm = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(zip(made.lm_sample, made.lm_cell, strict=True))], "lm_id int, sample_id string, cell_id string")
    typed = lm.join(cells.select("sample_id", "cell_id", "label"), ["sample_id", "cell_id"]).select("lm_id", "label")
    made.celltypes(typed, "known").refresh()
    made.truth = cells
    return made


@pytest.fixture(scope="module")
def counted(spark):
    assay = counts(spark).cache()
    return Analysis(None, assay.select("sample_id").distinct(), Config(components=5, neighbors=6, share=0.2, variable=30, force_in=("MT-ND1",)), assay=assay).run()


DESIGN = np.c_[np.ones(6), [s % 2 for s in range(6)]]


def test_cell_types_reach_nearly_all_cells(run):
    got = run.celltyping_labels.join(run.truth.withColumnRenamed("label", "truth"), ["sample_id", "cell_id"])
    assert got.where("label = truth").count() > 0.97 * got.count() == 0.97 * 360


def test_density_and_composition_find_the_rarer_population(run):
    fit = run.lm_fit(DESIGN, np.array([[0.0], [1.0]]))
    types = {r.lm_id: r.label for r in run.typing.current().collect()}
    two = np.array([types[i] == "two" for i in range(len(types))])
    assert (fit.coef[two, 0] < 0).mean() > 0.9 and fit.coef[~two, 0].mean() > 0
    assert fit.density_q.shape == fit.component_q.shape == fit.coef.shape and np.nanmin(fit.component_q) >= 0
    made, names = fit.composition["celltyping"]
    assert made.coef[names.index("two"), 0] < 0 < made.coef[names.index("one"), 0] and made.p[names.index("two"), 0] < 0.05
    assert run.lm_fit(DESIGN, np.array([[0.0], [1.0]])) is fit  # kept by name
    assert run.lm_fit(DESIGN, np.array([[0.0], [1.0]]), again=True) is not fit


def test_votes_in_a_map_are_those_of_the_joins(run):
    annot = run.typing.current()
    slow = mapping.transferred(mapping.fuzzy_votes(run.edges, annot), run.cells, 0.5)
    fast = mapping.voted(run.cell_edges, {r.lm_id: r.label for r in annot.collect()}, 0.5)
    both = slow.join(fast.select("sample_id", "cell_id", F.col("label").alias("l"), F.col("confidence").alias("c")), ["sample_id", "cell_id"])
    assert both.count() == 360 and both.where("l <> label or abs(c - confidence) > 1e-9").count() == 0


def test_feature_programs(run):
    fit = run.lm_fit(DESIGN, name="full")
    made = run.pls_programs(1, "full", components=2)
    assert made.scores.shape[1] == len(made.smooth) >= 1 and (made.smooth > 0.5).all() and (made.smooth <= 1).all()
    assert np.corrcoef(made.scores[:, 0], fit.coef[:, 1])[0, 1] > 0.5 and made.concordance.shape == (5, made.scores.shape[1])
    spark = run.cells.sparkSession
    assert [r.component for r in made.diagnostics(spark, fit.coef[:, 1]).collect()] == list(range(len(made.smooth)))
    assert made.table(spark, fit.coef[:, 1]).count() == made.scores.size
    with pytest.raises(ValueError, match="no fit"):
        run.pls_programs(1, "other")
    plain = run.pls_programs(1, "full", components=1, design=DESIGN[:, :1], block=["x", "y", "x", "y", "x", "y"])
    assert plain.scores.shape[1] == 1


def test_nuisance_columns_are_taken_out(run):
    z = models.nuisance(DESIGN, ["x", "x", "y", "y", "z", "z"])
    assert z.shape == (6, 5)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)), rng.normal(size=40)
    batch = np.repeat([[1.0, 0.0], [0.0, 1.0]], 20, axis=0)
    shifted = x + 50 * batch[:, :1]
    p = models.random_walk(np.ones((40, 40)) + 20 * np.eye(40))
    a, b = models.graph_pls(p, y, x, 1, nuisance=batch), models.graph_pls(p, y, shifted, 1, nuisance=np.c_[np.ones(40), batch])
    assert np.allclose(a.scores, b.scores)


def test_marker_mode_and_design_mode_of_features(run):
    got = run.pb_de(labels=["two"], result="marker")
    assert (got.fit.coef[:, 0] > 3).all() and (got.fit.q < 0.01).all() and run.pb_de(labels=["two"], result="marker") is got
    assert np.allclose(run.pb_de(labels=["two"], against=["one"], result="both").fit.coef, got.fit.coef, atol=0.1)
    design = run.pb_de(design=DESIGN, contrasts=np.array([[0.0], [1.0]]))
    assert (design.fit.coef[:, 0] < 0).all() and design.samples == [f"s{i}" for i in range(6)]
    landmarks = [i for i, t in {r.lm_id: r.label for r in run.typing.current().collect()}.items() if t == "two"]
    assert np.allclose(run.pb_de(landmarks=landmarks, result="lm").fit.coef, got.fit.coef, atol=0.1)
    for bad in ({}, {"design": DESIGN, "against": ["one"]}, {"labels": ["one"], "landmarks": [1]}):
        with pytest.raises(ValueError):
            run.pb_de(**bad)


def test_outlier_samples_and_empty_columns_are_left_out(spark):
    rows = [(s, f"c{i}", f, float(s % 2 * (f == "g1") + i % 3)) for s in range(6) for i in range(40 if s < 5 else 1) for f in ("g0", "g1", "g2")]
    assay = spark.createDataFrame(rows, "sample_id int, cell_id string, feature string, value double")
    weights = assay.select("sample_id", "cell_id").distinct().withColumn("weight", F.lit(1.0))
    design = np.c_[np.ones(6), [s % 2 for s in range(6)], [s == 5 for s in range(6)]]
    got = expression.design_mode(assay, weights, list(range(6)), design, counts=False)
    assert got.dropped_samples == [5] and got.design.shape == (5, 2) and abs(got.fit.coef[1, 1] - 1) < 1e-9
    with pytest.raises(ValueError, match="too few"):
        expression.design_mode(assay, weights, list(range(6)), design, np.array([[0.0], [0.0], [1.0]]), counts=False)


def test_embedding_and_subset(run):
    e = run.effect(full=DESIGN, reduced=DESIGN[:, :1])
    c = run.effect(design=DESIGN, contrast=np.array([0.0, 1.0]))
    assert e.rank == c.rank == 1 and np.allclose(np.abs(e.coord), np.abs(c.coord))
    sub = run.subset(run.truth.where("label = 'two'"), {"labels": "two"})
    assert sub.cells.count() == run.truth.where("label = 'two'").count() and sub.provenance == [{"labels": "two"}] and not sub.results


def test_layout_keeps_neighbours_together(run):
    run.layout(100)
    at, _ = neighbors.nearest(run.lm_layout, run.lm_layout, 6)
    types = {r.lm_id: r.label for r in run.typing.current().collect()}
    label = np.array([types[i] for i in range(len(types))])
    assert run.lm_layout.shape == (len(label), 2) and np.isfinite(run.lm_layout).all()
    assert (label[at[:, 1:]] == label[:, None]).mean() > 0.9
    assert np.array_equal(layout.two_dimensional(run.fuzzy, run.lm_coord[:, :2], 100, 123), run.lm_layout)
    assert layout.two_dimensional(np.zeros((3, 3)), np.zeros((3, 1))).shape == (3, 2)


def test_save_and_load(run, tmp_path):
    kept = store.Store(run.cells.sparkSession, str(tmp_path / "kept"))
    run.save(kept)
    back = Analysis.load(kept)
    assert back.typing.active == "known" and back.clustering.active == run.clustering.active and back.config == run.config
    a, b = run.matrix(), back.matrix()
    assert np.allclose(a[0], b[0]) and a[2] == b[2]
    assert sorted(map(str, back.celltyping_labels.collect())) == sorted(map(str, run.celltyping_labels.collect()))
    back.embed()
    fresh = Analysis(run.truth.select("sample_id", "cell_id", "features"), run.samples, run.config).setup().map_to(back)
    got = fresh.reference_labels.join(run.truth.withColumnRenamed("label", "truth"), ["sample_id", "cell_id"])
    assert got.where("label = truth").count() > 0.97 * 360


def test_relabelling_makes_what_followed_stale(run):
    before, names = run.clustering.active, run.clustering.names()
    run.cluster(0.5, name="coarse")
    assert run.clustering.active == "coarse" and run.clustering.names() == [*names, "coarse"] and run.clustering.stale == ["labels", "composition", "trad"]
    with pytest.warns(UserWarning, match="made under"):
        run.pb_de(labels=["two"], result="marker")
    run.refresh()
    assert run.slot("clustering_labels", "s1").count() == 60 and run.slot("density").count() == 6 * len(run.lm_coord)
    with pytest.raises(ValueError, match="no table"):
        run.slot("pca")
    assert run.clustering.stale == ["trad"] and run.clustering_composition.groupBy("sample_id").agg(F.sum("count").alias("n")).where("n = 60").count() == 6
    run.clustering.activate(before)
    run.refresh()
    with pytest.raises(ValueError, match="no such"):
        run.clustering.activate("none")


def test_annotations_are_imported(run):
    meta = run.truth.select("sample_id", "cell_id", "label", F.when(F.col("label") == "two", F.lit("T")).alias("other"), F.concat("sample_id", F.lit("x")).alias("batch"), F.concat("sample_id", "cell_id").alias("barcode"))
    run.import_annotations(meta.withColumn("other", F.coalesce("other", F.when(F.col("cell_id") == "c1", F.lit("U")))))
    assert run.typing.names() == ["known", "label", "other"] and run.typing.active == "other"
    assert {r.label for r in run.typing.current().collect()} >= {"T", "unknown"}
    with pytest.raises(ValueError, match="batch"):
        run.import_annotations(meta, ["batch"])
    run.typing.activate("known")
    run.refresh()


def test_made_up_ids(spark, tmp_path):
    blobs(spark, 2, 20).drop("cell_id", "label").write.parquet(str(tmp_path / "c"))
    got = store.load_cells(spark, str(tmp_path / "c"))
    assert got.select("sample_id", "cell_id").distinct().count() == 40 and got.first().cell_id.startswith(got.first().sample_id + "_event_")


def test_export(run, tmp_path):
    kept = store.export(store.Store(run.cells.sparkSession, str(tmp_path / "out")), run.density, {"known": run.typing.current()}, "known", run.samples)
    assert kept.names() == ["assays", "columns", "rows"] and kept.read("assays").count() == len(run.lm_coord) * 6
    assert kept.read("rows").where("known = active").count() == len(run.lm_coord)


# counts


def test_counts_from_landmarks_to_labels(counted):
    assert counted.genes.names[0] == "MT-ND1" and len(counted.genes.names) == 30  # forced in though excluded otherwise
    assert counted.lm_raw.shape == counted.lm_expr.shape == counted.lm_scaled.shape == (len(counted.lm_cell), 30)
    assert counted.clustering_labels.count() == 160 and counted.density.groupBy("sample_id").count().count() == 4
    total = counted.edges.groupBy("sample_id", "cell_id").agg(F.sum("weight").alias("w"))
    assert total.count() == 160 and total.where("w <= 0").count() == 0
    log, *_ = counted.matrix()
    assert np.isfinite(log).all() and counted.sample_pca.coord.shape[0] == 4


def test_pass_two_sees_landmark_normalised_values(counted):
    rows, dense = counted._rows(counted.genes)
    got = dense(rows.where("sample_id = 's0' and cell_id = 'c3'").toPandas())[0]
    raw = {r.feature: r.value for r in counted.assay.where("sample_id = 's0' and cell_id = 'c3'").collect()}
    total = sum(raw.values())
    assert got.tolist() == pytest.approx([np.log2(raw.get(f, 0.0) / (total / counted.genes.mean_total) + 1) for f in counted.genes.names])


def test_rows_of_counts_have_the_moments_of_the_assay(counted):
    got = linalg.count_moments(counted.rows, counted.mean_total, len(counted.feature_names)).collect()
    want = {(r.sample_id, r.feature): (r.n, r.mean, r.variance) for r in C.feature_moments(C.log2p1(C.normalised(counted.assay, with_cells=True)).withColumnRenamed("n_cells", "n_cells")).collect()}
    assert {(r.sample_id, counted.feature_names[r.feature]): pytest.approx((r.n, r.mean, r.variance)) for r in got} == want
    top = C.most_variable(C.feature_moments(C.without_excluded(C.log2p1(C.normalised(counted.assay.join(counted.lm.select("sample_id", "cell_id"), ["sample_id", "cell_id"]), counted.genes.mean_total)), ["MT-ND1"]), [], len(counted.lm_cell)), 30, [], ["MT-ND1"])
    assert [r.feature for r in top.orderBy("rank").collect()] == counted.genes.names


def test_cells_without_counts_are_kept(spark):
    assay = counts(spark, 2, 15, 12)
    cells = assay.select("sample_id", "cell_id").distinct().unionByName(spark.createDataFrame([("s0", "empty")], "sample_id string, cell_id string"))
    run = Analysis(cells, assay.select("sample_id").distinct(), Config(components=3, neighbors=4, share=0.3, variable=10, exclude=False), assay=assay).run()
    assert run.clustering_labels.count() == 31 and run.sizes.where("n_cells = 16").count() == 1


def test_count_models(counted):
    first = [g for g in counted.genes.names if g.startswith("gene") and int(g[4:]) < 30]
    design = np.c_[np.ones(4), [s % 2 for s in range(4)]]
    got = counted.pb_de(design=design, contrasts=np.array([[0.0], [1.0]]), sets={"high": first, "none": ["x"]})
    high = np.array([f == "MT-ND1" or int(f[4:]) < 30 for f in got.features])
    assert got.fit.coef[high, 0].mean() > 0.3 > -0.3 > got.fit.coef[~high, 0].mean() and got.set_names == ["high"] and got.sets.coef[0, 0] > 0
    assert (got.fit.q[:, 0] < 0.05).mean() > 0.5


def test_counts_are_checked(spark):
    assay = counts(spark, 2, 12, 10)
    with pytest.raises(ValueError, match="components"):
        Analysis(None, assay.select("sample_id").distinct(), Config(components=30), assay=assay).setup()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        Analysis(None, assay.select("sample_id").distinct(), Config(components=3, force_in=("no such",)), assay=assay).setup()
    assert any("no such" in str(w.message) for w in said)


def test_dispatch(spark, tmp_path):
    wide = blobs(spark, 2, 15).select("sample_id", "cell_id", *[F.col("features")[i].alias(f"m{i}") for i in range(5)], F.substring("sample_id", 2, 1).alias("side"))
    wide.write.parquet(str(tmp_path / "w"))
    got = analysis_of(str(tmp_path / "w"), config=Config(components=3), spark=spark)
    assert got.assay is None and got.setup().samples.columns[:2] == ["sample_id", "side"] and len(got.cells.first().features) == 5
    assert analysis_of(counts(spark, 2, 12, 10)).assay is not None
    with pytest.raises(TypeError):
        analysis_of(3)
    with pytest.warns(UserWarning, match="colour"):
        analysis_of(wide, colour=1)


def test_sparse_leverage_is_that_of_dense_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 12)) * (rng.random((90, 12)) < 0.6)
    rows = [(i % 2, i, [int(k) for k in np.flatnonzero(v)], [float(w) for w in v[v != 0]], [float(w) for w in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id int, cell_id int, at array<int>, x array<double>, features array<double>")
    dense = {r.cell_id: r.weight for r in linalg.leverage(df.select("sample_id", "cell_id", "features"), 3).collect()}
    sparse = {r.cell_id: r.weight for r in linalg.leverage(df.drop("features"), 3, 12).collect()}
    assert dense == pytest.approx(sparse)
    monkeypatch.setattr(linalg, "GRAM", 4)  # more features: block power iteration
    close = {r.cell_id: r.weight for r in linalg.leverage(df.drop("features"), 3, 12, rounds=40).collect()}
    assert dense == pytest.approx(close, abs=1e-4)
    model = linalg.pca(x, 4)
    z = ((x - model.center) / model.scale @ model.rotation / model.d) ** 2
    got = {r.cell_id: r.weight for r in linalg.projected_leverage(df.drop("features"), model).collect()}
    assert got == pytest.approx({i: v for i, v in enumerate(z.sum(1))})


# numerical operators


@pytest.mark.parametrize("nested", [False, True])
def test_many_landmarks_go_by_blocks(spark, monkeypatch, nested):
    cells = blobs(spark, 2, 30)
    lm = cells.select(F.row_number().over(Window.orderBy("sample_id", "cell_id")).alias("lm_id"), "features")
    want = neighbors.cell_neighbors(cells, lm, 5, nested=nested).collect()
    monkeypatch.setattr(neighbors, "MOST_LANDMARKS", 25)
    got = neighbors.cell_neighbors(cells, lm, 5, nested=nested)
    rows = got.collect()
    assert got.columns == neighbors.cell_neighbors(cells, lm.limit(5), 5, nested=nested).columns
    if nested:
        assert sorted((r.sample_id, r.cell_id, tuple(r.lm_ids)) for r in rows) == sorted((r.sample_id, r.cell_id, tuple(r.lm_ids)) for r in want)
    else:
        assert sorted((r.sample_id, r.cell_id, r.rank, r.lm_id, round(r.weight, 9)) for r in rows) == sorted((r.sample_id, r.cell_id, r.rank, r.lm_id, round(r.weight, 9)) for r in want)


def test_q_values_use_the_share_of_nulls():
    rng = np.random.default_rng(1)
    p = np.r_[rng.random(700), rng.beta(0.2, 20, 300)]
    assert (storey(p) <= bh(p) + 1e-12).all() and storey(p).sum() < 0.9 * bh(p).sum()
    few = rng.random(50)
    pcs = rng.normal(size=(1500, 3))
    assert np.array_equal(models.covariate_q(few, rng.normal(size=(50, 2)), np.ones(2)), bh(few))
    assert np.array_equal(models.covariate_q(p[:500], pcs[:500], np.ones(3)), storey(p[:500]))
    signal = pcs[:, 0] > 0.8
    mixed = np.where(signal, rng.beta(0.3, 10, 1500), rng.random(1500))
    sdev = np.array([5.0, 1.2, 1.1, 1.0])
    q = models.covariate_q(mixed, np.c_[pcs, rng.normal(size=1500)], sdev)
    assert ((q <= 0.1) & signal).sum() >= ((bh(mixed) <= 0.1) & signal).sum() and ((q <= 0.1) & ~signal).sum() <= 0.15 * max(1, (q <= 0.1).sum())
    full = models.covariate_q(mixed, np.c_[pcs, rng.normal(size=1500)], sdev, design=pcs[:, :1])
    assert (full >= 0).all() and (full <= 1).all()


def test_prior_of_variances():
    rng = np.random.default_rng(4)
    d0, s0, df = 8.0, 2.0, 5
    s2 = d0 * s0 / rng.chisquare(d0, 20_000) * rng.chisquare(df, 20_000) / df
    got = models.variance_prior(s2, df)
    assert abs(got[0] - d0) < 1 and abs(got[1] - s0) < 0.1
    assert np.isinf(models.variance_prior(np.full(50, 3.0), 4)[0])
    outlier = np.r_[s2[:500], np.full(5, 1e6)]
    assert abs(models.variance_prior(outlier, df, True)[1] - s0) < abs(models.variance_prior(outlier, df, False)[1] - s0) + 0.2


def test_contrasts_equal_a_reparametrised_fit():
    rng = np.random.default_rng(7)
    y, group = rng.normal(size=(20, 9)), np.repeat([0, 1, 2], 3)
    cells_ = np.eye(3)[group]
    treat = np.c_[np.ones(9), group == 1, group == 2].astype(float)
    a = models.contrasted(models.ols(y, cells_), np.array([[-1.0], [1.0], [0.0]]))
    b = models.ols(y, treat)
    assert np.allclose(a.coef[:, 0], b.coef[:, 1]) and np.allclose(a.se[:, 0], b.se[:, 1])
    w = rng.random((20, 9)) + 0.5
    assert np.allclose(models.contrasted(models.ols(y, cells_, w), np.array([[-1.0], [1.0], [0.0]])).se[:, 0], models.ols(y, treat, w).se[:, 1])


def test_set_scores_rank_the_planted_set_first():
    rng = np.random.default_rng(8)
    expr = rng.normal(size=(60, 8))
    expr[:10, 4:] += 3
    got = models.set_scores(expr, [np.arange(10), np.arange(30, 40)])
    assert got[0, 4:].min() > got[0, :4].max() and np.abs(got[1]).mean() < np.abs(got[0]).mean()


def test_maps_of_graphs_part_blobs():
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 0.3, (30, 3)), rng.normal(5, 0.3, (30, 3))]
    at, _ = neighbors.nearest(x, x, 32)
    w = np.zeros((60, 60))
    w[np.repeat(np.arange(60), 32), at.ravel()] = 1
    coord, values = linalg.laplacian_eigenmap(w, 10)
    assert (values > 1e-6).all() and np.allclose(np.linalg.norm(coord, axis=0), 1)
    assert abs(np.sign(coord[:30, 0]).mean() - np.sign(coord[30:, 0]).mean()) > 1.8
    d = linalg.diffusion_map(x, 3)
    assert d.shape == (60, 3) and abs(np.corrcoef(d[:, 0], np.r_[np.zeros(30), np.ones(30)])[0, 1]) > 0.9
    own = cluster.kmeans(x, 2)
    assert len(set(own[:30])) == len(set(own[30:])) == 1 and own[0] != own[59]


def test_reference_batches_shift_onto_each_other():
    rng = np.random.default_rng(10)
    ref = np.r_[rng.normal(0, 0.2, (100, 2)) + [4, 0], rng.normal(0, 0.2, (100, 2)) + [0, 4]]
    centroids = np.eye(2)
    r = linalg.memberships(ref, centroids)
    assert np.allclose(r.sum(1), 1) and (r[:100, 0] > 0.9).all()
    query = ref + [0.5, 0.5]
    rq = linalg.memberships(query, centroids)
    betas = linalg.query_betas({"q": (rq.sum(0), rq.T @ query), "o": (r.sum(0), r.T @ ref)}, ref, r)
    moved = query - rq @ betas["q"]
    before, after = query.mean(0) - ref.mean(0), moved.mean(0) - (ref - r @ betas["o"]).mean(0)
    assert np.abs(after).max() < 0.4 * np.abs(before).max()


def test_concordance_is_a_share():
    rng = np.random.default_rng(11)
    t = rng.normal(size=200)
    x = np.c_[t + rng.normal(0, 0.1, 200), rng.normal(size=200), np.ones(200)]
    same, against = models.concordance(t, np.full(200, 0.1), t, x), models.concordance(-t, np.full(200, 0.1), t, x)
    assert same[0] > 0.95 and against[0] < 0.05 and same[2] == 0.5 and ((same >= 0) & (same <= 1)).all()


def test_reconstruction_of_full_rank_is_the_data():
    x = np.random.default_rng(12).normal(size=(30, 4)) * [1, 2, 3, 4] + 5
    scaled, expr = linalg.reconstructed(linalg.pca(x, 4))
    assert np.allclose(expr, x) and np.allclose(scaled, (x - x.mean(0)) / x.std(0, ddof=1))
    _, low = linalg.reconstructed(linalg.pca(x, 1))
    assert np.linalg.matrix_rank(low - low.mean(0), tol=1e-8) == 1


def test_runs_that_ended_badly_are_swept(spark, tmp_path):
    old, new = store.run_key(now=1000), store.run_key()
    for n in (old, new, "other"):
        store.Store(spark, str(tmp_path / n)).write(spark.range(3), "t")
    assert store.sweep_orphans(spark, str(tmp_path)) == [old]
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([new, "other"]) and store.run_key() != store.run_key()
    kept = store.workspace(spark, str(tmp_path))
    kept.write(spark.range(4), "t")
    kept.write(spark.range(5), "t")
    assert kept.read("t").count() == 5 and kept.names() == ["t"] and kept.info()[0]["rows"] == 5 and len(list((tmp_path / kept.path.split("/")[-1] / ".data").iterdir())) == 1


def test_trajectory_counts(spark):
    got = store.trajectory_counts(spark, 200, 20)
    assert got.where("value <= 0").count() == 0 and got.select("sample_id").distinct().count() == 6
    by = got.join(store.trajectory_cells(spark, 200).select("cell_id", "stage"), "cell_id").groupBy("stage").pivot("feature", ["gene000", "gene018"]).agg(F.avg("value")).toPandas().set_index("stage").sort_index().fillna(0)
    assert by["gene000"].iloc[0] > by["gene000"].iloc[-1] and by["gene018"].iloc[-1] > by["gene018"].iloc[0]


def test_significance_and_scatter(spark):
    t = spark.createDataFrame([(1, 0.5, 0.01), (2, -0.5, 0.01), (3, 0.5, 0.5)], "lm_id int, coef double, q double")
    assert [r.sig for r in t.select("lm_id", report.significance(F.col("coef"), F.col("q")).alias("sig")).orderBy("lm_id").collect()] == ["more abundant", "less abundant", "not sig."]
    assert report.scatter(t, "coef", "q", "lm_id").columns == ["x", "y", "color"]


def test_moments_count_given_cells(spark):
    assay = counts(spark, 2, 10, 6)
    a = C.feature_moments(C.normalised(assay, with_cells=True)).orderBy("sample_id", "feature").collect()
    b = C.feature_moments(C.normalised(assay)).orderBy("sample_id", "feature").collect()
    assert [r.feature for r in a] == [r.feature for r in b] and [r.variance for r in a] == pytest.approx([r.variance for r in b])
