import itertools
import math

import numpy as np
import pytest

from loamgrid.functions import special as S
from loamgrid.operators import cluster, linalg, models, neighbors, validate


def test_special_functions():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert S.f_upper(4.0, 1, 10) == pytest.approx(float(S.t_two_sided(2.0, 10)))
    assert S.digamma(1.0)[0] == pytest.approx(-0.5772156649)
    assert S.trigamma(1.0)[0] == pytest.approx(math.pi**2 / 6)
    for x in (0.1, 1.0, 7.5, 300.0):
        assert S.trigamma_inverse(float(S.trigamma(x)[0])) == pytest.approx(x, rel=1e-6)


def test_fdr_against_its_definition():
    p, w = np.array([0.01, 0.2, 0.03, np.nan, 0.03]), np.array([1.0, 2, 0.5, 9, 1])
    q = S.bh(p, w)
    assert np.isnan(q[3])
    ok = [0, 1, 2, 4]
    total = w[ok].sum()
    for i in ok:
        assert q[i] <= total * p[i] / w[[j for j in ok if p[j] <= p[i]]].sum() + 1e-12
    assert (S.density_weights([0.0, 9.0]) == [1.0, 1.0]).all()


def test_elbow_ranges_and_errors():
    assert S.elbow([10, 8, 6, 3, 2, 1.5, 1.3, 1.2, 1.1, 1.0]) <= 5
    assert 3 <= S.elbow([0.01, 0.02, 0.03, 0.1, 0.5, 1.2, 2.5, 4, 6, 8]) <= 7
    with pytest.raises(ValueError):
        S.elbow([1, 2, 3])
    with pytest.raises(ValueError):
        S.elbow([1, 1, 1, 1])


def test_ranks_and_mcc():
    assert S.average_rank([3, 1, 3, 2]).tolist() == [3.5, 1, 3.5, 2]
    assert S.mcc([0, 1, 1, 0], [0, 1, 1, 0]) == 1
    assert S.mcc([0, 1, 1, 0], [1, 0, 0, 1]) == -1
    assert S.mcc([0, 0], [1, 1]) == 0


def test_ols_is_a_difference_of_means_and_checks_designs():
    rng = np.random.default_rng(1)
    y, g = rng.normal(size=(5, 8)), np.array([0, 1] * 4)
    fit = models.moderated(models.ols(y, np.c_[np.ones(8), g]))
    assert np.allclose(fit.coef[:, 1], y[:, g == 1].mean(1) - y[:, g == 0].mean(1))
    assert ((fit.p > 0) & (fit.p <= 1)).all() and (fit.q >= fit.p - 1e-12).all()
    with pytest.raises(ValueError):
        models.ols(y, np.ones((7, 1)))
    with pytest.raises(ValueError):
        models.ols(y, np.c_[np.ones(8), np.ones(8)])


def test_block_correlation_finds_planted_blocks():
    rng = np.random.default_rng(2)
    block = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    y = rng.normal(size=(200, 5))[:, block] + 0.5 * rng.normal(size=(200, 10))
    assert 0.6 < models.block_correlation(y, np.ones((10, 1)), block) < 0.95
    assert abs(models.block_correlation(rng.normal(size=(200, 10)), np.ones((10, 1)), block)) < 0.25


def test_embeddings_have_the_rank_of_their_effect():
    rng = np.random.default_rng(3)
    a, b = np.array([0, 1] * 6), np.repeat([0, 1, 2], 4)
    x = np.c_[np.ones(12), a, b == 1, b == 2].astype(float)
    y = rng.normal(size=(30, 12)) + np.outer(rng.normal(size=30), a)
    one = models.contrast_embedding(y, x, np.array([0, 1, 0, 0]))
    assert one.coord.shape == (12, 1)
    assert abs(np.corrcoef(one.coord[:, 0], a)[0, 1]) > 0.7
    nested = models.nested_embedding(y, x, x[:, :2])
    assert nested.rank == 2 and nested.coord.shape == (12, 2)
    with pytest.raises(ValueError):
        models.nested_embedding(y, x, x)


def test_pls_implicit_equals_dense():
    rng = np.random.default_rng(4)
    w = rng.random((20, 20))
    w = w + w.T
    p, y, x = models.random_walk(w), rng.normal(size=20), rng.normal(size=(20, 7))
    got = models.graph_pls(p, y, x, 3)
    yc, xc = y - y.mean(), x - x.mean(0)
    m = p @ (yc[:, None] * xc)
    m = m - m.mean(0)
    first = m.T @ yc
    t = m @ (first / np.linalg.norm(first))
    assert abs(np.corrcoef(t, got.scores[:, 0])[0, 1]) == pytest.approx(1)
    gram = got.scores.T @ got.scores
    assert np.allclose(gram - np.diag(np.diag(gram)), 0, atol=1e-8)
    with pytest.raises(ValueError):
        models.random_walk(np.zeros((2, 2)))


def test_tmm_and_voom():
    rng = np.random.default_rng(5)
    counts = rng.poisson(50, size=(300, 6)).astype(float)
    counts[:, 3] *= 2
    assert np.allclose(models.tmm(counts), 1, atol=0.05)
    y, weight = models.voom(counts, np.c_[np.ones(6), [0, 0, 0, 1, 1, 1]])
    assert y.shape == weight.shape and (weight > 0).all()
    assert models.expressed(counts, np.ones((6, 1))).all()


def test_communities_stragglers_and_names():
    rng = np.random.default_rng(0)
    w = (rng.random((60, 60)) < 0.02).astype(float)
    w[:30, :30], w[30:, 30:] = rng.random((30, 30)) < 0.6, rng.random((30, 30)) < 0.6
    w = np.maximum(w, w.T)
    assert cluster.communities(w, 200).tolist() == [0] * 30 + [1] * 30
    label = np.r_[np.zeros(25, int), np.arange(1, 6)]
    v = np.full((30, 30), 0.1)
    assert set(cluster.absorbed(v, label, 3).tolist()) == {0}
    assert cluster.named(np.array([5, 5, 2])) == ["cluster.01", "cluster.01", "cluster.02"]


def test_nearest_and_weights():
    rng = np.random.default_rng(6)
    x, ref = rng.normal(size=(40, 5)), rng.normal(size=(100, 5))
    at, dist = neighbors.nearest(x, ref, 7)
    d = np.sqrt(((x[:, None] - ref) ** 2).sum(2))
    assert (at == np.argsort(d, 1, kind="stable")[:, :7]).all()
    w = neighbors.smooth_weights(dist)
    assert ((w > 0) & (w <= 1)).all() and (np.diff(w, axis=1) <= 1e-12).all()
    assert np.allclose(w.sum(1), np.log2(7), atol=1e-3)


def test_pca_and_batch_correction():
    rng = np.random.default_rng(7)
    # three clusters away from the origin, as directions tell clusters apart
    z = 10 * np.eye(4)[rng.integers(0, 3, 300)] + 0.5 * rng.normal(size=(300, 4))
    batch = np.array(["a", "b"] * 150)
    z[batch == "b", 3] += 1.5
    out, r, y = linalg.batch_corrected(z, batch, clusters=5)
    gap = lambda m: abs(m[batch == "a", 3].mean() - m[batch == "b", 3].mean())
    assert gap(out) < 0.5 * gap(z)
    p = linalg.pca(z, 3)
    assert np.allclose(p.project(z), p.coord)


def test_permutations_are_all_and_without_the_observed():
    found = validate.permuted_labels(["A", "B", "A", "B"], [1, 1, 2, 2])
    assert len(found) == 3 and ("A", "B", "A", "B") not in found
    assert len(set(itertools.chain(found))) == 3
