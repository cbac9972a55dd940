"""The whole analysis: setup, landmarks in two passes, graph and clusters, map, sample embedding, models."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LOW_CONFIDENCE, log_norm
from ..operators import annotate, cells as C, cluster, expression, layout, linalg, mapping, models, neighbors
from ..sources import store


@dataclass
class Config:
    share: float = 0.1
    most_landmarks: int = 5000
    components: int = 30
    neighbors: int = 20
    resolution: float = 0.8
    small: int = 3
    prune: float = 1 / 15
    confidence: float = 0.5
    least_cells: int = 10
    seed: int = 123
    batch: str | None = None
    variable: int = 5000
    exclude: bool = True
    force_in: tuple[str, ...] = ()


@dataclass
class Genes:
    """Chosen features of counts, in order, and the mean total of the landmarks that they were chosen on."""

    names: list[str]
    mean_total: float


@dataclass
class Analysis:
    """One analysis of cells in samples (sample_id, covariates). Each verb returns self.

    cells: (sample_id, cell_id, features), or, with counts as an assay (sample_id, cell_id, feature, value; zeros absent), (sample_id, cell_id).
    Counts are dealt by cell once, in ``setup``, and kept as a row a cell (numbers of features, counts); all passes after that are maps, which
    normalise, leave out excluded genes and those of little variance, and make rows dense 2000 at a time.
    """

    cells: DataFrame | None
    samples: DataFrame
    config: Config = field(default_factory=Config)
    provenance: list[dict] = field(default_factory=list)
    assay: DataFrame | None = None
    results: dict = field(default_factory=dict)

    def setup(self) -> Analysis:
        c = self.config
        if self.assay is not None:
            if {"sample_id", "cell_id", "feature", "value"} - set(self.assay.columns):
                raise ValueError("an assay needs sample_id, cell_id, feature and value")
            self.cells = self.assay.select("sample_id", "cell_id").distinct() if self.cells is None else self.cells.select("sample_id", "cell_id")
            if missing := C.missing_features(self.assay, list(c.force_in)):
                warnings.warn(f"features to be forced in that the assay does not have: {missing}", stacklevel=2)
        elif {"sample_id", "cell_id", "features"} - set(self.cells.columns):
            raise ValueError("cells need sample_id, cell_id and features")
        sizes = C.samples(self.cells, c.least_cells)
        self.cells = self.cells.join(sizes.select("sample_id"), "sample_id", "left_semi")
        if self.assay is not None:
            self.assay = self.assay.join(self.cells, ["sample_id", "cell_id"], "left_semi")
        self.sizes = sizes.persist(StorageLevel.MEMORY_AND_DISK)
        self.samples = self.samples.drop("n_cells", "log10_n_cells").join(self.sizes, "sample_id")
        if self.samples.count() != self.sizes.count():
            raise ValueError("samples and cells do not match")
        self.quota = C.quotas(self.sizes, c.share, c.most_landmarks)
        if self.assay is not None:
            self._count_rows()
        if self.assay is not None and c.components >= (least := self.sizes.agg(F.min("n_cells")).first()[0]):
            raise ValueError(f"{c.components} components of {least} cells, the fewest of a sample")
        return self

    def _count_rows(self) -> None:
        """Features in order of their names, which of them may be chosen, all cells as rows of counts, and each sample's mean total."""
        c, spark = self.config, self.cells.sparkSession
        found = self.assay.select("feature").distinct()
        self.feature_names = sorted(r.feature for r in found.collect())  # genes: tens of thousands
        allowed = {r.feature for r in (C.without_excluded(found, list(c.force_in)) if c.exclude else found).collect()}
        self.allowed = np.array([f in allowed for f in self.feature_names], bool)
        self.forced = [i for i, f in enumerate(self.feature_names) if f in set(c.force_in)]
        index = spark.createDataFrame(list(zip(self.feature_names, range(len(self.feature_names)), strict=True)), "feature string, at int")
        self.rows = C.sparse_cells(self.cells, self.assay.where("value <> 0"), F.broadcast(index)).persist(StorageLevel.DISK_ONLY)
        total = self.rows.where(F.size("x") > 0).select("sample_id", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"))
        self.mean_total = {r.sample_id: r.mean for r in total.groupBy("sample_id").agg(F.avg("total").alias("mean")).collect()}  # a row a sample

    def _view(self, place, mean, width: int):
        """A function that makes dense arrays of rows of counts; what it needs is broadcast."""
        held = self.cells.sparkSession.sparkContext.broadcast(linalg.LogCounts(place, mean, width))
        return lambda pdf: held.value(pdf)

    def _rows(self, genes: Genes | None) -> tuple[DataFrame, object]:
        """All cells, and how rows become arrays of features: as they are, or of the chosen genes by the landmarks' mean total."""
        if genes is None:
            return self.cells, None
        column = {f: i for i, f in enumerate(genes.names)}
        return self.rows, self._view(np.array([column.get(f, -1) for f in self.feature_names]), genes.mean_total, len(genes.names))

    def _first_leverage(self) -> DataFrame:
        """Leverage within samples, of counts on the genes that vary most in each."""
        c = self.config
        if self.assay is None:
            return linalg.leverage(self.cells, c.components)
        moments = linalg.count_moments(self.rows, self.mean_total, len(self.feature_names))
        allowed = F.broadcast(self.cells.sparkSession.createDataFrame([(int(i),) for i in np.flatnonzero(self.allowed)], "feature int"))  # genes
        top = C.most_variable(moments.join(allowed, "feature", "left_semi"), c.variable, force_in=self.forced)
        place = {s: np.full(len(self.feature_names), -1, np.int32) for s in self.mean_total}
        ranked = top.select("sample_id", "feature", "rank").toPandas()  # samples x variable
        for s, own in ranked.groupby("sample_id"):
            place[s][own["feature"].to_numpy()] = own["rank"].to_numpy() - 1
        width = int(ranked["rank"].max()) if len(ranked) else 1
        return linalg.leverage(self.rows, c.components, width, dense=self._view(place, self.mean_total, width))

    def _collected(self, chosen: DataFrame) -> tuple[list, list, np.ndarray, Genes | None]:
        """Samples, ids and features of the chosen cells (at most most_landmarks and one a sample); of counts also the genes that vary most in them."""
        c = self.config
        own = F.broadcast(chosen.select("sample_id", "cell_id"))
        if self.assay is None:
            rows = self.cells.join(own, ["sample_id", "cell_id"]).orderBy("sample_id", "cell_id").collect()
            return [r.sample_id for r in rows], [r.cell_id for r in rows], np.array([r.features for r in rows], float), None
        pdf = self.rows.join(own, ["sample_id", "cell_id"]).toPandas().sort_values(["sample_id", "cell_id"]).reset_index(drop=True)
        filled, size = pdf[pdf["at"].map(len) > 0], len(self.feature_names)
        mean = float(filled["x"].map(sum).mean())
        _, at, v = linalg.logged(filled, mean)
        s, q, n = np.bincount(at, v, size), np.bincount(at, v * v, size), len(filled)
        variance = np.where(self.allowed & (s > 0), np.maximum((q - s * s / n) / (n - 1), 0), -1.0)
        order = np.lexsort((np.arange(size), -variance, ~np.isin(np.arange(size), self.forced)))
        keep = [i for i in order[: c.variable].tolist() if variance[i] >= 0]
        genes = Genes([self.feature_names[i] for i in keep], mean)
        place = np.full(size, -1)
        place[keep] = np.arange(len(keep))
        return pdf["sample_id"].tolist(), pdf["cell_id"].tolist(), linalg.LogCounts(place, mean, len(keep))(pdf), genes

    def _sampled(self, weights: DataFrame) -> DataFrame:
        """The weighted sample of the quotas, made once: at most most_landmarks rows and one a sample."""
        chosen = C.weighted_sample(weights, self.quota, self.config.seed).select("sample_id", "cell_id")
        return self.cells.sparkSession.createDataFrame(chosen.collect(), chosen.schema)

    def landmarks(self) -> Analysis:
        """Pass 1 by leverage within samples; pass 2 by leverage on the components of the first landmarks."""
        c = self.config
        first = self._sampled(self._first_leverage())
        *_, x, genes = self._collected(first)
        model = linalg.pca(x, c.components)
        rows, dense = self._rows(genes)
        second = self._sampled(linalg.projected_leverage(rows, model, dense))
        self.lm_sample, self.lm_cell, self.lm_raw, self.genes = self._collected(second)
        self.pca = linalg.pca(self.lm_raw, c.components)
        self.lm_coord = self.pca.coord
        self.lm_scaled, self.lm_expr = linalg.reconstructed(self.pca) if self.genes else ((self.lm_raw - self.pca.center) / self.pca.scale, self.lm_raw)
        if c.batch:
            level = {r.sample_id: str(r[c.batch]) for r in self.samples.select("sample_id", c.batch).collect()}
            self.lm_batch = np.array([level[s] for s in self.lm_sample])
            self.lm_coord, self.memberships, self.centroids = linalg.batch_corrected(self.lm_coord, self.lm_batch, seed=c.seed)
        spark: SparkSession = self.cells.sparkSession
        kinds = {f.name: f.dataType.simpleString() for f in self.cells.schema.fields}
        coord = [(i, s, k, x.tolist()) for i, (s, k, x) in enumerate(zip(self.lm_sample, self.lm_cell, self.lm_raw if self.genes is None else self.lm_coord, strict=True))]
        self.lm = spark.createDataFrame(coord, f"lm_id int, sample_id {kinds['sample_id']}, cell_id {kinds['cell_id']}, features array<double>")
        return self

    @property
    def features(self) -> list[str]:
        return self.genes.names if self.genes else [str(i) for i in range(self.lm_raw.shape[1])]

    def graph(self) -> Analysis:
        c = self.config
        n = len(self.lm_coord)
        at, dist = neighbors.nearest(self.lm_coord, self.lm_coord, min(c.neighbors, n))
        self.nn = at
        self.fuzzy = neighbors.fuzzy_union(at, neighbors.smooth_weights(dist), n)
        self.snn = neighbors.jaccard(at, c.prune)
        joined = np.zeros((n, n), np.float32)
        joined[np.repeat(np.arange(n), at.shape[1]), at.ravel()] = 1
        self.eigenmap, _ = linalg.laplacian_eigenmap(joined, self.lm_coord.shape[1])
        self.clustering = annotate.Solutions("clustering")
        return self.cluster(c.resolution)

    def layout(self, epochs: int = 500) -> Analysis:
        """Two coordinates of each landmark, in lm_layout."""
        self.lm_layout = layout.two_dimensional(self.fuzzy, self.lm_coord[:, :2], epochs, self.config.seed)
        return self

    def cluster(self, resolution: float, method: str = "snn", name: str | None = None) -> Analysis:
        w = self.snn if method == "snn" else np.where(self.fuzzy > 1 / 20, self.fuzzy, 0)
        start = cluster.kmeans(self.eigenmap, min(25, max(1, len(w) // 3)), self.config.seed)
        label = cluster.absorbed(w, cluster.communities(w, resolution, start, seed=self.config.seed), self.config.small)
        table = self.cells.sparkSession.createDataFrame(list(enumerate(cluster.named(label))), "lm_id int, label string")
        self.clustering.add(name or f"leiden.res.{resolution:g}", table)
        return self

    def celltypes(self, table: DataFrame, name: str) -> Analysis:
        self.typing = getattr(self, "typing", None) or annotate.Solutions("celltyping")
        self.typing.add(name, table)
        return self

    def import_annotations(self, meta: DataFrame, columns: list[str] | None = None) -> Analysis:
        """Labellings of the landmarks from text columns of a table of cells; the last one becomes active."""
        for name, table in annotate.imported(self.lm, meta, columns).items():
            self.celltypes(table, name)
        return self

    def _placed(self):
        """(reference coordinates of landmarks, the function that places rows of cells among them)."""
        project = self.pca.project
        if self.config.batch:
            return self.lm_coord, self._batch_map(project)
        return self.lm_coord, lambda x, _: project(x)

    def map(self) -> Analysis:
        """Edges of all cells in one pass, a row a cell; density and labels from them."""
        c = self.config
        reference, place = self._placed()
        rows, dense = self._rows(self.genes)
        edges = neighbors.placed_neighbors(rows, np.arange(len(reference)), reference, "int", c.neighbors, place, self.lm_raw.shape[1], nested=True, dense=dense)
        self.cell_edges = edges.persist(StorageLevel.DISK_ONLY)
        self.edges = neighbors.exploded(self.cell_edges)
        self.density = mapping.density(self.edges, self.lm, self.sizes)
        return self.refresh()

    def map_to(self, reference: Analysis, k: int = 10, threshold: float | None = None) -> Analysis:
        """Cell types of all cells from another analysis: votes of the k nearest of its landmarks, in its own components.

        Counts are normalised by its landmarks' mean total, on its genes. (sample_id, cell_id, label, confidence) goes to reference_labels.
        """
        place = reference.pca.project
        if (reference.genes is None) != (self.assay is None):
            raise ValueError("counts map to an analysis of counts, features to one of features")
        rows, dense = self._rows(reference.genes)
        nn = neighbors.placed_neighbors(rows, np.arange(len(reference.pca.coord)), reference.pca.coord, "int", k, lambda x, _: place(x), reference.lm_raw.shape[1], dense=dense)
        votes = mapping.neighbor_votes(nn, reference.typing.current())
        self.reference_labels = mapping.transferred(votes, self.cells, self.config.confidence if threshold is None else threshold)
        return self

    def _batch_map(self, project):
        """Projection and batch correction of cells: one pass sums memberships by batch, the returned function is a pure map."""
        level = {r.sample_id: str(r[self.config.batch]) for r in self.samples.select("sample_id", self.config.batch).collect()}
        centroids, (rows, dense), width = self.centroids, self._rows(self.genes), self.lm_raw.shape[1]
        dense = dense or (lambda pdf: linalg.vectors(pdf, width))

        def sums(batches):
            import pandas as pd

            held: dict = {}
            for pdf in batches:
                for a in range(0, len(pdf), 2000):
                    part = pdf.iloc[a : a + 2000]
                    z = project(dense(part))
                    r = linalg.memberships(z, centroids)
                    name = np.array([level[s] for s in part["sample_id"]])
                    for b in set(name.tolist()):
                        own = name == b
                        n, m = held.get(b, (0, 0))
                        held[b] = n + r[own].sum(0), m + r[own].T @ z[own]
            yield pd.DataFrame([{"b": b, "n": n, "m": m.ravel()} for b, (n, m) in held.items()], columns=["b", "n", "m"])

        total: dict = {}
        columns = ["sample_id", *(["features"] if "features" in rows.columns else ["at", "x"])]
        for row in rows.select(*columns).mapInPandas(sums, "b string, n array<double>, m array<double>").toLocalIterator():
            n, m = total.get(row.b, (0, 0))
            total[row.b] = n + np.array(row.n), m + np.array(row.m).reshape(len(row.n), -1)
        betas = linalg.query_betas(total, self.lm_coord, self.memberships)

        def place(x, sample):
            z = project(x)
            r = linalg.memberships(z, centroids)
            return np.stack([v - w @ betas[level[s]] for v, w, s in zip(z, r, sample, strict=True)]) if len(z) else z

        return place

    def refresh(self) -> Analysis:
        """Labels and composition of the active solutions, from the edges that are there: votes are a map."""
        for kind, s in (("clustering", self.clustering), ("celltyping", getattr(self, "typing", None))):
            if s is None:
                continue
            annot = {r.lm_id: r.label for r in s.current().collect()}  # landmarks
            labels = mapping.voted(self.cell_edges, annot, self.config.confidence)
            setattr(self, f"{kind}_labels", labels)
            setattr(self, f"{kind}_composition", mapping.composition(labels))
            s.stale = [x for x in s.stale if x == "trad"]
        return self

    def matrix(self) -> tuple[np.ndarray, np.ndarray, list]:
        """(log_norm, norm, samples): landmarks x samples, on the driver."""
        pdf = self.density.select("lm_id", "sample_id", "norm", "log_norm").toPandas()
        names = sorted(pdf["sample_id"].unique())
        log = pdf.pivot(index="lm_id", columns="sample_id", values="log_norm")[names]
        return log.to_numpy(), pdf.pivot(index="lm_id", columns="sample_id", values="norm")[names].to_numpy(), names

    def embed(self) -> Analysis:
        log, _, self.sample_names = self.matrix()
        self.sample_pca = models.sample_pca(log)
        return self

    def effect(self, full: np.ndarray | None = None, reduced: np.ndarray | None = None, design: np.ndarray | None = None, contrast: np.ndarray | None = None) -> models.Embedding:
        """Samples along what a full model adds to a reduced one, or along one contrast of a design."""
        log, *_ = self.matrix()
        return models.contrast_embedding(log, design, contrast) if contrast is not None else models.nested_embedding(log, full, reduced)

    def _labelled_by(self) -> tuple:
        return self.clustering.active, self.typing.active if getattr(self, "typing", None) else None

    def _once(self, kind: str, name: str, again: bool, make):
        """The result of that name, made if it is not there. One made under another active labelling is returned with a warning."""
        held, by = self.results.setdefault(kind, {}), self.results.setdefault("labelled by", {})
        if again or name not in held:
            held[name], by[kind, name] = make(), self._labelled_by()
        elif by.get((kind, name)) != self._labelled_by():
            warnings.warn(f"{name} of {kind} was made under the labellings {by.get((kind, name))}; now {self._labelled_by()} are active", stacklevel=3)
        return held[name]

    def slot(self, name: str, sample=None) -> DataFrame:
        """One of the tables of ``map`` (edges, cell_edges, density, clustering_labels, celltyping_labels), of one sample on demand."""
        table = getattr(self, name, None)
        if not isinstance(table, DataFrame) or "sample_id" not in table.columns:
            raise ValueError(f"no table {name} by sample")
        return table if sample is None else table.where(F.col("sample_id") == sample)

    def lm_fit(self, design: np.ndarray, contrasts: np.ndarray | None = None, block: list | None = None, name: str = "default", again: bool = False) -> models.Fit:
        """Moderated models of log density by landmark, with density- and component-weighted q beside plain ones.

        Models of the log percents of clusters and of cell types, where there is more than one, go with it as ``composition``. Results are kept
        by name; a name that is there is returned unless ``again``.
        """
        return self._once("lm", name, again, lambda: self._lm_fit(design, contrasts, block))

    def _lm_fit(self, design, contrasts, block) -> models.Fit:
        log, norm, self.sample_names = self.matrix()
        fit = models.fitted(log, design, contrasts, block)
        fit.density_q = np.stack([models.density_q(fit.p[:, j], norm.sum(1)) for j in range(fit.p.shape[1])], 1)
        expanded = models.checked_design(design, log.shape[1])[[self.sample_names.index(s) for s in self.lm_sample]]
        fit.component_q = np.stack([models.covariate_q(fit.p[:, j], self.lm_coord, self.lm_coord.std(0, ddof=1), expanded) for j in range(fit.p.shape[1])], 1)
        fit.composition = {}
        for kind in ("clustering", "celltyping"):
            table = getattr(self, f"{kind}_composition", None)
            pdf = table.where(F.col("label") != LOW_CONFIDENCE).select("label", "sample_id", log_norm(F.col("perc")).alias("y")).toPandas() if table is not None else None  # labels x samples
            if pdf is not None and pdf["label"].nunique() > 1:
                wide = pdf.pivot(index="label", columns="sample_id", values="y").reindex(columns=self.sample_names)
                fit.composition[kind] = models.fitted(wide.to_numpy(), design, contrasts, block), list(wide.index)
                getattr(self, "clustering" if kind == "clustering" else "typing").stale.clear()
        return fit

    def pb_de(self, design: np.ndarray | None = None, contrasts: np.ndarray | None = None, block: list | None = None, labels: list[str] | None = None, landmarks: list[int] | None = None, against: list[str] | None = None, against_landmarks: list[int] | None = None, sets: dict[str, list[str]] | None = None, model: str = "default", result: str = "pb", again: bool = False) -> expression.Result:
        """Models of pseudobulk expression over samples (with a design), or of chosen cells against others in the same samples (markers).

        Cells are those of labels of the active cell types (clusters without any), or those that a set of landmarks claims; all by default.
        """
        mode = expression.mode(design is not None, labels is not None, landmarks is not None, against is not None, against_landmarks is not None)
        return self._once(f"pb.{mode}", f"{model}/{result}", again, lambda: self._pb_de(mode, design, contrasts, block, (labels, landmarks), (against, against_landmarks), sets))

    def _pb_de(self, mode, design, contrasts, block, one, two, sets) -> expression.Result:
        values = self.assay if self.assay is not None else C.long_form(self.cells).withColumn("feature", F.col("feature").cast("string"))
        names = [r.sample_id for r in self.sizes.select("sample_id").orderBy("sample_id").collect()]
        told = getattr(self, "celltyping_labels", None)
        told = self.clustering_labels if told is None else told
        chosen = lambda labels, landmarks: mapping.chosen_cells(self.cells.select("sample_id", "cell_id"), told, labels, self.edges, landmarks, self.config.confidence).withColumn("weight", F.lit(1.0))
        first, counts = chosen(*one), self.assay is not None
        if mode == "design":
            return expression.design_mode(values, first, names, design, contrasts, block, counts, sets)
        if two == (None, None):
            second = self.cells.select("sample_id", "cell_id").join(first, ["sample_id", "cell_id"], "left_anti").withColumn("weight", F.lit(1.0))
        else:
            second = chosen(*two)
        return expression.marker_mode(values, first, second, names, counts, sets)

    def pls_programs(self, coef: int, name: str = "default", components: int = 5, design: np.ndarray | None = None, block: list | None = None, interaction: bool = True, method: str = "pearson", regularise: float = 0.0, lazy: float = 1.0) -> models.Pls:
        """Feature programs along one coefficient of a fit that ``lm_fit`` has kept; scores by landmark, loadings by feature.

        design: columns of the samples that are taken out of the features first (those that the coefficient does not use), with blocks.
        """
        fit = self.results.get("lm", {}).get(name)
        if fit is None:
            raise ValueError(f"no fit of the name {name}; there are {sorted(self.results.get('lm', {}))}")
        at = [self.sample_names.index(s) for s in self.lm_sample]
        nuisance = models.nuisance(design, block)[at] if design is not None or block is not None else None
        x = self.lm_raw
        if self.genes is not None:
            x = x[:, (x > 0).mean(0) > 0.005]
        walk = models.random_walk(self.snn, regularise, lazy)
        made = models.graph_pls(walk, fit.coef[:, coef], x, components, interaction, nuisance, method, self.snn)
        made.concordance = np.stack([models.concordance(fit.coef[:, coef] - fit.coef[:, coef].mean(), np.sqrt(fit.s2_post), t, x) for t in made.scores.T], 1) if made.scores.shape[1] else np.zeros((x.shape[1], 0))
        self.results.setdefault("pls", {})[name, coef] = made
        return made

    def subset(self, kept: DataFrame, note: dict) -> Analysis:
        """A new analysis of some cells: nothing computed is carried over, the batch column is."""
        keep = kept.select("sample_id", "cell_id").distinct()
        cells = self.cells.join(keep, ["sample_id", "cell_id"], "left_semi")
        return Analysis(cells, self.samples, self.config, [*self.provenance, note], self.assay).setup()

    def run(self) -> Analysis:
        return self.setup().landmarks().graph().map().embed()

    def save(self, kept: store.Store) -> Analysis:
        """Keeps what ``map`` has made: landmarks, edges, density, sizes, samples and labellings of both kinds."""
        spark = self.cells.sparkSession
        kept.write(self.samples, "samples")
        kept.write(self.sizes, "sizes")
        kept.write(self.lm, "landmarks")
        kept.write(self.cell_edges, "edges", ["sample_id"])
        kept.write(self.density, "density")
        for kind in ("clustering", "typing"):
            solutions = getattr(self, kind, None)
            for name, table in (solutions.tables if solutions else {}).items():
                kept.write(table.select("lm_id", "label"), f"{kind}.{name}")
        model = {"config": vars(self.config), "active": {k: getattr(self, k).active for k in ("clustering", "typing") if getattr(self, k, None)}, "genes": vars(self.genes) if self.genes else None, "provenance": self.provenance}
        arrays = {"center": self.pca.center, "scale": self.pca.scale, "rotation": self.pca.rotation, "d": self.pca.d, "coord": self.pca.coord, "lm_coord": self.lm_coord, "lm_raw": self.lm_raw}
        kept.write(spark.createDataFrame([("model", json.dumps(model), None, None)] + [(k, None, [int(n) for n in v.shape], v.ravel().tolist()) for k, v in arrays.items()], "name string, said string, shape array<int>, v array<double>"), "model")
        return self

    @classmethod
    def load(cls, kept: store.Store, cells: DataFrame | None = None, assay: DataFrame | None = None) -> Analysis:
        """An analysis as ``save`` has kept it, of the same cells; it can embed, model, label anew and serve as a reference."""
        rows = {r.name: r for r in kept.read("model").collect()}  # a model is landmark-sized
        said = json.loads(rows["model"].said)
        config = said["config"] | {"force_in": tuple(said["config"]["force_in"])}
        out = cls(cells, kept.read("samples"), Config(**config), said["provenance"], assay)
        arr = lambda k: np.array(rows[k].v, float).reshape(rows[k].shape)
        out.pca = linalg.PCA(*(arr(k) for k in ("center", "scale", "rotation", "d", "coord")))
        out.lm_coord, out.lm_raw, out.genes = arr("lm_coord"), arr("lm_raw"), Genes(**said["genes"]) if said["genes"] else None
        out.lm, out.sizes, out.cell_edges, out.density = (kept.read(k) for k in ("landmarks", "sizes", "edges", "density"))
        placed = out.lm.orderBy("lm_id").select("sample_id", "cell_id").collect()
        out.lm_sample, out.lm_cell = [r.sample_id for r in placed], [r.cell_id for r in placed]
        out.edges = neighbors.exploded(out.cell_edges)
        out.cells = out.cell_edges.select("sample_id", "cell_id") if cells is None else cells
        for kind, label in (("clustering", "clustering"), ("typing", "celltyping")):
            names = [n.removeprefix(f"{kind}.") for n in kept.names() if n.startswith(f"{kind}.")]
            if names:
                solutions = annotate.Solutions(label)
                for n in names:
                    solutions.add(n, kept.read(f"{kind}.{n}"), activate=False)
                solutions.activate(said["active"][kind])
                setattr(out, kind, solutions)
        return out.refresh()


def analysis_of(source, samples: DataFrame | None = None, config: Config | None = None, spark: SparkSession | None = None, **unknown) -> Analysis:
    """An analysis of whatever holds cells: the path of a Parquet table, a table of counts, of features, or with a column for each marker.

    Without samples they are the cells' own, with the columns that have one value in each. Unknown arguments are named in a warning.
    """
    if unknown:
        warnings.warn(f"unknown arguments: {sorted(unknown)}", stacklevel=2)
    df = (spark or SparkSession.getActiveSession()).read.parquet(source) if isinstance(source, str) else source
    if not isinstance(df, DataFrame):
        raise TypeError(f"no analysis of a {type(source).__name__}")
    if {"feature", "value"} <= set(df.columns):
        own = samples if samples is not None else C.sample_table(df.drop("cell_id", "feature", "value"))
        return Analysis(None, own, config or Config(), assay=df)
    own = samples if samples is not None else C.sample_table(df.drop("cell_id", "features"))
    return Analysis(store.checked_cells(df), own, config or Config())


__all__ = ["LOW_CONFIDENCE", "Analysis", "Config", "Genes", "analysis_of"]
