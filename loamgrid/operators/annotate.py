"""Named solutions of landmark labels: cell types from clusters or from labelled cells."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import annotation_columns


def from_clusters(annot: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """(lm_id, label): each cluster's cell type. Every cluster must be named once. annot: (lm_id, label)."""
    named = [c for cs in types.values() for c in cs]
    if len(named) != len(set(named)):
        raise ValueError("a cluster is named twice")
    known = {r.label for r in annot.select("label").distinct().collect()}
    if set(named) != known:
        raise ValueError(f"not named: {sorted(known - set(named))}; unknown: {sorted(set(named) - known)}")
    table = F.create_map(*[F.lit(x) for t, cs in types.items() for c in cs for x in (c, t)])
    return annot.select("lm_id", table[F.col("label")].alias("label"))


def from_cells(landmarks: DataFrame, labels: DataFrame) -> DataFrame:
    """(lm_id, label) from labels of cells (sample_id, cell_id, label): each landmark takes that of its own cell."""
    out = landmarks.select("lm_id", "sample_id", "cell_id").join(labels, ["sample_id", "cell_id"], "left")
    if missing := out.where("label is null").limit(5).collect():
        raise ValueError(f"landmarks without a label: {[r.cell_id for r in missing]}")
    return out.select("lm_id", "label")


def imported(landmarks: DataFrame, meta: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """(lm_id, label) by name, of each column of the cells' table that can label cells, or of the given ones. Cells without a label are ``unknown``."""
    found = annotation_columns(meta)
    if columns is not None and (bad := [c for c in columns if c not in found]):
        raise ValueError(f"columns that cannot label cells: {bad}; there are {found}")
    return {c: from_cells(landmarks, meta.select("sample_id", "cell_id", F.coalesce(c, F.lit("unknown")).alias("label"))) for c in columns or found}


def numbered(annot: DataFrame) -> DataFrame:
    """Labels renumbered by first appearance (smallest landmark)."""
    first = annot.groupBy("label").agg(F.min("lm_id").alias("first"))
    order = first.select("label", F.dense_rank().over(Window.orderBy("first")).alias("number"))  # one row for each label
    return annot.join(F.broadcast(order), "label").select("lm_id", "number")


@dataclass
class Solutions:
    """Named label tables of one kind (clustering or cell types), one of them active. Changing it makes what was derived stale."""

    kind: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    active: str | None = None
    stale: list[str] = field(default_factory=list)

    def add(self, name: str, table: DataFrame, activate: bool = True) -> None:
        if name == "ids":
            raise ValueError("ids is reserved")
        self.tables[name] = table
        if activate or self.active is None:
            self.activate(name)

    def activate(self, name: str) -> None:
        if name not in self.tables:
            raise ValueError(f"no such solution: {name}; there are {sorted(self.tables)}")
        if name != self.active:
            self.stale = ["labels", "composition", "trad"]
        self.active = name

    def names(self) -> list[str]:
        return list(self.tables)

    def current(self) -> DataFrame:
        if self.active is None:
            raise ValueError(f"no {self.kind} yet")
        return self.tables[self.active]
