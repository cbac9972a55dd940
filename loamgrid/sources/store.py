"""Loading, simulating and keeping tables.

Kept tables are Parquet folders with a manifest (schema version, rows). A table is written to a folder of its own, which the small file of its name
then points to, so readers see the old table or the new one, never half of either; the folder before goes after that. Cell tables are
partitioned by sample, so a scan of one sample prunes.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import u01
from ..operators.cells import matched, of_large_samples

SCHEMA_VERSION = 3

CELLS = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("cell_id", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
ASSAY = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("cell_id", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class Store:
    """Named tables below one path."""

    spark: SparkSession
    path: str

    def write(self, df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
        folder = f"{name}-{uuid.uuid4().hex}"
        # rebalanced by size, so that a sample is in a few files and a large one in several, whatever the tasks of df
        writer = df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/.data/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/.data/{folder}").count()
        fs, aside = _fs(self.spark, f"{self.path}/.{folder}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "rows": rows, "folder": folder, "schema": df.schema.jsonValue()}).encode()))
        stream.close()
        final = _fs(self.spark, f"{self.path}/{name}")[1]
        before = self.manifest(name).get("folder") if fs.exists(final) else None
        self._replace(fs.makeQualified(aside), fs.makeQualified(final))
        if before:
            fs.delete(_fs(self.spark, f"{self.path}/.data/{before}")[1], True)
        return self.read(name)

    def _replace(self, aside, final) -> None:
        """Renames over the old name in one step."""
        jvm = self.spark.sparkContext._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, final, how)

    def cached(self, name: str, make, by: list[str] = ()) -> DataFrame:
        """The table of that name if it is kept in this version, else what make() gives, kept."""
        try:
            return self.read(name)
        except (FileNotFoundError, ValueError):
            return self.write(make(), name, by)

    def manifest(self, name: str) -> dict:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        if not fs.exists(p):
            raise FileNotFoundError(f"no table {name}")
        stream = fs.open(p)
        said = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        return said

    def read(self, name: str, sample: str | None = None) -> DataFrame:
        said = self.manifest(name)
        if said["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"{name} has schema version {said['schema_version']}; this is version {SCHEMA_VERSION}")
        df = self.spark.read.schema(T.StructType.fromJson(said["schema"])).parquet(f"{self.path}/.data/{said['folder']}")
        return df if sample is None else df.where(F.col("sample_id") == sample)

    def names(self) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def validate(self, names: list[str] | None = None) -> None:
        """An error unless all tables exist, of this version, with all their rows."""
        for name in self.names() if names is None else names:
            if self.read(name).count() != self.manifest(name)["rows"]:
                raise ValueError(f"{name} has lost rows")

    def info(self) -> list[dict]:
        fs, said = _fs(self.spark, self.path)[0], {n: self.manifest(n) for n in self.names()}
        return [{"name": n, "rows": m["rows"], "bytes": fs.getContentSummary(_fs(self.spark, f"{self.path}/.data/{m['folder']}")[1]).getLength()} for n, m in said.items()]

    def cleanup(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or where that is unset and the master is local a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


RUN = "loamgrid-run-"


def run_key(now: float | None = None) -> str:
    """A name of a run that sorts by its start and is like no other."""
    return f"{RUN}{int(now if now is not None else time.time()):012d}-{uuid.uuid4().hex[:12]}"


def workspace(spark: SparkSession, root: str | None = None) -> Store:
    """A store of this run, below the shared folder; it goes when the driver ends."""
    store = Store(spark, f"{root or shared_folder(spark)}/{run_key()}")

    def end() -> None:
        with contextlib.suppress(Exception):
            store.cleanup()

    atexit.register(end)
    return store


def sweep_orphans(spark: SparkSession, root: str, older: float = 7 * 86_400, now: float | None = None) -> list[str]:
    """Removes the stores of runs that began more than ``older`` seconds ago (their drivers ended without removing them); the names that went."""
    fs, p = _fs(spark, root)
    limit = (now if now is not None else time.time()) - older
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    gone = sorted(n for n in names if n.startswith(RUN) and n[len(RUN) :].split("-")[0].isdigit() and int(n[len(RUN) :].split("-")[0]) < limit)
    for n in gone:
        fs.delete(_fs(spark, f"{root}/{n}")[1], True)
    return gone


def export(store: Store, density: DataFrame, solutions: dict[str, DataFrame], active: str | None, samples: DataFrame) -> Store:
    """Tables for other tools: assays (lm_id, sample_id, counts, normcounts, logcounts), rows (lm_id, a column for each labelling, and the active one), columns (samples)."""
    store.write(density.select("lm_id", "sample_id", F.col("raw").alias("counts"), F.col("norm").alias("normcounts"), F.col("log_norm").alias("logcounts")), "assays")
    rows = density.select("lm_id").distinct()
    for name, labels in solutions.items():
        rows = rows.join(labels.select("lm_id", F.col("label").alias(name)), "lm_id", "left")  # landmarks
    store.write(rows.withColumn("active", F.col(active)) if active else rows, "rows")
    store.write(samples, "columns")
    return store


def checked_cells(cells: DataFrame, markers: list[str] | None = None, least_markers: int = 3) -> DataFrame:
    """cells with an array of features: made of the named columns, or of all numeric ones."""
    if "features" in cells.columns:
        return cells.select("sample_id", "cell_id", F.col("features").cast("array<double>").alias("features"))
    numeric = [f.name for f in cells.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ("sample_id", "cell_id", "cell_ord")]
    chosen = markers or numeric
    if unknown := [m for m in chosen if m not in numeric]:
        import difflib

        hints = {m: difflib.get_close_matches(m, numeric, 3) for m in unknown}
        raise ValueError(f"no such markers: {hints}")
    if len(chosen) < least_markers:
        raise ValueError(f"at least {least_markers} markers are needed")
    return cells.select("sample_id", "cell_id", F.array(*[F.col(m).cast("double") for m in chosen]).alias("features"))


def identified(cells: DataFrame) -> DataFrame:
    """cells with a cell_id, made up as sample and number where there is none. Keep the result: numbers follow how the files are split into tasks."""
    return cells if "cell_id" in cells.columns else cells.withColumn("cell_id", F.concat_ws("_event_", "sample_id", F.monotonically_increasing_id()))


def load_cells(spark: SparkSession, path: str, markers: list[str] | None = None, least: int = 10) -> DataFrame:
    return of_large_samples(checked_cells(identified(spark.read.parquet(path)), markers), least)


def load_assay(spark: SparkSession, paths: list[str], meta: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first of paths that can be read, matched with cell metadata, and the cells without a partner."""
    for path in paths:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            own = spark.read.parquet(path)
            on = ["sample_id", "cell_id"] if "sample_id" in own.columns else ["cell_id"]  # ids need only be unique within their sample
            assay, lost = matched(own, meta, on)
            return of_large_samples(assay.select("sample_id", "cell_id", "feature", "value"), least), lost
    raise FileNotFoundError(f"none of {paths} exists")


def decoded(codes: DataFrame, categories: DataFrame, code: str = "code") -> DataFrame:
    """Dictionary-encoded values: codes below zero are null. categories: (code, value)."""
    return codes.join(F.broadcast(categories), code, "left")


def sample_order(cells: DataFrame) -> DataFrame:
    """Samples by first appearance (smallest cell_ord), never by name."""
    return cells.groupBy("sample_id").agg(F.min("cell_ord").alias("first")).orderBy("first")


def _normal(seed: int, *ids):
    return F.sqrt(-2 * F.log(u01(seed, *ids))) * F.cos(2 * 3.141592653589793 * u01(seed + 1, *ids))


def simulate_abundance(spark: SparkSession, cells: int = 50_000, per_group: int = 6, shares: tuple[float, ...] = (0.005, 0.05, 0.5), seed: int = 42) -> DataFrame:
    """Cells of two groups for each share: a target population whose share is halved in the second group; two batches shift all markers."""
    ids = spark.range(len(shares) * 2 * per_group * cells).withColumn("s", F.floor(F.col("id") / cells).cast("int"))
    setting = F.floor(F.col("s") / (2 * per_group)).cast("int")
    share = F.array(*[F.lit(x) for x in shares])[setting]
    group = (F.floor(F.col("s") / per_group) % 2).cast("int")
    batch = (F.col("s") % 2).cast("int")
    target = u01(seed, F.col("id")) < share * F.when(group == 1, 0.5).otherwise(1.0)
    marks = F.array(*[F.when(target, 2.0 if m == 0 else 0.0).otherwise(0.0) + _normal(seed + 10 * m, F.col("id")) * 0.5 + batch * 0.2 for m in range(5)])
    return ids.select(F.format_string("sample%02d", F.col("s")).alias("sample_id"), F.concat(F.lit("cell"), F.col("id")).alias("cell_id"), marks.alias("features"), share.alias("setting"), F.when(group == 1, "depleted").otherwise("control").alias("treatment"), F.concat(F.lit("batch"), batch + 1).alias("batch"), F.when(target, "target").otherwise("other").alias("cell_type"))


def simulate_expression(spark: SparkSession, cells: int = 50_000, per_group: int = 6, shifts: tuple[float, ...] = (0.5, 1.0, 2.0), seed: int = 42) -> DataFrame:
    """As simulate_abundance with 5 percent targets in all groups; their second marker shifts in the activated group."""
    ids = spark.range(len(shifts) * 2 * per_group * cells).withColumn("s", F.floor(F.col("id") / cells).cast("int"))
    shift = F.array(*[F.lit(x) for x in shifts])[F.floor(F.col("s") / (2 * per_group)).cast("int")]
    group = (F.floor(F.col("s") / per_group) % 2).cast("int")
    target = u01(seed, F.col("id")) < 0.05
    marks = F.array(*[F.when(target & F.lit(m == 0), 2.0).otherwise(0.0) + F.when(target & (group == 1) & F.lit(m == 1), shift * 0.5).otherwise(0.0) + _normal(seed + 10 * m, F.col("id")) * 0.5 for m in range(5)])
    return ids.select(F.format_string("sample%02d", F.col("s")).alias("sample_id"), F.concat(F.lit("cell"), F.col("id")).alias("cell_id"), marks.alias("features"), shift.alias("shift"), F.when(group == 1, "activated").otherwise("control").alias("treatment"), F.when(target, "target").otherwise("other").alias("cell_type"))


#: Share of condition A in each of ten stages of the trajectory.
STAGES = (0.5, 0.4, 0.3, 0.2, 0.1, 0.8, 0.85, 0.9, 0.95, 1.0)


def trajectory_cells(spark: SparkSession, cells: int = 5000, replicates: int = 3, seed: int = 1) -> DataFrame:
    """(cell_id, stage, condition, replicate, sample_id): cells along a path of ten stages, at each of which one condition has its own share."""
    ids = spark.range(cells).withColumn("stage", F.floor(u01(seed, F.col("id")) * len(STAGES)).cast("int"))
    a = u01(seed + 1, F.col("id")) < F.array(*[F.lit(x) for x in STAGES])[F.col("stage")]
    named = ids.withColumn("condition", F.when(a, "A").otherwise("B")).withColumn("replicate", F.concat(F.lit("R"), (F.floor(u01(seed + 2, F.col("id")) * replicates) + 1).cast("int")))
    return named.select(F.concat(F.lit("cell"), "id").alias("cell_id"), "stage", "condition", "replicate", F.concat_ws("_", "condition", "replicate").alias("sample_id"))


def trajectory_counts(spark: SparkSession, cells: int = 5000, genes: int = 500, replicates: int = 3, seed: int = 1) -> DataFrame:
    """(sample_id, cell_id, feature, value) of ``trajectory_cells``: a gene peaks at one place of the path; counts are geometric around that mean, zeros absent."""
    own = trajectory_cells(spark, cells, replicates, seed).crossJoin(spark.range(genes).withColumnRenamed("id", "gene"))  # the result itself, before its zeros go
    peak = F.col("gene") * len(STAGES) / genes
    mean = 0.2 + 6 * F.exp(-F.pow(F.col("stage") - peak, 2) / 2)
    value = F.floor(F.log(u01(seed + 3, F.col("cell_id"), F.col("gene"))) / F.log(mean / (1 + mean)))
    return own.select("sample_id", "cell_id", F.format_string("gene%03d", "gene").alias("feature"), value.cast("double").alias("value")).where("value > 0")
