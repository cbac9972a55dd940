"""Size-tiered compaction: arrivals become small immutable runs, runs of similar size merge, manifests are versioned.

A run is a folder of Parquet files that nobody changes once a manifest names it. Its tier is the power of
``fanout`` by which it exceeds the smallest run size; when a tier holds ``fanout`` runs they merge into one,
in files of about ``target`` bytes. A row is therefore rewritten about log_fanout(size / arrival) times.
Version v of the table is the file ``manifest/v``: it is written aside and then given a name that must
not exist, in one step of the file system (a hard link for local folders, else a rename that never replaces), so of two writers
one wins and the other starts again from the newer version; readers open one version
and see all of it. Files of merged runs stay for readers of older versions until ``vacuum``.

Merging reads and writes without a shuffle: Spark packs the runs' files into as many tasks as there will be files. Nothing is
collected but names and sizes of files.

Cases: an arrival without rows adds a version but no run, and a table of such arrivals reads as an empty frame of their schema; rows
may repeat; columns and nulls are kept as they are; all arrivals of a table have one schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import fresh, hadoop

FANOUT = 4
TARGET = 128 << 20
SMALLEST = 1 << 20


@dataclass
class Run:
    name: str
    bytes: int
    rows: int


@dataclass
class Manifest:
    version: int
    runs: list[Run] = field(default_factory=list)
    schema: str | None = None


class Table:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, target: int = TARGET, smallest: int = SMALLEST):
        self.spark, self.path, self.fanout, self.target, self.smallest = spark, path, fanout, target, smallest

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, by default the newest; version 0 is the empty table."""
        fs, folder = hadoop(self.spark, f"{self.path}/manifest")
        if version is None:
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            version = max((int(n) for n in names if n.isdigit()), default=0)
        if not version:
            return Manifest(0)
        stream = fs.open(hadoop(self.spark, f"{self.path}/manifest/{version:012d}")[1])
        said = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        return Manifest(said["version"], [Run(**r) for r in said["runs"]], said["schema"])

    def commit(self, before: Manifest, runs: list[Run], schema: str | None = None) -> Manifest | None:
        """The next version, or None if another writer has made it meanwhile."""
        after = Manifest(before.version + 1, runs, before.schema or schema)
        fs, aside = hadoop(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        final = hadoop(self.spark, f"{self.path}/manifest/{after.version:012d}")[1]
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": after.version, "runs": [vars(r) for r in runs], "schema": after.schema}).encode()))
        stream.close()
        try:
            self._name(fs.makeQualified(aside), fs.makeQualified(final))
            return after
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return None
        finally:
            fs.delete(aside, False)

    def _name(self, aside, final) -> None:
        """Gives the file the final name, which must not exist: the file system decides between writers."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        if final.toUri().getScheme() == "file":
            at = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(at.get(final.toUri()), at.get(aside.toUri()))
            return
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(aside, final, how)

    def written(self, df: DataFrame) -> Run | None:
        """df as a new run."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/runs/{name}")
        return self.run(name)

    def run(self, name: str) -> Run | None:
        path = f"{self.path}/runs/{name}"
        fs, p = hadoop(self.spark, path)
        size = fs.getContentSummary(p).getLength()
        rows = self.spark.read.parquet(path).count()  # from the files' footers
        return Run(name, size, rows) if rows else None

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.smallest, self.fanout))) if run.bytes > self.smallest else 0

    def add(self, run: Run | None, schema: StructType) -> Manifest:
        """Commits a run that is already written."""
        while True:
            before = self.manifest()
            if after := self.commit(before, before.runs + ([run] if run else []), schema.json()):
                return after

    def append(self, df: DataFrame) -> Manifest:
        return self.add(self.written(df), df.schema)

    def append_split(self, df: DataFrame, by: str) -> list[Manifest]:
        """An arrival for each value of column by (which must start with no underscore), all written by one job, committed in order.

        Without any row it is one empty arrival.
        """
        schema = df.drop(by).schema
        stage = uuid.uuid4().hex
        df.write.partitionBy(by).parquet(f"{self.path}/runs/{stage}")
        fs, p = hadoop(self.spark, f"{self.path}/runs/{stage}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [self.add(self.run(f"{stage}/{n}"), schema) for n in names] or [self.add(None, schema)]

    def compact(self) -> Manifest:
        """Merges, lowest tier first, until no tier holds fanout runs."""
        while True:
            before = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in before.runs:
                tiers.setdefault(self.tier(r), []).append(r)
            full = min((t for t, rs in tiers.items() if len(rs) >= self.fanout), default=None)
            if full is None:
                return before
            chosen = tiers[full]
            size = sum(r.bytes for r in chosen)
            rows = sum(r.rows for r in chosen)
            merged = self.spark.read.parquet(*[f"{self.path}/runs/{r.name}" for r in chosen])
            files = max(1, round(size / self.target))
            if merged.rdd.getNumPartitions() > files:
                merged = merged.coalesce(files)
            name = uuid.uuid4().hex
            most = -(-3 * rows // (2 * files))  # tasks differ somewhat: no file is cut for that, none is over 1.5 targets
            merged.write.option("maxRecordsPerFile", max(1, most)).parquet(f"{self.path}/runs/{name}")
            made = self.run(name)
            if made.rows != rows:
                raise RuntimeError("a merge changed the number of rows")
            names = {r.name for r in chosen}
            while True:  # other writers may have appended meanwhile; runs that we merged must still be there
                now = self.manifest()
                if not names <= {r.name for r in now.runs}:
                    break
                if self.commit(now, [r for r in now.runs if r.name not in names] + [made]):
                    break

    def vacuum(self, grace: float = 86_400) -> None:
        """Removes runs that an older version names and the newest does not, and those that no version has named for ``grace`` seconds.

        So a run that another writer has not yet committed stays. No older version can be read afterwards.
        """
        now = self.manifest()
        named = {r.name for r in now.runs}
        dead = {r.name for v in range(1, now.version) for r in self.manifest(v).runs} - named
        fs, p = hadoop(self.spark, f"{self.path}/runs")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            inner = {f"{name}/{x.getPath().getName()}": x for x in fs.listStatus(s.getPath()) if x.isDirectory()} or {name: s}
            for n, status in inner.items():
                if n in dead or n not in named and status.getModificationTime() < 1000 * (time.time() - grace):
                    fs.delete(hadoop(self.spark, f"{self.path}/runs/{n}")[1], True)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found.runs:
            if found.schema is None:
                raise ValueError("nothing was ever appended to the table")
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found.schema)))
        return self.spark.read.parquet(*[f"{self.path}/runs/{r.name}" for r in found.runs])


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals of documents, appended and compacted; the rows of the last version, with a digest of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = Table(spark, fresh(spark, "shards"))
    by = "arrival"
    while by in {c.lower() for c in docs.columns}:
        by += "_"
    table.append_split(docs.withColumn(by, F.pmod(F.xxhash64("doc_id"), F.lit(8))), by)
    table.compact()
    table.vacuum()
    return table.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source", "n_chars")


OP4_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents"
