"""Secret scan with corpus-wide ownership frequency.

Base spans are what three fixed patterns match (see ``KINDS``). Wider candidates are added: well-known
credential shapes, and long tokens that mix letters and digits at high entropy. Each candidate's value is
hashed; over the whole corpus the distinct owners and repositories that hold the hash are counted (both from
the row's columns; by default its source, and its source and language). A value seen with at least
``wide`` owners or twice as many repositories is a widely copied example; one that stays with fewer is
owner-specific and looks live. Wider candidates become spans only if they are owner-specific; base spans
always stay. Only hashes with owner and repository are shuffled, never texts; each task removes
repeats first, so a value copied a million times costs a row for each task and owner.

The verdicts go back to the rows by a join on the hash of candidates. They are written first, so that both sides of the join are
dealt anew and Spark's skew join can split a value that is in very many rows.

Cases: null texts are empty; null owners count as one owner of their own; rows that repeat give repeated
results but count once; overlapping spans of different kinds are all listed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written

WIDE = 3
#: Fixed base patterns, in the order that spans with one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Fixed wide patterns: public shapes of credentials.
WIDER = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])"),
}
ORDER = {k: i for i, k in enumerate((*KINDS, *WIDER))}
_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)


def entropy(s: str) -> float:
    """Bits a character."""
    counts = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)[1] / max(1, len(s.encode()))
    return float(-(counts * np.log2(counts)).sum()) if len(counts) else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value); matches that are too short are taken, then dropped."""
    out = []
    if _WORDS.search(text):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


_LONG = re.compile(r"[A-Za-z0-9+/_-]{24}")


def wide_spans(text: str) -> list[tuple[str, int, int, str]]:
    out = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end(), m[0]) for m in WIDER["jwt"].finditer(text)]
    if "PRIVATE KEY" in text:
        out += [("pem", m.start(), m.end(), m[0]) for m in WIDER["pem"].finditer(text)]
    if _LONG.search(text):
        out += [("prefixed", m.start(), m.end(), m[0]) for m in WIDER["prefixed"].finditer(text)]
        for m in WIDER["random"].finditer(text):
            s = m[0]
            digits = sum(c.isdigit() for c in s)
            if 0.15 * len(s) <= digits <= 0.85 * len(s) and entropy(s) >= 3.5:
                out.append(("random", m.start(), m.end(), s))
    elif "xox" in text or "sk_" in text:
        out += [("prefixed", m.start(), m.end(), m[0]) for m in WIDER["prefixed"].finditer(text)]
    return out


def digest(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "little", signed=True)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


FOUND = "kind string, start int, end int, hash long"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))


def candidates(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """Columns of keep, with n_assign, n_access, n_hex, base_sha256 and found: all candidate spans with the hash of their value."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = rows.columns[:-1]
    new = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", _FOUND)])

    def run(batches):
        for batch in batches:
            counts, sha, found = [], [], []
            for text in batch.column(len(kept)):
                text = text.as_py() or ""
                base = base_spans(text)
                counts.append([sum(k == kind for k, *_ in base) for kind in KINDS])
                sha.append(hashlib.sha256(listed([x[:3] for x in base]).encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": b, "hash": digest(v)} for k, a, b, v in (*base, *wide_spans(text))])
            own = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)] + [pa.array(sha, pa.string()), pa.array(found, _FOUND)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], schema=pa.schema([*list(batch.schema)[:-1], *new]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>")


def ownership(found: DataFrame, owner: str = "owner", repo: str = "repo", wide: int = WIDE) -> DataFrame:
    """hash, owners, repos, widely_copied: over all candidates. Repeats go before the shuffle, so no group is larger than its owners."""
    one = found.select(F.explode("found").alias("f"), F.coalesce(F.col(owner), F.lit("")).alias("o"), F.coalesce(F.col(repo), F.lit("")).alias("r")).select("f.hash", "o", "r").distinct()
    return one.groupBy("hash").agg(F.countDistinct("o").alias("owners"), F.countDistinct("r").alias("repos")).withColumn("widely_copied", (F.col("owners") >= wide) | (F.col("repos") >= 2 * wide))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, wide: int = WIDE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (string), live: owner-specific spans [kind, start, end]."""
    col = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit("")
    owner = col("source") if owner is None else owner
    repo = F.concat_ws("/", col("source"), col("lang")) if repo is None else repo
    rows = candidates(docs, [F.col(id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo")], text_col)
    rows = written(rows, "secrets")  # few bytes a row: the texts are scanned once
    verdict = written(ownership(rows, wide=wide).where("widely_copied").select("hash", F.lit(True).alias("copied")), "verdict")
    # rows without candidates, nearly all, need no join
    none = rows.where(F.size("found") == 0).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.lit("").alias("spans"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)").alias("live"))
    some = rows.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id())  # read from a written table: stable
    flat = some.select("row", F.explode("found").alias("f")).select("row", "f.*").join(verdict, "hash", "left")
    kept = flat.where(F.col("kind").isin(*KINDS) | F.col("copied").isNull())
    rank = F.create_map(*[F.lit(x) for k, i in ORDER.items() for x in (k, i)])
    lists = kept.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind", F.col("copied").isNotNull().alias("copied")))).alias("s")
    )
    said = lists.select(
        "row",
        F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))).alias("spans"),
        F.transform(F.filter("s", lambda x: ~x["copied"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("live"),
    )
    joined = some.join(said, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("live", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")).alias("live"))
    return none.unionByName(joined)


MOST_COPIED = 1_000_000


def redact(docs: DataFrame, text_col: str = "text", owner: str = "source", repo: str = "lang", wide: int = WIDE, mark: str = "[secret]", most: int = MOST_COPIED) -> DataFrame:
    """docs with owner-specific values replaced by mark, same columns; rows without one pass unchanged.

    The widely copied hashes are broadcast while they number at most ``most`` (counted); beyond, each text
    with candidates gets its own copied hashes by a join on a digest of the text.
    """
    spark = docs.sparkSession
    col = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit("")
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = written(candidates(docs, [col(owner).alias("owner"), F.concat_ws("/", col(owner), col(repo)).alias("repo"), key.alias("key")], text_col).where(F.size("found") > 0), "secrets")
    copied = written(ownership(found, wide=wide).where("widely_copied").select("hash"), "copied")
    small = copied.count() <= most
    held = spark.sparkContext.broadcast({r.hash for r in copied.toLocalIterator()} if small else set())
    schema, rows = docs.schema, docs
    if not small:
        own = found.select("key", F.explode("found.hash").alias("hash")).distinct().join(copied, "hash").groupBy("key").agg(F.collect_set("hash").alias("__copied"))
        own = written(own, "own")
        rows = docs.withColumn("__key", key).join(own.withColumnRenamed("key", "__key"), "__key", "left").select(*docs.columns, "__copied")

    def run(batches):
        for batch in batches:
            also = None if small else batch.column(batch.num_columns - 1).to_pylist()
            batch = batch if small else pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            where, n = batch.schema.get_field_index(text_col), batch.schema.get_field_index("n_chars")
            new: dict[int, str] = {}
            for i, text in enumerate(batch.column(where)):
                text = text.as_py() or ""
                known = held.value if small else set(also[i] or ())
                spans = sorted((a, b) for _, a, b, v in (*base_spans(text), *wide_spans(text)) if digest(v) not in known)
                if spans:
                    out, at = [], 0
                    for a, b in spans:
                        if a >= at:
                            out += [text[at:a], mark]
                        at = max(at, b)
                    new[i] = "".join([*out, text[at:]])
            if new:
                cols = list(batch.columns)
                cols[where] = pa.array([new.get(i, x) for i, x in enumerate(cols[where].to_pylist())], cols[where].type)
                if n >= 0:
                    cols[n] = pa.array([len(new[i]) if i in new else x for i, x in enumerate(cols[n].to_pylist())], cols[n].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return rows.mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("live")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the scan that SQL can express: base spans of each kind by document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return candidates(docs, [F.col("doc_id")]).select("doc_id", "n_assign", "n_access", "n_hex")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASE_SQL = f"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all({_LOWERED}, '(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([a-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""
