"""I-Match fingerprints: terms of a band of inverse document frequency, hashed through randomised lexicons.

The lexicon holds the terms whose document frequency lies in [``low`` x N, ``high`` x N]. As a text has A
distinct terms on average, at most A / ``low`` terms qualify however many texts there are, so the lexicon
has a proven bound and is broadcast. It is counted before it is collected: texts of so many terms that it exceeds ``most_terms`` (eight bytes
each; over 2,000 distinct terms a text on average with the values given) are an error that says which parameter to raise. Sub-lexicon j keeps a term with probability
2**-d for a random but fixed choice by hash; over all j, d runs through ``DEPTHS``, so that both short and
long texts have sub-lexicons that hold few of their terms. A text's distinct kept terms are sorted and
hashed, once for each sub-lexicon; the fingerprint is the row of these 16-bit hashes in hex (zeros: no
term is kept). The likeness of two fingerprints is the share of sub-lexicons with equal hashes among those
where either has one; equal fingerprints have likeness 1.

Cases: null texts are empty; a text without kept terms has a fingerprint of zeros; rows with equal ids are
ordered by a hash of the text; the last text is followed by the first; a single text is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from ._text import Words, byte_list, chunks, distinct_terms, mix

LOW, HIGH = 1e-4, 0.1
#: Depths of the sub-lexicons, each of probability 2**-d: few for texts of a handful of terms, five of each for longer ones.
DEPTHS = [0, 1, 2, *[*range(3, 12)] * 5]
MOST_TERMS = 20_000_000


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): over all texts; each task adds up its own terms before the shuffle."""
    out = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            terms, where = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            texts = byte_list(batch.column(0))
            for a, b in chunks(texts):
                _, h = distinct_terms(Words(texts[a:b]))
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], schema=out)
                    held = []
                size = sum(len(t) for t, _ in held)
        if held:
            terms, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], schema=out)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, most_terms: int = MOST_TERMS) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    kept = written(document_frequencies(docs, text_col).where((F.col("df") >= max(1, low * n)) & (F.col("df") <= max(1, high * n))).select("term"), "lexicon")
    terms = kept.count()
    if terms > most_terms:
        raise ValueError(f"the band holds {terms} terms: raise low, or most_terms if each executor has {8 * terms >> 20} MB for them")
    return np.sort(kept.toArrow().column(0).to_numpy().view(np.uint64))


def fingerprint(texts: list[bytes], terms: np.ndarray) -> np.ndarray:
    """A row of 16-bit hashes for each text."""
    out = np.zeros((len(texts), len(DEPTHS)), np.uint16)
    for a, b in chunks(texts):
        d, h = distinct_terms(Words(texts[a:b]))
        if len(terms) and len(h):
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            keep = terms[at] == h
            d, h = d[keep], h[keep]
        else:
            d, h = d[:0], h[:0]
        for j, depth in enumerate(DEPTHS):
            own = mix(h, 0x5851F42D4C957F2D * (j + 1) % (1 << 64))
            keep = (own >> np.uint64(53)) >> np.uint64(11 - depth) == 0
            dj, own = d[keep], own[keep]
            if not len(dj):
                continue
            first = np.flatnonzero(np.r_[True, dj[1:] != dj[:-1]])
            with np.errstate(over="ignore"):
                # terms are sorted and distinct: rank within the text, then a positional sum
                rank = np.arange(len(dj)) - np.repeat(first, np.diff(np.r_[first, len(dj)]))
                total = np.add.reduceat(mix(own, j + 1) * (rank.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first)
            out[a + dj[first], j] = np.maximum((mix(total) >> np.uint64(48)).astype(np.uint16), 1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    some = ((x != 0) | (y != 0)).sum(1)
    same = ((x == y) & (x != 0)).sum(1)
    return np.where((x == y).all(1), 1.0, same / np.maximum(some, 1))


def hexed(x: np.ndarray) -> list[str]:
    flat = x.astype(">u2").tobytes().hex()
    n = 4 * x.shape[1]
    return [flat[i * n : i * n + n] for i in range(len(x))]


def raw(x: np.ndarray) -> pa.Array:
    """Rows as bytes: half the size of hex in files."""
    flat, n = x.astype(">u2").tobytes(), 2 * x.shape[1]
    return pa.array([flat[i * n : i * n + n] for i in range(len(x))], pa.binary())


def edited(text: str, after: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of after, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id and fingerprint of each row."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text_col, low, high))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexed(fingerprint(byte_list(batch.column(1)), terms.value)), pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness to each other and to the next text's.

    The texts are range-partitioned and sorted by id once. A partition's last text needs the first of the
    next partition that has rows: only these edge texts, one or two for each partition, move again. Texts
    are compressed one by one before they move, which halves the shuffle.
    """
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text_col, low, high))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in byte_list(batch.column(1))], pa.binary()), batch.column(2)], names=["doc_id", "text", "tie"])

    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(packed, "doc_id long, text binary, tie long")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "tie")
    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, edge_first string, edge_last string, edge_id long"
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge_first", pa.string()), ("edge_last", pa.string()), ("edge_id", pa.int64())])

    def judged(ids, texts, extra):
        """Rows for texts[:-1]; extra: what stands in the last four columns."""
        own = fingerprint([t.encode() for t in texts], terms.value)
        changed = [edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
        other = fingerprint(changed, terms.value)
        n = len(changed)
        return pa.RecordBatch.from_arrays([pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(c).digest() for c in changed], pa.binary()), raw(own[:n]), raw(other), pa.array(likeness(own[:n], other)), pa.array(likeness(own[:n], own[1:])), *[pa.array([v] * n, t) for v, t in zip(extra, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)]], schema=out)

    def run(batches):
        part, ids, texts, first = TaskContext.get().partitionId(), [], [], None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            new_ids, new = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(new):  # about 2 million characters at a time
                size, end = 0, at
                while end < len(new) and (end == at or size < 2_000_000):
                    texts.append(unpack(new[end].as_py()).decode())
                    size += len(texts[-1])
                    end += 1
                ids += new_ids[at:end]
                first = texts[0] if first is None else first
                if len(texts) > 1:
                    yield judged(ids, texts, (None, None, None, None))
                    ids, texts = ids[-1:], texts[-1:]
                at = end
        if texts:
            blank = [pa.nulls(1, f.type) for f in out][:7]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([part], pa.int32()), pa.array([first]), pa.array([texts[0]]), pa.array(ids, pa.int64())], schema=out)

    def meet(batches):
        for batch in batches:
            for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield judged([i], [a, b], (None, None, None, None))

    made = written(rows.mapInArrow(run, schema), "imatch")
    edges = made.where("part is not null").select("part", "edge_first", "edge_last", "edge_id")
    nonempty = sorted(r.part for r in edges.select("part").collect())  # one small number for each partition
    after = spark.createDataFrame([(a, b) for a, b in zip(nonempty, nonempty[1:] + nonempty[:1], strict=True)], "part int, next_part int")
    pairs = edges.join(after, "part").join(edges.select(F.col("part").alias("next_part"), F.col("edge_first").alias("next_text")), "next_part")
    done = pairs.select("edge_id", "edge_last", "next_text").mapInArrow(meet, schema)
    hex_ = lambda c: F.lower(F.hex(c)).alias(c)
    return made.where("part is null").unionByName(done).select("doc_id", "n_chars", hex_("edited_sha256"), hex_("fingerprint"), hex_("edited_fingerprint"), "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_study(spark.read.parquet(f"{sf_dir}/documents.parquet"))
