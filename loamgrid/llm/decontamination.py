"""Benchmark decontamination: a broadcast set of item windows, scanned over every word window of the documents.

Words are runs of digits, letters a-z (A-Z lowered first) and any character from U+0080. A window is
``window`` consecutive words of an item; an item with fewer words, but not none, is one window. The windows
are broadcast if the benchmark has at most about ``block`` words (its bytes are added up first); a larger one is scanned
in blocks of whole items by hash, one pass over the documents each: the driver holds and broadcasts one block at a time, and the
passes' hits, written by digest of the text, are joined to the documents. Every hash hit is verified word by word. Each word inside a
verified window is hit. (A single item is one block, however long it is.)

Cases: null and empty texts have no words and are clean; rows that repeat give repeated results; an empty
benchmark hits nothing; other columns are never read by the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from ._text import Words, byte_list, chunks, mix

WINDOW = 10
BLOCK = 2_000_000


class Index:
    """Windows of benchmark items: sorted hashes by window length, each with the words' bytes and the items that hold it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = item_words(text)
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                found.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str]]]]]] = {}
        for n in sorted({len(k) for k in found}):
            table: dict[int, list] = {}
            for words in (k for k in found if len(k) == n):
                one = Words([b" ".join(words)])
                table.setdefault(int(rolled(one.hash, n)[0]), []).append((b" ".join(words), sorted(found[words])))
            keys = np.array(sorted(table), np.uint64)
            self.by_length[n] = keys, [table[int(k)] for k in keys]


def item_words(text: bytes | None) -> list[bytes]:
    w = Words([text or b""])
    flat = w.buf.tobytes()
    return [flat[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mix(out)


def scan(texts: list[bytes], index: Index) -> Iterator[tuple[Words, np.ndarray, list[set[str]]]]:
    """For each chunk of texts: its words, a flag for each word that is hit, and each text's items."""
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        mark = np.zeros(len(w.hash) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(b - a)]
        flat = None
        for n, (keys, entries) in index.by_length.items():
            r = rolled(w.hash, n)
            if not len(r) or not len(keys):
                continue
            at = np.searchsorted(keys, r)
            at[at == len(keys)] = 0
            for i in np.flatnonzero((keys[at] == r) & (w.doc[: len(r)] == w.doc[n - 1 :])).tolist():
                flat = flat if flat is not None else w.buf.tobytes()
                said = b" ".join(flat[s:e] for s, e in zip(w.start[i : i + n].tolist(), w.end[i : i + n].tolist(), strict=True))
                for words, ids in entries[at[i]]:
                    if words == said:
                        mark[i] += 1
                        mark[i + n] -= 1
                        items[w.doc[i]].update(ids)
        yield w, np.cumsum(mark[:-1]) > 0, items


def recalled(texts: list[bytes], spans: list[list[dict]], items: list[list[str]]) -> Iterator[tuple[Words, np.ndarray, list[set[str]]]]:
    """As ``scan``, from hits that earlier passes have found."""
    for a, b in chunks(texts):
        w = Words(texts[a:b])
        counts = w.counts()
        first = np.cumsum(counts) - counts
        mark = np.zeros(len(w.hash) + 1, np.int32)
        for d in range(b - a):
            for x in spans[a + d] or ():
                mark[first[d] + x["first"]] += 1
                mark[first[d] + x["after"]] -= 1
        yield w, np.cumsum(mark[:-1]) > 0, [set(x or ()) for x in items[a:b]]


def runs(w: Words, hit: np.ndarray) -> list[list[dict]]:
    """Runs of hit words of each text, as first word and the word after the last."""
    counts = w.counts()
    first = np.cumsum(counts) - counts
    out: list[list[dict]] = [[] for _ in w.texts]
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a run may go on from the end of one text to the start of the next
            d = int(w.doc[a])
            end = min(b, int(first[d] + counts[d]))
            out[d].append({"first": a - int(first[d]), "after": end - int(first[d])})
            a = end
    return out


SPANS = "array<struct<first:long,after:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, block: int) -> tuple[DataFrame, Callable]:
    """docs and a function that gives what ``scan`` does for a batch of its rows and their texts.

    With more than one block docs has two more columns at its end, __spans and __items.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").alias("i"), F.col("text").cast("binary").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block)))
    if blocks == 1:
        held = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in rows.toLocalIterator()], window))
        return docs, lambda batch, texts: scan(texts, held.value)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    own, part, found = docs.select(key.alias("key"), F.col(text_col).alias("text")), F.pmod(F.xxhash64("i", "t"), F.lit(blocks)), []
    for k in range(blocks):
        held = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in rows.where(part == k).toLocalIterator()], window))

        def run(batches, held=held):
            for batch in batches:
                at, keys, spans, items = 0, [], [], []
                for w, hit, names in scan(byte_list(batch.column(1)), held.value):
                    for d, own in enumerate(runs(w, hit)):
                        if own:
                            keys.append(batch.column(0)[at + d].as_py())
                            spans.append(own)
                            items.append(sorted(names[d]))
                    at += len(w.texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["key", "spans", "items"])

        found.append(written(own.mapInArrow(run, f"key string, spans {SPANS}, items array<string>").dropDuplicates(["key"]), "hits"))
        held.destroy()
    every = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    every = written(every, "hits")  # so that Spark can split the rows of a text that a large share of them has
    joined = docs.withColumn("__key", key).join(every.withColumnRenamed("key", "__key"), "__key", "left").select(*docs.columns, "__spans", "__items")
    return joined, lambda batch, texts: recalled(texts, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, joined by commas), contaminated, hit_spans.

    ``hit_spans`` lists runs of hit words as [first word, after the last word).
    """
    base, marks = hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", window, block)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans {SPANS}"

    def run(batches):
        for batch in batches:
            n_words, n_hit, n_items, sha, spans = [], [], [], [], []
            for w, hit, items in marks(batch, byte_list(batch.column(1))):
                n_words += w.counts().tolist()
                n_hit += np.bincount(w.doc[hit], minlength=len(w.texts)).tolist()
                spans += runs(w, hit)
                n_items += [len(x) for x in items]
                sha += [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            own = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    return base.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, drop_from: float = 0.5, block: int = BLOCK) -> DataFrame:
    """docs without hit passages, same columns: spans are cut out; a document of which at least ``drop_from`` of the words are hit is removed.

    Clean documents pass unchanged, byte for byte. ``n_chars``, where there is such a column, follows a cut text.
    """
    base, marks = hits(docs, benchmark, text_col, window, block)
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            where = batch.schema.get_field_index(text_col)
            texts = byte_list(batch.column(where))
            new: dict[int, bytes | None] = {}
            at = 0
            for w, hit, _ in marks(batch, texts):
                counts = w.counts()
                first = np.cumsum(counts) - counts
                for d, own in enumerate(runs(w, hit)):
                    if not own:
                        continue
                    if sum(x["after"] - x["first"] for x in own) >= drop_from * counts[d]:
                        new[at + d] = None
                        continue
                    text, kept, last = w.texts[d], [], 0
                    for x in own:
                        kept.append(text[last : w.start[first[d] + x["first"]] - w.first[d]])
                        last = w.end[first[d] + x["after"] - 1] - w.first[d]
                    new[at + d] = b"".join([*kept, text[last:]])
                at += len(w.texts)
            batch = pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema(list(batch.schema)[:width]))
            if new:
                keep = pa.array([new.get(i, b"") is not None for i in range(len(texts))], pa.bool_())
                cols = list(batch.columns)
                said = cols[where].to_pylist()
                for i, t in new.items():
                    said[i] = t.decode() if t is not None else None
                cols[where] = pa.array(said, cols[where].type)
                n = batch.schema.get_field_index("n_chars")
                if n >= 0:
                    size = cols[n].to_pylist()
                    for i, t in new.items():
                        size[i] = len(t.decode()) if t is not None else None
                    cols[n] = pa.array(size, cols[n].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep)
            yield batch

    return base.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_spans")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS said FROM i),
ns AS (SELECT DISTINCT n FROM iw),
dk AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS said FROM dk),
h AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.said = iw.said),
p AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS at FROM h),
hits AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
names AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM names GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
