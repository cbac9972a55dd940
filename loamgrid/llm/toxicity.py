"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct words and of their stems (the first 4, 5 and 6 bytes of longer words, so that
inflections that training has never seen are known by what they share), each hashed to one of 2**BITS columns. The score is
sigmoid(b + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j): the pairwise part learns that two words
together (an insult and the name of a group) mean more than the sum of both. x_i is 1 for
each column that the text has.

The model is fitted in one task of an executor on at most ``most`` labelled ids, and of these on as many as have ``most_pairs``
(row, column) pairs (both documented bounds; ids are taken by their hash, so the choice is the same in every run and a
lost executor's task gives the same model). Only the columns that count come back to the driver. Scoring is a map over
all rows with the model (fixed size) broadcast. Only the text is an input of a score.

Cases: null and empty texts score the intercept; labels that are null are left out, and of several labels
for one id the largest counts; of several rows of a labelled id, that of the smallest text hash is learned from; without any
label, or with one class only, every score is the share of the positive class (0 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

import contextlib
import ctypes
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, byte_list, chunks

BITS = 20
STEMS = (4, 5, 6)
FACTORS = 4
MOST = 20_000
MOST_PAIRS = 32_000_000
#: Of the fit, the only task of its stage.
THREADS = 4


def columns(texts: list[bytes], bits: int = BITS, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) pairs, sorted, distinct."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        d, h = (np.concatenate(x) for x in zip((words.doc, words.hash), *(words.stems(k) for k in stems), strict=True))
        key = np.unique((d.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
        rows.append((key >> bits) + a)
        cols.append(key & ((1 << bits) - 1))
    return np.concatenate(rows), np.concatenate(cols)


class Machine:
    """b, and w and v (columns x factors) of the sorted columns in ``used``; all other columns have neither."""

    def __init__(self, b: float, used: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.b, self.used, self.w, self.v = b, used, w, v
        self._place: np.ndarray | None = None

    def place(self, cols: np.ndarray) -> np.ndarray:
        """Where each column is in ``used``, or -1. The table is made where it is needed, so that it does not travel."""
        if self._place is None:
            self._place = np.full(1 << BITS, -1, np.int32)
            self._place[self.used] = np.arange(len(self.used))
        return self._place[cols]

    def logits(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        at = self.place(cols)
        rows, at = rows[at >= 0], at[at >= 0]
        v = self.v[at]
        out = self.b + np.bincount(rows, self.w[at], n)
        for f in range(v.shape[1]):
            s = np.bincount(rows, v[:, f], n)
            out += 0.5 * (s * s - np.bincount(rows, v[:, f].astype(np.float64) ** 2, n))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        found = [self.logits(*columns(texts[a:b]), b - a) for a, b in chunks(texts)]  # as nearly all columns count, by pieces
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *found]), -30, 30)))


def summed(pool: ThreadPoolExecutor, values: np.ndarray, at: np.ndarray, edges: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """Sums of values[at] between edges (no span empty), by pieces of about ``size``, so that no copy is as long as at."""
    out, cuts = np.empty((len(edges) - 1, values.shape[1]), np.float32), [0]
    while cuts[-1] < len(out):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edges, edges[cuts[-1]] + size, "right")) - 1))

    def piece(i: int, j: int) -> None:
        np.add.reduceat(np.take(values, at[edges[i] : edges[j]], axis=0), edges[i:j] - edges[i], axis=0, out=out[i:j])

    list(pool.map(piece, cuts[:-1], cuts[1:]))
    return out


def counted(x: np.ndarray, size: int) -> np.ndarray:
    """np.bincount by pieces: it makes a copy of 64-bit numbers."""
    return sum((np.bincount(x[i : i + (1 << 20)], minlength=size) for i in range(0, len(x), 1 << 20)), np.zeros(size, np.int64))


def index_type(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.int32


def by_column(rows: np.ndarray, at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """rows in the order of at, as a stable sort has it; by pieces, as the driver has no room for the order of all."""
    out, free = np.empty_like(rows), edges[:-1].copy()
    for i in range(0, len(at), 1 << 20):
        own = at[i : i + (1 << 20)]
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        out[free[own] + np.arange(len(own)) - np.repeat(first, sizes)] = rows[i : i + (1 << 20)][order]
        free[own[first]] += sizes
    return out


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, bits: int = BITS, factors: int = FACTORS, steps: int = 120, rate: float = 0.1, prior: float = 1.0, least: int = 4, told_from: float = 3.0, quiet: float = 0.1, spend: bool = False) -> Machine:
    """Full-batch Adam on the logistic loss with a Gaussian prior, as strong for few rows as for many.

    All columns in at least ``least`` texts have a weight and factors: none is left out for what it tells alone, as a pair
    may tell what neither of its words does. Those whose count among positive texts is within ``told_from`` standard errors of
    what chance gives have ``quiet`` for x while the machine is fitted (a prior 1 / quiet**2 as strong; w and v take it up). rows are sorted.
    spend: rows and cols may be overwritten, so that the task holds no second copy.
    """
    n = len(y)
    ridge = prior / max(n, 1)
    share = float(y.mean()) if n else 0.0
    used = np.flatnonzero(counted(cols, 1 << bits) >= least).astype(np.int32)
    if not len(used) or not 0 < share < 1:
        return Machine(float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0, used[:0], np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    spot = np.full(1 << bits, -1, np.int32)
    spot[used] = np.arange(len(used))
    at, kept = cols if spend else np.empty(len(cols), np.int32), 0
    rows = rows if spend else rows.astype(index_type(n))
    for i in range(0, len(cols), 1 << 20):
        own = spot[cols[i : i + (1 << 20)]]
        some = own >= 0
        k = int(some.sum())
        rows[kept : kept + k] = rows[i : i + (1 << 20)][some]
        at[kept : kept + k] = own[some]
        kept += k
    rows, at = rows[:kept], at[:kept]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    some, by_row = rows[starts], np.r_[starts, len(at)]
    df = counted(at, len(used))
    by_col = np.r_[0, np.cumsum(df)]
    turned = by_column(rows, at, by_col)
    positive = y > 0
    toxic = sum((np.bincount(at[i : i + (1 << 20)][positive[rows[i : i + (1 << 20)]]], minlength=len(used)) for i in range(0, len(at), 1 << 20)), np.zeros(len(used), np.int64))
    told = np.abs(toxic - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    x = np.where(told >= told_from, 1, quiet).astype(np.float32)[:, None]
    rng = np.random.default_rng(7)
    p = [np.array([np.log(share / (1 - share))]), np.zeros((len(used), 1), np.float32), rng.normal(0, 0.02, (len(used), factors)).astype(np.float32)]
    m1, m2 = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    total = np.zeros((n, factors + 2), np.float32)
    with ThreadPoolExecutor(THREADS) as pool:
        for step in range(1, steps + 1):
            b, wu, vu = p
            xv = x * vu
            total[some] = summed(pool, np.hstack([x * wu, xv, (xv * xv).sum(1, keepdims=True)]), at, by_row)
            sums = total[:, 1:-1]
            z = b[0] + total[:, 0] + 0.5 * ((sums * sums).sum(1) - total[:, -1])
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)[:, None]
            at_x = x * summed(pool, np.hstack([e, e * sums]), turned, by_col)
            gw, gv = at_x[:, :1] + ridge * wu, at_x[:, 1:] - at_x[:, :1] * xv + ridge * vu
            for k, g in enumerate((np.array([e.sum()]), gw, gv)):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p[0][0]), used, (x * p[1])[:, 0].astype(np.float32), (x * p[2]).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def gathered(batches, most_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, columns and labels of batches with y and cols, up to the row with which there are most_pairs pairs."""
    ys, sizes, held = [], [], 0
    cols = np.empty(most_pairs, np.int32)  # only what is filled takes memory
    for batch in batches:
        own = np.diff(batch.column("cols").offsets.to_numpy())
        n = int(np.searchsorted(held + np.cumsum(own), most_pairs, "right"))
        size = int(own[:n].sum())
        ys.append(batch.column("y").to_numpy()[:n].copy())
        sizes.append(own[:n])
        cols[held : held + size] = batch.column("cols").flatten().to_numpy()[:size]
        held += size
        if n < len(own):
            break
    y, sizes = np.concatenate([np.zeros(0), *ys]), np.concatenate([np.zeros(0, np.int64), *sizes])
    return np.repeat(np.arange(len(y), dtype=index_type(len(y))), sizes), cols[:held], y


def give_back() -> None:
    """Memory that is free goes back to the system: Spark uses a worker's process again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST, most_pairs: int = MOST_PAIRS) -> Machine:
    """Fits on labelled ids that are not held out, ``most`` at most, with ``most_pairs`` pairs at most."""
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie")).join(F.broadcast(chosen), "doc_id")

    def featured(batches):
        for batch in batches:
            texts = byte_list(batch.column("text"))
            r, c = columns(texts)
            edges = np.searchsorted(r, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(c.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("tie"), lists], names=["doc_id", "y", "tie", "cols"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.select("doc_id", "y", "tie", "text").mapInArrow(featured, f"doc_id {kind}, y double, tie long, cols array<int>")
    made = made.groupBy("doc_id").agg(F.min(F.struct("tie", "y", "cols")).alias("row")).select(F.xxhash64("doc_id").alias("turn"), "doc_id", "row.y", "row.cols")
    one = made.repartition(1).sortWithinPartitions("turn", "doc_id").select("y", "cols")  # at most ``most`` rows
    out = pa.schema([("b", pa.float64()), ("used", pa.binary()), ("w", pa.binary()), ("v", pa.binary())])

    def fitted(batches):
        m = fit(*gathered(batches, most_pairs), spend=True)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([m.b]), *(pa.array([x.tobytes()], pa.binary()) for x in (m.used, m.w, m.v))], schema=out)

    got = one.mapInArrow(fitted, "b double, used binary, w binary, v binary").first()
    if got is None:  # no labelled row
        return fit(*gathered([], most_pairs))
    return Machine(got.b, np.frombuffer(got.used, np.int32), np.frombuffer(got.w, np.float32), np.frombuffer(got.v, np.float32).reshape(-1, FACTORS))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(byte_list(batch.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            score = held.value.score(byte_list(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
