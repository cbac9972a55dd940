"""SimHash near-duplicates through BK-trees.

A fingerprint is one or more 64-bit words; the first takes the XXH64 (seed 42) of every word shingle and
sets a bit where over half of the hashes have it, further ones do so with these hashes mixed anew. Distinct fingerprints are dealt to shards by bands of
bits, so that each shard holds those that agree in a band. In each shard a BK-tree (children keyed by
integer Hamming distance to the parent) is searched with every member, following only edges within the
radius of the distance; all trees of a task are built and searched together, level by level, in numpy.
A shard hands on a star of links to the smallest member of each of its components, never its pairs, and
components across shards come from alternating large-star and small-star steps over written tables.

Shards instead of one broadcast tree: a tree over all fingerprints grows with the data, and so do its
searches (measured figures are in the README). A shard is a task's own tree.

``bands`` bands of one word each at radius below ``bands`` lose nothing (pigeonhole). Shards of over ``hot``
members are dealt anew by sub-bands of the other bits, with the same guarantee. What is still over ``hot``, of one word or many, is
divided by ``spread``: members near one chosen pivot are linked to it, and all pairs that this leaves open are dealt as pairs of blocks.
With more words the bands
find pairs up to a similarity with a stated probability (``plan``, the same for every number of documents), except sets of so few shingles that a near copy
is the set less one of them (``small``): these are joined by sums of their hashes, and none is missed. ``near_deduplicated``
takes what both link as candidates, and links by the exact Jaccard similarity of the shingle sets (``verified``).

Cases: null and empty texts have fingerprint zero and link like any other; rows with equal texts are one
fingerprint; ids may repeat or be null (a component's id is its smallest id that is not null).
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from ._text import byte_list, chunks, mix

SEED = 42
HOT = 4096
#: Pairs of a query and a member that a search holds at once.
SLICE = 1 << 21
#: Members of a large shard that are tried as its pivot.
PIVOTS = 8
#: Bits of a band and words that a tree compares, of fingerprints of many words.
BAND_BITS = 16
TREE = 3
BLOCK_BYTES = 4 << 20
SUMS = 0x5EED


def shingles(text: bytes, k: int, distinct: bool = False) -> list[bytes]:
    """Word shingles of a text: A-Z lowered, words between ASCII space characters, joined by a space."""
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    out = [b" ".join(w) for w in zip(*(words[i:] for i in range(k)), strict=False)]
    return list(set(out)) if distinct else out


def hashed(said: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in said], "<u8")


def majority(h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A word for each span of h (none is empty): bits that over half of the span's hashes have.

    Every eighth bit of a hash is in a byte of its own, so sums of up to 255 hashes count eight bits at once.
    """
    spans = -(-sizes // 255)
    lead = np.cumsum(spans) - spans
    start = np.repeat(first, spans) + 255 * (np.arange(spans.sum()) - np.repeat(lead, spans))
    ones = np.empty((len(sizes), 8, 8), np.int32)
    for k in range(8):
        part = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), start).view(np.uint8).reshape(-1, 8)
        ones[:, :, k] = part if len(part) == len(sizes) else np.add.reduceat(part, lead, axis=0, dtype=np.int32)
    return np.packbits(2 * ones.reshape(-1, 64) > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(texts: list[bytes], k: int = 3, words: int = 1, distinct: bool = False, most: int = 0, sums: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A row of uint64 words for each text.

    sums is filled for each text of at most ``most`` shingles: the sum of its mixed hashes, and the sum without each of them.
    """
    out = np.zeros((len(texts), words), np.uint64)
    for a, b in chunks(texts, 1 << 19):
        said = [shingles(t, k, distinct) for t in texts[a:b]]
        sizes = np.array([len(s) for s in said])
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        first = (np.cumsum(sizes) - sizes)[some]
        base = hashed(s for own in said for s in own)
        if most and sums is not None:
            mixed = mix(base, SUMS)
            for i, at in zip(some.tolist(), first.tolist(), strict=True):
                if sizes[i] <= most:
                    own = mixed[at : at + sizes[i]]
                    sums[a + i] = own.sum() - np.r_[np.uint64(0), own]
        for w in range(words):
            out[a + some, w] = majority(mix(base, w) if w else base, first, sizes[some])
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, words: int = 1, distinct: bool = False, also: str | None = None, most: int = 0) -> DataFrame:
    """doc_id and fp (array of long) of each row, and the long column ``also``; sums (array of long, empty for larger sets) if ``most``."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            fp = fingerprint(byte_list(batch.column(1)), k, words, distinct, most, sums).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fp.size + 1, words, dtype=np.int32)), pa.array(fp.ravel()))
            cols, fields = [batch.column(0), lists, *batch.columns[2:]], [("doc_id", batch.column(0).type), ("fp", kind), *list(batch.schema)[2:]]
            if most:
                sizes = [len(sums.get(i, ())) for i in range(batch.num_rows)]
                flat = np.concatenate([np.zeros(0, np.uint64), *sums.values()]).view(np.int64)  # in the order of the rows
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat)))
                fields.append(("sums", kind))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([also] if also else []))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp array<long>" + (f", {also} long" if also else "") + (", sums array<long>" if most else ""))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """BK-trees of several shards at once. fp: members x words, those of a shard together; the first of a shard is its root."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.root = np.zeros(n, np.int64)
        if not n:
            return
        start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(start, np.diff(np.r_[start, n]))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        loose = np.flatnonzero(self.root != np.arange(n))
        at = self.root[loose]
        while len(loose):
            d = distance(fp[loose], fp[at])
            key = at * 65536 + d
            order = np.argsort(key, kind="stable")
            loose, key = loose[order], key[order]
            lead = np.r_[True, key[1:] != key[:-1]]
            new = loose[lead]
            parent[new], edge[new] = key[lead] // 65536, key[lead] % 65536
            at = np.repeat(new, np.diff(np.r_[np.flatnonzero(lead), len(loose)]))[~lead]
            loose = loose[~lead]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65536 + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def links(self, radius: int):
        """Yields (query, found) pairs within radius, query > found, for slices of queries of about ``SLICE`` pairs."""
        size = np.bincount(self.root, minlength=len(self.fp))[self.root] if len(self.fp) else np.zeros(0, np.int64)
        piece = np.cumsum(size) // SLICE
        cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else np.zeros(0, np.int64)
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            q = np.arange(start, end)
            node = self.root[q]
            while len(q):
                nq, nn = [], []
                for c in range(0, len(q), 1 << 18):
                    cq, cn = q[c : c + (1 << 18)], node[c : c + (1 << 18)]
                    d = distance(self.fp[cq], self.fp[cn])
                    near = (d <= radius) & (cn < cq)
                    if near.any():
                        yield cq[near], cn[near]
                    lo = np.searchsorted(self.key, cn * 65536 + np.maximum(d - radius, 0))
                    hi = np.searchsorted(self.key, cn * 65536 + d + radius, "right")
                    n = hi - lo
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    nq.append(np.repeat(cq, n))
                    nn.append(self.child[np.repeat(lo, n) + step])
                q, node = np.concatenate(nq), np.concatenate(nn)

    def components(self, radius: int) -> np.ndarray:
        """The smallest member of each member's component."""
        label = np.arange(len(self.fp))
        for q, f in self.links(radius):
            while True:
                a, b = label[q], label[f]
                apart = a != b
                if not apart.any():
                    break
                a, b, q, f = a[apart], b[apart], q[apart], f[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while True:
                    jump = label[label]
                    if (jump == label).all():
                        break
                    label = jump
        return label


def apart(fp: Column, other: Column, words: int) -> Column:
    """Differing bits."""
    return sum((F.bit_count(fp[w].bitwiseXOR(other[w])) for w in range(words)), F.lit(0))


def spread(base: DataFrame, radius: int, words: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """base (key, fp, shard) with no shard of over ``hot`` members, and links that this has found; nothing is lost.

    Of each larger shard a few members are tried as pivot, and the one with most members within the radius is taken. These are one
    component, by links to the pivot. All other pairs of the shard are one of the rest with one of the rest, or with one near the
    pivot: both kinds are dealt as pairs of blocks. A shard that one group of copies fills so costs about its members, not their square.
    """
    large = written(base.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("shard"), "large")
    if large.isEmpty():
        return base, None
    held = written(base.join(large, "shard", "left_semi"), "hot")
    tried = F.array(*[F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("turn"), F.col("key").alias("pivot"), F.col("fp").alias("at")))  for i in range(PIVOTS)])
    tried = written(held.groupBy("shard").agg(tried.alias("tried")), "tried")
    met = held.join(tried, "shard").select("shard", F.posexplode(F.transform("tried", lambda t: (apart(F.col("fp"), t["at"], words) <= radius).cast("long"))).alias("i", "near"))
    best = met.groupBy("shard", "i").agg(F.sum("near").alias("near"), F.count("*").alias("n")).groupBy("shard").agg(F.max(F.struct("near", "i", "n")).alias("best"))
    half = max(1, hot // 2)
    blocks = lambda n: F.ceil(n / half).cast("int")
    best = best.join(tried, "shard").select("shard", F.col("tried")[F.col("best.i")].alias("p"), blocks(F.col("best.near")).alias("near_blocks"), blocks(F.col("best.n") - F.col("best.near")).alias("rest_blocks"))
    told = held.join(written(best, "pivots"), "shard").withColumn("near", apart(F.col("fp"), F.col("p.at"), words) <= radius)
    told = written(told.select("key", "fp", "shard", "near", "p.pivot", "rest_blocks", "near_blocks"), "told")
    dealt = in_blocks(told, "shard", "key", "fp").select("key", "fp", F.col("grp").alias("shard"))
    return base.join(large, "shard", "left_anti").select("key", "fp", "shard").unionByName(dealt), told.where("near and key <> pivot").select(F.greatest("key", "pivot").alias("u"), F.least("key", "pivot").alias("v"))


def in_blocks(told: DataFrame, of: str, *columns: str) -> DataFrame:
    """columns and grp of all groups in which pairs are still to be compared: the rest's blocks with each other, and with those near the pivot.

    told: a row a member, with near, near_blocks and rest_blocks of its ``of``; blocks go by hash of the key.
    """
    own = F.pmod(F.xxhash64("key", F.lit("block")), F.when(F.col("near"), F.col("near_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    many = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    to_rest = F.when(F.col("rest_blocks") > 0, F.transform(many("rest_blocks"), lambda j: F.when(F.col("near"), pair(1, F.col("b"), j)).otherwise(pair(0, F.least("b", j), F.greatest("b", j)))))
    to_near = F.when(~F.col("near") & (F.col("near_blocks") > 0), F.transform(many("near_blocks"), lambda i: pair(1, i, F.col("b"))))
    none = F.expr("cast(array() as array<struct<kind:int,i:int,j:int>>)")
    dealt = told.withColumn("b", own).select(of, *columns, F.explode(F.concat(F.coalesce(to_rest, none), F.coalesce(to_near, none))).alias("g"))
    return dealt.select(*columns, F.xxhash64(of, "g.kind", "g.i", "g.j").alias("grp"))


def linked(distinct: DataFrame, words: int, band_bits: int, radius: int, tree: int = 1, hot: int = HOT) -> DataFrame:
    """(u, v): members of one component of a shard, as stars to its member of the smallest key.

    distinct: key (long) and fp (array of long), one row for each fingerprint; trees compare the first ``tree`` words.
    """
    per = 64 // band_bits
    mask = (1 << band_bits) - 1
    base = distinct.select("key", F.slice("fp", 1, tree).alias("fp"), F.explode(F.array(*[F.array(F.lit(w * per + b), F.shiftrightunsigned(F.col("fp")[w], b * band_bits).bitwiseAND(F.lit(mask)).cast("int")) for w in range(words) for b in range(per)])).alias("shard"))
    base = base.select("key", "fp", F.xxhash64("shard").alias("shard"), F.col("shard")[0].alias("band"))
    if words == 1 and radius < per:
        large = written(base.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("shard", F.lit(True).alias("large")), "large")
        dealt = base.join(large, "shard", "left")
        # the other bits, closed up, in radius + 1 parts: two fingerprints that agree in the band agree in one of them
        fp, at = F.col("fp")[0], (F.col("band") * band_bits).cast("int")
        below = fp.bitwiseAND(F.expr(f"shiftleft(1L, int(band * {band_bits})) - 1"))
        above = F.when(at + band_bits >= 64, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(fp[0], int(band * {band_bits}) + {band_bits}), int(band * {band_bits}))"))
        rest = below.bitwiseOR(above)
        part = (64 - band_bits) // (radius + 1)
        sub = F.array(*[F.xxhash64("shard", F.lit(k), F.shiftrightunsigned(F.col("rest"), k * part).bitwiseAND(F.lit((1 << part) - 1) if k < radius else F.lit(-1).cast("long"))) for k in range(radius + 1)])
        dealt = dealt.withColumn("rest", rest)
        base = dealt.select("key", "fp", F.explode(F.when(F.col("large"), sub).otherwise(F.array("shard"))).alias("shard"))
    base, found = spread(base.select("key", "fp", "shard"), radius, tree, hot)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(key, fp, shard):
            found = Forest(fp, shard).components(radius)
            own = np.flatnonzero(found != np.arange(len(found)))
            return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(key[found[own]])], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.stack([batch.column(2 + w).to_numpy().view(np.uint64) for w in range(tree)], 1)
            held.append((batch.column(0).to_numpy(), fp, batch.column(1).to_numpy()))
            if held[-1][2][-1] == held[0][2][0] or sum(len(x[0]) for x in held) < 20_000:
                continue
            key, fp, shard = (np.concatenate([x[i] for x in held]) for i in range(3))
            cut = np.flatnonzero(shard[1:] != shard[:-1])
            cut = cut[-1] + 1 if len(cut) else 0  # the last shard may go on in the next batch
            if cut:
                yield solve(key[:cut], fp[:cut], shard[:cut])
            held = [(key[cut:], fp[cut:], shard[cut:])]
        if held:
            yield solve(*(np.concatenate([x[i] for x in held]) for i in range(3)))

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = base.select("key", "shard", *[F.col("fp")[w].alias(f"w{w}") for w in range(tree)]).repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(run, "u long, v long")
    return (links.unionByName(found) if found is not None else links).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest vertex of u's component, for all vertices but the smallest themselves. edges: (u, v) in any order.

    The minima are written before they are joined: a join with an aggregate keeps the aggregate's partitions, and all edges of a
    vertex that links a large share of the rows would be one task; between two exchanges Spark splits such a partition.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:  # settles after steps in the order of the square of the logarithm of a component's size
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def members(star: DataFrame) -> DataFrame:
    """(key, root) of each vertex of a star, its root too; no join on the root, which may be that of a large share of all rows."""
    return star.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def least_of(one: DataFrame, star: DataFrame) -> DataFrame:
    """(key, component_id): the smallest ``first`` in each key's component. Vertices without a link join nothing on the root.

    The minima are written before they are joined, so that Spark can split the rows of a root that a large share of them has.
    """
    placed = written(one.join(members(star), "key", "left"), "placed")
    linked_ = placed.where("root is not null")
    least = written(linked_.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return placed.where("root is null").select("key", F.col("first").alias("component_id")).unionByName(linked_.join(least, "root").select("key", "component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, words: int = 1, band_bits: int = 16, radius: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    rows = written(fingerprints(docs, id_col, text_col, k, words, distinct), "simhash")
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    one = written(one.select("fp", "first", (F.col("fp")[0] if words == 1 else F.xxhash64("fp")).alias("key")), "distinct")
    star = stars(linked(one.select("key", "fp"), words, band_bits, radius))
    least = one.select("key", "fp").join(least_of(one.select("key", "first"), star), "key")
    return rows.join(least.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def small(similarity: float) -> int:
    """The largest size of sets of which any two different ones with that Jaccard similarity are one and the same less one member.

    Two sets of m that share all but one each have (m - 1) / (m + 1), the most of all other pairs up to m.
    """
    return min(32, math.ceil((1 + similarity) / max(1 - similarity, 1e-3) - 1e-9) - 1)


def less_one(one: DataFrame) -> DataFrame:
    """(u, v): u's shingles are v's and one more, for all such pairs. one: key and sums, one row for each fingerprint."""
    whole = one.where(F.size("sums") > 0).select(F.col("sums")[0].alias("sum"), F.col("key").alias("v"))
    less = one.where(F.size("sums") > 1).select(F.col("key").alias("u"), F.explode(F.expr("slice(sums, 2, size(sums) - 1)")).alias("sum"))
    return less.join(whole.hint("merge"), "sum").select("u", "v")  # both grow with the documents: never broadcast


def odds(n: int) -> np.ndarray:
    """The chances of 0 to n ones among n bits."""
    return np.array([math.comb(n, x) / 2**n for x in range(n + 1)])


def differing(a: int, b: int, both: int) -> float:
    """The probability that a bit differs between sets of a and b hashes that share some: it is 1 where over half of a set's are 1."""

    def over(own: int, size: int) -> np.ndarray:
        tail = np.r_[np.cumsum(odds(own)[::-1])[::-1], 0]
        return tail[np.clip(size // 2 + 1 - np.arange(both + 1), 0, own + 1)]

    one, two = over(a - both, a), over(b - both, b)
    return float((odds(both) * (one * (1 - two) + two * (1 - one))).sum())


@cache
def worst(similarity: float, sizes: int = 200) -> float:
    """The largest probability that a bit differs between sets of at least that Jaccard similarity, beyond those of ``small``.

    Exact up to a size; beyond it acos(2j / (1 + j)) / pi, which large sets of one size come to. Sets of few members are
    above that, as a tie counts as 0.
    """
    out = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for a in range(1, sizes + 1):
        for b in range(a, math.floor(a / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if b > small(similarity) and both <= a:
                out = max(out, differing(a, b, both))
    return out


def plan(similarity: float = 0.8, recall: float = 0.99, band_bits: int = BAND_BITS, tree: int = TREE) -> tuple[int, int]:
    """(words, radius): as many words as the recall at that Jaccard similarity takes with bands of ``band_bits`` bits.

    The radius, over the first ``tree`` words, is three standard errors beyond the expected distance of the pair of ``worst``, which 0.998 of such pairs are
    within; to agree in a band and to be near favour each other, so the product of both chances is a lower bound of the recall.
    """
    differ = worst(similarity)
    bands = math.log(1 - recall / 0.998) / math.log(1 - (1 - differ) ** band_bits)
    words = max(tree, math.ceil(bands / (64 // band_bits)))
    return words, round(64 * tree * differ + 3 * math.sqrt(64 * tree * differ * (1 - differ)))


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest member of each set's component under Jaccard similarity of at least ``similarity``. sets: distinct hashes.

    A flood: each member that is reached is held against all that are not yet, at once.
    """
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(s) for s in sets])
    if n < 2:
        return label
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    flag = np.zeros(len(token) + 1, bool)
    left = np.arange(n)
    flat, where = token, np.repeat(np.arange(n), sizes)  # tokens of the members that are left, and their places in left
    while len(left):
        front, seed = [left[0]], left[0]
        reached = np.zeros(len(left), bool)
        reached[0] = True
        while front:
            x = front.pop()
            flag[own := token[start[x] : start[x] + sizes[x]]] = True
            both = np.bincount(where, flag[flat], len(left))
            flag[own] = False
            new = ~reached & (both >= similarity * (sizes[left] + sizes[x] - both) - 1e-9) & ((sizes[left] > 0) | (sizes[x] == 0))
            front += left[new].tolist()
            label[left[new]] = seed
            reached |= new
            if reached.mean() > 0.5 or not front:
                keep = ~reached
                place = np.cumsum(keep) - 1
                stay = keep[where]
                flat, where, left, reached = flat[stay], place[where[stay]], left[keep], np.zeros(keep.sum(), bool)
                if not len(left):
                    break
    return label


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return np.unique(hashed(shingles(text, k, True)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes; 1 for two empty sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def around_pivots(met: DataFrame, large: DataFrame, k: int, similarity: float, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(members of large components in groups of pairs to be compared, links of those near their component's pivot).

    The pivot is, of a few members, the one that most of them are similar to. A component that one text's copies fill so costs about its members.
    """
    held = written(met.join(large, "root", "left_semi"), "held")
    few = held.groupBy("root").agg(F.array(*[F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("turn"), "key", "text")) for i in range(2 * PIVOTS)]).alias("few"))

    def best(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, texts = [], []
            for own in batch.column(1):
                said = {x["key"]: x["text"] for x in own.as_py()}
                sets = {key: shingle_set(unpack(t), k) for key, t in said.items()}
                keys.append(max(sorted(sets), key=lambda x, sets=sets: sum(jaccard(sets[x], y) >= similarity - 1e-9 for y in sets.values())))
                texts.append(said[keys[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["root", "pivot", "pivot_text"])

    pivots = written(few.mapInArrow(best, "root long, pivot long, pivot_text binary"), "pivots")
    fields = ["root", "key", "text", "size", "pivot"]

    def compared(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for text, pivot, pivot_text in zip(batch.column(2), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if pivot != now:
                    now, own = pivot, shingle_set(unpack(pivot_text.as_py()), k)
                near.append(jaccard(own, shingle_set(unpack(text.as_py()), k)) >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near, pa.bool_())], names=[*fields, "near"])

    told = written(held.join(pivots, "root").select(*fields, "pivot_text").mapInArrow(compared, "root long, key long, text binary, size long, pivot long, near boolean"), "told")
    blocks = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, F.col("size")).otherwise(0)) / (block_bytes / 2)).cast("int")
    many = lambda near: F.max((F.col("near") == near).cast("int"))
    size = written(told.groupBy("root").agg(F.greatest(blocks(True), many(True)).alias("near_blocks"), F.greatest(blocks(False), many(False)).alias("rest_blocks")), "blocks")
    links = told.where("near and key <> pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v"))
    return in_blocks(told.join(size, "root"), "root", "key", "text"), links


def verified(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str, k: int, similarity: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v): links between fingerprints of one candidate component whose shingle sets are as similar as that, as stars of smaller components.

    placed: key, root (the candidate component), doc_id and tie (id and text hash of the key's representative), of components with
    over one member. Their texts move compressed. Of a component of over ``block_bytes`` of text the members similar to one pivot are linked to it;
    the others are cut into blocks by hash, and each pair of blocks is a group of its own, so every pair of members that this leaves open
    meets in some group and no group is unbounded.
    """

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            texts = byte_list(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([pack(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["own_id", "own_tie", "text", "size"])

    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("own_tie"))
    texts = texts.mapInArrow(packed, f"own_id {docs.schema[id_col].dataType.simpleString()}, own_tie long, text binary, size long")
    met = texts.join(placed.hint("merge"), (F.col("tie") == F.col("own_tie")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("root", "key", "text", "size")
    met = written(met.dropDuplicates(["root", "key"]), "candidates")  # rows may repeat a representative
    large = written(met.groupBy("root").agg(F.sum("size").alias("size")).where(F.col("size") > block_bytes).select("root"), "large")
    dealt, found = met.select("key", "text", F.xxhash64("root").alias("grp")), None
    if not large.isEmpty():
        split, found = around_pivots(met, large, k, similarity, block_bytes)
        dealt = met.join(large, "root", "left_anti").select("key", "text", F.xxhash64("root").alias("grp")).unionByName(split)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        group, keys, sets = None, [], []
        u, v = [], []

        def solve():
            label = similar(sets, similarity)
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                u.append(keys[i])
                v.append(keys[label[i]])

        for batch in batches:
            for key, text, grp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if grp != group:
                    solve()
                    group, keys, sets = grp, [], []
                keys.append(key)
                sets.append(shingle_set(unpack(text.as_py()), k))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=out)
            u, v = [], []
        solve()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=out)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "grp").sortWithinPartitions("grp", "key").mapInArrow(run, "u long, v long")
    return links.unionByName(found) if found is not None else links


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, recall: float = 0.99, band_bits: int = BAND_BITS) -> DataFrame:
    """doc_id and component_id of each row: texts of exact Jaccard similarity ``similarity`` or more are linked.

    Candidates come from the trees, with the recall of ``plan``, and all pairs of ``small`` sets from ``less_one``; texts of one fingerprint (over a thousand equal bits) count as equal.
    ``band_bits`` trades fewer members of a shard for more bands; the recall is the same.
    """
    words, radius = plan(similarity, recall, band_bits)
    made = fingerprints(docs.withColumn("__tie", text_hash(text_col)), id_col, text_col, k, words, True, "__tie", small(similarity))
    rows = written(made.withColumn("key", F.xxhash64("fp")).withColumnRenamed("__tie", "tie"), "simhash")
    one = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("rep"), F.first("fp").alias("fp"), F.first("sums").alias("sums"))
    one = written(one.select("key", "fp", "sums", "first", "rep.doc_id", "rep.tie"), "distinct")
    member = members(stars(linked(one.select("key", "fp"), words, band_bits, radius, TREE).unionByName(less_one(one))))
    star = stars(verified(docs, one.join(member, "key").select("key", "root", "doc_id", "tie"), id_col, text_col, k, similarity))
    least = least_of(one.select("key", "first"), star)
    return rows.select("doc_id", "key").join(least, "key").select("doc_id", "component_id")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies (word shingles of k, Jaccard similarity of ``similarity`` or more): the one of the smallest id.

    Of rows that share that id too, one stays; rows whose id is null are kept with a group only if it has no other id.
    """
    found = near_components(docs, id_col, text_col, k, similarity)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    # the ids that stay grow with the documents: never broadcast them, at any size
    kept = written(kept.select(F.col("doc_id").alias("__keep"), "n"), "kept").hint("merge")
    out = docs.join(kept.select("__keep"), docs[id_col].eqNullSafe(F.col("__keep")), "left_semi")
    again = kept.where("n > 1").select("__keep")
    if again.isEmpty():
        return out
    repeated = out.join(again, out[id_col].eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates([id_col])
    return out.join(again, out[id_col].eqNullSafe(F.col("__keep")), "left_anti").unionByName(repeated)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
