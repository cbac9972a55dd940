"""URL filter: suffix rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path: it fits its host and all subdomains if the url's path starts with its path; the
longest rule wins. Urls that a rule judges are the labelled ones, and the trees are fitted on them alone, on the driver, on at most ``most``
distinct ones (a documented bound; the smallest hashes, so the choice is the same in every run). Features: lengths, depth, share of digits, entropy, counts of parameters and
separators, and for the url's last host labels and first path part how the labelled urls with them were
judged (smoothed). No url is described by labels of its own site: sites (the last three host labels) are dealt to ``FOLDS`` folds, and a
labelled url's suffix statistics come from the other folds. The trees of the other folds judge each fold, and the
threshold is the lowest at which ``precision`` of what they block there is labelled so; where none reaches it, nothing
is blocked. ``Judge.held_out`` has precision and recall there. Suffix tables and trees are bounded by the sample and are broadcast.

Cases: null urls and urls without ``://`` have an empty host and path, no rule, and are judged by the trees;
rows that repeat are judged alike; without labelled urls, or with one verdict only, the trees give that
verdict (allow if there are none).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 20_000
FOLDS = 4
PRECISION = 0.9
#: Fixed rules of the query, as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(_LOWER), m[2]


class Rules:
    """Looks a url up by the suffixes of its host, not rule by rule."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[2]), r[2])):
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones that with the longer host."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for own, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(own):
                    if best is None or len(rule) > len(best[0]):
                        best = rule, verdict
                    break
        return best


def entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2][len(host) + len(path) :]
    query = rest.partition("#")[0].removeprefix("?") if rest.startswith("?") else ""
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), len([x for x in path.split("/") if x]), digits / max(1, len(url)), sum(c.isdigit() for c in host),
        entropy(url), entropy(host), query.count("&") + bool(query), query.count("="), host.count("."), host.count("-"), path.count("-") + path.count("_"), url.count("%"),
        float(url.startswith("https:")), float("#" in rest), float(bool(re.search(r"\.[A-Za-z0-9]{1,5}$", path))), float(path.endswith("/")),
    ]


def suffixes(host: str, path: str) -> list[str]:
    """Keys of the suffix tables: the last one, two and three host labels, the host, the first path part."""
    labels = host.split(".")
    first = path.split("/")[1] if path.count("/") else ""
    return [".".join(labels[-1:]), ".".join(labels[-2:]), ".".join(labels[-3:]), host, "/" + first, labels[-1] + "/" + first]


class Boosted:
    """Additive trees for the logistic loss, grown level by level over binned features."""

    def __init__(self, base: float, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float):
        self.base, self.edges, self.trees, self.rate = base, edges, trees, rate

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > at[node])
            out += self.rate * value[node - (len(value) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    share = float((w * y).sum() / w.sum()) if len(y) else 0.0
    if not 0 < share < 1:
        return Boosted(30.0 if share == 1 else -30.0, [], [], rate)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = Boosted(float(np.log(share / (1 - share))), edges, [], rate)
    b = model.binned(x)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-6)
        inner = (1 << depth) - 1
        feature, at = np.zeros(inner, np.int64), np.full(inner, bins + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, off = 1 << level, (1 << level) - 1
            key = (b + (np.arange(x.shape[1]) * width + (node - off)[:, None]) * (bins + 1)).ravel()  # feature, node and bin of each row
            shape = (x.shape[1], width, bins + 1)
            gs = np.bincount(key, np.repeat(g, x.shape[1]), np.prod(shape)).reshape(shape)
            hs = np.bincount(key, np.repeat(h, x.shape[1]), np.prod(shape)).reshape(shape)
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            top = gain.argmax(2)
            most = np.take_along_axis(gain, top[:, :, None], 2)[:, :, 0]
            f = most.argmax(0)  # the first of equal features
            split = most[f, np.arange(width)] > 1e-9
            feature[off : off + width] = np.where(split, f, 0)
            at[off : off + width] = np.where(split, top[f, np.arange(width)], bins + 1)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > at[node])
        leaf = node - inner
        value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        model.trees.append((feature, at, value))
        z += rate * value[leaf]
    return model


def fold(host: str, folds: int) -> int:
    """A site's fold, by hash of its last three labels."""
    return zlib.crc32(".".join(host.split(".")[-3:]).encode("utf-8", "replace")) % folds


class Judge:
    """Features with their suffix tables, trees and a threshold."""

    def __init__(self, urls: list[str | None], y: np.ndarray, folds: int = FOLDS, precision: float = PRECISION):
        split = [parts(u) for u in urls]
        own = np.array([fold(host, folds) for host, _ in split], int)
        self.share = float(y.mean()) if len(y) else 0.0
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in suffixes("", "")]  # blocked and all urls of a suffix, by fold
        for (host, path), label, f in zip(split, y.tolist(), own.tolist(), strict=True):
            for table, key in zip(self.tables, suffixes(host, path), strict=True):
                seen = table.setdefault(key, np.zeros((2, folds)))
                seen[0, f] += label
                seen[1, f] += 1
        x = np.array([self.row(u, *s, f) for u, s, f in zip(urls, split, own.tolist(), strict=True)]) if len(urls) else np.zeros((0, 1))
        self.trees = boost(x, y, np.ones(len(y)))
        z = np.full(len(y), -np.inf)
        for f in np.unique(own):
            if 0 < y[own != f].sum() < (own != f).sum():
                z[own == f] = boost(x[own != f], y[own != f], np.ones((own != f).sum())).logits(x[own == f])
        self.at, self.held_out = threshold(z, y, precision)
        if not 0 < self.share < 1:
            self.at = 0.0
        self.tables = [{k: v.sum(1, keepdims=True) for k, v in t.items()} for t in self.tables]

    def row(self, url: str | None, host: str, path: str, without: int | None = None) -> list[float]:
        out = lexical(url, host, path)
        for table, key in zip(self.tables, suffixes(host, path), strict=True):
            seen = table.get(key)
            hit, n = (0.0, 0.0) if seen is None else seen.sum(1) - (seen[:, without] if without is not None else 0)
            out += [(hit + 4 * self.share) / (n + 4), min(n, 100.0)]
        return out

    def blocks(self, urls: list[str | None], split: list[tuple[str, str]]) -> np.ndarray:
        if not urls:
            return np.zeros(0, bool)
        return self.trees.logits(np.array([self.row(u, *s) for u, s in zip(urls, split, strict=True)])) >= self.at


def threshold(z: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, tuple[float, float]]:
    """The lowest value of z from which on a share ``precision`` of y is 1 (infinity if there is none), and precision and recall there."""
    order = np.argsort(-z, kind="stable")
    hit, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.r_[z[order][1:] != z[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero(last & (hit >= precision * n) & np.isfinite(z[order]))
    if not len(good):
        return np.inf, (1.0, 0.0)
    k = good[-1]
    return float(z[order][k]), (float(hit[k] / n[k]), float(hit[k] / max(1, y.sum())))


def train(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", most: int = MOST, precision: float = PRECISION) -> Judge:
    """Fits on distinct urls that the rules judge."""
    known = Rules(rules)

    def run(batches):
        for batch in batches:
            said = batch.column(0).to_pylist()
            found = [known.find(*parts(u)) for u in said]
            some = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([pa.array([said[i] for i in some], pa.string()), pa.array([float(found[i][1] == "block") for i in some], pa.float64())], names=["url", "y"])

    labelled = pages.select(F.col(url_col).alias("url")).where("url is not null").mapInArrow(run, "url string, y double").distinct()
    got = labelled.orderBy(F.xxhash64("url"), "url").limit(most).toArrow()
    return Judge(got.column("url").to_pylist(), got.column("y").to_numpy(), precision=precision)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most: int = MOST) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    judge = pages.sparkSession.sparkContext.broadcast(train(pages, rules, url_col, most))
    known = Rules(rules)

    def run(batches):
        for batch in batches:
            urls = batch.column(1).to_pylist()
            split = [parts(u) for u in urls]
            found = [known.find(*s) for s in split]
            open_ = [i for i, f in enumerate(found) if f is None]
            block = judge.value.blocks([urls[i] for i in open_], [split[i] for i in open_])
            said = dict(zip(open_, np.where(block, "block", "allow").tolist(), strict=True))
            cols = [pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else said[i] for i, f in enumerate(found)], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the filter that SQL can express: host, path and rule of each page, and the verdict where a rule fits."""
    found = op8_urls(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def _case(column: str) -> str:
    """The longest rule that fits, as SQL."""
    said = {"rule": lambda v, h, p: f"'{h}{p}'", "verdict": lambda v, h, p: f"'{v}'"}[column]
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {said(v, h, p)}" for v, h, p in longest) + " END"


RULES_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_case("rule")} AS rule, {_case("verdict")} AS verdict FROM p
"""
