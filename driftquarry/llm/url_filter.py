"""URL filter: gradient-boosted trees on lexical features of URLs, trained from labelled URLs.

Features of a URL: its length, the lengths of host, path and query, path depth, labels of the host, shares of
digits and of other than letters and digits, longest run of digits, entropy of its bytes, number of parameters,
and statistics of its suffixes (top-level domain, last two labels of the host, file extension): each suffix's
smoothed share of good labels and the logarithm of its count among the training URLs.

Trees are grown on the driver in numpy, on histograms of quantile bins with a logistic loss, from a bounded
sample of labelled URLs (`max_labelled`, the only thing collected). Every URL is scored, in Arrow batches.

Suffix statistics are counted on one half of the sample (by a hash of the URL) and trees are grown on the other
half, with those same statistics: a statistic never holds the label that a tree learns from, and means the same
when fitting and when scoring. A split has to gain `MIN_GAIN`, more than the best of several hundred useless
splits does by chance, so labels that URLs tell nothing about give the share of good labels and no trees.

Defined cases. A null or empty URL has no features: its score is null and it is not kept. Null labels and null
URLs are left out of training; repeated labelled URLs count as often as they occur. Without labels of both
classes in the half that trees are grown on, every URL scores the share of good labels (0.5 without any). Scores
tie where features do; of equally good splits the first feature's lowest cut is taken. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, SMOOTH = 60, 3, 0.15, 32, 20.0
#: Least gain of a split, in units of twice the log-likelihood: useless splits gain 1 on average, the best of some hundred about 10.
MIN_GAIN = 12.0
_PARTS = regex.compile(r"^(?:[a-zA-Z][\w+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", regex.S)
_DIGITS = regex.compile(r"\d+")
_EXTENSION = regex.compile(r"\.([A-Za-z0-9]{1,8})$")


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """Top-level domain, last two labels of the host, extension of the path."""
    labels = host.lower().rsplit(".", 2)
    ext = _EXTENSION.search(path)
    return "t:" + labels[-1], "d:" + ".".join(labels[-2:]), "e:" + (ext.group(1).lower() if ext else "")


def lexical(urls: list[str]) -> tuple[np.ndarray, list[tuple[str, str, str]]]:
    """Features without the suffix statistics, and the suffixes."""
    out, ends = np.zeros((len(urls), 12)), []
    for i, url in enumerate(urls):
        m = _PARTS.match(url)
        host, path, query, fragment = (x or "" for x in m.groups()) if m else (url, "", "", "")
        n = max(len(url), 1)
        digits = sum(c.isdigit() for c in url)
        _, often = np.unique(np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)
        share = often / max(often.sum(), 1)
        out[i] = (
            len(url), len(host), len(path), len(query), path.strip("/").count("/") + (path.strip("/") != ""), host.count(".") + 1, digits / n,
            sum(not c.isalnum() for c in url) / n, max((len(d) for d in _DIGITS.findall(url)), default=0), -(share * np.log2(share)).sum(),
            sum(1 for p in query.split("&") if p), bool(fragment) + 2 * url.lower().startswith("https"),
        )
        ends.append(suffixes(host, path))
    return out, ends


@dataclass
class UrlModel:
    prior: float
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: Per tree: feature and bin of each inner node in level order (a bin above it goes right), and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def matrix(self, urls: list[str]) -> np.ndarray:
        x, ends = lexical(urls)
        return np.hstack([x, self.statistics(ends)])

    def statistics(self, ends: list[tuple[str, str, str]]) -> np.ndarray:
        unseen = (self.prior, 0.0)
        return np.array([[v for s in e for v in self.stats.get(s, unseen)] for e in ends]).reshape(len(ends), 6)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def log_odds(self, urls: list[str]) -> np.ndarray:
        out = np.full(len(urls), self.base)
        if self.trees and urls:
            bins = self.binned(self.matrix(urls))
            for feature, cut, leaf in self.trees:
                out += leaf[_leaf(bins, feature, cut)]
        return out


def _leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
    return at - (2**DEPTH - 1)


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by second-order gain; a node that no split improves sends everything left."""
    inner, d = 2**DEPTH - 1, bins.shape[1]
    feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        first, n = 2**level - 1, 2**level
        key = ((node - first)[:, None] * d + np.arange(d)) * (BINS + 1) + bins
        size = n * d * (BINS + 1)
        g = np.bincount(key.ravel(), weights=np.repeat(grad, d), minlength=size).reshape(n, d, -1).cumsum(2)
        h = np.bincount(key.ravel(), weights=np.repeat(hess, d), minlength=size).reshape(n, d, -1).cumsum(2)
        gr, hr = g[:, :, -1:] - g, h[:, :, -1:] - h
        gain = g**2 / (h + 1) + gr**2 / (hr + 1) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + 1)
        gain[(h < 1) | (hr < 1)] = 0
        best = gain.reshape(n, -1).argmax(1)
        split = gain.reshape(n, -1).max(1) > MIN_GAIN
        feature[first : first + n] = np.where(split, best // (BINS + 1), 0)
        cut[first : first + n] = np.where(split, best % (BINS + 1), BINS)
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    leaf = node - inner
    g, h = np.bincount(leaf, grad, 2**DEPTH), np.bincount(leaf, hess, 2**DEPTH)
    return feature, cut, -RATE * g / (h + 1)


def train(urls: list[str], labels: list[int]) -> UrlModel:
    """Boosted trees for the log-odds of label 1."""
    y = np.asarray(labels, dtype=float)
    prior = float(y.mean()) if len(y) else 0.5
    model = UrlModel(prior, base=float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / np.clip(1 - prior, 1e-6, 1))))
    counting = np.array([xxhash.xxh3_64_intdigest(u) & 1 for u in urls], dtype=bool)
    if len(np.unique(y[~counting])) < 2:
        return model
    x, ends = lexical(urls)
    total: dict[str, list[float]] = {}
    for i in np.flatnonzero(counting):
        for s in ends[i]:
            t = total.setdefault(s, [0.0, 0.0])
            t[0] += y[i]
            t[1] += 1
    model.stats = {s: ((g + SMOOTH * prior) / (n + SMOOTH), float(np.log1p(n))) for s, (g, n) in total.items()}
    rows = np.flatnonzero(~counting)
    x, y = np.hstack([x[rows], model.statistics([ends[i] for i in rows])]), y[rows]
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins, score = model.binned(x), np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(bins, p - y, p * (1 - p))
        if (tree[1] == BINS).all():
            break  # nothing is left to learn
        score += tree[2][_leaf(bins, tree[0], tree[1])]
        model.trees.append(tree)
    return model


def train_on(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> UrlModel:
    """Fit on at most `max_labelled` rows of (url, label), chosen by a hash of the URL."""
    rows = labelled.where("url IS NOT NULL AND url <> '' AND label IS NOT NULL").select("url", F.col("label").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).collect()
    return train([r[0] for r in rows], [int(r[1] > 0) for r in rows])


def score(urls: DataFrame, model: UrlModel, id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """(id, p_good, keep) of every row with a `url`."""
    bound_batches(urls.sparkSession)
    shipped = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("url").to_pylist()
            odds = shipped.value.log_odds([t or "" for t in texts])
            p = [round(float(1 / (1 + np.exp(-o))), 6) if t else None for t, o in zip(texts, odds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([v is not None and v >= threshold for v in p])], names=[id_col, "p_good", "keep"])

    return urls.select(F.col(id_col).cast("long").alias(id_col), "url").mapInArrow(run, f"{id_col} long, p_good double, keep boolean")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label): pages whose path names a labelled document, with that document's quality."""
    named = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    return named.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("url", "label")
