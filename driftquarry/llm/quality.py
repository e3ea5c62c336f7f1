"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: hashed words, hashed character n-grams of
each word, and hashed pairs of neighbouring words (a word followed by itself is one shared feature). A
softmax layer over the average gives the class. Vectors and layer are trained together on the driver by
stochastic gradient descent in numpy, on a bounded sample of labelled documents (`max_labelled`); the
sample is the only thing collected, and no more than `max_bytes` of it. Scoring reads every document whole: since the layer is linear, each
feature's vector shrinks to one number before it is shipped, and a document's score is a mean of lookups,
done once for each distinct word of a slice.

Defined cases. Null and empty texts have no features: they score the class prior given by the bias and
are rejected (`keep` false), as there is nothing to learn from them. Null labels are left out of training;
with labels of one class every document with a word has that class, and without labels it scores 0.5 and stays. Repeated label rows
count as often as they occur. Further columns are ignored or carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, mix, other_names, text_slices, windows, words_of

#: log2 of the feature table, sizes of the character n-grams.
BITS, GRAMS = 18, (3, 4)
MAX_LABELLED, MAX_BYTES = 3000, 48 << 20
THRESHOLD = 0.5
_MASK = np.uint64((1 << BITS) - 1)


@dataclass
class QualityModel:
    """`weight` has each feature's contribution to the log-odds of good quality, `bias` the rest."""

    weight: np.ndarray
    bias: float


def _word_features(unique: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, number of the word) of the words and their n-grams, and a 64-bit hash of each word."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), np.uint64, len(unique))
    feats, owners = [hashes & _MASK], [np.arange(len(unique))]
    points = np.frombuffer(("<" + ">\n<".join(unique) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    breaks = points == 10
    word = np.cumsum(breaks)[~breaks]
    points = mix(points[~breaks] + np.uint64(0x5851F42D4C957F2D))
    for n in GRAMS:
        h = windows(points, n)
        within = word[: len(h)] == word[n - 1 :] if len(h) else np.zeros(0, bool)
        feats.append(h[within] & _MASK)
        owners.append(word[: len(h)][within])
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners), hashes


def _pairs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of neighbouring words."""
    same = doc[1:] == doc[:-1]
    a, b = hashes[:-1][same], hashes[1:][same]
    h = mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    h[a == b] = 0x2545F4914F6CDD1D
    return (h & _MASK).astype(np.int64), doc[1:][same]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of the text, index of the word) of each word, and the distinct words."""
    offsets, words = words_of(texts)
    unique = words.dictionary.to_pylist()
    index = np.asarray(words.indices, dtype=np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    full = np.array([bool(w) for w in unique], dtype=bool)
    kept = full[index] if len(unique) else np.zeros(0, bool)
    renumber = np.cumsum(full) - 1
    return doc[kept], renumber[index[kept]] if len(unique) else index, [w for w in unique if w]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of feature frequencies: (bounds by text, feature, share)."""
    doc, index, unique = _tokens(texts)
    if not len(doc):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    feat, owner, hashes = _word_features(unique)
    order = np.argsort(owner, kind="stable")
    feat, per = feat[order], np.bincount(owner, minlength=len(unique))
    first = np.cumsum(per) - per
    # One entry for each distinct word of a text, expanded to its features, weighted by how often it occurs.
    key, often = np.unique(doc * len(unique) + index, return_counts=True)
    d, w = key // len(unique), key % len(unique)
    reps = per[w]
    spread = np.repeat(np.arange(len(w)), reps)
    within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    pf, pd_ = _pairs(hashes[index], doc)
    key = np.concatenate([d[spread], pd_]) * (1 << BITS) + np.concatenate([feat[first[w][spread] + within], pf])
    weight = np.concatenate([often[spread], np.ones(len(pf))])
    key, inverse = np.unique(key, return_inverse=True)
    share = np.bincount(inverse, weights=weight)
    rows = key >> BITS
    total = np.bincount(rows, weights=share, minlength=len(texts))
    return np.searchsorted(rows, np.arange(len(texts) + 1)), key & ((1 << BITS) - 1), (share / total[rows]).astype(np.float32)


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 5, rate: float = 0.3, batch: int = 16, seed: int = 7) -> QualityModel:
    """Fit embeddings and a two-class softmax layer by minibatch stochastic gradient descent with per-row step sizes."""
    y = np.asarray(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return QualityModel(np.zeros(1 << BITS, np.float32), 60.0 * float(y[0] > 0) - 30 if len(y) else 0.0)
    parts = [features(pa.array(texts[i : i + 200], pa.string())) for i in range(0, len(texts), 200)]  # in slices, for the driver's memory
    starts = np.cumsum([0, *[p[0][-1] for p in parts]])
    bounds = np.concatenate([[0], *[p[0][1:] + s for p, s in zip(parts, starts)]])
    feat, share = np.concatenate([p[1].astype(np.int32) for p in parts]), np.concatenate([p[2] for p in parts])
    del parts
    rng = np.random.default_rng(seed)
    used, feat = np.unique(feat, return_inverse=True)
    emb = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    # The floor keeps features of one document from being learnt by heart before common ones are.
    seen_e, seen_o, seen_b = np.full((len(used), 1), 1e-4, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            n = bounds[rows + 1] - bounds[rows]
            rows, n = rows[n > 0], n[n > 0]
            if not len(rows):
                continue
            at = np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            f, s, owner = feat[at], share[at][:, None], np.repeat(np.arange(len(rows)), n)
            hidden = np.add.reduceat(emb[f] * s, np.cumsum(n) - n, axis=0)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            g_out, g_bias = hidden.T @ p, p.sum(0)
            touched, inverse = np.unique(f, return_inverse=True)
            rowgrad = (p @ out.T)[owner] * s
            order = np.argsort(inverse, kind="stable")
            g_emb = np.add.reduceat(rowgrad[order], np.searchsorted(inverse[order], np.arange(len(touched))), axis=0)
            seen_e[touched] += (g_emb**2).mean(1, keepdims=True)
            emb[touched] -= rate * g_emb / np.sqrt(seen_e[touched])
            seen_o += g_out**2
            out -= rate * g_out / np.sqrt(seen_o)
            seen_b += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_b)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = emb @ (out[:, 1] - out[:, 0])
    return QualityModel(weight, float(bias[1] - bias[0]))


def log_odds(texts: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of good quality, number of words) by text."""
    doc, index, unique = _tokens(texts)
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if not len(doc):
        return np.full(len(texts), model.bias), count
    feat, owner, hashes = _word_features(unique)
    per_word = np.bincount(owner, weights=model.weight[feat], minlength=len(unique))
    n_word = np.bincount(owner, minlength=len(unique))
    pf, pd_ = _pairs(hashes[index], doc)
    n = len(texts)
    total = np.bincount(doc, weights=per_word[index], minlength=n) + np.bincount(pd_, weights=model.weight[pf], minlength=n)
    many = np.bincount(doc, weights=n_word[index], minlength=n) + np.bincount(pd_, minlength=n)
    return total / np.maximum(many, 1) + model.bias, count


def train_on(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> QualityModel:
    """Fit on at most `max_labelled` labelled documents, chosen by a hash of their ids, or as many whole texts of these in that order as `max_bytes` hold."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(F.col("quality") > 0, 1).otherwise(0).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text", "label").alias("row"), F.xxhash64("doc_id").alias("h"), "doc_id", "text", "label")
    found = checkpointed(found)
    taken, size = set(), 0
    for row in found.select("h", "doc_id", "label", "row", F.octet_length("text").alias("n")).orderBy("h", "doc_id", "label", "row").collect():
        size += row["n"]
        if size > max_bytes:
            break
        taken.add(row["row"])
    rows = [r for r in found.where(F.col("row").isin(taken) if size > max_bytes else F.lit(True)).select("doc_id", "text", "label").collect()]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `p_good` (probability of good quality) and `keep`; both get a leading underscore where the name is taken."""
    names = other_names(docs, "p_good", "keep")
    schema = T.StructType([*docs.schema.fields, T.StructField(names["p_good"], T.DoubleType()), T.StructField(names["keep"], T.BooleanType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            odds, words = log_odds(batch.column("text"), shipped.value)
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold) & (words > 0))], names=schema.names)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_good, keep) of every document."""
    return score(docs.select("doc_id", "text"), model, threshold).select("doc_id", F.round("p_good", 6).alias("p_good"), "keep")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts; same columns."""
    names = other_names(docs, "p_good", "keep")
    return score(docs, train_on(docs, labels), threshold).where(F.col(names["keep"])).select(*[F.col(f"`{c}`") for c in docs.columns])
