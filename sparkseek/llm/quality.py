"""Quality classifier: Bradley-Terry ranking of documents.

A document's utility is a sum of weights: of the bins into which surface figures of its text fall, and of the buckets into which
its words, word pairs and byte 4-grams are hashed, each bucket by the root of its share. All are taken of the whole text. From
pairs of a labelled good and a labelled bad document the weights are learned by logistic loss on the difference of their features:
the probability that the good one is preferred. A quantile of the utilities of the labelled sample, at the share of bad documents
that parts the labels best, is the threshold; scores are logistic in the distance from it, and the score at the threshold is CUT.

Labels are those of at most SAMPLE rows, the first by hash of doc_id among those whose crc32(doc_id as text) mod 5 is not 0; that
is the only bound, and it holds for fitting alone. The sample's texts stay on the executors: the driver gets SURFACE figures of each
and one byte a bucket. Language, source and doc_id never enter a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import spread
from .common import bounded, cut, packed, slices, tidy, unpacked
from .suffixes import _B1, Words, _lower, _mix

SAMPLE = 20_000
BINS = 16
CUT = 0.3
_PAIRS, _STEPS, _RATE = 16_384, 300, 0.05
#: Penalties on the weights of bins and of buckets.
_PENALTY = 1e-4, 1e-5

#: Kinds of byte: lower, upper, digit, blank, line end, other control, ASCII signs, bytes of other characters.
_kind = np.full(256, 6, np.uint8)
_kind[:32], _kind[127], _kind[128:] = 5, 5, 7
_kind[97:123], _kind[65:91], _kind[48:58] = 0, 1, 2
_kind[[32, 9]], _kind[[10, 13]] = 3, 4
SURFACE = 19
#: Buckets of words, of word pairs, of byte 4-grams; powers of two.
BUCKETS = 1024, 512, 512
_STEP = 1 << 20


def surface(text: str) -> list[float]:
    """Figures of one text, all defined for empty ones."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_kind[raw], minlength=8)[:8] / max(1, len(raw))
    words = text.split()
    n, lines, times = max(1, len(words)), text.split("\n"), Counter(words)
    upper = sum(map(str.isupper, "".join([w[0] for w in words])))
    return [
        *kinds, np.log1p(len(words)), np.log1p(len(text)), (len(text) - len(words) + 1) / n, len(times) / n, np.log(n) - np.log(max(1, len(times))),
        max(times.values(), default=0) / n, len(set(lines)) / len(lines), np.log1p(len(lines)), len(zlib.compress(raw, 1)) / max(1, len(raw)), upper / n, sum(map(text.count, "!|#$%&*")) / max(1, len(text)),
    ]


def _counted(owner: np.ndarray, digest: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """How many digests of each text fall into each bucket, by their highest bits."""
    at = owner * buckets + (digest >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    return np.bincount(at, minlength=n * buckets).reshape(n, buckets)


def _four(raw: np.ndarray) -> np.ndarray:
    """Digest of the four bytes from each byte on, A-Z lower-cased."""
    b = _lower[raw].astype(np.uint64)
    return _mix((b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)) * _B1)


def hashed(texts: list[str]) -> np.ndarray:
    """Roots of the shares of each bucket, a row for each text, of the whole text."""
    n, raw = len(texts), [t.encode() for t in texts]
    w = Words(pa.array(texts, pa.string()))
    pair = w.whole(2)
    fours = np.zeros((n, BUCKETS[2]), np.int64)
    for i, r in enumerate(raw):
        for at in range(0, len(r) - 3, _STEP):
            fours[i] += _counted(np.int64(0), _four(np.frombuffer(r[at : at + _STEP + 3], np.uint8)), 1, BUCKETS[2])[0]
    parts = _counted(w.text, w.digest, n, BUCKETS[0]), _counted(w.text[pair], w.grams(2, _B1)[pair], n, BUCKETS[1]), fours
    return np.concatenate([np.sqrt(c / np.maximum(1, c.sum(axis=1, keepdims=True))) for c in parts], axis=1, dtype=np.float32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Surface figures and bucket values of texts; null as empty."""
    texts = [t or "" for t in texts]
    return np.array([surface(t) for t in texts], float).reshape(len(texts), SURFACE), hashed(texts)


@dataclass
class Ranker:
    """Edges of each figure's bins, the weights of bins and buckets, the threshold and the steepness."""

    edges: np.ndarray
    bins: np.ndarray = field(default_factory=lambda: np.zeros((SURFACE, BINS)))
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(sum(BUCKETS)))
    threshold: float = 0.0
    slope: float = 1.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """For each row, which of all bins its figures are in."""
        return np.stack([np.searchsorted(e, x[:, j], "right") + j * BINS for j, e in enumerate(self.edges)], 1)

    def utility(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.bins.ravel()[self.binned(x)].sum(1) + h @ self.buckets.astype(h.dtype)

    def score(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x, h) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_loss(w: np.ndarray, at: np.ndarray, h: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferring good[i] to bad[i], and its gradient; w has the bins' weights, then the buckets'."""
    n = SURFACE * BINS
    u = w[:n][at].sum(1) + h @ w[n:].astype(h.dtype)
    margin = u[good] - u[bad]
    p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # of preferring the bad one
    pull = (np.bincount(bad, p, len(u)) - np.bincount(good, p, len(u))) / len(good)
    decay = np.repeat(_PENALTY, [n, len(w) - n])
    grad = np.r_[np.bincount(at.ravel(), np.repeat(pull, SURFACE), n), pull.astype(h.dtype) @ h] + decay * w
    return float(np.logaddexp(0, -margin).mean() + (decay * w * w).sum() / 2), grad


def fit(x: np.ndarray, h: np.ndarray, labels: np.ndarray, seed: int = 7) -> Ranker:
    """A ranker from features of labelled texts; without both labels, one that prefers nothing."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros((SURFACE, BINS - 1)))
    most = max(len(good), len(bad))
    half = np.r_[np.resize(good, most), np.resize(bad, most)]
    model = Ranker(np.array([np.quantile(x[half, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(SURFACE)]))
    at, rng, w = model.binned(x), np.random.default_rng(seed), np.zeros(SURFACE * BINS + h.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, _STEPS + 1):
        _, g = pair_loss(w, at, h, rng.choice(good, _PAIRS), rng.choice(bad, _PAIRS))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.bins, model.buckets = w[: SURFACE * BINS].reshape(SURFACE, BINS), w[SURFACE * BINS :]
    u = model.utility(x, h)
    order = np.argsort(u, kind="stable")
    y = labels[order]
    # errors of each quantile: good ones below it and bad ones above it; the middle of the best quantiles
    errors = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    best = np.flatnonzero(errors == errors.min())
    q = int(best[len(best) // 2])
    s = u[order]
    model.threshold = float((s[q - 1] + s[q]) / 2) if 0 < q < len(s) else float(s[0] - 1 if q == 0 else s[-1] + 1)
    trial = np.geomspace(0.05, 20, 40)
    z = trial[:, None] * (u - model.threshold)[None, :] + np.log(CUT / (1 - CUT))
    model.slope = float(trial[np.argmin(np.where(labels[None, :] == 1, np.logaddexp(0, -z), np.logaddexp(0, z)).mean(1))])
    return model


def held_out(doc_id):
    """Whether a row is kept from fitting: crc32 of doc_id as text, mod 5, is 0. Not so for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fit on at most `sample` labelled rows that are not held out; their texts stay on the executors, features come to the driver."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    some = bounded(rows, sample, "doc_id", "quality")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # `sample` rows at most
    found = cut(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(2)):
                x, h = features(part.column(2).to_pylist())
                h = np.rint(255 * h).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in h], pa.binary())], ["doc_id", "quality", "x", "h"])
        tidy()

    featured = cut(found.mapInArrow(run, "doc_id long, quality int, x binary, h binary"), "features")
    order = {tuple(r): i for i, r in enumerate(sorted(featured.select("doc_id", "quality").collect()))}
    x, h, y = np.empty((len(order), SURFACE)), np.empty((len(order), sum(BUCKETS)), np.float32), np.empty(len(order), int)
    for r in featured.toLocalIterator():  # one partition at a time
        i = order[r.doc_id, r.quality]
        x[i], h[i], y[i] = np.frombuffer(r.x, float), np.frombuffer(r.h, np.uint8), r.quality
    h *= np.float32(1 / 255)
    return fit(x, h, y)


def scored(rows: DataFrame, text: str, model: Ranker) -> DataFrame:
    """rows (packed) with score double and predicted int; `text` is the field of the row that has it, read whole, each row where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).type.get_field_index(text)
            for part in slices(batch, batch.column(0).flatten()[place]):
                score = model.score(*features(part.column(0).flatten()[place].to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["row", "score", "predicted"])
        tidy()

    return spread(rows.select("row")).mapInArrow(run, rows.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted).

    Null texts score as empty ones. Labels other than 0 and 1, and of no document, are passed over; repeated labels count once, a
    document with both labels counts for both; of rows that repeat a labelled doc_id the least text is learned from. Without labels of both kinds every score is CUT and every prediction 1. Rows with
    equal texts have equal scores. Other columns, whatever their names, are not looked at. Empty tables give no rows.
    """
    rows = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = scored(rows, "c1", learn(docs, labels, sample))
    return out.select("row.c0", "score", "predicted").select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score", "predicted")


def good_ones(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs that are predicted good, in their columns, whatever the names of those beside doc_id and text."""
    rows = packed(docs.withColumn("text", F.col("text").cast("string")))
    return unpacked(scored(rows, f"c{docs.columns.index('text')}", learn(docs, labels, sample)).filter("predicted = 1"), docs.columns)
