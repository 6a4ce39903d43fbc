"""Toxic passages as maximal-scoring segments of token log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, documents_in, mix, prefix_hash, spans_hash, words_in

#: Hashed vocabulary; counts and scores are tables of this size whatever the corpus.
BITS = 20
#: Most labelled rows that the model is fitted on, by hash order of doc_id.
SAMPLE_ROWS = 30_000
#: Weight of the Dirichlet prior in tokens, dealt out by the words' pooled shares.
PRIOR = 200.0
#: What each token costs, so that chance passages drift down.
DRIFT = 0.25
_EULER = 0.5772156649
#: Besides the whole word, beginnings of so many bytes give evidence: unseen forms of known stems are scored too.
PREFIXES = (4, 5, 6)
#: Steps of a score in the histogram from which the extreme-value rate is found.
_STEP = 1 / 64


@dataclass
class Model:
    odds: np.ndarray  # float32 by bucket: log-odds, drawn to 0 by their standard error
    rate: float = 1.0  # Karlin-Altschul lambda
    scale: float = 1.0  # and K
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)
    threshold: float = 0.05  # expected chance segments in a text

    def chance(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Logarithm of the expected number of chance segments as good, for texts of so many words."""
        return np.log(self.scale * np.maximum(words, 1)) - self.rate * best

    def probability(self, best: np.ndarray, words: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        z = a + b * -self.chance(best, words) + c * np.log1p(total)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def buckets(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word (one row for the whole, one for each beginning), its start and end, and the offsets of each text's words."""
    starts, ends, bounds = words_in(b, at, ALNUM)
    p = prefix_hash(b, lower=True)
    rows = [spans_hash(p, starts, ends)]
    rows += [mix(spans_hash(p, starts, np.minimum(starts + n, ends)) + np.uint64(n)) for n in PREFIXES]
    return (np.stack(rows) >> np.uint64(64 - BITS)).astype(np.int64), starts, ends, bounds


def token_scores(table: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """The most toxic evidence of each word, less the drift."""
    return table[idx].max(0) - np.float32(DRIFT)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, past last, score), left to right, in linear time.

    Each is the best in its surroundings: it has no better part, and no extension that
    keeps that is better. The scan keeps a stack of segments with the sums before and after,
    and for each the nearest earlier one with a smaller sum before it: all between can't be
    merged with what comes, so they are jumped over.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    firsts, lasts, lefts, rights, nearest = [], [], [], [], []
    for i, left, right in zip(hot.tolist(), sums[hot].tolist(), sums[hot + 1].tolist(), strict=True):
        lo, j = i, len(lefts) - 1
        while j >= 0 and lefts[j] >= left:
            j = nearest[j]
        while j >= 0 and rights[j] < right:  # merged with j and all after it
            lo, left = firsts[j], lefts[j]
            for x in (firsts, lasts, lefts, rights):
                del x[j:]
            nearest[j:], j = [], nearest[j]
        for x, v in zip((firsts, lasts, lefts, rights, nearest), (lo, i + 1, left, right, j), strict=True):
            x.append(v)
    return [(lo, hi, right - left) for lo, hi, left, right in zip(firsts, lasts, lefts, rights, strict=True)]


def _features(model: Model, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, float]]], np.ndarray]:
    """Best segment, words, sum of significant segments, these (byte offsets in the text), and the words' scores."""
    idx, starts, ends, bounds = buckets(b, at)
    s = token_scores(model.odds, idx)
    n = len(at) - 1
    best, total = np.zeros(n), np.zeros(n)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    words = np.diff(bounds)
    hot = np.concatenate([[0], np.cumsum(s > 0)])
    for i in np.flatnonzero(hot[bounds[1:]] > hot[bounds[:-1]]).tolist():
        lo, hi = bounds[i], bounds[i + 1]
        segments = maximal_segments(s[lo:hi])
        best[i] = max(x[2] for x in segments)
        least = (np.log(model.scale * (hi - lo)) - np.log(model.threshold)) / model.rate
        for first, last, score in segments:
            if score >= least:
                total[i] += score
                found[i].append((int(starts[lo + first] - at[i]), int(ends[lo + last - 1] - at[i]), float(score)))
    return best, words, total, found, s


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def _rate(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum share * exp(rate * score) = 1, for scores with negative mean."""
    f = lambda x: float(shares @ np.exp(np.minimum(x * scores, 50.0))) - 1
    lo, hi = 1e-3, 1e-3
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 0.01)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled documents that are not held out.

    At most `rows` labels, in hash order of doc_id, are used: a bounded sample, whose ids are
    broadcast. Word counts by class are summed on the executors into 2**BITS buckets. Null
    labels or ids are left out; without rows of both classes nothing scores above 0.5.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", (F.col(label) > 0).cast("int").alias("y")).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            k = 0
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])]):
                idx, _, _, bounds = buckets(b, at)
                own = np.repeat(y[k : k + len(ids)], np.diff(bounds))
                k += len(ids)
                for c in (0, 1):
                    n[c] += np.bincount(idx[:, own == c].ravel(), minlength=1 << BITS)
        k = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n[0, k]), pa.array(n[1, k])], ["bucket", "clean", "toxic"])

    counts = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    n = np.zeros((2, 1 << BITS))
    k = counts.column("bucket").to_numpy()
    n[0, k], n[1, k] = counts.column("clean").to_numpy(), counts.column("toxic").to_numpy()
    if not n[0].any() or not n[1].any():
        return Model(np.zeros(1 << BITS, np.float32))
    prior = PRIOR * n.sum(0) / n.sum()
    a, c = n[1] + prior, n[0] + prior
    odds = np.zeros(1 << BITS)
    k = np.flatnonzero(prior > 0)
    odds[k] = np.log(a[k] / (n[1].sum() + PRIOR - a[k])) - np.log(c[k] / (n[0].sum() + PRIOR - c[k]))
    doubt = np.sqrt(1 / a[k] + 1 / c[k])
    odds[k] = np.sign(odds[k]) * np.maximum(np.abs(odds[k]) - 1.64 * doubt, 0)
    model = Model(np.clip(odds, -3, 6).astype(np.float32))
    lowest, cells = -3 - DRIFT, int(9 / _STEP) + 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each labelled text, and last the histogram of clean texts' token scores."""
        seen = np.zeros(cells, np.int64)
        names = ["best", "words", "total", "y", "seen"]
        for batch in batches:
            y, k = batch.column("y").to_numpy(), 0
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])]):
                own = y[k : k + len(ids)]
                best, words, total, _, s = _features(model, b, at)
                clean = np.repeat(own == 0, words)
                seen += np.bincount(((s[clean] - lowest) / _STEP).round().astype(np.int64), minlength=cells)
                k += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(words.astype(np.int64)), pa.array(total), pa.array(own), pa.nulls(len(ids), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int32()), pa.array([seen.tolist()], pa.list_(pa.int64()))], names)

    def measured() -> tuple[np.ndarray, ...]:
        rows = sample.mapInArrow(measure, "best double, words long, total double, y int, seen array<long>").toArrow()
        hist = sum((np.array(x, np.int64) for x in rows.column("seen").to_pylist() if x is not None), np.zeros(cells, np.int64))
        rows = rows.filter(rows.column("y").is_valid())
        return *(rows.column(c).to_numpy() for c in ("best", "words", "total", "y")), hist

    # rate and scale first, from clean texts; then the weights, with significance under these
    best, words, _, y, hist = measured()
    levels = lowest + _STEP * np.arange(cells)
    shares = hist / max(hist.sum(), 1)
    if not (hist[levels > 0]).any():
        shares = shares * (1 - 1e-6)
        shares[-1] += 1e-6  # no clean word scored above 0: as if one in a million did, as highly as can be
    model.rate = _rate(shares, levels)
    clean = (y == 0) & (words > 0)
    model.scale = float(np.exp(np.mean(model.rate * best[clean] - np.log(words[clean])) - _EULER)) if clean.any() else 1.0
    best, words, total, y, _ = measured()
    x = np.stack([np.ones(len(y)), -model.chance(best, words), np.log1p(total)], 1)
    w = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(map(float, w))
    return model


def score(documents: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_passages and, on request, passages.

    Whole texts are scored, one row a document, repeated rows too; null and empty texts have
    no passage and score as a text without any. passages are the significant segments: start
    and end byte and score. Other columns are left out.
    """
    schema = "doc_id long, score double, n_words long, n_passages int" + ", passages array<struct<start:long,end:long,score:double>>" * passages
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k = batch.column("doc_id"), 0
            for own, b, at in documents_in([batch]):
                best, words, total, found, _ = _features(model, b, at)
                cols = [ids.slice(k, len(own)), pa.array(model.probability(best, words, total)), pa.array(words.astype(np.int64)), pa.array([len(f) for f in found], pa.int32())]
                if passages:
                    cols.append(pa.array([[{"start": s, "end": e, "score": v} for s, e, v in f] for f in found], kind))
                k += len(own)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_words", "n_passages"] + ["passages"] * passages)

    rows = documents.select("doc_id", "text").mapInArrow(run, schema)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[c for c in rows.columns if c not in ("doc_id", "score")])


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold; in one pass, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            places = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "text"])
            for own, b, at in documents_in([places]):
                best, words, total, _, _ = _features(model, b, at)
                yield batch.slice(k, len(own)).filter(pa.array(model.probability(best, words, total) < threshold))
                k += len(own)

    return documents.mapInArrow(run, documents.schema)
