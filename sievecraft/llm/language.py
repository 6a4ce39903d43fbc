"""Language identification by error-correcting output codes over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_in
from .toxicity import held_out

BITS = 16
#: Most documents a language that are learned from, by hash order of doc_id.
ROWS_A_LANGUAGE = 2_000
#: Bits of an id's hash that the histogram counts by.
_BINS = 12
#: Texts are read so many bytes at a time.
_CHUNK = 1 << 18
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # -1 or 1 by language and bit
    weights: np.ndarray  # float32 by bucket and bit; the last bucket is 0
    middle: np.ndarray
    half: np.ndarray
    trust: np.ndarray  # by language and bit, rows add up to 1
    margin: float = 0.1  # loss between the two nearest codewords under which a text is ambiguous


def codewords(n: int, most: int = 63, seed: int = 7) -> np.ndarray:
    """Codewords of n classes: all splits into two groups if there are few, else random ones far apart."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if 2 ** (n - 1) - 1 <= most:
        splits = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T.copy()
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = min(most, max(15, int(np.ceil(10 * np.log2(n)))))
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        g = c.astype(int) @ c.T
        np.fill_diagonal(g, -bits)
        if (bits - g.max()) // 2 > far and (np.abs(c.sum(0)) < n).all():
            best, far = c, (bits - g.max()) // 2
    return best


def trigrams(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte; 2**BITS where none fits into the text."""
    low = _LOWER[b]
    out = np.full(len(b), 1 << BITS, np.int64)
    if len(b) >= 3:
        v = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        out[:-2] = (v * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    for k in (1, 2):
        edge = at[1:] - k
        out[edge[edge >= at[:-1]]] = 1 << BITS
    return out


def first_of_each(known: DataFrame, rows: int) -> DataFrame:
    """Distinct (doc_id, lang) rows, at most `rows` a language, by hash order of doc_id; no language is ranked whole.

    Bins count repeated rows as often as they come, so repeats can leave fewer than `rows`.
    """
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).withColumn("bin", F.shiftright("hash", 64 - _BINS))
    counts = hashed.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")
    cut = counts.withColumn("before", before).where(F.col("before") < rows).groupBy("lang").agg(F.max("bin").alias("last"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    some = hashed.join(F.broadcast(cut), "lang").where(F.col("bin") <= F.col("last")).select("doc_id", "lang", "hash").distinct()
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("doc_id", "lang")


def fit(documents: DataFrame, rows: int = ROWS_A_LANGUAGE) -> Model:
    """Learns from documents with a language that are not held out, at most `rows` of each.

    Ids and languages alone decide which: a histogram of id hashes says where each language's
    first `rows` end, so that no more than these and one bin are ranked. The ids picked (a
    bounded number a language) are broadcast, and trigram counts by language are summed into
    2**BITS buckets. Each bit's classifier is the log-odds of a trigram between the languages
    on its two sides.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked = first_of_each(known.select("doc_id", "lang"), rows)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, k = batch.column("lang").to_pylist(), 0
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])], _CHUNK):
                idx = trigrams(b, at)
                for lang in set(own := langs[k : k + len(ids)]):
                    mine = np.repeat(np.array([x == lang for x in own]), np.diff(at))
                    n[lang] = n.get(lang, 0) + np.bincount(idx[mine], minlength=(1 << BITS) + 1)[:-1]
                k += len(ids)
        for lang, c in n.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(c[k], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").combine_chunks().dictionary_encode()
    # a language whose documents have no trigram is learned too
    languages = sorted(set(names.dictionary.to_pylist()) | {x["lang"] for x in picked.select("lang").distinct().collect()})
    n = np.zeros((len(languages), 1 << BITS))
    place = {x: i for i, x in enumerate(languages)}
    if len(names):
        n[np.array([place[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    codes = codewords(len(languages))
    shares = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)  # languages weigh alike, however many documents they have
    bits = codes.shape[1] if len(languages) else 1
    weights = np.zeros(((1 << BITS) + 1, bits), np.float32)
    middle, half, trust = np.zeros(bits), np.ones(bits), np.ones((len(languages), bits))
    for j in range(bits if len(languages) > 1 else 0):
        up, down = codes[:, j] > 0, codes[:, j] < 0
        w = np.log(shares[up].mean(0)) - np.log(shares[down].mean(0))
        weights[:-1, j] = w
        mean = shares @ w
        middle[j] = (mean[up].min() + mean[down].max()) / 2
        half[j] = max((mean[up].min() - mean[down].max()) / 2, 1e-6)
        spread = np.sqrt(np.maximum(shares @ (w * w) - mean**2, 1e-9))
        trust[:, j] = np.clip(np.abs(mean - middle[j]) / spread, 1e-3, None)
    if len(languages):
        trust /= trust.sum(1, keepdims=True)
    return Model(languages, codes, weights, middle, half, trust)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each document, from its whole text.

    Each bit's margin is the mean log-odds, centred and scaled; a language's loss is the
    sum of exp(-code * margin) weighted by how well that bit tells it apart. The nearest
    codeword wins and score is its share of exp(-loss); texts whose two nearest codewords are
    close are ambiguous. Null texts and texts without a letter are `und` with score 0;
    repeated rows stay; without a language to learn all are `und`. Other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(model.languages)
        bits = model.weights.shape[1]
        for batch in batches:
            column, k = batch.column("doc_id"), 0
            for ids, b, at in documents_in([batch], _CHUNK):
                n = len(ids)
                filled = np.flatnonzero(at[1:] > at[:-1])
                sums = np.zeros((n, bits))
                letters = np.zeros(n, bool)
                if len(filled):
                    # block by block, so that a very long text doesn't need all its rows at once
                    idx = trigrams(b, at)
                    for lo in range(0, len(filled), 512):
                        part = filled[lo : lo + 512]
                        s, e = at[part[0]], at[part[-1] + 1]
                        if e - s <= 4 * _CHUNK:
                            sums[part] = np.add.reduceat(model.weights[idx[s:e]], at[part] - s, axis=0)
                        else:
                            for i in part:
                                sums[i] = sum(model.weights[idx[x : min(x + _CHUNK, at[i + 1])]].sum(0, dtype=np.float64) for x in range(at[i], at[i + 1], _CHUNK))
                    letters[filled] = np.logical_or.reduceat(_ASCII_LETTER[b], at[filled])
                for i in np.flatnonzero(~letters & (at[1:] > at[:-1])):
                    letters[i] = any(map(str.isalpha, bytes(b[at[i] : at[i + 1]]).decode("utf-8", "replace")))
                grams = np.maximum(np.diff(at) - 2, 1)[:, None]
                margin = np.clip((sums / grams - model.middle) / model.half, -6, 6)
                if many:
                    loss = np.stack([np.exp(-model.codes[i] * margin) @ model.trust[i] for i in range(many)], 1)
                    order = np.argsort(loss, 1, kind="stable")
                    first = loss[np.arange(n), order[:, 0]]
                    share = np.exp(-2 * (loss - first[:, None]))
                    share = 1 / share.sum(1)
                    close = (loss[np.arange(n), order[:, 1]] - first < model.margin) if many > 1 else np.zeros(n, bool)
                    names = [model.languages[order[i, 0]] if letters[i] else "und" for i in range(n)]
                    score = np.where(letters, share, 0.0)
                else:
                    names, score, close = ["und"] * n, np.zeros(n), np.zeros(n, bool)
                yield pa.RecordBatch.from_arrays([column.slice(k, n), pa.array(names, pa.string()), pa.array(score), pa.array(close | ~letters)], ["doc_id", "lang_pred", "score", "ambiguous"])
                k += n

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
