"""Near-duplicate documents by a chosen-path set similarity join.

Each tree of the join branches documents by a few chosen minwise tokens of their shingle
sets: documents that agree there meet in a node. A first round goes on by further chosen
tokens, laid out as a sort order whose runs are leaves, and confirms on full sets a few of
each leaf's likeliest pairs; these links make classes. A second round compares by sketches
all documents of a small node that aren't in one class yet, those of larger nodes by their
rarest shingles, and confirms every likely pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, components, documents_in, equal_spans, lean, mix, partitions, stored, words_hash, words_in

WORDS = 5
SIMILARITY = 75  # percent
COORDINATES = 64
#: Independent trees; each picks a coordinate with probability 1 / (similarity * coordinates), so about 4/3 at its root.
TREES = 12
#: Most documents that a leaf compares exhaustively, and how many of them the next leaf of the same node sees again.
LEAF, OVERLAP = 192, 16
#: Most documents of a node that are compared exhaustively by sketches; larger nodes go by rare shingles.
SMALL = 128
#: Documents of a block: where more share a shingle, they meet block against block, so that none has to fit a task.
BLOCK = 1 << 16
#: Shingles are counted in 2**_RARITY_BITS buckets, whatever the corpus.
_RARITY_BITS = 20
#: Most doc_ids, with a label 16 bytes each, that are sent to the texts; where there are more, the texts are shuffled to them.
SENT = 1 << 20
#: Places where the copies of one set are looked up.
_SALTS = 32
#: Pairs whose sketches are compared at once.
_PAIRS = 1 << 17
#: Elements of sets that are looked up at once.
_ELEMENTS = 1 << 20
_LOW, _HIGH = 32, 60  # of 64 equal sketch bytes: may be linked, and almost surely is
_DEEPER = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(4)
_ODD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _roots() -> list[tuple[int, int]]:
    """(tree, coordinate) of the root branches; coordinates aren't used twice while there are others."""
    rng, left, found = np.random.default_rng(11), list(range(COORDINATES)), []
    for tree in range(TREES):
        n = max(1, int(rng.binomial(COORDINATES, 100 / (SIMILARITY * COORDINATES))))
        for _ in range(n):
            found.append((tree, left.pop(int(rng.integers(len(left))))))
            left = left or list(range(COORDINATES))
    return found


ROOTS = _roots()
_ROOT_COORDINATES = np.array([x[1] for x in ROOTS])


def shingle_sets(b: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, and their offsets."""
    starts, ends, bounds = words_in(b, at, NOT_BLANK)
    h = words_hash(b, starts, ends, lower=True)
    n = np.diff(bounds)
    sets: list[np.ndarray] = []
    if len(h) >= words:
        s = sum(h[i : len(h) - words + 1 + i] * _STEP[i] for i in range(words))
        s = mix(s)
    for lo, k in zip(bounds[:-1].tolist(), n.tolist(), strict=True):
        if k >= words:
            sets.append(np.unique(s[lo : lo + k - words + 1]))
        elif k:
            sets.append(mix((h[lo : lo + k] * _STEP[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            sets.append(h[:0])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else h[:0]), offsets


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32 minwise tokens by text and coordinate; all ones for empty sets."""
    n = len(offsets) - 1
    out = np.full((n, COORDINATES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        where = offsets[:-1][filled]
        for c in range(COORDINATES):
            out[filled, c] = np.minimum.reduceat(hashes * _ODD[c] + _ADD[c], where) >> np.uint64(32)
    return out


def root_keys(signature: np.ndarray) -> np.ndarray:
    """The node below each root branch."""
    salt = np.array([x[0] * 1000 + x[1] + 1 for x in ROOTS], np.uint64)
    return mix(signature[:, _ROOT_COORDINATES].astype(np.uint64) + (salt << np.uint64(32))).view(np.int64)


def _signatures(documents: DataFrame, words: int) -> DataFrame:
    names = ["doc_id", "n_shingles", "set_hi", "set_lo", "signature", "roots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, k = batch.column("doc_id"), 0
            for ids, b, at in documents_in([batch]):
                hashes, offsets = shingle_sets(b, at, words)
                signature = minwise(hashes, offsets)
                digests = np.frombuffer(b"".join(hashlib.blake2b(hashes[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(ids))), np.int64).reshape(-1, 2)
                roots = pa.FixedSizeListArray.from_arrays(pa.array(root_keys(signature).ravel()), len(ROOTS)).cast(pa.list_(pa.int64()))
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), len(ids), [None, pa.py_buffer(signature.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([column.slice(k, len(ids)), pa.array(np.diff(offsets)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), rows, roots], names)
                k += len(ids)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary, roots array<long>")


def _forest(m: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs with at least _LOW equal bytes."""
    n = len(m)
    best, parent, out, done = m[0].copy(), np.zeros(n, np.int64), [], np.zeros(n, bool)
    done[0] = True
    best[0] = -1
    for _ in range(n - 1):
        j = int(best.argmax())
        if best[j] < 0:
            j = int(np.flatnonzero(~done)[0])
        elif best[j] >= _LOW:
            out.append((int(parent[j]), j))
        done[j] = True
        better = (m[j] > best) & ~done
        parent[better] = j
        best = np.where(done, -1, np.maximum(best, m[j]))
    return out


def _leaf_links(ids: np.ndarray, sketch: np.ndarray) -> tuple[list[int], list[int]]:
    """First candidate links of a leaf, for remaining_links to have few pairs of different classes.

    The first forest has the likeliest pair across each cut; two more, on what sketches
    leave in doubt, stand in where full sets refute it.
    """
    order = np.argsort(ids, kind="stable")
    ids, sketch = ids[order], sketch[order]
    m = (sketch[:, None, :] == sketch[None, :, :]).sum(-1, dtype=np.int16)
    np.fill_diagonal(m, 0)
    root = np.arange(len(ids))
    a, b = [], []
    for turn in range(3):
        pairs = _forest(m)
        for i, j in pairs:
            a.append(int(ids[i]))
            b.append(int(ids[j]))
            if turn == 0 and m[i, j] >= _HIGH:
                root[root == root[j]] = root[i]
        if turn == 0:
            m[root[:, None] == root[None, :]] = 0
        for i, j in pairs:
            m[i, j] = m[j, i] = 0
        if not (m >= _LOW).any():
            break
    return a, b


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with lean():
        yield from _leaves(batches)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts rows sorted by node into leaves and emits their candidate links."""
    key = np.zeros(0, np.int64)
    ids, sketch = key, np.zeros((0, COORDINATES), np.uint8)

    def links(bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        a: list = []
        b: list = []
        size = np.diff(bounds)
        for n in (2, 3, 4):
            at = bounds[:-1][size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    ok = (sketch[at + i] == sketch[at + j]).sum(1) >= _LOW
                    a += ids[at + i][ok].tolist()
                    b += ids[at + j][ok].tolist()
        for lo, n in zip(bounds[:-1][size > 4].tolist(), size[size > 4].tolist(), strict=True):
            for s in range(0, n, LEAF - OVERLAP):
                e = min(n, s + LEAF)
                x, y = _leaf_links(ids[lo + s : lo + e], sketch[lo + s : lo + e])
                a += x
                b += y
                if e == n:
                    break
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.append(key, batch.column("key").to_numpy())
        ids = np.append(ids, batch.column("doc_id").to_numpy())
        sketch = np.concatenate([sketch, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)])
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        last = int(bounds[-1])
        if len(key) - last > 4 * LEAF:  # a large node: what is complete of it goes now
            cut = last + (len(key) - last - OVERLAP) // (LEAF - OVERLAP) * (LEAF - OVERLAP)
            bounds = np.append(bounds, cut + OVERLAP if cut + OVERLAP <= len(key) else len(key))
            keep = bounds[-1] - OVERLAP
        else:
            keep = last
        yield from links(bounds)
        key, ids, sketch = key[keep:], ids[keep:], sketch[keep:]
    if len(key):
        yield from links(np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]))


def plain(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, A-Z in lower case, with one blank after each; and the texts' offsets."""
    starts, ends, bounds = words_in(b, at, NOT_BLANK)
    size = ends - starts
    place = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(place[-1], 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[step + np.repeat(place[:-1], size)] = _LOWER[b[step + np.repeat(starts, size)]]
    return out, place[bounds]


def exact_sets(b: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of each plain text, and their offsets; equal numbers are equal bytes."""
    starts, ends, bounds = words_in(b, at, NOT_BLANK)
    n = np.diff(bounds)
    per = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), per)
    first = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + bounds[:-1][text]
    last = np.minimum(first + words, bounds[1:][text]) - 1
    h = words_hash(b, starts, ends)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0xD6E8FEB86659FD93)))])
    key = mix(h[first] + mix(h[last])) + total[last + 1] - total[first] if len(first) else h[:0]
    lo, size = starts[first], ends[last] - starts[first]
    order = np.lexsort((size, key))
    new = np.append(True, (np.diff(key[order]) != 0) | (np.diff(size[order]) != 0))[: len(order)]
    rank = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][rank] if len(order) else order
    same = equal_spans(b, lo[head], lo[order], size[order])
    for r in np.unique(rank[~same]).tolist():  # chance meetings of hashes, told apart by their bytes
        own: dict[bytes, int] = {}
        for k in np.flatnonzero(rank == r).tolist():
            i = order[k]
            rank[k] = own.setdefault(b[lo[i] : lo[i] + size[i]].tobytes(), r if not own else len(order) + r * len(order) + len(own))
    number = np.empty(len(order), np.int64)
    number[order] = np.unique(rank, return_inverse=True)[1]
    most = int(number.max()) + 1 if len(number) else 1
    pairs = np.unique(text * most + number)
    return pairs % most, np.searchsorted(pairs // most, np.arange(len(n) + 1))


def meetings(signatures: DataFrame) -> DataFrame:
    """Representatives (doc_id, signature, roots) by the nodes where they meet others, with further tokens, sketch and the tokens of all roots."""
    branches = signatures.select("doc_id", F.posexplode("roots").alias("root", "key"))
    shared = branches.groupBy("key").count().where("count > 1").select("key")
    met = branches.join(shared, "key").join(signatures.select("doc_id", "signature"), "doc_id")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            key = batch.column("key").to_numpy()
            seed = mix(key.view(np.uint64).copy())
            steps = [s[np.arange(len(s)), ((seed >> np.uint64(8 * i)) & np.uint64(COORDINATES - 1)).astype(np.int64)].view(np.int32) for i in range(_DEEPER)]
            rows = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.nbytes // len(s)), len(s), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (s.astype(np.uint8), s[:, _ROOT_COORDINATES])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, steps), batch.column("doc_id"), batch.column("root"), *rows], ["key", "p0", "p1", "p2", "doc_id", "root", "sketch", "tokens"])

    return met.mapInArrow(paths, "key long, p0 int, p1 int, p2 int, doc_id long, root int, sketch binary, tokens binary")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of likely links, a few for each document of the nodes."""
    order = ["key", "p0", "p1", "p2", "doc_id"]
    ranged = nodes.select(*order, "sketch").repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_compare, "a long, b long").where("a < b").distinct()


def _all_pairs(extra: dict[str, type], alike: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Of rows sorted by (key, lo, hi, block, label): the pairs of a key, with different labels, that are alike.

    Rows of blocks lo and hi of a key are met by each other, and where lo is hi by their own;
    rows with the same label, which lie side by side, never are.
    """
    names = ["key", "lo", "hi", "block", "doc_id", "label"]

    def links(c: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(bounds)
        at = np.arange(bounds[-1])
        group = np.repeat(np.arange(len(size)), size)
        other = (c["lo"] < c["hi"]) & (c["block"] == c["hi"])  # the second of two blocks
        second = np.repeat(bounds[1:] - np.add.reduceat(other, bounds[:-1], dtype=np.int64), size)
        edge = np.append(np.flatnonzero((np.diff(group) != 0) | (np.diff(c["label"]) != 0)) + 1, len(at))
        run_end = edge[np.searchsorted(edge, at, "right")]
        end = np.repeat(bounds[1:], size)
        first = np.where(other, end, np.where(c["lo"] < c["hi"], second, run_end))
        done = np.concatenate([[0], np.cumsum(end - first)])
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(done, done[s] + _PAIRS, "right")) - 1)
            for lo in range(int(done[s]), int(done[e]), _PAIRS):  # a row may have more than that many
                place = np.arange(lo, min(lo + _PAIRS, int(done[e])))
                i = np.searchsorted(done, place, "right") - 1
                j = first[i] + place - done[i]
                ok = c["label"][i] != c["label"][j]
                i, j = i[ok], j[ok]
                ok = alike(c, i, j)
                x, y = c["doc_id"][i[ok]], c["doc_id"][j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            s = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {x: batch.column(x).to_numpy() for x in names}
            for x, kind in extra.items():
                own = batch.column(x)
                new[x] = np.frombuffer(b"".join(own.to_pylist()), kind).reshape(batch.num_rows, -1) if pa.types.is_binary(own.type) else own.to_numpy()
            held = {x: np.concatenate([held[x], new[x]]) for x in new} if held else new
            bounds = np.flatnonzero(np.append(True, (np.diff(held["key"]) != 0) | (np.diff(held["lo"]) != 0) | (np.diff(held["hi"]) != 0)))
            if len(bounds) > 1:
                yield from links({x: v[: bounds[-1]] for x, v in held.items()}, bounds)
                held = {x: v[bounds[-1] :] for x, v in held.items()}
        if held:
            yield from links(held, np.array([0, len(held["key"])]))

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from run(batches)

    return leanly


def _alike(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have likely enough sketches, each in the first node where its two meet."""
    ok = (c["sketch"][i] == c["sketch"][j]).sum(1) >= _LOW
    ok[ok] = (c["tokens"][i[ok]] == c["tokens"][j[ok]]).argmax(1) == c["root"][i[ok]]
    return ok


def _possible(similarity: int) -> Callable:
    """Which pairs may be similar by their sizes and by the places of the shingle that they share in their orders."""

    def alike(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left = np.minimum(c["size"][i] - c["place"][i], c["size"][j] - c["place"][j])  # they can't share more
        return (100 + similarity) * left >= similarity * (c["size"][i] + c["size"][j])

    return alike


def _dealt(rows: DataFrame, run: Callable) -> DataFrame:
    order = ["key", "lo", "hi"]
    return rows.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "block", "label").mapInArrow(run, "a long, b long")


def remaining_links(nodes: DataFrame, classes: DataFrame, documents: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """All pairs (a, b) of possible links that meet in a node and aren't in one class (node, component) yet.

    Nodes of up to SMALL documents are compared exhaustively, by sketches. Documents of larger
    ones go by their rarest shingles: of sets that share `similarity` percent, one shingle at
    least is in the first part of both, in any order that is the same for all; in the order of
    how many documents have them, hardly any other documents meet there.
    """
    label = F.coalesce("component", "doc_id").alias("label")
    rows = nodes.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "root", label, "sketch", "tokens")
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    mixed = stored(mixed.select("key", (F.col("n") <= SMALL).alias("small")), "mixed")
    one = [F.lit(0).alias(x) for x in ("lo", "hi", "block")]
    small = _dealt(rows.join(mixed.where("small"), "key").select("key", *one, "doc_id", "label", "root", "sketch", "tokens"), _all_pairs({"root": np.int32, "sketch": np.uint8, "tokens": np.uint32}, _alike))
    crowd = stored(rows.select("key", "doc_id", "label").join(mixed.where("not small"), "key").select("doc_id", "label").distinct(), "crowd")
    if crowd.isEmpty():
        return small
    return small.union(_by_rare_shingles(crowd, documents, words, similarity)).distinct()


def _texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is in a stored table that has each id once, with its other columns."""
    texts = documents.select("doc_id", "text")
    if ids.count() <= SENT:
        return texts.join(F.broadcast(ids), "doc_id")
    return texts.repartition(partitions(documents.sparkSession), "doc_id").join(ids.hint("shuffle_hash"), "doc_id")


def _by_rare_shingles(crowd: DataFrame, documents: DataFrame, words: int, similarity: int) -> DataFrame:
    spark = documents.sparkSession
    texts = _texts_of(documents, crowd).select("doc_id", "label", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            for _, b, at in documents_in([batch.select(["doc_id", "text"])]):
                n += np.bincount((shingle_sets(b, at, words)[0] >> np.uint64(64 - _RARITY_BITS)).astype(np.int64), minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["bucket", "n"])

    counts = texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << _RARITY_BITS)
    total[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    crowded = np.packbits(total > BLOCK)
    # eight steps for each doubling are order enough; the table's size doesn't go with the data
    steps = spark.sparkContext.broadcast((np.minimum(np.log2(np.maximum(total, 1)) * 8, 255).astype(np.uint8), crowded))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, crowded = steps.value
        for batch in batches:
            labels, k = batch.column("label").to_numpy(), 0
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])]):
                hashes, offsets = shingle_sets(b, at, words)
                own = labels[k : k + len(ids)]
                k += len(ids)
                size = np.diff(offsets)
                who = np.repeat(np.arange(len(ids)), size)
                bucket = (hashes >> np.uint64(64 - _RARITY_BITS)).astype(np.int64)
                order = np.lexsort((hashes, step[bucket], who))
                place = np.arange(len(order)) - np.repeat(offsets[:-1], size)
                keep = 100 * (size[who] - place) >= similarity * size[who]  # who is sorted, so it is that of order too
                order, place, who = order[keep], place[keep], who[keep]
                hot = (crowded[bucket[order] >> 3] >> (7 - (bucket[order] & 7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[order].view(np.int64)), pa.array(hot.astype(bool)), pa.array(ids[who]), pa.array(own[who]), pa.array(place.astype(np.int32)), pa.array(size[who].astype(np.int32))], ["key", "hot", "doc_id", "label", "place", "size"])

    rows = texts.mapInArrow(firsts, "key long, hot boolean, doc_id long, label long, place int, size int")
    columns = ["doc_id", "label", "place", "size"]
    one = rows.where("not hot").select("key", *[F.lit(0).alias(x) for x in ("lo", "hi", "block")], *columns)
    if not crowded.any():
        return _dealt(one, _all_pairs({"place": np.int32, "size": np.int32}, _possible(similarity)))
    # what may have more documents than a task should hold meets block against block
    hot = rows.where("hot")
    hot = hot.join(hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "key")
    hot = hot.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *columns)
    return _dealt(one.union(hot), _all_pairs({"place": np.int32, "size": np.int32}, _possible(similarity)))


def confirmed(links: DataFrame, documents: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The candidate links (a, b) whose full shingle sets, compared byte by byte, are similar enough."""
    spark = documents.sparkSession
    wanted = stored(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            column, k = batch.column("doc_id"), 0
            for ids, b, at in documents_in([batch]):
                out, places = plain(b, at)
                packed = [small.compress(out[lo:hi].tobytes()) for lo, hi in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column.slice(k, len(ids)), pa.array(packed, pa.binary())], ["doc_id", "words"])
                k += len(ids)

    full = _texts_of(documents, wanted).mapInArrow(sets, "doc_id long, words binary")
    # pairs are dealt by a square of doc_id hashes, and each text goes once to a cell that needs it
    cell = [F.pmod(F.xxhash64(x), F.lit(partitions(spark))).alias(y) for x, y in (("a", "x"), ("b", "y"))]
    pairs = links.select(*cell, "a", "b")
    members = pairs.select("x", "y", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(full, "doc_id")
    rows = members.select("x", "y", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), "words")
    rows = rows.unionByName(pairs.select("x", "y", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("words")))
    dealt = rows.repartition(partitions(spark), "x", "y").sortWithinPartitions("x", "y", "kind", "a", "b")
    return dealt.mapInArrow(_similar(words, similarity), "a long, b long")


def _similar(words: int, similarity: int):
    """Of (x, y, kind, a, b, words) rows, sorted, where each cell's texts (kind 0) precede its pairs: the pairs similar enough."""

    def cell(ids: list[np.ndarray], packed: list[bytes]) -> tuple[np.ndarray, ...]:
        large = zstandard.ZstdDecompressor()
        texts = [large.decompress(x) for x in packed]
        ranks, at = exact_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), words)
        return np.concatenate(ids), ranks, at, np.zeros(int(ranks.max(initial=0)) + 1, bool)

    def shared(ranks: np.ndarray, at: np.ndarray, held: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        """How many elements set i has in common with each other."""
        own = ranks[at[i] : at[i + 1]]
        held[own] = True
        size = at[others + 1] - at[others]
        done = np.concatenate([[0], np.cumsum(size)])
        out, s = [], 0
        while s < len(others):
            e = max(s + 1, int(np.searchsorted(done, done[s] + _ELEMENTS, "right")) - 1)
            places = np.repeat(at[others[s:e]] - done[s:e], size[s:e]) + np.arange(done[s], done[e])
            out.append(np.add.reduceat(held[ranks[places]], done[s:e] - done[s], dtype=np.int64))
            s = e
        held[own] = False
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, packed, known = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, kind, a, b = (batch.column(c).to_numpy() for c in ("x", "y", "kind", "a", "b"))
            bounds = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(kind) != 0), [True]]))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if kind[lo] == 0:
                    if now != (x[lo], y[lo]):
                        now, ids, packed, known = (x[lo], y[lo]), [], [], None
                    ids.append(a[lo:hi])
                    packed += batch.column("words").slice(lo, hi - lo).to_pylist()
                    continue
                if known is None:
                    known = cell(ids, packed)
                    packed = []
                who, ranks, at, held = known
                i, j = np.searchsorted(who, a[lo:hi]), np.searchsorted(who, b[lo:hi])
                runs = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0, [True]]))
                for s, e in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                    both = shared(ranks, at, held, int(i[s]), j[s:e])
                    either = at[i[s] + 1] - at[i[s]] + at[j[s:e] + 1] - at[j[s:e]] - both
                    keep[lo + s : lo + e] = 100 * both >= similarity * either
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from run(batches)

    return leanly


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, component) after further links (a, b)."""
    links = stored(links, "late")
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti")
    classes = stored(classes.unionByName(alone.withColumn("component", F.col("node"))), "early")
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class")), end)
    merged = components(links.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")), "near-late")
    after = classes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("after")), "component", "left")
    return after.select("node", F.coalesce("after", "component").alias("component"))


def near_duplicates(documents: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document.

    Texts are lower-cased (A-Z) and cut at ASCII blanks; documents are linked if their sets
    of distinct shingles overlap by `similarity` percent of their union, and component_id is
    the smallest doc_id reachable. Equal sets are one class from the start and only their
    smallest doc_id goes on, so copies cost nothing. Null, empty and blank texts have no
    shingles and stay alone. Repeated rows stay and share a component; a document with a null
    doc_id represents nobody, and where nothing else is like it, its component is null.
    """
    rows = stored(_signatures(documents, words), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts = classes.where(F.col("first").isNotNull()).select(F.col("first").alias("doc_id"))
    representatives = rows.where("n_shingles > 0").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nodes = stored(meetings(representatives.select("doc_id", "signature", "roots")), "nodes")
    links = stored(candidate_links(nodes), "candidates")
    found = components(confirmed(links, documents, words, similarity), "near")
    rest = stored(remaining_links(nodes, found, documents, words, similarity).join(links, ["a", "b"], "left_anti"), "remaining")
    if not rest.isEmpty():
        found = _joined(found, confirmed(rest, documents, words, similarity))
    # only sets with copies are looked up, and one with very many copies in several places
    copied = classes.where("n > 1").select("set_hi", "set_lo", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias("salt")
    joined = rows.select("doc_id", "n_shingles", "set_hi", "set_lo", salt).join(copied, ["set_hi", "set_lo", "salt"], "left")
    joined = joined.withColumn("own", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    joined = joined.join(found.withColumnRenamed("node", "own"), "own", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "own").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "own"), F.lit(False)).alias("kept"))
