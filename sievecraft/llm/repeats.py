"""Suffix-array deduplication: repeated windows by a depth-limited radix sort.

A window is a suffix cut at `width` bytes. Windows that are equal have the same anchor, the
smallest hash among their grams, so they are dealt to tasks by it, and a task orders the
suffixes it gets by most-significant-digit passes of eight bytes; what is still together
after the last pass are exactly the repeated windows. Before that a round on anchors alone
tells which can repeat at all, so that only text around shared anchors is moved. Runs of
windows with one anchor travel as one piece of text, and equal pieces as one piece.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _grown, documents_in, equal_spans, lean, mix, partitions, prefix_hash, spans_hash, stored

WIDTH = 50
#: Bytes of the grams whose smallest hash is a window's anchor.
GRAM = 24
#: Anchors and bytes of text that a task gathers before it sends them on.
_HELD, _HELD_BYTES = 1 << 18, 8 << 20
#: Anchors that meet in a bucket, about; a task works on one bucket at a time.
_BUCKET = 150_000
#: Documents with one anchor beyond which its windows are dealt one by one, so that its surroundings don't meet in a task.
_HOT = 30_000
#: Bits of the table of such anchors; its size doesn't go with the data.
_HOT_BITS = 22
#: Windows that are sorted at once.
_SORTED = 1 << 18
#: The internal column of packed spans.
SPANS = "__spans"


def anchors(b: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, past-last start and anchor of each run of windows with one anchor, text by text."""
    n, many = len(b), width - gram + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = prefix_hash(b)
    _, inverse = _grown(n + 1)
    m = mix((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    span = 1
    while span * 2 <= many:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < many:
        m = np.minimum(m[: len(m) - (many - span)], m[many - span :])
    valid = np.ones(len(m) + 1, bool)
    valid[-1] = False
    for back in range(1, width):  # windows that would leave their text
        k = at[1:] - back
        valid[k[(k >= at[:-1]) & (k < len(m))]] = False
    first = valid[:-1].copy()
    first[1:] &= ~valid[:-2] | (m[1:] != m[:-1])
    starts = np.flatnonzero(first)
    # a run ends where the next begins or where no window is
    edge = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1
    stop = np.append(starts[1:], n)
    k = np.searchsorted(edge, starts, "right")
    return starts, np.minimum(stop, edge[np.minimum(k, len(edge) - 1)]) if len(starts) else starts, m[starts]


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of the values, plane by plane: equal high bytes then compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplane(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return out.view("<u8").ravel()


def _bytes_for(top: int) -> int:
    return max(1, -(-int(top).bit_length() // 8))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned values as planes, each with its own number of bytes."""
    out = [struct.pack("<I", len(columns[0]))]
    for x in columns:
        size = _bytes_for(int(x.max())) if len(x) else 1
        out += [bytes([size]), _planes(x, size)]
    return b"".join(out)


def _unpacked(raw: bytes, columns: int) -> tuple[list[np.ndarray], int]:
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(columns):
        size = raw[at]
        out.append(_unplane(raw[at + 1 : at + 1 + n * size], n, size))
        at += 1 + n * size
    return out, at


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _row(bucket: list, kind: list, ids: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "kind", "doc_id", "blob"])


_SCHEMA = "bucket int, kind int, doc_id long, blob binary"


def _answers(groups: int, docs: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """What is found out about documents, packed by the documents' groups, so that the rows don't grow with the documents."""
    if not len(docs):
        return [], []
    where = (mix(docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((*columns[::-1], docs, where))
    docs, where = docs[order], where[order]
    columns = [c[order].astype(np.uint64) for c in columns]
    bounds = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(docs))
    blobs = [struct.pack("<q", docs[lo]) + _packed(_delta(docs[lo:hi] - docs[lo]), *(c[lo:hi] for c in columns)) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return where[bounds[:-1]].tolist(), blobs


def _found(rows: tuple[list[int], list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["group", "blob"])


def _leanly(run: Callable) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from run(batches)

    return task


def _per_document(columns: int):
    """One row for each document from the packed answers; one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            docs, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cols[0], docs))
            docs, cols = docs[order], [c[order] for c in cols]
            bounds = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs))
            for k in range(0, len(bounds) - 1, 4096):
                part = bounds[k : k + 4097].tolist()
                blobs = [_packed(*(c[lo:hi] for c in cols)) for lo, hi in zip(part[:-1], part[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[part[:-1]]), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

        for batch in batches:
            for g, raw in zip(batch.column("group").to_pylist(), batch.column("blob"), strict=True):
                if g != group and held:
                    yield from flush()
                    held = []
                group, raw = g, raw.as_py()
                (d, *cols), _ = _unpacked(raw[8:], columns + 1)
                held.append((np.cumsum(d, dtype=np.uint64).astype(np.int64) + struct.unpack_from("<q", raw)[0], *cols))
        if held:
            yield from flush()

    return _leanly(run)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash's upper half."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _send_anchors(width: int, gram: int, cut: int, buckets: int):
    """Anchors by bucket, each once a batch; documents that share one inside the batch get their answer here."""

    def flush(h: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[once], d[once]
        new = np.append(True, h[1:] != h[:-1])
        bounds = np.append(np.flatnonzero(new), len(h))
        count = np.diff(bounds)
        many = np.repeat(count > 1, count)
        groups, packed = _answers(buckets, d[many], h[many] >> np.uint64(cut))
        yield _row(groups, [1] * len(groups), groups, packed)
        h, d, told = h[bounds[:-1]], d[bounds[:-1]], count > 1
        cuts = np.searchsorted(_bucket_of(h, buckets), np.arange(buckets + 1))
        ids, blobs, where = [], [], []
        for k in range(buckets):
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            if lo < hi:
                base, own = np.unique(d[lo:hi][~told[lo:hi]], return_inverse=True)
                who = np.zeros(hi - lo, np.int64)  # 0: its documents know already
                who[~told[lo:hi]] = own + 1
                first = int(base[0]) if len(base) else 0
                where.append(k)
                ids.append(first)
                blobs.append(_packed(_delta(base - first)) + _packed(_delta(h[lo:hi] >> np.uint64(cut)), who.astype(np.uint64), count[lo:hi].astype(np.uint64)))
        yield _row(where, [0] * len(where), ids, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        ds: list[np.ndarray] = []
        held = 0
        for ids, b, at in documents_in(batches):
            starts, _, h = anchors(b, at, width, gram)
            hs.append(h)
            ds.append(ids[np.searchsorted(at, starts, "right") - 1])
            held += len(h)
            if held >= _HELD:
                yield from flush(np.concatenate(hs), np.concatenate(ds))
                hs, ds, held = [], [], 0
        if held:
            yield from flush(np.concatenate(hs), np.concatenate(ds))

    return run


def _shared_anchors(buckets: int, hot: int):
    """Answers each document with its anchors that another document has; one bucket after another.

    Rows of group -1 hold places in the table of anchors that more than `hot` documents have.
    """

    def flush(hs: list[np.ndarray], ds: list[np.ndarray], told: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        h, d, t, n = (np.concatenate(x) for x in (hs, ds, told, ns))
        order = np.argsort(h, kind="stable")
        h, d, t, n = h[order], d[order], t[order], n[order]
        bounds = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        count = np.diff(bounds)
        keep = np.repeat(count > 1, count) & ~t
        many = h[bounds[:-1]][np.add.reduceat(n, bounds[:-1]) > hot]
        return d[keep], h[keep], many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        out: list[tuple] = []
        size = 0

        def bucket_done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                d, h, many = flush(*map(list, zip(*held, strict=True)))
                held = []
                out.append((d, h))
                size += len(d)
                if len(many):
                    yield _found(([-1], [_packed(_hot_place(many))]))

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == 1).any():
                own = batch.filter(pa.array(kinds == 1))
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int32()), own.column("blob")], ["group", "blob"])
            for i in np.flatnonzero(kinds == 0).tolist():
                k = batch.column("bucket")[i].as_py()
                if k != bucket:
                    yield from bucket_done()
                    if size >= _HELD:
                        yield _found(_answers(buckets, *(np.concatenate(x) for x in zip(*out, strict=True))))
                        out, size = [], 0
                bucket = k
                raw, first = batch.column("blob")[i].as_py(), batch.column("doc_id")[i].as_py()
                (base,), at = _unpacked(raw, 1)
                (h, who, n), _ = _unpacked(raw[at:], 3)
                docs = np.append(np.int64(0), np.cumsum(base, dtype=np.uint64).astype(np.int64) + first)
                held.append((np.cumsum(h, dtype=np.uint64), docs[who.astype(np.int64)], who == 0, n.astype(np.int64)))
        yield from bucket_done()
        if out:
            yield _found(_answers(buckets, *(np.concatenate(x) for x in zip(*out, strict=True))))

    return _leanly(run)


def _hot_place(h: np.ndarray) -> np.ndarray:
    """The place of (shortened) anchors in the table of hot ones."""
    return mix(h.astype(np.uint64)) >> np.uint64(64 - _HOT_BITS)


def _kinds(b: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, lo: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns sorted by anchor and bytes, then document and start, and whether each piece is the first of its bytes.

    Hashes of the contents bring equal pieces together; then their bytes are compared.
    """
    sub = np.zeros(len(h), np.int64)
    while True:
        order = np.lexsort((start, doc, sub, size, content, h))
        h, doc, start, lo, size, content, sub = (x[order] for x in (h, doc, start, lo, size, content, sub))
        new = np.append(True, (h[1:] != h[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1]) | (sub[1:] != sub[:-1]))[: len(h)]
        kind = np.cumsum(new) - 1
        rest = np.flatnonzero(~new)
        same = equal_spans(b, lo[np.flatnonzero(new)[kind[rest]]], lo[rest], size[rest])
        if same.all():
            return h, doc, start, lo, size, content, new
        for k in np.unique(kind[rest[~same]]).tolist():  # contents whose hashes meet by chance or design
            known: dict[bytes, int] = {}
            for i in np.flatnonzero(kind == k).tolist():
                sub[i] = known.setdefault(b[lo[i] : lo[i] + size[i]].tobytes(), len(known))


def _send_pieces(width: int, gram: int, cut: int, buckets: int, hot: np.ndarray):
    """The text of each run of windows whose anchor is shared, by anchor; of equal pieces the smallest document's.

    Other documents with the same piece get their answer here: all of it is in a smaller one.
    Windows with a hot anchor are pieces of their own and dealt by all their bytes.
    """

    def merged(b: np.ndarray, *cols: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """The pieces of the smallest documents that have them, and document, start and size of the others."""
        h, doc, start, lo, size, content, new = _kinds(b, *cols)
        later = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        return tuple(x[~later] for x in (h, doc, start, lo, size, content)), tuple(x[later] for x in (doc, start, size))

    def flush(text: list[np.ndarray], cols: list[tuple]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        b = np.concatenate(text)
        doc, start, lo, size, h, content = (np.concatenate(x) for x in zip(*cols, strict=True))
        (h, doc, start, lo, size, _), told = merged(b, h, doc, start, lo, size, content)
        crowded = hot[(_hot_place(h >> np.uint64(cut)) >> np.uint64(3)).astype(np.int64)] >> (_hot_place(h >> np.uint64(cut)) & np.uint64(7)).astype(np.uint8) & 1 > 0
        if crowded.any():
            n = size[crowded] - width + 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(lo[crowded], n) + step
            key = spans_hash(prefix_hash(b), at, at + width)
            own, more = merged(b, key, np.repeat(doc[crowded], n), np.repeat(start[crowded], n) + step, at, np.full(len(at), width), key)
            told = tuple(np.concatenate(x) for x in zip(told, more, strict=True))
            h, doc, start, lo, size = (np.concatenate([x[~crowded], y]) for x, y in zip((h, doc, start, lo, size), own[:5], strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, start, lo, size = (x[order] for x in (h, doc, start, lo, size))
        groups, packed = _answers(buckets, *told)
        yield _row(groups, [1] * len(groups), groups, packed)
        cuts = np.searchsorted(_bucket_of(h, buckets), np.arange(buckets + 1))
        ids, blobs, where = [], [], []
        for k in range(buckets):
            i, j = int(cuts[k]), int(cuts[k + 1])
            if i < j:
                base = int(doc[i:j].min())
                head = _packed(_delta(h[i:j]), (doc[i:j] - base).astype(np.uint64), start[i:j].astype(np.uint64), size[i:j].astype(np.uint64))
                blobs.append(head + small.compress(b"".join(b[s : s + n].tobytes() for s, n in zip(lo[i:j].tolist(), size[i:j].tolist(), strict=True))))
                ids.append(base)
                where.append(k)
        if where:
            yield _row(where, [0] * len(where), ids, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[np.ndarray] = []
        cols: list[tuple] = []
        held = 0
        for batch in batches:
            k, shared = 0, batch.column("shared")
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])]):
                starts, stops, h = anchors(b, at, width, gram)
                who = np.searchsorted(at, starts, "right") - 1
                keep = np.zeros(len(starts), bool)
                cuts = np.searchsorted(who, np.arange(len(ids) + 1))
                for i in range(len(ids)):
                    lo, hi = cuts[i], cuts[i + 1]
                    if lo < hi:
                        own = _unpacked(shared[k + i].as_py(), 1)[0][0]
                        keep[lo:hi] = np.isin(h[lo:hi] >> np.uint64(cut), own)
                k += len(ids)
                starts, stops, h, who = starts[keep], stops[keep], h[keep], who[keep]
                if not len(starts):
                    continue
                size = stops - starts + width - 1
                content = spans_hash(prefix_hash(b), starts, starts + size)
                cols.append((ids[who], starts - at[who], starts + held, size, h, content))
                text.append(b)
                held += len(b)
                if held >= _HELD_BYTES:
                    yield from flush(text, cols)
                    text, cols, held = [], [], 0
        if cols:
            yield from flush(text, cols)

    return _leanly(run)


def repeated(b: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and group of the suffixes of b that equal another one of their group on `width` bytes.

    Most-significant-digit passes of eight bytes; what is alone after a pass is dropped.
    """
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, group = np.arange(len(suffixes)), groups
    for depth in range(0, width, 8):
        depth = min(depth, max(0, width - 8))
        digit = words[suffixes[order] + depth].copy().view(">u8").ravel()
        if width < 8:
            digit = digit >> np.uint64(8 * (8 - width))
        k = np.lexsort((digit.astype(np.uint64), group))
        order, group, digit = order[k], group[k], digit[k]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(new)
        size = np.bincount(group)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        if not len(order):
            break
    return order, group


def _contents(b: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece's bytes; pieces lie side by side and are hashed about a megabyte at a time."""
    out, i = np.zeros(len(lo), np.uint64), 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(lo, lo[i] + (1 << 20))))
        end = lo[j - 1] + size[j - 1]
        out[i:j] = spans_hash(prefix_hash(b[lo[i] : end]), lo[i:j] - lo[i], lo[i:j] + size[i:j] - lo[i])
        i = j
    return out


def _covered(b: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, lo: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces' parts that a smaller document has; pieces come sorted by anchor."""
    h, doc, start, lo, size, _, new = _kinds(b, h, doc, start, lo, size, _contents(b, lo, size))
    at = np.flatnonzero(new)
    kind = np.cumsum(new) - 1
    later = doc != doc[at][kind]
    out = [(doc[later], start[later], size[later])]
    # distinct pieces whose anchor has others
    anchor = h[at]
    group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
    some = np.bincount(group)[group] > 1
    if some.any():
        pick = np.flatnonzero(some)
        windows = size[at][pick] - width + 1
        owner = np.repeat(pick, windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        o, g = repeated(b, lo[at][owner] + offset, group[owner], width)
        if len(o):
            who = doc[at][owner[o]]
            edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            least = np.minimum.reduceat(who, edge)[np.cumsum(np.append(True, g[1:] != g[:-1])) - 1]
            o = np.sort(o[who > least])
            # runs of covered windows of a piece
            if len(o):
                head = np.append(True, (o[1:] != o[:-1] + 1) | (owner[o[1:]] != owner[o[:-1]]))
                i = np.flatnonzero(head)
                j = np.append(i[1:], len(o)) - 1
                piece, s, n = owner[o[i]], offset[o[i]], o[j] - o[i] + width
                # each place where the smallest document has this piece
                places = np.flatnonzero(~later)
                by = kind[places]
                a, z = np.searchsorted(by, piece), np.searchsorted(by, piece, "right")
                times = z - a
                k = places[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                out.append((doc[k], start[k] + np.repeat(s, times), np.repeat(n, times)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sort_pieces(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def flush() -> Iterator[tuple]:
            b = np.concatenate([x[0] for x in held])
            shift = np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[1]) for x in held])
            h, doc, start, lo, size = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
            lo = lo + shift
            order = np.argsort(h, kind="stable")
            h, doc, start, lo, size = (x[order] for x in (h, doc, start, lo, size))
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            done = np.cumsum(size - width + 1)
            k = 0
            while k < len(h):  # whole anchors, about _SORTED windows at a time
                top = (done[k - 1] if k else 0) + _SORTED
                j = int(np.searchsorted(done, top, "right"))
                e = np.searchsorted(edge, max(j, k + 1))
                j = int(edge[e]) if e < len(edge) else len(h)
                # these pieces side by side, out of the bucket's text
                own = np.concatenate([b[s : s + n] for s, n in zip(lo[k:j].tolist(), size[k:j].tolist(), strict=True)])
                where = np.cumsum(size[k:j]) - size[k:j]
                yield _covered(own, h[k:j], doc[k:j], start[k:j], where, size[k:j], width)
                k = j

        out: list[tuple] = []
        count = 0

        def gathered(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, out, count
            if held:
                for x in flush():
                    out.append(x)
                    count += len(x[0])
            held = []
            if out and (last or count >= _HELD):
                yield _found(_answers(buckets, *(np.concatenate(x) for x in zip(*out, strict=True))))
                out, count = [], 0

        grown = zstandard.ZstdDecompressor()
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == 1).any():
                own = batch.filter(pa.array(kinds == 1))
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int32()), own.column("blob")], ["group", "blob"])
            for i in np.flatnonzero(kinds == 0).tolist():
                k = batch.column("bucket")[i].as_py()
                if k != bucket:
                    yield from gathered(False)
                bucket = k
                raw, base = batch.column("blob")[i].as_py(), batch.column("doc_id")[i].as_py()
                (h, doc, start, size), at = _unpacked(raw, 4)
                size = size.astype(np.int64)
                held.append((np.frombuffer(grown.decompress(raw[at:]), np.uint8), np.cumsum(h, dtype=np.uint64), doc.astype(np.int64) + base, start.astype(np.int64), np.cumsum(size) - size, size))
        yield from gathered(True)

    return _leanly(run)


def _union(spans: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of the packed spans, which are sorted by start."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (s, n), _ = _unpacked(spans, 2)
    s = s.astype(np.int64)
    e = np.maximum.accumulate(s + n.astype(np.int64))
    first = np.append(True, s[1:] > e[:-1])
    return s[first], e[np.append(np.flatnonzero(first)[1:] - 1, len(e) - 1)]


def _plan_for(documents: DataFrame, width: int, gram: int) -> tuple[int, int]:
    """Low hash bits that the first round leaves out and buckets a partition, by the optimizer's size of the input.

    So few bits go that chance meetings stay rare; one only moves some text in vain, as the
    second round compares bytes. Text is taken to be twice its stored size.
    """
    size = max(2, int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # the optimizer can't tell, as for rows that come from no files
        return 0, 64
    found = 2 * size * 2 // (width - gram + 2)
    return 64 - min(64, max(40, math.ceil(math.log2(size)) + 18)), max(1, -(-found // (_BUCKET * partitions(documents.sparkSession))))


def covered_spans(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = _HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the documents with an id, dealt by it, and doc_id with the packed spans that smaller documents have."""
    spark = documents.sparkSession
    tasks = partitions(spark)
    cut, each = _plan_for(documents, width, gram)
    buckets = tasks * each
    known = documents.where(F.col("doc_id").isNotNull())
    sent = known.select("doc_id", "text").mapInArrow(_send_anchors(width, gram, cut, buckets), _SCHEMA)

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartitionById(tasks, F.col(by) % tasks).sortWithinPartitions(by)

    found = stored(dealt(sent, "bucket").mapInArrow(_shared_anchors(buckets, hot), "group int, blob binary"), "anchors")
    crowded = np.zeros(1 << (_HOT_BITS - 3), np.uint8)
    for row in found.where("group < 0").select("blob").distinct().toLocalIterator():  # places in a table of fixed size
        place = _unpacked(bytes(row.blob), 1)[0][0].astype(np.int64)
        np.bitwise_or.at(crowded, place >> 3, (1 << (place & 7)).astype(np.uint8))
    shared = dealt(found.where("group >= 0"), "group").mapInArrow(_per_document(1), "doc_id long, blob binary").withColumnRenamed("blob", "shared")
    texts = known.repartition(tasks, "doc_id")
    pieces = texts.join(shared.hint("shuffle_hash"), "doc_id").select(texts.doc_id, texts.text, shared.shared).mapInArrow(_send_pieces(width, gram, cut, buckets, crowded), _SCHEMA)
    covered = dealt(pieces, "bucket").mapInArrow(_sort_pieces(width, buckets), "group int, blob binary")
    return texts, dealt(covered, "group").mapInArrow(_per_document(2), "doc_id long, blob binary").withColumnRenamed("blob", SPANS)


def _cut(own: np.ndarray, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text's bytes, and how many runs went."""
    s, e = _union(spans)
    s, e = s[s < len(own)], np.minimum(e[s < len(own)], len(own))
    raw = own.tobytes()
    if not len(s):
        return raw, 0
    return b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True)), len(s)


def remove_repeats(documents: DataFrame, width: int = WIDTH, hot: int = _HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document.

    Removed is each byte covered by a window of `width` bytes that also starts in a document
    with a smaller doc_id. Null is empty; texts shorter than a window lose nothing; a null
    doc_id is neither a source nor cut; rows with the same doc_id don't cut each other and
    lose what either's windows lose at these offsets. Other columns are left out.
    """
    documents = documents.select("doc_id", "text")
    texts, spans = covered_spans(documents, width, hot=hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, all_spans, k = batch.column("doc_id"), batch.column(SPANS), 0
            for ids, b, at in documents_in([batch.select(["doc_id", "text"])]):
                rows = []
                for i in range(len(ids)):
                    own = b[at[i] : at[i + 1]]
                    kept, n = _cut(own, all_spans[k + i].as_py())
                    rows.append((len(own), len(own) - len(kept), n, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([column.slice(k, len(ids)), *map(pa.array, zip(*rows, strict=True))], schema.replace(" long", "").replace(" string", "").split(", "))
                k += len(ids)

    cut = texts.join(spans.hint("shuffle_hash"), "doc_id", "left").mapInArrow(run, schema)
    nobody = documents.where(F.col("doc_id").isNull()).withColumn(SPANS, F.lit(None).cast("binary")).mapInArrow(run, schema)
    return cut.unionByName(nobody)


def without_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, with the bytes that remove_repeats counts cut out of text.

    Parts of a character that a cut went through go too; n_chars, if there, follows the new
    text. Documents of which nothing is left stay, with empty texts; null texts stay null.
    """
    texts, spans = covered_spans(documents, width)
    cut = texts.join(spans.hint("shuffle_hash"), "doc_id", "left").select(texts["*"], spans[SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text, packed in zip(part.column("text").to_pylist(), part.column(SPANS), strict=True):
                    if text is not None and packed.is_valid:
                        text = _cut(np.frombuffer(text.encode(), np.uint8), packed.as_py())[0].decode("utf-8", "ignore")
                    rows.append(text)
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(rows, pa.string()))
                yield part.select([c for c in part.schema.names if c != SPANS])

    out = cut.mapInArrow(run, documents.schema).unionByName(documents.where(F.col("doc_id").isNull()))
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out
