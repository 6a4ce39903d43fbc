"""Byte-level BPE by backtracking over an Aho-Corasick trie.

Bytes become Latin-1 characters, so that pyahocorasick holds every reachable token. A piece
is cut greedily by longest matches; a token is kept if merging could have left it beside
the one before (memoised), else the next shorter token is tried, and a position from which
nothing fits is never entered again. So each position is left at most once, and the ids
are those of the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import REMEMBERED, lean

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks with the tables that backtracking needs.

    Ranks need all 256 single bytes. Tokens that merging never makes are kept for whole
    pieces alone, as they match there before any merging.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 1 << 20):
        self.ranks, self.memo = ranks, memo
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.trie = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            else:
                parts = self._merged(token)
                if len(parts) != 2:
                    continue
                self.split[rank] = (parts[0], parts[1])
                self.pair[parts[0], parts[1]] = rank
            self.size[rank] = len(token)
            self.trie.add_word(token.decode("latin-1"), rank)
        self.shorter: dict[int, int] = {}
        for rank in self.split:
            word = self.bytes_of[rank].decode("latin-1")[:-1]
            n = self.trie.longest_prefix(word) if word else 0
            while n and word[:n] not in self.trie:
                n -= 1
            self.shorter[rank] = self.trie.get(word[:n]) if n else _NONE
        self.longest = max(self.size.values())
        #: Decimal ids and decoded bytes of pieces met before, and how many characters these have.
        self.texts: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.held = 0

    def _merged(self, token: bytes) -> list[int]:
        """The parts of a token before its own merge, by merging lower ranks."""
        own, parts = self.ranks[token], [bytes([x]) for x in token]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank >= own:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens beside each other."""
        key = left, right
        if (known := self.fits.get(key)) is not None:
            return known
        limit, good, split, pair = _NONE, True, self.split, self.pair
        while True:
            if pair.get((left, right), _NONE) < limit:
                good = False
                break
            if left > right:  # the later of the two merges is undone
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        break
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        break
        if len(self.fits) >= self.memo:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a position; all single bytes are tokens."""
        size = self.longest
        trie = self.trie
        part = text[at : at + size]
        part = part[: trie.longest_prefix(part)]
        while (found := trie.get(part, _NONE)) == _NONE:
            part = part[:-1]
        return found

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n, size = piece.decode("latin-1"), len(piece), self.size
        alive = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        at, token = 0, self._longest(text, 0) if n else _NONE
        while token != _NONE:
            last = ids[-1] if ids else _NONE
            while True:
                end = at + size[token]
                if alive[end] and (last == _NONE or self._fit(last, token)):
                    ids.append(token)
                    at = end
                    token = self._longest(text, at) if at < n else _NONE
                    break
                if (less := self.shorter[token]) != _NONE:
                    token = less
                    continue
                alive[at] = 0
                ids.pop()
                at -= size[last]
                token = last
                break
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids and, decoded from these, the bytes of pieces; forgets all others when full."""
        if len(self.texts) >= self.memo // 2 or self.held > 1 << 25:
            self.texts.clear()
            self.decoded.clear()
            self.held = 0
        texts, decoded = self.texts, self.decoded
        for p in pieces:
            if p not in texts:
                ids = self.piece(p.encode())
                texts[p] = ",".join(map(str, ids))
                decoded[p] = self.decode(ids)
                self.held += len(p)

    def both_ways(self, text: str) -> tuple[str, bytes]:
        """The decimal ids of a text, joined by commas, and the bytes that these decode to."""
        pieces = self.cut(text)
        found = list(map(self.texts.get, pieces))
        if None in found:
            self.learn(pieces)
            found = map(self.texts.__getitem__, pieces)
        return ",".join(found), b"".join(map(self.decoded.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return [i for p in self.cut(text) for i in self.piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_open: dict[tuple, Vocabulary] = {}
REMEMBERED["bpe"] = _open.clear


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Vocabulary(load_ranks(path), pattern)
    return _open[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes a text column and decodes the ids again.

    Gives id_col, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids. Null and
    empty texts have no tokens (the hashes are those of no bytes); a row stays a row, also
    if repeated; other columns are left out. The file must be readable on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean("bpe"):
            yield from encoded(batches, vocabulary(path, pattern))

    def encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[], [], [], []]
                for text in part.column(1).to_pylist():
                    ids, decoded = v.both_ways(text or "")
                    out[0].append(ids.count(",") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        out[3].append([int(x) for x in ids.split(",")] if ids else [])
                cols = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array(out[3], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(id_col, text_col).mapInArrow(run, schema)
