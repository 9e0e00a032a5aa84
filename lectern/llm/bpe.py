"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

*Encoding.* A text is cut where any tokenizer match must end (after another
character, before white space: no alternative of the pattern holds white
space behind anything else), so the parts' ids simply concatenate. Each match
of the pattern in a part is one byte string, and its encoding is a tree
reduction: halves are encoded recursively and two neighbours are joined by
re-encoding a window of tokens around their border, doubled until the tokens
outside provably stay. The tree's leaves are short strings, which a batch
encodes together.

*Why the join is exact.* Call two tokens compatible when encoding their
joined bytes gives the two back. If all neighbours in a sequence are
compatible, the sequence is the encoding of its bytes: consider the first
merge, in rank order, that would cross a border; until then every token has
evolved as it does alone, so the same merge would have crossed that border
in the pair. The window's tokens are compatible with each other (they are an
encoding), and so are those outside; the join checks the two seams. The
argument needs every token to encode to itself, which ``Ranks`` checks.

*Decoding* concatenates the tokens' bytes up a tree.

Null and empty texts have no tokens (empty ``ids``, digest of the empty
string). Repeated rows give repeated results; null ids of rows pass through.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, slices, texts

#: Bytes below which a match is encoded in one go, and entries of each of a
#: task's caches.
LEAF_BYTES = 48
CACHE = 150_000
#: Ids below which decoding joins in one go.
LEAF_IDS = 1 << 14
_NEVER = 1 << 62


def read_ranks(path: str) -> bytes:
    """The rank file as it is: under 1 MB, so it travels with the tasks and
    executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


class Ranks:
    """A rank file's vocabulary with the merge of one byte string.

    ``check`` verifies that every token encodes to itself (the premise of
    the join); it costs about a second and is for the driver or tests."""

    def __init__(self, file: bytes, check: bool = False):
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file.splitlines())}
        self.token = {r: t for t, r in self.rank.items()}
        self._fits: dict[int, bool] = {}
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None
        if check and (bad := [t for t in self.rank if self.merge(t) != [self.rank[t]]]):
            raise ValueError(f"{len(bad)} tokens do not encode to themselves, e.g. {bad[0]!r}")

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        if len(data) > 64:
            return self._merge_long(data)
        rank = self.rank
        parts = [data[i:i + 1] for i in range(len(data))]
        open_ = [rank.get(data[i:i + 2], _NEVER) for i in range(len(data) - 1)]
        while open_ and (best := min(open_)) != _NEVER:
            i = open_.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del open_[i]
            if i < len(open_):
                open_[i] = rank.get(parts[i] + parts[i + 1], _NEVER)
            if i:
                open_[i - 1] = rank.get(parts[i - 1] + parts[i], _NEVER)
        return [rank[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of the open merges over a linked list."""
        rank, n = self.rank, len(data)
        end = list(range(1, n + 1))          # of the part that starts here
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if prev[i] is None or (j := end[i]) >= e or end[j] != e or j >= n or prev[j] is None:
                continue                     # one of its parts has changed
            end[i], prev[j] = e, None
            if e < n:
                prev[e] = i
                if (r := rank.get(data[i:end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := rank.get(data[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i:end[i]]])
            i = end[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        if (known := self._fits.get(a << 32 | b)) is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every way to build a token from two: sorted keys (left id, right
        id) and the token's id, which is also the merge's rank."""
        if self._pairs is None:
            rank = self.rank
            found = sorted((a << 20 | b, r) for t, r in rank.items() for i in range(1, len(t))
                           if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None)
            self._pairs = tuple(np.array(x, np.int64) for x in zip(*found))
        return self._pairs

    def leaves(self, strings: list[bytes]) -> list[bytes]:
        """``merge`` of many short byte strings at once, packed: a round does
        the next merge of every string that has one left."""
        keys, merged = self.pairs()

        def ranked(left, right):
            key = left << 20 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, merged[at], _NEVER)

        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        ids = byte[np.frombuffer(b"".join(strings), np.uint8)]
        of = np.repeat(np.arange(len(strings)), sizes)
        best = np.full(len(ids), _NEVER)     # rank of a part's merge with the next
        best[:-1] = np.where(of[:-1] == of[1:], ranked(ids[:-1], ids[1:]), _NEVER)
        out = [b""] * len(strings)
        while len(ids):
            start = np.flatnonzero(np.diff(of, prepend=-1))
            low = np.minimum.reduceat(best, start)
            size = np.diff(start, append=len(ids))
            if (over := low == _NEVER).any():
                stay = ~np.repeat(over, size)
                flat, ends = _pack(ids[~stay]), (4 * np.cumsum(size[over])).tolist()
                for k, a, b in zip(of[start[over]].tolist(), [0, *ends], ends):
                    out[k] = flat[a:b]
                ids, of, best, low, size = ids[stay], of[stay], best[stay], low[~over], size[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(best == np.repeat(low, size))
            at = at[np.diff(of[at], prepend=-1) != 0]        # the leftmost of each string
            ids[at] = best[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, of, best = ids[stay], of[stay], best[stay]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):                   # the pairs that the merge has changed
                last = np.minimum(i + 1, len(ids) - 1)
                same = (of[i] == of[last]) & (last > i)
                best[i] = np.where(same, ranked(ids[i], ids[last]), _NEVER)
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of both sides' bytes."""
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            mid = self.merge(b"".join(map(self.token.__getitem__, chain(left[a:], right[:b]))))
            if (a == 0 or self.fits(left[a - 1], mid[0])) and (b == len(right) or self.fits(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            k *= 2

    def encode(self, data: bytes) -> list[int]:
        """One match's ids."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.encode(data[:mid]), self.encode(data[mid:]))


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, file: bytes, pattern: str):
        import re

        import regex

        self.ranks = Ranks(file)
        self.find = regex.compile(pattern).findall
        # A text of no other white space than these six splits before every
        # run of them that follows another character.
        self.odd = regex.compile(r"[^\S\x20\t-\r]").search
        self.split = re.compile(r"[\x20\t-\r]*[^\x20\t-\r]+|[\x20\t-\r]+").findall
        self.known: dict[str, bytes] = {}
        token = [self.ranks.token.get(i, b"") for i in range(max(self.ranks.token) + 1)]
        self.size = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Spans between safe cuts that are not yet known are encoded
        together, each once; a text's ids are its spans' ids, joined."""
        spans = [[t] if self.odd(t) else self.split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list(set(chain.from_iterable(spans)).difference(known))
        matches = [[w] if w.isascii() and w[1:].isalpha() and w[0] == " " else self.find(w) for w in new]
        pieces = {w: w.encode("utf-8") for w in chain.from_iterable(matches)}
        short = {w: b for w, b in pieces.items() if len(b) <= LEAF_BYTES}
        ids = dict(zip(short, self.ranks.leaves(list(short.values()))))
        ids.update((w, _pack(self.ranks.encode(b))) for w, b in pieces.items() if len(b) > LEAF_BYTES)
        known.update((w, b"".join(map(ids.__getitem__, m))) for w, m in zip(new, matches))
        out = [b"".join(map(known.__getitem__, ws)) for ws in spans]
        for w in new:
            if len(w) > LEAF_BYTES:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The ids' bytes: halves concatenated, a leaf gathered at once."""
        if len(ids) > 4 * LEAF_IDS:
            mid = len(ids) // 8 * 4
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        at = np.frombuffer(ids, "<u4")
        size = self.size[at]
        done = np.cumsum(size)
        return self.bytes[np.repeat(self.start[at] - done + size, size) + np.arange(size.sum())].tobytes()


def encode(df: DataFrame, ranks_file: bytes, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """``id, n_tokens long, ids binary`` for every row; ``ids`` packs the
    token ids as little-endian unsigned 32-bit integers (``unpack`` and
    ``decode`` read it)."""

    def run(batches):
        enc = Encoder(ranks_file, pattern)
        for b in batches:
            for part in slices(b):
                ids = enc.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "n_tokens", "ids"])
            release()

    rows = texts(df, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_file: bytes) -> DataFrame:
    """``encoded`` (``id, n_tokens, ids``) with a last column ``decoded``
    binary: the bytes the ids stand for."""

    def run(batches):
        enc = Encoder(ranks_file, "x")
        for b in batches:
            for part in slices(b, "ids"):
                out = [enc.decode(x.as_py()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                 ["id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "n_tokens", "ids").mapInArrow(
        run, f"id {kind}, n_tokens long, ids binary, decoded binary")


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
