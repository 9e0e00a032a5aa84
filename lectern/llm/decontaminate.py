"""Operator 6: benchmark decontamination with an FM-index per training shard.

The test phrases are the windows of ``size`` consecutive words of every
benchmark item (a shorter item is one window). A shard is what a task holds
of the documents at a time. Its words become numbers, its stretches that hold
no run of phrase bigrams as long as the shortest phrase are left out (no
phrase can lie there, so nothing is lost; most of a clean text is), and an
FM-index is built over the rest: suffix order
by prefix doubling, a wavelet matrix over the last column for ranks, and
suffix positions sampled at every stretch's start and at regular distances.
Backward search steps all phrases at once; each occurrence is located by
walking to a sampled position, and occurrences merge into removal spans.

The phrases are broadcast in blocks whose size is measured first: a benchmark
beyond one block takes several passes, whose spans are merged per document.

Defined results: null and empty texts have no words and no hits; an item
without an id or without words takes no part; items that share an id count
once; repeated document rows each get their own result; very long texts are
indexed whole, as a shard of their own; an empty table of documents gives no
rows, an empty benchmark no hits; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, texts

#: Words of a test phrase.
WINDOW = 10
#: Bytes of benchmark text whose phrases one pass broadcasts. As phrases they
#: take some 140 times as much in memory, in the driver and in every task.
BLOCK_BYTES = 1 << 20
#: Documents' bytes that a task turns into one shard.
SHARD_BYTES = 24 << 20
#: Distance of the sampled suffix positions.
SAMPLE = 16

_SEPARATES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATES, b" " * len(_SEPARATES))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then the runs of anything but ASCII punctuation,
    space and control characters."""
    return text.lower().translate(_TO_SPACE).split()


class Phrases:
    """The distinct windows of some items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.word: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.word.setdefault(x, len(self.word) + 1) for x in words(text)]
            for i in range(max(1, len(w) - size + 1) if w else 0):
                of.setdefault(tuple(w[i:i + size]), set()).add(item)
        self.rows = list(of)
        self.items = [sorted(x) for x in of.values()]
        self.length = np.array([len(r) for r in self.rows], np.int64)
        self.matrix = np.zeros((len(self.rows), size), np.int64)     # right-aligned
        for i, r in enumerate(self.rows):
            self.matrix[i, size - len(r):] = r
        self.shortest = int(self.length.min(initial=size))
        self.base = len(self.word) + 1
        self.bigrams = np.unique(np.array([a * self.base + b for r in of for a, b in zip(r, r[1:])] or [-1], np.int64))


def _suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends as soon as all ranks differ."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.diff(t[order], prepend=t[order[:1]]) != 0)
    k = 1
    while rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        k *= 2
    return order


class FMIndex:
    """Over stretches of word numbers (1 and up), joined by separators.

    Each separator sorts as a symbol of its own, so suffixes compare within
    their stretch only; in the last column all separators are 0. Walks never
    cross one: every stretch's start is sampled."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray):
        sizes = np.diff(starts, append=len(tokens))
        n = len(tokens) + len(starts)
        at = np.arange(len(tokens)) + np.repeat(np.arange(len(starts)), sizes)
        gap = starts + sizes + np.arange(len(starts))
        text = np.empty(n, np.int64)
        text[at], text[gap] = tokens + len(starts), np.arange(len(starts))
        order = _suffix_order(text)
        flat = np.zeros(n, np.int64)
        flat[at] = tokens
        last = flat[order - 1]
        self.bits = max(1, int(tokens.max(initial=1)).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=(1 << self.bits) + 1))])
        self.levels = []                     # (zeros, ones before each row) from the top bit down
        col = last
        for level in reversed(range(self.bits)):
            bit = (col >> level) & 1
            self.levels.append((int((bit == 0).sum()), np.concatenate([[0], np.cumsum(bit)])))
            col = np.concatenate([col[bit == 0], col[bit == 1]])
        begin = np.zeros(n, bool)
        begin[0] = True
        begin[gap[:-1] + 1] = True
        marked = (order % SAMPLE == 0) | begin[order]
        self.marked = marked
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.places = order[marked]
        self.n = n

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column above each row."""
        lo = np.zeros_like(row)
        for level, (zeros, ones) in zip(reversed(range(self.bits)), self.levels):
            bit = (symbol >> level) & 1 == 1
            lo, row = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (lo, row))
        return row - lo

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for zeros, ones in self.levels:
            bit = ones[row + 1] - ones[row]
            out = out << 1 | bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return out

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the right-aligned phrases (0 pads on the left), by
        backward search from their last words."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        live = np.arange(len(rows))
        for j in reversed(range(rows.shape[1])):
            live = live[(lo[live] < hi[live]) & (rows[live, j] > 0)]
            sym = rows[live, j]
            inside = sym < 1 << self.bits
            hi[live[~inside]] = lo[live[~inside]] = 0
            live, sym = live[inside], sym[inside]
            lo[live], hi[live] = (self.before[sym] + self.rank(sym, x[live]) for x in (lo, hi))
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of the rows, walked back to a sampled one."""
        place = np.empty_like(row)
        open_, steps = np.arange(len(row)), 0
        row = row.copy()
        while len(open_):
            hit = self.marked[row[open_]]
            done = open_[hit]
            place[done] = self.places[self.marks[row[done]]] + steps
            open_ = open_[~hit]
            r = row[open_]
            s = self.symbol(r)
            row[open_] = self.before[s] + self.rank(s, r)
            steps += 1
        return place


def _stretches(ids: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of phrase words whose neighbours
    are all phrase bigrams, as long as the shortest phrase at least."""
    key = ids[:-1] * p.base + ids[1:]
    sieve = np.zeros(1 << 22, bool)          # most pairs fail here already
    sieve[p.bigrams % len(sieve)] = True
    joined = np.flatnonzero(sieve[key % len(sieve)] & (ids[:-1] > 0) & (ids[1:] > 0))
    found = np.minimum(np.searchsorted(p.bigrams, key[joined]), len(p.bigrams) - 1)
    joined = joined[p.bigrams[found] == key[joined]]
    first = np.flatnonzero(np.diff(joined, prepend=-9) != 1)
    a, b = joined[first], joined[np.append(first[1:], len(joined)) - 1] + 2 if len(joined) else joined
    if p.shortest == 1:                      # a phrase word alone may be a phrase
        alone = ids > 0
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, a, 1)
        np.add.at(covered, b, -1)
        single = np.flatnonzero(alone & (np.cumsum(covered[:-1]) == 0))
        a, b = np.concatenate([a, single]), np.concatenate([b, single + 1])
    long = b - a >= p.shortest
    order = np.argsort(a[long], kind="stable")
    return a[long][order], b[long][order]


def scan(docs: list[bytes], p: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text of a shard: its words, the merged word spans of all
    occurrences, and the items they belong to."""
    n_words, ids = np.zeros(len(docs), np.int64), []
    get = p.word.get
    none = np.zeros(1, np.int64)
    for i, text in enumerate(docs):
        w = words(text)
        n_words[i] = len(w)
        ids += [np.fromiter((get(x, 0) for x in w), np.int64, len(w)), none]
    out = [(n, [], []) for n in n_words.tolist()]
    if not ids or not p.rows:
        return out
    flat = np.concatenate(ids)
    a, b = _stretches(flat, p)
    if not len(a):
        return out
    sizes = b - a
    starts = np.cumsum(sizes) - sizes
    index = FMIndex(flat[np.repeat(a - starts, sizes) + np.arange(sizes.sum())], starts)
    lo, hi = index.search(p.matrix)
    count = hi - lo
    phrase = np.repeat(np.arange(len(lo)), count)
    place = index.locate(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum()))
    stretch = np.searchsorted(starts + np.arange(len(starts)), place, side="right") - 1
    word = a[stretch] + place - starts[stretch] - stretch
    ends = np.cumsum(n_words + 1)
    doc = np.searchsorted(ends, word, side="right")
    word = word - (ends[doc] - n_words[doc] - 1)
    order = np.lexsort((word, doc))
    items: dict[int, set[str]] = {}
    for d, f, at in zip(doc[order].tolist(), phrase[order].tolist(), word[order].tolist()):
        spans, end = out[d][1], at + int(p.length[f])
        if spans and at <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((at, end))
        items.setdefault(d, set()).update(p.items[f])
    for d, found in items.items():
        out[d][2].extend(sorted(found))
    return out


def _shards(batch: pa.RecordBatch, most: int):
    """The batch in slices of about ``most`` bytes of text."""
    size = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset:][:batch.num_rows + 1])
    part = np.cumsum(size) // most
    for v in np.unique(part):
        at = np.flatnonzero(part == v)
        yield batch.slice(at[0], len(at))


_FOUND = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _pass(rows: DataFrame, items: list[tuple[str, bytes]], size: int, keep_text: bool) -> DataFrame:
    p = Phrases(items, size)
    names = [c for c in rows.columns if keep_text or c != "text"]

    def run(batches):
        for batch in batches:
            for part in _shards(batch, SHARD_BYTES):
                found = scan(part.column("text").cast(pa.binary()).to_pylist(), p)
                spans = [[{"first": a, "last": b} for a, b in s] for _, s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names),
                     pa.array([n for n, _, _ in found], pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     pa.array([i for _, _, i in found], pa.list_(pa.string()))],
                    [*names, "n_words", "spans", "items"])
            release()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kept}, {_FOUND}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
               size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """``id, n_words, spans, items`` for every row of ``docs``: ``spans`` are
    the merged word ranges (end exclusive) to remove, ``items`` the sorted
    ids, as strings, of the items with an occurrence. ``keep_text`` adds the
    ``text`` (empty for null)."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")) \
        .filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    need = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-need // block_bytes))
    load = lambda rows: [(r["item"], r["text"].encode("utf-8")) for r in rows.collect()]
    rows = texts(docs, id_col, text_col)
    if blocks == 1:
        return _pass(rows, load(items), size, keep_text)
    # Several passes: number the rows once, then merge each row's finds.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    block = F.pmod(F.xxhash64("item"), F.lit(2 * blocks))
    every = None
    for i in range(2 * blocks):
        # Stored, so that the driver holds the phrases of one pass.
        found = stored(_pass(rows.select("row", "id", "text"), load(items.filter(block == i)), size, False), "decontaminate-pass")
        every = found if every is None else every.unionByName(found)
    both = every.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                                    F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))))
        .otherwise(F.concat(done, F.array(s))))
    own = both.select("row", "id", "n_words", F.when(F.size("spans") > 0, joined).otherwise(F.col("spans")).alias("spans"), "items")
    return (own.join(rows.select("row", "text"), "row") if keep_text else own).drop("row")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    import re

    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:found[a][0]])
        at = found[b - 1][1]
    return "".join(out) + text[at:]
