"""Operator 8: toxicity by averaged subword embeddings and a linear softmax.

A text is the bag of its words' character n-grams (3 to 6 characters of
``<word>``, and the word itself), each hashed to one of ``BUCKETS`` rows of an
embedding table. A word that stands n times weighs log2(1 + n), so that a text
repeating one word is not decided by it. The n-grams' average goes through a softmax over two classes. Table
and softmax are trained together, in numpy, on a bounded sample of labelled
rows; a misspelling not seen in training shares most n-grams with words that
were. Scoring runs over all rows: a word's part of the score is a sum over
its n-grams, computed once per task, and a text's score follows from the sums
of its words, however long it is.

Defined results: null and empty texts (and texts without words) score what
the softmax gives a zero average, the bias alone; without usable labels of
both classes every score is 0.0. A label row that repeats counts once, as toxic if any of
its rows is. Repeated documents get equal scores; an empty table of documents
gives no rows, whatever the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, stored, texts
from .decontaminate import _TO_SPACE

#: Weight of a text without words as a clean one, against all others' sum: what
#: holds no evidence is not toxic.
EMPTY_WEIGHT = 0.25
#: Labelled rows to learn from, at most, and bytes of their texts. A quarter
#: of them only sets the scores' scale.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 32 << 20
BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
DIM = 4
STEPS = 100
RATE = 0.1
TABLE_RATE = 3.0
#: Zero rows averaged in with every text, so that a few words alone decide little.
PADDING = 1500.0
#: Words of training texts that an n-gram must stand in, each text's word once:
#: a share of the texts, and two at least.
LEAST_SHARE = 0.003
#: Weight of a toxic row's loss against a clean one's.
TOXIC_WEIGHT = 3.0
#: Words whose n-grams are made together.
TOGETHER = 20_000
#: Words whose sums a task keeps, and bytes up to which a word is kept.
CACHE = 150_000
CACHED_BYTES = 64


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(_TO_SPACE).split()


def grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of the words, word after word, and how
    many each word has; some words at a time, so that memory holds little
    beside the result."""
    parts = [_grams(vocabulary[i:i + TOGETHER]) for i in range(0, len(vocabulary), TOGETHER)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def _grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A window's hash is a polynomial over code points."""
    joined = "".join(f"<{w.decode('utf-8', 'replace')}>" for w in vocabulary)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(code == ord("<"))       # neither sign is ever part of a word
    size = np.diff(first, append=len(code))
    of = np.repeat(np.arange(len(first)), size)
    left = np.repeat(first + size, size) - np.arange(len(code))      # characters from here to the word's end
    place = np.arange(len(code))
    found, word = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h * np.uint64(0x100000001B3)
        h[:len(code) - n + 1] += code[n - 1:]
        if n in GRAMS:
            at = place[left >= n]
            found.append(h[at] ^ np.uint64(n << 32))
            word.append(of[at])
    whole = np.add.reduceat(code * (place - np.repeat(first, size) + 31).astype(np.uint64) ** np.uint64(5), first) if len(first) else code
    found.append(whole)
    word.append(np.arange(len(first)))
    h, word = np.concatenate(found), np.concatenate(word)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(word, kind="stable")
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[order], np.bincount(word, minlength=len(vocabulary))


def _sums(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each range of ``x``; 0.0 for an empty one."""
    out = np.zeros(len(start))
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(x, start[full])
    return out


class Model:
    """``part``: what an n-gram of a bucket adds to the difference of the two
    classes' logits, before averaging."""

    def __init__(self, part: np.ndarray, bias: float, empty: bool = False):
        self.part, self.bias, self.empty = part.astype(np.float32), bias, empty
        self.known: dict[bytes, int] = {}
        self.sum = self.count = np.zeros(0)

    def score(self, docs: list[str]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(docs))
        found = [words(t) for t in docs]
        if len(self.sum) > CACHE:
            self.known, self.sum, self.count = {}, np.zeros(0), np.zeros(0)
        new = list(set().union(*found).difference(self.known)) if found else []
        if new:
            bucket, count = grams(new)
            start = np.cumsum(count) - count
            self.known.update(zip(new, range(len(self.sum), len(self.sum) + len(new))))
            self.sum = np.concatenate([self.sum, np.add.reduceat(self.part[bucket].astype(np.float64), start)])
            self.count = np.concatenate([self.count, count])
        logit = np.full(len(docs), self.bias)
        for i, ws in enumerate(found):
            if ws:
                at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
                at, times = np.unique(at, return_counts=True)
                times = np.log2(1.0 + times)
                logit[i] += (times * self.sum[at]).sum() / (PADDING + (times * self.count[at]).sum())
        for w in new:
            if len(w) > CACHED_BYTES:
                del self.known[w]
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def train(docs: list[str], label: np.ndarray, seed: int = 0) -> Model:
    """A model whose scores are probabilities: three quarters of the sample
    train table and softmax, the rest sets the softmax's scale and bias. The
    order of the sample and the seed fix the result."""
    if len(docs) == 0 or label.min() == label.max():
        return Model(np.zeros(BUCKETS), 0.0, empty=True)
    kept = np.arange(len(docs)) % 4 == 0
    if min(label[kept].sum(), (1 - label[kept]).sum(), label[~kept].sum(), (1 - label[~kept]).sum()) < 10:
        return _fit(docs, label, seed)
    model = _fit([t for t, k in zip(docs, kept) if not k], label[~kept], seed)
    held, y = [t for t, k in zip(docs, kept) if k], label[kept]
    n = max(1, int(EMPTY_WEIGHT * len(held)))
    p = np.clip(model.score([*held, *[""] * n]), 1e-12, 1 - 1e-12)
    scale, bias = _calibrate(np.log(p / (1 - p)), np.concatenate([y, np.zeros(n)]))
    return Model(model.part * scale, model.bias * scale + bias)


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic regression on one margin (Newton's steps
    on smoothed targets)."""
    n = label.sum()
    target = np.where(label == 1, (n + 1) / (n + 2), 1 / (len(label) - n + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([0.0, np.log((n + 1) / (len(label) - n + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (p - target))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _fit(docs: list[str], label: np.ndarray, seed: int) -> Model:
    """Full-batch Adam on the weighted cross-entropy."""
    number: dict[bytes, int] = {}
    ref, times, size = [], [], []
    for text in docs:
        bag: dict[int, int] = {}
        for w in words(text):
            k = number.setdefault(w, len(number))
            bag[k] = bag.get(k, 0) + 1
        ref.append(np.fromiter(bag.keys(), np.int64, len(bag)))
        times.append(np.log2(1.0 + np.fromiter(bag.values(), np.float32, len(bag))))
        size.append(len(bag))
    ref, times, size = np.concatenate(ref).astype(np.int32), np.concatenate(times).astype(np.float32), np.array(size)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), size)
    bucket, count = grams(list(number))
    start = np.cumsum(count) - count
    total = PADDING + np.bincount(doc, times * count[ref], len(docs))
    share = (times / total[doc]).astype(np.float32)

    # N-grams that stand in few words of few texts say nothing about others:
    # they keep a zero row.
    held = np.bincount(ref, minlength=len(number))
    common = np.bincount(bucket, np.repeat(held.astype(np.float32), count), BUCKETS) >= max(2.0, LEAST_SHARE * len(docs))
    used = common[bucket]
    kept = np.add.reduceat(used, start) if len(start) else count
    bucket, start, count = bucket[used], np.cumsum(kept) - kept, kept

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (DIM, BUCKETS)).astype(np.float32) * common
    soft = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(label == 1, TOXIC_WEIGHT, 1.0)
    weight = weight / weight.sum()
    params = [table, soft, bias]
    mean = [np.zeros_like(x) for x in params]
    var = [0.0, *(np.zeros_like(x) for x in params[1:])]
    for step in range(1, STEPS + 1):
        hidden = np.empty((DIM, len(docs)))
        for k in range(DIM):
            word = _sums(table[k][bucket], start, count)
            hidden[k] = np.bincount(doc, word[ref] * share, len(docs))
        logit = soft @ hidden + bias[:, None]
        toxic = 1.0 / (1.0 + np.exp(np.clip(logit[0] - logit[1], -50, 50)))
        off = weight * (toxic - label)              # of the toxic logit; the other's is its negative
        both = np.stack([-off, off])
        word = np.bincount(ref, off[doc] * share, len(number))
        gram = np.bincount(bucket, np.repeat(word.astype(np.float32), count), BUCKETS)
        none = EMPTY_WEIGHT / (1.0 + np.exp(np.clip(bias[0] - bias[1], -50, 50)))
        slope = [np.outer(soft[1] - soft[0], gram), both @ hidden.T, both.sum(axis=1) + np.array([-none, none])]
        for i, (x, g, m) in enumerate(zip(params, slope, mean)):
            m += 0.1 * (g - m)
            # The table's rows share one scale, that of the steepest: an
            # n-gram moves as far as its own evidence goes.
            var[i] += 0.01 * (((g * g).max() if x is table else g * g) - var[i])
            rate = TABLE_RATE if x is table else RATE
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(var[i] / (1 - 0.99 ** step)) + 1e-12)
    return Model((soft[1] - soft[0]) @ table, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
           rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts for training, in the order of their
    ids' hashes, so the same at any partitioning. Only rows that are not held
    out. A text that no longer fits into ``SAMPLE_BYTES`` is passed over;
    raises where that leaves a class without any text."""
    lab = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")) \
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    lab = lab.groupBy("id").agg(F.max("y").alias("y"))
    picked = lab.orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()
    if picked.empty:
        return [], np.zeros(0)
    picked["turn"] = range(len(picked))
    own = docs.sparkSession.createDataFrame(picked)
    # An id that stands on many rows counts once, with its smallest text.
    bag = stored(texts(docs, id_col, text_col).join(F.broadcast(own), "id")
                 .groupBy("turn", "y").agg(F.min("text").alias("text")), "toxicity-sample")
    size = bag.select("turn", "y", F.octet_length("text").alias("n")).toPandas().sort_values("turn")
    kept, room = [], SAMPLE_BYTES
    for turn, n in zip(size["turn"].tolist(), size["n"].tolist()):
        if n <= room:
            kept.append(turn)
            room -= n
    got = bag.filter(F.col("turn").isin(kept)).toPandas().sort_values("turn")
    if size["y"].nunique() == 2 and got["y"].nunique() < 2:
        raise ValueError(f"no labelled text of one class fits into {SAMPLE_BYTES} bytes")
    return got["text"].tolist(), got["y"].to_numpy(np.float64)


def held_out(id_):
    """Rows whose crc32 of the id, as text, leaves 2 modulo 4 are never
    learnt from. A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2


def score(rows: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``rows`` (with a ``text`` column, null counts as empty) with a last
    column ``score``; 1 is surely toxic. The text goes to Python once, and
    comes back only if it is kept."""
    part, bias, empty = model.part, model.bias, model.empty
    names = [c for c in rows.columns if keep_text or c != "text"]

    def run(batches):
        own = Model(part, bias, empty)
        for batch in batches:
            for b in slices(batch):
                out = own.score([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out)], [*names, "score"])
            release()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kept}, score double")
