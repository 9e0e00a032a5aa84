"""Operator 13: spelling variants, grouped by words one edit apart.

Letters are hashed to a few symbols, which shortens the full neighbourhood of
a word (itself and every single insertion, deletion and replacement) from
hundreds of strings to about 18 for each letter. Each word's reduced
neighbourhood is joined with the reduced vocabulary; one edit between two
words is at most one edit between their reduced forms, so no pair is lost.
The pairs that meet are verified on the words themselves, inside the join.

A neighbourhood is made as 64-bit numbers, not strings: with a reduced word's
number a polynomial in its symbols, every neighbour's follows from sums over
the symbols before and after the edit, so a word of a million letters costs
millions of numbers and no more. Two reduced words of one number only meet in
vain. A bitmap of fixed size (a Bloom filter of the reduced vocabulary) drops
neighbours that no word has before they are shuffled; it loses none, and a
vocabulary too large for it only makes it drop fewer.

Reduced words that very many words share are dealt over parts, so that no task
compares a large bucket with itself.

A word's form is its near word of largest count, where that is at least twice
its own; counts at least double along a chain of forms, so chains are short
and pointer jumping ends after a logarithm of that.

Defined results: a null text has no words; a null id counts as an empty string
in the rule that spoils runs; repeated rows count each time; ties go to the
smallest word in code-point order; no words, no rows. Other columns are never
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS = r"A-Za-zÀ-ÿ"
#: Words are this long and this frequent at least.
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run in this many loses a letter (see ``words``).
SPOILED = 97
#: A form is this many times as frequent as its word.
FORM_TIMES = 2

#: Symbols of the reduced alphabet: fewer make neighbourhoods small and
#: buckets large.
SYMBOLS = 8
SIEVE_BITS = 1 << 25
#: Words whose neighbourhoods one task makes, slots of a block in numpy, and
#: words of a reduced form that one part compares.
TASK_WORDS = 20_000
BLOCK = 1 << 16
PART_WORDS = 500
#: Letters beyond which words are compared without a table of distances.
LONG = 64

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(docs: DataFrame, id_col: str, text_col: str, spoiled: int = SPOILED) -> DataFrame:
    """``word`` of every run of letters, A-Z lower-cased. Where ``spoiled``
    divides the checksum ``h`` of ``<id>:<run>``, the run loses its letter
    number ``h % length``. Only words of ``LEAST_LETTERS`` letters."""
    low = F.translate(docs[text_col], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % spoiled == 0, cut).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS)


class Reduced:
    """A batch of words in the reduced alphabet, laid out in slots: one before
    each letter and one at the end of each word."""

    def __init__(self, batch: list[str], symbols: int = SYMBOLS):
        self.symbols = _mix(np.arange(1, symbols + 1, dtype=np.uint64)) | _U(1)
        size = np.fromiter(map(len, batch), np.int64, len(batch))
        points = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        symbol = ((points * _U(2654435761) >> _U(16)) % _U(symbols)).astype(np.int8)
        self.first = np.cumsum(size + 1) - (size + 1)          # each word's first slot
        self.word = np.repeat(np.arange(len(batch)), size + 1)
        self.place = np.arange(len(self.word)) - self.first[self.word]
        self.symbol = np.full(len(self.word), -1, np.int8)     # -1: a word's last slot
        self.symbol[self.place < size[self.word]] = symbol
        power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
        np.cumprod(np.full(len(power) - 1, _BASE), out=power[1:])
        self.power = power[self.place]
        inner = self.symbol >= 0
        term = np.where(inner, self.symbols[self.symbol], _U(0)) * self.power
        total = np.cumsum(term)
        self.term = term
        before = total - term                                  # of all slots before this one
        self.before = before - before[self.first][self.word] if len(batch) else before
        last = self.first + size
        self.whole = self.before[last] if len(batch) else total

    def keys(self) -> np.ndarray:
        return _mix(self.whole).view(np.int64)

    def neighbours(self):
        """``(word number, key)`` arrays, block by block: each word itself and
        its distinct neighbours."""
        yield np.arange(len(self.whole)), _mix(self.whole)
        for lo in range(0, len(self.word), BLOCK):
            s = slice(lo, lo + BLOCK)
            word, symbol, power, before, term = self.word[s], self.symbol[s], self.power[s], self.before[s], self.term[s]
            whole = self.whole[word]
            inner = symbol >= 0
            # Next to an equal symbol, an edit gives what the one before gave.
            prior = np.where(self.place[s] > 0, self.symbol[np.arange(lo, lo + len(word)) - 1], -2)
            rows, out = [], []

            def take(ok, key):
                rows.append(word[ok])
                out.append(key[ok])

            take(inner & (symbol != prior), before + (whole - before - term) * _BACK)
            for t, value in enumerate(self.symbols):
                here = value * power
                take(inner & (symbol != t), whole - term + here)
                take(prior != t, before + here + (whole - before) * _BASE)
            yield np.concatenate(rows), _mix(np.concatenate(out))


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key & _U(SIEVE_BITS - 1)).astype(np.int64), ((key >> _U(25)) & _U(SIEVE_BITS - 1)).astype(np.int64)


def _sieve(vocabulary: DataFrame) -> np.ndarray:
    """Both bits of every key, as a bitmap of fixed size."""
    bits = F.explode(F.array(F.col("key").bitwiseAND(SIEVE_BITS - 1), F.shiftrightunsigned("key", 25).bitwiseAND(SIEVE_BITS - 1)))
    at = vocabulary.select(bits.alias("at")).select((F.col("at") / 32).cast("int").alias("slot"), (F.col("at") % 32).cast("int").alias("bit"))
    got = at.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 32, np.uint32)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def _batches(batch: pa.RecordBatch):
    """Slices of bounded letters (a longer word stands alone)."""
    size = np.cumsum([len(w) + 1 for w in batch.column("word").to_pylist()])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def keyed(counts: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, key``: with the number of the reduced word."""
    def run(batches):
        for batch in batches:
            for b in _batches(batch):
                yield b.append_column("key", pa.array(Reduced(b.column("word").to_pylist(), symbols).keys()))

    return counts.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _asking(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``word, key``: each word with the keys of its reduced neighbourhood
    that the sieve lets pass."""
    sieve = _sieve(vocabulary)

    def run(batches):
        for batch in batches:
            for b in _batches(batch):
                for row, key in Reduced(b.column("word").to_pylist(), symbols).neighbours():
                    ok = np.ones(len(key), bool)
                    for at in _bits(key):
                        ok &= ((sieve[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
                    yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(row[ok])), pa.array(key[ok].view(np.int64))], ["word", "key"])

    tasks = -(-vocabulary.count() // TASK_WORDS) or 1
    return vocabulary.select("word").repartition(tasks, "word").mapInArrow(run, "word string, key long")


def one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced letter makes the difference.
    Spark's edit distance, also with a bound, takes the square of the length;
    long words are compared around their first difference, which halving
    steps find."""
    x, y = F.length(a), F.length(b)
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(x, y))).cast("int"), F.lit(0)), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    same = F.aggregate(steps, F.lit(0), lambda p, n: p + F.when(
        (p + n <= F.least(x, y)) & (F.substring(a, p + 1, n) == F.substring(b, p + 1, n)), n).otherwise(0))

    def after(word, other):
        return F.substring(word, same + F.when(F.length(word) < F.length(other), 1).otherwise(2), F.length(word))

    apart = (a != b) & (F.abs(x - y) <= 1) & (after(a, b) == after(b, a))
    return F.when(F.greatest(x, y) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(apart)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, near, near_n``: all pairs (both ways) of words that differ by
    one edit, from ``word, n, key``."""
    large = (vocabulary.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > PART_WORDS)
             .select("key", F.ceil(F.col("size") / PART_WORDS).cast("int").alias("parts")))
    large = stored(large, "spelling-large")
    parts = F.coalesce("parts", F.lit(1))
    dealt = vocabulary.join(large, "key", "left").select(
        "key", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    asking = _asking(vocabulary, symbols).join(large, "key", "left").select(
        "word", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = asking.join(dealt, ["key", "part"]).filter(one_edit(F.col("word"), F.col("near")))
    return both.select("word", "near", "near_n")


def forms(vocabulary: DataFrame, near: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    is_form = most >= FORM_TIMES * F.col("n")
    return vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, most).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the end of the chain of
    forms. Each step jumps to where the one jumped to points."""
    at = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, id_col: str, text_col: str, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of whole texts."""
    counts = words(docs, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)
    vocabulary = stored(keyed(counts, symbols), "spelling-words")
    formed = stored(forms(vocabulary, near_words(vocabulary, symbols)), "spelling-forms")
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
