"""Operator 3: near-duplicate classes by SuperMinHash.

*Sets and signatures.* A text's set holds the hashes of its distinct word
shingles. In a SuperMinHash every element visits all slots in a random order
of its own; its rank in slot s is its visit number plus a random fraction, and
the slot keeps the lowest rank. Ranks of one element are thus correlated (each
whole part is used once), which lowers the variance against independent
minima. All elements of a batch make their j-th visit together, and a text
stops once all its slots are filled: later visits rank higher.

*Banding.* Texts with equal sets are one node. Nodes that agree on all rows of
a band meet in a bucket. With 42 bands of 6 rows a pair of similarity 0.8
meets nowhere with a probability of 3e-6 (``miss``), less for closer ones.

*Verification and union-find.* Links are confirmed on the full sets, in
rounds, and a pair is looked at only while its nodes are in different classes:

1. each node against the lowest node of its buckets that it meets most often;
2. neighbours of different classes in small random parts of a bucket;
3. each node against every class that it still meets and is not part of (the
   largest class of a bucket asks nobody there). Two single nodes whose
   sketches agree far too little for a link are passed over. A class of few members gives
   pairs; a large one is split into blocks of bounded bytes, and a task finds
   a node's overlaps with a whole block through an inverted index of it, so
   the pairs themselves are never rows.

After each round the confirmed links merge classes by the lowest label of
neighbours and pointer jumping. So a large group of copies takes about one
check a node, a link inside a class is never needed, and no link between
classes is left out. Buckets are never gathered: they are counted by partial
sums, and joins on them read stored tables, which Spark splits where a key has
most rows.

Defined results: a text with fewer words than a shingle has one shingle, all
its words; without words, or null, it is linked with nothing. Rows may repeat;
a row without an id belongs to its class but names none, and is not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, slices, stored, texts

#: Slots of a signature (a power of two), rows of a band, bands.
SLOTS = 256
ROWS = 6
BANDS = SLOTS // ROWS
#: Words of a shingle and least similarity, as a fraction.
SHINGLE = 5
SIMILAR = (80, 100)
#: Random rounds, and rows of a bucket's random part in one.
RANDOM_ROUNDS = 1
PART_ROWS = 500
#: Members up to which a class gives pairs, and bytes of sets in a block.
FEW = 8
BLOCK_BYTES = 8 << 20
#: Signatures and words that a task remembers.
CACHE = 10_000
CACHE_WORDS = 150_000
#: Bytes up to which a word is kept.
CACHED_BYTES = 64

_U = np.uint64
_GOLDEN, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def miss(similarity: float) -> float:
    """Probability that a pair meets in no bucket (independent rows)."""
    return (1 - similarity ** ROWS) ** BANDS


def _times(j: int) -> np.uint64:
    return _U(j * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _visited(key: np.ndarray, j: int) -> np.ndarray:
    """The slot of each element's j-th visit: a bijection of the slots, made
    of odd factors, shifts and keys from the element's own bits."""
    top = _U(SLOTS - 1)
    half = _U(SLOTS.bit_length() // 2)
    x = (_U(j) ^ key) & top
    for shift in (8, 24, 40):
        x = (x * ((key >> _U(shift)) | _U(1))) & top
        x ^= x >> half
        x = (x + (key >> _U(shift + 8))) & top
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each (non-empty) set: visit number in the upper 12
    bits, fraction below."""
    size = np.array([len(s) for s in sets])
    element, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    key = _mix(element ^ _GOLDEN)
    low = np.full((len(sets), SLOTS), _EMPTY)
    flat = low.reshape(-1)
    for j in range(SLOTS):
        rank = (_U(j) << _U(52)) | (_mix(element + _times(j + 1)) >> _U(12))
        np.minimum.at(flat, doc * SLOTS + _visited(key, j).astype(np.int64), rank)
        full = low.max(axis=1) != _EMPTY
        if full.all():
            break
        open_ = ~full[doc]
        element, key, doc = element[open_], key[open_], doc[open_]
    return low


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket keys of each signature, one for each band."""
    rows = signature[:, :BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLDEN, rows.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key ^ rows[:, :, r]) + _GOLDEN
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Eight bits of each slot, to estimate a pair's similarity from."""
    return (_mix(signature) & _U(0xFF)).astype(np.uint8).view(np.int8)


def least_agreement(similar: tuple[int, int]) -> int:
    """Equal sketch slots below which a pair is not looked at: 5.5 standard
    deviations under what the least similarity gives (one in 5e7)."""
    s = similar[0] / similar[1]
    p = s + (1 - s) / 256
    return int(SLOTS * p - 5.5 * (SLOTS * p * (1 - p)) ** 0.5)


class Shingler:
    """Texts to sorted arrays of the hashes of their distinct shingles."""

    def __init__(self, size: int):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.size = size
        self.known: dict[bytes, int] = {}

    def set(self, text: bytes) -> np.ndarray:
        words = text.lower().split()          # bytes: A-Z only, and ASCII white space
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in words:
            if len(w) > CACHED_BYTES:
                known.pop(w, None)
        n = min(self.size, len(h))
        if n == 0:
            return h
        x = np.full(len(h) - n + 1, _U(n))
        for j in range(n):
            x = _mix(x + h[j:len(h) - n + 1 + j] * _M2) + _GOLDEN
        return np.unique(x)


_SIGNED = "id {id}, n long, node binary, bands array<long>, sketch array<tinyint>"


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """``id, n, node, bands, sketch``: set size, 128-bit digest of the set,
    bucket keys and sketch (none without words)."""

    def run(batches):
        import xxhash

        shingler, done = Shingler(size), {}
        for batch in batches:
            for b in slices(batch):
                sets = [shingler.set(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
                node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if len(done) > CACHE:
                    done = {}
                new = {k: s for k, s in zip(node, sets) if k is not None and k not in done}
                if new:
                    low = signatures(list(new.values()))
                    done.update(zip(new, zip(bands(low), sketches(low))))
                both = [done.get(k, (None, None)) for k in node]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()),
                     pa.array([x for x, _ in both], pa.list_(pa.int64())), pa.array([x for _, x in both], pa.list_(pa.int8()))],
                    ["id", "n", "node", "bands", "sketch"])
            release()

    return docs.mapInArrow(run, _SIGNED.format(id=docs.schema["id"].dataType.simpleString()))


#: Bits of the sieve that spares texts without candidates their sets.
SIEVE_BITS = 1 << 23


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids' hashes, of fixed size however many there are."""
    at = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SIEVE_BITS))
    words = ids.select(F.floor(at / 32).cast("int").alias("word"), F.pmod(at, F.lit(32)).cast("int").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 32, np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``v, set binary`` of the wanted nodes (``v, id, node``), from the texts
    of the ids that stand for them. Texts outside the sieve are not looked at;
    the digest of the set decides, so repeated ids cannot mix up."""
    sieve = _sieve(wanted)
    at = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SIEVE_BITS)).cast("int")

    def run(batches):
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            h = batch.column("at").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((sieve[h >> 5] >> (h & 31).astype(np.uint32)) & 1)
            for b in slices(batch.select(["text"]).take(pa.array(rows))):
                some = b.column("text").cast(pa.binary()).to_pylist()
                sets = [s.tobytes() for s in map(shingler.set, some) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                                                  pa.array(sets, pa.binary())], ["node", "set"])
            release()

    found = docs.select(at.alias("at"), "text").mapInArrow(run, "node binary, set binary")
    return found.join(wanted.select("v", "node"), "node").groupBy("v").agg(F.first("set").alias("set")) \
        .withColumn("bytes", F.octet_length("set").cast("long"))


def _linked(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    num, den = similar
    left = pairs.join(sets.select(F.col("v").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("v").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                ok = den * len(small) >= num * len(large)
                if ok:
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                    ok = den * common >= num * (len(x) + len(y) - common)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _overlapping(asking: pa.Table, block: pa.Table, similar: tuple[int, int]) -> pa.Table:
    """One link ``a, b`` for each asking set that is similar enough to a set
    of the block: overlaps with all of them come from one look-up of its
    elements among the block's sorted ones."""
    num, den = similar
    held = [np.frombuffer(s.as_buffer(), np.uint64) for s in block.column("set")]
    size = np.array([len(s) for s in held], np.int64)
    element, owner = np.concatenate([*held, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(held)), size)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    v = block.column("v").to_numpy()
    a, b = [], []
    for x, s in zip(asking.column("v").to_pylist(), asking.column("set")):
        s = np.frombuffer(s.as_buffer(), np.uint64)
        lo, hi = np.searchsorted(element, s, side="left"), np.searchsorted(element, s, side="right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(held))
        near = np.flatnonzero((den * common >= num * (len(s) + size - common)) & (v != x))
        if len(near):
            a.append(x)
            b.append(int(v[near[0]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _class_links(met: DataFrame, label: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links between nodes and the large classes that they meet: ``met`` has
    ``a, root, bytes`` (of the class). Classes and those that ask are split
    by bytes; every part of one meets every part of the other."""
    parts = lambda n: F.greatest(F.ceil(n / BLOCK_BYTES), F.lit(1)).cast("int")
    size = sets.select("v", F.col("bytes").alias("own"))
    asked = stored(met.join(size.withColumnRenamed("v", "a"), "a"), "neardup-asked")
    plan = stored(asked.groupBy("root").agg(parts(F.max("bytes")).alias("blocks"), parts(F.sum("own")).alias("turns")), "neardup-plan")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asking = asked.join(plan, "root").select(F.col("a").alias("v"), "root", of("a", "turns").alias("turn"), each("blocks").alias("block"))
    block = label.join(plan, "root").select("v", "root", of("v", "blocks").alias("block"), each("turns").alias("turn"))
    key = ["root", "block", "turn"]
    own = lambda x: F.col(x).alias(x)  # noqa: E731  columns of its own for each side
    left = stored(asking, "neardup-asking").join(sets.select(own("v"), own("set")), "v").select(*map(own, ["v", "set", *key])).groupBy(*key)
    right = stored(block, "neardup-blocks").join(sets.select(own("v"), own("set")), "v").select(*map(own, ["v", "set", *key])).groupBy(*key)

    def run(asking, block):
        return _overlapping(asking, block, similar)

    return left.cogroup(right).applyInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "neardup-classes") -> DataFrame:
    """``v, root``: each node of the links ``a, b`` with the lowest node that
    it reaches. Every step takes the lowest label among neighbours, then jumps
    to that label's own; steps are stored, and their number grows with the
    logarithm of the longest chain."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    label = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")), name)
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").select(F.col("a").alias("v"), "root")
        low = stored(near.unionByName(label).groupBy("v").agg(F.min("root").alias("root")), name)
        jump = low.join(low.select(F.col("v").alias("root"), F.col("root").alias("next")), "root") \
            .select("v", F.col("next").alias("root"))
        new = stored(jump, name)
        changed = new.select("v", F.col("root").alias("new")).join(label, "v").filter(F.col("new") != F.col("root"))
        if changed.isEmpty():
            return new
        label = new


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after further links between them."""
    if label is None:
        return components(links)
    if links.isEmpty():
        return label
    named = links.select("a", "b")
    for end in ("a", "b"):
        named = named.join(label.select(F.col("v").alias(end), F.col("root").alias(f"{end}_root")), end, "left") \
            .withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    over = components(stored(named.filter("a <> b"), "neardup-between")).select(F.col("v").alias("root"), F.col("root").alias("over"))
    old = label.join(over, "root", "left").select("v", F.coalesce("over", "root").alias("root"))
    new = over.select(F.col("root").alias("v"), F.col("over").alias("root")).join(label.select("v"), "v", "left_anti")
    return stored(old.unionByName(new), "neardup-classes")


def _mixed(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one class, with theirs."""
    if label is None:
        return members.withColumn("root", F.col("v"))
    named = stored(members.join(label, "v", "left").withColumn("root", F.coalesce("root", "v")), "neardup-members")
    keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    return stored(named.join(stored(keys, "neardup-mixed"), "key", "left_semi"), "neardup-mixed-members")


def _pairs(rows: DataFrame, tested: DataFrame) -> DataFrame:
    """Distinct unordered pairs ``a < b`` that were not looked at yet."""
    ordered = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(ordered.join(tested, ["a", "b"], "left_anti"), "neardup-pairs")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE,
                    similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    signed = stored(_signed(rows, shingle).withColumn("row", F.monotonically_increasing_id()), "neardup-signed")
    nodes = stored(signed.filter("n > 0").groupBy("node").agg(
        F.min("row").alias("v"), F.min("id").alias("id")), "neardup-nodes")
    # A node's bands are those of its first row: one row a node goes on.
    first = signed.filter("n > 0").select(F.col("row").alias("v"), "bands").join(nodes.select("v"), "v", "left_semi")
    entries = first.select(F.explode("bands").alias("key"), "v")
    groups = stored(entries.groupBy("key").agg(F.min("v").alias("lowest"), F.count(F.lit(1)).alias("size"))
                    .filter("size > 1"), "neardup-buckets")
    members = stored(entries.join(groups, "key"), "neardup-entries")
    wanted = nodes.join(members.select("v").distinct(), "v", "left_semi")
    sets = stored(_sets(rows, wanted, shingle), "neardup-sets")

    star = members.filter("v <> lowest").groupBy("v", "lowest").agg(F.count(F.lit(1)).alias("n"))
    best = star.groupBy("v").agg(F.max(F.struct("n", (-F.col("lowest")).alias("to"))).alias("m"))
    pairs = stored(best.select((-F.col("m.to")).alias("a"), F.col("v").alias("b")), "neardup-pairs")
    tested = pairs
    links = stored(_linked(pairs, sets, similar), "neardup-links")
    label = components(links)

    members = members.select("key", "v", "size")
    for turn in range(RANDOM_ROUNDS):
        mixed = _mixed(members, label)
        order = F.xxhash64("v", F.lit(turn))
        part = F.pmod(order, F.ceil(F.col("size") / PART_ROWS))
        w = Window.partitionBy("key", "part").orderBy("order", "v")
        near = mixed.withColumn("order", order).withColumn("part", part).select(
            F.col("v").alias("a"), "root", F.lead("v").over(w).alias("b"), F.lead("root").over(w).alias("next"))
        pairs = _pairs(near.filter("root <> next"), tested)
        tested = tested.unionByName(pairs)
        label = _merged(label, stored(_linked(pairs, sets, similar), "neardup-links"))

    mixed = _mixed(members, label)
    each = stored(mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "neardup-met")
    most = stored(each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("most")), "neardup-most")
    sketch = signed.filter("n > 0").select(F.col("row").alias("v"), "sketch")
    few = mixed.join(most, "key").filter("root <> most").select("key", "most", "v", F.col("root").alias("a_root"))
    few = stored(few.join(sketch, "v").withColumnRenamed("v", "a"), "neardup-few")
    # A node that is a class of its own has a sketch to ask first.
    single = each.join(label.select(F.col("v").alias("root")), "root", "left_anti") \
        .join(sketch.select(F.col("v").alias("root"), F.col("sketch").alias("own")), "root")
    several = each.join(label.select(F.col("v").alias("root")), "root", "left_semi") \
        .withColumn("own", F.lit(None).cast("array<tinyint>"))
    asked = stored(single.unionByName(several), "neardup-asked-classes")
    agree = F.aggregate(F.zip_with("sketch", "own", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    meet = few.join(asked, "key").filter(
        (F.col("a_root") != F.col("root")) & ((F.col("root") == F.col("most")) | (F.col("a_root") < F.col("root")))
        & (F.col("own").isNull() | (agree >= least_agreement(similar))))
    met = stored(meet.select("a", "root").distinct(), "neardup-meet")
    classes = stored(label.join(sets.select("v", "bytes"), "v").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "neardup-classes-size")
    met = stored(met.join(classes, "root", "left"), "neardup-meet")
    large = F.coalesce(F.col("n"), F.lit(1)) > FEW
    alone = met.filter("n is null").select("a", F.col("root").alias("b"))
    pairs = _pairs(met.filter(~large & F.col("n").isNotNull()).join(label, "root").select("a", F.col("v").alias("b")).unionByName(alone), tested)
    links = _linked(pairs, sets, similar).unionByName(_class_links(met.filter(large), label, sets, similar))
    label = _merged(label, stored(links, "neardup-links"))

    # Names: the lowest id of a class's nodes, then of each row's node.
    classed = stored(nodes.join(label, "v"), "neardup-classed")
    lowest = stored(classed.groupBy("root").agg(F.min("id").alias("component_id")), "neardup-lowest")
    linked = classed.join(lowest, "root").select("node", "component_id")
    alone = nodes.join(label, "v", "left_anti").select("node", F.col("id").alias("component_id"))
    named = stored(linked.unionByName(alone), "neardup-named")
    with_words = signed.filter("n > 0").select("id", "n", "node").join(named, "node").select("id", "n", "component_id")
    without = signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return with_words.unionByName(without).select(
        "id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
