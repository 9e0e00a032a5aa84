"""Operator 2: secret scans with corpus-wide ownership frequency.

Native: DataFrame functions only. A scan finds candidates in every text
(assignments, access keys, long hex strings) with their places. The hashes of
their values are then counted over the whole corpus by distinct repositories
and owners: a value in many repositories, or of several owners, is a copied
example, also where one owner copied it; one in few repositories of one or two
owners that looks random is likely live. Both verdicts are added as further
spans; a value in few places that does not look random gets none.

Counting is by combining sums only (repository, then owner, then value), so a
value that a third of all rows hold moves a row per task. The verdicts return
to the documents by a shuffle join of two stored tables, which Spark splits
where one value has most rows.

Defined results: a null text is empty and has no candidate; a null owner or
repository is one of its own; repeated rows of a repository count once, and
each gets its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Kinds of spans in their order: the scan's, then the verdicts'.
KINDS = ("assign", "access", "hex", "live", "example")

#: The scans as Java patterns with the group of the value. Runs of one class
#: of characters are taken whole, so their least length may stand in the
#: pattern; an assignment's value is measured after the match.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1),
    "hex": (r"([0-9a-f]{24,})", 1),
}
LEAST_ASSIGNED = 6
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Owners, and repositories whosever, from which on a value counts as a copied
#: example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 10
#: Different characters that a live-looking value has at least.
LIVE_CHARACTERS = 8
_PLACEHOLDER = "(?i)example|changeme|dummy|placeholder|your|xxxx|12345"


def running_sum(x: Column) -> Column:
    """Prefix sums of an array of longs, in a logarithmic number of steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int"))

    def step(p, e):
        back = F.pow(F.lit(2.0), e).cast("int")
        return F.transform(p, lambda v, i: v + F.when(i >= back, F.get(p, i - back)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(steps, x, step)


def _long_length(c: Column) -> Column:
    return F.length(c).cast("long")


def _matches(text: Column, kind: str) -> Column:
    """``array<struct<kind,first,last,value>>`` of a kind's matches: the text
    between them gives their places."""
    pattern, group = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: _long_length(g) + _long_length(F.coalesce(m, F.lit(""))))
    ends = running_sum(steps)
    found = F.transform(F.arrays_zip(ends.alias("e"), whole.alias("m"), value.alias("v")), lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), (x["e"] - _long_length(x["m"])).alias("first"),
        x["e"].alias("last"), x["v"].alias("value"), x["m"].alias("whole")))
    least = LEAST_ASSIGNED if kind == "assign" else 1
    # The part after the last match has no match of its own.
    return F.filter(found, lambda x: x["whole"].isNotNull() & (F.length(x["value"]) >= least))


_CANDIDATE = "array<struct<kind:int,first:bigint,last:bigint,value:string>>"


def candidates(text: Column) -> Column:
    """All base candidates of a text, kind after kind. A cheap test spares
    most texts the patterns."""
    low = F.lower(text)
    has = {"assign": F.lit(False), "access": text.contains("AKIA"), "hex": text.rlike(PATTERNS["hex"][0])}
    for w in _WORDS:
        has["assign"] = has["assign"] | low.contains(w)
    none = F.expr(f"cast(array() as {_CANDIDATE})")
    slim = lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "first", "last", "value")))
    return F.concat(*(F.when(has[k], F.transform(_matches(text, k), slim)).otherwise(none) for k in PATTERNS))


def looks_live(value: Column) -> Column:
    """Digits and letters, many different characters, no placeholder's word."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(_PLACEHOLDER)
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` of every candidate value in ``found``
    (``owner, repo, cands``); a repository is its owner's."""
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("cands", lambda c: c["hash"]))).alias("hash"))
    return (each.distinct()
            .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners")))


def scan(docs: DataFrame, text_col: str, repo_col: str, owner_col: str, keep: list[str]) -> DataFrame:
    """``row`` (a number of its own for each row of ``docs``), the columns of
    ``keep`` as ``keep.<name>``, ``base`` and ``spans``: arrays of
    ``struct<first long, kind int, last long>``, ``kind`` a place in
    ``KINDS``; ``spans`` also has the verdicts. Sorted by ``first``, then
    ``kind``."""
    base = docs.select(
        F.struct(*(docs[c].alias(c) for c in keep)).alias("keep"),
        docs[owner_col].cast("string").alias("owner"), docs[repo_col].cast("string").alias("repo"),
        candidates(F.coalesce(docs[text_col], F.lit(""))).alias("cands"))
    base = base.withColumn("cands", F.transform("cands", lambda c: F.struct(
        c["kind"].alias("kind"), c["first"].alias("first"), c["last"].alias("last"),
        F.unhex(F.sha2(c["value"], 256)).alias("hash"), looks_live(c["value"]).alias("live"))))
    found = stored(base.withColumn("row", F.monotonically_increasing_id()), "secrets-found")

    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    counts = stored(ownership(found).select("hash", copied.alias("copied")), "secrets-owned")
    each = found.select("row", F.explode("cands").alias("c")).select("row", F.col("c.hash").alias("hash"), "c")
    live, example = KINDS.index("live"), KINDS.index("example")
    verdict = F.when(F.col("copied"), F.lit(example)).when(F.col("c.live"), F.lit(live))
    added = (each.join(counts, "hash").withColumn("verdict", verdict).filter(F.col("verdict").isNotNull())
             .groupBy("row").agg(F.collect_set(F.struct(F.col("c.first").alias("first"), F.col("verdict").alias("kind"),
                                                        F.col("c.last").alias("last"))).alias("added")))
    placed = F.transform("cands", lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last")))
    none = F.expr("cast(array() as array<struct<first:bigint,kind:int,last:bigint>>)")
    out = found.join(added, "row", "left")
    return out.select("row", "keep", F.array_sort(placed).alias("base"),
                      F.array_sort(F.concat(placed, F.coalesce("added", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"], s["last"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every range of ``spans`` (sorted) replaced by ``mark``;
    overlapping ranges count as one. The text is cut once at every border."""
    clear = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    merged = F.aggregate(spans, clear, lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))))
        .otherwise(F.concat(done, F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))))
    size = _long_length(text)
    pieces = F.transform(merged, lambda s, i: F.concat(
        F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(merged, i - 1)["last"] + 1).cast("int"),
                    (s["first"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(merged, i - 1)["last"])).cast("int")),
        F.lit(mark)))
    tail = F.substring(text, (F.element_at(merged, -1)["last"] + 1).cast("int"), size.cast("int"))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
