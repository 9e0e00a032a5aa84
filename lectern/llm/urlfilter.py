"""Operator 12: URL filters by rules and a logistic regression.

Native: DataFrame functions only. A URL is cut into host and path; the longest
rule that fits decides. Where none does, a logistic regression decides on
hashed character n-grams of host and path.

It is trained from a small table of labelled URLs. The rules label URLs
themselves, so ``rule_labels`` takes that table from the pages: of each
verdict the ``LABELLED`` distinct URLs that come first by their digest. That
bound is the only one; every page is judged.

Training is one fold over a single row of at most 2 * ``LABELLED`` URLs: full
gradient steps by ``aggregate``, where each URL's error comes from its n-grams'
weights and each weight's change from the URLs that hold the n-gram. Sums run
in a fixed order, so the same table gives the same model. The model, one
number a bucket, is the only thing the driver sees; judging is a projection
with the weights as a literal.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is judged by the model like any other text without
n-grams; repeated rows are judged alike; without labelled URLs the model is
neutral and allows; an empty table gives no rows. Other columns are kept or
ignored as named by the caller, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Host, path and verdict of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Labelled URLs of each verdict that the model is trained on, at most.
LABELLED = 256
GRAM = 3
BUCKETS = 4093
#: Start values of the hashes of host and path n-grams.
SEEDS = (1, 2)
STEPS = 200
RATE = 4.0
SHRINK = 1e-4
BLOCK_OVER = 0.5

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, _PARTS, 2)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict (else null)."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in longest]
    return (F.coalesce(*(F.when(f, h + p) for f, (h, p, _) in zip(fits, longest))),
            F.coalesce(*(F.when(f, v) for f, (_, _, v) in zip(fits, longest))))


def _hashes(text: Column, seed: int) -> Column:
    def hashed(points):
        def number(i):
            h = F.lit(seed).cast("long")
            for j in range(GRAM):
                h = h * 131 + F.get(points, i + j)
            return (h % BUCKETS).cast("int")

        return F.transform(F.sequence(F.lit(0), F.size(points) - GRAM), number)

    # An array of one binds the code points, which every n-gram reads.
    found = F.get(F.transform(F.array(F.transform(F.split(text, ""), F.ascii)), hashed), 0)
    return F.when(F.length(text) >= GRAM, found).otherwise(F.expr("cast(array() as array<int>)"))


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams, in order; ``^`` and ``$`` mark the
    ends of the host, ``$`` the end of the path."""
    ends = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    return F.array_sort(F.array_distinct(F.concat(*(_hashes(t, s) for t, s in zip(ends, SEEDS)))))


def rule_labels(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most: int = LABELLED) -> DataFrame:
    """``host, path, blocked`` of URLs (``host, path``) that the rules judge:
    of each verdict the first ``most`` distinct ones by their digest."""
    _, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = urls.select("host", "path", verdict.alias("verdict")).filter("verdict is not null").distinct()
    order = [F.md5(F.concat("host", "path").cast("binary")), F.col("host"), F.col("path")]
    first = [judged.filter(F.col("verdict") == v).orderBy(*order).limit(most) for v in ("allow", "block")]
    return first[0].unionByName(first[1]).select("host", "path", (F.col("verdict") == "block").alias("blocked"))


def _margin(weights: Column, bias: Column, found: Column) -> Column:
    """Mean-length sum of the weights of an n-gram set."""
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return bias + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))


def _chance(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def train(labelled: DataFrame) -> list[float]:
    """Weight of each bucket, then the bias, from ``host, path, blocked``."""
    rows = stored(labelled.select("host", "path", F.col("blocked").cast("double").alias("y"), grams(F.col("host"), F.col("path")).alias("found"))
                  .orderBy("host", "path").coalesce(1).withColumn("i", F.monotonically_increasing_id().cast("int")), "urls-labelled")
    spark = labelled.sparkSession
    holders = rows.select("i", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("held"))
    held = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(holders, "bucket", "left").select(
        F.struct("bucket", F.coalesce("held", F.expr("cast(array() as array<int>)")).alias("held")).alias("b"))
    table = rows.select(F.struct("i", "y", "found").alias("r"))
    both = table.unionByName(held, allowMissingColumns=True).agg(
        F.array_sort(F.collect_list("r")).alias("rows"), F.array_sort(F.collect_list("b")).alias("held"))
    both = stored(both.select("rows", F.transform("held", lambda b: b["held"]).alias("held")), "urls-training")

    count = F.greatest(F.size("rows"), F.lit(1)).cast("double")

    def step(model, _):
        def moved(errors):
            def weight(w, b):
                slope = F.aggregate(F.get("held", b), F.lit(0.0), lambda g, i: g + F.get(errors, i)["scaled"])
                return w - RATE * (slope / count + SHRINK * w)

            slope = F.aggregate(errors, F.lit(0.0), lambda g, e: g + e["plain"])
            return F.struct(F.transform(model["w"], weight).alias("w"), (model["b"] - RATE * slope / count).alias("b"))

        def error(r):
            e = _chance(_margin(model["w"], model["b"], r["found"])) - r["y"]
            return F.struct(e.alias("plain"), (e / F.sqrt(F.greatest(F.size(r["found"]), F.lit(1)).cast("double"))).alias("scaled"))

        # An array of one binds the errors, which every weight reads.
        return F.get(F.transform(F.array(F.transform("rows", error)), moved), 0)

    start = F.struct(F.array_repeat(F.lit(0.0), BUCKETS).alias("w"), F.lit(0.0).alias("b"))
    model = both.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("m")).select("m.w", "m.b").first()
    return [*model["w"], model["b"]]


def judge(pages: DataFrame, url_col: str, keep: list[str], model: list[float],
          rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The columns of ``keep`` as ``keep.<name>``, ``host, path, rule, score``
    (of the model) and ``verdict`` of every row."""
    weights = F.split(F.lit(",".join(map(repr, model[:-1]))), ",").cast("array<double>")
    host, path = parts(pages[url_col])
    cut = pages.select(F.struct(*(pages[c].alias(c) for c in keep)).alias("keep"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    score = _chance(_margin(weights, F.lit(model[-1]), grams(F.col("host"), F.col("path"))))
    scored = cut.select("keep", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), score.alias("score"))
    own = F.when(F.col("score") > BLOCK_OVER, "block").otherwise("allow")
    return scored.select("keep", "host", "path", "rule", "score", F.coalesce("by_rule", own).alias("verdict"))


def filter_urls(pages: DataFrame, url_col: str, keep: list[str], rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``judge`` by ``rules`` and a model trained on what they say."""
    host, path = parts(pages[url_col])
    return judge(pages, url_col, keep, train(rule_labels(pages.select(host.alias("host"), path.alias("path")), rules)), rules)
