"""Operator 11: how filters act on each other, in every order of applying them.

A document's *cell* is the string of the letters of all filters it fails
(``"AC"``). Each text is read once for the letters that hang on it alone; the
letter for copies comes from the smallest id of each text. What an order of
filters does to a document follows from its cell alone, so the corpus shrinks
to counts per part and cell by combining sums, at most 2^filters cells a part.

The audit is a fold of higher-order functions over those counts: each cell
walks through the array of all orders (a literal, sent with the plan), where
an ``aggregate`` over an order's letters carries whether the document is still
there. That gives one struct of counts for each order and step, weighted by
the cell's documents; the cells' structs are merged by elementwise sums.

Copies: the smallest id of a text's digest is found by a combining minimum;
rows meet it by text *and* id, so a text that a third of all rows hold is
spread by their ids. The other sides of both joins hold a key once, so a row
that is repeated that often makes a large partition, which adaptive execution
splits, and no larger result.

Defined results: a null text is empty; a null part is the empty string; a row
without an id is no copy, makes none and has no label; ids may repeat (rows of
one id with one text are not copies of each other); of several labels of an id
the highest counts; an empty table has no parts and gives no rows. Other
columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANK = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3

#: The letter of the filter for copies, which no text shows by itself.
COPY = "E"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that hang on the text alone, by their letters."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_UPPER_PERCENT,
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str,
             filters: Callable[[Column, Column], dict[str, Column]] = text_filters) -> DataFrame:
    """``id, part, digest, cell`` of every row: the letters that its own text
    fails, in the order of ``filters``."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    letters = [F.when(failed, letter).otherwise("") for letter, failed in filters(F.col("text"), F.col("words")).items()]
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.concat(*letters).alias("cell"))


def with_copies(failed: DataFrame, letter: str = COPY) -> DataFrame:
    """``id, part, cell``: with the letter of rows whose text also stands
    under a smaller id."""
    named = failed.filter("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    flagged = named.join(first, ["digest", "id"], "left")
    cell = F.concat("cell", F.when(F.col("is_first"), "").otherwise(letter))
    return flagged.select("id", "part", cell.alias("cell")).unionByName(failed.filter("id is null").select("id", "part", "cell"))


def cells(rows: DataFrame, labels: DataFrame, label_id: str, good: str, toxic: str) -> DataFrame:
    """``part, cell, n, good, toxic``: documents, and how many of them are
    labelled good or toxic."""
    marks = (labels.select(labels[label_id].alias("id"), (labels[good] == 1).alias("good"), (labels[toxic] == 1).alias("toxic"))
             .filter("id is not null and (good or toxic)")
             .groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    # Rows without an id would all meet in one task of the join.
    nameless = rows.filter("id is null").withColumns({m: F.lit(None).cast("boolean") for m in ("good", "toxic")})
    marked = rows.filter("id is not null").join(marks, "id", "left").unionByName(nameless)

    def having(mark):
        return F.count(F.when(F.col(mark), 1)).alias(mark)

    return marked.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), having("good"), having("toxic"))


def _walk(cell: Column, orders: Column) -> Column:
    """One struct of counts for each order and step, weighted by the cell."""
    def weigh(flag, weight):
        return F.when(flag, cell[weight]).otherwise(F.lit(0).cast("long"))

    def step(state, letter):
        there, fails = state["there"], F.contains(cell["cell"], letter)
        here = there & fails
        return F.struct((there & ~fails).alias("there"), F.concat(state["steps"], F.array(F.struct(
            weigh(there & ~fails, "n").alias("kept"), weigh(here, "n").alias("removed"),
            weigh(~there & fails, "n").alias("redundant"), weigh(cell["cell"] == letter, "n").alias("unique_fails"),
            weigh(here, "good").alias("good_lost"), weigh(here, "toxic").alias("toxic_lost")))).alias("steps"))

    none = F.expr(f"cast(array() as array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>)")
    start = F.struct(F.lit(True).alias("there"), none.alias("steps"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(F.split(o, ""), start, step)["steps"]))


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step``, the ``COUNTS`` and ``shapley`` from the
    cells' counts (``part, cell, n, good, toxic``): a row for each part, order
    of ``letters`` and step."""
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    steps = len(letters)
    # A part has at most 2^filters cells, however many documents it has.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))

    def summed(a, b):
        return F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))

    empty = F.transform(F.sequence(F.lit(1), F.size(orders) * steps), lambda i: F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)))
    merged = F.aggregate("cells", empty, lambda done, cell: F.zip_with(done, _walk(cell, orders), summed))
    placed = F.transform("merged", lambda s, i: F.struct(
        F.get(orders, F.floor(i / steps).cast("int")).alias("filter_order"), (i % steps + 1).alias("step"), *(s[c].alias(c) for c in COUNTS)))

    def letter(s):
        return F.substring(s["filter_order"], s["step"], F.lit(1))

    # What a filter removes, over all orders.
    share = F.transform(F.split(F.lit(letters), ""), lambda x: F.aggregate(
        "placed", F.lit(0).cast("long"), lambda n, s: n + F.when(letter(s) == x, s["removed"]).otherwise(F.lit(0).cast("long"))))
    folded = parts.select("part", merged.alias("merged")).select("part", placed.alias("placed")).withColumn("share", share)
    rows = folded.select("part", "share", F.explode("placed").alias("s"))
    own = F.get("share", F.position(letter(F.col("s")), F.lit(letters)) - 1)
    return rows.select("part", "s.filter_order", "s.step", *(f"s.{c}" for c in COUNTS), own.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str,
                 good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The audit of ``text_filters`` and copies, over whole texts."""
    failed = stored(failures(docs, id_col, text_col, part_col), "audit-failures")
    counted = stored(cells(with_copies(failed), labels, id_col, good, toxic), "audit-cells")
    return audit(counted, "ABCD" + COPY)
