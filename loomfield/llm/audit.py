"""How filters interact: what each one removes, in every order in which they can be applied.

A document is reduced to the set of filters that it fails. In the lattice of filter subsets, an edge
goes from the subset that is already applied to the one with the next filter: n * 2**(n - 1) of them, 80 for
five. Documents contribute to every edge: they are counted by part and set of failed
filters first, so at most 2**n rows a part do so, and the sums are those of the documents. Each order of the filters is
a path of n edges; its steps (600 for five) are joined to the edges' sums on (already applied, next).
What a step keeps or removes doesn't depend on the order of the filters before it, so nothing is counted twice over.

Filters A to D look at one text. E compares texts by their SHA-256 digest over the whole table: for each digest the least
key is found by partial aggregation, and rows meet it by (digest, key), so that a text which a third of all rows share
gathers in no task. Labels are reduced to a row a key; rows without a key, which have no label, don't take part in that join.

Null text: as empty, and so equal to empty ones. Empty texts have no words and fail A only (and E). Null key: no
key is smaller than it and it is smaller than none, so such a row doesn't fail E; it has no labels. Rows of equal key and text aren't smaller than one another, so each
counts, as the first or not as their key is the least. Several label rows of one key: any that says so decides.
Null part: the empty string, together with parts that are empty. A very long text is one row's work, in
proportion to its length. An empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import WORD, Workspace

#: More filters have too many orders for a table of them.
MOST_FILTERS = 8


def failures(text: Column) -> dict[str, Column]:
    """Filters of one text, each true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # both sizes come of one list of words
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "A": n["all"] < 200,
        "B": n["distinct"] * 100 < n["all"] * 50,
        "C": F.length(F.regexp_replace(text, r"[^A-Z]+", "")) * 100 > F.length(text) * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed_sets(df: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]], copies: str, text: str, key: str, part: str) -> tuple[DataFrame, list[str]]:
    """(part, failed, n, good, toxic): documents by part and set of failed filters, and the filters' names. Bit i of `failed` is the i-th name's."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = filters(body)
    names = sorted({*own, copies})
    if len(names) > MOST_FILTERS or copies in own:
        raise ValueError(f"at most {MOST_FILTERS} filters of different names")
    bit = {n: 1 << i for i, n in enumerate(names)}
    failed = sum((F.when(c, bit[n]).otherwise(0) for n, c in own.items()), F.lit(0))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), failed.alias("failed"))
    # equal rows are one from here on, so that none of these tables has a frequent (digest, key); texts are read once
    alike = Workspace(df.sparkSession, "audit").save(rows.groupBy("digest", "key", "part", "failed").agg(F.count("*").alias("n")), "alike")
    least = alike.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    keyed = alike.where("key IS NOT NULL").join(least, ["digest", "key"], "left").withColumn("failed", F.when(F.col("first"), F.col("failed")).otherwise(F.col("failed") + bit[copies]))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.select(F.col(key).alias("key"), "quality", "toxic").where("key IS NOT NULL").groupBy("key").agg(is_one("quality"), is_one("toxic"))
    keyed = keyed.join(known, "key", "left").select("part", "failed", "n", "quality", "toxic")
    others = alike.where("key IS NULL").select("part", "failed", "n", F.lit(None).cast("boolean").alias("quality"), F.lit(None).cast("boolean").alias("toxic"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return keyed.unionByName(others).groupBy("part", "failed").agg(F.sum("n").alias("n"), of("quality"), of("toxic")), names


def edges(sets: DataFrame, filters: int) -> DataFrame:
    """(part, applied, next, and the sums of each edge): `applied` is the subset's bits, `next` the number of the filter that follows."""
    every = [(applied, f) for f in range(filters) for applied in range(1 << filters) if not applied >> f & 1]
    each = sets.withColumn("e", F.explode(F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next")) for a, f in every)))).select("*", "e.applied", "e.next")
    alone = F.call_function("shiftleft", F.lit(1), F.col("next"))
    here = F.col("failed").bitwiseAND(alone) != 0
    before = F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda c, value="n": F.sum(F.when(c, F.col(value)).otherwise(0)).alias
    return each.groupBy("part", "applied", "next").agg(
        total(~here & ~before)("kept"), total(here & ~before)("removed"), total(here & before)("redundant"), total(F.col("failed") == alone)("unique_fails"),
        total(here & ~before, "quality")("good_lost"), total(here & ~before, "toxic")("toxic_lost"),
    )


def audit(df: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]] = failures, copies: str = "E", text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Per part, order of all filters and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` gives one-letter names and conditions of a text that fails; `copies` names the filter for texts that a smaller key has.
    `labels` has key, quality and toxic.
    """
    sets, names = failed_sets(df, labels, filters, copies, text, key, part)
    n = len(names)
    sums = edges(sets, n)
    # the orders in which an edge is passed: those of the filters before it times those of the filters after
    passes = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count(F.col("applied")) + 1)
    worth = sums.groupBy("part", "next").agg(F.sum(F.col("removed") * passes).alias("shapley"))
    steps = [("".join(p), k + 1, sum(1 << names.index(f) for f in p[:k]), names.index(p[k])) for p in permutations(names) for k in range(n)]
    paths = df.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    # n * n! rows of constants, 600 for five filters; `worth` has n rows a part
    found = sums.join(worth, ["part", "next"]).join(F.broadcast(paths), ["applied", "next"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
