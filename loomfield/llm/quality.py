"""Quality rules as a short-circuit cascade.

A rule names a condition for rejecting. On a bounded, hashed sample, kept as a table, each rule is
evaluated on every row between two readings of the JVM's clock: the median is its cost a row, and
the share of rows that it rejects its selectivity. Rules are ordered by rejections per cost, and
become one CASE: a row that an earlier rule rejects doesn't evaluate later ones. The order
changes what a row costs, never its verdict; `rejected_by` names the first rule in that order
that rejects it, so pass `order` where it must not vary between runs.

Words are runs between ASCII white space, so `RULES` reject clean Chinese, Japanese and often Thai
prose by its mean word length; `ANY_SCRIPT` doesn't.

Everything is built-in functions on one row; there is no shuffle. Null and empty texts have
zero counts and fail the base. A very long text is one row's work, in proportion to its length but for
the sorting of its 5-word windows' hashes. Repeated rows stay; an empty table gives an empty
one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import WORD, Workspace

#: Distinct texts that the estimates are made of, about.
SAMPLE_ROWS = 1000
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:
        # a window covers five words, or as many as there are before the next one begins
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - p, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda x, j, step: F.coalesce(F.get(ordered, j + step)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, j: F.when(j > 0, same(x, j, -1)).otherwise(False) | same(x, j, 1)), lambda x: x["i"]))

    def count(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(let(let(ordered, places), covered))

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.when(F.size(words) < 6, F.lit(0).cast("bigint")).otherwise(let(grams, count))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[Column, Column], Column]  # of the text and its measures


def _share(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


#: Letters of scripts written without blanks between words, and all other characters.
BLANKLESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"


def _blankless(text: Column) -> Column:
    """Whether half of the letters or more are of such scripts, where runs between blanks aren't words."""
    return _share(text, rf"[^{BLANKLESS}]+") * 2 >= _share(text, r"\P{L}+")


#: Thresholds are ours and the SQL's, wide enough for natural prose in scripts that are written with blanks.
RULES = (
    Rule("mean_word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
    Rule("symbols_per_word", lambda t, m: m["n_symbols"] * 10 > m["n_words"] * 3),
    Rule("duplicate_lines", lambda t, m: m["n_dup_lines"] * 2 > F.size(F.split(t, "\n"))),
    Rule("few_letters", lambda t, m: _share(t, r"\P{L}+") * 2 < m["word_chars"]),
    Rule("shouting", lambda t, m: _share(t, r"\P{Lu}+") * 10 > m["word_chars"] * 6),
    Rule("bullet_lines", lambda t, m: (F.regexp_count(t, F.lit(r"(?m)^[\x20\t]*[-*•]\x20")) * 10 > F.size(F.split(t, "\n")) * 9) & (F.size(F.split(t, "\n")) > 3)),
    Rule("words_without_letters", lambda t, m: F.regexp_count(t, F.lit(r"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D\p{L}]+(?=[\x20\x09-\x0D]|$)")) * 2 > m["n_words"]),
)


#: RULES, but the mean length of words has no upper bound in scripts without blanks; not what the SQL says.
ANY_SCRIPT = (Rule("mean_word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | ((m["word_chars"] > 25 * m["n_words"]) & ~_blankless(t))), *RULES[1:])


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float  # nanoseconds a row
    selectivity: float

    @property
    def rate(self) -> float:
        return self.selectivity / self.cost


def sample(df: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """t: about `rows` distinct texts, whole, those with the least hashes."""
    n = df.count()
    hashed = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64(F.lit(3), "t"))
    return hashed.where(F.col("h") <= F.lit(min((1 << 63) - 1, int(rows / max(1, n) * (1 << 64)) - (1 << 63)))).groupBy("h").agg(F.min("t").alias("t")).select("t")


def estimate(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost a row and share of rejections of each rule on a sample, best rejection per cost first; ties keep the given order."""
    work = Workspace(df.sparkSession, "quality")
    some = work.save(sample(df, text, rows).withColumn("m", measures(F.col("t"))), "sample")
    clock = lambda: F.expr("reflect('java.lang.System', 'nanoTime')").cast("bigint")  # noqa: E731  read once a row, in place
    rejects = lambda r: F.coalesce(r.reject(F.col("t"), F.col("m")), F.lit(False))
    steps = [clock().alias("c0")]
    for i, r in enumerate(rules, 1):
        steps += [rejects(r).alias(f"r{i}"), clock().alias(f"c{i}")]
    timed = some.select(*steps)
    each = [x for i in range(1, len(rules) + 1) for x in (F.percentile_approx(F.col(f"c{i}") - F.col(f"c{i - 1}"), 0.5).alias(f"cost{i}"), F.avg(F.col(f"r{i}").cast("int")).alias(f"share{i}"))]
    s = timed.agg(*each).first()
    work.drop("sample")
    found = [Estimate(r, float(s[f"cost{i}"] or 1), s[f"share{i}"] or 0.0) for i, r in enumerate(rules, 1)]
    return sorted(found, key=lambda e: -e.rate)


def cascade(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """Per row: key, the measures, base_failed, kept, rejected_by (null where kept)."""
    order = [e.rule for e in estimate(df, text, rules)] if order is None else order
    t, m = F.col("body"), F.col("measured")
    base = (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)
    verdict = F.when(base, F.lit("base"))
    for r in order:
        verdict = verdict.when(r.reject(t, m), F.lit(r.name))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).withColumn("measured", measures(t))
    return rows.select(F.col("key").alias(key), "measured.*", base.alias("base_failed"), verdict.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())
