"""Words of documents that lie in a benchmark's passages, found by winnowing.

A window is `WINDOW` consecutive words of an item, or the whole of an item with fewer. Its fingerprint is the least hash
of the `GRAM`-word grams within it (of the whole window where that has fewer words), so it depends on the window's words alone:
a span of `WINDOW` words or more that a document shares with an item has a fingerprint in common with it in
every window, wherever it stands. Documents keep the windows whose fingerprint some test fingerprint may equal, by a bit table of bounded size. They are
joined with the test windows on the fingerprint, and each hit is extended over all windows that chose it: their words
are compared in the same join, so the result is exact, and windows of one fingerprint but other words don't meet.

Test windows are joined as distinct texts, each once however many items have it. Items are then found by classes: windows that
the same items have are one class, documents with the same set of classes are one case, and each case
lists its items once. A window that a third of the documents share is parted among tasks by its frequency, and so is a
frequent case (`operators.skew.spread_join`). Documents' texts are read once and never shuffled; what is written is a row a document with
its candidate windows. The bit table has `FILTER_BITS` bits at most; where the benchmark is so large that it fills up, more candidates
go to the join, with the same result. Everything is built-in functions.

A-Z are lower-cased; a word is a run of ASCII letters, digits and any characters beyond ASCII. Null and empty texts, of documents and
items, have no words; an item without words hits nothing. Items with the same id are one item; an item without an id hits words but isn't
counted or listed. Documents are told apart by row, so null and repeated ids keep their rows. A very long text
is one row's work, in proportion to its length. Without items nothing is hit; an empty table gives an empty one. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.llm.common import Workspace
from loomfield.llm.quality import let
from loomfield.operators.skew import spread_join

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: Bits of the table of test fingerprints: this many for each, and at most so many; and how many of them one sets.
BITS_EACH = 32
FILTER_BITS = 1 << 20
PROBES = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    body = F.coalesce(text.cast("string"), F.lit(""))
    # of ASCII alone, `lower` does the same as `translate`, and faster
    folded = F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    return F.regexp_extract_all(folded, F.lit(WORDS), F.lit(0))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def minima(hashes: Column, size: int, gram: int = GRAM) -> Column:
    """At place i, the least hash of the grams inside the window of `size` words from i on. The last size - 1 places have no window and mean nothing."""
    k = min(gram, size)
    out = let(hashes, lambda a: F.transform(a, lambda h, i: F.xxhash64(*(F.get(a, i + j) for j in range(k))))) if k > 1 else hashes
    least = lambda a, step: let(a, lambda x: F.transform(x, lambda h, i: F.least(h, F.get(x, i + step))))
    width, wanted = 1, size - k + 1
    while width < wanted:
        step = min(width, wanted - width)
        out, width = least(out, step), width + step
    return out


def test_windows(items: DataFrame, text: str, key: str, window: int, gram: int) -> DataFrame:
    """(item, size, print, words): each window of each item, with its fingerprint; words are joined by blanks."""

    def whole(w: Column, hashes: Column) -> Column:
        """Of an item that is one window."""
        n = F.size(w)
        least = F.when(n >= gram, F.array_min(F.slice(minima(hashes, gram, gram), F.lit(1), F.greatest(n - gram + 1, F.lit(0)))))
        for k in range(1, gram):
            least = least.when(n == k, F.get(minima(hashes, k, gram), F.lit(0)))
        return F.array(F.struct(n.alias("size"), least.alias("print"), F.array_join(w, " ").alias("words")))

    def parts(w: Column, hashes: Column) -> Column:
        prints = F.slice(minima(hashes, window, gram), F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(0)))
        return F.transform(prints, lambda h, i: F.struct(F.lit(window).alias("size"), h.alias("print"), F.array_join(F.slice(w, i + 1, window), " ").alias("words")))

    # the list is made before it is taken apart, so that no row carries the item's words along
    every = let(words_of(F.col(text)), lambda w: F.when(F.size(w) > 0, let(hashes_of(w), lambda h: F.when(F.size(w) < window, whole(w, h)).otherwise(parts(w, h)))))
    return items.select(F.col(key).cast("string").alias("item"), F.explode(every).alias("x")).select("item", "x.*")


class Filter:
    """Which fingerprints may be in a table: PROBES bits for each, at places that its hashes give."""

    def __init__(self, prints: DataFrame, most: int = FILTER_BITS):
        n = prints.count()
        self.bits = 64
        while self.bits < min(most, n * BITS_EACH):
            self.bits *= 2
        # at most most / 64 numbers reach the driver
        places = prints.select(F.explode(F.array(*(self._place(F.col("print"), k) for k in range(PROBES)))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("k")).agg(F.bit_or(self._bit(F.col("p"))).alias("v")).collect()
        held = [0] * (self.bits // 64)
        for r in words:
            held[r["k"]] = r["v"]
        self.text = " ".join(map(str, held))

    def _place(self, h: Column, probe: int) -> Column:
        # the least hashes aren't spread evenly, so they are hashed again
        return F.xxhash64(h, F.lit(probe)).bitwiseAND(F.lit(self.bits - 1)).cast("int")

    def _bit(self, place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)))

    def may_have(self, h: Column) -> Column:
        table = F.split(F.lit(self.text), " ").cast("array<bigint>")
        hit = lambda k: let(self._place(h, k), lambda p: F.get(table, F.shiftright(p, 6)).bitwiseAND(self._bit(p)) != 0)
        # nearly all end at the first
        found = F.lit(True)
        for k in reversed(range(PROBES)):
            found = F.when(hit(k), found).otherwise(False)
        return found


def candidates(words: Column, sizes: list[int], held: Filter, gram: int) -> Column:
    """Array of (i, size, print, words): the windows of a document whose fingerprint a test window may have."""

    def of_size(hashes: Column, size: int) -> Column:
        def chosen(least: Column) -> Column:
            at = F.array_compact(F.transform(least, lambda h, i: F.when((i <= F.size(words) - size) & held.may_have(h), i)))
            return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(size).alias("size"), F.get(least, i).alias("print"), F.array_join(F.slice(words, i + 1, size), " ").alias("words")))

        return let(minima(hashes, size, gram), chosen)

    return let(hashes_of(words), lambda h: F.concat(*(of_size(h, size) for size in sizes)))


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: key, n_words, n_hit (words inside any test window), n_items (whose windows occur), items_sha256 (their ids, sorted as strings), contaminated, spans (runs of hit words: first, length)."""
    work = Workspace(df.sparkSession, "decontaminate")
    tests = work.save(test_windows(items, item_text, item_key, window, gram), "tests")
    sizes = sorted(r["size"] for r in tests.select("size").distinct().collect())
    held = Filter(tests.select("print").distinct())
    found = (lambda w: candidates(w, sizes, held, gram)) if sizes else lambda w: F.array().cast("array<struct<i: int, size: int, print: bigint, words: string>>")
    read = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), found(w).alias("found")))
    docs = work.save(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), read.alias("read")).select("row", "key", "read.*"), "documents")

    # a class for the items of a window: their number and sums of their hashes, which need no list of them
    owners = tests.groupBy("size", "print", "words", "item").agg(F.count("*"))
    items_of = [F.count("item").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b")]
    window = F.struct("print", "size", "words")
    at = F.xxhash64("print", "size", "words").alias("at")
    windows = owners.groupBy("size", "print", "words").agg(*items_of).select(at, window.alias("test"), F.md5(F.concat_ws(":", "n", "a", "b").cast("binary")).alias("class"))
    members = owners.where("item IS NOT NULL").select(at, window.alias("owned"), "item").join(windows, "at").where("test = owned").select("class", "item").distinct()

    # the join on fingerprints and, as the hits' extension, on the words of the windows that chose them
    spots = docs.select("row", F.explode("found").alias("f")).select("row", "f.*").select("row", "i", "size", at, window.alias("window"))
    met = spread_join(spots, windows, ["at"], ["row"]).where("window = test")
    hits = work.save(met.select("row", "i", (F.col("i") + F.col("size")).alias("end"), "class"), "hits")
    ordered = Window.partitionBy("row").orderBy("i")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    starts = hits.groupBy("row", "i").agg(F.max("end").alias("end")).select("row", "i", "end", F.when(F.col("i") <= before, 0).otherwise(1).alias("new"))
    spans = starts.select("row", "i", "end", run).groupBy("row", "run").agg(F.min("i").alias("first"), (F.max("end") - F.min("i")).alias("length"))
    per_row = spans.groupBy("row").agg(F.sum("length").alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "length"))).alias("spans"))

    # documents whose windows belong to the same classes are one case, which lists its items once
    cased = hits.groupBy("row").agg(F.array_sort(F.collect_set("class")).alias("classes")).withColumn("case", F.md5(F.concat_ws(",", "classes").cast("binary")))
    each = cased.groupBy("case").agg(F.any_value("classes").alias("classes")).select("case", F.explode("classes").alias("class"))
    listed = spread_join(each, members, ["class"], ["case"]).groupBy("case").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("case", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    of_row = spread_join(cased.select("row", "case"), listed, ["case"], ["row"], "left").join(per_row, "row")
    none = F.sha2(F.lit("").cast("binary"), 256)
    zero = F.lit(0).cast("bigint")
    out = docs.select("row", "key", "n_words").join(of_row, "row", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("spans", F.array()).alias("spans"))
