"""Exact n-gram Jaccard join by vertical partitioning.

1. Sets. A document is the set of its distinct 5-word shingles, as 64-bit hashes. Documents
   with equal sets form a class at once (key: a hash of the set, `rid`; sets that another 64 bits
   tell apart get keys of their own).
2. First vertical cut: hash space is cut into fragments. Each task sends every fragment one
   packed row of the classes it saw first; a fragment counts in how many classes each of its
   shingles occurs and returns those in two or more, by class. Shingles that a bounded sample of
   classes shows to be very common are known to be shared: their occurrences go straight to
   their classes, so no fragment gathers them. A class whose shared shingles
   are fewer than 0.75 of its set can't have a partner and is done.
3. Global order of the shared shingles: rarest first (by steps of a third of a doubling), then by hash. Two linked sets share one
   of the first n - ceil(0.75 n) + 1 shingles each (those in one class only come before all), and
   the smaller set has it in its first n - ceil(6/7 n) + 1.
4. Pairs. Classes that share such a shingle form a bucket. First every member is paired with
   two pivots of its bucket only, in `PIVOT_ROUNDS` rounds; components come of the links found.
   Then, in buckets that still hold several components, all pairs between different components
   are compared, block by block: no link is lost, and a large group of near copies costs rows
   in proportion to its size, not to its square. Blocks hold sets of like sizes; two of them meet only in a
   bucket where sizes, prefixes and what follows the shingle leave room for a link.
5. Second vertical cut: the global order is cut at quantiles into fragments. For each pair the
   partial overlap of each fragment is counted separately, and summed per pair.

Components come from rounds of hooking to the least neighbour and relabelling, all distributed.
Joins whose keys can be hot are salted: a shingle's entries by its own frequency, and the rows of
the 1000 most frequent nodes, components and sets `SALTS` ways, so that no other key has a thousandth of the rows.

Documents without words, and null texts, have no shingles and no links. Very long texts are one
row's work; blocks with long sets hold fewer. Repeated rows are
equal sets. Rows without a key take part; a component's id is its smallest non-null key, null
if it has none. An empty table gives an empty one; only the named columns are read. Shingles are told apart by 64 bits when they are counted (59 and more
where there are 8 fragments, more with more) and by 56 afterwards: any two of two sets of a thousand
shingles are confused with a probability below 2e-11. Sets are told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import ASCII_LOWER, Workspace, released, unused

WORDS = 5
PERCENT = 75
BLOCK_SHINGLES = 1 << 20
CUTS = 4
PIVOT_ROUNDS = 2
BLOCK_DOCUMENTS = 192
#: Shingles of a block's documents, about.
BLOCK_LENGTHS = 1 << 19
#: Bits of a shingle's hash below its frequency class in the global order.
HASH_BITS = 56
#: Work is cut into so many fragments that one has about this many shingles, if shuffle partitions are fewer.
FRAGMENT_SHINGLES = 1 << 21
#: Classes, about, that tell which shingles are very common; in how many of them one is, and how many of the
#: most common go their own way. All others are counted in their fragment, with the same result.
HOT_SAMPLE = 8192
HOT_COUNT = 32
HOT_MOST = 100_000
#: Ways to part the rows of one key, and the entries of a shingle that go together.
SALTS = 8
TOGETHER = 4096


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    n = len(words)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
    a = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    h = a[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, k):
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) + a[i : n - k + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def set_ids(h: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit hashes of a set; of the first, `bits` bits."""
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(x >> 64 & (1 << bits) - 1), signed(x & (1 << 64) - 1)


def class_table(df: DataFrame, text: str, key: str, rate: int = 1, bits: int = 64) -> DataFrame:
    """key, rid and check (null without shingles), n; and rows that have a `sample`, the set itself, one for each task and class of which check mod `rate` is 0."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            ids, n, sampled = [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py())
                n.append(len(h))
                ids.append(set_ids(h, bits) if len(h) else (None, None))
                check = ids[-1][1]
                if len(h) > 2 and check % rate == 0 and check not in sent:
                    sent.add(check)
                    sampled.append((check, h.tobytes()))
            names = [key, "rid", "check", "n", "sample"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in ([r for r, _ in ids], [c for _, c in ids], n)), pa.nulls(len(n), pa.binary())], names=names)
            for x in sampled:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.array([x[0]], pa.int64()), pa.nulls(1, pa.int64()), pa.array([x[1]], pa.binary())], names=names)

    return df.select(key, F.col(text).cast("string").alias(unused("text", [key]))).mapInArrow(released(run), f"`{key}` {kind}, rid bigint, check bigint, n bigint, sample binary")


def common_shingles(sampled: DataFrame, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of very common shingles, ascending, and their frequency classes; HOT_MOST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n, pa.int64())], names=["gram", "n"])

    once = sampled.dropDuplicates(["check"]).select("sample")
    found = once.mapInArrow(released(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "gram").limit(HOT_MOST).collect()
    grams = np.array([r["gram"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], frequency_class(np.array([r["n"] for r in found], np.int64)[order] * rate)


def frequency_class(n: np.ndarray) -> np.ndarray:
    """Steps of a third of a doubling, at most 127."""
    return np.minimum(127, np.floor(3 * np.log2(np.maximum(n, 1)) + 1e-9)).astype(np.uint64)


def twins(classes: DataFrame) -> dict[tuple[int, int], int]:
    """New keys for sets that share a key with another: by (rid, check). With 64 bits there is about one in every 2 ** 65 pairs of sets."""
    several = [r["rid"] for r in classes.groupBy("rid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("rid").collect()]
    found = classes.where(F.col("rid").isin(several)).select("rid", "check").distinct().collect() if several else []
    least: dict[int, int] = {}
    for r in found:
        least[r["rid"]] = min(r["check"], least.get(r["rid"], r["check"]))
    new = lambda r: int(np.uint64(xxhash.xxh64_intdigest(f"{r['rid']}:{r['check']}")).astype(np.int64))
    return {(r["rid"], r["check"]): new(r) for r in found if r["check"] != least[r["rid"]]}


def frequent(rows: DataFrame, key: str) -> list:
    """The keys with the most rows, of those with over TOGETHER / 4: 1000 at most, so any key with a thousandth of the rows is among them."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER // 4)
    return [r[key] for r in n.orderBy(F.desc("n"), key).limit(1000).collect()]


def pieces_of(gram: Column) -> Column:
    """Into how many pieces the entries of a shingle are parted: its frequency, to a third of a doubling, over TOGETHER."""
    doublings = F.floor(F.shiftright(gram, HASH_BITS) / 3).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), doublings - (TOGETHER.bit_length() - 1)))


def by_gram(left: DataFrame, right: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Joined on `gram`; the left rows of one shingle are parted by `spread`, and the right ones, few for each shingle, go to all parts."""
    parted = left.withColumn("piece", F.pmod(F.xxhash64(spread), pieces_of(F.col("gram"))))
    return parted.join(right.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces_of(F.col("gram")) - 1))), ["gram", "piece"], how).drop("piece")


def salted(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Joined on `on`, of which the left side may have many rows for one key, parted by `spread`, and the right side one. With `hot`, a list of keys, only theirs are parted."""
    is_hot = F.lit(True) if hot is None else F.col(on[0]).isin(hot)
    parted = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    return parted.join(right.withColumn("salt", F.explode(every)), [*on, "salt"], how).drop("salt")


PACKED = "part int, rids binary, ns binary, lens binary, grams binary, extra binary"


def _packed(parts: np.ndarray, order_rids: np.ndarray, ns: np.ndarray, grams: np.ndarray, extra: np.ndarray) -> Iterator[tuple]:
    """One packed row per part of occurrences that are sorted by part and then by class: (part, rids, ns, run lengths, grams, extra)."""
    if not len(parts):
        return
    new_run = np.r_[True, (parts[1:] != parts[:-1]) | (order_rids[1:] != order_rids[:-1])]
    runs = np.flatnonzero(new_run)
    lens = np.diff(np.r_[runs, len(parts)]).astype(np.uint32)
    run_part = parts[runs]
    firsts = np.flatnonzero(np.r_[True, run_part[1:] != run_part[:-1]])
    for a, b in zip(firsts, np.r_[firsts[1:], len(runs)]):
        lo, hi = runs[a], runs[b] if b < len(runs) else len(parts)
        yield int(run_part[a]), order_rids[runs[a:b]].tobytes(), ns[runs[a:b]].astype(np.uint32).tobytes(), lens[a:b].tobytes(), grams[lo:hi].tobytes(), extra[lo:hi].tobytes()


def _packed_batches(rows: Iterator[tuple], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["part", "rids", "ns", "lens", "grams", "extra"])

    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield out()
            held.clear()
    if held:
        yield out()


def _unpacked(batches: Iterator[pa.RecordBatch], gram_kind: str) -> tuple[np.ndarray, ...] | None:
    """Of all rows: part, rid and n of each run; run of each occurrence; grams; bytes of extra."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        for i in range(batch.num_rows):
            part, *raw = (batch.column(k)[i].as_py() for k in range(6))
            rids = np.frombuffer(raw[0], np.int64)
            for c, x in zip(cols, (np.full(len(rids), part, np.int64), rids, *(np.frombuffer(x, k) for x, k in zip(raw[1:], ("u4", "u4", gram_kind, "u1"))))):
                c.append(x)
    if not cols[0]:
        return None
    part, rid, n, lens, grams, extra = (np.concatenate(c) for c in cols)
    return part, rid, n, np.repeat(np.arange(len(rid), dtype=np.int32), lens), grams, extra


def fragment_rows(df: DataFrame, text: str, fragments: int, common: tuple[np.ndarray, np.ndarray], renamed: dict[tuple[int, int], int], bits: int = 64) -> DataFrame:
    """First vertical cut: packed rows by fragment, each class once a task. grams: low 32 bits; extra: the next 24.

    Common shingles are packed by a bucket of their class instead: grams are places in the global order, extra is empty.
    """
    hot, hot_class = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_low = np.zeros(1 << 20, bool)
        hot_low[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        ids: list[int] = []
        held = 0

        def flush() -> Iterator[tuple]:
            h = np.concatenate(sets)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
            rid = np.array(ids, np.int64)
            is_hot = np.zeros(len(h), bool)
            maybe = np.flatnonzero(hot_low[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(hot, h[maybe]), len(hot) - 1)
                sure = hot[at] == h[maybe]
                maybe, at = maybe[sure], at[sure]
                is_hot[maybe] = True
                value = hot_class[at] << np.uint64(HASH_BITS) | h[maybe] & np.uint64((1 << HASH_BITS) - 1)
                who = owner[maybe]
                bucket = (rid.view(np.uint64) % np.uint64(fragments)).astype(np.int64)[who]
                order = np.lexsort((who, bucket))
                yield from _packed(bucket[order], rid[who[order]], size[who[order]], value[order], np.zeros((len(order), 0), np.uint8))
                h, owner = h[~is_hot], owner[~is_hot]
            part = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            part = part.astype(np.uint16 if fragments <= 65536 else np.uint32)
            order = np.argsort(part, kind="stable")
            h, owner = h[order], owner[order]
            middle = (h >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            yield from _packed(part[order].astype(np.int64), rid[owner], size[owner], h.astype(np.uint32), middle)

        def rows() -> Iterator[tuple]:
            nonlocal held
            for batch in batches:
                for t in batch.column(0):
                    h = shingles(t.as_py())
                    if len(h) < 3:  # links of smaller sets are equalities
                        continue
                    ids_of = set_ids(h, bits)
                    rid = renamed.get(ids_of, ids_of[0]) if renamed else ids_of[0]
                    if rid in seen:
                        continue
                    seen.add(rid)
                    sets.append(h)
                    ids.append(rid)
                    held += len(h)
                    if held >= BLOCK_SHINGLES:
                        yield from flush()
                        sets.clear()
                        ids.clear()
                        held = 0
            if sets:
                yield from flush()

        yield from _packed_batches(rows())

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(released(run), PACKED)


def shared_rows(fragments: DataFrame, buckets: int) -> DataFrame:
    """Of each fragment: shingles in two or more classes, as places in the global order, packed by a bucket of the class. Rows of common shingles pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = []
        for batch in batches:
            is_common = pc.equal(pc.binary_length(batch.column(5)), 0)
            if is_common.true_count:
                yield batch.filter(is_common)
            counted.append(batch.filter(pc.invert(is_common)))
        got = _unpacked(counted, "u4")
        if got is None:
            return
        counted.clear()
        part, rid, n, run_of, low, middle = got
        # a class that several tasks sent counts once
        order = np.lexsort((rid, part))
        again = np.zeros(len(rid), bool)
        again[order[1:]] = (rid[order[1:]] == rid[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
        keep = ~again[run_of]
        middle = middle.reshape(-1, 3)
        key = low.astype(np.uint64)
        for i in range(3):
            key |= middle[:, i].astype(np.uint64) << np.uint64(32 + 8 * i)
        run_of, key = run_of[keep], key[keep]
        del low, middle, keep, got
        where = part[run_of]
        order = np.argsort(key) if len(part) and (part == part[0]).all() else np.lexsort((key, where))
        key, run_of, where = key[order], run_of[order], where[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (where[1:] != where[:-1])]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(key)])
        shared = np.repeat(count >= 2, count)
        classes = np.repeat(frequency_class(count), count)[shared]
        key, run_of = classes << np.uint64(HASH_BITS) | key[shared], run_of[shared]
        bucket = rid[run_of].view(np.uint64) % np.uint64(buckets)
        order = np.lexsort((run_of, bucket))
        run_of = run_of[order]
        yield from _packed_batches(_packed(bucket[order].astype(np.int64), rid[run_of], n[run_of], key[order], np.zeros((len(order), 0), np.uint8)))

    return fragments.mapInArrow(released(run), PACKED)


SURVIVORS = "rid bigint, n bigint, s bigint, grams binary"


def survivors(shared: DataFrame) -> DataFrame:
    """Classes with enough shared shingles. grams: these, as uint64 in global order (frequency class, then hash), ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches, "u8")
        if got is None:
            return
        _, rid, n, run_of, value, _ = got
        who, at = np.unique(rid, return_inverse=True)
        size = np.zeros(len(who), np.int64)
        size[at] = n
        owner = at[run_of]
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        # several tasks send the common shingles of one class
        once = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(owner) else np.zeros(0, bool)
        owner, value = owner[once], value[once]
        s = np.bincount(owner, minlength=len(who))
        keep = (100 * s >= PERCENT * size)[owner]
        owner, value = owner[keep], value[keep]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(owner)].astype(np.int64)
        for a in range(0, len(starts), 512):
            some = list(zip(starts[a : a + 512], ends[a : a + 512]))
            o = [owner[x] for x, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(who[o], pa.int64()), pa.array(size[o], pa.int64()), pa.array([int(y - x) for x, y in some], pa.int64()), pa.array([value[x:y].tobytes() for x, y in some], pa.binary())], names=["rid", "n", "s", "grams"])

    return shared.mapInArrow(released(run), SURVIVORS)


def prefixes(alive: DataFrame) -> DataFrame:
    """gram, rid, n, rest, low: the shared shingles within each class's prefix of the global order.

    rest: shared shingles from this one on; low: is it in the prefix that a set has as the smaller of a pair?
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for rid, n, s, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                p = s - -(-PERCENT * n // 100) + 1
                smaller = s - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
                at = np.arange(p)
                for o, x in zip(out, (np.frombuffer(raw, np.int64)[:p], np.full(p, rid, np.int64), np.full(p, n, np.int64), s - at, at < smaller)):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["gram", "rid", "n", "rest", "low"])

    return alive.mapInArrow(released(run), "gram bigint, rid bigint, n bigint, rest bigint, low boolean")


def segments(alive: DataFrame, cuts: list[int]) -> DataFrame:
    """Second vertical cut: rid, n, fragment, segment; the global order is cut before each of `cuts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(cuts, np.int64)
        for batch in batches:
            rows = []
            for rid, n, _, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                g = np.frombuffer(raw, np.int64)
                ends = [0, *np.searchsorted(g, at), len(g)]
                rows += [(rid, n, f, g[a:b].tobytes()) for f, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["rid", "n", "fragment", "segment"])

    return alive.mapInArrow(released(run), "rid bigint, n bigint, fragment int, segment binary")


@F.pandas_udf(T.LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def links(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """Of (x, y): those with 100 * overlap >= 75 * union; partial overlaps by fragment are summed per pair."""
    left = pairs.join(segs.select(F.col("rid").alias("x"), F.col("n").alias("nx"), "fragment", F.col("segment").alias("sx")), "x")
    both = left.join(segs.select(F.col("rid").alias("y"), F.col("n").alias("ny"), "fragment", F.col("segment").alias("sy")), ["y", "fragment"])
    parts = both.select("x", "y", "nx", "ny", _overlap("sx", "sy").alias("partial"))
    summed = parts.groupBy("x", "y", "nx", "ny").agg(F.sum("partial").alias("overlap"))
    return summed.where(F.col("overlap") * 100 >= PERCENT * (F.col("nx") + F.col("ny") - F.col("overlap"))).select("x", "y")


def pivot_pairs(labelled: DataFrame, seed: int) -> DataFrame:
    """x, y: every member of a bucket with the two members of least and greatest seeded hash, unless it shares their component or can't be linked by this shingle. Rows grow with the buckets' sizes."""
    who = F.struct("rid", "n", "comp", "rest", "low")
    pivots = labelled.groupBy("gram").agg(F.min_by(who, F.xxhash64("rid", F.lit(seed))).alias("p"), F.max_by(who, F.xxhash64("rid", F.lit(seed))).alias("q"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("low").alias("any")).where("lo <> hi AND any")
    met = by_gram(labelled, pivots.select("gram", F.explode(F.array("p", "q")).alias("p")), "rid").where("p.comp <> comp").where(_close("n", "p.n") & _room("rest", "n", "p.rest", "p.n")).where("(n <= p.n AND low) OR (p.n <= n AND p.low)")
    return met.select(F.least("rid", "p.rid").alias("x"), F.greatest("rid", "p.rid").alias("y")).distinct()


def _close(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _room(rest_a: str, a: str, rest_b: str, b: str) -> Column:
    """Can the overlap be enough if it begins here? A linked pair's first common shingle leaves room."""
    return F.least(rest_a, rest_b) * (100 + PERCENT) >= (F.col(a) + F.col(b)) * PERCENT


def block_links(work: Workspace, labelled: DataFrame, segs: DataFrame) -> DataFrame:
    """x, y: labels of different components with a link between them, found among all pairs that share a bucket.

    Documents of open buckets (those with several components) are put into blocks of about
    `BLOCK_DOCUMENTS`: each large component makes its own blocks, other documents go by their
    most common open shingle, and both by size where there are many. Blocks that meet in a bucket are compared as a whole: a row is
    a pair of blocks and a fragment, its result a matrix of partial overlaps; the matrices of a
    pair of blocks are summed. Left out are pairs of blocks of one and the same component, and those
    whose members can't be linked by this bucket's shingle, by size, prefix or what follows it.
    """
    mixed = labelled.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.max("low").alias("any")).where("lo <> hi AND any").select("gram", "m")
    met = work.save(by_gram(labelled, mixed, "rid"), "open")
    docs = met.groupBy("rid", "n", "comp").agg(F.max(F.struct("m", "gram"))["gram"].alias("gram"))
    of_comp = docs.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_DOCUMENTS // 4)
    docs = salted(docs, of_comp.select("comp", F.lit(True).alias("pure")), ["comp"], "rid", "left").withColumn("pure", F.coalesce("pure", F.lit(False)))
    docs = docs.withColumn("place", F.when(F.col("pure"), F.col("comp")).otherwise(F.col("gram")))
    docs = work.save(docs.select("rid", "n", "comp", "pure", "place", F.floor(F.log("n") / math.log(100 / PERCENT)).alias("like")), "open-documents")
    by_size = docs.groupBy("pure", "place", "like").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    large = by_size.groupBy("pure", "place").agg(F.sum("m").alias("all_m"), F.sum("n").alias("all_n")).where((F.col("all_m") > BLOCK_DOCUMENTS) | (F.col("all_n") > BLOCK_LENGTHS)).select("pure", "place")
    pieces = by_size.join(large, ["pure", "place"]).select("pure", "place", "like", F.ceil(F.greatest(F.col("m") / BLOCK_DOCUMENTS, F.col("n") / BLOCK_LENGTHS)).alias("pieces"))
    parted = F.when(F.col("pieces").isNull(), F.xxhash64("pure", "place")).otherwise(F.xxhash64("pure", "place", "like", F.pmod(F.xxhash64("rid"), "pieces")))
    blocks = salted(docs, pieces, ["pure", "place", "like"], "rid", "left").withColumn("block", parted)
    blocks = blocks.groupBy("block", "pure").agg(F.sort_array(F.collect_list(F.struct("rid", "n", "comp"))).alias("members"))
    blocks = work.save(blocks, "blocks")
    inside = blocks.select("block", F.when(F.col("pure"), F.col("members")[0]["comp"]).alias("only"), F.size("members").alias("size"), F.posexplode("members").alias("i", "m"))
    inside = work.save(inside.select("block", "only", "size", "i", "m.rid"), "inside")
    packed = inside.join(segs, "rid").groupBy("block", "fragment").agg(F.collect_list(F.struct("i", "segment")).alias("sets"))
    packed = work.save(packed, "packed")

    at = met.select("gram", "rid", "n", "rest", "low").join(inside, "rid").groupBy("gram", "block", "only", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.max("low").alias("low"))
    a, b = (at.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "only", "size", "least", "most", "rest", "low"))) for s in "ab")
    first = F.struct("size_a", "block_a") <= F.struct("size_b", "block_b")
    same = F.coalesce(F.col("only_a") == F.col("only_b"), F.lit(False))
    like = (F.col("most_a") * 100 >= F.col("least_b") * PERCENT) & (F.col("most_b") * 100 >= F.col("least_a") * PERCENT)
    # the smaller block travels to the larger
    pairs = by_gram(a, b, "block_a").where(first & ~same & like & (F.col("low_a") | F.col("low_b")) & _room("rest_a", "least_a", "rest_b", "least_b")).select("block_a", "size_a", "block_b", "size_b").distinct()
    pairs = work.save(pairs, "block-pairs")
    left = pairs.join(packed.select(F.col("block").alias("block_a"), "fragment", F.col("sets").alias("sets_a")), "block_a")
    both = left.join(packed.select(F.col("block").alias("block_b"), "fragment", F.col("sets").alias("sets_b")), ["block_b", "fragment"])
    partial = both.select("block_a", "block_b", _matrix("size_a", "sets_a", "size_b", "sets_b").alias("matrix"))
    # at most one matrix a fragment
    summed = partial.groupBy("block_a", "block_b").agg(F.collect_list("matrix").alias("matrices"))
    named = summed.join(blocks.select(F.col("block").alias("block_a"), F.col("members").alias("a")), "block_a").join(blocks.select(F.col("block").alias("block_b"), F.col("members").alias("b")), "block_b")
    return named.select(F.explode(_linked("matrices", "a.n", "a.comp", "b.n", "b.comp")).alias("l")).select("l.x", "l.y").distinct()


@F.pandas_udf(T.BinaryType())
def _matrix(size_a: pd.Series, sets_a: pd.Series, size_b: pd.Series, sets_b: pd.Series) -> pd.Series:
    """Overlaps of each set of a block with each set of another, uint32, row by row."""

    def one(m: int, a: list, n: int, b: list) -> bytes:
        out = np.zeros((m, n), np.uint32)
        parts = [np.frombuffer(x["segment"], np.int64) for x in b]
        grams, owner = np.concatenate(parts), np.repeat(np.array([x["i"] for x in b]), [len(p) for p in parts])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        for x in a:
            g = np.frombuffer(x["segment"], np.int64)
            lo, hi = np.searchsorted(grams, g), np.searchsorted(grams, g, "right")
            k = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            out[x["i"]] = np.bincount(owner[at], minlength=n)
        return out.tobytes()

    return pd.Series([one(*x) for x in zip(size_a, sets_a, size_b, sets_b)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])))
def _linked(matrices: pd.Series, na: pd.Series, ca: pd.Series, nb: pd.Series, cb: pd.Series) -> pd.Series:
    """Sums the partial overlaps and tells which components are linked, each pair of components once."""

    def one(parts: list, n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> list:
        overlap = np.sum([np.frombuffer(p, np.uint32).reshape(len(n), len(m)) for p in parts], axis=0, dtype=np.int64)
        i, j = np.nonzero((100 * overlap >= PERCENT * (n[:, None] + m[None, :] - overlap)) & (a[:, None] != b[None, :]))
        return [{"x": int(x), "y": int(y)} for x, y in {(min(x, y), max(x, y)) for x, y in zip(a[i], b[j])}]

    return pd.Series([one(p, *map(np.asarray, rest)) for p, *rest in zip(matrices, na, ca, nb, cb)], dtype=object)


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, comp: comp is the least node reachable. Rounds of hooking each node to its least neighbour, then relabelling both tables."""
    edges = work.save(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), f"{name}-edges-0")
    labels = work.save(edges.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("comp", F.col("node")), f"{name}-labels-0")
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.select(F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
        hook = work.save(both.groupBy("e.x").agg(F.least(F.min("e.y"), F.first("e.x")).alias("to"), F.count("*").alias("n")), f"{name}-hook-{k}")
        # any node that many rows of a table below name has many edges
        hubs = [r["x"] for r in hook.where(F.col("n") > TOGETHER // 4).orderBy(F.desc("n"), "x").limit(1000).select("x").collect()]
        # follow two hooks at once
        far = salted(hook.select("x", F.col("to").alias("via")), hook.select(F.col("x").alias("via"), "to"), ["via"], "x", hot=hubs).select("x", "to")
        far = work.save(far, f"{name}-far-{k}")
        # at first every node is its own label
        next_labels = far.select(F.col("x").alias("node"), F.col("to").alias("comp")) if k == 1 else salted(labels, far.withColumnRenamed("x", "comp"), ["comp"], "node", "left", frequent(labels, "comp")).select("node", F.coalesce("to", "comp").alias("comp"))
        labels = work.save(next_labels, f"{name}-labels-{k}")
        begun = salted(edges, far.select("x", F.col("to").alias("tx")), ["x"], "y", hot=hubs)
        moved = salted(begun, far.select(F.col("x").alias("y"), F.col("to").alias("ty")), ["y"], "x", hot=hubs).select(F.least("tx", "ty").alias("x"), F.greatest("tx", "ty").alias("y")).where("x <> y").distinct()
        edges = work.save(moved, f"{name}-edges-{k}")
        work.drop(f"{name}-edges-{k - 1}", f"{name}-labels-{k - 1}", f"{name}-hook-{k}", f"{name}-far-{k}")
    return labels


def similar_components(df: DataFrame, text: str = "text", key: str = "doc_id", pivot_rounds: int = PIVOT_ROUNDS, set_bits: int = 64) -> DataFrame:
    """Per row of df: key, n_shingles, component_id."""
    spark = df.sparkSession
    work = Workspace(spark, "jaccard")
    rate = max(1, df.count() // HOT_SAMPLE)
    read = work.save(class_table(df, text, key, rate, set_bits), "classes")
    classes = read.where("sample IS NULL").drop("sample")
    common = common_shingles(read.where("sample IS NOT NULL").select("check", "sample"), rate)
    renamed = twins(classes.where("rid IS NOT NULL"))
    if renamed:
        names = F.create_map(*(F.lit(x) for (r, c), new in renamed.items() for x in (f"{r}:{c}", new)))
        classes = classes.withColumn("rid", F.coalesce(F.try_element_at(names, F.concat_ws(":", "rid", "check")), F.col("rid")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT_SHINGLES))

    packed = fragment_rows(df, text, parts, common, renamed, set_bits).repartitionById(parts, "part")
    shared = shared_rows(packed, parts).repartitionById(parts, "part")
    alive = work.save(survivors(shared), "alive")

    # quantiles of the global order, from values evenly spaced in each set
    spread = alive.select(F.explode(_evenly("grams")).alias("o"))
    cuts = spread.agg(F.percentile_approx("o", [i / CUTS for i in range(1, CUTS)], 1000).alias("q")).first()["q"] or []
    segs = work.save(segments(alive, sorted(set(cuts))), "segments")
    entries = work.save(prefixes(alive), "entries")
    work.drop("alive")

    def labelled(comps: DataFrame) -> DataFrame:
        return entries.join(comps.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))

    comps = entries.select(F.col("rid").alias("node"), F.col("rid").alias("comp")).limit(0)
    found = entries.select(F.col("rid").alias("x"), F.col("rid").alias("y")).limit(0)
    for k in range(1, pivot_rounds + 1):
        pairs = work.save(pivot_pairs(labelled(comps), k), f"pairs-{k}")
        found = work.save(found.unionByName(links(pairs, segs)), f"links-{k}")
        comps = components(work, found, f"round-{k}")
        work.drop(f"pairs-{k}")
    more = work.save(block_links(work, labelled(comps), segs), "block-links")
    work.drop("segments", "entries", "open", "open-documents", "inside", "packed", "block-pairs", "blocks")
    comps = components(work, found.unionByName(more), "all")

    least = work.save(classes.where("rid IS NOT NULL").groupBy("rid").agg(F.min(key).alias("least"), F.count("*").alias("n")), "least")
    often = [r["rid"] for r in least.where(F.col("n") > TOGETHER // 4).orderBy(F.desc("n"), "rid").limit(1000).select("rid").collect()]
    linked = comps.select(F.col("node").alias("rid"), "comp").join(least.drop("n"), "rid")
    roots = linked.groupBy("comp").agg(F.min("least").alias("root"))
    found_roots = salted(linked, roots, ["comp"], "rid", hot=frequent(comps, "comp")).select("rid", "root")
    named = work.save(least.drop("n").join(found_roots, "rid", "left").select("rid", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root")).alias("least")), "named")
    told = salted(classes.where("rid IS NOT NULL"), named, ["rid"], key, hot=often).select(key, F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return told.unionByName(classes.where("rid IS NULL").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _evenly(raw: pd.Series) -> pd.Series:
    """Eight values of each sorted set."""
    return raw.map(lambda x: (g := np.frombuffer(x, np.int64))[np.linspace(0, len(g) - 1, 8).astype(int)] if len(x) else np.zeros(0, np.int64))
