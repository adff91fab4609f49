"""Sharding along a Hilbert curve, for file pruning by several columns at once.

Each dimension, the metadata columns and the size, is quantised to `BITS` bits in its own order, so
that ranges of values lie in few shards: a value's coordinate is its rank, spread over the cells, where there are no more
values than cells, and else the quantile, by rows, at which it begins. Quantiles come of a table of the
distinct values and their counts; at most one cut a cell reaches the driver. The cell's index on the Hilbert curve
comes of a table of the curve's states, made by rule and walked one bit of every dimension at a
time by `aggregate`. Rows are ordered by that index, then by the dimensions themselves, checksum, size and
id, so that equal texts of one cell stand together, and the order is cut into `shards` runs.
Everything is built-in functions.

Law `rows`: shard = position * shards div rows, so counts differ by one at most. Null text: size
1, checksum of no bytes, however long another text is it counts as one row; null metadata come before all values. A null id sorts first. Equal
rows are interchangeable. An empty table gives an empty one. Columns of any names may be there; only the
named ones are read, but by `write_shards`, which writes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import Workspace
from loomfield.llm.ranking import global_rank

SHARDS = 16
BITS = 5


def curve_table(n: int) -> list[int]:
    """Of the n-dimensional Hilbert curve: at state * 2**n + cell, next state * 2**n + place. A state is an entry corner and a direction."""
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & ((1 << n) - 1)
    gray = lambda i: i ^ (i >> 1)
    place_of = {gray(i): i for i in range(1 << n)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << n)]
    along = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]
    states, table = {(0, 0): 0}, []
    todo = [(0, 0)]
    while todo:
        corner, axis = todo.pop(0)
        for cell in range(1 << n):
            i = place_of[turn(cell ^ corner, n - (axis + 1) % n)]
            to = (corner ^ turn(entry[i], axis + 1), (axis + along[i] + 1) % n)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            table.append(states[to] << n | i)
    return table


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the cell whose coordinates are `dims`, each `bits` wide."""
    n = len(dims)
    table = curve_table(n)
    states = len(table) >> n
    steps = F.expr(f"split('{' '.join(map(str, table))}', ' ')").cast("array<bigint>")

    def step(acc: Column, bit: Column) -> Column:
        cell = sum((F.call_function("shiftright", d, bit).bitwiseAND(F.lit(1)) * (1 << k) for k, d in enumerate(dims)), F.lit(0))
        t = F.get(steps, (acc % states * (1 << n) + cell).cast("int"))
        return ((acc / states).cast("bigint") * (1 << n) + t % (1 << n)) * states + (t / (1 << n)).cast("bigint")

    # the state rides in the low part of one number
    return (F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), step) / states).cast("bigint")


def cuts(work: Workspace, rows: DataFrame, dim: str, bits: int = BITS) -> list:
    """The least value of each cell but the first, ascending."""
    cells = 1 << bits
    counts = rows.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    few = counts.limit(cells + 1).collect()
    if len(few) <= cells:
        return sorted(r["value"] for r in few if r["value"] is not None)[0 if any(r["value"] is None for r in few) else 1 :]
    placed = global_rank(work, counts, [F.col("value").asc_nulls_first()], f"values-{dim}", weight="n")
    first = placed.groupBy(F.floor(F.col("position") * cells / F.col("total")).alias("cell")).agg(F.min("value").alias("value"))
    found = [r["value"] for r in first.orderBy("cell").collect()]
    work.drop(f"values-{dim}")
    return [v for v in found[1:] if v is not None]


def coordinate(c: Column, at: list, bits: int = BITS) -> Column:
    """How many cuts are at or below the value, spread over all cells; 0 for null."""
    if not at:
        return F.lit(0)
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= c)), F.lit(0))
    return F.floor(place * (1 << bits) / (len(at) + 1)).cast("int")


def cells(df: DataFrame, text: str, key: str, dims: tuple[str, ...], work: Workspace, *more: Column) -> DataFrame:
    """Per row: key, size, text_crc32, curve, d0, d1, ... (the dimensions), and more columns of df's."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(body).cast("bigint") + 1
    named = [f"d{i}" for i in range(len(dims))]
    rows = df.select(F.col(key), size.alias("size"), F.crc32(body).alias("text_crc32"), *more, *(F.col(d).alias(n) for d, n in zip(dims, named)))
    measured = work.save(rows.select("size", *named), "dimensions")
    curve = curve_index([coordinate(F.col(n), cuts(work, measured, n)) for n in (*named, "size")])
    work.drop("dimensions")
    return rows.withColumn("curve", curve)


def hilbert_shards(df: DataFrame, text: str = "text", key: str = "doc_id", dims: tuple[str, ...] = ("lang", "source"), shards: int = SHARDS) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard, curve."""
    work = Workspace(df.sparkSession, "shards")
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(d).alias(f"dim{i}") for i, d in enumerate(dims)))
    rows = cells(named, "text", "key", tuple(f"dim{i}" for i in range(len(dims))), work)
    placed = global_rank(work, rows, [F.col(c) for c in _order(len(dims), "key")], "placed")
    shard = F.expr(f"position * {shards} div total")
    return placed.withColumn("shard", shard.cast("int")).select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"position - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def _order(dims: int, key: str) -> tuple[str, ...]:
    return ("curve", *(f"d{i}" for i in range(dims)), "text_crc32", "size", key)


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> None:
    """Writes df's rows into one folder a shard, in slot order within each task's run of slots.

    `placed` is of the same rows, with the same key, text and dims. Both are numbered by cell,
    dimensions, checksum, size and key, and joined on the number, so null and repeated keys keep their rows,
    each once. A row that finds no place, or another row's, raises an error.
    """
    work = Workspace(df.sparkSession, "written")
    same = ("curve", "text_crc32", "size", "key")

    def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        # the last column lets range partitions part equal rows
        apart = rows.withColumn("apart", F.monotonically_increasing_id())
        return global_rank(work, apart, [F.col(c) for c in (*order, "apart")], name, "at", "rows").drop("apart", "rows")

    named = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(d).alias(f"dim{i}") for i, d in enumerate(dims)))
    rows = numbered(cells(named, "text", "key", tuple(f"dim{i}" for i in range(len(dims))), work, F.col("row")), [*_order(len(dims), "key")], "rows")
    places = numbered(placed.select("curve", "text_crc32", "size", F.col(key).alias("key"), "shard", "slot"), ["shard", "slot"], "places")
    right = F.struct(*(rows[c] for c in same)) == F.struct(*(places[c] for c in same))
    found = rows.join(places, "at", "full_outer").select("row", F.when(F.coalesce(right, F.lit(False)), places["shard"]).otherwise(F.raise_error(F.lit("the placement is of other rows"))).alias("shard"), "slot")
    # a column of df's that is named so gives way to the placement
    found = found.select(*(F.col(f"row.`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")), "shard", "slot")
    found.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    work.drop("rows", "places")
