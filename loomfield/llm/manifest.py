"""Merkle manifest of a table: one tree a language, one over their roots, and for every row the proof that it belongs.

A leaf is the digest of a row's columns, made by Spark's functions, so texts stay in the JVM. Leaves of a tree stand in the
order of their keys. The trees are then worked on in supersteps over RDDs, as in Pregel: a vertex is a block of
the tree, `BLOCK_LEVELS` levels high. Upward, nodes send their digests to the block above them; a block
that has all its children hashes its levels and forwards its top. Downward, a block sends each block below
it the siblings on the way from there to the root, so that leaves learn their whole path; each row folds its own,
perhaps altered, leaf with these siblings and compares the outcome with the root. A message between nodes of
one block needs no shuffle, so `log(rows) / log(fanout ** BLOCK_LEVELS)` supersteps do: four for 10**10 rows. A block has at most `fanout **
BLOCK_LEVELS` children, whatever part of the rows one language has. Each upward superstep, and each downward one but the last, is written
to the shared folder, so a lost executor repeats only its part of one. The driver sees two numbers: how many rows the largest tree has,
and how many trees there are.

A null in a column is written `-`, any other value as its length in UTF-8 bytes, a colon and the value; so null and empty differ.
Null tree: a tree of its own, before the others. Null keys come first, equal keys in the order of their leaves; rows
equal in all columns have the same leaf and are interchangeable, each with a place of its own. A lone leaf is its
tree's root; a lone node at the end of a longer level is hashed alone. Without any sibling the proof
is the digest of no text. A very long text is hashed like any. An empty table gives an empty one. Only the named
columns are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import Workspace
from loomfield.llm.ranking import global_rank
from loomfield.operators.skew import spread_join

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
BLOCK_LEVELS = 9
NODES = "tree bigint, block bigint, n bigint, nodes array<binary>, rows array<{}>, top binary"
MESSAGES = "level int, tree bigint, block bigint, path binary, at bigint, trees bigint, subroot binary, root binary"


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256))


def parent(nodes: list[bytes]) -> bytes:
    """Digests count as their hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


class Shape:
    """How trees are cut: `size` nodes of one level go to a block."""

    def __init__(self, fanout: int = FANOUT, levels: int = BLOCK_LEVELS):
        if fanout < 2 or levels < 1:
            raise ValueError("a fan-out of two and a block of one level at least")
        self.fanout, self.levels, self.size = fanout, levels, fanout**levels

    def heights(self, n: int) -> int:
        """Block levels of a tree of n leaves."""
        k = 1
        while n > self.size:
            n, k = -(-n // self.size), k + 1
        return k

    def grow(self, nodes: list[bytes], n: int) -> list[list[bytes]]:
        """A block's levels from its children up; n: nodes in the tree at the children's level."""
        levels = [nodes]
        while len(levels) <= self.levels and n > 1:
            below, n = levels[-1], -(-n // self.fanout)
            levels.append([parent(below[i : i + self.fanout]) for i in range(0, len(below), self.fanout)])
        return levels

    def siblings(self, levels: list[list[bytes]], i: int) -> list[bytes]:
        """Of the i-th child, up to the block's top."""
        found: list[bytes] = []
        for nodes in levels[:-1]:
            first = i - i % self.fanout
            found += nodes[first:i] + nodes[i + 1 : first + self.fanout]
            i //= self.fanout
        return found

    def fold(self, node: bytes, i: int, n: int, path: list[bytes]) -> bytes:
        """The root of a tree of n leaves, of its i-th leaf and the siblings, which are taken from `path`."""
        while n > 1:
            first = i - i % self.fanout
            others = [path.pop(0) for _ in range(min(self.fanout, n - first) - 1)]
            node = parent([*others[: i - first], node, *others[i - first :]])
            i, n = i // self.fanout, -(-n // self.fanout)
        return node

    def complete(self, item: tuple) -> tuple:
        """A block with all its children's messages: (tree, block, n, nodes, rows, top)."""
        (tree, block), messages = item
        got = sorted(messages, key=lambda m: m[0])
        n = got[0][1]
        if [m[0] for m in got] != list(range(min(self.size, n - block * self.size))):
            raise ValueError(f"block {block} of tree {tree} lacks children")
        nodes = [bytes(m[2]) for m in got]
        return tree, block, n, nodes, [m[3] for m in got], self.grow(nodes, n)[-1][0]


class Supersteps:
    """Trees in blocks, each level of blocks a written table."""

    def __init__(self, work: Workspace, shape: Shape):
        self.work, self.shape, self.spark = work, shape, work.spark
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, rows: RDD, schema: str, name: str) -> DataFrame:
        return self.work.save(self.spark.createDataFrame(rows, schema, verifySchema=False), name)

    def climb(self, messages: RDD, most: int, kind: str, name: str) -> list[DataFrame]:
        """Messages are ((tree, block), (place in it, nodes of the tree on this level, digest, row)); `most` is the largest number of leaves."""
        shape, tables = self.shape, []
        for level in range(shape.heights(most)):
            full = messages.groupByKey(self.parts, hash).map(shape.complete)
            tables.append(self._save(full, NODES.format(kind), f"{name}-{level}"))
            size, kind = shape.size, "int"
            onward = tables[-1].where(F.col("n") > size).select("tree", "block", "n", "top")
            messages = onward.rdd.map(lambda r, size=size: ((r.tree, r.block // size), (r.block % size, -(-r.n // size), r.top, None)))
        return tables

    def tops(self, tables: list[DataFrame]) -> DataFrame:
        """(tree, top): the trees' roots."""
        found = None
        for t in tables:
            own = t.where(F.col("n") <= self.shape.size).select("tree", "top")
            found = own if found is None else found.unionByName(own)
        return found

    def _meet(self, blocks: DataFrame, messages: DataFrame, level: int) -> RDD:
        """((tree, block), (block's row, its message))."""
        sent = messages.where(F.col("level") == level)
        return blocks.rdd.keyBy(lambda r: (r.tree, r.block)).join(sent.rdd.keyBy(lambda r: (r.tree, r.block)), self.parts).values()

    def descend(self, tables: list[DataFrame], seeds: DataFrame, name: str, last) -> RDD:  # noqa: ANN001
        """What `last(block, message, paths)` gives of the lowest blocks, when each block has sent its children the siblings on their way to the top."""
        shape = self.shape

        def paths(block, message) -> Iterator[bytes]:  # noqa: ANN001
            nodes = [bytes(x) for x in block.nodes]
            levels = shape.grow(nodes, block.n)
            for i in range(len(nodes)):
                yield b"".join(shape.siblings(levels, i)) + bytes(message.path)

        def forward(pair: tuple) -> Iterator[tuple]:
            block, m = pair
            # the tree's own top block tells its root
            for i, path in enumerate(paths(block, m)):
                yield m.level - 1, block.tree, block.block * shape.size + i, path, m.at, m.trees, m.subroot or block.top, m.root

        for level in range(len(tables) - 1, 0, -1):
            sent = self._save(self._meet(tables[level], seeds, level).flatMap(forward), MESSAGES, f"{name}-down-{level}")
            seeds = sent.unionByName(seeds.where(F.col("level") < level))
        return self._meet(tables[0], seeds, 0).flatMap(lambda pair: last(*pair, paths(*pair)))


def manifest(df: DataFrame, altered: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", tree: str = "lang", fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256 (of its siblings), folded_root, verified.

    `altered` gives what columns hold now, where that isn't what was hashed: folded_root is of that leaf with
    the siblings of the original. Without it, rows are verified as they are.
    """
    spark, shape = df.sparkSession, Shape(fanout, levels)
    kind = dict(df.dtypes)[key]
    out = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    work = Workspace(spark, "manifest")
    own = leaf(F.col(c) for c in columns)
    now = leaf((altered or {}).get(c, F.col(c)) for c in columns)
    is_altered = F.lit(False)
    for c, v in (altered or {}).items():
        is_altered = is_altered | ~F.col(c).cast("string").eqNullSafe(v.cast("string"))
    leaves = work.save(df.select(F.col(tree).cast("string").alias("name"), F.col(key).alias("key"), own.alias("leaf"), F.when(is_altered, now).alias("now")), "leaves")
    counts = leaves.groupBy("name").agg(F.count("*").alias("n"))
    first = [F.col("name").asc_nulls_first()]
    # `tree`: how many leaves stand before the tree's, which tells trees apart; `at`: its place among the trees
    starts = global_rank(work, counts, first, "starts", "tree", "rows", weight="n")
    trees = work.save(global_rank(work, starts, [F.col("tree")], "order", "at", "trees"), "trees")
    most, many = trees.agg(F.max("n"), F.max("trees")).first()
    if not most:
        return spark.createDataFrame([], out)
    order = [F.col("name").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    placed = global_rank(work, leaves, order, "placed")
    rows = spread_join(placed, trees.select("name", "tree", F.col("n").alias("leaves")), ["name"], ["position"])
    size = shape.size

    def to_block(r) -> tuple:  # noqa: ANN001
        i = r.position - r.tree
        return (r.tree, i // size), (i % size, r.leaves, r.leaf, (r.key, r.now))

    steps = Supersteps(work, shape)
    low = steps.climb(rows.select("position", "tree", "leaves", "leaf", "key", "now").rdd.map(to_block), most, f"struct<key: {kind}, now: binary>", "rows")
    work.drop("leaves", "placed")
    roots = steps.tops(low).join(trees.select("tree", "n", "at", "trees"), "tree").select("tree", "n", "at", "trees", "top")
    high = steps.climb(roots.rdd.map(lambda r: ((0, r["at"] // size), (r["at"] % size, r.trees, r.top, (r.tree, r.n)))), many, "struct<tree: bigint, n: bigint>", "trees")

    def to_trees(block, m, paths) -> Iterator[tuple]:  # noqa: ANN001
        for i, (child, path) in enumerate(zip(block.rows, paths)):
            yield shape.heights(child["n"]) - 1, child["tree"], 0, path, block.block * size + i, block.n, None, m.subroot or block.top

    def to_rows(block, m, paths) -> Iterator[tuple]:  # noqa: ANN001
        subroot, root = (m.subroot or block.top), bytes(m.root)
        for i, (row, node, path) in enumerate(zip(block.rows, block.nodes, paths)):
            whole = [path[k : k + 32] for k in range(0, len(path), 32)]
            found = shape.fold(bytes(row["now"] or node), block.block * size + i, block.n, whole)
            found = shape.fold(found, m["at"], m.trees, whole)
            yield row["key"], node.hex(), subroot.hex(), root.hex(), hashlib.sha256(path.hex().encode()).hexdigest(), found.hex(), found == root

    top = spark.createDataFrame([(shape.heights(many) - 1, 0, 0, b"", 0, 0, None, None)], MESSAGES)
    seeds = steps._save(steps.descend(high, top, "trees", to_trees), MESSAGES, "seeds")
    return spark.createDataFrame(steps.descend(low, seeds, "rows", to_rows), out, verifySchema=False)


def tampering(key: str = "doc_id", column: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """One more in `column` where `every` divides the CRC-32 of the decimal key; nulls stay."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    return {column: F.when(hit, F.col(column).cast("decimal(20,0)") + 1).otherwise(F.col(column).cast("decimal(20,0)"))}
