"""The manifest against a plain tree, with several fan-outs and block heights."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomfield.llm import manifest as M


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, n_chars) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])))


def levels_of(nodes: list[str], fanout: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels: list[list[str]], i: int, fanout: int) -> list[tuple[list[str], list[str]]]:
    """Siblings before and after, level by level."""
    found = []
    for nodes in levels[:-1]:
        a = i - i % fanout
        found.append((nodes[a:i], nodes[i + 1 : a + fanout]))
        i //= fanout
    return found


def plain(rows: list, fanout: int = 2) -> list[tuple]:
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (first(r["doc_id"]), leaf_of(r, r["n_chars"])))
        trees[lang] = (own, levels_of([leaf_of(r, r["n_chars"]) for r in own], fanout))
    top = levels_of([trees[x][1][-1][0] for x in langs], fanout)
    out = []
    for t, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            steps = way(levels, i, fanout) + way(top, t, fanout)
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, r["n_chars"] + hit if hit else r["n_chars"])
            for before, after in steps:
                node = sha("".join([*before, node, *after]))
            out.append((r["doc_id"], leaf_of(r, r["n_chars"]), levels[-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in steps)), node, node == top[-1][0]))
    return out


def same(got, want) -> None:
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 9), (2, 1), (3, 2)])
def test_equals_a_plain_tree(docs, fanout, levels):
    same(M.manifest(docs, M.tampering(), fanout=fanout, levels=levels).collect(), plain(docs.collect(), fanout))


def test_many_trees_and_rows(spark):
    """More trees than a block holds, of one leaf to hundreds; lengths beside powers of the block's size."""
    sizes = {f"l{i:02}": 1 + i % 5 for i in range(20)} | {None: 17, "": 16, "é": 33, "z": 400}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k, f"text {k % 90}", lang, None if k % 11 == 0 else "s", None if k % 5 == 0 else k))
            k += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    got = M.manifest(df, M.tampering(), levels=3).collect()
    same(got, plain(df.collect()))
    assert not all(r["verified"] for r in got)


def test_repeated_keys_nothing_altered_and_no_rows(spark, none):
    df = spark.createDataFrame([(1, "same", "en", "a", 4)] * 300 + [(None, None, None, None, None)] * 40 + [(1, f"t{i}", "en", "a", 2) for i in range(50)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = M.manifest(df).collect()
    assert all(r["verified"] for r in got)
    same([(*r[:5],) for r in got], [p[:5] for p in plain(df.collect())])
    assert M.manifest(none, M.tampering()).collect() == []
    one = M.manifest(df.limit(1), M.tampering()).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


def test_a_block_without_all_children_is_refused():
    with pytest.raises(ValueError):
        M.Shape().complete(((0, 0), [(0, 3, b"a", None), (2, 3, b"c", None)]))
    with pytest.raises(ValueError):
        M.Shape(fanout=1)


def test_any_change_is_found(docs):
    """Each column, where it is changed and wasn't null or the like."""
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for c, v in (("source", F.lit("other")), ("lang", F.lit("xx")), ("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))):
        assert not any(r["verified"] for r in M.manifest(rows, {c: v}).collect())
