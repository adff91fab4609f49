"""The registered queries on the smallest table: names, types and order of columns as agreed, one row a document, and SQL where there is some."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from loomfield.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
# The first columns of each query.
COLUMNS = {
    "op1": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, con, name):
    got = QUERIES[name](spark, DATA)
    ids = Counter(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())
    if name == "op3_token_packing":
        found = {d for r in got.select("doc_ids").collect() for d in r["doc_ids"]}
        assert found == {r[0] for r in con.execute("SELECT doc_id FROM documents WHERE text <> ''").fetchall()}
        return
    want = COLUMNS[name.partition("_")[0]].split(", ")
    assert [f"{c} {k}" for c, k in got.dtypes][: len(want)] == want
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == ids if "doc_id" in got.columns else rows
    if name in SQL:
        sql = con.execute(SQL[name])
        names = [d[0] for d in sql.description]
        assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(sql.fetchall())


def test_every_operator_has_one_query():
    assert sorted(n.partition("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
